"""Streams: a query queue with poison rows set apart, idempotent writes, daily usage, rate windows, file arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawframe.scratch import passing, scratch_path

MESSAGE = "query_id string, query_text string, llm_provider string, timestamp bigint"


def messages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value) rows of a queue to parsed messages, and those without an id or a text."""
    parsed = raw.withColumn("m", F.from_json("value", MESSAGE))
    good = F.coalesce(F.col("m.query_id").isNotNull() & (F.trim(F.col("m.query_text")) != ""), F.lit(False))
    return parsed.filter(good).select("m.*"), parsed.filter(~good).select("value")


def deduplicated(stream: DataFrame, key: str = "query_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """First delivery of each key within the watermark: `late` is how far apart deliveries may be, and bounds the state."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def daily_usage(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Per user and day: questions and tokens; the watermark drops days that are over."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "user_id")
    return grouped.agg(F.count("*").alias("questions"), F.sum("tokens").alias("tokens")).select("user_id", F.to_date("day.start").alias("day"), "questions", "tokens")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return grouped.agg(F.count("*").alias("events")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def arriving_texts(spark: SparkSession, folder: str, glob: str = "*.txt", per_trigger: int = 100) -> DataFrame:
    """(path, text) of files as they arrive."""
    lines = spark.readStream.option("wholetext", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What is there now, run through `stream` into the shared folder: appended rows by the file sink, a complete
    result by one folder a micro-batch, of which the last counts."""
    spark, at = stream.sparkSession, scratch_path(stream.sparkSession, "stream")
    rows, writer = f"{at}/rows", stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", rows).start().awaitTermination()
        passing(spark, at)
        return spark.read.schema(stream.schema).parquet(rows)
    done: list[int] = []

    def put(frame: DataFrame, number: int) -> None:
        frame.write.mode("overwrite").parquet(f"{rows}/{number}")
        done.append(number)

    writer.foreachBatch(put).start().awaitTermination()
    passing(spark, at)
    return spark.read.schema(stream.schema).parquet(f"{rows}/{max(done)}") if done else spark.createDataFrame([], stream.schema)


def batches(stream: DataFrame, handle, checkpoint: str) -> None:
    """Each micro-batch to `handle(frame, number)`; a batch that fails comes again, so `handle` has to be idempotent."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def enqueue(messages_: DataFrame, folder: str) -> None:
    """Messages (query_id, query_text, llm_provider, timestamp) put into a queue's folder as JSON lines."""
    messages_.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(folder)


def consume(spark: SparkSession, folder: str, handle, poison: str, checkpoint: str, per_trigger: int = 10) -> None:
    """What lies in a queue's folder, at least once: good messages to `handle(frame, number)`, others to the folder
    `poison`, one folder a batch so that a repeated batch writes the same. The checkpoint takes a batch as done only
    after `handle` has returned; a batch that fails is delivered again."""
    raw = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder)

    def one(frame: DataFrame, number: int) -> None:
        good, bad = messages(frame)
        bad.write.mode("overwrite").text(f"{poison}/{number}")
        handle(good, number)

    batches(raw, one, checkpoint)


def live(cache: DataFrame, now: int) -> DataFrame:
    """Cache rows (cache_key, ttl, ...) of a stream or a table that have not expired."""
    return cache.filter(F.col("ttl") >= now)
