"""Usage metering: daily counters, limits, overviews and rate windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawframe.scratch import small


def daily(events: DataFrame) -> DataFrame:
    """(user_id, day, questions, tokens) of rows (user_id, ts, tokens)."""
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("questions"), F.sum("tokens").alias("tokens"))


def limited(events: DataFrame, limits: DataFrame) -> DataFrame:
    """Events with their running counts of the day and whether they are within their tier's limits.

    Counts run over all requests of the day, accepted or not, in the order of (ts, event_id).
    """
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("questions", F.count("*").over(w)).withColumn("total_tokens", F.sum("tokens").over(w))
    return counted.join(small(limits), "tier").withColumn("accepted", (F.col("questions") <= F.col("max_questions")) & (F.col("total_tokens") <= F.col("max_tokens")))


def overview(users: DataFrame, subscriptions: DataFrame, today: DataFrame) -> DataFrame:
    """Users with tier and today's usage, zeros and FREE where there is none."""
    joined = users.join(subscriptions, "user_id", "left").join(today.select("user_id", "questions", "tokens"), "user_id", "left")
    return joined.withColumns({"tier": F.coalesce("tier", F.lit("FREE")), "questions": F.coalesce("questions", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})


def answered(requests: DataFrame, templates: DataFrame, fallback: str) -> DataFrame:
    """Requests (question) with the template's answer where the question equals one, else the fallback."""
    return requests.join(templates, "question", "left").withColumn("answer", F.coalesce("answer", F.lit(fallback)))


def sliding_counts(events: DataFrame, seconds: int) -> DataFrame:
    """Events with the number of their user's events within the last `seconds`, itself included."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(w))


def fixed_windows(events: DataFrame, seconds: int) -> DataFrame:
    return events.groupBy("user_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens")).select("user_id", F.col("w.start").alias("start"), "requests", "tokens")
