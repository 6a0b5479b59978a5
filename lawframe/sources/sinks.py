"""Sinks: JSON files, keyed JSON lines, vector collections and repaired texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawframe.operators.store import upsert

METRICS = ("cosine", "dot", "euclidean", "manhattan")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upsert_jsonl(spark: SparkSession, path: str, new: DataFrame, schema: str, key: str = "record_id") -> str:
    """A new folder beside `path` with the old records, overwritten in place, and the new ones behind them.

    The caller swaps folders, so a reader never sees half a write.
    """
    old = spark.read.schema(schema + ", seq long").json(path)
    rows = upsert(old, new, key)
    made = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    rows.withColumn("seq", F.col("place._side") * 10**15 + F.col("place.seq")).drop("place").repartitionByRange("seq").sortWithinPartitions("seq").write.json(made)
    return made


def sections_json(sections: DataFrame) -> DataFrame:
    """(doc_id, json): a document's sections in order as one JSON array."""
    row = F.struct("ord", "section_id", "parent_id", "marker", "level", "header", "title", "content")
    return sections.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("json"))


def ensure_collection(spark: SparkSession, path: str, dim: int, metric: str) -> DataFrame:
    """The points of a collection folder, made empty if there is none; another dimension or an unknown metric is an error."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        spark.createDataFrame([], "record_id string, embedding array<float>, payload string").write.parquet(path)
    points = spark.read.parquet(path)
    other = points.filter(F.size("embedding") != dim).limit(1).count()
    if other:
        raise ValueError(f"points of a dimension other than {dim}")
    return points


def reset_collection(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], "record_id string, embedding array<float>, payload string").write.mode("overwrite").parquet(path)


def parsed_vector(text: Column) -> Column:
    """array<float> of comma-separated numbers, blanks left out."""
    return F.transform(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.cast("float"))


def joined_chunks(chunks: DataFrame) -> DataFrame:
    """(doc_id, text): chunks in order, blank lines between."""
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda r: r["text"]), "\n\n").alias("text"))


def scrolled(points: DataFrame, record_id: str | None = None, content: str | None = None, limit: int = 100) -> DataFrame:
    """The first points by record_id that meet all given filters."""
    kept = points
    if record_id:
        kept = kept.filter(F.col("record_id") == record_id)
    if content:
        kept = kept.filter(F.lower("content").contains(content.lower()))
    return kept.orderBy("record_id").limit(limit)


def merged_appendices(main: DataFrame, appendices: DataFrame) -> DataFrame:
    """Section rows of a document and of its appendices (with `position`), which count on from its last segment."""
    last = main.groupBy("doc_id").agg(F.max("doc_number").alias("_last"))
    added = appendices.join(last, "doc_id").withColumn("doc_number", (F.col("_last") + F.col("position")).cast("int"))
    return main.unionByName(added.select(*main.columns))
