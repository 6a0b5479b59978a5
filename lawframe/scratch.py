"""Tables that a job writes once into the shared folder, and what is decided by their size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that broadcast themselves have at most so many bytes, a row counting for ROW besides its columns.
BROADCAST_BYTES, ROW = 64 << 20, 16
#: Bytes of a row group, which a writing task holds in memory.
ROW_GROUP = 16 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where none is named one beside the warehouse's tables."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (at or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_dir(spark)}/lawframe-{name}-{uuid.uuid4().hex}"


def passing(spark: SparkSession, path: str) -> None:
    """What lies at `path` goes when the application ends."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(held)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once into the shared folder and read it back: lineage ends here, lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    passing(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it holds at most `most` bytes (ROW a row besides); otherwise as it is, so the join
    shuffles. Tasks count and add up their own rows, so a number a task is shuffled; `df` should be stored."""
    fixed = ROW + 8 * len(df.columns)
    long = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string") if f.dataType.typeName() not in ("string", "binary") else F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary", "array", "struct", "map")]
    size = df.select((F.lit(fixed) + sum(long, F.lit(0))).cast("bigint").alias("bytes")).agg(F.sum("bytes")).first()[0]
    return F.broadcast(df) if (size or 0) <= most else df


def numbered(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """`df` with its rows' places from 1 in an order: a sort over ranges; one count a range goes to the driver."""
    spark = df.sparkSession
    rows = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    before, offsets = 0, []
    for at, n in sorted(rows.groupBy(part.alias("part")).count().collect()):
        offsets.append((at, before))
        before += n
    base = spark.createDataFrame(offsets, "_part long, _before long")
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1
    return rows.withColumn("_part", part).join(F.broadcast(base), "_part").withColumn(name, place).drop("_part", "_at", "_before")
