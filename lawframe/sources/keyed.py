"""Keyed tables that a write touches in part: rows lie in buckets of their key, and only touched buckets are rewritten.

Each bucket is a partition folder. An upsert, a partial update or a delete reads the buckets of the keys that it brings,
writes what they become to the shared folder, and replaces those buckets alone (dynamic partition overwrite); all others
keep their files. A lookup of a few keys reads their buckets alone. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lawframe.scratch import stored


@dataclass
class KeyedTable:
    spark: SparkSession
    path: str
    key: str
    buckets: int = 64

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.filter(F.col(self.key).isNotNull()).withColumn("bucket", self._bucket())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> None:
        writer = rows.repartition(self.buckets, "bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic")
        writer.mode("overwrite").parquet(self.path)

    def create(self, rows: DataFrame, order: str) -> KeyedTable:
        """The table of `rows`, the latest of each key by `order`; rows without a key go."""
        self._write(self._latest(self._dealt(rows), F.desc(order)))
        return self

    def _latest(self, rows: DataFrame, *order: Column) -> DataFrame:
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(self.key).orderBy(*order))).filter("_n = 1").drop("_n")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def _touched(self, rows: DataFrame) -> DataFrame:
        """The table's rows in the buckets of `rows`: at most `buckets` numbers come to the driver."""
        numbers = sorted(r[0] for r in rows.select("bucket").distinct().collect())
        return self.spark.read.parquet(self.path).filter(F.col("bucket").isin(numbers))

    def upsert(self, new: DataFrame, order: str) -> None:
        """Rows of `new` take the place of rows with their keys, the latest of a key by `order`."""
        new = stored(self._dealt(new), "new")
        both = self._touched(new).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        self._write(stored(self._latest(both, F.desc("_new"), F.desc(order)).drop("_new"), "touched"))

    def update(self, delta: DataFrame) -> None:
        """Columns that `delta` sets (not null) on rows that are there; a row a key."""
        delta = stored(self._dealt(delta), "delta")
        fields = [c for c in delta.columns if c not in (self.key, "bucket")]
        old = self._touched(delta)
        joined = old.join(delta.select(self.key, *(F.col(c).alias(f"_{c}") for c in fields)), self.key, "left")
        self._write(stored(joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else c for c in old.columns)), "touched"))

    def delete(self, keys: DataFrame) -> None:
        """Rows with the given keys go; a bucket that becomes empty keeps an empty file."""
        keys = stored(self._dealt(keys.select(self.key)), "keys")
        old = self._touched(keys)
        left = stored(old.join(keys.select(self.key), self.key, "left_anti"), "touched")
        gone = sorted(r[0] for r in old.select("bucket").distinct().join(left.select("bucket").distinct(), "bucket", "left_anti").collect())
        self._write(left)
        for number in gone:  # dynamic overwrite leaves buckets without new rows as they are
            held = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={number}")
            held.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(held, True)

    def lookup(self, keys: list) -> DataFrame:
        """Rows of a few keys, from their buckets alone."""
        found = self.spark.createDataFrame([(str(k),) for k in keys], "k string").select(F.pmod(F.xxhash64("k"), F.lit(self.buckets)).cast("int")).distinct().collect()
        return self.spark.read.parquet(self.path).filter(F.col("bucket").isin([r[0] for r in found]) & F.col(self.key).isin(keys)).drop("bucket")
