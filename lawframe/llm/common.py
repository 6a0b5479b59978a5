"""What the operators of this subpackage share: tables, scratch space, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lawframe.scratch import small, stored  # noqa: F401  (the operators take them from here)

#: Rows of an Arrow batch.
ARROW_ROWS = 1000
#: Words and other units up to so many bytes are kept in workers' caches; longer ones are made anew.
SHORT = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few_rows_a_batch(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_ROWS rows in this session, since rows are whole documents: a batch is held by the
    executor and by its worker, several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and the text as UTF-8 bytes, null as empty."""
    few_rows_a_batch(docs.sparkSession)
    return docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def free(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores behind it as it takes to be no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_of(df: DataFrame, columns: list[str]):
    """The columns as one struct `row`, so that their names meet no others."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")


def slices(batches: Iterator, size: int = 8 << 20) -> Iterator:
    """Arrow batches cut so that none holds much more than `size` bytes (a single row may)."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(size, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def schema_of(df: DataFrame, kept: list[str], added: str) -> StructType:
    """The columns `kept` of `df` followed by those of the DDL string `added`."""
    return StructType([df.schema[c] for c in kept] + StructType.fromDDL(added).fields)


class Memo:
    """Answers that a worker keeps, at most about `most`; when full, those of the last two calls stay.

    What is longer than SHORT bytes is kept for the call that asks for it alone, so that bytes are bounded as well.
    """

    def __init__(self, most: int):
        self.most, self.found, self.last, self.long = most, {}, set(), []

    def missing(self, asked: set) -> list:
        """What of `asked` is not known; the caller then adds it to `found`."""
        for x in self.long:
            self.found.pop(x, None)
        new = [x for x in asked if x not in self.found]
        self.long = [x for x in new if len(x) > SHORT]
        if len(self.found) + len(new) > self.most:
            self.found = {k: self.found[k] for k in self.last | asked if k in self.found}
        self.last = asked.difference(self.long)
        return new


class Words(dict):
    """A number for each word (bytes), made once while it is kept; at most `most` words of at most SHORT bytes."""

    def __init__(self, make: Callable[[bytes], int], most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: bytes) -> int:
        found = self.make(word)
        if len(word) <= SHORT:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


_claimed: list = []


def claim(*caches) -> None:
    """Called by a task that fills `caches`: what other operators' tasks have kept in this worker goes.

    Workers outlive stages; without this each would end up with the caches of every operator of a pipeline.
    """
    stale = [c for c in _claimed if not any(c is own for own in caches)]
    _claimed[:] = caches
    if stale:
        for c in stale:
            c.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Return freed memory to the system, where the allocators can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)
