"""Streams that keep state a key: a cache whose entries expire, call limiters that admit, conversations that grow.

State lives in the state store (RocksDB) under the query's checkpoint, so a query that is started again goes on where it
was. What has to happen at some time without a new row (an entry expires, a waiting call is admitted) hangs on event-time
timers: it happens once the watermark has passed that time. Within a micro-batch a key's rows are taken by (time, id);
batches are taken as they come, and rows behind the watermark are dropped by Spark.

A key's rows of one micro-batch pass through one task, in chunks; the trigger bounds them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lawframe.scratch import passing, scratch_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


class ExpiringCache(StatefulProcessor):
    """Rows (cache_key, id, us, value) of a key: a value is put, null asks for it. Gives hit, miss and expired rows.

    An entry lives for `ttl` microseconds from its last put, the last one included.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, until_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        made, held = [], self.entry.get() if self.entry.exists() else None
        frame = _ordered(rows, ["us", "id"])
        for at, number, value in zip(frame["us"], frame["id"], frame["value"], strict=True):
            if held is not None and held[1] < at:
                made.append((key[0], None, held[1], "expired", held[0]))
                held = None
            if value is not None and value == value:
                held = (value, int(at) + self.ttl)
            else:
                made.append((key[0], number, int(at), "miss" if held is None else "hit", None if held is None else held[0]))
        if held is None:
            self.entry.clear()
        else:
            self.entry.update(held)
            self.handle.registerTimer(held[1] // 1000 + 1)
        yield _frame(made, CACHE_ROWS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        if held is not None and held[1] < expiredTimerInfo.getExpiryTimeInMs() * 1000:  # else it was put again
            self.entry.clear()
            yield _frame([(key[0], None, held[1], "expired", held[0])], CACHE_ROWS)

    def close(self) -> None:
        pass


class Admitting(StatefulProcessor):
    """Rows (limit_key, id, us) of a key, each with the time at which it is admitted, given out when it is.

    Sliding: at most `calls` admissions in any `period` microseconds. Fixed: at most `calls` in each period from 1970 on.
    Calls wait in the order in which they asked.
    """

    def __init__(self, calls: int, period: int, fixed: bool = False):
        self.calls, self.period, self.fixed = calls, period, fixed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the last admissions, or a window's start and its calls; and the calls that wait, all in one value with one timer
        # for the first of them, since each access to the state is a round trip
        self.held = handle.getValueState("held", "recent array<long>, ids array<long>, asked array<long>, admitted array<long>")

    def admit(self, recent: list[int], at: int) -> int:
        """When a call of time `at` is admitted; `recent` is brought up to date."""
        if self.fixed:
            own = at - at % self.period
            start, used = recent or (own, 0)
            if own > start:
                start, used = own, 0
            elif used >= self.calls:
                start, used = start + self.period, 0
            recent[:] = [start, used + 1]
            return max(at, start)
        admitted = max(at, recent[0] + self.period) if len(recent) >= self.calls else at
        recent.append(max(admitted, recent[-1]) if recent else admitted)
        del recent[: -self.calls]
        return recent[-1]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent, made, waiting, first = [], [], [], None
        if self.held.exists():
            recent, *columns = map(list, self.held.get())
            waiting = list(zip(*columns, strict=True))
            first = min((-(-w[2] // 1000) for w in waiting), default=None)
        frame = _ordered(rows, ["us", "id"])
        for at, number in zip(frame["us"].tolist(), frame["id"].tolist(), strict=True):
            admitted = self.admit(recent, at)
            if admitted == at:
                made.append((key[0], number, at, at))
            else:
                waiting.append((number, at, admitted))
        self._keep(recent, waiting, first)
        yield _frame(made, ADMITTED_ROWS)

    def _keep(self, recent: list[int], waiting: list[tuple], timed: int | None) -> None:
        """Held from now on; a timer for the first that waits, unless there is one at `timed` or before."""
        self.held.update((recent, *(map(list, zip(*waiting, strict=True)) if waiting else ([], [], []))))
        first = min((-(-w[2] // 1000) for w in waiting), default=None)
        if first is not None and (timed is None or first < timed):
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        recent, *columns = map(list, self.held.get())
        waiting = list(zip(*columns, strict=True))
        done = [w for w in waiting if -(-w[2] // 1000) <= now]
        if done:
            self._keep(recent, [w for w in waiting if -(-w[2] // 1000) > now], None)
            yield _frame([(key[0], *w) for w in done], ADMITTED_ROWS)

    def close(self) -> None:
        pass


class Conversations(StatefulProcessor):
    """Rows (conv_id, turn, role, text) of a conversation are appended; a row a batch tells the history so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "role string, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _ordered(rows, ["turn", "role", "text"])
        new = [(r, t) for r, t in zip(frame["role"].fillna(""), frame["text"].fillna(""), strict=True)]
        self.turns.appendList(new)
        said = list(self.turns.get())
        yield _frame([(key[0], len(said), "\n".join(f"{r}: {t}" for r, t in said))], HISTORY_ROWS)

    def close(self) -> None:
        pass


CACHE_ROWS = "cache_key long, id long, us long, what string, value string"
ADMITTED_ROWS = "limit_key long, id long, asked_us long, admitted_us long"
HISTORY_ROWS = "conv_id long, turns int, history string"


def _frame(rows: list[tuple], ddl: str) -> pd.DataFrame:
    kinds = [x.split() for x in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pd.DataFrame({name: pd.array(values, dtype={"long": "Int64", "int": "Int32"}[kind]) if kind in ("long", "int") else pd.Series(values, dtype=object) for (name, kind), values in zip(kinds, columns, strict=True)})


def _timed(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)


def expiring_cache(rows: DataFrame, ttl: int, late: str = "0 seconds") -> DataFrame:
    """A stream (cache_key long, id long, ts timestamp, value string or null) through a cache of `ttl` microseconds."""
    return _timed(rows, late).groupBy("cache_key").transformWithStateInPandas(ExpiringCache(ttl), CACHE_ROWS, "Append", "eventTime")


def admitted(calls: DataFrame, most: int, period: int, fixed: bool = False, late: str = "0 seconds") -> DataFrame:
    """A stream of calls (limit_key long, id long, ts timestamp), each given out when a limiter admits it."""
    return _timed(calls, late).groupBy("limit_key").transformWithStateInPandas(Admitting(most, period, fixed), ADMITTED_ROWS, "Append", "eventTime")


def conversations(turns: DataFrame) -> DataFrame:
    """A stream of turns (conv_id long, turn, role, text): after each batch the history of what was spoken in it."""
    return turns.groupBy("conv_id").transformWithStateInPandas(Conversations(), HISTORY_ROWS, "Append", "none")


def in_steps(parts: list[DataFrame], through: Callable[[DataFrame], DataFrame], at: str | None = None) -> DataFrame:
    """`parts` one after the other through a stream with state, each by a query that is started on the checkpoint of the
    one before and takes what is there; returns all that has come out. `at` is a folder to go on with later."""
    spark = parts[0].sparkSession
    if at is None:
        at = scratch_path(spark, "steps")
        passing(spark, at)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for part in parts:
            part.write.mode("append").parquet(f"{at}/in")
            made = through(spark.readStream.schema(part.schema).parquet(f"{at}/in"))
            made.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(made.schema).parquet(f"{at}/out")
