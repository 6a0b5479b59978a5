"""Streams with state: what expires or is admitted without a new row, restarts on a checkpoint, and simulations."""

import random
from datetime import datetime, timedelta

import pytest

from lawframe.streaming import stateful as T

BEGAN = datetime(2024, 3, 1)
S = 1_000_000


def calls(spark, rows, value=True):
    schema = "cache_key long, id long, ts timestamp, value string" if value else "limit_key long, id long, ts timestamp"
    return spark.createDataFrame([(k, i, BEGAN + timedelta(seconds=s), *v) for k, i, s, *v in rows], schema)


def seconds(us):
    return us / S - BEGAN.timestamp()


def test_entries_vanish_at_their_time(spark, tmp_path):
    put, at = [(1, 1, 0, "a"), (1, 2, 5, None), (2, 3, 8, "b")], str(tmp_path / "cache")
    through = lambda s: T.expiring_cache(s, 10 * S)
    found = lambda df: sorted((r["cache_key"], r["what"], r["value"], seconds(r["us"])) for r in df.collect())
    assert found(T.in_steps([calls(spark, put)], through, at)) == [(1, "hit", "a", 5.0)]
    # a row of another key moves the watermark: key 1 vanishes without a row of its own, key 2 is still there
    second = found(T.in_steps([calls(spark, [(9, 4, 12, None)])], through, at))
    assert second == [(1, "expired", "a", 10.0), (1, "hit", "a", 5.0), (9, "miss", None, 12.0)]
    # started again: what was put before the restart is found, up to its last moment, and put again it lives longer
    third = found(T.in_steps([calls(spark, [(2, 5, 18, None), (2, 6, 18, "c"), (2, 7, 27.5, None), (1, 8, 13, None)])], through, at))
    assert [r for r in third if r not in second] == [(1, "miss", None, 13.0), (2, "hit", "b", 18.0), (2, "hit", "c", 27.5)]
    fourth = found(T.in_steps([calls(spark, [(9, 9, 60, None)])], through, at))
    assert [r for r in fourth if r not in third] == [(2, "expired", "c", 28.0), (9, "miss", None, 60.0)]


def simulated(times, most, period, fixed):
    made = []
    for t in times:
        a = max([t, *made[-1:]])
        while True:
            if fixed:
                used = sum(1 for x in made if x // period == a // period)
                if used < most:
                    break
                a = (a // period + 1) * period
            else:
                held = [x for x in made if x > a - period]
                if len(held) < most:
                    break
                a = held[-most] + period
        made.append(a)
    return made


@pytest.mark.parametrize("fixed", [False, True])
def test_admissions_equal_a_simulation(fixed):
    rng = random.Random(fixed)
    for _ in range(200):
        times = sorted(rng.randrange(3000) for _ in range(rng.randrange(1, 60)))
        most, period = rng.randrange(1, 5), rng.randrange(10, 200)
        limiter, state = T.Admitting(most, period, fixed), []
        assert [limiter.admit(state, t) for t in times] == simulated(times, most, period, fixed)
        assert len(state) <= max(most, 2)


def test_calls_wait_over_a_restart(spark, tmp_path):
    at, through = str(tmp_path / "calls"), lambda s: T.admitted(s, 2, 10 * S)
    found = lambda df: sorted((r["id"], seconds(r["asked_us"]), seconds(r["admitted_us"])) for r in df.collect())
    first = found(T.in_steps([calls(spark, [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 4)], False)], through, at))
    assert first == [(1, 0.0, 0.0), (2, 1.0, 1.0)]
    second = found(T.in_steps([calls(spark, [(1, 6, 12), (7, 7, 15)], False)], through, at))
    assert second == [*first, (3, 2.0, 10.0), (4, 3.0, 11.0), (7, 15.0, 15.0)]
    third = found(T.in_steps([calls(spark, [(7, 8, 100)], False)], through, at))
    assert third == sorted([*second, (5, 4.0, 20.0), (6, 12.0, 21.0), (8, 100.0, 100.0)])


def test_conversations_grow(spark):
    part = lambda *rows: spark.createDataFrame(list(rows), "conv_id long, turn long, role string, text string")
    made = T.in_steps([part((1, 1, "b", "y"), (1, 0, "a", "x"), (2, 0, "a", None)), part((1, 2, None, "z")), part((1, 3, "a", "w"), (2, 1, "b", ""))], T.conversations)
    assert sorted(map(tuple, made.collect())) == [
        (1, 2, "a: x\nb: y"), (1, 3, "a: x\nb: y\n: z"), (1, 4, "a: x\nb: y\n: z\na: w"), (2, 1, "a: "), (2, 2, "a: \nb: "),
    ]


def test_waiting_calls_take_one_access_and_one_timer():
    """However many calls wait, a batch reads and writes a key's state once."""
    import pandas as pd

    class Held:
        value, accesses = None, 0

        def exists(self):
            self.accesses += 1
            return self.value is not None

        def get(self):
            self.accesses += 1
            return self.value

        def update(self, value):
            self.accesses += 1
            self.value = value

    class Handle:
        def __init__(self):
            self.held, self.timers = Held(), []

        def getValueState(self, name, schema):
            return self.held

        def registerTimer(self, ms):
            self.timers.append(ms)

    limiter, handle = T.Admitting(1, 10 * S, fixed=True), Handle()
    limiter.init(handle)
    frame = pd.DataFrame({"us": [i * S for i in range(50)], "id": range(50)})
    made = pd.concat(limiter.handleInputRows((7,), iter([frame]), None))
    assert made["id"].tolist() == [0] and handle.timers == [10_000] and handle.held.accesses <= 3

    class At:
        getExpiryTimeInMs = getCurrentWatermarkInMs = staticmethod(lambda: 35_000)

    made = pd.concat(limiter.handleExpiredTimer((7,), At, At))
    assert made["admitted_us"].tolist() == [10 * S, 20 * S, 30 * S] and handle.timers == [10_000, 40_000]
