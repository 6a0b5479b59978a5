"""Sessions, byte-level BPE and fill-in-middle: odd inputs, brute force, round trips."""

from __future__ import annotations

import hashlib
import random
import re
import sys
from datetime import UTC, datetime, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from lawframe.llm import bpe, fim, sessions  # noqa: E402

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")
M = sessions.MINUTE


@pytest.fixture(scope="module")
def odd(spark):
    return H.odd_documents(spark)


@pytest.fixture(scope="module")
def none(spark):
    return H.odd_documents(spark, empty=True)


# 11 sessions

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
COLUMNS = ["client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by", "path_sha256"]
BEGAN = datetime(2024, 1, 31, 22, 0)


def us(t: datetime) -> int:
    return round((t.replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


def by_brute_force(rows, gap=5 * M, length=120 * M, late=60 * M):
    once = {r[0]: r for r in rows if r[0] is not None and r[1] is not None and r[3] is not None}
    clients, made = {}, []
    for r in once.values():
        clients.setdefault(r[3], []).append(r)
    for client, clicks in clients.items():
        is_late = lambda r: r[2] is not None and us(r[2]) - us(r[1]) > late
        timely = sorted((us(r[1]), r[0], r[4] == "purchase" and r[5] is not None and r[5] >= 60, r[5]) for r in clicks if not is_late(r))
        found = []
        for c in timely:
            if found:
                first, last = found[-1][0], found[-1][-1]
                why = "end" if last[2] else "gap" if c[0] - last[0] >= gap else "length" if c[0] - first[0] > length else None
                if why:
                    found.append([])
                    reasons.append(why)
            else:
                found, reasons = [[]], []
            found[-1].append(c)
        for k, s in enumerate(found):
            until = found[k + 1][0][0] if k + 1 < len(found) else None
            n_late = sum(1 for r in clicks if is_late(r) and us(r[1]) >= s[0][0] and (until is None or us(r[1]) < until))
            closed = reasons[k] if k < len(reasons) else "end" if s[-1][2] else "none"
            cents = sum(int(np.floor(100 * c[3] + 0.5)) for c in s if c[3] is not None)
            path = hashlib.sha256(",".join(str(c[1]) for c in s).encode()).hexdigest()
            made.append((client, s[0][1], s[0][0], s[-1][0], len(s), n_late, cents, closed, path))
    return sorted(made)


def got(spark, rows, **how):
    df = sessions.sessionise(spark.createDataFrame(rows, CLICKS), **how)
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def busy(seed: int, n: int, mean_s: float, clients=(1, 2)) -> list[tuple]:
    """Clicks of clients at random distances, now and then a long break, a tie, a late or a final click, a repeat."""
    rng, rows = random.Random(seed), []
    for client in clients:
        at = BEGAN + timedelta(seconds=rng.random() * 4000)
        for k in range(n):
            x = rng.random()
            at += timedelta(seconds=0 if x < 0.05 else 300 if x < 0.06 else rng.expovariate(1 / 40_000) if x < 0.065 else rng.expovariate(1 / mean_s))
            arrives = at + timedelta(seconds=rng.choice((1, 1, 1, 1, 1, 1, 3600, 3601, 90_000)))
            rows.append((client * 1_000_000 + rng.randrange(10) * 10_000 + k, at, arrives, client, rng.choice(("purchase", "view", "view", None)), rng.choice((None, 60.0, 59.994, 1.005, 12.5)), None))
            if rng.random() < 0.05:
                rows.append(rows[-1])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "mean_s"), [(1, 20), (2, 60), (3, 150)])
def test_sessions_by_brute_force(spark, seed, mean_s):
    rows = busy(seed, 1200, mean_s)
    assert got(spark, rows, rows_a_group=300) == by_brute_force(rows)


@pytest.mark.parametrize("step", [7, 61, 290])
def test_sessions_of_machines_without_breaks(spark, step):
    """Nothing but length cuts over days: slices wait for the ones before."""
    rng = random.Random(step)
    rows, at = [], BEGAN
    for k in range(2500):
        at += timedelta(seconds=step * (0.5 + rng.random() / 2))
        late = k % 40 == 0
        rows.append((k * 7 % 2503, at, at + timedelta(hours=2 if late else 0), 5, "view", 1.0, None))
        if k % 1200 == 900:
            rows.append((10_000 + k, at + timedelta(seconds=1), None, 5, "purchase", 99.0, None))
    want = by_brute_force(rows, length=20 * M)
    assert got(spark, rows, length=20 * M, width=60 * M, rows_a_group=500) == want
    assert {"length"} <= {w[7] for w in want} and len(want) > 10
    for width in (51 * M, 24 * 60 * M):
        assert got(spark, rows, length=20 * M, width=width) == want


def test_sessions_limits(spark):
    at = lambda s, u=0: BEGAN + timedelta(seconds=s, microseconds=u)
    rows = [
        (1, at(0), at(0), 1, "view", 1.0, None), (2, at(299, 999_999), at(300), 1, "view", None, None),  # 1 us under a gap
        (3, at(599, 999_999), at(600), 1, "purchase", 60.0, None),  # a gap
        (4, at(599, 999_999), at(600), 1, "view", 2.0, None),  # behind a final click, at the same time
        (5, at(700), at(4300), 1, "view", 0.0, None), (6, at(701), at(4301, 1), 1, "view", 0.0, None),  # 60 minutes; late
        (7, at(90_000), at(200_000), 1, "view", 5.0, None),  # late, after all sessions
        (8, at(0), at(90_000), 2, "view", 5.0, None),  # late clicks alone
        (9, None, at(0), 1, "view", 1.0, None), (10, at(0), at(0), None, "view", 1.0, None), (None, at(0), at(0), 1, "view", 1.0, None),
        (11, at(0), None, 3, None, float("nan"), None), (12, at(50_000), None, 3, "purchase", float("inf"), None),
    ]
    found = {(r[0], r[1]): r[3:8] for r in got(spark, rows + rows[:3])}
    assert found == {
        (1, 1): (us(at(299, 999_999)), 2, 0, 100, "gap"), (1, 3): (us(at(599, 999_999)), 1, 0, 6000, "end"), (1, 4): (us(at(700)), 2, 2, 200, "none"),
        (3, 11): (us(at(0)), 1, 0, 0, "gap"), (3, 12): (us(at(50_000)), 1, 0, 0, "none"),
    }
    assert got(spark, []) == []


def test_session_query_equals_sql(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    duck = duckdb.connect()
    duck.execute(f"create view clicks as select * from '{big}/clicks.parquet'")
    want = duck.sql(sessions.ORACLE)
    assert sorted(map(tuple, sessions.op11_sessions(spark, big).select(*want.columns).collect())) == sorted(want.fetchall())


# 12 byte-level BPE


@pytest.fixture(scope="module")
def lib():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBPE(bpe.read_ranks(RANKS), P.PATTERN)


def test_bpe_equals_library(own, lib):
    rng = random.Random(5)
    pool = [" ", "\n", "\t", "\r", " ", "　", " ", "a", "b", " the", "don't", "'s", "1", "23", "é", "日本", "🎉", "é", "\x1c", "\x85", "<|endoftext|>", "!!", "\x00", "ſ"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    letters = "abcdefghijklmnopqrstuvwxyzéß"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(1500)] + ["a" * 3000, "ab" * 2000, "日" * 500, "".join(rng.choice(letters) for _ in range(20_000))]
    for text in texts:
        ids = own.encode(text.encode())
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text), text[:80]
        assert own.decode(ids) == text.encode()


def test_bpe_pairs_are_those_of_merges(own):
    rng = random.Random(6)
    tokens = [t for t in own.token if len(own.token[t]) < 10]
    common = sorted(tokens)[:2000]
    refused = 0
    for _ in range(15_000):
        a, b = rng.choice(common), rng.choice(common if rng.random() < 0.7 else tokens)
        want = own.merged(own.token[a] + own.token[b]) == [a, b]
        refused += not want
        assert own.stands(a, b) == want
    assert refused > 100


def test_bpe_query(spark, odd, none, lib):
    want = {(r["doc_id"], tuple(lib.encode_ordinary(r["text"] or ""))) for r in odd.collect()}
    made = bpe.encode(odd, RANKS, P.PATTERN)
    assert {(r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in made.collect()} == want
    back = {(r["doc_id"], bytes(r["text"]).decode()) for r in bpe.decode(made, RANKS, P.PATTERN).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in odd.collect()}
    found = bpe.digests(odd, RANKS, P.PATTERN).collect()
    assert len(found) == odd.count()
    for r in found:
        ids = next(t for d, t in want if d == r["doc_id"] and len(t) == r["n_tokens"])
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.digests(none, RANKS, P.PATTERN).count() == 0


def test_bpe_query_over_a_table(spark, sf_dir, lib):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.op12_bpe(spark, sf_dir).collect():
        ids = np.array(lib.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_bpe_keeps_what_is_asked_for_again():
    asked = []
    kept = bpe.Recent(lambda x: asked.append(x) or x, 3)
    for x in (b"a", b"b", b"c", b"d", b"a", b"e", b"f", b"a", b"x" * 100, b"x" * 100):
        assert kept[x] == x
    assert asked.count(b"a") == 1 and asked.count(b"x" * 100) == 2 and len(kept) + len(kept.old) <= 6


# 13 fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fim_by_brute_force(key, text: str, seed=42, rate=50, spm=80):
    units = UNIT.findall(text)
    n, h = len(units), fim.draws(seed, key)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text.encode()
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}".encode()
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}".encode()


@pytest.mark.parametrize("rate", [50, 100])
def test_fim_by_brute_force(rate):
    rng = random.Random(rate)
    pool = [" ", "\n", "\t", "a", "bc", "é", "日本", "🎉", "<", "<P", ">", "<S>", "S>", "M", " ", "\x1c", "x" * 500, "é" * 700, " \n" * 600]
    texts = ["".join(rng.choice(pool[: rng.randint(3, len(pool))]) for _ in range(rng.randint(0, 30))) for _ in range(2500)]
    found = fim.transformed(list(range(len(texts))), [t.encode() for t in texts], 42, rate, 80)
    for i, (text, made) in enumerate(zip(texts, found, strict=True)):
        assert made == fim_by_brute_force(i, text, rate=rate)
        assert fim.restored(made[4], made[1]) == text.encode()
    assert {f[1] for f in found} == {"plain", "psm", "spm"}


def test_fim_query_odd(spark, odd, none):
    made = fim.read_back(fim.fill_in_middle(odd, rate=100)).collect()
    want = sorted((repr(r["doc_id"]), *fim_by_brute_force(r["doc_id"], r["text"] or "", rate=100)) for r in odd.collect())
    assert sorted((repr(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], bytes(r["output"])) for r in made) == want
    assert sorted(bytes(r["restored"]) for r in made) == sorted((r["text"] or "").encode() for r in odd.collect())
    assert fim.fill_in_middle(none).count() == 0
    assert fim.fill_in_middle(odd.withColumnRenamed("doc_id", "of"), key="of").count() == odd.count()


def test_fim_query_equals_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = duck.sql(fim.ORACLE)
    found = fim.op13_fim(spark, sf_dir).select(*want.columns)
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
    assert found.filter(F.col("form") != "plain").count() > 20


# later mends of earlier operators


def test_labels_that_say_nothing_give_no_rule(spark):
    from lawframe.llm import urls

    rng = random.Random(8)
    pages = [f"http://{rng.choice('abcdef')}.{rng.choice(('com', 'org', 'net'))}/{rng.choice('xyz')}/{rng.choice('uvw')}?{rng.choice('pq')}=1" for _ in range(120)]
    bad = [i < 70 for i in range(120)]
    for _ in range(12):
        rng.shuffle(bad)
        assert urls.mine_rules(spark.createDataFrame(list(zip(pages, bad, strict=True)), "url string, bad boolean"), 0.02, 1.2).count() == 0


def test_likeness_by_brute_force():
    from collections import Counter

    from lawframe.llm.fingerprint import Fingerprint

    rng, errors = random.Random(9), []
    pairs = lambda t: Counter(p for line in t.split("\n") for p in zip(line.split(), line.split()[1:], strict=False))
    for k in range(300):
        words = H.prose(k, rng.choice((40, 150, 600, 3000))).split()
        other = [w if rng.random() > (k % 10) / 20 else f"{w}{k}" for w in words]
        a, b = " ".join(words), " ".join(other)
        x, y = pairs(a), pairs(b)
        errors.append(abs(Fingerprint.of(a.encode()).likeness(Fingerprint.of(b.encode())) - (x & y).total() / (x | y).total()))
    assert sorted(errors)[int(0.95 * len(errors))] <= 0.1
    one, two = Fingerprint.of(b"a b\nc d"), Fingerprint.of(b"c d")
    assert (one - two).equals(Fingerprint.of(b"a b")) and (two + Fingerprint.of(b"a b")).equals(one)


def test_repeated_labelled_rows_come_once(spark):
    from lawframe.llm import quality

    docs = spark.createDataFrame([(1, H.prose(1, 50)), (2, H.prose(2, 50))] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen, fit = [], quality.fit
    quality.fit = lambda x, y: seen.append(len(x)) or fit(x, y)
    try:
        quality.train(docs, labels)
    finally:
        quality.fit = fit
    assert seen and seen[0] <= 2
