"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

The words of a source, its documents in a seeded order, are cut into blocks of equally many words. Targets (weights,
none above `most` times its source) are turned into whole numbers of blocks by highest quotients v / (2 s + 1); each
source's blocks are apportioned again over its shards, hash groups of about `shard_words` words, so a source with a
third of all rows is many shards. A shard with q of n blocks takes every block q div n times and q mod n more of them,
chosen by a seeded affine permutation, so whether a block is taken is arithmetic: no block is ever a row.

To the driver go one row per source and one per shard (at most `most_shards` and one more per source).

Edge cases: a null text has size 0; the null source comes last; repeated rows are documents of their own, dealt alike;
documents without words take 0; a table without words has targets 0; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawframe.llm.common import row_of, small, stored, table

WORD, REST = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]*"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of sum(sizes) by weight, none above `most` times its size; what is cut off is shared again by weight."""
    found, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        above = {i for i in free if left * weights[i] / total > most * sizes[i]}
        for i in above or free:
            found[i] = float(most * sizes[i]) if above else left * weights[i] / total
        if not above:
            break
        left -= sum(found[i] for i in above)
        free -= above
    return found


def apportion(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Sainte-Lague: `seats` by highest quotients votes / (2 s + 1), at most most[i] each; ties go to the earlier."""
    v, cap = np.array(votes, float), np.array(most, np.int64)
    seats = min(seats, int(cap.sum()))
    held = np.zeros(len(v), np.int64)
    if seats and v.sum() > 0:
        low, high = 0.0, 2 * float(v.max()) + 1  # a divisor: at `high` no more than `seats` are held
        for _ in range(200):
            mid = (low + high) / 2
            if mid in (low, high):
                break
            low, high = (low, mid) if np.minimum(np.floor(v / mid + 0.5), cap).sum() <= seats else (mid, high)
        held = np.minimum(np.floor(v / high + 0.5), cap).astype(np.int64)
    queue = [(-v[i] / (2 * held[i] + 1), i) for i in range(len(v)) if held[i] < cap[i] and v[i] > 0]
    heapq.heapify(queue)
    for _ in range(seats - int(held.sum())):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        held[i] += 1
        if held[i] < cap[i]:
            heapq.heappush(queue, (-v[i] / (2 * held[i] + 1), i))
    return held.tolist()


def mix(docs: DataFrame, *carried: str, weights: tuple = (5, 2, 1), most: int = 3, block: int = 64, seed: int = 11, shard_words: int = 1 << 18, most_shards: int = 65_536) -> DataFrame:
    """doc_id and source of each document and `row`, a struct of its `carried` columns if there are any, with size,
    source_size, target, taken, and how blocks are taken (at: words before it in its shard; blocks, rounds, more, step,
    shift: of its shard)."""
    spark = docs.sparkSession
    kept = ["doc_id", "source", *(["row"] if carried else [])]
    sized = stored(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    totals = sorted(sized.groupBy("source").agg(F.sum("size")).collect(), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r[1] for r in totals]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    per_shard = max(shard_words, sum(sizes) // most_shards)
    sources = spark.createDataFrame(
        [(r[0], r[1], t, 1 + r[1] // per_shard) for r, t in zip(totals, wanted, strict=True)],
        sized.select("source").schema.add("source_size", "long").add("target", "double").add("shards", "long"),
    )

    def sharded(rows: DataFrame) -> DataFrame:
        renamed = small(sources.withColumnRenamed("source", "of"))
        joined = rows.join(renamed, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        return joined.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), "shards"))

    shards: dict = {}
    for r in sorted(sharded(sized).groupBy("source", "shard").agg(F.sum("size")).collect(), key=lambda r: r[1]):
        shards.setdefault(r[0], []).append((r[1], r[2]))
    seats = apportion(wanted, round(sum(wanted) / block), [most * sum(-(-n // block) for _, n in shards[r[0]]) for r in totals])
    plan = []
    for (source, _), quota in zip(totals, seats, strict=True):
        words = [n for _, n in shards[source]]
        blocks = [-(-n // block) for n in words]
        for (shard, _), n, q in zip(shards[source], blocks, apportion(words, quota, [most * n for n in blocks]), strict=True):
            step = next((s for s in range(max(1, int(n * 0.618)), n + 1) if gcd(s, n) == 1), 1)
            plan.append((source, shard, n, q // n if n else 0, q % n if n else 0, step, (seed * 7919 + shard * 104_729) % n if n else 0))
    schema = sized.select(F.col("source").alias("of")).schema
    for name in ("shard", "blocks", "rounds", "more", "step", "shift"):
        schema = schema.add(name, "long")
    held = small(spark.createDataFrame(plan, schema).withColumnRenamed("shard", "of_shard"))

    from pyspark.sql import Window

    rows = sharded(docs.select("doc_id", "source", row_of(docs, carried), size_of(F.col("text")).alias("size")) if carried else sized)
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0)))
    joined = placed.join(held, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("of_shard"))).drop("of", "of_shard")
    extra = F.aggregate(taken_blocks(block), F.lit(0).cast("bigint"), lambda n, j: n + _overlap(j, block)[1])
    return joined.select(*kept, "size", "source_size", "target", (F.col("size") * F.col("rounds") + extra).alias("taken"), "at", "blocks", "rounds", "more", "step", "shift")


def taken_blocks(block: int) -> Column:
    """Numbers of the blocks under a document that its shard takes once more."""
    first, last = F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}")
    under = F.when((F.col("size") > 0) & (F.col("more") > 0), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.filter(under, lambda j: F.pmod(j * F.col("step") + F.col("shift"), F.col("blocks")) < F.col("more"))


def _overlap(j: Column, block: int) -> tuple[Column, Column]:
    """Where block j begins in the document, in words, and how many of its words lie there."""
    begin = F.greatest(j * block - F.col("at"), F.lit(0))
    return begin, F.least((j + 1) * block - F.col("at"), F.col("size")) - begin


def materialise(mixed: DataFrame, block: int = 64) -> DataFrame:
    """The rows that a mix carries (text among them): each whole as often as `rounds`, then once more its further blocks
    alone."""
    words = mixed.withColumn("words", F.when(F.col("more") > 0, F.regexp_extract_all("row.text", F.lit(WORD + REST), F.lit(0))))

    def part(j: Column) -> Column:
        begin, length = _overlap(j, block)
        return F.array_join(F.slice("words", (begin + 1).cast("int"), length.cast("int")), "")

    rest = F.array_join(F.transform(taken_blocks(block), part), "")
    whole = F.array_repeat(F.col("row.text"), F.when(F.col("size") > 0, F.col("rounds")).otherwise(0).cast("int"))
    made = words.select("row", F.explode(F.concat(whole, F.filter(F.array(F.coalesce(rest, F.lit(""))), lambda t: t != ""))).alias("made"))
    return made.select(F.col("row").withField("text", F.col("made")).alias("row")).select("row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
