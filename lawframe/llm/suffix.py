"""Exact repeated substrings across a corpus, by merging shard Burrows-Wheeler transforms.

Removed is every byte covered by a string of `length` bytes (LENGTH if not said otherwise) that also starts anywhere else. Each start i of such a string has
an anchor: the least hashed 8-gram (leftmost of equals) among the WINDOW ones from i on. Equal strings have their anchor
in the same place, and all strings of an anchor share its core, the length - WINDOW + 1 bytes from the anchor on. So
strings can only be equal within a class of anchors with equal cores, whatever documents these stand in.

1. Anchors are counted by (core, context), a context being all bytes that the anchor's strings cover; only classes
   with two anchors or more go on, each distinct context once, with its count. A context that occurs twice repeats all
   of its strings as it stands; the transforms are built for the classes in which some context occurs once.
2. A context becomes a string over bytes and one symbol for its core, dealt by core to buckets. In a bucket, shards of
   strings get their Burrows-Wheeler transforms; the transforms are merged by refining their interleave: a pass sorts
   the merged rows stably by their preceding symbols, and after k passes they are in order of their first k symbols.
   Where two rows part in pass k their longest common prefix is k - 1. After WINDOW passes, intervals of rows with a
   common prefix of WINDOW symbols are the classes of equal strings.
3. Intervals with more than one occurrence go back to all anchors with that context as spans, and documents lose them.

Contexts of a core too frequent for a bucket (over `most` distinct ones) are compared start by start in Spark instead.
Cores and contexts are told apart by 64-bit hashes each.

Edge cases: a null text is empty; texts shorter than `length` keep everything; overlapping occurrences count; repeated rows
are occurrences of one another; null doc_ids are documents like others; an empty table gives no rows.
"""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawframe.llm.common import claim, few_rows_a_batch, row_of, schema_of, slices, small, stored, table

LENGTH, WINDOW = 400, 64
#: Bytes of a passage of over 50 words, at four letters and a space each.
PASSAGE = 255
U = np.uint64
#: Bits of the filter that spares anchors of unknown cores a shuffle; a fixed size, whatever the corpus.
FILTER_BITS = 27
#: Bytes of texts whose anchors are sought together, so that arrays stay in the processor's cache.
AT_ONCE = 1 << 18
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 2**64))
BYTES = np.random.default_rng(5).integers(0, 2**64, 256, U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of BASE and of its inverse, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> _Powers:
        if len(self.up) < n:
            step = np.full(max(n, 1 << 16), BASE, U), np.full(max(n, 1 << 16), INVERSE, U)
            for s in step:
                s[0] = 1
            self.up, self.down = (np.cumprod(s, dtype=U) for s in step)
        return self


_powers = _Powers()


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """For each anchor of strings of `length` bytes: the number of its text, its place there, the first and last start
    that it serves, and the hashes of its core and context; in order of texts and places."""
    found, at = [_anchors(b"", np.zeros(0, np.int64), length)], 0
    while at < len(texts):
        upto, held = at, 0
        while upto < len(texts) and (upto == at or held + len(texts[upto]) <= AT_ONCE):
            held += len(texts[upto])
            upto += 1
        text, *rest = _anchors(b"".join(texts[at:upto]), np.cumsum([len(t) for t in texts[at:upto]]), length)
        found.append((text + at, *rest))
        at = upto
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _anchors(joined: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """`anchors` of texts that lie one behind the other and end at `ends`."""
    b = np.frombuffer(joined, np.uint8)
    begins = np.r_[0, ends][:-1]
    starts = np.maximum(ends - begins - length + 1, 0)
    total, size = int(starts.sum()), length - WINDOW + 1
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    start = np.arange(total) + np.repeat(begins - starts.cumsum() + starts, starts)
    # windows that reach over a text's end are looked at by no start
    least = _mix(np.ndarray(len(b) - 7, "<u8", joined, strides=(1,)).astype(U))
    least &= U(0xFFFFFFFF00000000)
    least |= np.arange(len(least), dtype=U)
    for k in (1, 2, 4, 8, 16, 32):
        least = np.minimum(least[:-k], least[k:])
    at = (least[start] & U(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    first, last, place = start[head], start[np.r_[head[1:] - 1, total - 1]], at[head]
    powers = _powers.upto(len(b))
    sums = np.zeros(len(b) + 1, U)
    np.cumsum(BYTES[b] * powers.up[: len(b)], dtype=U, out=sums[1:])
    core = _mix((sums[place + size] - sums[place]) * powers.down[place])
    context = _mix((sums[last + length] - sums[first]) * powers.down[first]) ^ _mix((place - first << 8 | last - first).astype(U))
    text = np.searchsorted(ends, first, "right")
    return text, place - begins[text], first - begins[text], last - begins[text], core.view(np.int64), context.view(np.int64)


def repeated_starts(contexts: list[tuple[int, bytes, bytes, int]], shards: int = 4) -> list[np.ndarray]:
    """For each context (core, bytes before the anchor, bytes behind the core, count) which of its starts are repeated.

    Start j of a context begins j bytes into it; it has len(left) + len(right) - WINDOW + 2 starts.
    """
    cores = {c: k for k, c in enumerate(sorted({x[0] for x in contexts}))}
    if len(cores) > 65_000:
        raise ValueError("too many cores for one bucket")
    strings = [np.concatenate([np.frombuffer(left, np.uint8) + np.uint16(1), np.array([257 + cores[c], *(x + 1 for x in right), 0], np.uint16)]) for c, left, right, _ in contexts]
    size = -(-len(strings) // shards)
    owner, offset, transforms, ids = [], [], [], []
    for number, at in enumerate(range(0, len(strings), size)):
        some = strings[at : at + size]
        order, of, start, symbols, before = _shard(some)
        owner.append(of[order] + at)
        offset.append(start[order])
        transforms.append(symbols[before][order])
        ids.append(np.full(len(order), number, np.uint8))
    owner, offset, transform, interleave = map(np.concatenate, (owner, offset, transforms, ids))
    common, interleave = merge(transform, interleave, WINDOW)
    rows = interleave.argsort(kind="stable")  # merged row of each shard row, shard by shard
    merged_owner, merged_offset = np.empty_like(owner), np.empty_like(offset)
    merged_owner[rows], merged_offset[rows] = owner, offset
    heads = np.flatnonzero(common < WINDOW)
    counts = np.array([x[3] for x in contexts], np.int64)[merged_owner]
    weight = np.add.reduceat(counts, heads)
    many = np.repeat(weight > 1, np.diff(np.r_[heads, len(common)]))
    starts = np.array([len(x[1]) + len(x[2]) - WINDOW + 2 for x in contexts])
    kept = many & (merged_offset < starts[merged_owner])
    found = [np.zeros(n, bool) for n in starts]
    edges = np.cumsum(np.r_[0, starts])
    flat = np.zeros(edges[-1], bool)
    flat[edges[merged_owner[kept]] + merged_offset[kept]] = True
    for k in range(len(found)):
        found[k] = flat[edges[k] : edges[k + 1]]
    return found


def _shard(strings: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Suffix order of a shard by prefix doubling; string, offset and symbol of each suffix, and the place before it."""
    symbols = np.concatenate(strings)
    sizes = np.array([len(s) for s in strings])
    begin = np.repeat(sizes.cumsum() - sizes, sizes)
    of = np.repeat(np.arange(len(strings)), sizes)
    place = np.arange(len(symbols))
    offset, left = place - begin, begin + np.repeat(sizes, sizes) - place
    rank, step = symbols.astype(np.int64), 1
    while step < 2 * WINDOW:
        ahead = np.where(left > step, np.r_[rank[step:], np.zeros(min(step, len(rank)), np.int64)][: len(rank)] + 1, 0)
        key = rank * (int(rank.max()) + 2) + ahead
        _, rank = np.unique(key, return_inverse=True)
        step *= 2
    order = np.lexsort((of, rank))
    before = np.where(offset > 0, place - 1, begin + np.repeat(sizes, sizes) - 1)
    return order, of, offset, symbols, before


def merge(transform: np.ndarray, interleave: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of shards after `depth` passes, and each merged row's common prefix with the row before (at most depth).

    `transform` holds the shards' transforms one behind the other, `interleave` the shard of each row.
    """
    n = len(transform)
    common = np.zeros(n, np.uint8)  # passes that a row has not yet parted from the one before
    block = np.zeros(n, np.int32)
    shards = range(int(interleave.max()) + 1)
    for _ in range(depth):
        merged = np.empty_like(transform)
        merged[np.concatenate([np.flatnonzero(interleave == k) for k in shards])] = transform
        turn = merged.argsort(kind="stable")
        symbol, block, interleave = merged[turn], block[turn], interleave[turn]
        parts = np.ones(n, bool)
        np.not_equal(symbol[1:], symbol[:-1], out=parts[1:])
        parts[1:] |= block[1:] != block[:-1]
        common += ~parts
        block = parts.cumsum(dtype=np.int32)
    return common, interleave


def _spans(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of true flags."""
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()


def _keyed(docs: DataFrame) -> DataFrame:
    """key (doc_id, null as the least number) and mark (a hash of the text) name a document's text."""
    few_rows_a_batch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("key"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _free(spark) -> None:
    """Let Spark drop the shuffle files of frames that are no longer used."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def starts_within(size: int, low: np.ndarray, high: np.ndarray, shorter: int, length: int) -> np.ndarray:
    """Which starts of strings of `length` bytes in a text of `size` bytes have only starts of repeated `shorter` strings
    in them, given the first and last of runs of these."""
    n, span = size - shorter + 1, length - shorter + 1
    if n < span:
        return np.zeros(0, bool)
    edge = np.bincount(low, minlength=n + 1) - np.bincount(high + 1, minlength=n + 1)
    open_ = np.zeros(n + 1, np.int32)
    np.cumsum(edge[:n].cumsum() > 0, out=open_[1:])
    return open_[span:] - open_[:-span] == span


def anchors_within(texts: list[bytes], runs: list[tuple[np.ndarray, np.ndarray]], shorter: int, length: int) -> tuple[np.ndarray, ...]:
    """`anchors` of the runs of starts that may repeat; only the bytes of these strings are looked at."""
    pieces = [(k, a, t[a : b + length]) for k, (t, r) in enumerate(zip(texts, runs, strict=True)) for a, b in zip(*_spans(starts_within(len(t), *r, shorter, length)), strict=True)]
    piece, *places, core, context = anchors([p[2] for p in pieces], length)
    text, begin = (np.array([p[k] for p in pieces], np.int64)[piece] for k in (0, 1))
    return text, *(p + begin for p in places), core, context


def _runs(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Firsts and lasts of each row of an Arrow column of spans."""
    offsets = column.offsets.to_numpy()
    first, last = (x.to_numpy() for x in column.flatten().flatten())
    return [(first[a:b], last[a:b]) for a, b in zip((offsets[:-1] - offsets[0]).tolist(), (offsets[1:] - offsets[0]).tolist(), strict=True)]


def repeated_spans(docs: DataFrame, most: int = 20_000, bucket_rows: int = 800, length: int = LENGTH, within: DataFrame | None = None, shorter: int = PASSAGE) -> DataFrame:
    """(key, mark, spans array<struct<first, last>>): runs of starts of repeated strings, for each text that has any.

    `within` are the same for strings of `shorter` bytes: as a string only repeats where all shorter ones in it do, texts
    without them and anchors outside of them are left out from the start.
    """
    spark, keyed = docs.sparkSession, _keyed(docs)
    if length < WINDOW + 7:
        raise ValueError(f"strings have {WINDOW + 7} bytes at least: all 8-grams that an anchor is chosen from")
    texts, limited = ["key", "mark", "text"], within is not None
    if limited:
        touched = keyed.join(small(within.select("key", "mark")), ["key", "mark"], "left_semi")
        keyed, texts = stored(touched.join(within, ["key", "mark"]), "touched"), [*texts, "spans"]
    counted = schema_of(keyed, ["key", "mark"], "nth int, width int, core long, context long, n long")

    def found_in(batch) -> tuple[np.ndarray, ...]:
        """The anchors of the batch's texts, those that may repeat."""
        given = batch.column("text").to_pylist()
        return anchors_within(given, _runs(batch.column("spans")), shorter, length) if limited else anchors(given, length)

    def count(batches):
        import pyarrow as pa

        claim()
        for batch in slices(batches, 4 << 20):
            row, _, first, last, core, context = found_in(batch)
            if not len(row):
                continue
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            # copies within a slice travel as one row
            order = np.lexsort((context, core))
            heads = np.flatnonzero(np.r_[True, (core[order][1:] != core[order][:-1]) | (context[order][1:] != context[order][:-1])])
            some, n = order[heads], np.diff(np.r_[heads, len(order)])
            at = pa.array(row[some])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(at), batch.column("mark").take(at), pa.array(nth[some].astype(np.int32)), pa.array((last - first)[some].astype(np.int32)), pa.array(core[some]), pa.array(context[some]), pa.array(n)], counted.names
            )

    from pyspark.sql import Window

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed.select(*texts).mapInArrow(count, counted).repartition(partitions, "core")
    sums = rows.groupBy("core", "context").agg(F.sum("n").alias("n"), F.min(F.struct("key", "mark", "nth")).alias("at"), F.first("width").alias("width"))
    whole = Window.partitionBy("core")
    classes = sums.withColumn("all", F.sum("n").over(whole)).filter("all > 1")
    # a context that occurs twice repeats all of its strings; bytes are looked at where a context occurs once
    classes = classes.withColumn("open", F.min("n").over(whole) == 1).select("core", "context", "n", "width", "open", "at.*")
    classes = stored(classes, "classes")
    _free(spark)
    settled = classes.filter("n > 1").select("core", "context", F.array(F.lit(0)).alias("first"), F.array("width").alias("last"))

    # the contexts' bytes, from one document that holds each
    wanted = classes.filter("open").groupBy("key", "mark").agg(F.collect_list(F.struct("nth", "core", "context", "n")).alias("wanted"))
    having = keyed.select(*texts).join(small(wanted.select("key", "mark")), ["key", "mark"], "left_semi").dropDuplicates(["key", "mark"])
    cut = schema_of(classes, ["core", "context", "n"], "before binary, behind binary")

    def extract(batches):
        import pyarrow as pa

        for batch in slices(batches):
            row, place, first, last, _, _ = found_in(batch)
            nth, core, context, n = batch.column("wanted").flatten().flatten()
            asked = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("wanted").offsets.to_numpy()))
            at = np.searchsorted(row, asked) + nth.to_numpy()
            texts_ = batch.column("text").to_pylist()
            ends = list(zip(asked.tolist(), place[at].tolist(), first[at].tolist(), last[at].tolist(), strict=True))
            before = pa.array([texts_[k][lo:a] for k, a, lo, _ in ends], pa.binary())
            behind = pa.array([texts_[k][a + length - WINDOW + 1 : hi + length] for k, a, _, hi in ends], pa.binary())
            yield pa.RecordBatch.from_arrays([core, context, n, before, behind], cut.names)

    contexts = stored(having.join(wanted, ["key", "mark"]).select(*texts, "wanted").mapInArrow(extract, cut), "contexts")
    _free(spark)
    frequent = contexts.groupBy("core").agg(F.count("*").alias("contexts")).filter(F.col("contexts") > most).select("core")
    buckets = max(1, contexts.count() // bucket_rows)
    marked = schema_of(contexts, ["core", "context"], "first array<int>, last array<int>")

    def refine(held):
        import pyarrow as pa

        given = [held.column(c).to_pylist() for c in ("core", "before", "behind", "n")]
        runs = [_spans(f) for f in repeated_starts(list(zip(*given, strict=True)))]
        some = [k for k, (r, n) in enumerate(zip(runs, given[3], strict=True)) if n == 1 and r[0]]
        first, last = (pa.array([runs[k][side] for k in some], pa.list_(pa.int32())) for side in (0, 1))
        return pa.table([*(held.column(c).take(pa.array(some, pa.int64())) for c in ("core", "context")), first, last], marked.names)

    few = contexts.join(small(frequent), "core", "left_anti")
    merged = few.groupBy(F.pmod(F.xxhash64("core"), F.lit(buckets)).alias("bucket")).applyInArrow(refine, marked)
    if frequent.limit(1).count():
        merged = merged.unionByName(_start_by_start(contexts.join(small(frequent), "core", "left_semi")))
    repeats = stored(merged.unionByName(settled), "repeats")
    _free(spark)

    # back to every anchor with such a context
    words = repeats.select((F.shiftrightunsigned("core", 64 - FILTER_BITS)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    held = words.toArrow()  # 2 ** (FILTER_BITS - 6) rows at most
    bits = np.zeros(1 << FILTER_BITS - 6, U)
    bits[held.column("word").to_numpy()] = held.column("bits").to_numpy().view(U)
    shared = spark.sparkContext.broadcast(bits)
    member = schema_of(keyed, ["key", "mark"], "begin int, core long, context long")

    def members(batches):
        import pyarrow as pa

        known = shared.value
        for batch in slices(batches):
            row, _, first, _, core, context = found_in(batch)
            bit = core.view(U) >> U(64 - FILTER_BITS)
            maybe = np.flatnonzero(known[bit >> U(6)] >> (bit & U(63)) & U(1))
            at = pa.array(row[maybe])
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("mark").take(at), pa.array(first[maybe].astype(np.int32)), pa.array(core[maybe]), pa.array(context[maybe])], member.names)

    placed = keyed.select(*texts).mapInArrow(members, member).join(repeats, ["core", "context"])
    span = F.zip_with("first", "last", lambda a, b: F.struct((F.col("begin") + a).alias("first"), (F.col("begin") + b).alias("last")))
    spans = placed.groupBy("key", "mark").agg(F.array_sort(F.flatten(F.collect_set(span))).alias("spans"))
    return spans


def _start_by_start(contexts: DataFrame) -> DataFrame:
    """The same answer for contexts of very frequent cores: each start's string is counted in Spark."""
    starts = contexts.withColumn("j", F.explode(F.sequence(F.lit(0), F.length("before") + F.length("behind") - WINDOW + 1)))
    # start j takes the bytes before the anchor from j on, and as many behind the core as the window leaves
    left = F.length("before") - F.col("j")
    own = F.sha2(F.concat(left.cast("string").cast("binary"), F.expr("substring(before, j + 1)"), F.substr("behind", F.lit(1), F.lit(WINDOW - 1) - left)), 256)
    keyed = starts.select("core", "context", "n", "j", own.alias("own"))
    many = keyed.groupBy("core", "own").agg(F.sum("n").alias("all")).filter("all > 1").select("core", "own")
    found = keyed.filter("n = 1").join(many, ["core", "own"]).groupBy("core", "context").agg(F.array_sort(F.collect_set("j")).alias("first"))
    return found.select("core", "context", "first", F.col("first").alias("last"))


def remove_repeats(docs: DataFrame, *carried: str, whole_characters: bool = False, length: int = LENGTH, passages: int | None = None) -> DataFrame:
    """doc_id of every row, `row` (a struct of its `carried` columns, if there are any), the text without repeated bytes
    (as bytes), n_bytes, n_removed, n_spans, n_repeated.

    With `whole_characters` the halves of characters that were cut go too. With `passages`, less than `length`, n_repeated
    counts the bytes that repeated strings of so many bytes cover, removed or not; else it is n_removed.
    """
    extra, spark = ["row"] if carried else [], docs.sparkSession
    none = "array<struct<first:int,last:int>>"
    if passages:
        wide = stored(repeated_spans(docs, length=passages), "passages")
        _free(spark)
        cut_ = stored(repeated_spans(docs, length=length, within=wide, shorter=passages), "spans")
        spans = wide.withColumnRenamed("spans", "wide").join(cut_, ["key", "mark"], "left").withColumn("spans", F.coalesce("spans", F.array().cast(none)))
    else:
        spans = stored(repeated_spans(docs, length=length), "spans").withColumn("wide", F.lit(None).cast(none))
    _free(spark)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", *([row_of(docs, carried)] if carried else []), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("_key"), F.xxhash64(text).alias("_mark"), text.alias("_text"))
    touched = small(spans.select(F.col("key").alias("_key"), F.col("mark").alias("_mark")))
    zero = F.lit(0).cast("bigint")
    whole = rows.join(touched, ["_key", "_mark"], "left_anti").select("doc_id", *extra, F.col("_text").alias("text"), F.length("_text").cast("bigint").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), zero.alias("n_repeated"))
    cutting = rows.join(touched, ["_key", "_mark"], "left_semi").join(spans.withColumnsRenamed({"key": "_key", "mark": "_mark", "spans": "_spans", "wide": "_wide"}), ["_key", "_mark"])
    schema = schema_of(rows, ["doc_id", *extra], "text binary, n_bytes long, n_removed long, n_spans long, n_repeated long")

    def covered(size: int, run: tuple[np.ndarray, np.ndarray], of: int) -> np.ndarray:
        edge = np.bincount(run[0], minlength=size + 1) - np.bincount(run[1] + of, minlength=size + 1)
        return edge[:-1].cumsum() > 0

    def cut(batches):
        import pyarrow as pa

        for batch in slices(batches):
            made = []
            wider = _runs(batch.column("_wide")) if passages else [None] * batch.num_rows
            for raw, run, wide in zip(batch.column("_text").to_pylist(), _runs(batch.column("_spans")), wider, strict=True):
                gone = covered(len(raw), run, length)
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                if whole_characters:
                    left = left.decode("utf-8", "ignore").encode()
                repeated = gone if wide is None else covered(len(raw), wide, passages)
                made.append((left, len(raw), int(gone.sum()), len(_spans(gone)[0]), int(repeated.sum())))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *extra)), *(pa.array(x, t) for x, t in zip(zip(*made, strict=True) if made else [()] * 5, kinds, strict=True))], schema.names)

    return whole.unionByName(cutting.select("doc_id", *extra, "_text", "_spans", "_wide").mapInArrow(cut, schema))


def op3_suffix(spark, sf_dir: str) -> DataFrame:
    """Per document what repeated strings of LENGTH bytes take away, and the bytes that stand in repeated passages of PASSAGE bytes."""
    made = remove_repeats(table(spark, sf_dir, "documents"), passages=PASSAGE)
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"), "n_repeated")
