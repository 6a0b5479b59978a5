"""Near duplicates by DartMinHash.

A text's elements are its five-word shingles, each weighted by its count. Over every element the plane of weight and
rank is cut into unit cells; a cell holds a Poisson(1) number of darts, thrown by hashing, and each dart names one of K
coordinates. Of the darts below an element's weight the earliest (least rank) per coordinate is kept: two texts agree in
a coordinate with the probability of their weighted Jaccard similarity, and a text only looks at ranks up to about
K ln K / its total weight, so long texts throw few darts an element.

Two texts are alike if their shingles are, with counts (sums of lesser over sums of greater ones) or as sets; a text in
which shingles repeat therefore sends a signature of either kind. Equal texts are one node from the start, named by
their hash, whatever their doc_ids, and send one member on. Coordinates are banded; in each bucket every member is
paired with a few anchors (the least, and the most central ones), pairs are verified exactly on their shingles, and
links are closed to components. Where a bucket's members are still in different components, those outside the largest
are compared with all others that shared buckets connect, in blocks and exactly. So no link that shares a bucket is
lost, while a large group of near copies costs a few pairs a member.

Edge cases: a null text is empty; empty texts are one class; a text of fewer than five words is one shingle of all its
words; words are runs between white space, compared as they are; repeated rows are copies; different texts with one
doc_id are linked only if they are alike; a class is named by its least doc_id, null where all of its rows have none, so
`root` (the least hash of its texts) tells classes apart where names are null or repeated; an empty table gives no rows.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lawframe.llm.common import Words, claim, schema_of, slices, small, stored, table, texts

WORDS, ALIKE = 5, 0.8
#: Coordinates in BANDS bands of ROWS: a pair of similarity 0.8 misses all of them once in 150,000 times.
BANDS, ROWS = 30, 5
COORDINATES = BANDS * ROWS
ANCHORS = 4
#: Rows of one text beyond which its class is broadcast to them.
OFTEN = 1000
U = np.uint64
#: Chances that a cell holds at most 0, 1, 2 ... darts, as 32-bit numbers.
POISSON = (np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(12)]) * 2**32).astype(U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _hash(word: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(word)


_words = Words(_hash)


def _begin() -> None:
    """What tasks start with; a function of the module, so that workers use the module's own cache."""
    claim(_words)


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of a text's shingles, and how often each occurs."""
    words = text.split()
    hashes = np.fromiter(map(_words.__getitem__, words), U, len(words))
    if not len(hashes):
        return hashes, np.zeros(0, np.uint32)
    count = max(1, len(hashes) - WORDS + 1)
    found = np.full(count, min(len(hashes), WORDS), U)
    for k in range(min(WORDS, len(hashes))):
        found = _mix(found ^ hashes[k : k + count])
    found, counts = np.unique(found, return_counts=True)
    return found, counts.astype(np.uint32)


def packed(elements: np.ndarray, counts: np.ndarray) -> bytes:
    return elements.tobytes() + counts.tobytes()


def unpacked(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(held) // 12
    return np.frombuffer(held, U, n), np.frombuffer(held, np.uint32, n, 8 * n)


def alike(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether two texts' shingles have a Jaccard similarity of ALIKE or more, as sets or with counts."""
    (a, m), (b, n) = x, y
    sets, sums = sorted((len(a), len(b))), sorted((int(m.sum()), int(n.sum())))
    if sets[0] < ALIKE * sets[1] and sums[0] < ALIKE * sums[1]:
        return False
    _, i, j = np.intersect1d(a, b, True, True)
    both = int(np.minimum(m[i], n[j]).sum())
    return len(i) >= ALIKE * (sum(sets) - len(i)) or both >= ALIKE * (sum(sums) - both)


def dart_minhash(elements: np.ndarray, weights: np.ndarray | None = None, coordinates: int = COORDINATES) -> np.ndarray:
    """Signature (64-bit names of the kept darts) of distinct elements with positive weights (1 if none are given)."""
    total = float(len(elements) if weights is None else weights.sum())
    limit = (coordinates * log(coordinates) + 2 * coordinates) / total
    while True:
        ranks = ceil(limit)
        if weights is None:
            cells, layer, most = elements, np.zeros(1, U), None
        else:
            layers = np.ceil(weights).astype(np.int64)
            cells = np.repeat(elements, layers)
            layer = (np.arange(len(cells)) - np.repeat(layers.cumsum() - layers, layers)).astype(U)
            most = np.repeat(weights, layers) - layer
        cell = _mix(cells ^ _mix(layer + U(1)))
        if ranks > 1:
            cell, most = np.tile(cell, ranks), None if most is None else np.tile(most, ranks)
        floor = np.repeat(np.arange(ranks, dtype=np.int64), len(cell) // ranks)
        cell = _mix(cell + floor.astype(U) * U(0x9E3779B97F4A7C15))
        darts = np.searchsorted(POISSON, cell >> U(32), "right")
        at = np.repeat(np.arange(len(cell)), darts)
        nth = (np.arange(len(at)) - np.repeat(darts.cumsum() - darts, darts)).astype(U)
        dart = _mix(cell[at] + (nth + U(1)) * U(0xD1B54A32D192ED03))
        rank = floor[at] + (dart >> U(11)).astype(float) * 2.0**-53
        kept = rank <= limit
        if most is not None:
            kept &= (_mix(dart ^ U(0x5851F42D4C957F2D)) >> U(11)).astype(float) * 2.0**-53 < most[at]
        dart, rank = dart[kept], rank[kept]
        name = _mix(dart ^ U(0x2545F4914F6CDD1D))
        coordinate = (name >> U(20)) % U(coordinates)
        order = np.lexsort((rank, coordinate))
        first, where = np.unique(coordinate[order], return_index=True)
        if len(first) == coordinates:
            return name[order][where]
        limit *= 2  # a coordinate without a dart: look further


def bands_of(signature: np.ndarray) -> np.ndarray:
    found = np.arange(BANDS, dtype=U)
    for row in signature.reshape(BANDS, ROWS).T:
        found = _mix(found ^ row)
    return found.astype(np.int64)


def keys_of(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bucket keys of a text: its bands as a set, and, if shingles repeat, with counts."""
    if not len(elements):
        return np.zeros(0, np.int64)
    found = bands_of(dart_minhash(elements))
    return found if counts.max() == 1 else np.unique(np.concatenate([found, bands_of(dart_minhash(elements, counts.astype(float)))]))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, copy (hash of the text), bands (none for an empty text)."""
    df = texts(docs, "doc_id").withColumn("copy", F.unhex(F.md5("text")))
    schema = schema_of(df, ["doc_id", "copy"], "bands array<long>")

    def scan(batches):
        import pyarrow as pa

        _begin()
        for batch in slices(batches):
            found = [keys_of(*shingles(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(found, pa.list_(pa.int64()))], schema.names)

    return df.mapInArrow(scan, schema)


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(copy, elements: its shingles and their counts as bytes) of the texts in `nodes` (copy, name: a doc_id that has the text)."""
    hashed = texts(docs, "doc_id").withColumn("copy", F.unhex(F.md5("text")))
    named = small(nodes.select(F.col("copy").alias("node"), "name"))
    # by name as well, so that of exact copies those with another doc_id stay behind; repeated rows are still there
    found = hashed.join(named, (F.col("copy") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("name")), "left_semi")
    wanted = found.groupBy("copy").agg(F.first("text").alias("text"))
    schema = schema_of(wanted, ["copy"], "elements binary")

    def scan(batches):
        import pyarrow as pa

        _begin()
        for batch in slices(batches):
            made = [packed(*shingles(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("copy"), pa.array(made, pa.binary())], schema.names)

    return stored(wanted.mapInArrow(scan, schema), "shingles")


def verified(pairs: DataFrame, docs: DataFrame, names: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b: hashes of different texts) whose shingles are alike enough, exactly."""
    sets = shingle_sets(docs, names.join(small(pairs.select(F.explode(F.array("a", "b")).alias("copy")).distinct()), "copy", "left_semi"))
    sides = pairs.join(sets.select(F.col("copy").alias("b"), F.col("elements").alias("right")), "b").join(
        sets.select(F.col("copy").alias("a"), F.col("elements").alias("left")), "a"
    )
    linked = schema_of(pairs, ["a", "b"], "")

    def compare(batches):
        import pyarrow as pa

        for batch in slices(batches):
            kept = [alike(unpacked(x.as_py()), unpacked(y.as_py())) for x, y in zip(batch.column("left"), batch.column("right"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return sides.select("a", "b", "left", "right").mapInArrow(compare, linked)


def _linked_in_blocks(open_: DataFrame, docs: DataFrame, names: DataFrame, asked_bytes: int = 1 << 20, held_bytes: int = 4 << 20) -> DataFrame:
    """Links (a, b) between components of one cluster, for rows (member, root, least: the least of a shared bucket).

    A cluster is what shared buckets connect. Its members outside of its main component are the queries; they meet all
    its members in blocks of bounded size, are compared exactly there, and one link to each other component comes out.
    Members are dealt by (cluster, block), never by cluster alone.
    """
    clusters = components(open_.filter("member <> least").select(F.col("least").alias("a"), F.col("member").alias("b")).distinct())
    members = open_.select("member", "root").distinct().join(clusters.withColumnsRenamed({"node": "member", "root": "cluster"}), "member")
    sets = shingle_sets(docs, names.join(small(members.select(F.col("member").alias("copy"))), "copy", "left_semi"))
    sized = stored(members.join(sets.withColumnRenamed("copy", "member"), "member"), "members")
    # sums by component first, so that a large cluster arrives as a row a task and component
    shares = sized.groupBy("cluster", "root").agg(F.count("*").alias("share"), F.sum(F.length("elements")).alias("bytes"))
    main = F.max_by("root", F.struct("share", "root"))
    total = shares.groupBy("cluster").agg(main.alias("main"), F.sum("bytes").alias("bytes"), F.max_by("bytes", F.struct("share", "root")).alias("of_main"))
    plan = total.select("cluster", "main", (1 + F.floor(F.col("bytes") / held_bytes)).cast("int").alias("blocks"), (1 + F.floor((F.col("bytes") - F.col("of_main")) / asked_bytes)).cast("int").alias("parts"))
    rows = sized.join(small(stored(plan, "plan")), "cluster").withColumn("block", F.pmod(F.xxhash64("member"), "blocks").cast("int")).withColumn("part", F.pmod(F.xxhash64("member"), "parts").cast("int"))
    packed_ = F.collect_list(F.struct("member", "root", "elements"))
    held = rows.groupBy("cluster", "block").agg(packed_.alias("held"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    asked = rows.filter("root <> main").groupBy("cluster", "blocks", "part").agg(packed_.alias("asked")).select("cluster", "asked", each)
    schema = StructType.fromDDL("a binary, b binary")

    def compare(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            found = []
            for some, all_ in zip(batch.column("asked").to_pylist(), batch.column("held").to_pylist(), strict=True):
                given = [unpacked(x["elements"]) for x in all_]
                sizes, sums = (np.array([f(x) for x in given], np.int64) for f in (lambda x: len(x[0]), lambda x: int(x[1].sum())))
                values, counts = (np.concatenate([x[k] for x in given]) for k in (0, 1))
                order = values.argsort(kind="stable")
                owner, values, counts = np.repeat(np.arange(len(all_)), sizes)[order], values[order], counts[order]
                for x in some:
                    own, own_counts = unpacked(x["elements"])
                    low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                    hits = high - low
                    at = np.repeat(low - (hits.cumsum() - hits), hits) + np.arange(int(hits.sum()))
                    both = np.bincount(owner[at], minlength=len(all_))
                    shared = np.bincount(owner[at], np.minimum(np.repeat(own_counts, hits), counts[at]), len(all_))
                    near = np.flatnonzero((both >= ALIKE * (len(own) + sizes - both)) | (shared >= ALIKE * (int(own_counts.sum()) + sums - shared)))
                    others = {all_[i]["root"]: all_[i]["member"] for i in near.tolist() if all_[i]["root"] != x["root"]}
                    found += [(min(x["member"], m), max(x["member"], m)) for m in others.values()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["a", "b"])

    return asked.join(held, ["cluster", "block"]).select("asked", "held").mapInArrow(compare, schema)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each one's component. Label propagation with pointer jumping, a table a round."""
    # a node's lesser neighbours hang on the least of them: as connected, with few more edges than nodes
    # (joined, not collected: a central node may be the neighbour of half of a bucket)
    least = links.groupBy("b").agg(F.min("a").alias("least"))
    thin = links.join(least, "b").select(F.col("least").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
    edges = stored(thin.select(F.col("a").alias("x"), F.col("b").alias("y")).union(thin.select("b", "a")), "edges")
    roots = stored(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("root")), "roots")
    for _ in range(rounds):
        near = edges.join(roots, edges.y == roots.node).groupBy("x").agg(F.min("root").alias("near"))
        met = roots.join(near, roots.node == near.x).select("node", "root", F.least("root", "near").alias("least"))
        # a root that learns of a lesser one passes it to all its nodes
        passed = met.groupBy("root").agg(F.min("least").alias("passed"))
        merged = met.join(passed, "root").select("node", F.col("root").alias("old"), F.least("least", "passed").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = stored(merged.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root")), "roots")
        changed = new.filter("old <> root").limit(1).count()
        roots = new.select("node", "root")
        if not changed:
            return roots
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, copy (hash of the text), root (least hash of its class) and class_id (least doc_id of its class) of every row."""
    docs = docs.select("doc_id", "text")
    made = stored(signatures(docs), "signatures")
    classes = stored(made.groupBy("copy").agg(F.min("doc_id").alias("name"), F.first("bands").alias("bands"), F.count("*").alias("rows")), "classes")
    names = classes.select("copy", "name")
    keyed = classes.select(F.col("copy").alias("member"), F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    full = stored(keyed.join(sizes, "key"), "buckets")
    # anchors: the least member, and of each third of members the one whose buckets are largest, which is most central
    central = full.groupBy("member").agg(F.sum("n").alias("weight"))
    third = lambda k: F.when(F.pmod(F.xxhash64("member"), F.lit(ANCHORS - 1)) == k, F.struct("weight", "member"))
    anchors = full.join(central, "member").groupBy("key").agg(F.array_compact(F.array_distinct(F.array(F.min("member"), *(F.max_by("member", third(k)) for k in range(ANCHORS - 1))))).alias("anchors"))
    first = stored(
        full.join(anchors, "key").select("member", F.explode("anchors").alias("anchor")).filter("member <> anchor")
        .select(F.least("member", "anchor").alias("a"), F.greatest("member", "anchor").alias("b")).distinct(),
        "pairs",
    )
    links = stored(verified(first, docs, names), "links")
    roots = components(links)
    # buckets whose members are not in one component yet, and what these buckets connect
    placed = full.join(roots.withColumnRenamed("node", "member"), "member", "left").select("key", "member", F.coalesce("root", "member").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.min("member").alias("least"))
    open_ = stored(placed.join(split.filter("low <> high and n > 2").select("key", "least"), "key").select("member", "root", "least").distinct(), "open")
    if open_.limit(1).count():
        more = stored(_linked_in_blocks(open_, docs, names), "links")
        if more.limit(1).count():
            roots = components(links.union(more))
    # only now hashes turn into doc_ids: a linked class has the least of its texts' names
    linked = stored(names.join(roots.withColumnRenamed("node", "copy"), "copy"), "linked")
    least = linked.groupBy("root").agg(F.min("name").alias("class_id"))
    classed = linked.join(small(least), "root").select("copy", "root", "class_id")
    named = classes.select("copy", "name", "rows").join(classed, "copy", "left").select(
        "copy", "rows", F.coalesce("root", "copy").alias("root"), F.when(F.col("root").isNull(), F.col("name")).otherwise(F.col("class_id")).alias("class_id")
    )
    # texts with many copies travel to their rows, all others meet them by hash
    often, rows = named.filter(F.col("rows") > OFTEN).drop("rows"), made.select("doc_id", "copy")
    often = small(stored(often, "often"))
    others = rows.join(often.select("copy"), "copy", "left_anti").join(named.filter(F.col("rows") <= OFTEN).drop("rows"), "copy")
    return rows.join(often, "copy").unionByName(others).select("doc_id", "copy", "root", "class_id")


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
