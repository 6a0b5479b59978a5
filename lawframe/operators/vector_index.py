"""An inverted-file index over vectors: every point lies in the cell of its nearest centre, a search reads a few cells.

The centres come from k-means over a bounded sample (SAMPLE points by a hash of their id); every row is then dealt to its
cell, and the table is written by cell, large cells in chunks of CHUNK rows. A search sends each query to the cells with
the nearest centres (`probes`), where points are scored exactly; queries and points meet by (cell, chunk), so nothing is
compared outside the cells that were asked, and k rows a query and chunk are shuffled for the final ranks.

`probes_for` measures recall on a bounded number of the table's own points and returns the least number of probes that
reaches a target. `search_exact` needs none: by the triangle inequality a cell whose centre is farther than its radius
and the k-th best distance so far can hold nothing nearer, so all other cells are asked in a second step, and the rows are
those of `knn_join`.

`has_near` only asks whether a query has a near point. Neighbouring cells make a region, and a query goes to that of its
nearest centre, where most queries with a near point find one; the rest go to the other regions within reach. A task
holds a region's points and prunes by cell, so a query travels once a region and not once a cell.

Points with a null vector, or one of another length than most of the sample, are in no cell and are never found.
Equal scores go to the lesser record_id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lawframe.operators.search import DUPLICATE_THRESHOLD, TILE, _arrow_fields, _matrix, _nearest, _unit
from lawframe.scratch import small, stored

#: Points from which centres are fitted, centres at most, and rounds of k-means.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 1024, 12
#: Points of a chunk, and queries that a chunk meets at once.
CHUNK, BLOCK = 16_384, 4096
#: Vectors whose distances to all centres are held at once.
SLICE = 1024
#: Points of which recall is measured.
TRIED = 200
#: Scores are rounded to five places; distances that differ by less may tie.
SLACK = 2e-3
#: By how much less a score may be and still be rounded up.
HALF_PLACE = 5e-6


def placed(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Vectors where cells are made of them: on the unit sphere for cosine."""
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300) if metric == "cosine" else vectors


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def centres(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """k-means (Lloyd) from distinct random points; a centre that loses all its points moves to the farthest one."""
    rng = np.random.default_rng(seed)
    found = np.unique(sample, axis=0)
    found = found[rng.permutation(len(found))[:cells]]
    for _ in range(ROUNDS):
        far = distances(sample, found)
        own = far.argmin(1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        counts = np.bincount(own, minlength=len(found))
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
        for empty in np.flatnonzero(counts == 0):
            moved[empty] = sample[far[np.arange(len(sample)), own].argmax()]
        if np.allclose(moved, found):
            break
        found = moved
    return found


def reach_of(threshold: float) -> float:
    """Unit vectors of a rounded cosine of at least `threshold` are so near to each other."""
    return np.inf if threshold <= 0 else np.sqrt(max(2 - 2 * (threshold - HALF_PLACE), 0)) + 1e-4


def _singles(column) -> np.ndarray:
    """Unit vectors in single precision."""
    parts = [_unit(_matrix(column.slice(at, SLICE))).astype(np.float32) for at in range(0, len(column), SLICE)]
    return np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)


def with_near(some, against, middle: np.ndarray, radius: np.ndarray, threshold: float) -> np.ndarray:
    """Which of `some` (embedding, own, least: the nearest centre and its distance) have a point in `against` (embedding,
    cell) that scores at least `threshold`.

    A query meets the points of its own cell first, then those of other cells within reach, in each the points about as
    far from the centre as itself, and no more once one is found. Scores are of single precision; those that it can't
    tell from the threshold are made again in double precision and rounded.
    """
    asked, met = (x.column("embedding").combine_chunks() for x in (some, against))
    q, p = _singles(asked), _singles(met)
    own, least = (some.column(c).to_numpy() for c in ("own", "least"))
    found, reach = np.zeros(len(q), bool), reach_of(threshold)
    if not len(q) or not len(p):
        return found
    edge, margin = threshold - HALF_PLACE, (q.shape[1] + 8) * 1.2e-7

    def hits(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        scores = q[rows] @ p[points].T
        best = scores.max(1)
        hit = best >= edge + margin
        for i in np.flatnonzero(~hit & (best >= edge - margin)):
            close = points[scores[i] >= edge - margin]
            exact = _unit(_matrix(asked.slice(int(rows[i]), 1))) @ _unit(_matrix(met.take(close))).T
            hit[i] = (np.round(exact, 5) >= threshold).any()
        return hit

    of = np.where(np.isfinite(p).all(1), against.column("cell").to_numpy(), -1)
    held = {}
    for c in np.unique(of[of >= 0]):
        points = np.flatnonzero(of == c)
        away = distances(p[points].astype(float), middle[c : c + 1])[:, 0]
        order = away.argsort()
        held[c] = points[order], away[order]
    for mine in (True, False):
        for c, (points, away) in held.items():
            rows = np.flatnonzero(~found & ((own == c) == mine))
            if not len(rows):
                continue
            far = distances(q[rows].astype(float), middle[c : c + 1])[:, 0]
            if not mine:
                near = ~(far - radius[c] > reach) & ~(far > least[rows] + 2 * reach)
                rows, far = rows[near], far[near]
            order = far.argsort()
            rows, far = rows[order], far[order]
            for at in range(0, len(rows), TILE[0]):
                left, between = rows[at : at + TILE[0]], far[at : at + TILE[0]]
                begin, end = np.searchsorted(away, between[0] - reach), np.searchsorted(away, between[-1] + reach, "right")
                size = TILE[0]
                while begin < end and len(left):
                    hit = hits(left, points[begin : min(begin + size, end)])
                    found[left[hit]] = True
                    left, begin, size = left[~hit], begin + size, min(4 * size, TILE[1])
    return found


@dataclass
class VectorIndex:
    """A written index. `rows`: cell, chunk, record_id, embedding; `centres[i]` is the centre of cell i."""

    rows: DataFrame
    metric: str
    centres: np.ndarray
    radius: np.ndarray
    counts: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.centres)

    def _asked(self, queries: DataFrame, choose) -> DataFrame:
        """(query_id, embedding, cell): for each batch of queries `choose(matrix, batch)` marks the cells to ask."""
        schema = StructType([queries.schema["query_id"], queries.schema["embedding"], *StructType.fromDDL("cell int").fields])
        width = self.centres.shape[1] if self.cells else 0

        def scan(batches):
            import pyarrow as pa
            import pyarrow.compute as pc

            for batch in batches:
                sound = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("embedding")), width), False))
                if not sound.num_rows:
                    continue
                for begin in range(0, sound.num_rows, SLICE):  # with a row a query and cell, a batch would be many times itself
                    part = sound.slice(begin, SLICE)
                    row, cell = choose(_matrix(part.column("embedding")), part).nonzero()
                    for i in range(0, len(row), CHUNK):
                        at = pa.array(row[i : i + CHUNK])
                        yield pa.RecordBatch.from_arrays([part.column("query_id").take(at), part.column("embedding").take(at), pa.array(cell[i : i + CHUNK].astype(np.int32))], schema.names)

        return queries.mapInArrow(scan, schema)

    def _scored(self, asked: DataFrame, k: int) -> DataFrame:
        """The k best points of each query in each chunk of each cell that it asks."""
        asked = stored(asked, "asked")
        blocks = {r["cell"]: -(-r["count"] // BLOCK) for r in asked.groupBy("cell").count().collect()}  # a row a cell
        schema = StructType([asked.schema["query_id"], self.rows.schema["record_id"], *StructType.fromDDL("similarity_score double").fields])
        spark = self.rows.sparkSession
        if not blocks:
            return spark.createDataFrame([], schema)
        sizes = spark.createDataFrame([(c, n, max(1, -(-int(self.counts[c]) // CHUNK))) for c, n in blocks.items()], "cell int, blocks int, chunks int")
        each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        left = asked.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).withColumn("chunk", each("chunks"))
        right = self.rows.filter(F.col("cell").isin(list(blocks))).join(F.broadcast(sizes.select("cell", "blocks")), "cell").withColumn("block", each("blocks"))
        keys, metric = ("cell", "chunk", "block"), self.metric

        def meet(some, against):
            import pyarrow as pa

            made = _nearest(some, schema, k, None, False, metric)(against.combine_chunks().to_batches())
            return pa.Table.from_batches(made, pa.schema(_arrow_fields(schema)))

        names = [*keys, "embedding"]
        return left.select(*names, "query_id").groupBy(*keys).cogroup(right.select(*names, "record_id").groupBy(*keys)).applyInArrow(meet, schema)

    def _ranked(self, found: DataFrame, k: int) -> DataFrame:
        score = F.col("similarity_score")
        order = Window.partitionBy("query_id").orderBy(score.asc() if self.metric == "euclidean" else score.desc(), "record_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def _nearest_cells(self, probes: int):
        held, metric = self.rows.sparkSession.sparkContext.broadcast(self.centres), self.metric

        def choose(q, _):
            points = placed(q, metric)
            away = -(points @ held.value.T) if metric == "dot" else distances(points, held.value)
            picked = np.zeros(away.shape, bool)
            np.put_along_axis(picked, away.argpartition(min(probes, away.shape[1]) - 1, 1)[:, :probes], True, 1)
            return picked

        return choose

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query_id, record_id, similarity_score, rank): the k nearest points in the `probes` nearest cells of each of
        `queries` (query_id, embedding)."""
        asked = self._asked(queries.select("query_id", "embedding"), self._nearest_cells(max(1, probes)))
        return self._ranked(self._scored(asked, k), k)

    def search_exact(self, queries: DataFrame, k: int, probes: int = 1) -> DataFrame:
        """As `search`, but nothing is missed; cosine and euclidean alone."""
        if self.metric not in ("cosine", "euclidean"):
            raise ValueError(f"no bound for {self.metric}")
        queries = queries.select("query_id", "embedding")
        if not self.cells:
            return self.search(queries, k, probes)
        first = stored(self._ranked(self._scored(self._asked(queries, self._nearest_cells(max(1, probes))), k), k), "first")
        last = first.filter(F.col("rank") == k).select("query_id", F.col("similarity_score").alias("least"))
        sc = self.rows.sparkSession.sparkContext
        held, metric, done = sc.broadcast((self.centres, self.radius)), self.metric, self._nearest_cells(max(1, probes))

        def choose(q, batch):
            middle, radius = held.value
            least = batch.column("least").to_numpy(zero_copy_only=False).astype(float)  # NaN where fewer than k were found
            reach = np.sqrt(np.maximum(2 - 2 * least, 0)) if metric == "cosine" else least
            points = placed(q, metric)
            away = np.maximum(distances(points, middle) - radius, 0)
            if metric == "cosine":  # a zero vector is alike to all by 0
                away[np.linalg.norm(q, axis=1) == 0] = 0
            return ~(away > np.where(np.isnan(reach), np.inf, reach + SLACK)[:, None]) & ~done(q, batch)

        more = self._scored(self._asked(queries.join(last, "query_id", "left"), choose), k)
        return self._ranked(first.drop("rank").unionByName(more), k)

    def near(self, queries: DataFrame, threshold: float) -> DataFrame:
        """(query_id, record_id, similarity_score, rank): the nearest point of each query that has one of at least
        `threshold` (cosine), nothing missed.

        A point so near lies within a distance of the query, so its cell reaches as far, and as its centre is its own
        nearest, that centre is at most twice the distance farther from the query than the query's nearest one.
        """
        if self.metric != "cosine":
            raise ValueError(f"no bound for {self.metric}")
        sc = self.rows.sparkSession.sparkContext
        held = sc.broadcast((self.centres, self.radius))
        reach = reach_of(threshold)

        def choose(q, _):
            middle, radius = held.value
            away = distances(placed(q, "cosine"), middle)
            return (away - radius <= reach) & (away <= away.min(1, keepdims=True) + 2 * reach)

        queries = queries.select("query_id", "embedding")
        found = self._scored(self._asked(queries, choose), 1) if self.cells else self.search(queries, 1, 1).drop("rank")
        return self._ranked(found.filter(F.col("similarity_score") >= threshold), 1)

    def regions(self) -> np.ndarray:
        """The region of each cell: neighbouring cells that together have about CHUNK points."""
        count = max(int(np.ceil(np.sqrt(self.cells))), -(-int(self.counts.sum()) // CHUNK))
        return distances(self.centres, centres(self.centres, min(self.cells, count))).argmin(1)

    def _dealt(self, queries: DataFrame, region: np.ndarray, reach: float, first: bool) -> DataFrame:
        """(query_id, embedding, region, own, least): each query with the region of its nearest centre, or else with all
        other regions within reach."""
        schema = StructType([queries.schema["query_id"], queries.schema["embedding"], *StructType.fromDDL("region int, own int, least double").fields])
        members = np.zeros((self.cells, region.max() + 1), np.float32)
        members[np.arange(self.cells), region] = self.counts > 0
        held, width = self.rows.sparkSession.sparkContext.broadcast((self.centres, self.radius, region, members)), self.centres.shape[1]

        def scan(batches):
            import pyarrow as pa
            import pyarrow.compute as pc

            middle, radius, region, members = held.value
            for batch in batches:
                sound = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("embedding")), width), False))
                for begin in range(0, sound.num_rows, SLICE):
                    part = sound.slice(begin, SLICE)
                    points = placed(_matrix(part.column("embedding")), "cosine")
                    away = distances(points, middle)
                    own, least = away.argmin(1), away.min(1)
                    if first:
                        asked = np.zeros((len(own), members.shape[1]), bool)
                        asked[np.arange(len(own)), region[own]] = True
                    else:
                        within = ~(away - radius > reach) & ~(away > least[:, None] + 2 * reach)
                        asked = within.astype(np.float32) @ members > 0
                        asked[np.arange(len(own)), region[own]] = False
                    if reach < np.inf:  # a zero vector is alike to all by 0
                        asked[~points.any(1)] = False
                    row, to = asked.nonzero()
                    for i in range(0, len(row), CHUNK):
                        at, some = pa.array(row[i : i + CHUNK]), row[i : i + CHUNK]
                        yield pa.RecordBatch.from_arrays([part.column("query_id").take(at), part.column("embedding").take(at), pa.array(to[i : i + CHUNK].astype(np.int32)), pa.array(own[some].astype(np.int32)), pa.array(least[some])], schema.names)

        return queries.mapInArrow(scan, schema)

    def _met(self, asked: DataFrame, region: np.ndarray, threshold: float) -> DataFrame:
        """query_id of the rows of `_dealt` with a near point in the region that they ask; a task holds at most about
        2 * CHUNK points of a region and CHUNK queries."""
        asked, spark = stored(asked, "asked"), self.rows.sparkSession
        blocks = {r["region"]: -(-r["count"] // CHUNK) for r in asked.groupBy("region").count().collect()}  # a row a region
        schema = StructType([asked.schema["query_id"]])
        if not blocks:
            return spark.createDataFrame([], schema)
        points = np.bincount(region, self.counts)
        sizes = F.broadcast(spark.createDataFrame([(int(r), n, max(1, -(-int(points[r]) // (2 * CHUNK)))) for r, n in blocks.items()], "region int, blocks int, chunks int"))
        of_cell = F.broadcast(spark.createDataFrame([(i, int(r)) for i, r in enumerate(region)], "cell int, region int"))
        each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
        one_of = lambda name, *key: F.pmod(F.xxhash64(*key), name).cast("int")
        left = asked.join(sizes, "region").withColumn("block", one_of("blocks", "query_id", "embedding")).withColumn("chunk", each("chunks"))
        right = self.rows.drop("chunk").join(of_cell, "cell").join(sizes, "region").withColumn("chunk", one_of("chunks", "record_id", "embedding")).withColumn("block", each("blocks"))
        keys, held = ("region", "chunk", "block"), spark.sparkContext.broadcast((self.centres, self.radius))

        def meet(some, against):
            import pyarrow as pa

            return some.select(["query_id"]).filter(pa.array(with_near(some, against, *held.value, threshold)))

        left = left.select(*keys, "query_id", "embedding", "own", "least").groupBy(*keys)
        return stored(left.cogroup(right.select(*keys, "embedding", "cell").groupBy(*keys)).applyInArrow(meet, schema), "near")

    def has_near(self, queries: DataFrame, threshold: float) -> DataFrame:
        """query_id of the queries that have a point of at least `threshold` (cosine), nothing missed; one may stand
        several times. `queries` (query_id, embedding) are read twice."""
        if self.metric != "cosine":
            raise ValueError(f"no bound for {self.metric}")
        queries = queries.select("query_id", "embedding")
        if not self.cells:
            return queries.select("query_id").limit(0)
        region, reach = self.regions(), reach_of(threshold)
        first = self._met(self._dealt(queries, region, reach, True), region, threshold)
        left = queries.join(small(first), "query_id", "left_anti")
        return first.unionByName(self._met(self._dealt(left, region, reach, False), region, threshold))

    def probes_for(self, recall: float, k: int = 10) -> int:
        """The least number of probes (doubling, then halving the step) that finds `recall` of the k nearest, measured
        on TRIED points of the index itself against the exact answer."""
        chance = F.xxhash64("record_id", F.lit(11))
        tried = stored(self.rows.orderBy(chance).limit(TRIED).select(F.col("record_id").alias("query_id"), "embedding"), "tried")
        everything = self.search(tried, k, self.cells) if self.metric == "dot" else self.search_exact(tried, k)
        want = stored(everything.select("query_id", "record_id"), "nearest")
        total = want.count()

        def reached(probes: int) -> bool:
            return self.search(tried, k, probes).join(want, ["query_id", "record_id"]).count() >= recall * total

        high = 1
        while high < self.cells and not reached(high):
            high *= 2
        low, high = high // 2, min(high, self.cells)
        while high - low > max(1, self.cells // 32):
            middle = (low + high) // 2
            low, high = (low, middle) if reached(middle) else (middle, high)
        return high


def build(points: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, seed: int = 7) -> VectorIndex:
    """Index `points` (record_id, embedding) under `path`; `cells` centres, by default about the root of the rows."""
    if metric not in ("cosine", "euclidean", "dot"):
        raise ValueError(f"unknown metric {metric}")
    spark = points.sparkSession
    rows = points.select("record_id", "embedding").filter("embedding is not null")
    held = rows.orderBy(F.xxhash64("record_id", F.lit(seed))).limit(SAMPLE).select("embedding").toArrow().column("embedding")
    widths = np.array([len(x) for x in held.to_pylist()], int)
    width = int(np.bincount(widths).argmax()) if len(widths) else 0
    sample = placed(np.array([x for x in held.to_pylist() if len(x) == width], float).reshape(-1, max(1, width)), metric)
    rows = rows.filter(F.size("embedding") == width)
    count = cells or min(MOST_CELLS, int(np.ceil(np.sqrt(rows.count()))))
    middle = centres(sample, max(1, count), seed) if len(sample) else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(middle)
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("cell int, away double").fields])

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                away = distances(placed(_matrix(part.column("embedding")), metric), shared.value)
                cell = away.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])], schema.names)

    dealt = stored(rows.mapInArrow(deal, schema), "dealt")
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    cut = dealt.join(F.broadcast(sizes.select("cell", chunks.alias("chunks"))), "cell").withColumn("chunk", F.pmod(F.xxhash64("record_id", "embedding"), "chunks").cast("int"))
    cut.select("cell", "chunk", "record_id", "embedding").repartition("cell", "chunk").write.partitionBy("cell").parquet(f"{path}/rows")
    by_cell = {r["cell"]: r for r in sizes.collect()}  # a row a cell
    found = [(i, middle[i].tolist(), by_cell[i]["radius"] if i in by_cell else 0.0, by_cell[i]["n"] if i in by_cell else 0) for i in range(len(middle))]
    spark.createDataFrame(found, "cell int, centre array<double>, radius double, n long").coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame([(metric,)], "metric string").coalesce(1).write.parquet(f"{path}/metric")
    return load(spark, path, points.schema)


def load(spark: SparkSession, path: str, points: StructType | None = None) -> VectorIndex:
    """The index at `path`; at most MOST_CELLS centres come to the driver."""
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    schema = points and StructType([*StructType.fromDDL("chunk int").fields, points["record_id"], points["embedding"], *StructType.fromDDL("cell int").fields])
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/rows")
    width = len(cells[0]["centre"]) if cells else 1
    as_array = lambda name: np.array([c[name] for c in cells], float)
    return VectorIndex(rows, spark.read.parquet(f"{path}/metric").first()[0], as_array("centre").reshape(-1, width), as_array("radius"), as_array("n").astype(int))


def without_near_duplicates(new: DataFrame, index: VectorIndex, threshold: float = DUPLICATE_THRESHOLD) -> DataFrame:
    """As the exact anti join of `search`, against the points of an index; only the cells that can hold one are read."""
    found = index.has_near(new.select(F.col("record_id").alias("query_id"), "embedding"), threshold)
    return new.join(small(found.select(F.col("query_id").alias("record_id"))), "record_id", "left_anti")
