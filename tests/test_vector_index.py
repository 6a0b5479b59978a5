"""The vector index against brute force, and the metrics of a search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawframe.operators import vector_index as V
from lawframe.operators.search import knn_join


def clustered(spark, n=1500, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(20, dim)) * 3
    x = middles[rng.integers(0, 20, n)] + rng.normal(size=(n, dim)) * 0.4
    x[5], x[6] = x[4], x[4]  # ties
    x[7] = 0
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)] + [(n, None), (n + 1, [1.0, 2.0])]
    return spark.createDataFrame(rows, "record_id long, embedding array<float>"), x


def queries_of(points):
    return points.filter("record_id % 20 < 2 and size(embedding) > 2").select(F.col("record_id").alias("query_id"), "embedding")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["record_id"], round(r["similarity_score"], 4)) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_exact_search_equals_knn_join(spark, tmp_path, metric, monkeypatch):
    monkeypatch.setattr(V, "CHUNK", 50)  # large cells in several chunks
    monkeypatch.setattr(V, "BLOCK", 20)  # and queries in several blocks
    points, _ = clustered(spark)
    index = V.build(points, str(tmp_path / "index"), metric, cells=25)
    sound = points.filter("size(embedding) = 12")
    want = rows(knn_join(queries_of(points), sound, 7, metric=metric))
    assert rows(index.search_exact(queries_of(points), 7)) == want
    assert rows(index.search(queries_of(points), 7, 25)) == want
    assert index.counts.sum() == 1500 and index.cells == 25
    again = V.load(spark, str(tmp_path / "index"))
    assert rows(again.search_exact(queries_of(points), 7, probes=3)) == want


def test_exact_search_leaves_cells_out(spark, tmp_path):
    points, _ = clustered(spark)
    index = V.build(points, str(tmp_path / "index"), cells=20)
    asked = []
    scored = index._scored

    def counted(cells, k):
        asked.append(cells.count())
        return scored(cells, k)

    index._scored = counted
    queries = queries_of(points).filter("query_id <> 7")
    index.search_exact(queries, 5).count()
    assert sum(asked) < 0.35 * 20 * queries.count()


def test_search_reads_asked_cells_alone(spark, tmp_path):
    points, _ = clustered(spark)
    index = V.build(points, str(tmp_path / "index"), cells=20)
    plan = index.search(queries_of(points).filter("query_id = 0"), 5, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cell" in plan or "PartitionFilters: [cell" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_recall_and_probes(spark, sf_dir, tmp_path):
    big = sf_dir.replace("sf0.001", "sf0.1")
    points = spark.read.parquet(f"{big}/embeddings.parquet").select(F.col("vec_id").alias("record_id"), "embedding")
    queries = points.filter("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), "embedding")
    index = V.build(points, str(tmp_path / "index"))
    probes = index.probes_for(0.95)
    found = index.search(queries, 10, probes).select("query_id", "record_id")
    want = knn_join(queries, points, 10).select("query_id", "record_id")
    recall = found.join(want, ["query_id", "record_id"]).count() / want.count()
    print(f"recall@10 {recall:.3f} with {probes} of {index.cells} cells")
    assert recall >= 0.9


def test_odd_indexes(spark, tmp_path):
    none = spark.createDataFrame([], "record_id long, embedding array<float>")
    empty = V.build(none, str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<float>")
    assert empty.search_exact(asked, 3).count() == 0 and empty.search(asked, 3, 1).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(40)], "record_id long, embedding array<float>")
    index = V.build(same, str(tmp_path / "same"), cells=5)
    assert [r[2] for r in rows(index.search_exact(asked, 3))] == [0, 1, 2]
    dot = V.build(same, str(tmp_path / "dot"), "dot")
    with pytest.raises(ValueError):
        dot.search_exact(asked, 3)
    assert [r[2] for r in rows(dot.search(asked, 3, 9))] == [0, 1, 2]


@pytest.mark.parametrize("threshold", [0.999, 0.97, 0.5, 0.0])
def test_near_equals_brute_force(spark, tmp_path, threshold):
    points, x = clustered(spark)
    index = V.build(points, str(tmp_path / "index"), cells=25)
    want = {r["query_id"] for r in knn_join(queries_of(points), points.filter("size(embedding) = 12"), 1).collect() if r["similarity_score"] >= threshold}
    assert {r["query_id"] for r in index.near(queries_of(points), threshold).collect()} == want
    moved = spark.createDataFrame([(f"n{i}", [float(v) for v in x[i] * 3 + 0.003 * (i % 3)]) for i in range(0, 1500, 10)] + [("null", None), ("short", [1.0])], "record_id string, embedding array<float>")
    left = {r[0] for r in V.without_near_duplicates(moved, index, threshold).select("record_id").collect()}
    near = {r["query_id"] for r in knn_join(moved.filter("size(embedding) = 12").select(F.col("record_id").alias("query_id"), "embedding"), points.filter("size(embedding) = 12"), 1).collect() if r["similarity_score"] >= threshold}
    assert left == {r[0] for r in moved.select("record_id").collect()} - near and {"null", "short"} <= left


def test_near_reads_few_cells(spark, tmp_path):
    points, _ = clustered(spark)
    index = V.build(points, str(tmp_path / "index"), cells=25)
    asked = []
    scored = index._scored
    index._scored = lambda a, k: asked.append(a.count()) or scored(a, k)
    n = queries_of(points).count()
    index.near(queries_of(points), 0.999).collect()
    assert asked[0] < n * 25 / 4


@pytest.mark.parametrize("threshold", [1.0, 0.999, 0.97, 0.5, 0.0, -0.9])
def test_has_near_equals_brute_force(spark, tmp_path, threshold, monkeypatch):
    monkeypatch.setattr(V, "CHUNK", 50)  # regions in several chunks, and queries in several blocks
    points, x = clustered(spark)
    stored = points.filter("record_id % 3 = 0")
    index = V.build(stored, str(tmp_path / "index"), cells=25)
    moved = [(i, [float(v) for v in x[i - i % 3] * 2 + 0.01 * (i % 5)]) for i in range(0, 1500, 4)]
    odd = [(2000, [0.0] * 12), (2001, None), (2002, [1.0]), (2003, [float("nan")] * 12), (2004, [float(v) for v in -x[0]])]
    asked = spark.createDataFrame(moved + odd, "query_id long, embedding array<float>").unionByName(queries_of(points).withColumn("query_id", F.col("query_id") + 3000))
    sound = asked.filter("size(embedding) = 12 and query_id <> 2003")
    want = {r["query_id"] for r in knn_join(sound, stored.filter("size(embedding) = 12"), 1).collect() if r["similarity_score"] >= threshold}
    assert {r["query_id"] for r in index.has_near(asked, threshold).collect()} == want


def test_scores_at_the_threshold():
    """Single precision can't tell these; rounded in double precision they differ. A point that is no number hides none."""
    import pyarrow as pa

    angles = np.arccos(np.array([0.998995 + 2e-8, 0.998995 - 2e-8, 0.9989]))
    some = pa.table({"embedding": pa.array([[float(np.cos(a)), float(np.sin(a))] for a in angles]), "own": pa.array([0, 0, 1], pa.int32()), "least": pa.array([0.0, 0.0, 0.0])})
    against = pa.table({"embedding": pa.array([[float("nan"), 0.0], [0.0, 0.0], [1.0, 0.0]]), "cell": pa.array([0, 0, 0], pa.int32())})
    assert V.with_near(some, against, np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([1.0, 0.0]), 0.999).tolist() == [True, False, False]


def test_near_duplicates_travel_once(spark, tmp_path, monkeypatch):
    """A row whose own surroundings hold a near point asks nothing else, however many cells lie within reach."""
    rng = np.random.default_rng(1)
    x = np.ones(12) + rng.normal(size=(1200, 12)) * 0.1
    points = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(1200)], "record_id long, embedding array<float>")
    index = V.build(points, str(tmp_path / "index"), cells=25)
    asked, stored = [], V.stored

    def counted(df, name):
        held = stored(df, name)
        if name == "asked":
            asked.append(held.count())
        return held

    monkeypatch.setattr(V, "stored", counted)
    assert V.without_near_duplicates(points, index, 0.99).count() == 0
    assert sum(asked) == 1200
