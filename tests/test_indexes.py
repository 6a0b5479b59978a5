"""Prefix-filtered similarity, keyword postings, keyed tables and payloads against plain ways."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lawframe.functions import payload as P
from lawframe.operators import postings, tfidf
from lawframe.sources.keyed import KeyedTable


@pytest.mark.parametrize("cutoff", [0.75, 0.3, 1.0])
def test_similar_above_equals_all_pairs(spark, sf_dir, cutoff):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    queries = docs.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "text")
    take = lambda df: {(r["query_id"], r["doc_id"]): round(r["similarity"], 6) for r in df.collect()}
    # a text's similarity to itself is 1 but for rounding, so 1.0 is met on both sides or on neither
    want = {k: v for k, v in take(tfidf.query_similarity(queries, docs)).items() if v >= cutoff}
    got = take(tfidf.similar_above(queries, docs, cutoff - 1e-7))
    assert {k for k, v in got.items() if v >= cutoff} == set(want) and all(got[k] == v for k, v in want.items())


def test_few_pairs_meet(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    weighted = tfidf.weights(docs)
    asked = weighted.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    met = tfidf.candidates(asked, weighted, 0.75).count()
    sharing = asked.select("query_id", "token").join(weighted.select("doc_id", "token"), "token").select("query_id", "doc_id").distinct().count()
    print(f"{met} of {sharing} pairs that share a token meet")
    assert 0 < met < sharing / 10
    with pytest.raises(ValueError):
        tfidf.similar_above(docs, docs, 0.0)


def test_postings_equal_substrings(spark, tmp_path):
    rng = random.Random(4)
    pool = ["a", "b", "ab", " ", "é", "É", "日", "🎉", "the ", "THE", "\n", "x%_"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 25))) for _ in range(150)] + [None, "", "a", "ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "record_id long, content string")
    postings.build(rows, str(tmp_path / "index"))
    words = ["a", "AB", "the", "The a", "🎉", "日🎉", "é", "x%_", "aaaaaaaa", "abab", "b the ", "zzz", "\n", " "]
    got = {(r["id"], r["keyword"]) for r in postings.search(spark, str(tmp_path / "index"), words).collect()}
    assert got == {(i, w) for i, t in enumerate(texts) for w in words if t and w.lower() in t.lower()}
    assert {r["id"] for r in postings.search(spark, str(tmp_path / "index"), [""]).collect()} == {i for i, t in enumerate(texts) if t}
    rows.write.parquet(str(tmp_path / "rows"))
    kept = postings.matching(spark.read.parquet(str(tmp_path / "rows")).select("record_id"), str(tmp_path / "index"), ["the", "🎉"])
    assert sorted(r[0] for r in kept.collect()) == [i for i, t in enumerate(texts) if t and ("the" in t.lower() or "🎉" in t)]
    assert "content" not in kept._jdf.queryExecution().executedPlan().toString()


def test_writes_touch_their_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "keyed")
    rows = spark.createDataFrame([(f"k{i}", i, 0) for i in range(400)] + [("k1", 999, 1), (None, 5, 0)], "id string, value long, seq long")
    held = KeyedTable(spark, path, "id", 16).create(rows, "seq")
    assert held.read().count() == 400 and held.read().filter("id = 'k1'").first()["value"] == 999

    def files():
        return {d: sorted((f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket=")}

    def changed(before, after):
        return {d for d in before.keys() | after.keys() if before.get(d) != after.get(d)}

    one = lambda *rows: spark.createDataFrame(list(rows), "id string, value long, seq long")
    before = files()
    held.upsert(one(("k7", -7, 2), ("k7", -8, 1), (None, 1, 1)), "seq")
    assert len(changed(before, files())) == 1 and held.read().count() == 400
    assert held.read().filter("id = 'k7'").first()["value"] == -7
    before = files()
    held.update(spark.createDataFrame([("k8", None, 5), ("none", 3, 3)], "id string, value long, seq long"))
    assert len(changed(before, files())) <= 2 and held.read().filter("id = 'k8'").first()[1:] == (8, 5) and held.read().count() == 400
    assert sorted(r["id"] for r in held.lookup(["k7", "k8", "none"]).collect()) == ["k7", "k8"]
    before = files()
    held.delete(spark.createDataFrame([("k9",)], "id string"))
    assert len(changed(before, files())) == 1 and held.read().count() == 399
    held.upsert(one(("new", 1, 1)), "seq")
    assert held.read().count() == 400
    small = KeyedTable(spark, str(tmp_path / "small"), "id", 8).create(one(("a", 1, 1), ("b", 2, 1), ("c", 3, 1)), "seq")
    small.delete(spark.createDataFrame([("a",), ("zz",)], "id string"))  # its bucket may become empty
    assert sorted(r["id"] for r in small.read().collect()) == ["b", "c"]


def test_payload_paths(spark):
    texts = ['{"a": {"b": 1}, "t": ["x", "y"]}', '{"a": {"b": "1"}}', '{"a": [1]}', "{broken", None, "7", '{"a": {"b": null}, "t": []}', '{"a": {"b": 1.0}, "s": true}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", P.payload(F.col("text")).alias("payload"))
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(P.where(rows, {"$.a.b": 1})) == [0, 1, 7]
    assert ids(P.where(rows, {"$.t[1]": "y"})) == [0] and ids(P.where(rows, {"$.s": True})) == [7]
    assert ids(P.where(rows, {"$.a.b": [1, 2], "$.t[0]": ["x", "z"]})) == [0]
    got = sorted((r["id"], r["pos"], r["name"]) for r in P.entries(rows, "id").collect())
    assert got == [(0, 0, "a"), (0, 1, "t"), (1, 0, "a"), (2, 0, "a"), (6, 0, "a"), (6, 1, "t"), (7, 0, "a"), (7, 1, "s")]


def test_an_index_shuffles_texts_alone(spark):
    rows = spark.createDataFrame([(1, "abab"), (2, None), (3, "ä")], "record_id int, content string")
    made = postings._placed(rows, "record_id", "content")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")
    assert sorted((r["id"], r["gram"], r["places"]) for r in made.collect()) == [(1, "ab", [2]), (1, "aba", [0]), (1, "b", [3]), (1, "bab", [1]), (3, "ä", [0])]


def test_blocks_and_rare_tokens_change_nothing(spark, sf_dir):
    """Few tokens broadcast and small blocks give the rows of everything broadcast and one block; documents that share an
    id count as one, those without an id as none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("doc_id < 80")
    docs = docs.unionByName(docs.filter("doc_id = 3").select(F.lit(4).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text")).unionByName(docs.filter("doc_id = 5").selectExpr("cast(null as bigint) as doc_id", "text"))
    terms = tfidf.packed(docs)
    idf = tfidf.fitted(terms, tfidf._total(docs))
    take = lambda df: {(r["doc_id"], r["token"]): (r["tf"], round(r["weight"], 9)) for r in df.collect()}
    want = take(tfidf._weights(terms, idf))
    assert take(tfidf._weights(terms, idf, 2000)) == want == take(tfidf._weights(terms, idf, 0)) and all(k[0] is not None for k in want)
    held = tfidf._vectors(terms, idf)
    asked = held.filter("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id")
    pairs = [{(r["query_id"], r["doc_id"], round(r["similarity"], 9)) for r in tfidf._compared(asked, held, 0.3, 4000, 20000, block).collect()} for block in (1 << 20, 1500)]
    assert pairs[0] == pairs[1] and len(pairs[0]) >= 16
