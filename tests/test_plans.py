"""Stores, providers, the question pipeline and streams."""

import pytest
from pyspark.sql import functions as F

from lawframe.operators import search as S
from lawframe.operators import store as K
from lawframe.plans import answering, ingest, providers
from lawframe.streaming import streams


def test_unknown_provider():
    with pytest.raises(ValueError):
        providers.provider("embedder", "none")


def test_retry():
    calls = []

    def fail(x):
        calls.append(x)
        if len(calls) < 2:
            raise OSError
        return x

    assert providers.retried(fail, 2, 0)(5) == 5 and calls == [5, 5]


def test_answers(spark):
    points = spark.createDataFrame([("qa_768", "R1", "giấy phép xây dựng", "T", "D", "", "D_art001"), ("doc_768", "R2", "thuế thu nhập", "T", "D", "own", "D_art002"), ("doc_768", "R3", "", "T", "D", "", "D")], "collection string, record_id string, content string, title string, document_id string, source string, chunk_id string")
    points = points.withColumn("embedding", providers.embed(F.col("content")))
    queries = spark.createDataFrame([("1", "giấy phép xây dựng"), ("2", "zzz yyy"), ("3", " THUẾ ")], "query_id string, query_text string")
    cache = spark.createDataFrame([(K.cache_key, 0)][:0], "cache_key string, ttl int")
    held = queries.filter("query_id = '3'").select(F.md5(F.lit("thuế")).alias("cache_key"), F.lit("held").alias("response_text"), F.lit(99).cast("bigint").alias("ttl"), F.lit(True).alias("is_complete"))
    got = {r["query_id"]: r for r in answering.answer(queries, points, held, 10, rerank=True).collect()}
    assert cache.count() == 0
    assert got["3"]["response_text"] == "held" and got["3"]["cached"]
    assert got["2"]["response_text"] == answering.NOTHING_FOUND and got["2"]["sources"] == []
    assert got["1"]["sources"] == ["R1"] and got["1"]["response_text"].endswith("References: [Record ID: R1]")


def test_routing(spark):
    raw = spark.createDataFrame([('{"title": "a", "content": "b"}',), ("<id=1><title>t</title><content>c</content></id=1>",), ("plain words",), ("[1]",)], "raw string")
    assert sorted((r["title"], r["content"]) for r in ingest.routed(raw).filter("title in ('a', 't')").collect()) == [("a", "b"), ("t", "c")]
    assert ingest.routed(raw).count() == 3


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "record_id string, v int, seq int")
    new = spark.createDataFrame([("b", 9, 1), ("c", 3, 2), (None, 4, 3)], "record_id string, v int, seq int")
    once = K.upsert(old, new).select("record_id", "v", F.row_number().over(__import__("pyspark").sql.Window.orderBy("place")).alias("seq"))
    assert sorted(map(tuple, once.collect())) == [("a", 1, 1), ("b", 9, 2), ("c", 3, 3)]
    assert sorted((r[0], r[1]) for r in K.upsert(once, new).select("record_id", "v").collect()) == [("a", 1), ("b", 9), ("c", 3)]


def test_default_thresholds(spark):
    hits = spark.createDataFrame([("qa_768", 0.7), ("doc_768", 0.79), ("doc_768", 0.8), ("other", 0.69)], "collection string, similarity_score double")
    assert S.above_threshold(hits).count() == 2


def test_near_duplicates_within_a_batch(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "record_id string, embedding array<float>")
    stored = spark.createDataFrame([("z", [0.0, 1.0])], "record_id string, embedding array<float>")
    assert sorted(r[0] for r in S.without_near_duplicates(rows, stored).select("record_id").collect()) == ["a", "b"]
    assert [r[0] for r in S.without_near_duplicates(rows, stored, intra_batch=True).select("record_id").collect()] == ["a"]


def test_near_duplicate_behind_many_later_copies(spark):
    """The only earlier near copy of `r` is less alike than 17 later exact copies."""
    near, far = [1.0, 0.0], [1.0, 0.03]
    rows = spark.createDataFrame([("e", far), ("r", near), *((f"s{i:02}", near) for i in range(17))], "record_id string, embedding array<float>")
    stored = spark.createDataFrame([("z", [0.0, 1.0])], "record_id string, embedding array<float>")
    assert [r[0] for r in S.without_near_duplicates(rows, stored, intra_batch=True).select("record_id").collect()] == ["e"]


def test_poison_messages(spark):
    raw = spark.createDataFrame([('{"query_id": "1", "query_text": "a"}',), ('{"query_id": "2"}',), ("junk",)], "value string")
    good, bad = streams.messages(raw)
    assert [r["query_id"] for r in good.collect()] == ["1"] and bad.count() == 2


def test_files_arrive_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    seen = []
    for more in ("b.txt", "c.bin"):
        streams.batches(streams.arriving_texts(spark, str(tmp_path / "in")), lambda df, n: seen.extend(r["text"] for r in df.collect()), str(tmp_path / "check"))
        (tmp_path / "in" / more).write_text(more)
    streams.batches(streams.arriving_texts(spark, str(tmp_path / "in")), lambda df, n: seen.extend(r["text"] for r in df.collect()), str(tmp_path / "check"))
    assert seen == ["one", "b.txt"]
