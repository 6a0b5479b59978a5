"""The corpus pipeline stage by stage against brute force."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

import corpus_pipeline  # noqa: E402
from lawframe.llm import mixing, suffix  # noqa: E402


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept, inputs = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    left = {r["doc_id"] for r in kept["quality"].collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in left for d in good) >= 0.97 * len(good)

    rows = H.texts_of(inputs["near_duplicates"])
    want = {min(rows[i][0] for i in g) for g in H.classes_by_brute_force(rows)}
    assert sorted(r["doc_id"] for r in kept["near_duplicates"].collect()) == sorted(want)

    rows = [(d, t.encode()) for d, t in H.texts_of(inputs["repeated_passages"])]
    clean = {d: text.decode("utf-8", "ignore") for d, _, _, _, text in H.removed_by_brute_force(rows, suffix.PASSAGE)}
    assert {r["doc_id"]: r["text"] for r in kept["repeated_passages"].collect()} == clean

    mixed = mixing.mix(inputs["source_mix"]).agg(F.sum("taken")).first()[0]
    assert kept["source_mix"].agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == mixed

    sequences = Counter()
    for r in kept["packing"].collect():
        sequences[r["sequence_id"]] += r["length"]
    assert set(sequences.values()) - {sequences[max(sequences)]} <= {4096}


def test_duplicates_with_nulls_and_repeats(spark, sf_dir):
    odd = H.odd_documents(spark)
    got = corpus_pipeline.keep_one_of_each_group(spark, odd, sf_dir).collect()
    rows = H.texts_of(odd)
    assert len(got) == len(H.classes_by_brute_force(rows)) and odd.columns == list(got[0].asDict())


def test_near_copies_with_null_and_repeated_ids(spark, sf_dir):
    a, b, c = H.prose(11, 200), H.prose(12, 200), H.prose(13, 200)
    rows = [(None, a), (None, a + " more"), (None, b), (9, b + " more"), (5, c), (5, H.prose(14, 200)), (6, c + " more"), (5, H.prose(15, 200))]
    got = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    left = sorted(map(tuple, got), key=str)
    assert len(left) == 5 and (rows[0] in left) != (rows[1] in left)
    assert all(rows[i] in left for i in (3, 4, 5, 7)) and rows[2] not in left and rows[6] not in left


def test_odd_documents_through_all_stages(spark, sf_dir, tmp_path):
    """Each stage's rows against what its input asks for; labels of none of the documents, so that quality keeps all."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, held = H.odd_documents(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = held[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or docs.columns == before.columns
    odd = H.odd_documents(spark)
    assert sorted(map(str, held["quality"].collect())) == sorted(map(str, odd.collect()))
    groups = H.classes_by_brute_force(H.texts_of(odd))
    left = held["near_duplicates"].collect()
    assert len(left) == len(groups) and {r["doc_id"] for r in left} == {1, 3, None, 5, 7, 8, 9, 10}
    want = sorted(t.decode("utf-8", "ignore") for *_, t in H.removed_by_brute_force([(d, t.encode()) for d, t in H.texts_of(held["near_duplicates"])], suffix.PASSAGE))
    assert sorted(r["text"] for r in held["repeated_passages"].collect()) == want
    mixed = mixing.mix(held["repeated_passages"]).agg(F.sum("taken")).first()[0]
    assert held["source_mix"].agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == mixed > 0
    pieces = held["packing"].collect()
    assert sum(r["length"] for r in pieces if r["start"] == 0) > 0 and len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)
    assert len([r for r in pieces if r["start"] == 0]) == held["source_mix"].count()


def test_empty_documents_through_all_stages(spark, sf_dir):
    docs = H.odd_documents(spark, empty=True)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_dir)
        assert after.count() == 0 and (name == "packing" or after.columns == docs.columns)
        docs = after
