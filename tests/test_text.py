"""Text operators on literals."""

import pytest
from pyspark.sql import functions as F

from lawframe.functions import text as T
from lawframe.functions.payload import payload


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("123456789abcd", "***abcd"), ("abcd", "invalid"), ("", "invalid"), (None, "***")])
def test_mask(spark, raw, want):
    assert one(spark, T.mask_key, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("score 10", 10), ("1", 1), ("none", 5), ("17 then 3", 3)])
def test_relevance(spark, raw, want):
    assert one(spark, T.relevance, raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("D_ch1_art012_cl_03_pt_b", "khoản 3, Điều 12, điểm b văn bản D"), ("D_art001", "Điều 1 văn bản D"), ("D", "văn bản D"), (None, None)],
)
def test_source(spark, raw, want):
    assert one(spark, T.source_of, raw) == want


def test_tagged_record(spark):
    text = "<id=1>\n<title>Sample Title</title>\n<published_date>2024-09-22</published_date>\n<categories><Category1><Category2></categories>\n<content>\nSample content here.\n</content></id=1>"
    r = one(spark, T.tagged_record, text)
    assert (r["record_id"], r["title"], r["published_date"], r["categories"], r["content"]) == ("1", "Sample Title", "2024-09-22", ["Category1", "Category2"], "Sample content here.")
    assert one(spark, T.tagged_record, text.replace("<title>Sample Title</title>", "")) is None
    assert one(spark, T.tagged_record, text.replace("</title>", "<title>")) is None


def test_text_type(spark):
    assert [one(spark, T.text_type, x) for x in ("12", '"a"', "{}", "<title>a</title><content>\n</content>", "<title>a</title>", "x")] == ["json", "json", "json", "tagged", "unformatted", "unformatted"]


def test_only_whole_texts_are_json(spark):
    broken = ("4537960215852590 Thinthen oror", '{"a": 1} x', "1, 2", "1] x", "1,0] x", '1} x', '1,"b":2', "", " ", '"a" "b"', "[1] [2]")
    assert [one(spark, T.text_type, x) for x in broken] == ["unformatted"] * len(broken)
    assert [one(spark, T.text_type, x) for x in (" 1 ", "[]", "[1, 0]", "null", '\n{"b": [1, {"a": "]}"}]}\n')] == ["json"] * 5
    assert one(spark, payload, '{"a": 1} x') is None


def test_intention(spark):
    assert [one(spark, T.intention, x) for x in ('a {"history": true, "b": {}} c', '{"irrelevant": true, "history": true}', "no", "{broken")] == ["history", "irrelevant", "rag", "rag"]


def test_answer_has_citation(spark):
    assert one(spark, T.has_citation, "see [QA12] there") and not one(spark, T.has_citation, "see QA12")


def test_table_rebuilt(spark):
    assert one(spark, T.reconstruct_table, "a\n<table>\n<tr>\n<td> x </td>\n<td>y</td>\n</tr>\n</table>\nb") == "a\nx | y\n\nb\n"
