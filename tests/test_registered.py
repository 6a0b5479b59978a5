"""Functions of SQL, keywords as rows, and answers by keywords that a generator names."""

import pytest
from pyspark.sql import functions as F

from lawframe.operators import postings
from lawframe.operators import search as S
from lawframe.operators import usage as U
from lawframe.plans import answering, providers
from lawframe.plans.registered import register_functions


def test_functions_of_sql(spark):
    register_functions(spark, dim=8)
    spark.createDataFrame([(1, "Luật A 2019 b", "luật c a"), (2, None, None), (3, "", "x"), (4, "a A b", "")], "i int, t string, q string").createOrReplaceTempView("texts_of_test")
    got = spark.sql("select i, m.mention, m.issue_year from texts_of_test, lateral walked_mentions(t) m")
    assert [tuple(r) for r in got.collect()] == [(1, "Luật A 2019 b", "2019")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Exchange" not in plan
    rows = spark.sql("select i, t, q, score_text(q, t) as s, embed_text(t) as e, generate_text(t) as g from texts_of_test order by i")
    want = [r[0] for r in spark.table("texts_of_test").orderBy("i").select(F.coalesce(S.lexical_overlap(F.col("q"), F.col("t")), F.lit(0.0))).collect()]
    assert [r["s"] for r in rows.collect()] == pytest.approx(want)
    assert [r["g"] for r in rows.collect()] == ["Luật A 2019 b", "", "", "a A b"] and all(len(r["e"]) == 8 for r in rows.collect())
    lines = spark.sql("select l.* from values ('<p>a</p><p> b&amp;c </p>'), (null), ('') as v(h), lateral html_lines(h) l")
    assert [tuple(r) for r in lines.collect()] == [(1, "a"), (2, "b&c")]


def test_keywords_as_rows(spark, tmp_path):
    texts = [(1, "Das Haus am See"), (2, "haushalt"), (3, ""), (4, None), (5, "ab"), (6, "aaaaaa"), (7, "x a"), (8, "Ça sé ça")]
    postings.build(spark.createDataFrame(texts, "record_id int, content string"), f"{tmp_path}/p")
    words = ["HAUS", "haus", "a", "ab", "aaa", "aaaaa", "aaaaaaa", "s a", "ça", "Haus am See", "zz", " "]
    got = postings.search_all(spark.read.parquet(f"{tmp_path}/p"), spark.createDataFrame([(w,) for w in [*words, "", None, "a"]], "keyword string"))
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted({(i, w) for i, t in texts for w in words if w.lower() in (t or "").lower()})
    assert postings.search_all(spark.read.parquet(f"{tmp_path}/p"), spark.createDataFrame([], "keyword string")).collect() == []


POINTS = [("legal_qa", 1, [1.0, 0.0], "tax law"), ("legal_qa", 2, [0.0, 1.0], "land law"), ("legal_doc", 1, [0.6, 0.8], "Land tax"), ("legal_doc", 3, [1.0, 0.1], None), ("legal_doc", 4, [0.0, 0.0], "land")]


def test_retrieval_by_keywords(spark):
    points = spark.createDataFrame(POINTS, "collection string, record_id int, embedding array<float>, content string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], ["LAND", "law", "LAND"]), (2, [1.0, 0.0], ["nowhere"]), (3, [1.0, 0.0], []), (4, [1.0, 0.0], None)], "query_id int, embedding array<float>, keywords array<string>")
    got = {}
    for r in answering.retrieve_by_keywords(asked, points, answering.keyword_index(points), qa_k=2, doc_k=1, qa=0.5, doc=0.5).collect():
        got.setdefault(r["query_id"], []).append((r["branch"], r["rank"], r["record_id"], r["by_keywords"]))
    assert sorted(got[1]) == [(0, 1, 1, True), (0, 2, 2, True), (1, 1, 1, True)]  # the second lies below any threshold
    assert all(sorted(got[q]) == [(0, 1, 1, False), (1, 1, 3, False)] for q in (2, 3, 4))
    few = answering.retrieve_by_keywords(asked.filter("query_id = 1"), points.filter("record_id = 4"), answering.keyword_index(points.filter("record_id = 4"))).collect()
    assert [(r["record_id"], r["similarity_score"]) for r in few] == [(4, None)]  # a vector of length zero comes last


def test_keywords_are_asked_for_twice(spark, tmp_path):
    at = str(tmp_path)

    def forgetful(prompts):
        import os
        import re

        said = []
        for p in prompts:
            question = p.split("Question: ")[1]
            seen = f"{at}/{re.sub(r'[^a-z]', '', question)}"
            said.append('{"keywords": ["' + question + '", " ", null]}' if os.path.exists(seen) or question == "first" else "{broken}")
            open(seen, "a").close()
        return said

    providers.register("generator", "forgetful", forgetful)
    asked = spark.createDataFrame([(1, "first"), (2, "second"), (3, None), (4, " ")], "query_id int, query_text string")
    got = answering.with_keywords(asked, "forgetful")
    assert {r["query_id"]: r["keywords"] for r in got.collect()} == {1: ["first"], 2: ["second"], 3: [], 4: []}


def test_answers_by_keywords(spark):
    points = spark.createDataFrame([("legal_doc", i, t, "T", "D", "", f"D{i}_art001") for i, t in enumerate(["land tax rules", "house rules", "tax of land"])], "collection string, record_id int, content string, title string, document_id string, source string, chunk_id string")
    points = points.withColumn("embedding", providers.embed(F.col("content")))
    providers.register("generator", "house", lambda prompts: ['{"keywords": ["house"]}' if "land" in p else "{}" for p in prompts])
    asked = spark.createDataFrame([(1, "land tax rules"), (2, "tax of it")], "query_id int, query_text string")
    got = {r["query_id"]: r["response_text"] for r in answering.answer(asked, points, keyword_gen="house", doc=0.3).collect()}
    assert "house rules" in got[1] and "land tax" not in got[1].split("Related information")[1] and "tax of land" in got[2]


def test_limits_of_any_size(spark):
    events = spark.createDataFrame([(1, 1, "FREE", 5), (2, 1, "FREE", 6)], "event_id int, user_id int, tier string, tokens int").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    limits = spark.createDataFrame([("FREE", 5, 10)], "tier string, max_questions int, max_tokens int")
    assert [r["accepted"] for r in U.limited(events, limits).orderBy("event_id").collect()] == [True, False]
