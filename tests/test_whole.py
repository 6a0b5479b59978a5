"""Queries do their whole job: rows that a filter or an idle stage left out."""

import duckdb
from pyspark.sql import functions as F

from lawframe import catalog


def both(spark, name, path, **tables):
    """A query's rows and its SQL's on small tables."""
    duck = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{path}/{table}.parquet")
        duck.execute(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
    got = catalog.queries()[name](spark, str(path))
    return sorted(map(tuple, got.collect())), sorted(duck.execute(f"select {', '.join(got.columns)} from ({catalog.oracle_sql()[name]})").fetchall())


def test_mentions_without_a_year_are_matched(spark, tmp_path):
    """The query took those with a year alone."""
    docs = spark.createDataFrame([(11, "x"), (12, "y")], "doc_id long, text string")
    parts = spark.createDataFrame([(101, ""), (102, "blush thistle"), (103, "almond")], "p_partkey long, p_name string")
    got, want = both(spark, "M4_weighted_match", tmp_path, documents=docs, part=parts)
    assert got == want == [(11, "D101", 0.86603, 1)]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_sections_are_shuffled_once(spark, sf_dir, monkeypatch):
    """Records joined the sections three times and compact texts were written and joined level by level."""
    from lawframe.operators import records
    from lawframe.operators import structure as S
    from lawframe.plans import ingest
    from lawframe.plans.structure_queries import _law

    made, kept = [], records.stored
    monkeypatch.setattr(records, "stored", lambda df, name: made.append(shuffles(df)) or kept(df, name))
    records.section_records(S.sections(_law(spark, sf_dir)))
    assert made == [1]
    assert shuffles(S.reconstructed(S.sections(_law(spark, sf_dir)), full=True, compact=True)) == 1
    assert shuffles(ingest.simplified(S.sections(_law(spark, sf_dir)), embed=lambda c: F.array(F.length(c).cast("double")))) == 1


def test_pieces_of_blank_sections(spark):
    """Compact texts, of sections that may be blank, as stripping level by level makes them."""
    from lawframe.operators import structure as S

    rows = [(0, None, 1, "D_ch1", " ", "c"), (1, 0, 2, "D_ch1_art1", "", ""), (2, 1, 3, "D_ch1_art1_cl_1", "", "  x "), (3, 1, 3, "D_ch1_art1_cl_2", "", ""), (4, 0, 2, "D_ch1_art2", "t", "u "), (5, 4, 3, "D_ch1_art2_cl_1", "", " "), (6, None, 1, "D_ch2", "", ""), (7, None, 1, "D_ch3", "e", "")]
    found = spark.createDataFrame([("D", *r, "h") for r in rows], "doc_id string, ord int, parent_ord int, level int, section_id string, title string, content string, header string")

    def text(at):
        _, _, _, key, title, content = rows[at]
        pad = "    " * (len(key.split("_")) - 2 - key.count("cl_"))
        return ("".join(f"{pad}{x}\n" for x in (title, content) if x) + "".join(text(r[0]) for r in rows if r[1] == at)).strip()

    tops = [text(r[0]) for r in rows if r[1] is None]
    assert S.reconstructed(found, compact=True).first()["text"] == "\n".join(tops).strip()
    pieces = {r["ord"]: r["piece"] for r in S.compact_pieces(found).collect()}
    below = lambda at: [at, *(x for r in rows if r[1] == at for x in below(r[0]))]
    assert all("".join(pieces[i] for i in below(r[0])) == text(r[0]) for r in rows)


def test_likeness_parts_clauses(spark, tmp_path):
    """All clauses had one vector, so that only the number of words made parts."""
    text = lambda last: "\n".join(["t", "w " * 80, "x " * 20, "", "", f"{last} " * 20, "z"])
    docs = spark.createDataFrame([(1, text("x")), (2, text("y"))], "doc_id long, text string")
    got, want = both(spark, "D4_simplified", tmp_path, documents=docs)
    assert got == want
    assert [sum(f"{d}_ch1_art002" in r for r in got) for d in (1, 2)] == [1, 2]


def test_keywords_do_not_shuffle_pairs(spark, sf_dir):
    """Each pair of a query and a point that holds its keyword was shuffled, and so was every place of the keyword's grams."""
    from lawframe.operators import search as S
    from lawframe.plans import answering

    points = spark.createDataFrame([("qa" if i % 3 == 0 else "doc", i, [float(i % 7), 1.0] if i % 11 else [0.0, 0.0], f"The land {i % 5}") for i in range(300)], "collection string, record_id int, embedding array<float>, content string")
    asked = spark.createDataFrame([(i, [1.0, float(i % 4)], ["THE", f"d {i % 6}"][i % 2 :]) for i in range(40)] + [(50, None, ["land"]), (51, [1.0, 0.0], None)], "query_id int, embedding array<float>, keywords array<string>")
    found = S.knn_holding(asked, points, 4)
    assert shuffles(found) == 1 and found._jdf.queryExecution().executedPlan().toString().count("Join") == 0
    take = lambda df: sorted((r["query_id"], r["collection"], r["record_id"], r["similarity_score"], r["rank"], r["by_keywords"]) for r in df.collect())
    one, indexed = (take(answering.retrieve_by_keywords(asked, points, index, qa=0.2, doc=0.2)) for index in (None, answering.keyword_index(points)))
    assert one == indexed and {r[0] for r in one if r[-1]} == {i for i in range(40) if i % 2 == 0 or i % 6 < 5} | {50}
    nulls = S.knn_holding(asked, points.withColumn("embedding", F.when(F.col("record_id") % 11 > 0, F.col("embedding"))), 4)
    assert sorted(map(tuple, nulls.collect()), key=str) == sorted(map(tuple, found.collect()), key=str)
    small = [tuple(r) for r in S.knn_holding(asked, points, 4, block=7).collect()]
    assert sorted(small, key=str) == sorted(map(tuple, found.collect()), key=str)
    first = [(r["record_id"], r["similarity_score"]) for r in found.filter("query_id = 50 and collection = 'qa'").orderBy("rank").collect()]
    assert first == [(0, None), (3, None), (6, None), (9, None)]


def test_postings_are_packed(spark):
    """A row a gram and chunk of texts; it was a row a gram and text."""
    import pyarrow as pa

    from lawframe.operators import postings

    texts = ["abab", "x", "b🎉ab", "abc" * 40, "bab"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "record_id long, content string")
    schema = postings._arrow_schema(postings._packed(rows, "record_id", "content").drop("bucket").schema)
    batches = [pa.RecordBatch.from_pydict({"id": list(range(a, b)), "text": texts[a:b]}) for a, b in ((0, 2), (2, 5))]
    want = {(i, t[p : p + 3], p) for i, t in enumerate(texts) for p in range(len(t))}
    for chunk, most in ((1 << 20, 1), (5, 3), (1, 5)):
        made = [(r["gram"], x["id"], p) for b in postings._pack(schema, chunk)(iter(batches)) for r in b.to_pylist() for x in r["texts"] for p in x["places"]]
        assert {(i, g, p) for g, i, p in made} == want and len(made) == len(want)
        grams = [r["gram"] for b in postings._pack(schema, chunk)(iter(batches)) for r in b.to_pylist()]
        assert max(map(grams.count, grams)) <= most


def test_similar_texts_stay_where_they_lie(spark, sf_dir):
    """All vectors were shuffled, then copied to each block of queries; any number of blocks gives the same rows."""
    from lawframe.operators import tfidf

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("doc_id < 120")
    queries = docs.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), "text")
    one, many = (tfidf.similar_above(queries, docs, 0.3, block=block) for block in (tfidf.BLOCK, 900))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert shuffles(one) == shuffles(many) == 0 and plan.count("MapInArrow") > 2 and "CoGroup" not in plan
    take = lambda df: sorted((r["query_id"], r["doc_id"], round(r["similarity"], 9)) for r in df.collect())
    assert take(one) == take(many) and len(take(one)) >= queries.count()
