"""The question pipeline over a batch of queries: cache, embedding, search per collection, rerank, context, answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawframe.functions import text as T
from lawframe.functions.text import backfilled_source, citation_suffix, matches_any
from lawframe.operators import postings
from lawframe.operators import search as S
from lawframe.operators.store import cached_answers
from lawframe.plans.providers import embed, generate
from lawframe.scratch import passing, scratch_path, stored

NOTHING_FOUND = "No relevant data found."


def retrieve(queries: DataFrame, points: DataFrame, qa_k: int = 3, doc_k: int = 6, qa: float = S.QA_THRESHOLD, doc: float = S.DOC_THRESHOLD, keywords: list[str] | None = None) -> DataFrame:
    """Hits of queries (query_id, embedding) in points (collection, record_id, embedding, payload): QA ones first.

    With keywords points must hold one of them, and thresholds do not apply.
    """
    kept = points.filter(matches_any(F.col("content"), keywords)) if keywords else points
    hits = S.best_per_record(S.knn_join(queries, kept, max(qa_k, doc_k), "collection"))
    of_qa = F.lower("collection").contains("qa")
    hits = hits.filter(F.col("rank") <= F.when(of_qa, qa_k).otherwise(doc_k))
    if not keywords:
        hits = S.above_threshold(hits, qa, doc)
    return hits.withColumn("branch", F.when(of_qa, 0).otherwise(1)).join(points.drop("embedding"), ["collection", "record_id"])


def with_keywords(queries: DataFrame, generator: str = "extractive", most: int = 10) -> DataFrame:
    """Queries (query_text, ...) with `keywords`, array<string>, that a generator names for them. One whose answer holds
    none is asked once more; then, and without a text, it has none."""
    asked = F.concat(F.lit(f"Name at most {most} keywords for a search of legal texts that answer the question, as one JSON object with the list keywords.\n\nQuestion: "), "query_text")

    def once(df: DataFrame) -> DataFrame:
        listed = F.filter(F.coalesce(T.keywords(generate(asked, generator), most), F.array().cast("array<string>")), lambda k: F.coalesce(F.trim(k), F.lit("")) != "")
        return stored(df.withColumn("keywords", listed), "keywords")

    blank = F.coalesce(F.trim("query_text"), F.lit("")) == ""
    first = once(queries.filter(~blank))
    again = once(first.filter("size(keywords) = 0").drop("keywords"))
    silent = queries.filter(blank).withColumn("keywords", F.array().cast("array<string>"))
    return first.filter("size(keywords) > 0").unionByName(again).unionByName(silent)


def keyword_index(points: DataFrame, path: str | None = None) -> DataFrame:
    """The postings of points (collection, record_id, content), written to `path` or for as long as the application runs."""
    spark = points.sparkSession
    if path is None:
        path = scratch_path(spark, "postings")
        passing(spark, path)
    postings.build(points.withColumn("_key", F.struct("collection", "record_id")), path, "_key", "content")
    return spark.read.parquet(path)


def retrieve_by_keywords(queries: DataFrame, points: DataFrame, index: DataFrame | None = None, qa_k: int = 3, doc_k: int = 6, **search) -> DataFrame:
    """As `retrieve` for queries (query_id, embedding, keywords), with `by_keywords`: among the points that hold one of a
    query's own keywords, without thresholds; where none does, or it has no keywords, by `retrieve`.

    A batch of queries looks for all its keywords in one pass over the points' texts. With an index its postings tell
    which points hold them, and no text is read. Pairs of queries and points are scored where the points lie.
    """
    queries = stored(queries.select("query_id", "embedding", "keywords"), "asked")
    if index is None:
        found = S.knn_holding(queries, points, max(qa_k, doc_k))
    else:
        words = queries.select("query_id", F.explode(F.array_distinct("keywords")).alias("keyword"))
        held = postings.search_all(index, words).groupBy("id.collection", "id.record_id").agg(F.collect_set("keyword").alias("_held"))
        found = S.knn_holding(queries, points.select("collection", "record_id", "embedding").join(held, ["collection", "record_id"]), max(qa_k, doc_k), "_held")
    of_qa = F.lower("collection").contains("qa")
    best = found.filter(F.col("rank") <= F.when(of_qa, qa_k).otherwise(doc_k))
    best = stored(best.withColumn("branch", F.when(of_qa, 0).otherwise(1)), "by_keywords")
    rest = queries.join(best.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "embedding")
    plain = retrieve(rest, points, qa_k, doc_k, **search).withColumn("by_keywords", F.lit(False))
    return best.join(points.drop("embedding"), ["collection", "record_id"]).withColumn("by_keywords", F.lit(True)).unionByName(plain, allowMissingColumns=True)


def answer(queries: DataFrame, points: DataFrame, cache: DataFrame | None = None, now: int = 0, rerank: bool = False, generator: str = "extractive", keyword_gen: str | None = None, **search) -> DataFrame:
    """(query_id, query_text, response_text, sources, cached) of queries (query_id, query_text[, embedding]).

    `keyword_gen` names a generator of keywords: points are then sought among those that hold a query's own."""
    asked = queries if "embedding" in queries.columns else queries.withColumn("embedding", embed(F.col("query_text")))
    done = None
    if cache is not None:
        probed = cached_answers(asked, cache, now)
        done = probed.filter("hit").select("query_id", "query_text", "response_text", F.array().cast("array<string>").alias("sources"), F.lit(True).alias("cached"))
        asked = probed.filter("not hit").drop("response_text", "hit", "cache_key")
    if keyword_gen:
        named = with_keywords(asked.select("query_id", "query_text", "embedding"), keyword_gen)
        hits = retrieve_by_keywords(named, points, **search)
    else:
        hits = retrieve(asked.select("query_id", "embedding"), points, **search)
    hits = hits.withColumn("rank", F.col("branch") * 1000 + F.col("rank")).withColumn("source", backfilled_source(F.col("source"), F.col("chunk_id")))
    if rerank:
        scored = S.reranked(hits.join(asked.select("query_id", "query_text"), "query_id"), S.lexical_overlap(F.col("query_text"), F.col("content")))
        hits = scored.withColumn("rank", F.col("position")).drop("position", "score", "query_text")
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("record_id").cast("string").alias("record_id"), "content"))).alias("hits"))
    built = S.context(hits)
    joined = asked.join(built, "query_id", "left").join(listed, "query_id", "left")
    prompt = F.concat(F.lit("User Question: "), "query_text", F.lit("\n\nRelated information:\n\n"), F.coalesce("context", F.lit("")))
    made = F.concat(generate(prompt, generator), citation_suffix(F.coalesce("hits", F.array().cast("array<struct<rank:int,record_id:string,content:string>>"))))
    fresh = joined.select(
        "query_id", "query_text", F.when(F.col("context").isNull(), NOTHING_FOUND).otherwise(made).alias("response_text"),
        F.coalesce(F.transform("sources", lambda s: s.cast("string")), F.array().cast("array<string>")).alias("sources"), F.lit(False).alias("cached"),
    )
    return fresh if done is None else fresh.unionByName(done)


def query_engine(points: DataFrame, top_k: int = 3, generator: str = "extractive"):
    """A function from queries (query_id, query_text) to answers from the `top_k` nearest points, however far they are."""
    return lambda queries: answer(queries, points, generator=generator, qa_k=top_k, doc_k=top_k, qa=-1.0, doc=-1.0)
