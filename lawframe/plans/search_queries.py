"""Queries over vector search and retrieval, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawframe.functions.vectors import norm
from lawframe.operators import search as S


def _points(spark, sf_dir):
    """Embeddings as points of two collections; two points share each record_id at times."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("record_id"), "embedding", "label", F.when(F.col("label") % 2 == 0, "qa_768").otherwise("doc_768").alias("collection"))


SCORE = "round(list_cosine_similarity(p.embedding::double[], q.embedding::double[]), 5)"
POINTS = "with pts as (select vec_id as record_id, embedding, label, case when label % 2 = 0 then 'qa_768' else 'doc_768' end as collection from embeddings), "
SCORED = POINTS + f"scored as (select q.record_id as query_id, p.record_id, p.collection, p.label, {SCORE} as similarity_score from pts p, pts q where q.record_id % 20 = 0), "


def knn_search(spark, sf_dir):
    points = _points(spark, sf_dir)
    query = points.filter("record_id = 0").first()["embedding"]
    return S.top_one(points, query, 6).select(F.col("record_id").alias("vec_id"), F.col("similarity_score").alias("score"))


KNN = """
select p.vec_id, round(list_cosine_similarity(p.embedding::double[], q.embedding::double[]), 5) as score
from embeddings p, embeddings q where q.vec_id = 0 order by score desc, p.vec_id limit 6
"""


def _hits(spark, sf_dir, k):
    points = _points(spark, sf_dir)
    queries = points.filter("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), "embedding")
    return S.knn_join(queries, points, k, "collection")


def per_group(spark, sf_dir):
    return _hits(spark, sf_dir, 3).withColumn("rank", F.col("rank").cast("bigint"))


PER_GROUP = SCORED + """r as (select *, row_number() over (partition by query_id, collection order by similarity_score desc, record_id) as rank from scored)
select query_id, record_id, collection, similarity_score, rank from r where rank <= 3"""


def _index(spark, sf_dir):
    from lawframe.operators import vector_index
    from lawframe.scratch import passing, scratch_path

    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("record_id"), "embedding")
    path = scratch_path(spark, "index")
    passing(spark, path)
    return vector_index.build(points, path), points.filter("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), "embedding")


def index_exact(spark, sf_dir):
    index, queries = _index(spark, sf_dir)
    return index.search_exact(queries, 10).withColumn("rank", F.col("rank").cast("bigint"))


INDEX_EXACT = SCORED + """r as (select *, row_number() over (partition by query_id order by similarity_score desc, record_id) as rank from scored)
select query_id, record_id, similarity_score, rank from r where rank <= 10"""


def index_search(spark, sf_dir):
    index, queries = _index(spark, sf_dir)
    return index.search(queries, 10, index.probes_for(0.95))


def metric_knn(spark, sf_dir):
    points = _points(spark, sf_dir)
    queries = points.filter("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), "embedding")
    parts = [S.knn_join(queries, points, 5, metric=m).withColumn("metric", F.lit(m)) for m in ("dot", "euclidean", "manhattan")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("metric", "query_id", "record_id", F.col("similarity_score").alias("score"))


METRIC_KNN = """
with s as (
  select q.vec_id as query_id, p.vec_id as record_id, round(list_dot_product(p.embedding::double[], q.embedding::double[]), 5) as dot,
    round(list_distance(p.embedding::double[], q.embedding::double[]), 5) as euclidean,
    round(list_sum(list_transform(list_zip(p.embedding::double[], q.embedding::double[]), lambda x: abs(x[1] - x[2]))), 5) as manhattan
  from embeddings p, embeddings q where q.vec_id % 20 = 0),
m as (
  select 'dot' as metric, query_id, record_id, dot as score, row_number() over (partition by query_id order by dot desc, record_id) as n from s
  union all select 'euclidean', query_id, record_id, euclidean, row_number() over (partition by query_id order by euclidean, record_id) from s
  union all select 'manhattan', query_id, record_id, manhattan, row_number() over (partition by query_id order by manhattan, record_id) from s)
select metric, query_id, record_id, score from m where n <= 5
"""


def threshold(spark, sf_dir):
    return S.above_threshold(S.best_per_record(_hits(spark, sf_dir, 6)), 0.2, 0.25).select("query_id", "collection", "record_id", "similarity_score")


THRESHOLD = SCORED + """r as (select *, row_number() over (partition by query_id, collection order by similarity_score desc, record_id) as rank from scored)
select query_id, collection, record_id, similarity_score from r where rank <= 6 and similarity_score >= case when contains(collection, 'qa') then 0.2 else 0.25 end"""


def keyword_knn(spark, sf_dir):
    points = _points(spark, sf_dir).withColumn("content", F.concat(F.lit("Label "), F.col("label").cast("string")))
    from lawframe.functions.text import matches_any

    kept = points.filter(matches_any(F.col("content"), ["label 3", "LABEL 7"]))
    queries = points.filter("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), "embedding")
    return S.best_per_record(S.knn_join(queries, kept, 10)).select("query_id", "record_id", "similarity_score")


KEYWORD_KNN = SCORED + """r as (select *, row_number() over (partition by query_id order by similarity_score desc, record_id) as rank from scored where label::varchar like '3%' or label::varchar like '7%')
select query_id, record_id, similarity_score from r where rank <= 10"""


def near_dup(spark, sf_dir):
    points = _points(spark, sf_dir)
    return S.without_near_duplicates(points.filter("record_id % 2 = 0"), points.filter("record_id % 2 = 1"), 0.3).select("record_id")


NEAR_DUP = POINTS + f"""x as (select q.record_id, max({SCORE}) as best from pts q, pts p where q.record_id % 2 = 0 and p.record_id % 2 = 1 group by 1)
select record_id from x where best < 0.3"""


def metrics(spark, sf_dir):
    points = _points(spark, sf_dir)
    query = points.filter("record_id = 0").first()["embedding"]
    vector = F.array(*[F.lit(float(x)) for x in query])
    return points.select("record_id", *(F.round(S.similarity(F.col("embedding"), vector, m), 5).alias(m) for m in ("cosine", "dot", "euclidean", "manhattan")))


METRICS = f"""
select p.vec_id as record_id, {SCORE} as cosine, round(list_inner_product(p.embedding::double[], q.embedding::double[]), 5) as dot,
  round(list_distance(p.embedding::double[], q.embedding::double[]), 5) as euclidean,
  round(list_sum(list_transform(list_zip(p.embedding::double[], q.embedding::double[]), lambda z: abs(z[1] - z[2]))), 5) as manhattan
from embeddings p, embeddings q where q.vec_id = 0
"""


def normalised(spark, sf_dir):
    short = F.slice("embedding", 1, 16)
    length = norm(short)
    return _points(spark, sf_dir).select("record_id", F.round(length, 5).alias("length"), F.round(F.get(short, F.lit(0)).cast("double") / length, 5).alias("first"), F.size(short).alias("dim"))


NORMALISED = """
with t as (select vec_id as record_id, embedding[1:16]::double[] as v from embeddings)
select record_id, round(sqrt(list_inner_product(v, v)), 5) as length, round(v[1] / sqrt(list_inner_product(v, v)), 5) as first, len(v)::int as dim from t
"""


def union_topk(spark, sf_dir):
    hits = _hits(spark, sf_dir, 6)
    qa = hits.filter("collection = 'qa_768' and rank <= 3")
    return S.union_ranked([qa, hits.filter("collection = 'doc_768'")]).select("query_id", "branch", F.col("rank").cast("bigint").alias("rank"), "record_id")


UNION_TOPK = SCORED + """r as (select *, row_number() over (partition by query_id, collection order by similarity_score desc, record_id) as rank from scored)
select query_id, (collection <> 'qa_768')::int as branch, rank, record_id from r where rank <= case when collection = 'qa_768' then 3 else 6 end"""


def _texts(spark, sf_dir):
    """Hits of the search joined to documents of the same number, some without text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("record_id"), F.when(F.col("doc_id") % 5 > 0, F.col("text")).otherwise("").alias("content"), F.col("source").alias("title"))
    return _hits(spark, sf_dir, 6).join(docs, "record_id")


def rerank_lookup(spark, sf_dir):
    hits = _texts(spark, sf_dir)
    new = S.reranked(hits, F.length("content").cast("double")).select("query_id", "collection", "record_id", "score", F.col("position").cast("bigint").alias("position"))
    return S.lookup_reranked(new, hits.select("query_id", "collection", "record_id", "similarity_score", "title")).select("query_id", "collection", "record_id", "title", "similarity_score", "position")


RANKED_TEXTS = SCORED + """r as (select *, row_number() over (partition by query_id, collection order by similarity_score desc, record_id) as rank from scored),
h as (select r.*, case when doc_id % 5 > 0 then text else '' end as content, source as title from r join documents on record_id = doc_id where rank <= 6)
"""
RERANK_LOOKUP = RANKED_TEXTS + """select query_id, collection, record_id, title, length(content)::double as similarity_score,
  row_number() over (partition by query_id order by length(content) desc, rank, record_id) as position from h where content <> ''"""


def context_build(spark, sf_dir):
    hits = _texts(spark, sf_dir).filter("collection = 'doc_768'").withColumns({"document_id": F.lit("D"), "source": F.lit(None).cast("string"), "chunk_id": F.lit("c")})
    built = S.context(hits, 8000)
    return built.select("query_id", F.md5("context").alias("context_md5"), F.length("context").alias("length"), F.array_join(F.transform("sources", lambda s: s.cast("string")), ",").alias("sources"))


CONTEXT_BUILD = RANKED_TEXTS + """, b as (select query_id, rank, record_id, case when content <> '' then 'Document ID: D' || chr(10) || 'Cơ sở pháp lý: N/A' || chr(10) || 'Mô tả: ' || title || chr(10) || 'Nội dung: ' || content || chr(10) || 'Record ID: ' || record_id || chr(10) || 'Chunk ID: c' || chr(10) end as block
  from h where collection = 'doc_768'),
c as (select query_id, left(coalesce(string_agg(block, chr(10) || chr(10) || repeat('-', 27) || chr(10) || chr(10) order by rank), ''), 8000) as context, string_agg(record_id::varchar, ',' order by rank) as sources from b group by 1)
select query_id, md5(context) as context_md5, length(context)::int as length, sources from c"""

QUERIES = {
    "VI1_index_search": (index_search, None), "VI2_index_exact": (index_exact, INDEX_EXACT), "VI3_metric_knn": (metric_knn, METRIC_KNN), "V1_knn_search": (knn_search, KNN),
    "V2_threshold_by_collection": (threshold, THRESHOLD),
    "V3_keyword_prefilter_knn": (keyword_knn, KEYWORD_KNN),
    "V4_knn_join_per_group_topk": (per_group, PER_GROUP),
    "V5_near_dup_antijoin": (near_dup, NEAR_DUP),
    "V6_metrics_dot_l2_l1": (metrics, METRICS),
    "V7_normalise_truncate": (normalised, NORMALISED),
    "R1_union_topk_ranked": (union_topk, UNION_TOPK),
    "R2_rerank_lookup_join": (rerank_lookup, RERANK_LOOKUP),
    "R3_context_build_truncate": (context_build, CONTEXT_BUILD),
}
