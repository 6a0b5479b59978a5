"""Further queries: lookups, sinks, reconstruction variants, budgets, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lawframe.functions.text import cache_key, flatten_table
from lawframe.operators import search as S
from lawframe.operators import store as K
from lawframe.operators import structure as H
from lawframe.operators import usage as U
from lawframe.plans import ingest
from lawframe.plans.structure_queries import LAW, _law
from lawframe.sources import files, sinks


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_point(spark, sf_dir):
    text = F.concat(F.lit(" "), F.col("p_size"), F.lit(", ,"), F.col("p_partkey"), F.lit(".5,"))
    v = sinks.parsed_vector(text)
    return _table(spark, sf_dir, "part").select("p_partkey", F.size(v).alias("dim"), F.get(v, F.lit(1)).cast("double").alias("second"))


RAW_POINT = "select p_partkey, 2::int as dim, (p_partkey + 0.5)::double as second from part"


def scroll(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("content"))
    return sinks.scrolled(docs, content="THAT").select("record_id")


SCROLL = "select doc_id as record_id from documents where contains(lower(text), 'that') order by doc_id limit 100"


def point_lookup(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), cache_key(F.col("text")).alias("cache_key"), F.col("text").alias("query_text"))
    wanted = items.filter("query_id = 3").select("cache_key")
    return items.join(wanted, "cache_key", "left_semi").orderBy("query_id").limit(1).select("query_id", "cache_key")


POINT_LOOKUP = r"""with k as (select item_id as query_id, md5(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) as cache_key from benchmark)
select query_id, cache_key from k where cache_key = (select cache_key from k where query_id = 3) order by query_id limit 1"""


def folder(spark, sf_dir):
    n = F.col("doc_id")
    path = F.concat(F.lit("base/"), "lang", F.lit("/"), n % 9, F.when(n % 2 == 0, F.concat(F.lit("."), n % 4)).otherwise(""), F.when(n % 5 > 0, " Name of ").otherwise("-"), n, F.lit(".docx"))
    return files.folder_catalog(_table(spark, sf_dir, "documents").select(path.alias("path")), "base").drop("document_path")


FOLDER = """
with t as (select lang, doc_id, (doc_id % 9)::varchar || case when doc_id % 2 = 0 then '.' || (doc_id % 4) else '' end as id from documents where doc_id % 5 > 0)
select lang as category, id as document_id, 'Name of ' || doc_id as document_name, len(string_split(id, '.'))::int as hierarchy_level, case when doc_id % 2 = 0 then (doc_id % 9)::varchar end as parent_document_id from t
"""


def file_order(spark, sf_dir):
    n = F.col("doc_id")
    names = _table(spark, sf_dir, "documents").select(F.when(n % 3 == 0, F.concat("source", F.lit("_x.png"))).otherwise(F.concat(F.lit("p"), n % 50, F.lit(".png"))).alias("name")).distinct()
    return files.by_numeric_suffix(names)


FILE_ORDER = """
with n as (select distinct case when doc_id % 3 = 0 then source || '_x.png' else 'p' || (doc_id % 50) || '.png' end as name from documents),
s as (select name, try_cast(regexp_extract(name, '(\\d+)(\\.[^.]*)?$', 1) as int) as k from n)
select name, position from (select name, row_number() over (order by k nulls last, name) as position from s)
""".replace("\\\\", "\\")


def upload_counts(spark, sf_dir):
    """Two thirds of the points are new; of the stored third every second one is offered again."""
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), "embedding")
    stored, new = e.filter("record_id % 3 = 0"), e.filter("record_id % 3 > 0 or record_id % 2 = 0")
    fresh = K.delete(new, stored, "record_id")
    return K.upload_counts(new, stored, S.without_near_duplicates(fresh, stored, 0.3))


UPLOAD_COUNTS = """
with n as (select vec_id, embedding::double[] as e from embeddings where vec_id % 3 > 0 or vec_id % 2 = 0), s as (select vec_id, embedding::double[] as e from embeddings where vec_id % 3 = 0),
f as (select n.vec_id, max(round(list_cosine_similarity(n.e, s.e), 5)) as best from n, s where n.vec_id % 3 > 0 group by 1)
select (select count(*) from n) as total, (select count(*) from n where vec_id % 3 = 0) as known, (select count(*) from f where best >= 0.3) as near_duplicate, (select count(*) from f where best < 0.3) as uploaded
"""


def repaired(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.trim("text").alias("text"))
    return sinks.joined_chunks(turns).select("doc_id", F.md5("text").alias("text_md5"))


REPAIRED = "select conv_id as doc_id, md5(string_agg(trim(text), chr(10) || chr(10) order by turn)) as text_md5 from conversations group by 1"


def audit(spark, sf_dir):
    """Every document whose number is divisible by 20 is a question; its hits are the documents up to the next one."""
    docs, n = _table(spark, sf_dir, "documents"), F.col("doc_id")
    q = docs.filter("doc_id % 20 = 0").select(n.alias("query_id"), F.col("text").alias("query_text"), F.col("source").alias("response_text"))
    hits = docs.select((n - n % 20).alias("query_id"), n.alias("rank"), n.alias("record_id"), F.lit(None).cast("string").alias("document_id"), F.col("lang").alias("title"), F.col("source"), F.lit("c").alias("chunk_id"))
    shown = lambda h: F.concat_ws("|", h["record_id"], h["document_id"], h["title"], h["source"])
    return K.audit_rows(q, hits).select("query_id", "query_text", F.md5(F.array_join(F.transform("hits", shown), ";")).alias("hits_md5"))


AUDIT = """
with h as (select doc_id - doc_id % 20 as query_id, string_agg(doc_id || '|N/A|' || lang || '|' || source, ';' order by doc_id) as hits from documents group by 1)
select doc_id as query_id, text as query_text, md5(hits) as hits_md5 from documents left join h on query_id = doc_id where doc_id % 20 = 0
"""


def null_free(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.col("text")).alias("response_text"), F.when(F.col("item_id") % 3 == 0, F.col("item_id")).alias("timestamp"), F.lit(None).cast("array<map<string,string>>").alias("conversation_history"))
    return K.stored_query(rows).select("query_id", F.length("response_text").alias("length"), "timestamp", F.size("conversation_history").alias("turns"))


NULL_FREE = "select item_id as query_id, case when item_id % 2 = 0 then length(text) else 0 end::int as length, case when item_id % 3 = 0 then item_id else 0 end as timestamp, 0::int as turns from benchmark"


def budget(spark, sf_dir):
    """The lines of each document that are not blank, as the chunks that a model repairs under its limits."""
    docs = _table(spark, sf_dir, "documents")
    chunks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "content")).filter("trim(content) <> ''")
    return ingest.repaired_budget(chunks).select("doc_id", "ord", "tokens", "window")


BUDGET = r"""
with recursive l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord, unnest(string_split(text, chr(10))) as content from documents),
c as (select doc_id, ord::int as ord, row_number() over (partition by doc_id order by ord) as n, trunc(len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) * 1.3)::int + 2048 as tokens from l where trim(content) <> ''),
f as (select doc_id, n, ord, tokens, tokens as used, 1 as requests, 0 as w from c where n = 1
  union all select c.doc_id, c.n, c.ord, c.tokens, case when requests >= 30 or used + c.tokens > 20000 then c.tokens else used + c.tokens end, case when requests >= 30 or used + c.tokens > 20000 then 1 else requests + 1 end, w + (requests >= 30 or used + c.tokens > 20000)::int
  from f join c on c.doc_id = f.doc_id and c.n = f.n + 1)
select doc_id, ord, tokens, w as "window" from f
"""


def compact(spark, sf_dir):
    return H.reconstructed(H.sections(_law(spark, sf_dir)), full=True, compact=True).select("doc_id", F.md5("text").alias("text_md5"))


_OWN = """concat(repeat('    ', d), header, chr(10), case when title <> '' then repeat('    ', d) || title || chr(10) else '' end, case when content <> '' then repeat('    ', d) || content || chr(10) else '' end)"""
def compact_sql(own: str) -> str:
    """Tables l1 to l4 (doc_id, parent_ord, ord, t): each level's sections, `own` and those below, stripped."""
    made = r""", o as (select *, """ + own + r""" as own from (select *, len(regexp_extract_all(section_id, '_(art|ch|cl_|pt_)'))::int - 1 as d from sections)),
l4 as (select doc_id, parent_ord, ord, regexp_replace(own, '^\s+|\s+$', '', 'g') as t from o where level = 4)
"""
    for n in (3, 2, 1):
        lower = " union all ".join(f"select * from l{m}" for m in range(4, n, -1))
        made += rf""", k{n} as (select doc_id, parent_ord, string_agg(t, '' order by ord) as kids from ({lower}) group by all),
l{n} as (select o.doc_id, o.parent_ord, o.ord, regexp_replace(own || coalesce(kids, ''), '^\s+|\s+$', '', 'g') as t from o left join k{n} on k{n}.doc_id = o.doc_id and k{n}.parent_ord = o.ord where level = {n})
"""
    return made + ", texts as (select * from l1 union all select * from l2 union all select * from l3 union all select * from l4)"


_TEXT = "case when title <> '' then repeat('    ', d) || title || chr(10) else '' end, case when content <> '' then repeat('    ', d) || content || chr(10) else '' end)"
OWN = "concat(repeat('    ', d), header, chr(10), " + _TEXT
OWN_BARE = "concat(" + _TEXT
COMPACT = LAW + compact_sql(OWN) + r"""
select doc_id, md5(regexp_replace(string_agg(t, chr(10) order by ord), '^\s+|\s+$', '', 'g')) as text_md5 from texts where parent_ord is null group by 1"""


def full_references(spark, sf_dir):
    """Section rows with the headers of all ancestors behind their own."""
    found = H.full_headers(H.sections(_law(spark, sf_dir)))
    return found.select("doc_id", "section_id", "reference")


FULL_REFERENCES = LAW + """, up as (select s.doc_id, s.section_id, string_agg(a.header, ', ' order by length(a.section_id) desc) as above from sections s join sections a on a.doc_id = s.doc_id and starts_with(s.section_id, a.section_id || '_') group by 1, 2)
select s.doc_id, s.section_id, any_value(s.header) || coalesce(', ' || any_value(above), '') as reference from sections s left join up using (doc_id, section_id) group by 1, 2"""


def enums(spark, sf_dir):
    from lawframe.operators.citations import is_statute

    c = _table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    role = F.get(F.array(*map(F.lit, ("ADMIN", "MODERATOR", "USER"))), (n % 4).cast("int"))
    tier = F.when(n % 3 == 0, "PREPAID_PRO").otherwise(F.col("c_mktsegment"))
    name = F.concat(F.when(n % 5 == 0, "Bộ luật ").when(n % 5 == 1, "LUẬT ").otherwise(""), "c_name")
    return c.select("c_custkey", K.may_moderate(role).alias("moderates"), K.known_tier(tier).alias("known"), is_statute(name).alias("statute"))


ENUMS = "select c_custkey, c_custkey % 4 < 2 as moderates, c_custkey % 3 = 0 as known, c_custkey % 5 < 2 as statute from customer"


def flat_pages(spark, sf_dir):
    html = F.concat(F.lit("<table><tr><td>"), "url", F.lit("</td><td> x </td></tr></table>"))
    return _table(spark, sf_dir, "pages").select("page_id", flatten_table(html).alias("flat"))


FLAT_PAGES = "select page_id, url || ' | x' as flat from pages"


def sessions(spark, sf_dir):
    """Runs of a user's events with gaps under half an hour."""
    e = _table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("events")).select("user_id", F.unix_micros("s.start").alias("start"), "events")


SESSIONS = """
with g as (select user_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 1800000000 then 0 else 1 end as opens from events),
s as (select user_id, ts, sum(opens) over (partition by user_id order by ts) as n from g)
select user_id, epoch_us(min(ts)) as start, count(*) as events from s group by user_id, n
"""


def monthly_top(spark, sf_dir):
    """The three heaviest users of each day."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor(F.abs("value") * 10).cast("bigint").alias("tokens"))
    w = Window.partitionBy("day").orderBy(F.desc("tokens"), "user_id")
    return U.daily(e).withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 3").select("day", "user_id", "tokens", "rank")


MONTHLY_TOP = """
with d as (select user_id, ts::date as day, sum(floor(abs(value) * 10)::bigint)::bigint as tokens from events group by 1, 2),
r as (select *, row_number() over (partition by day order by tokens desc, user_id) as rank from d)
select day, user_id, tokens, rank from r where rank <= 3
"""

QUERIES = {
    "K7_raw_point": (raw_point, RAW_POINT), "K8_scroll_filter": (scroll, SCROLL), "K9_point_lookup": (point_lookup, POINT_LOOKUP), "P5_folder_catalog": (folder, FOLDER),
    "P6_file_order": (file_order, FILE_ORDER), "K10_upload_counts": (upload_counts, UPLOAD_COUNTS), "K11_repaired_text": (repaired, REPAIRED), "K12_audit_log": (audit, AUDIT),
    "K13_null_free": (null_free, NULL_FREE), "P7_repair_budget": (budget, BUDGET), "S8_reconstruct_compact": (compact, COMPACT), "S9_full_references": (full_references, FULL_REFERENCES),
    "T19_enum_predicates": (enums, ENUMS), "T20_page_tables": (flat_pages, FLAT_PAGES), "U8_session_windows": (sessions, SESSIONS), "U9_daily_top_users": (monthly_top, MONTHLY_TOP),
}
