"""Queries over keyed tables, metering, conversations, citations, TF-IDF and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawframe.functions.language import STOP_WORDS as LANGUAGE_WORDS
from lawframe.functions.language import language
from lawframe.functions.text import cache_key
from lawframe.operators import citations as M
from lawframe.operators import records as R
from lawframe.operators import store as K
from lawframe.operators import tfidf as W
from lawframe.operators import usage as U
from lawframe.sources.files import html_column


def language_sql(text: str) -> str:
    """The language of a text in SQL."""
    words = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}]+'), lambda w: w <> '')"
    scores = ", ".join("(len(list_filter({}, lambda w: w in ({}))), {})".format(words, ", ".join(f"'{w}'" for w in known), -i) for i, known in enumerate(LANGUAGE_WORDS.values()))
    codes = ", ".join(f"'{c}'" for c in LANGUAGE_WORDS)
    return f"(select case when (m).n > 0 then [{codes}][1 - (m).o] end from (select list_max([{scores}]::struct(n bigint, o bigint)[]) as m))"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- keyed tables: customers by segment play stored records, orders new ones


def upsert(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("payload"), F.col("c_custkey").alias("seq"))
    new = c.filter("c_custkey % 3 < 2").select(F.col("c_custkey").alias("record_id"), F.col("c_mktsegment").alias("payload"), F.col("c_custkey").alias("seq"))
    rows = K.upsert(old, new).select("record_id", "payload", F.col("place._side").alias("side"))
    return rows


UPSERT = """
select c_custkey as record_id, case when c_custkey % 3 < 2 then c_mktsegment else c_name end as payload, (c_custkey % 3 = 0)::int as side from customer
"""


def antijoin(spark, sf_dir):
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer").filter("c_nationkey < 12")
    return K.delete(o.withColumnRenamed("o_custkey", "k"), c.select(F.col("c_custkey").alias("k")), "k").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


ANTIJOIN = "select o_orderstatus, count(*) as n from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 12) group by 1"


def absent(spark, sf_dir):
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer").filter("c_nationkey < 12")
    new = o.select(F.col("o_custkey").alias("query_id"), "o_orderkey", "o_orderpriority")
    return K.insert_if_absent(c.select(F.col("c_custkey").alias("query_id")), new, "query_id", "o_orderkey")


ABSENT = """
select o_custkey as query_id, min(o_orderkey) as o_orderkey, arg_min(o_orderpriority, o_orderkey) as o_orderpriority from orders
where o_custkey not in (select c_custkey from customer where c_nationkey < 12) group by 1
"""


def partial(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    delta = c.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "new").alias("c_name"), F.lower("c_mktsegment").alias("c_mktsegment"))
    return K.partial_update(c, delta, "c_custkey")


PARTIAL = """select c_custkey, case when c_custkey % 4 = 0 then 'new' else c_name end as c_name, case when c_custkey % 2 = 0 then lower(c_mktsegment) else c_mktsegment end as c_mktsegment from customer"""


def cache(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark")
    held = b.filter("item_id % 3 > 0").select(cache_key(F.col("text")).alias("cache_key"), F.concat(F.lit("a"), "item_id").alias("response_text"), F.when(F.col("item_id") % 3 == 1, 2000).otherwise(500).cast("bigint").alias("ttl"), F.lit(True).alias("is_complete"))
    asked = b.select(F.col("item_id").alias("query_id"), F.concat(F.lit(" \t"), "text").alias("query_text"))
    return K.cached_answers(asked, held, 1000).select("query_id", "response_text", "hit")


CACHE = r"""
with k as (select item_id, md5(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) as k from benchmark), h as (select k, 'a' || item_id as r from k where item_id % 3 = 1),
a as (select item_id, md5(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) as k from benchmark)
select item_id as query_id, r as response_text, r is not null as hit from a left join h using (k)
"""


def cache_put(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark")
    held = b.filter("item_id % 3 > 0").select(cache_key(F.col("text")).alias("cache_key"), F.lit("old").alias("response_text"), F.when(F.col("item_id") % 3 == 1, 2000).otherwise(500).cast("bigint").alias("ttl"))
    return K.cache_put(held, b.select(F.col("text").alias("query_text"), F.lit("new").alias("response_text")), 1000)


CACHE_PUT = r"""
select distinct md5(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) as cache_key, case when item_id % 3 = 1 then 'old' else 'new' end as response_text,
  case when item_id % 3 = 1 then 2000 else 4600 end::bigint as ttl from benchmark
"""


# --- metering: events by type play questions with tokens


def _events(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.floor(F.abs("value") * 10).cast("bigint").alias("tokens"))


def daily(spark, sf_dir):
    return U.daily(_events(spark, sf_dir))


DAILY = "select user_id, ts::date as day, count(*) as questions, sum(floor(abs(value) * 10)::bigint)::bigint as tokens from events group by 1, 2"


def limit(spark, sf_dir):
    limits = spark.createDataFrame([("FREE", 2, 900), ("PRO", 5, 3000)], "tier string, max_questions long, max_tokens long")
    events = _events(spark, sf_dir).withColumn("tier", F.when(F.col("user_id") % 2 == 0, "FREE").otherwise("PRO"))
    return U.limited(events, limits).select("event_id", "questions", "total_tokens", "accepted")


LIMIT = """
with e as (select event_id, user_id, ts, floor(abs(value) * 10)::bigint as tokens from events),
r as (select *, count(*) over w as questions, sum(tokens) over w as total_tokens from e window w as (partition by user_id, ts::date order by ts, event_id rows unbounded preceding))
select event_id, questions, total_tokens::bigint as total_tokens, questions <= case when user_id % 2 = 0 then 2 else 5 end and total_tokens <= case when user_id % 2 = 0 then 900 else 3000 end as accepted from r
"""


def overview(spark, sf_dir):
    users = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    tiers = users.filter("user_id % 4 = 0").select("user_id", F.lit("PRO").alias("tier"))
    events = _events(spark, sf_dir)
    today = U.daily(events).filter(F.col("day") == events.agg(F.to_date(F.max("ts"))).first()[0])
    return U.overview(users, tiers, today)


OVERVIEW = """
with t as (select user_id, count(*) as questions, sum(floor(abs(value) * 10)::bigint)::bigint as tokens from events where ts::date = (select max(ts)::date from events) group by 1)
select c_custkey as user_id, c_name, case when c_custkey % 4 = 0 then 'PRO' else 'FREE' end as tier, coalesce(questions, 0) as questions, coalesce(tokens, 0) as tokens
from customer left join t on user_id = c_custkey
"""


def chat_log(spark, sf_dir):
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return joined.select("o_orderkey", "c_name", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).orderBy(F.desc("day"), "o_orderkey")


CHAT_LOG = "select o_orderkey, c_name, strftime(o_orderdate, '%Y-%m-%d') as day from orders join customer on o_custkey = c_custkey order by day desc, o_orderkey"


def templates(spark, sf_dir):
    asked = _table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    held = asked.filter("conv_id % 5 = 0").groupBy("question").agg(F.concat(F.lit("t"), F.min("conv_id")).alias("answer"))
    return U.answered(asked, held, "mock").select("conv_id", "turn", "answer")


TEMPLATES = """
with h as (select text, 't' || min(conv_id) as answer from conversations where role = 'user' and conv_id % 5 = 0 group by 1)
select conv_id, turn, coalesce(answer, 'mock') as answer from conversations left join h using (text) where role = 'user'
"""


def sliding(spark, sf_dir):
    return U.sliding_counts(_events(spark, sf_dir), 3600).select("event_id", "recent")


SLIDING = "select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 3600000000 preceding and current row) as recent from events"


def windows(spark, sf_dir):
    return U.fixed_windows(_events(spark, sf_dir), 60).select("user_id", F.unix_seconds("start").alias("start"), "requests", "tokens")


WINDOWS = "select user_id, (epoch_us(ts) // 60000000 * 60)::bigint as start, count(*) as requests, sum(floor(abs(value) * 10)::bigint)::bigint as tokens from events group by 1, 2"


# --- conversations


def qa_pairs(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    q, a = c.filter("role = 'user'"), c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = q.join(a, ["conv_id", "turn"]).select(F.col("text").alias("question"), "answer", F.when(F.col("conv_id") % 2 == 0, '{"categories": ["x", "x"], "language": "en"}').alias("metadata"))
    return R.qa_records(pairs).select("record_id", "title", "content", F.array_join("categories", ",").alias("categories"), "language", "validation_status")


QA_PAIRS = """
select 'QA_' || translate(left(base64(unhex(sha256(q.text || '|' || a.text))), 10), '+/', '-_') as record_id, 'Answer for: ' || q.text as title, a.text as content,
  case when q.conv_id % 2 = 0 then 'x' else 'QA' end as categories, case when q.conv_id % 2 = 0 then 'en' else 'vi' end as language, true as validation_status
from conversations q join conversations a on q.conv_id = a.conv_id and a.turn = q.turn + 1 where q.role = 'user' and a.role = 'assistant'
"""


def history(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    return rows.select("conv_id", F.size("h").alias("turns"), F.md5(F.array_join(F.transform("h", lambda r: F.concat(r["role"], F.lit(": "), r["text"])), "\n")).alias("history_md5"))


HISTORY = "select conv_id, count(*)::int as turns, md5(string_agg(role || ': ' || text, chr(10) order by turn)) as history_md5 from conversations group by 1"


# --- TF-IDF and citations

TFIDF = r"""
with d as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as token from documents),
tf as (select doc_id, token, count(*) as tf from d group by all), n as (select count(*) as n from documents),
idf as (select token, ln((1 + n) / (1 + count(*))) + 1 as idf from tf, n group by token, n),
raw as (select doc_id, token, tf * idf as raw from tf join idf using (token)),
len as (select doc_id, sqrt(sum(raw * raw)) as len from raw group by 1),
w as (select doc_id, token, raw / len as weight from raw join len using (doc_id))
"""


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def tfidf_query(spark, sf_dir):
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = W.query_similarity(queries, _docs(spark, sf_dir))
    return found.filter("similarity >= 0.3").select("query_id", "doc_id", F.round("similarity", 5).alias("similarity"))


TFIDF_QUERY = TFIDF + r""", q as (select item_id as query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as token from benchmark),
qr as (select query_id, token, count(*) * any_value(idf) as raw from q join idf using (token) group by all), ql as (select query_id, sqrt(sum(raw * raw)) as len from qr group by 1)
select query_id, doc_id, round(sum(raw / len * weight), 5) as similarity from qr join ql using (query_id) join w using (token) group by 1, 2 having sum(raw / len * weight) >= 0.3"""


def token_db(spark, sf_dir):
    return W.token_table(_docs(spark, sf_dir)).select("token", F.round("weight", 4).alias("weight"), "occurrences")


TOKEN_DB = TFIDF + "select token, round(sum(weight), 4) as weight, sum(tf)::bigint as occurrences from w join tf using (doc_id, token) group by token"


def top_tokens(spark, sf_dir):
    return W.top_tokens(W.token_table(_docs(spark, sf_dir)), 100).select("token", F.round("weight", 4).alias("weight"))


TOP_TOKENS = TFIDF + "select token, round(sum(weight), 4) as weight from w group by token order by sum(weight) desc, token limit 100"


def _catalog(spark, sf_dir):
    """Parts as legal documents."""
    p, n = _table(spark, sf_dir, "part"), F.col("p_partkey")
    kind = F.get(F.array(*map(F.lit, ("luật", "bộ luật", "nghị định", "thông tư"))), (n % 4).cast("int"))
    number, year = (n % 90 + 1).cast("string"), (n % 7 + 2015).cast("string")
    return p.select(
        n.alias("position"), F.concat(F.lit("D"), n).alias("document_id"), F.concat(kind, F.lit(" "), number, F.lit("/"), year, F.lit(" "), "p_name").alias("full_name"), kind.alias("document_type"),
        number.alias("document_number"), year.alias("issue_year"), F.when(n % 2 == 0, "btc").otherwise("bca").alias("issuer_body"), F.concat(F.lit("f"), n).alias("filename"),
    )


CATALOG = """
with cat as (select p_partkey as position, 'D' || p_partkey as document_id, ['luật', 'bộ luật', 'nghị định', 'thông tư'][p_partkey % 4 + 1] as document_type, (p_partkey % 90 + 1)::varchar as document_number,
  (p_partkey % 7 + 2015)::varchar as issue_year, case when p_partkey % 2 = 0 then 'btc' else 'bca' end as issuer_body, p_name from part),
catalog as (select *, document_type || ' ' || document_number || '/' || issue_year || ' ' || p_name as full_name from cat)
"""


def _cited(spark, sf_dir):
    n = F.col("doc_id")
    return _docs(spark, sf_dir).select(n, F.concat(F.lit("theo Nghị định "), n % 90 + 1, F.lit("/"), n % 7 + 2015, F.lit(" và Luật ban hành số "), n % 50 + 1, F.lit("/2019/QH.\n"), "text").alias("text"))


def mentions(spark, sf_dir):
    return _cited(spark, sf_dir).select("doc_id", F.array_join(M.mentions(F.col("text")), "|").alias("mentions"))


MENTIONS = "select doc_id, 'Luật ' || (doc_id % 50 + 1) || '/2019/QH|Nghị định ' || (doc_id % 90 + 1) || '/' || (doc_id % 7 + 2015) as mentions from documents"


def _structured(spark, sf_dir):
    n = F.col("doc_id")
    text = F.concat(F.lit("nghị định "), n % 90 + 1, F.lit("/"), n % 7 + 2015, F.lit("/NĐ-CP bộ tài chính về thuế  và Bộ luật "), n % 50 + 1, F.lit(" và khác"))
    return _docs(spark, sf_dir).select(n.alias("id"), F.explode(M.structured_mentions(text)).alias("m")).select("id", "m.*")


def structured(spark, sf_dir):
    return _structured(spark, sf_dir)


STRUCTURED = """
select doc_id as id, unnest(['Nghị định ' || (doc_id % 90 + 1) || '/' || (doc_id % 7 + 2015) || '/NĐ-CP về thuế', 'Bộ luật ' || (doc_id % 50 + 1)]) as mention, unnest(['nghị định', 'bộ luật']) as document_type,
  unnest([(doc_id % 90 + 1)::varchar, (doc_id % 50 + 1)::varchar]) as document_number, unnest([(doc_id % 7 + 2015)::varchar, '']) as issue_year, unnest(['btc', '']) as issuer_body, unnest(['về thuế', '']) as extra_info
from documents
"""


def best_match(spark, sf_dir):
    cited = _cited(spark, sf_dir).select(F.col("doc_id").alias("id"), F.explode(M.mentions(F.col("text"))).alias("mention"))
    return M.best_match(cited, _catalog(spark, sf_dir)).select("id", "document_id", "score")


BEST_MATCH = CATALOG + """, m as (select doc_id as id, unnest(['Luật ' || (doc_id % 50 + 1) || '/2019/QH', 'Nghị định ' || (doc_id % 90 + 1) || '/' || (doc_id % 7 + 2015)]) as mention,
  unnest(['2019', (doc_id % 7 + 2015)::varchar]) as year from documents),
s as (select id, mention, document_id, position, case when contains(lower(full_name), lower(mention)) then 0.7 else 0 end + case when year = issue_year then 0.3 else 0 end as score from m, catalog),
r as (select *, row_number() over (partition by id order by score desc, mention, position) as n from s where score > 0)
select id, document_id, score::double as score from r where n = 1"""


TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def cited_sql(cutoff: float) -> str:
    """Each structured mention with the two documents that it stands for: by its properties, else by names alike by `cutoff`."""
    return CATALOG + ", m as (" + STRUCTURED + rf"""),
sure as (select m.id, m.mention, document_id, row_number() over (partition by m.id, m.mention order by c.issue_year::int desc, c.position) as rank from m join catalog c
  on c.document_type = m.document_type and c.document_number = m.document_number and c.issue_year = m.issue_year and c.issuer_body = m.issuer_body where m.issue_year <> ''),
open as (select m.* from m where not exists (select 1 from sure s where s.id = m.id and s.mention = m.mention)),
cand as (select o.id, o.mention, case when o.extra_info <> '' then lower(trim(o.document_type || ' ' || o.document_number || ' ' || o.extra_info)) else lower(o.mention) end as query, c.position, c.document_id, c.full_name, c.issue_year
  from open o join catalog c on (c.document_type = o.document_type or (c.document_type in ('luật', 'bộ luật') and o.document_type in ('luật', 'bộ luật'))) and c.document_number = o.document_number and (o.issuer_body = '' or c.issuer_body = o.issuer_body)),
n as (select id, mention, count(*) as n from cand group by all),
ct as (select id, mention, position, token, count(*) as tf from (select id, mention, position, unnest({TOKENS.format("full_name")}) as token from cand) group by all),
qt as (select id, mention, token, count(*) as tf from (select distinct id, mention, query, unnest(generate_series(1, 1)) as one from cand) q, lateral (select unnest({TOKENS.format("q.query")}) as token) group by all),
idf as (select id, mention, token, ln((1 + any_value(n)) / (1 + count(*))) + 1 as idf from ct join n using (id, mention) group by all),
cw as (select id, mention, position, token, tf * idf as w from ct join idf using (id, mention, token)), qw as (select id, mention, token, tf * idf as w from qt join idf using (id, mention, token)),
cn as (select id, mention, position, sqrt(sum(w * w)) as l from cw group by all), qn as (select id, mention, sqrt(sum(w * w)) as l from qw group by all),
near as (select id, mention, position, sum(cw.w * qw.w) / any_value(cn.l * qn.l) as score from cw join qw using (id, mention, token) join cn using (id, mention, position) join qn using (id, mention) group by all),
ranked as (select id, mention, document_id, score, row_number() over (partition by id, mention order by round(score, 9) desc, issue_year desc, position) as rank from near join cand using (id, mention, position) where score >= {cutoff})
select id, mention, document_id, 1.0::double as score, rank from sure where rank <= 2 union all select id, mention, document_id, round(score, 5), rank from ranked where rank <= 2"""


def weighted(spark, sf_dir):
    """All mentions; those without a year go by the likeness of names."""
    found = M.weighted_match(_structured(spark, sf_dir), _catalog(spark, sf_dir))
    return found.select("id", "document_id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


WEIGHTED = f"select id, document_id, score, rank from ({cited_sql(0.75)})"


def dynamic(spark, sf_dir):
    """Citations with words behind them that some of the catalog's names hold."""
    n = F.col("doc_id")
    word = F.get(F.array(*map(F.lit, ("red", "blue", "hot", "small"))), (n % 4).cast("int"))
    text = F.concat(F.lit("nghị định "), n % 90 + 1, F.lit("/"), n % 7 + 2015, F.lit("/NĐ-CP bộ tài chính về "), word, F.lit(" bolt và Bộ luật "), n % 50 + 1, F.lit(" về "), word)
    rows = _docs(spark, sf_dir).select(n.alias("id"), F.explode(M.structured_mentions(text)).alias("m")).select("id", "m.*")
    found = M.dynamic_match(rows, _catalog(spark, sf_dir), 2, 0.5)
    return found.select("id", "mention", "document_id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_PAIR_TOKENS = "list_filter(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x not in ({}))"
_KEPT = ", ".join(f"'{w}'" for w in W.STOP_WORDS)
DYNAMIC = CATALOG + f""", d as (select doc_id, ['red', 'blue', 'hot', 'small'][doc_id % 4 + 1] as word from documents),
m as (select doc_id as id, unnest(['Nghị định ' || (doc_id % 90 + 1) || '/' || (doc_id % 7 + 2015) || '/NĐ-CP về ' || word || ' bolt', 'Bộ luật ' || (doc_id % 50 + 1) || ' về ' || word]) as mention, unnest(['nghị định', 'bộ luật']) as document_type,
  unnest([(doc_id % 90 + 1)::varchar, (doc_id % 50 + 1)::varchar]) as document_number, unnest([(doc_id % 7 + 2015)::varchar, '']) as issue_year, unnest(['btc', '']) as issuer_body, unnest(['về ' || word || ' bolt', 'về ' || word]) as extra_info,
  unnest([3.2 / 3.8, 1.7 / 2.3])::double as base, unnest([0.6 / 3.8, 0.6 / 2.3])::double as extra from d),
p as (select m.*, c.document_id, c.position, c.full_name from m join catalog c
  on (c.document_type = m.document_type or (c.document_type in ('luật', 'bộ luật') and m.document_type in ('luật', 'bộ luật'))) and c.document_number = m.document_number
  and (m.issue_year = '' or c.issue_year = m.issue_year) and (m.issuer_body = '' or c.issuer_body = m.issuer_body)),
ct as (select id, mention, position, token, count(*) as tf from (select id, mention, position, unnest({_PAIR_TOKENS.format("lower(full_name)", _KEPT)}) as token from p) group by all),
qt as (select id, mention, position, token, count(*) as tf from (select id, mention, position, unnest({_PAIR_TOKENS.format("lower(extra_info)", _KEPT)}) as token from p) group by all),
b as (select id, mention, position, coalesce(ct.tf, 0) as c, coalesce(qt.tf, 0) as q, ln(3.0 / (1 + (ct.tf is not null)::int + (qt.tf is not null)::int)) + 1 as idf from ct full join qt using (id, mention, position, token)),
near as (select id, mention, position, coalesce(sum(c * idf * q * idf) / nullif(sqrt(sum(c * idf * c * idf)) * sqrt(sum(q * idf * q * idf)), 0), 0) as s from b group by all),
scored as (select p.id, p.mention, document_id, p.position, base + extra * coalesce(s, 0) as score from p left join near using (id, mention, position)),
r as (select *, row_number() over (partition by id, mention order by round(score, 9) desc, position) as rank from scored where score >= 0.5)
select id, mention, document_id, round(score, 5) as score, rank from r where rank <= 2"""


def partial_names(spark, sf_dir):
    """Every kind and year that documents mention, with what it may stand for: how many names, and a sum over them."""
    n = F.col("doc_id")
    asked = _docs(spark, sf_dir).select(F.when(n % 2 == 0, "luật").otherwise("thông tư").alias("document_type"), (n % 7 + 2015).cast("string").alias("issue_year")).distinct()
    names = M.partial_names(_catalog(spark, sf_dir)).join(asked, ["document_type", "issue_year"])
    sums = F.sum(F.conv(F.left(F.md5("full_name"), F.lit(8)), 16, 10).cast("bigint"))
    return names.groupBy("document_type", "issue_year").agg(F.count("*").alias("n"), sums.alias("names_sum"))


PARTIAL_NAMES = CATALOG + """, a as (select distinct case when doc_id % 2 = 0 then 'luật' else 'thông tư' end as document_type, (doc_id % 7 + 2015)::varchar as issue_year from documents)
select document_type, issue_year, count(*) as n, sum(('0x' || left(md5(full_name), 8))::bigint)::bigint as names_sum from catalog join a using (document_type, issue_year) group by 1, 2"""


def walked(spark, sf_dir):
    return M.walk(_cited(spark, sf_dir))


WALKED = """
select doc_id, unnest(['Nghị định ' || (doc_id % 90 + 1) || '/' || (doc_id % 7 + 2015) || ' và', 'Luật ban hành số ' || (doc_id % 50 + 1) || '/2019/QH.']) as mention, unnest(['nghị định', 'luật']) as document_type, '' as document_number,
  '' as issue_year, '' as issuer_body, unnest([(doc_id % 90 + 1) || '/' || (doc_id % 7 + 2015) || ' và', 'ban hành số ' || (doc_id % 50 + 1) || '/2019/QH.']) as extra_info from documents
"""


# --- sources and languages


def languages(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "lang", language(F.col("text")).alias("detected"))


LANGUAGES = f"select doc_id, lang, {language_sql('text')} as detected from documents"


def pages_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", html_column(F.col("html")).alias("text"), html_column(F.col("html"), " ").alias("line"))


# in SQL: tags cut texts apart but in scripts, four entities occur
_NODE = r"""replace(regexp_replace(replace(replace(replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g'), chr(1), '<')"""
_HELD = r"""regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(<script[^>]*>[^<]*)<(/?\w+>[^<]*</script>)', '\1' || chr(1) || '\2', 'g')"""
PAGES_TEXT = f"""
with n as (select page_id, list_filter(list_transform(regexp_split_to_array({_HELD}, '<[^>]*>'), lambda x: {_NODE}), lambda x: x <> '') as nodes from pages)
select page_id, array_to_string(nodes, chr(10)) as text, array_to_string(nodes, ' ') as line from n"""


# --- streams, over what files hold now


def _event_stream(spark, sf_dir):
    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    return stream.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.floor(F.abs("value") * 10).cast("bigint").alias("tokens"))


def stream_daily(spark, sf_dir):
    from lawframe.streaming.streams import available, daily_usage

    return available(daily_usage(_event_stream(spark, sf_dir)), "complete")


def stream_dedup(spark, sf_dir):
    """The files hold events of any age in any order, so no event of a hundred years counts as late."""
    from lawframe.streaming.streams import available, deduplicated

    return available(deduplicated(_event_stream(spark, sf_dir), "event_id", late="36500 days").select("event_id", "user_id"))


def answered(spark, sf_dir):
    """The whole question pipeline over benchmark items, documents being the collection."""
    from lawframe.plans.answering import answer
    from lawframe.plans.providers import embed

    docs = _table(spark, sf_dir, "documents")
    points = docs.select(F.lit("doc_768").alias("collection"), F.col("doc_id").alias("record_id"), embed(F.col("text")).alias("embedding"), F.col("text").alias("content"), F.col("source").alias("title"), F.col("lang").alias("document_id"), F.lit("").alias("source"), F.concat(F.lit("D"), "doc_id", F.lit("_art001")).alias("chunk_id"))
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return answer(queries, points, doc=0.3).select("query_id", "response_text", F.array_join("sources", ",").alias("sources"))


QUERIES = {
    "K1_jsonl_upsert": (upsert, UPSERT), "K2_id_antijoin": (antijoin, ANTIJOIN), "K3_insert_if_absent": (absent, ABSENT), "K4_partial_update": (partial, PARTIAL),
    "K5_ttl_cache": (cache, CACHE), "K6_cache_put": (cache_put, CACHE_PUT), "U1_daily_usage": (daily, DAILY), "U2_usage_limit_running": (limit, LIMIT),
    "U3_user_overview_leftjoin": (overview, OVERVIEW), "U4_chat_log_join": (chat_log, CHAT_LOG), "U5_template_lookup": (templates, TEMPLATES),
    "U6_sliding_rate_limit": (sliding, SLIDING), "U7_fixed_window_limit": (windows, WINDOWS), "Q1_qa_records": (qa_pairs, QA_PAIRS), "Q2_history_array": (history, HISTORY),
    "F1_tfidf_query": (tfidf_query, TFIDF_QUERY), "F2_token_db": (token_db, TOKEN_DB), "F3_top_tokens": (top_tokens, TOP_TOKENS), "M1_mentions_regex": (mentions, MENTIONS),
    "M2_mentions_structured": (structured, STRUCTURED), "M3_best_match_theta": (best_match, BEST_MATCH), "M4_weighted_match": (weighted, WEIGHTED),
    "M5_dynamic_weight_match": (dynamic, DYNAMIC), "M6_partial_names": (partial_names, PARTIAL_NAMES), "M7_mentions_walk": (walked, WALKED), "P3_language_detect": (languages, LANGUAGES),
    "P4_html_text": (pages_text, PAGES_TEXT), "X1_stream_daily_usage": (stream_daily, DAILY), "X2_stream_dedup": (stream_dedup, "select event_id, user_id from events"), "G6_answer_pipeline": (answered, None),
}
