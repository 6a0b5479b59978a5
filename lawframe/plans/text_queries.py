"""Queries over text operators, each with its SQL twin. Legal markup is composed from table rows, alike in both."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawframe.functions import text as T

EMPTY = "''"


def _docs(spark, sf_dir, *columns):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def sanitize(spark, sf_dir):
    quoted = F.concat(F.lit("a\\b \"q\" 'r' "), F.col("text"))
    return _docs(spark, sf_dir, "doc_id", T.sanitize(quoted).alias("clean"))


SANITIZE = r"""
select doc_id, replace(replace(replace('a\b "q" ''r'' ' || text, '\', '\\'), '"', '\"'), '''', '\''') as clean from documents
"""


def tables_removed(spark, sf_dir):
    text = F.concat(F.col("text"), F.lit("<table>\nx</table>tail<table>y\n</table>"))
    return _docs(spark, sf_dir, "doc_id", T.remove_tables(text).alias("plain"))


TABLES_REMOVED = """
select doc_id, regexp_replace(text || '<table>' || chr(10) || 'x</table>tail<table>y' || chr(10) || '</table>', '<table>.*?</table>', '', 'gs') as plain
from documents
"""


def tables_flattened(spark, sf_dir):
    html = F.concat(F.lit("lost<table><tr><td> "), F.col("source"), F.lit(" </td><td><b>"), F.col("lang"), F.lit("</b></td></tr>\n<tr><td>"), F.col("doc_id").cast("string"), F.lit("</td></tr></table>"))
    return _docs(spark, sf_dir, "doc_id", T.flatten_table(html).alias("flat"), T.flatten_appendix(html).alias("appendix"))


TABLES_FLATTENED = """
with t as (select doc_id, source || ' | ' || lang || chr(10) || doc_id::varchar as flat from documents)
select doc_id, flat, flat as appendix from t
"""


def tables_rebuilt(spark, sf_dir):
    content = F.concat(F.lit("head\n<table>\n<tr>\n<td> "), F.col("source"), F.lit("</td>\n<td>"), F.col("lang"), F.lit(" </td>\n</tr>\n</table>\ntail"))
    return _docs(spark, sf_dir, "doc_id", T.reconstruct_table(content, 1).alias("rebuilt"))


TABLES_REBUILT = """
select doc_id, '    head' || chr(10) || '    ' || source || ' | ' || lang || chr(10) || chr(10) || '    tail' || chr(10) as rebuilt from documents
"""


def word_counts(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", T.count_words(F.col("text")).cast("bigint").alias("n_words"))


WORD_COUNTS = r"select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::bigint as n_words from documents"


def ids_base64(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", T.unique_id(F.col("source"), F.col("text"), "DOC").alias("record_id"))


IDS_BASE64 = """
select doc_id, 'DOC_' || translate(left(base64(unhex(sha256(source || '|' || text))), 10), '+/', '-_') as record_id from documents
"""


def ids_hex(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", T.unique_hex_id(F.col("source"), F.col("text"), "DOC").alias("record_id"))


IDS_HEX = "select doc_id, 'DOC_' || upper(left(sha256(source || text), 8)) as record_id from documents"


def cache_keys(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return rows.select("item_id", T.cache_key(F.concat(F.lit(" \n\t"), "text", F.lit("  "))).alias("cache_key"))


CACHE_KEYS = r"""select item_id, md5(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) as cache_key from benchmark"""


def masked(spark, sf_dir):
    key = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.left("text", (F.col("doc_id") % 9).cast("int")))
    return _docs(spark, sf_dir, "doc_id", T.mask_key(key).alias("masked"))


MASKED = """
with t as (select doc_id, case when doc_id % 7 = 0 then null else left(text, (doc_id % 9)::int) end as k from documents)
select doc_id, case when k is null then '***' when length(k) <= 4 then 'invalid' else '***' || right(k, 4) end as masked from t
"""


def text_types(spark, sf_dir):
    kind = F.col("doc_id") % 4
    raw = F.when(kind == 0, F.lit('{"a": 1}')).when(kind == 1, F.lit("12")).when(kind == 2, F.concat(F.lit("<title>"), "source", F.lit("</title>\n<content>x\ny</content>"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir, "doc_id", T.text_type(raw).alias("text_type"))


TEXT_TYPES = "select doc_id, case when doc_id % 4 < 2 then 'json' when doc_id % 4 = 2 then 'tagged' else 'unformatted' end as text_type from documents"


def document_numbers(spark, sf_dir):
    text = F.concat(F.lit("<table>\n<td> Số: "), F.col("doc_id").cast("string"), F.lit("/2020/NĐ-CP, x</td>\n"), F.col("text"))
    return _docs(spark, sf_dir, "doc_id", T.document_number(text).alias("number"), T.document_number(F.col("source")).alias("none"))


DOCUMENT_NUMBERS = "select doc_id, doc_id::varchar || '/2020/NĐ-CP' as number, '' as none from documents"


def names(spark, sf_dir):
    lines = F.concat(F.lit("\n<table>\nA\n</table>\n  LUẬT "), F.upper("source"), F.lit("\n\nvề "), F.col("lang"), F.lit("\nthêm"))
    appendix = F.concat(F.lit("Ban hành kèm 1/2/2020\nabc\nPHỤ LỤC "), F.upper("source"), F.lit("\nmô tả "), F.col("lang"))
    return _docs(spark, sf_dir, "doc_id", T.main_name(lines).alias("main"), T.appendix_name(appendix).alias("appendix"), T.appendix_name(F.concat(F.lit("x\ny "), F.col("lang"))).alias("plain"))


NAMES = """
select doc_id, 'LUẬT ' || upper(source) || ' về ' || lang as main, 'PHỤ LỤC ' || upper(source) || ' mô tả ' || lang as appendix, 'x y ' || lang as plain
from documents
"""


def sources(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    chunk = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("D"), n, F.lit("_art00"), n, F.lit("_cl_0"), n, F.lit("_pt_b"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("D"), n, F.lit("_ART0"), n)).otherwise(F.concat(F.lit("D"), n))
    given = F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise(F.lit(""))
    return _docs(spark, sf_dir, "doc_id", T.source_of(chunk).alias("rebuilt"), T.backfilled_source(given, chunk).alias("filled"))


SOURCES = """
with t as (select doc_id, source, case doc_id % 3
    when 0 then 'khoản ' || doc_id || ', Điều ' || doc_id || ', điểm b văn bản D' || doc_id
    when 1 then 'Điều ' || doc_id || ' văn bản D' || doc_id else 'văn bản D' || doc_id end as rebuilt from documents)
select doc_id, rebuilt, case when doc_id % 5 = 0 then source else rebuilt end as filled from t
"""


def levels(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, ("chapter", "article", "clause", "point", "appendix", "table"))), (F.col("doc_id") % 6).cast("int"))
    return _docs(spark, sf_dir, "doc_id", T.hierarchy_level(kind, F.lit(7)).cast("int").alias("level"), T.hierarchy_level(kind, F.lit(7), 1).cast("int").alias("flat_level"))


LEVELS = "select doc_id, [1,2,3,4,5,8][doc_id % 6 + 1]::int as level, [1,2,3,4,1,8][doc_id % 6 + 1]::int as flat_level from documents"


def years(spark, sf_dir):
    mention = F.concat(F.lit("số 1/1999 theo Nghị định 12/"), (F.col("doc_id") % 30 + 1990).cast("string"), F.lit("/NĐ-CP"))
    return _docs(spark, sf_dir, "doc_id", T.issue_year(mention).alias("first_year"), T.positional_issue_year(mention).alias("cited_year"), T.issue_year(F.col("source")).alias("none"))


YEARS = "select doc_id, '1999' as first_year, (doc_id % 30 + 1990)::varchar as cited_year, null::varchar as none from documents"


def enrichment(spark, sf_dir):
    answer = F.concat(F.lit("Main Topic: old\nMain Topic: "), F.col("source"), F.lit("\nApplicability:x \nGenerated Title: T\nAssigned Categories: a, "), F.col("lang"))
    e = T.enrichment(answer)
    return _docs(spark, sf_dir, "doc_id", e["main_topic"].alias("main_topic"), e["applicability"].alias("applicability"), e["generated_title"].alias("title"), F.array_join(e["categories"], "|").alias("categories"))


ENRICHMENT = "select doc_id, source as main_topic, 'x' as applicability, 'T' as title, 'a|' || lang as categories from documents"


def answers(spark, sf_dir):
    key = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('so: {"keywords": ["'), "source", F.lit('", "b"]} {x}'))).otherwise(F.concat(F.lit("two words "), "lang"))
    score = F.concat(F.lit("Score 17 is "), (F.col("doc_id") % 12).cast("string"), F.lit("."))
    intent = F.when(F.col("doc_id") % 3 == 0, '{"irrelevant": true, "note": {}}').when(F.col("doc_id") % 3 == 1, 'x {"history": true} y').otherwise("nothing")
    return _docs(spark, sf_dir, "doc_id", F.array_join(T.keywords(key, 2), "|").alias("keywords"), T.relevance(score).alias("relevance"), T.intention(intent).alias("intention"))


ANSWERS = """
select doc_id, case when doc_id % 2 = 0 then source || '|b' else 'two|words' end as keywords,
  case when doc_id % 12 between 1 and 10 then doc_id % 12 else 5 end::int as relevance,
  ['irrelevant', 'history', 'rag'][doc_id % 3 + 1] as intention from documents
"""


def tagged(spark, sf_dir):
    title = F.when(F.col("doc_id") % 4 == 0, F.lit("<title>broken")).otherwise(F.concat(F.lit("<title>"), "source", F.lit("</title>")))
    raw = F.concat(F.lit("<id="), F.col("doc_id").cast("string"), F.lit(">\n"), title, F.lit("\n<published_date>2024-09-22</published_date>\n<categories><C 1><"), "lang", F.lit("></categories>\n<content>\n "), F.col("text"), F.lit("</content></id=x>"))
    r = T.tagged_record(raw)
    return _docs(spark, sf_dir, "doc_id", r["record_id"].alias("record_id"), r["title"].alias("title"), F.array_join(r["categories"], "|").alias("categories"), r["content"].alias("content"))


TAGGED = r"""
select doc_id, case when doc_id % 4 > 0 then doc_id::varchar end as record_id, case when doc_id % 4 > 0 then source end as title,
  case when doc_id % 4 > 0 then 'C 1|' || lang end as categories, case when doc_id % 4 > 0 then regexp_replace(text, '^\s+|\s+$', '', 'g') end as content
from documents
"""


def tagged_files(spark, sf_dir):
    one = F.concat(F.lit("<id="), "source", F.lit(">a\nb</id=zz>"))
    blocks = _docs(spark, sf_dir, "doc_id", F.posexplode(T.tagged_blocks(F.concat(one, F.lit("\nnoise\n"), F.lit("<id=q>c</id>"), one))).alias("ord", "block"))
    return blocks.select("doc_id", "ord", "block")


TAGGED_FILES = """
select doc_id, unnest([0, 1])::int as ord, unnest(['<id=' || source || '>a' || chr(10) || 'b</id=' || source || '>',
  '<id=q>c</id><id=' || source || '>a' || chr(10) || 'b</id=q>']) as block from documents
"""


def citations(spark, sf_dir):
    hits = F.array(*[F.struct(F.concat(F.lit(f"R{i}_"), F.col("doc_id").cast("string")).alias("record_id"), F.when(F.col("doc_id") % (i + 1) == 0, F.col("source")).alias("content")) for i in (1, 2)])
    return _docs(spark, sf_dir, "doc_id", T.citation_suffix(hits).alias("suffix"), T.has_citation(F.concat(F.lit("see "), F.when(F.col("doc_id") % 2 == 0, "[12/2020/ND-CP]").otherwise("[none]"))).alias("cited"))


CITATIONS = r"""
with t as (select doc_id, list_filter([case when doc_id % 2 = 0 then '[Record ID: R1_' || doc_id || ']' end, case when doc_id % 3 = 0 then '[Record ID: R2_' || doc_id || ']' end], lambda x: x is not null) as c from documents)
select doc_id, case when len(c) > 0 then chr(10) || chr(10) || 'References: ' || array_to_string(c, ', ') else '' end as suffix, doc_id % 2 = 0 as cited from t
"""


def typed_codec(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id") % 6
    raw = F.when(n == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(n == 1, "true").when(n == 2, F.lit("[1, 2]")).when(n == 3, F.lit('{"a":1}')).when(n == 4, F.col("user_id").cast("string")).otherwise(F.concat(F.col("user_id").cast("string"), F.lit(".5")))
    typed, number = T.encode_typed(raw), T.decode_number(raw)
    return events.select("event_id", typed["type"].alias("kind"), F.when(n.isin(0, 1, 4), typed["value"]).alias("value"), number["whole"].alias("whole"), number["fraction"].alias("fraction"))


TYPED_CODEC = """
select event_id, ['S', 'BOOL', 'L', 'M', 'N', 'N'][event_id % 6 + 1] as kind,
  case event_id % 6 when 0 then event_type when 1 then 'true' when 4 then user_id::varchar end as value,
  case when event_id % 6 = 4 then user_id end as whole, case when event_id % 6 = 5 then user_id + 0.5 end::double as fraction from events
"""


def record_json(spark, sf_dir):
    made = F.to_json(F.struct(F.col("source").alias("title"), F.col("text").alias("content")))
    back = F.from_json(made, "record_id string, title string, content string, hierarchy_level int, language string, validation_status boolean")
    return _docs(
        spark, sf_dir, "doc_id", back["title"].alias("title"), back["content"].alias("content"), F.coalesce(back["hierarchy_level"], F.lit(1)).alias("hierarchy_level"),
        F.coalesce(back["language"], F.lit("vi")).alias("language"), F.coalesce(back["validation_status"], F.lit(False)).alias("validation_status"),
        F.coalesce(back["record_id"], T.unique_id(back["title"], back["content"], "DOC")).alias("record_id"),
    )


RECORD_JSON = """
select doc_id, source as title, text as content, 1 as hierarchy_level, 'vi' as language, false as validation_status,
  'DOC_' || translate(left(base64(unhex(sha256(source || '|' || text))), 10), '+/', '-_') as record_id from documents
"""


def validated(spark, sf_dir):
    docs = _docs(spark, sf_dir, "doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id").cast("string")).alias("record_id"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).otherwise(F.lit(" ")).alias("title"), F.col("text").alias("content"))
    errors = T.validation_errors({"record_id": "string", "title": "string", "content": "string"})
    return docs.select("doc_id", F.array_join(errors, ",").alias("errors"), (F.size(errors) == 0).alias("valid"))


VALIDATED = """
with t as (select doc_id, list_filter([case when doc_id % 5 = 0 then 'record_id' end, case when doc_id % 3 = 0 then 'title' end, case when trim(text) = '' then 'content' end], lambda x: x is not null) as e from documents)
select doc_id, coalesce(array_to_string(e, ','), '') as errors, len(e) = 0 as valid from t
"""


def keyword_filter(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "lang", "text").filter(T.matches_any(F.col("text"), ["THAT", "zu "])).groupBy("lang").agg(F.count("*").alias("n"))


KEYWORD_FILTER = "select lang, count(*) as n from documents where contains(lower(text), 'that') or contains(lower(text), 'zu ') group by lang"


def file_types(spark, sf_dir):
    path = F.concat(F.col("url"), F.get(F.array(*map(F.lit, (".PDF", ".docx", ".htm", ".html", ".txt", ".xyz"))), (F.col("page_id") % 6).cast("int")))
    from lawframe.sources.files import file_type

    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", file_type(path).alias("file_type"))


FILE_TYPES = "select page_id, ['pdf', 'docx', 'html', 'html', 'txt', 'unsupported'][page_id % 6 + 1] as file_type from pages"


QUERIES = {
    "T0_sanitize": (sanitize, SANITIZE),
    "T7_table_strip": (tables_removed, TABLES_REMOVED),
    "T7_table_flatten": (tables_flattened, TABLES_FLATTENED),
    "T7_table_rebuild": (tables_rebuilt, TABLES_REBUILT),
    "T10_word_count": (word_counts, WORD_COUNTS),
    "T1_unique_id_sha256_b64": (ids_base64, IDS_BASE64),
    "T2_unique_id_hex": (ids_hex, IDS_HEX),
    "T3_cache_key_md5": (cache_keys, CACHE_KEYS),
    "T4_mask": (masked, MASKED),
    "T5_text_type": (text_types, TEXT_TYPES),
    "T9_document_number": (document_numbers, DOCUMENT_NUMBERS),
    "T9_first_lines_name": (names, NAMES),
    "T6_source_reconstruct": (sources, SOURCES),
    "T12_hierarchy_level": (levels, LEVELS),
    "T13_issue_year": (years, YEARS),
    "T14_enrichment": (enrichment, ENRICHMENT),
    "T8_model_answers": (answers, ANSWERS),
    "T11_tagged_record_parse": (tagged, TAGGED),
    "T15_tagged_file": (tagged_files, TAGGED_FILES),
    "R4_citations_sources": (citations, CITATIONS),
    "T16_typed_codec": (typed_codec, TYPED_CODEC),
    "T17_record_json": (record_json, RECORD_JSON),
    "P1_validate_schema": (validated, VALIDATED),
    "T18_keyword_filter": (keyword_filter, KEYWORD_FILTER),
    "P2_route_by_type": (file_types, FILE_TYPES),
}
