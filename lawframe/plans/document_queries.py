"""Queries over document trees, formatting, reranking, embedding requests, uploads and citation search."""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
from pyspark.sql import functions as F

from lawframe.functions import text as T
from lawframe.operators import chunk as C
from lawframe.operators import citations as M
from lawframe.operators import search as S
from lawframe.operators import structure as H
from lawframe.operators import vector_index as V
from lawframe.plans import formatting, ingest, providers, uploads
from lawframe.plans.more_queries import COMPACT, OWN_BARE, compact_sql
from lawframe.plans.store_queries import CATALOG, _catalog, cited_sql, language_sql
from lawframe.plans.structure_queries import LAW, _law
from lawframe.scratch import passing, scratch_path, stored


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SAFE = r"""replace(replace(replace({}, '\', '\\'), '"', '\"'), '''', '\''')"""


# --- documents and their trees


def _files(spark, sf_dir):
    """Each document as a law file: a number, its text, and an appendix that holds a form."""
    n = F.col("doc_id").cast("string")
    text = F.concat(F.lit("Số: "), n, F.lit("/2020/QH\n"), "text", F.lit("\nPhụ lục I\nBan hành kèm theo\nBẢNG "), F.upper("lang"), F.lit("\ntrước\nMẫu số 1\nĐƠN\nĐiều 1. "), "source", F.lit("\n1. mục"))
    return _table(spark, sf_dir, "documents").select(F.concat(F.lit("in/f"), n, F.lit(".txt")).alias("path"), text.alias("text"))


def law_documents(spark, sf_dir):
    rows = ingest.law_documents(_files(spark, sf_dir))
    return rows.select("path", "doc_number", "doc_id", "doc_name", F.md5("content").alias("content_md5"))


LAW_DOCUMENTS = rf"""
with f as (select doc_id, lang, source, list_transform(string_split({SAFE.format("text")}, chr(10)), lambda x: {STRIP.format("x")}) as lines from documents),
m as (select doc_id, 'Số: ' || doc_id || '/2020/QH' || chr(10) || array_to_string(lines, chr(10)) as content, list_filter(lines, lambda x: x <> '') as shown from f),
a as (select doc_id, 'Ban hành kèm theo' || chr(10) || 'BẢNG ' || upper(lang) || chr(10) || 'trước' || chr(10) || 'Mẫu số 1' || chr(10) || 'ĐƠN' || chr(10) || 'Điều 1. ' || source || chr(10) || '1. mục' as content, 'BẢNG ' || upper(lang) || ' trước' as name from f)
select 'in/f' || doc_id || '.txt' as path, 1::int as doc_number, doc_id || '/2020/QH' as doc_id, 'Số: ' || doc_id || '/2020/QH' || coalesce(' ' || shown[1], '') as doc_name, md5(content) as content_md5 from m
union all select 'in/f' || doc_id || '.txt', 2::int, doc_id || '/2020/QH_appendix_02', name, md5(content) from a
"""


def structured(spark, sf_dir):
    """The JSON of each file, read back: the appendix's tree."""
    made = ingest.structured_json(_files(spark, sf_dir))
    node = "struct<id:string,header:string,title:string,content:string,subsections:array<struct<id:string,header:string,title:string,content:string,subsections:array<struct<id:string,header:string,title:string,content:string>>>>>"
    read = F.from_json("json", f"doc_filename string, documents array<struct<doc_number:int,doc_id:string,doc_name:string,articles:array<{node}>>>")
    rows = made.select("path", read.alias("r")).select("path", "r.doc_filename", F.posexplode("r.documents").alias("_", "d"))
    units = rows.filter("d.doc_number = 2").select("path", "doc_filename", "d.doc_id", F.explode("d.articles").alias("u"))
    return units.select("path", "doc_filename", "doc_id", "u.id", "u.header", F.md5("u.content").alias("content_md5"), F.array_join(F.flatten(F.transform("u.subsections", lambda s: F.concat(F.array(F.concat_ws("|", s["id"], s["title"], s["content"])), F.transform(s["subsections"], lambda k: F.concat_ws("|", k["id"], k["title"], k["content"]))))), ";").alias("below"))


STRUCTURED_JSON = """
with f as (select doc_id, 'in/f' || doc_id || '.txt' as path, 'f' || doc_id || '.txt' as doc_filename, doc_id || '/2020/QH_appendix_02' as id, lang, source from documents),
u as (select *, id || '_form_01' as unit, 'Form form_01' as header, 'Mẫu số 1' || chr(10) || 'ĐƠN' || chr(10) || 'Điều 1. ' || source || chr(10) || '1. mục' as content from f
  union all select *, id, 'Appendix Content', 'Ban hành kèm theo' || chr(10) || 'BẢNG ' || upper(lang) || chr(10) || 'trước' from f)
select path, doc_filename, id as doc_id, unit as id, header, md5(content) as content_md5, unit || '_art001||' || source || ';' || unit || '_art001_cl_01||mục' as below from u
"""


def hashed_words(texts: list[str], dim: int = 64) -> list[list[float]]:
    """How many words of each text fall to each place by their md5, which SQL knows too."""
    place = functools.cache(lambda word: int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim)
    return [np.bincount([place(w) for w in re.split(r"[ \t\n\f\r]+", t) if w], minlength=dim).astype(float).tolist() for t in texts]


providers.register("embedder", "hashed_words", hashed_words)


def simple(spark, sf_dir):
    """Clauses of longer articles hang together while their words are alike."""
    found = H.sections(_law(spark, sf_dir))
    rows = ingest.simplified(found, 100, 60, embed=lambda c: providers.embed(c, "hashed_words"))
    return rows.select("doc_id", "chapter_id", "chapter_header", "article_id", "part", "header", F.md5("title").alias("title_md5"), F.md5("content").alias("content_md5"))


def _words(x):
    return rf"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda y: y <> ''))"


SIMPLE = LAW + compact_sql(OWN_BARE) + rf""",
x as (select s.*, t from sections s join texts using (doc_id, ord)),
ch as (select doc_id, ord as chapter_ord, section_id as chapter_id, trim(header) as chapter_header from x where parent_ord is null),
ar as (select x.doc_id, x.ord, chapter_id, chapter_header, section_id as article_id, trim(trim(header) || ' ' || chapter_header) as header, coalesce(nullif(trim(title), ''), trim(content)) as title, t, {_words("t")} as words
  from x join ch on ch.doc_id = x.doc_id and ch.chapter_ord = x.parent_ord),
cl as (select ar.doc_id, ar.ord as article_ord, x.ord, trim(trim(x.header) || ' ' || ar.header) as header, x.t, {_words("x.t")}::int as words, row_number() over (partition by ar.doc_id, ar.ord order by x.ord) as n
  from ar join x on x.doc_id = ar.doc_id and x.parent_ord = ar.ord where ar.words > 100),
hs as (select *, list_transform(list_filter(regexp_split_to_array(t, '\s+'), lambda y: y <> ''), lambda y: ('0x' || left(md5(y), 8))::bigint % 64) as h from cl),
ve as (select * exclude (h), list_transform(range(64), lambda i: len(list_filter(h, lambda y: y = i))::double) as v from hs),
la as (select *, lag(v) over (partition by doc_id, article_ord order by n) as before from ve),
ne as (select * exclude (v, before), coalesce(list_dot_product(v, before) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(before, before)), 0), 1) as near from la),
fold as (select doc_id, article_ord, n, words as total, 0 as part from cl where n = 1
  union all select c.doc_id, c.article_ord, c.n, case when total + c.words > 60 or near < 0.6 then c.words else total + c.words end, part + (total + c.words > 60 or near < 0.6)::int from fold f join ne c on c.doc_id = f.doc_id and c.article_ord = f.article_ord and c.n = f.n + 1),
runs as (select doc_id, article_ord, part, arg_min(header, n) as header, string_agg(t, ' ' order by n) as content from fold join cl using (doc_id, article_ord, n) group by all)
select doc_id, chapter_id, chapter_header, article_id, 0::int as part, header, md5(title) as title_md5, md5(t) as content_md5 from ar where words <= 100
union all select r.doc_id, chapter_id, chapter_header, article_id, part::int, r.header, md5(title), md5(content) from runs r join ar on ar.doc_id = r.doc_id and ar.ord = r.article_ord
"""


def flat_appendices(spark, sf_dir):
    return ingest.flat_appendices(H.sections(_law(spark, sf_dir))).select("doc_id", F.md5("content").alias("text_md5"))


def roman(spark, sf_dir):
    """Parts that a Roman numeral marks, articles, clauses and points."""
    i = lambda n: (n + 1).cast("string")
    numerals = F.array(*map(F.lit, ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")))

    def line(x, n):
        word = F.concat(F.lit("zz "), x)
        return (
            F.when(n % 11 == 0, F.concat(F.element_at(numerals, (F.floor(n / 11) % 10 + 1).cast("int")), F.lit(". "), word)).when(n % 5 == 1, F.concat(F.lit("Điều "), i(n), F.lit(" - "), word))
            .when(n % 3 == 2, F.concat(i(n), F.lit(") "), word)).when(n % 7 == 3, F.concat(F.lit("b. "), word)).otherwise(word)
        )

    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))
    return H.sections(docs, H.ROMAN_ORDER).select("doc_id", "section_id", "parent_id", "parent_ord", "marker", "level", "ord", "header", "title", F.md5("content").alias("content_md5"))


NUMERAL = "['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X'][(ord // 11) % 10 + 1]"
ROMAN = (
    LAW.replace("'chapter'", "'roman_chapter'").replace("'ch' || (ord + 1)", f"'ch' || {NUMERAL}").replace("'Chương ' || (ord + 1)", f"'Phần ' || {NUMERAL}").replace("'pt_d'", "'pt_b'")
    .replace("when 'clause' then (ord + 1)::varchar when 'point' then 'd' end as header", "when 'clause' then 'Khoản ' || (ord + 1) when 'point' then 'Điểm b' end as header")
    + "select doc_id, section_id, parent_id, parent_ord, marker, level, ord, header, title, md5(content) as content_md5 from sections"
)


def whole_files(spark, sf_dir):
    """Files of three documents each."""
    docs, n = _table(spark, sf_dir, "documents"), F.col("doc_id")
    held = docs.select(F.concat(F.lit("f"), F.floor(n / 3).cast("string")).alias("path"), (n % 3 + 1).alias("doc_number"), n.cast("string").alias("doc_id"))
    return H.whole_file(H.sections(_law(spark, sf_dir)), held).select("path", F.md5("text").alias("text_md5"))


WHOLE_FILES = LAW + r""", h as (select s.*, len(regexp_extract_all(s.section_id, '_(art|ch|cl_|pt_)'))::int - 1 as d, concat_ws(', ', s.header, a.header, b.header, c.header) as full_header
  from sections s left join sections a on a.doc_id = s.doc_id and a.ord = s.parent_ord left join sections b on b.doc_id = a.doc_id and b.ord = a.parent_ord left join sections c on c.doc_id = b.doc_id and c.ord = b.parent_ord),
t as (select doc_id, string_agg(concat(repeat('    ', d), full_header, chr(10), case when title <> '' then repeat('    ', d) || title || chr(10) else '' end, case when content <> '' then repeat('    ', d) || content || chr(10) else '' end), '' order by ord) as text from h group by 1)
select 'f' || (documents.doc_id // 3) as path, md5(string_agg(coalesce(t.text, '') || chr(10) || repeat('-', 80) || chr(10) || chr(10), '' order by documents.doc_id)) as text_md5
from documents left join t on t.doc_id = documents.doc_id::varchar group by 1"""


def in_files(spark, sf_dir):
    """Sections without their document's name, looked up over all documents as files."""
    found = H.sections(_law(spark, sf_dir))
    bare = found.withColumn("file", F.concat(F.lit("f"), F.lpad("doc_id", 12, "0"))).withColumn("section_id", F.expr("substring(section_id, length(doc_id) + 2)"))
    wanted = spark.createDataFrame([("ch1_art002",), ("ch1_art002_cl_03",), ("ch1",), ("ch12_art017_cl_18",), ("none",)], "wanted string")
    return H.section_in_files(bare, wanted).select("wanted", "file", F.md5("text").alias("text_md5"))


IN_FILES = LAW + r""", b as (select *, 'f' || lpad(doc_id, 12, '0') as file, section_id[length(doc_id) + 2:] as id from sections),
w as (select unnest(['ch1_art002', 'ch1_art002_cl_03', 'ch1', 'ch12_art017_cl_18', 'none']) as wanted),
r as (select wanted, file, ord, header, title, content, len(regexp_extract_all('_' || id, '_(art|ch|cl_|pt_)')) - len(regexp_extract_all('_' || wanted, '_(art|ch|cl_|pt_)')) as d from w join b on id = wanted or starts_with(id, wanted || '_')),
t as (select wanted, file, string_agg(concat(repeat('    ', d::int), header, chr(10), case when title <> '' then repeat('    ', d::int) || title || chr(10) else '' end, case when content <> '' then repeat('    ', d::int) || content || chr(10) else '' end), '' order by ord) as text from r group by 1, 2)
select wanted, min(file) as file, md5(arg_min(text, file)) as text_md5 from t group by 1"""


# --- formatting


def _raw(spark, sf_dir):
    """Documents as JSON, tagged and plain texts, a third each."""
    n = F.col("doc_id") % 3
    tagged = F.concat(F.lit("<title>"), "source", F.lit("</title>\n<content>"), "text", F.lit("</content>"))
    return _table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.when(n == 0, F.to_json(F.struct(F.col("source").alias("title"), F.col("text").alias("content")))).when(n == 1, tagged).otherwise(F.concat(F.lit("plain "), "text")).alias("raw"))


#: to_json escapes as the twin does only where a text is plain, so JSON inputs are compared by what they hold.
def modes(spark, sf_dir):
    docs = _raw(spark, sf_dir).filter("doc_id % 3 > 0")
    made = [formatting.formatted(F.col("raw"), "tagged"), formatting.formatted(F.col("raw"), "json", json_schema={"title": "string"}), formatting.formatted(F.col("raw"), "json"), formatting.formatted(F.col("raw"), "enrichment", "DOC"), formatting.formatted(F.col("raw"), "none")]
    return docs.select("doc_id", *(F.md5(c).alias(name) for c, name in zip(made, ("tagged", "json", "no_schema", "enrichment", "unknown"), strict=True)))


def _said(name: str, text: str, **more: str) -> str:
    """What the default generator answers to a prompt, in SQL."""
    before, _, after = formatting.PROMPTS[name].partition("{}")
    for key, value in more.items():
        before = before.replace("{" + key + "}", value)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"right({quoted(before)} || {text} || {quoted(after)}, 400)"


RAW = "with r as (select doc_id, source, text, case when doc_id % 3 = 1 then '<title>' || source || '</title>' || chr(10) || '<content>' || text || '</content>' when doc_id % 3 = 2 then 'plain ' || text end as raw from documents where doc_id % 3 > 0)"
MODES = f"""{RAW}
select doc_id, md5(case when doc_id % 3 = 1 then raw else {_said("tagged", "raw")} end) as tagged, md5(case when doc_id % 3 = 1 then {_said("json", "raw", schema=json.dumps({"title": "string"}, indent=2))} end) as json, null::varchar as no_schema,
  md5(case when doc_id % 3 = 1 then {_said("enrichment", "raw")} end) as enrichment, null::varchar as unknown from r"""


def translations(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("that the of "), "source").alias("title"), F.col("text").alias("content"))
    return formatting.translated(docs).select("doc_id", "title", F.md5("content").alias("content_md5"))


TRANSLATIONS = rf"""
with d as (select doc_id, text, source, coalesce({language_sql("text")} = 'en', false) as english from documents)
select doc_id, {STRIP.format(_said("translate", "'that the of ' || source"))} as title, md5(case when english then {STRIP.format(_said("translate", "text"))} else text end) as content_md5 from d"""


def loads(spark, sf_dir):
    rows = formatting.loaded(_raw(spark, sf_dir))
    return rows.select("doc_id", "loaded_from", "record.record_id", "record.title", F.md5("record.content").alias("content_md5"))


LOADS = rf"""
with d as (select doc_id, source, case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then {STRIP.format("text")} end as content from documents)
select doc_id, case doc_id % 3 when 0 then 'json' when 1 then 'tagged' end as loaded_from, 'REC_' || translate(left(base64(unhex(sha256(case when content is not null then source || '|' || content end))), 10), '+/', '-_') as record_id,
  case when content is not null then source end as title, md5(content) as content_md5 from d"""


def before(spark, sf_dir):
    """Documents as they come: tagged ones are prepared, every seventh lacks a title and is left out."""
    docs = _raw(spark, sf_dir).select(F.col("doc_id").cast("string").alias("record_id"), F.when(F.col("doc_id") % 7 > 0, F.col("source")).alias("title"), F.col("raw").alias("content"))
    return formatting.preprocessed(docs, "tagged", requirements=()).select("source_id", "record_id", "title", F.md5("content").alias("content_md5"))


BEFORE = rf"""
with d as (select doc_id, source, {STRIP.format("text")} as content from documents where doc_id % 3 = 1 and doc_id % 7 > 0)
select doc_id::varchar as source_id, 'REC_' || translate(left(base64(unhex(sha256(source || '|' || content))), 10), '+/', '-_') as record_id, source as title, md5(content) as content_md5 from d"""


def enrichments(spark, sf_dir):
    """Articles whose text holds the labelled lines that the default generator repeats."""
    n = F.col("doc_id")
    text = F.concat(F.lit("Article 1. Main Topic: "), "source", F.lit("\nGenerated Title: T "), n.cast("string"), F.lit("\nAssigned Categories: a, "), "lang", F.lit("\nArticle 2. "), F.when(n % 2 == 0, "Main Topic: x").otherwise("none"))
    return formatting.enriched(_table(spark, sf_dir, "documents").select(n.cast("string").alias("document_id"), text.alias("text"), F.col("lang").alias("category"))).select("document_id", "chunk_id", "main_topic", "generated_title", F.array_join("categories", "|").alias("categories"), "category")


ENRICHMENTS = "select doc_id::varchar as document_id, doc_id || '.1' as chunk_id, source as main_topic, 'T ' || doc_id as generated_title, 'a|' || lang as categories, lang as category from documents"


def linked(spark, sf_dir):
    """Documents that cite one of the catalog's, and others; German so that none is translated."""
    n = F.col("doc_id")
    content = F.concat(F.lit("der die und Theo Nghị định "), n % 90 + 1, F.lit("/"), n % 7 + 2015, F.lit(" "), "lang")
    docs = _table(spark, sf_dir, "documents").select(n.cast("string").alias("record_id"), F.when(n % 4 > 0, F.lit("der die")).otherwise("").alias("title"), F.when(n % 2 == 0, content).otherwise("der die und").alias("content"), F.lit("own").alias("document_id"), F.lit("s").alias("source"))
    return formatting.postprocessed(docs, _catalog(spark, sf_dir)).select("record_id", "document_id", "source", "valid")


LINKED = CATALOG + """, d as (select doc_id, 'Nghị định ' || (doc_id % 90 + 1) || '/' || (doc_id % 7 + 2015) as mention, (doc_id % 7 + 2015)::varchar as year from documents where doc_id % 2 = 0),
s as (select doc_id, document_id, position, case when contains(lower(full_name), lower(mention)) then 0.7 else 0 end + case when year = issue_year then 0.3 else 0 end as score from d, catalog),
b as (select doc_id, arg_min(position, (-score, position)) as position from s where score > 0 group by 1)
select documents.doc_id::varchar as record_id, coalesce('D' || position, 'own') as document_id, coalesce('f' || position, 's') as source, documents.doc_id % 4 > 0 as valid from documents left join b using (doc_id)"""


# --- answers


def _turns(spark, sf_dir):
    """The first question of each conversation with all its turns as hits."""
    c = _table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    first = c.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query_text"))
    return c.join(first, "conv_id").select(F.col("conv_id").alias("query_id"), "query_text", F.col("text").alias("content"), F.col("turn").alias("rank"), F.col("turn").alias("record_id"))


TURNS = """with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations), q as (select conv_id, arg_min(text, turn) as query_text from c where role = 'user' group by 1),
t as (select conv_id as query_id, query_text, text as content, turn as rank from c join q using (conv_id)),
w as (select *, list_distinct(list_filter(regexp_split_to_array(lower(query_text), '\\s+'), lambda x: x <> '')) as a, list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '') as b, greatest({length} - len(list_filter(regexp_split_to_array(query_text, '\\s+'), lambda x: x <> '')), 1) as room from t where content <> ''),
p as (select *, unnest(range(1, greatest(len(b), 1) + 1, room)) as pos from w),
s as (select query_id, rank, max(1 / (1 + exp(-(len(list_intersect(a, list_transform(b[pos:pos + room - 1], lambda x: lower(x))))::double / greatest(len(a), 1) * 8 - 4)))) as score from p group by 1, 2)
select query_id, rank, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 12) desc, rank) as position from s""".replace("\\\\", "\\")


def reranked(method):
    def run(spark, sf_dir):
        found = S.reranked_by(_turns(spark, sf_dir), method)
        return found.select("query_id", "rank", F.round("score", 6).alias("score"), F.col("position").cast("bigint").alias("position"))

    return run


def by_answers(spark, sf_dir):
    found = S.reranked_by_answers(_turns(spark, sf_dir), lambda p: F.concat(F.lit("Score "), (F.length(p) % 12).cast("string"), F.lit(".")))
    return found.select("query_id", "rank", "score", F.col("position").cast("bigint").alias("position"))


BY_ANSWERS = """with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations), q as (select conv_id, arg_min(text, turn) as query_text from c where role = 'user' group by 1),
t as (select conv_id as query_id, turn as rank, length('Grade from 1 (unrelated) to 10 (answers it) how well the text fits the question. Question: ' || query_text || chr(10) || 'Text: ' || text || chr(10) || 'Grade:') % 12 as n from c join q using (conv_id)),
s as (select query_id, rank, case when n between 1 and 10 then n else 5 end::int as score from t)
select query_id, rank, score, row_number() over (partition by query_id order by score desc, rank) as position from s"""


def intentions(spark, sf_dir):
    """Questions that hold the answer which the default generator repeats; the last with no object."""
    n = F.col("doc_id") % 4
    told = F.when(n == 0, F.concat(F.lit('{"irrelevant": "'), "source", F.lit('"}'))).when(n == 1, F.concat(F.lit('{"x": 1, "history": "'), "lang", F.lit('"}'))).when(n == 2, '{"rag": null}').otherwise("nothing {")
    docs = _table(spark, sf_dir, "documents").withColumn("_i", providers.detected_intention(F.concat(F.lit("ask "), told), F.array("source")))
    return docs.select("doc_id", "_i.intention", "_i.response")


INTENTIONS = "select doc_id, ['irrelevant', 'history', 'rag', 'rag'][doc_id % 4 + 1] as intention, case doc_id % 4 when 0 then source when 1 then lang end as response from documents"


def conversed(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    messages = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    asked = F.element_at("m", 1)["content"]
    return rows.select("conv_id", F.md5(providers.converse(messages)).alias("answer_md5"), F.md5(providers.paraphrased(F.coalesce(asked, F.lit("")))).alias("paraphrase_md5"))


CONVERSED = rf"""select conv_id, md5(right(coalesce(arg_max(coalesce(text, ''), turn), ''), 400)) as answer_md5,
  md5({STRIP.format("right('Viết lại câu hỏi sau đây sử dụng ngôn ngữ, thuật ngữ pháp lý:' || chr(10) || chr(10) || arg_min(coalesce(text, ''), turn), 400)")}) as paraphrase_md5 from conversations group by 1"""


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(texts: list[str], dim: int = len(LETTERS)) -> list[list[float]]:
    """How often a text holds each of the first `dim` letters: vectors that SQL can make too."""
    return [[float(t.count(c)) for c in LETTERS[:dim]] for t in texts]


providers.register("embedder", "letters", letter_counts)


def _lettered():
    return providers.local_embedder({"model_name": "letters", "cache_dir": "", "vector_dimension": len(LETTERS)})


def letters_sql(text: str) -> str:
    return f"list_transform(string_split('{' '.join(LETTERS)}', ' '), lambda c: (length({text}) - length(replace({text}, c, '')))::double)"


def requests(spark, sf_dir):
    """Documents' lines as requests, every third for a single text, with their vectors."""
    asked = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("texts"), (F.col("doc_id") % 3 > 0).alias("is_batch"))
    return providers.embed_request(asked, _lettered()).select("request_id", "status", F.transform("embeddings", lambda v: F.concat_ws(",", F.transform(v, lambda x: x.cast("int").cast("string")))).alias("_v")).select("request_id", "status", F.array_join("_v", ";").alias("embeddings"))


REQUESTS = rf"""
with l as (select doc_id, doc_id % 3 > 0 as batch, case when doc_id % 5 > 0 then list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: {STRIP.format("x")}), lambda x: x <> '') else [] end as x from documents),
n as (select *, coalesce(len(x), 0) = 0 or (not batch and len(x) <> 1) as bad from l)
select doc_id as request_id, case when bad then 400 else 200 end::int as status,
  case when not bad then array_to_string(list_transform(x, lambda t: array_to_string(list_transform({letters_sql("t")}, lambda v: v::int::varchar), ',')), ';') end as embeddings from n"""


def uploaded(spark, sf_dir):
    """Every third document is stored and indexed; all are offered. Near duplicates have all but equal counts of letters."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.col("text").alias("content"), "doc_id")
    points = stored(providers.embedded(docs.filter("doc_id % 3 = 0"), "content", _lettered()), "points")
    path = scratch_path(spark, "index")
    passing(spark, path)
    return uploads.upload(docs, points, _lettered(), index=V.build(points, path))[1]


UPLOADED = f"""
with v as (select doc_id, {letters_sql("text")} as v from documents),
near as (select n.doc_id from v n, v p where n.doc_id % 3 > 0 and p.doc_id % 3 = 0 group by 1 having max(case when list_sum(n.v) > 0 and list_sum(p.v) > 0 then round(list_cosine_similarity(n.v, p.v), 5) else 0 end) >= 0.999)
select count(*) as total, count_if(doc_id % 3 = 0) as known, count_if(doc_id in (select doc_id from near)) as near_duplicate, count_if(doc_id % 3 > 0 and doc_id not in (select doc_id from near)) as uploaded from documents"""


def splitters(spark, sf_dir):
    """Documents' lines as clauses by all semantic splitters; vectors of the embeddings table in turn."""
    e = _table(spark, sf_dir, "embeddings")
    clauses = e.select((F.col("vec_id") % 50).alias("doc_id"), F.floor(F.col("vec_id") / 50).cast("int").alias("ord"), F.repeat(F.lit("w "), (F.col("vec_id") % 37).cast("int")).alias("content"), "embedding")
    parts = [C.split_by(clauses, name).select(F.lit(name).alias("method"), "doc_id", "ord", F.col("chunk").cast("bigint").alias("chunk")) for name in sorted(C.SPLITTERS) if name != "semantic_double_merge_chunking"]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


SPLITTERS = """
with c as (select vec_id % 50 as doc_id, (vec_id // 50)::int as ord, embedding::double[] as e from embeddings),
n as (select doc_id, ord, 1 - list_cosine_similarity(e, lag(e) over w) as far, list_cosine_similarity(e, lag(e) over w) as n1, list_cosine_similarity(e, lag(e, 2) over w) as n2, list_cosine_similarity(e, lag(e, 3) over w) as n3 from c window w as (partition by doc_id order by ord)),
l as (select doc_id, quantile_cont(far, 0.95) as most from n group by 1),
b as (select 'semantic_chunking' as method, doc_id, ord, sum(coalesce((far > most)::int, 0)) over (partition by doc_id order by ord)::bigint as chunk from n join l using (doc_id)),
t as (select 'topic_node_parser' as method, doc_id, ord, sum(case when ord = 0 then 0 else (greatest(coalesce(n1, -1), coalesce(n2, -1), coalesce(n3, -1)) < 0.8)::int end) over (partition by doc_id order by ord)::bigint as chunk from n)
select * from b union all select * from t
"""


def cited(spark, sf_dir):
    """All citations, those without year or issuer among them, which go by the likeness of names."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("nghị định "), F.col("doc_id") % 90 + 1, F.lit("/"), F.col("doc_id") % 7 + 2015, F.lit("/NĐ-CP bộ tài chính về thuế  và Bộ luật "), F.col("doc_id") % 50 + 1, F.lit(" và khác")).alias("text"))
    found = M.search(docs, _catalog(spark, sf_dir), 2, 0.2)
    return found.select("id", "mention", "document_id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


CITED = cited_sql(0.2)


QUERIES = {
    "D2_law_documents": (law_documents, LAW_DOCUMENTS), "D3_structured_json": (structured, STRUCTURED_JSON), "D4_simplified": (simple, SIMPLE), "D5_flat_appendix": (flat_appendices, COMPACT),
    "S10_roman_sections": (roman, ROMAN), "S11_whole_files": (whole_files, WHOLE_FILES), "S12_section_in_files": (in_files, IN_FILES), "FR1_format_modes": (modes, MODES),
    "FR2_translation": (translations, TRANSLATIONS), "FR3_load_fallbacks": (loads, LOADS), "FR4_preprocess": (before, BEFORE), "FR5_enrichment": (enrichments, ENRICHMENTS), "FR6_postprocess": (linked, LINKED),
    "RR1_flashrank": (reranked("flashrank"), TURNS.format(length=1_000_000_000)), "RR2_crossencoder": (reranked("crossencoder"), TURNS.format(length=256)), "RR3_relevance_answers": (by_answers, BY_ANSWERS),
    "G5_intentions": (intentions, INTENTIONS), "G7_conversations": (conversed, CONVERSED), "E1_embed_requests": (requests, REQUESTS), "K14_upload": (uploaded, UPLOADED), "C6_splitters": (splitters, SPLITTERS),
    "M8_citation_search": (cited, CITED),
}
