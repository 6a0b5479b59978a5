"""Queries over structure and chunking, each with its SQL twin. Legal texts are composed from documents' lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lawframe.functions import text as T
from lawframe.operators import chunk as C
from lawframe.operators import structure as S
from lawframe.operators import trees


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _law(spark, sf_dir):
    """Each line of a document as a chapter, an article, a clause, a point or text, by its number."""
    i = lambda n: (n + 1).cast("string")

    def line(x, n):
        word = F.concat(F.lit("zz "), x)
        return (
            F.when(n % 11 == 0, F.concat(F.lit("Chương "), i(n), F.lit(". "), word)).when(n % 5 == 1, F.concat(F.lit("Điều "), i(n), F.lit(" - "), word))
            .when(n % 3 == 2, F.concat(i(n), F.lit(") "), word)).when(n % 7 == 3, F.concat(F.lit("d. "), word)).otherwise(word)
        )

    return _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


LAW = r"""
with recursive raw as (select doc_id::varchar as doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord from documents),
law as (select doc_id, ord, regexp_replace('zz ' || x, '\s+$', '') as word,
  case when ord % 11 = 0 then 'chapter' when ord % 5 = 1 then 'article' when ord % 3 = 2 then 'clause' when ord % 7 = 3 then 'point' end as marker from raw),
kinds as (select doc_id, list_filter(['chapter', 'article', 'clause', 'point'], lambda m: list_contains(list(marker), m)) as markers from law group by 1),
lines as (select l.*, list_position(markers, marker)::int as level, case marker when 'chapter' then 'ch' || (ord + 1) when 'article' then 'art' || lpad((ord + 1)::varchar, greatest(3, length((ord + 1)::varchar))::int, '0')
    when 'clause' then 'cl_' || lpad((ord + 1)::varchar, greatest(2, length((ord + 1)::varchar))::int, '0') when 'point' then 'pt_d' end as part,
  case marker when 'chapter' then 'Chương ' || (ord + 1) when 'article' then 'Điều ' || (ord + 1) when 'clause' then (ord + 1)::varchar when 'point' then 'd' end as header,
  count(marker) over (partition by l.doc_id order by ord) as section from law l join kinds using (doc_id)),
bodies as (select doc_id, section, coalesce(string_agg(word, chr(10) order by ord) filter (marker is null), '') as content from lines where section > 0 group by all),
anc as (select *,
  last_value(case when level = 1 then ord end ignore nulls) over w as o1, last_value(case when level = 1 then part end ignore nulls) over w as p1,
  last_value(case when level = 2 then ord end ignore nulls) over w as o2, last_value(case when level = 2 then part end ignore nulls) over w as p2,
  last_value(case when level = 3 then ord end ignore nulls) over w as o3, last_value(case when level = 3 then part end ignore nulls) over w as p3,
  last_value(case when level < 2 then ord end ignore nulls) over w as b2, last_value(case when level < 3 then ord end ignore nulls) over w as b3
  from lines where marker is not null window w as (partition by doc_id order by ord rows between unbounded preceding and 1 preceding)),
sec as (select a.doc_id, marker, level, ord::int as ord, header, word as title, content,
  concat_ws('_', a.doc_id, case when level > 1 and o1 is not null then p1 end, case when level > 2 and o2 > coalesce(b2, -1) then p2 end, case when level > 3 and o3 > coalesce(b3, -1) then p3 end) as parent_id, part,
  coalesce(case when level > 3 and o3 > coalesce(b3, -1) then o3 end, case when level > 2 and o2 > coalesce(b2, -1) then o2 end, case when level > 1 then o1 end)::int as parent_ord
  from anc a join bodies b on a.doc_id = b.doc_id and a.section = b.section),
sections as (select *, parent_id || '_' || part as section_id from sec)
"""


def hierarchy(spark, sf_dir):
    return S.sections(_law(spark, sf_dir)).select("doc_id", "section_id", "parent_id", "marker", "level", "ord", "header", "title", "content")


HIERARCHY = LAW + "select doc_id, section_id, parent_id, marker, level, ord, header, title, content from sections"


def markers(spark, sf_dir):
    return S.detected(_law(spark, sf_dir)).select("doc_id", F.array_join("markers", ",").alias("markers"))


MARKERS = LAW + "select doc_id, array_to_string(markers, ',') as markers from kinds"


def lookup(spark, sf_dir):
    found = S.sections(_law(spark, sf_dir))
    wanted = found.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.concat("doc_id", F.lit("_ch1_art002")), F.lit("pt_d"), F.lit("none"))).alias("wanted"))
    return S.find_section(found, wanted).select("doc_id", "wanted", "section_id")


LOOKUP = LAW + """, w as (select distinct doc_id, unnest([doc_id || '_ch1_art002', 'pt_d', 'none']) as wanted from sections),
r as (select w.doc_id, wanted, section_id, row_number() over (partition by w.doc_id, wanted order by section_id <> wanted, ord) as n from w join sections s on w.doc_id = s.doc_id and (section_id = wanted or ends_with(section_id, '_' || wanted)))
select doc_id, wanted, section_id from r where n = 1"""


def rebuilt(spark, sf_dir):
    return S.reconstructed(S.sections(_law(spark, sf_dir))).select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("length"))


REBUILT = LAW + r""", t as (select doc_id, string_agg(concat(repeat('    ', d), header, chr(10), case when title <> '' then repeat('    ', d) || title || chr(10) else '' end, case when content <> '' then repeat('    ', d) || content || chr(10) else '' end), '' order by ord) as text
  from (select *, len(regexp_extract_all(section_id, '_(art|ch|cl_|pt_)'))::int - 1 as d from sections) group by 1)
select doc_id, md5(text) as text_md5, length(text)::int as length from t"""


def cleaned(spark, sf_dir):
    """Parents whose content repeats their children's: two levels, composed."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.left("source", F.lit(4)).alias("s"))
    parent = docs.select("doc_id", F.lit("p").alias("section_id"), F.lit("").alias("parent_id"), F.lit(None).cast("int").alias("parent_ord"), F.lit(1).alias("level"), F.lit(0).alias("ord"), F.lit("").alias("title"), F.concat(F.lit("own "), "s", F.lit(" child text")).alias("content"))
    child = docs.select("doc_id", F.lit("p_c").alias("section_id"), F.lit("p").alias("parent_id"), F.lit(0).alias("parent_ord"), F.lit(2).alias("level"), F.lit(1).alias("ord"), F.col("s").alias("title"), F.lit("child text").alias("content"))
    return S.cleaned(parent.unionByName(child)).select("doc_id", "section_id", "content")


CLEANED = "select doc_id::varchar as doc_id, unnest(['p', 'p_c']) as section_id, unnest(['own', 'child text']) as content from documents"


def segmented(spark, sf_dir):
    """Appendix headings behind every fourth line, with the phrase that makes them count for even documents only."""
    n = F.col("doc_id") % 2
    head = F.concat(F.lit("\nPhụ lục "), F.lit("I\n"), F.when(n == 0, "Ban hành kèm theo").otherwise("khác"), F.lit("\n"))
    docs = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("main "), "source", head, F.col("lang"), head, F.lit("end")).alias("text"))
    return S.segments(docs)


SEGMENTED = r"""
with t as (select doc_id, source, lang, doc_id % 2 = 0 as cut from documents)
select doc_id, unnest([1, 2, 3])::int as doc_number, unnest(['main ' || source, 'Ban hành kèm theo' || chr(10) || lang, 'Ban hành kèm theo' || chr(10) || 'end']) as content from t where cut
union all
select doc_id, 1::int, 'main ' || source || chr(10) || 'Phụ lục I' || chr(10) || 'khác' || chr(10) || lang || chr(10) || 'Phụ lục I' || chr(10) || 'khác' || chr(10) || 'end' from t where not cut
"""


def form_spans(spark, sf_dir):
    lines = F.concat(F.lit("x\nMẫu số 1\n"), F.upper("source"), F.lit("\nbody\nMẫu số 2\nplain\nBan hành kèm\nmẫu  số 3\n"), F.col("lang"))
    return S.forms(_docs(spark, sf_dir).select("doc_id", lines.alias("text"))).select("doc_id", "form_id", "first", "last")


FORM_SPANS = "select doc_id, unnest(['form_01', 'form_02']) as form_id, unnest([1, 7])::int as first, unnest([7, 9])::int as last from documents"


def appendix(spark, sf_dir):
    lines = F.concat(F.lit("x\nMẫu số 1\n"), F.upper("source"), F.lit("\nbody"))
    return S.appendix_sections(_docs(spark, sf_dir).select("doc_id", lines.alias("text")))


APPENDIX = """select doc_id, unnest(['Appendix Content', 'form_01']) as section, unnest(['x', 'Mẫu số 1' || chr(10) || upper(source) || chr(10) || 'body']) as content from documents"""


FOLD = r"""
with recursive parts as (select doc_id, unnest(p) as part, generate_subscripts(p, 1) as ord from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as p from documents)),
w as (select *, len(list_filter(regexp_split_to_array(part, '\s+'), lambda x: x <> ''))::int as words from parts),
fold as (select doc_id, ord, words as total, 1 as n, 0 as chunk from w where ord = 1
  union all select w.doc_id, w.ord, case when total + words > {words} or n >= {parts} then words else total + words end, case when total + words > {words} or n >= {parts} then 1 else n + 1 end,
    chunk + (total + words > {words} or n >= {parts})::int from fold f join w on w.doc_id = f.doc_id and w.ord = f.ord + 1)
select doc_id, chunk, sum(words)::int as n_words, md5(string_agg(part, chr(10) || chr(10) order by ord)) as content_md5 from fold join w using (doc_id, ord) group by doc_id, chunk
"""


def _chunks(spark, sf_dir, words, parts=None):
    return C.packed(_docs(spark, sf_dir), words, parts, "\n").select("doc_id", "chunk", "n_words", F.md5("content").alias("content_md5"))


def chunk_300(spark, sf_dir):
    return _chunks(spark, sf_dir, 300)


def chunk_600(spark, sf_dir):
    return _chunks(spark, sf_dir, 600, 8)


def cohesion(spark, sf_dir):
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    clauses = points.select((F.col("vec_id") % 50).alias("doc_id"), F.floor(F.col("vec_id") / 50).cast("int").alias("ord"), F.repeat(F.lit("w "), (F.col("vec_id") % 37).cast("int")).alias("content"), "embedding")
    return C.cohesive(clauses, 60, 0.0).select("doc_id", "ord", "chunk")


COHESION = """
with recursive c as (select vec_id % 50 as doc_id, (vec_id // 50)::int as ord, (vec_id % 37)::int as words, embedding::double[] as e from embeddings),
s as (select *, coalesce(list_cosine_similarity(e, lag(e) over (partition by doc_id order by ord)), 1.0) as near from c),
f as (select doc_id, ord, words as total, 0 as chunk from s where ord = 0
  union all select s.doc_id, s.ord, case when total + words > 60 or near < 0 then words else total + words end, chunk + (total + words > 60 or near < 0)::int from f join s on s.doc_id = f.doc_id and s.ord = f.ord + 1)
select doc_id, ord, chunk from f
"""


def articles(spark, sf_dir):
    text = F.concat(F.lit("Article 1. "), "source", F.lit("\nArticle 2 "), "lang", F.lit(" Article 3,  "))
    return C.split_articles(_docs(spark, sf_dir).select("doc_id", text.alias("text"))).select("doc_id", "chunk_id", "content")


ARTICLES = "select doc_id, unnest([doc_id || '.1', doc_id || '.2']) as chunk_id, unnest([source, lang]) as content from documents"


def windows(spark, sf_dir):
    return C.token_windows(_docs(spark, sf_dir), 128, 20).select("doc_id", "window", F.md5("content").alias("content_md5"))


WINDOWS = r"""
with t as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents),
s as (select doc_id, w, unnest(range(1, greatest(len(w) - 20, 1) + 1, 108)) as pos from t where len(w) > 0)
select doc_id, ((pos - 1) // 108)::int as "window", md5(array_to_string(w[pos:pos + 127], ' ')) as content_md5 from s
"""


def records(spark, sf_dir):
    """Records of chapters, articles, clauses and points with what they inherit."""
    from lawframe.operators.records import section_records

    found = S.sections(_law(spark, sf_dir))
    return section_records(found).select("document_id", "chunk_id", "record_id", "title", "content", "hierarchy_level")


RECORDS = LAW + """, x as (select s.*, p.marker as m1, nullif(p.title, '') as t1, nullif(p.content, '') as c1, nullif(g.title, '') as t2, nullif(g.content, '') as c2,
    exists (select 1 from sections k where k.doc_id = s.doc_id and k.parent_ord = s.ord) as has
  from sections s left join sections p on s.doc_id = p.doc_id and s.parent_ord = p.ord left join sections g on p.doc_id = g.doc_id and p.parent_ord = g.ord),
filled as (select doc_id, section_id, marker, has,
  coalesce(nullif(title, ''), case when marker in ('clause', 'point') and m1 is not null then coalesce(t1, case when m1 in ('clause', 'point') then coalesce(t2, c2) else c1 end) else nullif(content, '') end, '') as title,
  coalesce(nullif(content, ''), case when marker in ('clause', 'point') then coalesce(c1, case when m1 in ('clause', 'point') then c2 end) end, '') as content from x)
select doc_id as document_id, section_id as chunk_id,
  'DOC_' || translate(left(base64(unhex(sha256(title || '|' || case when has and marker in ('chapter', 'article') then title else content end))), 10), '+/', '-_') as record_id, title, content,
  case marker when 'chapter' then 1 when 'article' then 2 when 'clause' then 3 else 4 end::int as hierarchy_level from filled"""


def deep_trees(spark, sf_dir):
    """Forty documents make a tree, each below the one before it or the one before that: up to 27 levels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    place = F.col("doc_id") % 40
    nodes = docs.select(
        F.floor(F.col("doc_id") / 40).alias("tree"), F.col("doc_id").alias("ord"), F.when(place > 0, F.col("doc_id") - F.when((place % 3 == 2), 2).otherwise(1)).alias("parent_ord"),
        F.concat(F.lit("N"), F.col("doc_id")).alias("header"), F.concat("lang", F.lit(" "), F.col("n")).alias("title"),
    )
    line = F.concat(F.repeat(F.lit("    "), F.size("path") - 1), F.array_join(F.reverse("labels"), ", "), F.lit(": "), F.col("title"), F.lit("\n"))
    opened = F.concat(F.lit('{"header":"'), F.col("header"), F.lit('","title":"'), F.col("title"), F.lit('"'))
    made = trees.in_order(trees.paths(nodes, "tree", "header"), "tree", line=line, opened=opened)
    return made.select("tree", F.size("depths").cast("bigint").alias("nodes"), F.array_max("depths").cast("bigint").alias("depth"), F.md5(F.array_join("line", "")).alias("text_md5"), F.md5(trees.nested(F.col("opened"), F.col("depths"))).alias("json_md5"))


DEEP_TREES = """
with recursive nodes as (
  select doc_id // 40 as tree, doc_id as ord, case when doc_id % 40 > 0 then doc_id - case when doc_id % 40 % 3 = 2 then 2 else 1 end end as parent_ord,
    'N' || doc_id as header, coalesce(lang, '') || ' ' || length(coalesce(text, '')) as title
  from documents),
walk as (
  select n.*, [n.ord] as path, n.header as names from nodes n where not exists (from nodes p where p.tree = n.tree and p.ord = n.parent_ord)
  union all
  select n.*, list_append(w.path, n.ord), n.header || ', ' || w.names from nodes n join walk w on n.tree = w.tree and n.parent_ord = w.ord),
steps as (
  select *, len(path) as depth, lag(len(path)) over (partition by tree order by path) as before from walk)
select tree, count(*) as nodes, max(depth) as depth, md5(string_agg(repeat('    ', depth - 1) || names || ': ' || title || chr(10), '' order by path)) as text_md5,
  md5('[' || string_agg(case when before is null then '' when before >= depth then repeat(']}', before - depth + 1) || ',' else '' end
    || '{"header":"' || header || '","title":"' || title || '"' || ',"subsections":[', '' order by path) || repeat(']}', arg_max(depth, path)) || ']') as json_md5
from steps group by tree
"""

QUERIES = {
    "S13_deep_trees": (deep_trees, DEEP_TREES),
    "S1_segment_boundaries": (segmented, SEGMENTED),
    "S2_hierarchy_ids": (hierarchy, HIERARCHY),
    "S2_detect_markers": (markers, MARKERS),
    "S3_section_lookup_fallback": (lookup, LOOKUP),
    "S4_reconstruct": (rebuilt, REBUILT),
    "S5_clean_redundant": (cleaned, CLEANED),
    "S6_form_spans": (form_spans, FORM_SPANS),
    "S7_appendix_sections": (appendix, APPENDIX),
    "C1_chunk_300": (chunk_300, FOLD.format(words=300, parts=1_000_000_000)),
    "C2_chunk_600_8": (chunk_600, FOLD.format(words=600, parts=8)),
    "C3_chunk_cohesion": (cohesion, COHESION),
    "C4_split_articles": (articles, ARTICLES),
    "C5_token_windows": (windows, WINDOWS),
    "D1_records_from_tree": (records, RECORDS),
}
