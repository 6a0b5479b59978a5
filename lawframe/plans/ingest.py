"""From raw texts to validated records: structure, records, chunks and routing by text type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawframe.functions import text as T
from lawframe.operators import chunk as C
from lawframe.operators import records as R
from lawframe.operators import structure as S
from lawframe.scratch import stored


MARK = "\x01"


def law_documents(files: DataFrame, first_two: bool = False) -> DataFrame:
    """(path, text) to (path, doc_number, doc_id, doc_name, content): texts sanitised and cut into a main document and
    its appendices. The main one is named by the number in it, or its file; appendices by that and their own number.
    With `first_two` an appendix is called by its first two lines."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    parts = S.segments(files.select(F.col("path").alias("doc_id"), T.sanitize(F.col("text")).alias("text"))).withColumnRenamed("doc_id", "path")
    named = F.coalesce(F.nullif(T.document_number(F.col("content")), F.lit("")), stem)
    main = F.max(F.when(F.col("doc_number") == 1, named)).over(Window.partitionBy("path"))
    first = F.col("doc_number") == 1
    names = T.main_name(F.col("content")) if first_two else T.appendix_name(F.col("content"))
    return parts.filter("path is not null").withColumn("main_id", main).select(
        "path", "doc_number", F.when(first, F.col("main_id")).otherwise(F.format_string("%s_appendix_%02d", "main_id", "doc_number")).alias("doc_id"),
        F.when(first, T.main_name(F.col("content"))).otherwise(names).alias("doc_name"), "content",
    )


def law_units(documents: DataFrame) -> DataFrame:
    """(path, doc_number, doc_id, unit, unit_id, header, content, text): what is parsed on its own. A main document is one
    unit; an appendix its forms, and one of what they don't cover, parsed from the whole text."""
    key = F.concat("path", F.lit(MARK), "doc_id")
    main = documents.filter("doc_number = 1").select("path", "doc_number", "doc_id", F.lit(0).alias("unit"), F.col("doc_id").alias("unit_id"), F.lit("").alias("header"), F.col("content").alias("whole"), F.col("content").alias("text"))
    others = documents.filter("doc_number > 1").select("path", "doc_number", "doc_id", F.col("content").alias("all"), key.alias("_key"))
    cut = S.appendix_sections(others.select(F.col("_key").alias("doc_id"), F.col("all").alias("text"))).withColumnRenamed("doc_id", "_key")
    form = F.col("section") != "Appendix Content"
    pieces = others.join(cut, "_key").select(
        "path", "doc_number", "doc_id", F.when(form, F.regexp_extract("section", r"(\d+)$", 1).try_cast("int")).otherwise(1_000_000).alias("unit"),
        F.when(form, F.concat_ws("_", "doc_id", "section")).otherwise(F.col("doc_id")).alias("unit_id"), F.when(form, F.concat(F.lit("Form "), "section")).otherwise(F.col("section")).alias("header"),
        F.col("content").alias("whole"), F.when(form, F.col("content")).otherwise(F.col("all")).alias("text"),
    )
    return main.unionByName(pieces).withColumnRenamed("whole", "content")


def law_sections(units: DataFrame, order: tuple = S.ORDER) -> DataFrame:
    """SECTION rows of units with their path, doc_number and unit: parsed, empty contents filled, repeats cleaned."""
    key = F.concat("path", F.lit(MARK), "unit_id")
    found = S.cleaned(S.promoted(S.sections(units.select(key.alias("doc_id"), "text"), order)), len(order))
    own = units.select(key.alias("_key"), "path", "doc_number", "unit", "unit_id")
    bare = lambda c: F.regexp_replace(c, f"^[^{MARK}]*{MARK}", "")
    rows = found.join(own, found.doc_id == own._key).drop("_key")
    return rows.withColumns({"doc_id": bare("doc_id"), "section_id": bare("section_id"), "parent_id": bare("parent_id")})


def structured_json(files: DataFrame) -> DataFrame:
    """(path, json): {doc_filename, documents: [{doc_number, doc_id, doc_name, articles}]} of each file, trees of sections
    in it. A unit without markers is one section of its text; forms and the rest of an appendix are sections of theirs."""
    documents = stored(law_documents(files), "documents")
    units = stored(law_units(documents), "units")
    key = F.concat("path", F.lit(MARK), "unit_id")
    found = law_sections(units).withColumn("doc_id", F.concat("path", F.lit(MARK), "unit_id"))
    trees = S.tree_json(found).withColumnRenamed("doc_id", "_key")
    rows = units.withColumn("_key", key).join(trees, "_key", "left").withColumn("json", F.coalesce("json", F.lit("[]")))
    plain = F.to_json(F.struct(F.lit("").alias("header"), F.lit("").alias("title"), "content", F.array().cast("array<string>").alias("subsections")))
    head = F.to_json(F.struct(F.col("unit_id").alias("id"), "header", F.lit("").alias("title"), "content"))
    own = F.concat(F.expr("left(_head, length(_head) - 1)"), F.lit(',"subsections":'), "json", F.lit("}"))
    inner = F.expr("substring(json, 2, length(json) - 2)")
    shown = F.when(F.col("doc_number") > 1, own).when(F.col("json") == "[]", plain).otherwise(inner)
    listed = rows.withColumn("_head", head).groupBy("path", "doc_number").agg(F.array_sort(F.collect_list(F.struct("unit", shown.alias("json")))).alias("units"))
    articles = F.concat(F.lit('"articles":['), F.array_join(F.transform("units", lambda u: u["json"]), ","), F.lit("]}"))
    named = documents.drop("content").join(listed, ["path", "doc_number"]).withColumn("_head", F.to_json(F.struct("doc_number", "doc_id", "doc_name")))
    each = named.select("path", "doc_number", F.concat(F.expr("left(_head, length(_head) - 1)"), F.lit(","), articles).alias("json"))
    whole = each.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("doc_number", "json"))).alias("documents"))
    name = F.to_json(F.struct(F.element_at(F.split("path", "/"), -1).alias("doc_filename")))
    return whole.withColumn("_name", name).select("path", F.concat(F.expr("left(_name, length(_name) - 1)"), F.lit(',"documents":['), F.array_join(F.transform("documents", lambda d: d["json"]), ","), F.lit("]}")).alias("json"))


def write_mirrored(rows: DataFrame, base: str, target: str) -> DataFrame:
    """(path, json) of files below `base` with `target_path`, the same place below `target`; as a source of one file each
    for a `foreachPartition` of the caller's storage."""
    return rows.withColumn("target_path", F.concat(F.lit(target.rstrip("/")), F.substr("path", F.length(F.lit(base.rstrip("/"))) + 1), F.lit(".json")))


def simplified(found: DataFrame, most_words: int = 600, clause_words: int = 300, least: float = 0.6, embed=None) -> DataFrame:
    """(doc_id, chapter_id, chapter_header, chapter_title, article_id, part, header, title, content): articles of main
    documents with up to `most_words` words whole, longer ones as runs of clauses that hang together.

    First-level sections without anything below them are left out, and so is text of a longer article that stands before
    its clauses. An article without a title is called by its content; headers name the section and those above it.

    All of it is windows and groups within documents, so sections that lie by document are not shuffled again. `embed` is
    asked for a clause's text, and for null where an article stays whole.
    """
    rows, trimmed = S.compact_pieces(found), lambda c: F.trim(F.col(c))
    depth, at = F.size("up"), lambda i: F.coalesce(F.get("up", F.lit(i)), F.when(F.size("up") == i, F.col("ord")))
    chapter = F.struct(F.col("section_id").alias("id"), trimmed("header").alias("header"), trimmed("title").alias("title"))
    by_ord = Window.partitionBy("doc_id").orderBy("ord")
    rows = rows.withColumn("chapter", F.last(F.when(depth == 0, chapter), True).over(by_ord)).withColumns({"article": at(1), "clause": at(2)}).filter(depth > 0)
    own = F.struct("section_id", trimmed("header").alias("header"), F.coalesce(F.nullif(trimmed("title"), F.lit("")), trimmed("content")).alias("title"))
    head = F.first(F.when(F.col("ord") == F.coalesce("clause", "article"), own), True).alias("own")
    texts = rows.groupBy("doc_id", "article", "clause").agg(F.first("chapter").alias("chapter"), head, S._joined("ord", F.col("piece")).alias("text"))
    listed = texts.groupBy("doc_id", "article").agg(F.first("chapter").alias("chapter"), F.array_sort(F.collect_list(F.struct(F.coalesce("clause", "article").alias("ord"), "own", "text"))).alias("rows"))
    # the article's own row comes first
    articles = listed.select(
        "doc_id", "article", "chapter", F.get("rows", F.lit(0))["own"].alias("own"), F.slice("rows", F.lit(2), F.size("rows")).alias("clauses"),
        F.array_join(F.transform("rows", lambda r: r["text"]), "").alias("text"),
    ).withColumn("header", F.trim(F.concat_ws(" ", "own.header", "chapter.header"))).withColumn("long", T.count_words(F.col("text")) > most_words)
    clauses = F.transform("clauses", lambda c: F.struct(c["ord"].alias("ord"), F.trim(F.concat_ws(" ", c["own"]["header"], F.col("header"))).alias("header"), c["text"].alias("content")))
    whole = F.array(F.struct(F.col("article").alias("ord"), F.col("header"), F.col("text").alias("content")))
    parts = articles.select("doc_id", "article", "chapter", "own.section_id", "own.title", "long", F.explode(F.when(F.col("long"), clauses).otherwise(whole)).alias("c")).select("*", "c.*").drop("c")
    parts = parts.withColumn("embedding", (embed or default_embed)(F.when(F.col("long"), F.col("content"))))
    dealt = C.cohesive(parts, clause_words, least, ("doc_id", "article"))
    runs = dealt.groupBy("doc_id", "article", F.col("chunk").alias("part")).agg(
        F.first("chapter").alias("chapter"), F.first("section_id").alias("article_id"), F.first("title").alias("title"), F.min_by("header", "ord").alias("header"), S._joined("ord", F.col("content"), " ").alias("content"),
    )
    return runs.select("doc_id", F.col("chapter.id").alias("chapter_id"), F.col("chapter.header").alias("chapter_header"), F.col("chapter.title").alias("chapter_title"), "article_id", "part", "header", "title", "content")


def default_embed(text):
    from lawframe.plans.providers import embed

    return embed(text)


def flat_appendices(found: DataFrame) -> DataFrame:
    """(doc_id, content) of appendices' sections: tables flattened to rows, everything in one text with its headers."""
    flat = F.when(F.col("content").contains("<tr"), T.flatten_table(F.col("content"))).otherwise(F.col("content"))
    return S.reconstructed(found.withColumn("content", flat), full=True, compact=True).withColumnRenamed("text", "content")


def law_records(files: DataFrame, first_two: bool = False) -> DataFrame:
    """(path, text) of law texts to records: sections of main documents, and each appendix as one."""
    documents = stored(law_documents(files, first_two), "documents")
    main = R.section_records(law_sections(law_units(documents.filter("doc_number = 1"))), by=("path", "doc_id"))
    name = F.regexp_replace("doc_id", r"_appendix_\d+$", "")
    rest = R.appendix_records(documents.filter("doc_number > 1").select(name.alias("document_id"), F.col("doc_id").alias("appendix_id"), "doc_name", "content"))
    return main.unionByName(rest)


def routed(raw: DataFrame) -> DataFrame:
    """(raw) to records by text type: JSON records, tagged records, and plain texts packed into chunks."""
    typed = raw.withColumn("text_type", T.text_type(F.col("raw")))
    made = F.from_json("raw", "record_id string, title string, content string")
    as_json = typed.filter("text_type = 'json'").select(made.alias("r")).filter("r.title is not null and r.content is not null")
    json_rows = as_json.select(F.coalesce("r.record_id", T.unique_id(F.col("r.title"), F.col("r.content"), "REC")).alias("record_id"), "r.title", "r.content")
    tagged = typed.filter("text_type = 'tagged'").select(T.tagged_record(F.col("raw")).alias("r")).filter("r is not null").select("r.record_id", "r.title", "r.content")
    plain = typed.filter("text_type = 'unformatted'").select(F.md5("raw").alias("doc_id"), F.col("raw").alias("text"))
    chunks = C.packed(plain).select(T.unique_id(F.col("doc_id"), F.col("content"), "TXT").alias("record_id"), F.concat("doc_id", F.lit("."), F.col("chunk") + 1).alias("title"), "content")
    return json_rows.unionByName(tagged).unionByName(chunks)


def repaired_budget(chunks: DataFrame, most_requests: int = 30, most_tokens: int = 20_000) -> DataFrame:
    """Chunks (ord, content) with their token estimate and the number of the one-minute window that budgets let them in."""
    estimate = (T.count_words(F.col("content")) * 1.3).cast("int") + 2048
    listed = chunks.withColumn("tokens", estimate).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "tokens"))).alias("rows"))
    start = F.struct(F.lit(0).alias("window"), F.lit(0).alias("requests"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("windows"))

    def step(s, r):
        full = (s["requests"] >= most_requests) | (s["used"] + r["tokens"] > most_tokens)
        window = F.when(full & (s["requests"] > 0), s["window"] + 1).otherwise(s["window"])
        return F.struct(window.alias("window"), F.when(full, 1).otherwise(s["requests"] + 1).alias("requests"), F.when(full, r["tokens"]).otherwise(s["used"] + r["tokens"]).alias("used"), F.array_append(s["windows"], window).alias("windows"))

    folded = listed.withColumn("windows", F.aggregate("rows", start, step, lambda s: s["windows"]))
    return folded.select("doc_id", F.explode(F.arrays_zip("rows", "windows")).alias("z")).select("doc_id", "z.rows.ord", "z.rows.tokens", F.col("z.windows").alias("window"))
