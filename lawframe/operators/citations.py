"""Citations of legal documents: extraction from texts and matching against a catalog.

Catalog rows: document_id, full_name, document_type, document_number, issue_year (a string), issuer_body, filename, position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawframe.functions.text import CITATION, KINDS, issue_year, strip
from lawframe.operators.tfidf import STOP_WORDS, pair_similarity
from lawframe.scratch import small, stored

# Issuing bodies and their abbreviations.
ISSUERS = {
    "bộ công thương": "bct", "bộ nội vụ": "bnv", "bộ giáo dục": "bgddt", "bộ tài chính": "btc", "bộ quốc phòng": "bqp",
    "bộ công an": "bca", "bộ y tế": "byt", "bộ thông tin": "btttt", "bộ ngoại giao": "bng", "bộ tư pháp": "btp",
    "bộ kế hoạch": "bkhdt", "bộ nông nghiệp": "bnnptnt", "bộ giao thông": "bgtvt", "bộ xây dựng": "bxd",
    "bộ tài nguyên": "btnmt", "bộ lao động": "bldtbxh", "bộ văn hóa": "bvhttdl", "bộ khoa học": "bkhcn",
    "ngân hàng nhà nước": "nhnn",
}
# Kinds of statute that stand for one another.
STATUTES = ("luật", "bộ luật", "pháp lệnh")
PROPERTY_WEIGHTS = {"document_type": 0.2, "document_number": 0.3, "issue_year": 0.3, "issuer_body": 0.2}
RELIABILITY = {"document_type": 0.8, "document_number": 0.9, "issue_year": 0.7, "issuer_body": 0.8, "extra_info": 0.6}
CONFIDENT = 0.7
STRUCTURED = rf"(?iUs)^({KINDS})(?:\s+(\d{{1,3}}))?(?:/(\d{{4}}))?(?:/([\w\-]+))?(?:\s+(.+))?"


def mentions(text: Column) -> Column:
    """array<string>, sorted: citations in full, and ids within the five words behind a statute's name."""
    full = F.regexp_extract_all(text, F.lit("(?U)" + CITATION), F.lit(0))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def near(w: Column, i: Column) -> Column:
        # of the kinds only this one is a single word, so only it equals one
        reach = F.when(w == "Luật", 5).otherwise(0)
        found = F.regexp_extract(F.array_join(F.slice(words, i + 2, reach), " "), r"\d{1,3}/\d{4}(?:/[A-Za-z\-]+)?", 0)
        return F.when((reach > 0) & (found != ""), F.concat(w, F.lit(" "), found))

    return F.array_sort(F.array_distinct(F.concat(full, F.array_compact(F.transform(words, near)))))


def structured_mentions(text: Column) -> Column:
    """array<struct<mention, document_type, document_number, issue_year, issuer_body, extra_info>>: one a segment between
    conjunctions, if it opens with a kind of document."""
    segments = F.filter(F.transform(F.split(text, r"(?iU)\s+và\s+"), strip), lambda s: s.rlike(rf"(?iU)^(?:{KINDS})"))

    def parse(s: Column) -> Column:
        kind, number, year, suffix, extra = (strip(F.regexp_extract(s, STRUCTURED, i)) for i in range(1, 6))
        bodies = F.array(*[F.struct(F.lit(k).alias("body"), F.lit(v).alias("short")) for k, v in ISSUERS.items()])
        start = F.struct(extra.alias("extra"), F.lit("").alias("issuer"))

        def take(acc: Column, b: Column) -> Column:
            hit = F.lower(acc["extra"]).contains(b["body"])
            return F.struct(F.when(hit, strip(F.replace(acc["extra"], b["body"], F.lit("")))).otherwise(acc["extra"]).alias("extra"), F.when(hit, b["short"]).otherwise(acc["issuer"]).alias("issuer"))

        left = F.aggregate(bodies, start, take)
        name = F.concat(F.upper(F.left(kind, F.lit(1))), F.lower(F.substr(kind, F.lit(2))))
        piece = lambda mark, x: F.when(x != "", F.concat(F.lit(mark), x)).otherwise("")
        return F.struct(
            F.concat(name, piece(" ", number), piece("/", year), piece("/", suffix), piece(" ", left["extra"])).alias("mention"), F.lower(kind).alias("document_type"),
            number.alias("document_number"), year.alias("issue_year"), left["issuer"].alias("issuer_body"), left["extra"].alias("extra_info"),
        )

    return F.transform(segments, parse)


# The kinds of document that the walk knows, longest first.
WALKED_KINDS = ("bộ luật", "pháp lệnh", "nghị định", "thông tư", "nghị quyết", "quyết định", "luật")
#: Words behind a kind that belong to a mention, unless another kind comes first.
REACH = 6
_KIND = "(?:" + "|".join(WALKED_KINDS) + r")(?!\S)"
_WALK = rf"(?iU)(?<!\S){_KIND}(?: (?!{_KIND})\S+){{0,{REACH}}}"


def walked_sql(text: str) -> str:
    """SQL of array<struct<MENTION fields>> for the text column `text`: in each sentence the longest kind of document at
    a word, with the words behind it up to the next kind, six at most. The year is the first word that starts with a
    number of four digits. A sentence ends behind a mark and blank, or with its line; null texts give null."""
    words = r"trim(regexp_replace(s, r'(?U)\s+', ' '))"
    kind = f"regexp_extract(m, r'(?iU)^{_KIND}', 0)"
    year = r"regexp_extract(m, r'(?U)(?<!\S)\d{4}\b\S*', 0)"
    rest = "trim(substr(f.m, length(f.kind) + 1))"
    mention = (
        f"named_struct('mention', f.m, 'document_type', lower(f.kind), 'document_number', '', 'issue_year', f.year, 'issuer_body', '', "
        f"'extra_info', if(f.year = '', {rest}, trim(replace({rest}, f.year, ''))))"
    )
    found = rf"flatten(transform(split({text}, r'(?U)(?<=[.!?])\s+|\n'), s -> regexp_extract_all({words}, r'{_WALK}', 0)))"
    return f"transform(transform({found}, m -> named_struct('m', m, 'kind', {kind}, 'year', {year})), f -> {mention})"


def walk(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, MENTION fields), a row a mention that the walk over words finds."""
    return docs.select("doc_id", F.explode(F.expr(walked_sql("text"))).alias("m")).select("doc_id", "m.*")


def best_match(mentioned: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, document_id, filename, score) of rows (id, mention): 0.7 if the name holds the mention, 0.3 if the year is
    equal; the best of all mentions, the earliest in the catalog of equals.

    A name that holds a mention holds its number/year, so that is the join key; for the year alone the earliest row of
    each year is enough.

    Each mention is matched once, however many rows have it: what follows joins its best row alone.
    """
    ids = r"\d{1,3}/\d{4}"
    mentioned = stored(mentioned.select("id", "mention"), "cited")
    m = stored(mentioned.select("mention").distinct(), "mentions")
    m = m.select("mention", issue_year(F.col("mention")).alias("year"), F.regexp_extract("mention", ids, 0).alias("key"))
    named = catalog.withColumn("key", F.explode(F.array_distinct(F.regexp_extract_all("full_name", F.lit(ids), F.lit(0)))))
    held = m.join(named, "key").filter(F.lower("full_name").contains(F.lower("mention"))).select("mention", "document_id", "filename", "position", F.when(F.col("year") == F.col("issue_year"), 1.0).otherwise(0.7).alias("score"))
    first = catalog.groupBy(F.col("issue_year").alias("year")).agg(F.min_by(F.struct("document_id", "filename", "position"), "position").alias("c"))
    dated = m.join(first, "year").select("mention", "c.document_id", "c.filename", "c.position", F.lit(0.3).alias("score"))
    order = F.desc("score"), "mention", "position"
    own = held.unionByName(dated).withColumn("_n", F.row_number().over(Window.partitionBy("mention").orderBy(*order))).filter("_n = 1").drop("_n")
    found = mentioned.join(small(stored(own, "best")), "mention")
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter("_n = 1").select("id", "document_id", "filename", "score")


def _class(kind: Column) -> Column:
    return F.when(F.lower(kind).isin(*STATUTES), "statute").otherwise(F.lower(kind))


def _agreeing(mentioned: DataFrame, catalog: DataFrame, properties: tuple) -> DataFrame:
    """Mentions (id + MENTION) joined to catalog rows that agree in every property that a mention has; null is none.

    One equi-join: which properties are present is part of the key, and a catalog row stands once for each choice of its
    own properties, so that mentions never meet by kind alone where more is known.
    """
    present = lambda p: F.coalesce(F.col(p), F.lit("")) != ""
    pattern = sum((F.when(present(p), 1 << i).otherwise(0) for i, p in enumerate(properties)), F.lit(0))
    asked = mentioned.withColumns({"_class": _class(F.col("document_type")), "_pattern": pattern, **{f"_{p}": F.lower(F.coalesce(p, F.lit(""))) for p in properties}})
    c = catalog.select("document_id", "full_name", "position", F.col("issue_year").alias("c_issue_year"), _class(F.col("document_type")).alias("_class"), *(F.lower(F.coalesce(p, F.lit(""))).alias(f"_own_{p}") for p in properties))
    chosen = lambda i: F.col("_pattern").bitwiseAND(1 << i) != 0
    c = c.withColumn("_pattern", F.explode(F.sequence(F.lit(0), F.lit((1 << len(properties)) - 1))))
    for i, p in enumerate(properties):
        c = c.filter(~chosen(i) | (F.col(f"_own_{p}") != "")).withColumn(f"_{p}", F.when(chosen(i), F.col(f"_own_{p}")).otherwise(""))
    keys = ["_class", "_pattern", *(f"_{p}" for p in properties)]
    return asked.join(c.drop(*(f"_own_{p}" for p in properties)), keys).drop(*keys)


#: What a mention says of a document.
FIELDS = ("mention", "document_type", "document_number", "issue_year", "issuer_body", "extra_info")


def _each_once(mentioned: DataFrame, match, order: tuple, top_n: int) -> DataFrame:
    """What `match` finds for each distinct mention, which it gets as (id, MENTION), joined to all rows that have it; the
    first `top_n` of each id and mention by `order`, `rank` from 1. Texts cite the same documents again and again."""
    mentioned = stored(mentioned.select("id", F.struct(*FIELDS).alias("_said")), "mentions")
    found = stored(match(mentioned.select("_said").distinct().select(F.col("_said").alias("id"), "_said.*")), "matched")
    rows = mentioned.join(small(found.drop("mention").withColumnRenamed("id", "_said")), "_said").withColumn("mention", F.col("_said.mention"))
    by = Window.partitionBy("id", "mention").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top_n)


def weighted_match(mentioned: DataFrame, catalog: DataFrame, top_n: int = 2, cutoff: float = 0.75) -> DataFrame:
    """(id, mention, document_id, full_name, score, rank). Where the present properties weigh at least 0.7 and rows agree
    in all of them, the latest of these; else the candidates of that kind, number and issuer by TF-IDF. Each distinct
    mention is matched once."""
    order = F.desc("_sure"), F.desc("_by"), F.desc("_year"), F.col("position")
    found = _each_once(mentioned, lambda distinct: _weighted(distinct, catalog, top_n, cutoff), order, top_n)
    best = F.max("_sure").over(Window.partitionBy("id", "mention"))
    return found.withColumn("_best", best).filter("_sure = _best").select("id", "mention", "document_id", "full_name", "score", "rank")


def _weighted(mentioned: DataFrame, catalog: DataFrame, top_n: int, cutoff: float) -> DataFrame:
    """`weighted_match` with what its rows are ordered by: _sure, _by (year or similarity), _year, position."""
    mentioned = stored(mentioned, "mentions")
    weight = sum((F.when(F.col(p) != "", w).otherwise(0.0) for p, w in PROPERTY_WEIGHTS.items()), F.lit(0.0))
    scored = mentioned.withColumn("confidence", F.round(weight, 6))
    sure = _agreeing(scored.filter(F.col("confidence") >= CONFIDENT), catalog, ("document_number", "issue_year", "issuer_body"))
    year = F.col("c_issue_year").try_cast("int").cast("double")
    latest = Window.partitionBy("id").orderBy(year.desc(), "position")
    kept = sure.withColumn("rank", F.row_number().over(latest)).filter(F.col("rank") <= top_n)
    kept = stored(kept.select("id", "mention", "document_id", "full_name", F.col("confidence").alias("score"), F.lit(1).alias("_sure"), year.alias("_by"), F.lit(None).cast("string").alias("_year"), "position"), "kept")
    rest = mentioned.join(kept.select("id").distinct(), "id", "left_anti")
    query = F.when(F.col("extra_info") != "", F.lower(F.trim(F.concat_ws(" ", "document_type", "document_number", "extra_info")))).otherwise(F.lower("mention"))
    cands = _agreeing(rest, catalog, ("document_number", "issuer_body")).select(F.col("id").alias("group_id"), query.alias("query"), F.col("position").alias("cand_id"), F.col("full_name").alias("cand"), "document_id", "c_issue_year")
    cands = stored(cands, "candidates")
    near = pair_similarity(cands.select("group_id", "query", "cand_id", "cand")).filter(F.col("similarity") >= cutoff)
    by = Window.partitionBy("group_id").orderBy(F.round("similarity", 9).desc(), F.desc("c_issue_year"), "cand_id")
    fallback = near.join(cands, ["group_id", "cand_id"]).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top_n)
    return kept.unionByName(
        fallback.select(
            F.col("group_id").alias("id"), "group_id.mention", "document_id", F.col("cand").alias("full_name"), F.col("similarity").alias("score"),
            F.lit(0).alias("_sure"), F.round("similarity", 9).alias("_by"), F.col("c_issue_year").alias("_year"), F.col("cand_id").alias("position"),
        )
    )


def dynamic_match(mentioned: DataFrame, catalog: DataFrame, top_n: int = 2, cutoff: float = 0.5) -> DataFrame:
    """(id, mention, document_id, score, rank): present properties weigh by reliability, made to sum to one; rows must
    agree in all; extra words add their weight times the TF-IDF similarity of the two texts. Each distinct mention is
    matched once."""
    order = F.round("score", 9).desc(), F.col("position")
    found = _each_once(mentioned, lambda distinct: _dynamic(distinct, catalog, top_n, cutoff, order), order, top_n)
    return found.select("id", "mention", "document_id", "score", "rank")


def _dynamic(mentioned: DataFrame, catalog: DataFrame, top_n: int, cutoff: float, order: tuple) -> DataFrame:
    mentioned = stored(mentioned, "mentions")
    total = sum((F.when(F.col(p) != "", w).otherwise(0.0) for p, w in RELIABILITY.items()), F.lit(0.0))
    share = lambda p: F.when(F.col(p) != "", RELIABILITY[p]).otherwise(0.0) / F.nullif(F.col("total"), F.lit(0.0))
    rows = _agreeing(mentioned.withColumn("total", total), catalog, ("document_number", "issue_year", "issuer_body"))
    base = rows.withColumn("base", sum((share(p) for p in PROPERTY_WEIGHTS), F.lit(0.0))).withColumn("extra_weight", share("extra_info")).withColumnRenamed("id", "group_id")
    base = stored(base, "agreeing")
    extra = base.filter("extra_info <> ''").select("group_id", F.lower("extra_info").alias("query"), F.col("position").alias("cand_id"), F.lower("full_name").alias("cand"))
    near = pair_similarity(extra, True, STOP_WORDS).withColumnRenamed("cand_id", "position")
    scored = base.join(near, ["group_id", "position"], "left").withColumn("score", F.col("base") + F.col("extra_weight") * F.coalesce("similarity", F.lit(0.0)))
    best = Window.partitionBy("group_id").orderBy(*order)
    return scored.filter(F.col("score") >= cutoff).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_n).select(F.col("group_id").alias("id"), "mention", "document_id", "score", "position")


def partial_names(catalog: DataFrame) -> DataFrame:
    """(document_type, issue_year, full_name): the full names that a kind and year may stand for, a row each, so that
    mentions of the two join them and no list of a year's documents is ever held."""
    return catalog.select("document_type", "issue_year", "full_name")


def link_documents(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """Records (record_id, content, ...) with document_id and source of the best match of their citations, if any."""
    cited = records.select(F.col("record_id").alias("id"), F.explode(mentions(F.col("content"))).alias("mention"))
    best = best_match(cited, catalog).select(F.col("id").alias("record_id"), F.col("document_id").alias("_id"), F.col("filename").alias("_file"))
    joined = records.join(best, "record_id", "left")
    return joined.withColumn("document_id", F.coalesce("_id", "document_id")).withColumn("source", F.coalesce("_file", "source")).drop("_id", "_file")


def search(questions: DataFrame, catalog: DataFrame, top_n: int = 2, cutoff: float = 0.75) -> DataFrame:
    """(id, mention, document_id, full_name, score, rank) of questions (id, text): every citation in a question with the
    documents that it may stand for."""
    found = questions.select("id", F.explode(structured_mentions(F.col("text"))).alias("m")).select("id", "m.*")
    return weighted_match(found, catalog, top_n, cutoff)


def is_statute(full_name: Column) -> Column:
    """Whether a document's name opens with a kind of statute."""
    return F.coalesce(full_name.rlike("(?iU)^(" + "|".join(STATUTES) + ")"), F.lit(False))
