"""Text operators as column expressions. Every function takes and returns columns; none runs Python on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = r"^\s+|\s+$"


def strip(x: Column) -> Column:
    """Without white space at either end (Spark's trim takes spaces alone)."""
    return F.regexp_replace(x, EDGE, "")


def lines_of(x: Column) -> Column:
    return F.transform(F.split(x, "\n"), strip)


def sanitize(x: Column) -> Column:
    """Backslashes doubled, then quotes of both kinds escaped."""
    doubled = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit('"'), F.lit('\\"')), F.lit("'"), F.lit("\\'"))


def remove_tables(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)<table>.*?</table>", "")


def flatten_table(x: Column) -> Column:
    """Cells of each table row joined by ' | ', rows by line feeds; text outside of rows is lost."""
    rows = F.regexp_extract_all(x, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))

    def row(r: Column) -> Column:
        cells = F.regexp_extract_all(r, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1))
        return F.array_join(F.transform(cells, lambda c: strip(F.regexp_replace(c, r"<[^>]*>", ""))), " | ")

    return F.array_join(F.transform(rows, row), "\n")


def flatten_appendix(x: Column) -> Column:
    return strip(flatten_table(x))


def reconstruct_table(x: Column, indent: int = 0) -> Column:
    """Tagged table lines (one tag or cell a line) to rows 'a | b'; other lines as they are; a blank line ends a table."""
    pad = " " * 4 * indent
    state = F.struct(F.lit("").alias("out"), F.array().cast("array<string>").alias("cells"))

    def step(s: Column, line: Column) -> Column:
        cell = line.startswith("<td>") & line.endswith("</td>")
        ends = line == "</tr>"
        out = (
            F.when(line == "</table>", F.concat(s["out"], F.lit("\n")))
            .when(line.isin("<table>", "<tr>") | cell, s["out"])
            .when(ends, F.concat(s["out"], F.lit(pad), F.array_join(s["cells"], " | "), F.lit("\n")))
            .otherwise(F.concat(s["out"], F.lit(pad), line, F.lit("\n")))
        )
        inner = strip(F.substr(line, F.lit(5), F.greatest(F.length(line) - 9, F.lit(0))))
        cells = F.when(cell, F.array_append(s["cells"], inner)).when((line == "<tr>") | ends, F.array().cast("array<string>")).otherwise(s["cells"])
        return F.struct(out.alias("out"), cells.alias("cells"))

    return F.aggregate(lines_of(x), state, step, lambda s: s["out"])


def count_words(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda t: t != ""))


def unique_id(title: Column, content: Column, prefix: str) -> Column:
    """PREFIX_ and ten characters of the url-safe base64 of sha-256 over 'title|content'."""
    digest = F.unhex(F.sha2(F.concat(title, F.lit("|"), content), 256))
    return F.concat(F.lit(prefix + "_"), F.translate(F.substring(F.base64(digest), 1, 10), "+/", "-_"))


def unique_hex_id(title: Column, content: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.upper(F.left(F.sha2(F.concat(title, content), 256), F.lit(8))))


def cache_key(x: Column) -> Column:
    return F.md5(F.lower(strip(x)))


def mask_key(x: Column) -> Column:
    return F.when(x.isNull(), "***").when(F.length(x) <= 4, "invalid").otherwise(F.concat(F.lit("***"), F.right(x, F.lit(4))))


def json_value(x: Column) -> Column:
    """The VARIANT of a text that is JSON as a whole, else null.

    try_parse_json is content with a value at a text's begin, whatever follows. As an element before another one and as
    an object's member at once only a whole value is taken: what closes the array early is an error in the object."""
    value = F.try_parse_json(x)
    element = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), x, F.lit(",0]"))), "$", "array<variant>")
    member = F.try_parse_json(F.concat(F.lit('{"a":'), x, F.lit("}")))
    return F.when(value.isNotNull() & (F.size(element) == 2) & member.isNotNull(), value)


def text_type(x: Column) -> Column:
    """json (anything that parses, numbers and quoted strings too), tagged (a title and a content element), unformatted."""
    tagged = x.rlike(r"(?s)<title>.*?</title>") & x.rlike(r"(?s)<content>.*?</content>")
    return F.when(json_value(x).isNotNull(), "json").when(tagged, "tagged").otherwise("unformatted")


def document_number(x: Column) -> Column:
    """The first number behind 'Số' or 'Luật số' in the first 30 lines, cells unwrapped, table tags skipped."""
    first = F.filter(F.slice(lines_of(x), 1, 30), lambda s: ~s.isin("<table>", "</table>", "<tr>", "</tr>"))
    bare = F.transform(first, lambda s: F.when(s.startswith("<td>") & s.endswith("</td>"), strip(F.regexp_replace(s, "^<td>|</td>$", ""))).otherwise(s))
    hits = F.filter(F.transform(bare, lambda s: F.regexp_extract(s, r"(?U)(?:Số|Luật số)[:\s]*([^\s,;]+)", 1)), lambda m: m != "")
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(""))


def main_name(x: Column) -> Column:
    """The first two lines that are not blank, outside of tables."""
    return F.array_join(F.slice(F.filter(lines_of(remove_tables(x)), lambda s: s != ""), 1, 2), " ")


# Phrases that never name an appendix.
BOILERPLATE = (
    "cộng hòa xã hội chủ nghĩa việt nam",
    "độc lập - tự do - hạnh phúc",
    "ban hành kèm",
    r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    r"ngày\s+\d{1,2}.*?năm\s+\d{4}",
    r"năm\s+\d{4}",
    r"\d{1,2}\s*[/-]\s*\d{1,2}\s*[/-]\s*\d{4}",
)


def is_upper(x: Column) -> Column:
    return (F.upper(x) == x) & (F.lower(x) != x)


def appendix_name(x: Column) -> Column:
    """The first line in capitals of over three characters, with the next line unless that is in capitals too."""
    plain = F.regexp_replace(remove_tables(x), "(?iu)" + "|".join(BOILERPLATE), "")
    found = F.filter(lines_of(plain), lambda s: s != "")
    at = F.array_position(F.transform(found, lambda s: is_upper(s) & (F.length(s) > 3)), F.lit(True)).cast("int")
    following = F.get(found, at)
    named = F.concat_ws(" ", F.get(found, at - 1), F.when(~is_upper(following), following))
    return F.when(at > 0, named).otherwise(F.array_join(F.slice(found, 1, 2), " "))


def source_of(chunk_id: Column) -> Column:
    """'khoản n, Điều n, điểm x văn bản BASE' as far as the id names them."""

    def part(pattern: str, word: str, number: bool) -> Column:
        m = F.regexp_extract(chunk_id, pattern, 1)
        shown = m.cast("decimal(38,0)").cast("string") if number else m
        return F.when(m != "", F.concat(F.lit(word + " "), F.when(m != "", shown)))

    parts = F.array_compact(F.array(part(r"(?i)cl_(\d+)", "khoản", True), part(r"(?i)art(\d+)", "Điều", True), part(r"(?iU)pt_(\w+)", "điểm", False)))
    base = F.concat(F.lit("văn bản "), F.substring_index(chunk_id, "_", 1))
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, ", "), F.lit(" "), base)).otherwise(base)


def backfilled_source(source: Column, chunk_id: Column) -> Column:
    return F.coalesce(F.nullif(source, F.lit("")), source_of(chunk_id))


def hierarchy_level(kind: Column, parent: Column, appendix_level: int = 5) -> Column:
    found = F.when(kind == "chapter", 1).when(kind == "article", 2).when(kind == "clause", 3).when(kind == "point", 4)
    return found.when(kind == "appendix", appendix_level).otherwise(parent + 1)


def issue_year(mention: Column) -> Column:
    return F.nullif(F.regexp_extract(mention, r"/(\d{4})", 1), F.lit(""))


# The kinds of documents that citations name.
KINDS = "Luật|Bộ luật|Pháp lệnh|Nghị định|Thông tư(?: liên tịch)?|Nghị quyết|Quyết định"
CITATION = rf"(?:{KINDS}) \d{{1,3}}/\d{{4}}(?:/[\w\-]+)?"


def positional_issue_year(mention: Column) -> Column:
    """The first year that has a full citation starting to its left."""
    return F.nullif(F.regexp_extract(mention, rf"(?sU)(?:{KINDS}) \d{{1,3}}/(\d{{4}})", 1), F.lit(""))


# The labels of an enrichment answer's lines.
ENRICHMENT = ("Main Topic", "Applicability", "Generated Title", "Assigned Categories")


def enrichment(response: Column) -> Column:
    """struct<main_topic, applicability, generated_title, categories>; the last line with a label counts."""

    def last(label: str) -> Column:
        return strip(F.coalesce(F.try_element_at(F.regexp_extract_all(response, F.lit(f"(?m)^{label}:(.*)$"), F.lit(1)), F.lit(-1)), F.lit("")))

    topic, scope, title, categories = map(last, ENRICHMENT)
    return F.struct(topic.alias("main_topic"), scope.alias("applicability"), title.alias("generated_title"), F.transform(F.split(categories, ","), strip).alias("categories"))


def keywords(response: Column, k: int) -> Column:
    """The list in the first {...} of an answer; without braces the answer's first k words."""
    body = F.regexp_extract(response, r"(?s)\{(.*?)\}", 0)
    listed = F.from_json(body, "keywords ARRAY<STRING>")["keywords"]
    words = F.slice(F.regexp_extract_all(response, F.lit(r"(?U)\b\w+\b"), F.lit(0)), 1, k)
    return F.when(body == "", words).otherwise(F.slice(F.coalesce(listed, F.array().cast("array<string>")), 1, k))


def relevance(response: Column) -> Column:
    """The first whole number from 1 to 10 that stands alone; 5 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(response, r"\b([1-9]|10)\b", 1), F.lit("")).try_cast("int"), F.lit(5))


def intention(response: Column) -> Column:
    """irrelevant, history or rag, from the object between the first and the last brace; rag if there is none."""
    parsed = F.try_parse_json(F.regexp_extract(response, r"(?s)\{.*\}", 0))
    says = lambda key: F.try_variant_get(parsed, f"$.{key}", "boolean")
    return F.when(says("irrelevant"), "irrelevant").when(says("history"), "history").otherwise("rag")


def tagged_record(raw: Column) -> Column:
    """struct<record_id, title, published_date, categories, content>; null without a well-formed title."""

    def element(name: str) -> Column:
        return F.nullif(F.regexp_extract(raw, rf"(?s)<{name}>(.*?)</{name}>", 1), F.lit(""))

    listed = F.coalesce(element("categories"), F.lit(""))
    made = F.struct(
        F.nullif(F.regexp_extract(raw, r"<id=([^>]*)>", 1), F.lit("")).alias("record_id"),
        strip(element("title")).alias("title"),
        strip(element("published_date")).alias("published_date"),
        F.regexp_extract_all(listed, F.lit(r"<([^<>/]+)>"), F.lit(1)).alias("categories"),
        strip(F.coalesce(element("content"), F.lit(""))).alias("content"),
    )
    return F.when(element("title").isNotNull(), made)


def tagged_blocks(content: Column) -> Column:
    """Each <id=...> ... </id=...> block of a file, closing tags made to match the opening ones."""
    blocks = F.regexp_extract_all(content, F.lit(r"(?s)<id=[^>]*>.*?</id=[^>]*>"), F.lit(0))
    return F.transform(blocks, lambda b: F.regexp_replace(b, r"(?s)^(<id=)([^>]*)(>.*)</id=[^>]*>$", "$1$2$3</id=$2>"))


def citation_suffix(hits: Column) -> Column:
    """'\\n\\nReferences: [Record ID: x], ...' over hits (array<struct<record_id, content>>) that have content."""
    cited = F.transform(F.filter(hits, lambda h: F.coalesce(h["content"], F.lit("")) != ""), lambda h: F.concat(F.lit("[Record ID: "), h["record_id"], F.lit("]")))
    return F.when(F.size(cited) > 0, F.concat(F.lit("\n\nReferences: "), F.array_join(cited, ", "))).otherwise("")


def has_citation(answer: Column) -> Column:
    return answer.rlike(r"\[[A-Za-z0-9][A-Za-z0-9_/.\-]*\d[A-Za-z0-9_/.\-]*\]")


def encode_typed(value: Column) -> Column:
    """A JSON text as {type: value} with types S, N, BOOL, L, M and NULL."""
    parsed = json_value(value)
    kind = F.schema_of_variant(parsed)
    tag = (
        F.when(kind == "STRING", "S").when(kind == "BOOLEAN", "BOOL").when(kind.startswith("ARRAY"), "L")
        .when(kind.startswith("OBJECT"), "M").when(kind == "VOID", "NULL").otherwise("N")
    )
    return F.when(parsed.isNotNull(), F.struct(tag.alias("type"), F.when(kind == "STRING", F.try_variant_get(parsed, "$", "string")).otherwise(F.to_json(parsed)).alias("value")))


def decode_number(text: Column) -> Column:
    """struct<whole, fraction>: numbers with a dot are fractions, others whole."""
    return F.struct(F.when(~text.contains("."), text.try_cast("bigint")).alias("whole"), F.when(text.contains("."), text.try_cast("double")).alias("fraction"))


def matches_any(content: Column, words: list[str]) -> Column:
    """Whether a text holds any of the words, whatever the case."""
    return F.exists(F.array(*map(F.lit, words)), lambda k: F.lower(content).contains(F.lower(k)))


def validation_errors(required: dict[str, str]) -> Column:
    """array<string>: names of required columns that are null or, for texts, blank."""
    missing = [F.when(F.col(c).isNull() | ((F.trim(F.col(c).cast("string")) == "") if kind == "string" else F.lit(False)), F.lit(c)) for c, kind in required.items()]
    return F.array_compact(F.array(*missing))
