"""Structure of legal texts: segments, hierarchy markers, section ids, reconstruction, cleanup and forms.

Texts are exploded to lines and everything is windows over (document, line number), so a corpus is one plan. A document's
lines go to one task each time; documents are the unit of skew, not the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawframe.functions.text import is_upper, remove_tables, strip
from lawframe.operators import trees
from lawframe.scratch import small, stored

# Marker patterns by level. Group 1 is the marker, 2 its value, 3 what follows on the line.
MARKERS = {
    "roman_chapter": r"(?iU)^\s*(([IVXLCDM]{2,}|[IVXLCDM]\b))\s*[-.]?\s*(.+)$",
    "chapter": r"(?iU)^\s*(Chương\s+(\w+))(?:\s*[-.]?\s*(.*))?$",
    "article": r"(?iU)^\s*(Điều\s+(\d+))(?:\s*[-.]?\s*(.*))?$",
    "clause": r"^\s*((\d+))\s*[-.)]?(?:\s+(.+))?$",
    "point": r"(?U)^\s*(([^\W\d_]))\s*[-.)]?(?:\s+(.+))?$",
}
ORDER = ("chapter", "article", "clause", "point")
#: With parts that a Roman numeral alone marks; any letter of one counts, so points may open parts.
ROMAN_ORDER = ("chapter", "roman_chapter", "article", "clause", "point")
# How the variant names the headers of its sections.
NAMES = {"chapter": "Chương", "roman_chapter": "Phần", "article": "Điều", "clause": "Khoản", "point": "Điểm"}


def exploded(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, ord, line), lines stripped."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")).withColumn("line", strip(F.col("line")))


def _by(*order, partition: str = "doc_id"):
    return Window.partitionBy(partition).orderBy(*(order or ("ord",)))


def _before(*order):
    return _by(*order).rowsBetween(Window.unboundedPreceding, -1)


def _squeezed(line: Column) -> Column:
    return F.replace(F.lower(line), F.lit(" "), F.lit(""))


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_number, content): the main document and its appendices; a boundary line belongs to neither.

    A line opening with the appendix word scores 40; ten more if one of the next three lines, and ten if one of the
    three before, holds a phrase that goes with it. 50 makes a boundary.
    """
    lines, w, text = exploded(docs), _by(), _squeezed(F.col("line"))
    # Phrases around an appendix heading.
    after = [F.lead(text, i).over(w) for i in (1, 2, 3)]
    ahead = [F.lag(text, i).over(w) for i in (1, 2, 3)]
    holds = lambda xs, a, b: F.greatest(*(F.coalesce(x.contains(a) | x.contains(b), F.lit(False)).cast("int") for x in xs))
    opens = F.col("line").rlike(r"(?iU)^Phụ lục\s+")
    points = F.when(opens, 40 + 10 * holds(after, "banhànhkèm", "cộnghòaxãhội") + 10 * holds(ahead, "nơinhận:", "ghihọtên")).otherwise(0)
    marked = lines.withColumn("points", points).withColumn("cut", F.col("points") >= 50)
    placed = marked.withColumn("part", F.sum(F.col("cut").cast("int")).over(w)).filter("not cut")
    parts = placed.groupBy("doc_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda r: r["line"]), "\n").alias("content"))
    kept = parts.filter(strip(F.col("content")) != "")
    return kept.withColumn("doc_number", F.row_number().over(_by("part"))).select("doc_id", "doc_number", "content")


def _markers(order: tuple) -> Column:
    """Kinds of marker on the lines of `text` outside tables, in hierarchy order. A line tells of one kind at most: the
    first that it fits and no line before it has told of."""
    lines = F.split(remove_tables(F.col("text")), "\n")
    if "roman_chapter" not in order:  # no line fits two kinds, so lines need no order

        def occurs(pattern: str) -> Column:
            return F.exists(lines, lambda x: x.rlike(pattern))

        return F.array_compact(F.array(*(F.when(occurs(MARKERS[m]), F.lit(m)) for m in order)))

    def step(seen: Column, x: Column) -> Column:
        first = F.coalesce(*(F.when(~F.array_contains(seen, m) & x.rlike(MARKERS[m]), F.lit(m)) for m in order))
        return F.when(first.isNull(), seen).otherwise(F.array_append(seen, first))

    told = F.aggregate(lines, F.array().cast("array<string>"), step)
    return F.filter(F.array(*map(F.lit, order)), lambda m: F.array_contains(told, m))


def detected(docs: DataFrame, order: tuple = ORDER) -> DataFrame:
    """(doc_id, markers): kinds of marker on any line outside tables, in hierarchy order."""
    return docs.select("doc_id", _markers(order).alias("markers"))


def marked_lines(docs: DataFrame, order: tuple = ORDER) -> DataFrame:
    """Lines that are not blank with their marker (null for text), its level and parts, and whether a marker line
    without a title has absorbed them as its title."""
    # texts are dealt by document, so none of the windows over its lines shuffles again
    kinds = docs.select("doc_id", "text").repartition("doc_id").withColumn("markers", _markers(order))
    lines = kinds.select("doc_id", "markers", F.posexplode(F.split("text", "\n")).alias("ord", "line")).withColumn("line", strip(F.col("line"))).filter("line <> ''")
    marker = F.coalesce(*(F.when(F.array_contains("markers", m) & F.col("line").rlike(MARKERS[m]), F.lit(m)) for m in order))

    def group(i: int) -> Column:
        return F.coalesce(*(F.when(F.col("marker") == m, F.regexp_extract("line", MARKERS[m], i)) for m in order), F.lit(""))

    found = lines.withColumn("marker", marker).withColumn("rest", strip(group(3)))
    # in a run of markers without titles every second one is the title of the one before
    bare = F.col("marker").isNotNull() & (F.col("rest") == "")
    # (all windows have one order, so that lines are sorted once)
    runs = found.withColumn("bare", bare.cast("int")).withColumn("place", F.row_number().over(_by()))
    nth = F.col("place") - F.coalesce(F.max(F.when(F.col("bare") == 0, F.col("place"))).over(_by()), F.lit(0))
    open_ = runs.withColumn("open", (F.col("bare") == 1) & (nth % 2 == 1))
    return (
        open_.withColumn("absorbed", F.coalesce(F.lag("open").over(_by()), F.lit(False)))
        .withColumn("title", F.when(F.col("open"), F.regexp_replace(F.lead("line").over(_by()), r"^[-.)]?\s*", "")).otherwise(F.col("rest")))
        .withColumn("header", group(1)).withColumn("value", group(2))
        .withColumn("starts", F.col("marker").isNotNull() & ~F.col("absorbed"))
        .withColumn("level", F.array_position("markers", F.col("marker")).cast("int"))
        .select("doc_id", "ord", "line", "marker", "value", "level", "header", "title", "starts", "absorbed")
    )


def sections(docs: DataFrame, order: tuple = ORDER) -> DataFrame:
    """SECTION rows (doc_id, section_id, parent_id, parent_ord, marker, marker_value, level, ord, header, title, content).

    A section's ancestor at level l is the latest earlier section of that level, provided none of a lower level came
    since. Text between markers belongs to the section before it; text before the first marker is dropped. Headers are
    the markers as they stand; with ROMAN_ORDER a kind's name and its value.
    """
    lines = marked_lines(docs, order).withColumn("section", F.sum(F.col("starts").cast("int")).over(_by())).filter("section > 0")
    text = F.when(~F.col("starts") & ~F.col("absorbed"), F.col("line"))
    # each section has one line that starts it; the others are its body
    fields = ("marker", "value", "level", "ord", "header", "title", "line")
    rows = lines.groupBy("doc_id", "section").agg(
        F.first(F.when(F.col("starts"), F.struct(*fields)), True).alias("head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("ord", text.alias("text"))))), lambda r: r["text"]), "\n").alias("body"),
    ).select("doc_id", "section", "head.*", "body")
    value = F.col("value")
    part = (
        F.when(F.col("marker").isin("chapter", "roman_chapter"), F.concat(F.lit("ch"), value))
        .when(F.col("marker") == "article", F.concat(F.lit("art"), F.lpad(value, F.greatest(F.lit(3), F.length(value)), F.lit("0"))))
        .when(F.col("marker") == "clause", F.concat(F.lit("cl_"), F.lpad(value, F.greatest(F.lit(2), F.length(value)), F.lit("0"))))
        .otherwise(F.concat(F.lit("pt_"), value))
    )
    heads = rows.withColumn("part", part)
    w = _before()
    for level in range(1, len(order)):
        last = F.last(F.when(F.col("level") == level, F.struct("ord", "part")), True).over(w)
        lower = F.last(F.when(F.col("level") < level, F.col("ord")), True).over(w)
        heads = heads.withColumn(f"a{level}", F.when((F.col("level") > level) & (last["ord"] > F.coalesce(lower, F.lit(-1))), last))
    above = F.concat_ws("_", F.col("doc_id").cast("string"), *(f"a{level}.part" for level in range(1, len(order))))
    made = heads.withColumn("parent_id", above).withColumn("section_id", F.concat_ws("_", above, "part"))
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    return made.select(
        "doc_id", "section_id", "parent_id", F.greatest(F.lit(None).cast("int"), *(f"a{level}.ord" for level in range(1, len(order)))).alias("parent_ord"),
        "marker", F.col("value").alias("marker_value"), "level", "ord",
        (F.concat_ws(" ", names[F.col("marker")], F.col("value")) if "roman_chapter" in order else F.col("header")).alias("header"), "title",
        F.when((F.col("title") == "") & (F.col("body") == ""), F.col("line")).otherwise(F.col("body")).alias("content"),
    )


def promoted(found: DataFrame) -> DataFrame:
    """Sections without content have their title as content, and no title."""
    bare = (F.col("content") == "") & (F.col("title") != "")
    return found.withColumn("_bare", bare).withColumn("content", F.when(F.col("_bare"), F.col("title")).otherwise(F.col("content"))).withColumn("title", F.when(F.col("_bare"), "").otherwise(F.col("title"))).drop("_bare")


def cleaned(found: DataFrame, depth: int = 4) -> DataFrame:
    """Parents' contents without their direct children's contents and titles, deepest level first.

    Each level is written once, so that plans don't grow with the depth.
    """
    found = stored(found, "sections")
    done = stored(found.filter(F.coalesce(F.col("level") >= depth, F.lit(True))), "level")
    taken = lambda acc, x: strip(F.when(x == "", acc).otherwise(F.replace(acc, x, F.lit(""))))
    for level in range(depth - 1, 0, -1):
        children = done.groupBy(F.col("doc_id").alias("_doc"), F.col("parent_ord").alias("_parent")).agg(F.array_sort(F.collect_list(F.struct("ord", "content", "title"))).alias("_children"))
        less = F.aggregate("_children", F.col("content"), lambda acc, c: taken(taken(acc, c["content"]), c["title"]))
        joined = found.filter(F.col("level") == level).join(children, (F.col("doc_id") == F.col("_doc")) & (F.col("ord") == F.col("_parent")), "left")
        rows = joined.withColumn("content", F.when(F.col("_children").isNotNull(), less).otherwise(F.col("content"))).drop("_doc", "_parent", "_children")
        done = done.unionByName(stored(rows, "level"))
    return done


def _cuts(section_id: Column) -> Column:
    """The places of '_' in an id."""
    return F.filter(F.sequence(F.lit(1), F.length(section_id)), lambda i: F.substr(section_id, i, F.lit(1)) == "_")


def find_section(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """For (doc_id, wanted) the section of that id, else the first whose id ends in '_' and the wanted marker.

    Ids and what follows each of their '_' are the join key, so sections meet the wanted ids alone that they answer.
    """
    key = F.col("section_id")
    names = F.concat(F.array(key), F.transform(_cuts(key), lambda i: F.substr(key, i + 1)))
    named = found.withColumn("wanted", F.explode(F.array_distinct(names)))
    order = Window.partitionBy("doc_id", "wanted").orderBy((F.col("section_id") != F.col("wanted")).cast("int"), "ord")
    return wanted.join(named, ["doc_id", "wanted"]).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def full_headers(found: DataFrame) -> DataFrame:
    """(doc_id, section_id, reference): a section's header and those of all sections whose ids its own goes on from,
    the nearest first. The cut ids are the join key."""
    key = F.col("section_id")
    above = found.select("doc_id", "section_id", "header", F.explode_outer(F.transform(_cuts(key), lambda i: F.substr(key, F.lit(1), i - 1))).alias("_up"))
    up = found.select(F.col("doc_id").alias("_doc"), F.col("section_id").alias("_id"), F.col("header").alias("_header"))
    joined = above.join(up, (F.col("doc_id") == F.col("_doc")) & (F.col("_up") == F.col("_id")), "left")
    listed = F.sort_array(F.collect_list(F.when(F.col("_id").isNotNull(), F.struct(F.length("_id").alias("n"), "_header"))), False)
    return joined.groupBy("doc_id", "section_id").agg(F.concat_ws(", ", F.first("header"), F.transform(listed, lambda r: r["_header"])).alias("reference"))


def with_ancestors(found: DataFrame, name: str, *fields: str, by: tuple = ("doc_id",), depth: int = 5) -> DataFrame:
    """Sections with `name`, an array of (ord, fields) of those above each, the outermost first.

    As in `sections` they are the latest earlier ones of their levels, so windows tell them and rows that lie by document
    are not shuffled again."""
    w = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    above = []
    for level in range(1, depth):
        last = F.last(F.when(F.col("level") == level, F.struct("ord", *fields)), True).over(w)
        lower = F.last(F.when(F.col("level") < level, F.col("ord")), True).over(w)
        above.append(F.when((F.col("level") > level) & (last["ord"] > F.coalesce(lower, F.lit(-1))), last))
    return found.withColumn(name, F.array_compact(F.array(*above)))


def _depth() -> Column:
    """How far below the first level a section hangs."""
    return F.size(F.split("section_id", "_(?=art|ch|cl_|pt_)")) - 2


def _shown(*parts: Column) -> Column:
    """The parts that are not empty, each a line indented by its section's depth."""
    pad = F.repeat(F.lit("    "), F.col("_depth").cast("int"))
    return F.array_join(F.transform(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.concat(pad, x, F.lit("\n"))), "")


def compact_pieces(found: DataFrame, full: bool = False) -> DataFrame:
    """Sections with `piece` and `up`, the numbers of the sections above: the pieces of a section and all below it, one
    behind the other, are its compact text, headers in full mode alone.

    What a section yields is stripped before it goes into the one above, so first lines lose their indents and siblings
    touch: a piece is stripped in front, and behind too where no text hangs below it."""
    own = _shown(F.col("header") if full else F.lit(""), F.col("title"), F.col("content"))
    rows = with_ancestors(found, "_up").withColumn("up", F.transform("_up", lambda u: u["ord"])).withColumn("_depth", _depth()).withColumn("_own", own)
    rows = rows.withColumn("_shown", F.when(strip(F.col("_own")) != "", F.col("up")))
    following = F.expr("lead(_shown, 1) ignore nulls over (partition by doc_id order by ord)")
    below = rows.withColumn("_below", F.coalesce(F.array_contains(following, F.col("ord")), F.lit(False)))
    piece = F.when(F.col("_below"), F.regexp_replace("_own", r"^\s+", "")).otherwise(strip(F.col("_own")))
    return below.withColumn("piece", piece).drop("_up", "_depth", "_own", "_shown", "_below")


def _joined(order: str, text: Column, joint: str = "") -> Column:
    """Texts of a group in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda r: r["t"]), joint)


def tree_json(found: DataFrame) -> DataFrame:
    """(doc_id, json): a document's sections as a JSON array of {id, header, title, content, subsections}."""
    own = F.to_json(F.struct(F.col("section_id").alias("id"), "header", "title", "content"))
    made = trees.in_order(trees.paths(stored(found.select("doc_id", "ord", "parent_ord", "section_id", "header", "title", "content"), "sections"), "doc_id", "header"), "doc_id", opened=own)
    opened = F.transform("opened", lambda o: F.substr(o, F.lit(1), F.length(o) - 1))
    return made.select("doc_id", trees.nested(opened, F.col("depths")).alias("json"))


def reconstructed(found: DataFrame, full: bool = False, compact: bool = False) -> DataFrame:
    """(doc_id, text): sections in order, four spaces a level; `full` names ancestors after the header; `compact` as
    `compact_pieces`, the first level's sections on lines of their own."""
    if compact:
        piece = F.concat(F.when(F.size("up") == 0, F.lit("\n")).otherwise(F.lit("")), "piece")
        return compact_pieces(found, full).groupBy("doc_id").agg(strip(_joined("ord", piece)).alias("text"))
    rows, head = found.withColumn("_depth", _depth()), F.col("header")
    if full:
        rows = trees.paths(stored(rows.select("doc_id", "ord", "parent_ord", "_depth", "header", "title", "content"), "sections"), "doc_id", "header")
        head = F.array_join(F.filter(F.reverse("labels"), lambda h: h != ""), ", ")
    shown = _shown(head, F.col("title"), F.col("content"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", shown.alias("text")))), lambda r: r["text"]), "").alias("text"))


def whole_file(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, text) of files whose documents (path, doc_number, doc_id) have sections `found`: each document in full
    mode, a line of 80 dashes behind it."""
    texts = documents.join(reconstructed(found, full=True), "doc_id", "left")
    block = F.concat(F.coalesce("text", F.lit("")), F.lit("\n" + "-" * 80 + "\n\n"))
    return texts.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_number", block.alias("text")))), lambda r: r["text"]), "").alias("text"))


def section_in_files(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, file, text) for ids (wanted) and sections with a `file`: the section and what is below it, indented from
    there, from the first file by name that has it. Ids and their cuts are the join key: the wanted ids go to the sections
    (broadcast while they are few), not the sections to a task an id, since most files may have the same ids."""
    key = F.col("section_id")
    names = F.concat(F.array(key), F.transform(_cuts(key), lambda i: F.substr(key, F.lit(1), i - 1)))
    asked = small(stored(wanted.select("wanted").distinct(), "wanted"))
    rows = found.withColumn("wanted", F.explode(F.array_distinct(names))).join(asked, "wanted")
    marks = lambda c: F.size(F.split(c, "(?:^|_)(?=art|ch|cl_|pt_)"))
    shown = rows.withColumn("_depth", marks("section_id") - marks("wanted")).withColumn("_text", _shown(F.col("header"), F.col("title"), F.col("content")))
    texts = shown.groupBy("wanted", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_text"))), lambda r: r["_text"]), "").alias("text"))
    return texts.filter("text <> ''").groupBy("wanted").agg(F.min("file").alias("file"), F.min_by("text", "file").alias("text"))


def scored_forms(appendices: DataFrame) -> DataFrame:
    """(doc_id, ord, line, begins): lines, and whether a form begins there."""
    lines, w = exploded(appendices), _by()
    line, before, after = F.col("line"), F.lag("line").over(w), F.lead("line").over(w)
    table = lambda x: x.contains("<table>") | x.contains("</table>")
    # Phrases that announce a form.
    rules = (
        (_squeezed(line).contains("mẫusố"), 40), (_squeezed(before).contains("banhànhkèm"), 10), (is_upper(after), 10),
        (table(before), 10), (table(after), 10), (_squeezed(after).contains("cộnghòaxãhội"), 10),
    )
    points = sum((F.when(F.coalesce(rule, F.lit(False)), n).otherwise(0) for rule, n in rules), F.lit(0))
    return lines.withColumn("begins", points >= 50)


def forms(appendices: DataFrame) -> DataFrame:
    """(doc_id, form_id, first, last): spans of lines of the forms in appendices (doc_id, text); `last` is exclusive."""
    w, scored = _by(), scored_forms(appendices).withColumn("lines", F.count("*").over(Window.partitionBy("doc_id")))
    starts = scored.filter("begins")
    return starts.select(
        "doc_id",
        F.format_string("form_%02d", F.row_number().over(w)).alias("form_id"),
        F.col("ord").alias("first"),
        F.coalesce(F.lead("ord").over(w), F.col("lines").cast("int")).alias("last"),
        "line",
    )


def appendix_sections(appendices: DataFrame) -> DataFrame:
    """(doc_id, section, content): each form, and what no form covers as one section 'Appendix Content'.

    A form reaches to the next one or the end, so a line's form is the count of those that have begun.
    """
    begun = F.sum(F.col("begins").cast("int")).over(_by())
    lines = scored_forms(appendices).withColumn("form", begun)
    section = F.when(F.col("form") > 0, F.format_string("form_%02d", F.col("form"))).otherwise("Appendix Content")
    rows = lines.groupBy("doc_id", section.alias("section")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda r: r["line"]), "\n").alias("content"))
    return rows.filter(strip(F.col("content")) != "")
