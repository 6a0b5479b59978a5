"""Structure operators on a small law."""

from pyspark.sql import functions as F

from lawframe.operators import citations as M
from lawframe.operators import structure as S
from lawframe.plans import ingest

LAW = """preamble
Chương I
QUY ĐỊNH CHUNG
Điều 1. Phạm vi
Luật này quy định.
1. Khoản một
a) điểm a
b) điểm b
2. Khoản hai
Điều 12
Chương II. Khác
Điều 13 - Cuối"""


def laws(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "n int, text string").select(F.concat(F.lit("D"), "n").alias("doc_id"), "text")


def test_sections(spark):
    got = [(r["section_id"], r["level"], r["title"], r["content"]) for r in S.sections(laws(spark, LAW)).orderBy("ord").collect()]
    assert got == [
        ("D0_chI", 1, "QUY ĐỊNH CHUNG", ""),
        ("D0_chI_art001", 2, "Phạm vi", "Luật này quy định."),
        ("D0_chI_art001_cl_01", 3, "Khoản một", ""),
        ("D0_chI_art001_cl_01_pt_a", 4, "điểm a", ""),
        ("D0_chI_art001_cl_01_pt_b", 4, "điểm b", ""),
        ("D0_chI_art001_cl_02", 3, "Khoản hai", ""),
        ("D0_chI_art012", 2, "Chương II. Khác", ""),
        ("D0_chI_art013", 2, "Cuối", ""),
    ]


def test_no_markers_no_sections(spark):
    assert S.sections(laws(spark, "only text here", "")).count() == 0


def test_articles_are_level_one_without_chapters(spark):
    got = S.sections(laws(spark, "Điều 1. a\n1. b")).orderBy("ord").collect()
    assert [(r["section_id"], r["level"], r["parent_id"]) for r in got] == [("D0_art001", 1, "D0"), ("D0_art001_cl_01", 2, "D0_art001")]


def test_segments_need_context(spark):
    got = S.segments(laws(spark, "a\nPhụ lục I\nBan hành kèm theo\nb", "a\nPhụ lục I\nb", "Phụ lục\nBan hành kèm")).orderBy("doc_id", "doc_number").collect()
    assert [(r["doc_id"], r["doc_number"], r["content"]) for r in got] == [("D0", 1, "a"), ("D0", 2, "Ban hành kèm theo\nb"), ("D1", 1, "a\nPhụ lục I\nb"), ("D2", 1, "Phụ lục\nBan hành kèm")]


def test_law_records(spark):
    files = spark.createDataFrame([("x/law.txt", "Số: 12/2020/QH\n" + LAW)], "path string, text string")
    got = ingest.law_records(files)
    assert got.count() == 8 and got.select("document_id").distinct().collect()[0][0] == "12/2020/QH"


def walked(text):
    """The walk word by word."""
    import re

    found = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n", text or ""):
        words = sentence.split()
        size = lambda i: next((n for n in (2, 1) if i + n <= len(words) and " ".join(words[i : i + n]).lower() in M.WALKED_KINDS), 0)  # noqa: E731, B023
        i = 0
        while i < len(words):
            n = size(i)
            j = i + max(n, 1)
            while n and j < len(words) and j < i + n + 6 and not size(j):
                j += 1
            if n:
                year = next((w for w in words[i:j] if re.match(r"\d{4}\b", w)), "")
                rest = " ".join(words[i + n : j])
                found.append((" ".join(words[i:j]), " ".join(words[i : i + n]).lower(), "", year, "", rest.replace(year, "").strip() if year else rest))
            i = j
    return found


def test_walked_mentions(spark):
    import random

    draw = random.Random(5)
    words = ["Luật", "LUẬT", "bộ", "Bộ", "pháp", "lệnh", "nghị", "Nghị", "định", "quyết", "thông", "tư", "2020", "2019,", "50", "12345", "2001a", "2002/QH", "a.", "b!", "c", "luật.", "\n", "  ", "\u00a0", "d"]
    texts = ["Theo Luật Doanh nghiệp 2020 và Nghị định 15 của Chính phủ", None, "", "luật", *(" ".join(draw.choices(words, k=draw.randint(1, 60))) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in M.walk(df).collect():
        got.setdefault(r[0], []).append(tuple(r[1:]))
    assert all(got.get(i, []) == walked(t) for i, t in enumerate(texts)) and len(got) > 300


def test_agreement_by_presence(spark):
    """One join finds what a look at every pair finds, whichever properties a mention has."""
    import itertools

    names = ("document_type", "document_number", "issue_year", "issuer_body")
    made = list(itertools.product(("luật", "Bộ Luật", "nghị định"), ("", "1", "A"), ("", "2019"), ("", "btc")))
    mentioned = spark.createDataFrame([(i, *m) for i, m in enumerate(made)], "id int, " + ", ".join(f"{n} string" for n in names))
    catalog = [*made, ("luật", None, "2019", None), (None, "1", "2019", "btc"), ("luật", "a", None, "BTC")]
    rows = spark.createDataFrame([(f"D{i}", "name", i, *c) for i, c in enumerate(catalog)], "document_id string, full_name string, position int, " + ", ".join(f"{n} string" for n in names))
    kind = lambda k: None if k is None else "statute" if k.lower() in M.STATUTES else k.lower()
    for held in (names[1:], ("document_number", "issuer_body")):
        at = [names.index(n) for n in held]
        want = {(i, f"D{j}") for i, m in enumerate(made) for j, c in enumerate(catalog) if kind(m[0]) == kind(c[0]) and all(not m[k] or m[k].lower() == (c[k] or "").lower() for k in at)}
        found = M._agreeing(mentioned, rows, held)
        got = [(r["id"], r["document_id"]) for r in found.collect()]
        assert set(got) == want and len(got) == len(want)
        assert found._jdf.queryExecution().toString().count("Join Inner") <= 3


def test_fallback_by_similarity(spark):
    catalog = spark.createDataFrame([(1, "D1", "luật đất đai", "luật", "", "2013", ""), (2, "D2", "luật doanh nghiệp", "luật", "", "2020", "")], "position int, document_id string, full_name string, document_type string, document_number string, issue_year string, issuer_body string")
    text = spark.createDataFrame([(7, "Bộ luật doanh nghiệp")], "id int, text string")
    mentioned = text.select("id", F.explode(M.structured_mentions(F.col("text"))).alias("m")).select("id", "m.*")
    assert [r["document_id"] for r in M.weighted_match(mentioned, catalog, 1, 0.5).collect()] == ["D2"]


def test_mentions_are_matched_once(spark, monkeypatch):
    """The catalog meets each distinct mention, not each row that has it; all rows get what it stands for."""
    names = "position int, document_id string, full_name string, document_type string, document_number string, issue_year string, issuer_body string, filename string"
    catalog = spark.createDataFrame([(i, f"D{i}", f"nghị định 1/2020 {i}", "nghị định", "1", "2020", "btc", f"f{i}") for i in range(5)], names)
    text = spark.createDataFrame([(i, "nghị định 1/2020/NĐ-CP bộ tài chính về thuế") for i in range(40)], "id int, text string")
    mentioned = text.select("id", F.explode(M.structured_mentions(F.col("text"))).alias("m")).select("id", "m.*")
    met, agreeing = [], M._agreeing
    monkeypatch.setattr(M, "_agreeing", lambda m, c, p: met.append(m.count()) or agreeing(m, c, p))
    for match in (M.weighted_match, M.dynamic_match):
        got = match(mentioned, catalog, 2, 0.1).collect()
        assert sorted((r["id"], r["rank"], r["document_id"]) for r in got) == [(i, r, f"D{r - 1}") for i in range(40) for r in (1, 2)]
    assert met and max(met) == 1
    twice = mentioned.select("id", "mention").union(spark.createDataFrame([(3, "Nghị định 9/2020"), (50, "Luật 1"), (51, None)], "id int, mention string"))
    plan = M.best_match(twice.withColumn("mention", F.when(F.col("id") < 40, F.lit("nghị định 1/2020")).otherwise(F.col("mention"))), catalog)
    assert sorted(map(tuple, plan.collect())) == [(i, "D0", "f0", 1.0) for i in range(40)]


def test_wanted_ids_go_to_the_sections(spark):
    """Ids that all files have made one task read every file's sections of that id."""
    rows = [("a", 0, "ch1", "Chương 1", "x"), ("b", 0, "ch1", "Chương 1", "y"), ("b", 1, "ch1_art002", "Điều 2", "z"), ("c", 0, "ch12", "Chương 12", "w")]
    found = spark.createDataFrame([(*r, "") for r in rows], "file string, ord int, section_id string, header string, title string, content string")
    wanted = spark.createDataFrame([("ch1",), ("ch1_art002",), ("ch1",), ("none",)], "wanted string")
    got = S.section_in_files(found, wanted)
    assert sorted((r["wanted"], r["file"], r["text"]) for r in got.collect()) == [("ch1", "a", "Chương 1\nx\n"), ("ch1_art002", "b", "Điều 2\nz\n")]
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString()


def test_lines_are_sorted_once_and_sections_made_once(spark):
    """Marked lines took three sorts; records made the sections four times."""
    from lawframe.operators.records import section_records

    marked = S.marked_lines(laws(spark, LAW))._jdf.queryExecution().executedPlan().toString()
    assert marked.count("Sort [") <= 1
    assert section_records(S.sections(laws(spark, LAW)))._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 0
