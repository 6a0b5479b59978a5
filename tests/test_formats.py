"""Embedders, formatting, intentions, uploads, splitters, sinks and settings on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawframe import config, ship
from lawframe.operators import chunk as C
from lawframe.operators import citations as M
from lawframe.operators import search as S
from lawframe.operators import store as K
from lawframe.operators import structure as H
from lawframe.plans import formatting, ingest, providers, uploads
from lawframe.scratch import numbered, small
from lawframe.sources import files, sinks
from lawframe.streaming import streams


def hashed(dim=64):
    return providers.local_embedder({"model_name": "hashed", "cache_dir": "", "vector_dimension": dim})


def test_embedders():
    e = hashed(8)
    assert e.vector_dimension() == 8 and len(e.embed("a b")) == 8 and e.batch_embed(["a b", "c"])[0] == e.embed("a b")
    with pytest.raises(ValueError, match="cache_dir"):
        providers.local_embedder({"model_name": "hashed", "vector_dimension": 8})
    fails = providers.managed_embedder(lambda t: [1.0, 2.0] if t == "ok" else 1 / 0, 2)
    assert fails.batch_embed(["ok", "no", "ok"]) == [[1.0, 2.0], [], [1.0, 2.0]]
    assert providers.Embedder(lambda: lambda texts: [[1.0]] * len(texts), 2).embed("x") == []
    assert providers.flat([[1, 2]]) == [1.0, 2.0] == providers.flat([1, 2])


def test_http_embedder():
    asked = []

    class Answer:
        def __init__(self, body):
            self.body = body

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def read(self):
            return json.dumps({"embeddings": [[float(len(t)), 0.0] for t in json.loads(self.body)["texts"]]}).encode()

    def opener(request, timeout):
        asked.append((request.full_url, timeout))
        return Answer(request.data)

    e = providers.http_embedder("http://x/embed", 2, opener=opener)
    assert e.batch_embed(["ab", "c"]) == [[2.0, 0.0], [1.0, 0.0]] and asked == [("http://x/embed", 60.0)]
    assert providers.http_embedder("http://x/embed", 3, opener=opener).embed("ab") == []


def test_embed_requests(spark):
    rows = spark.createDataFrame([(1, " a \n\n b", True), (2, "a\nb", False), (3, "one", False), (4, None, True), (5, "bad", False)], "request_id int, texts string, is_batch boolean")
    e = providers.managed_embedder(lambda t: [1.0] if t != "bad" else 1 / 0, 1)
    got = {r["request_id"]: (r["status"], r["embeddings"] and len(r["embeddings"])) for r in providers.embed_request(rows, e).collect()}
    assert got == {1: (200, 2), 2: (400, None), 3: (200, 1), 4: (400, None), 5: (500, None)}


def test_intentions_are_asked_three_times(spark):
    providers.register("generator", "stubborn", lambda prompts: ['{"history": "h"}' if p.endswith("(try 3)") else '{"other": 1}' for p in prompts])
    providers.register("generator", "mute", lambda prompts: 1 / 0)
    df = spark.createDataFrame([("q", ["before"]), ("r", None)], "q string, h array<string>")
    assert [tuple(r[0]) for r in df.select(providers.detected_intention(F.col("q"), F.col("h"), "stubborn")).collect()] == [("history", "h")] * 2
    assert [tuple(r[0]) for r in df.select(providers.detected_intention(F.col("q"), F.col("h"), "stubborn", 2)).collect()] == [("rag", None)] * 2
    assert [tuple(r[0]) for r in df.select(providers.detected_intention(F.col("q"), F.col("h"), "mute")).collect()] == [("rag", None)] * 2
    assert providers.read_intention('so {"rag": null} }') is None and providers.read_intention('x {"irrelevant": "no"} y') == ("irrelevant", "no")


def test_modes(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("<title>t</title><content>c</content>",), ("plain",)], "raw string")
    run = lambda *a, **k: [r[0] for r in df.select(formatting.formatted(F.col("raw"), *a, **k)).collect()]
    assert run("json", json_schema={"a": 1})[0] == '{"a": 1}' and run("json")[1:] == [None, None]
    tagged = run("tagged")
    assert tagged[1] == "<title>t</title><content>c</content>" and tagged[2].endswith("plain") and tagged[0].endswith('{"a": 1}')
    assert run("enrichment") == [None] * 3 == run("enrichment", record_type="DOC")[2:] * 3 and run("other") == [None] * 3


def test_loading_falls_back_to_the_generator(spark):
    providers.register("generator", "tagger", lambda prompts: ["<title>T</title><content>C</content>" if "good" in p else "" for p in prompts])
    df = spark.createDataFrame([("good text",), ("other",), ('{"title": "a", "content": "b"}',)], "raw string")
    got = [(r["loaded_from"], r["record"] and r["record"]["title"]) for r in formatting.loaded(df, generator="tagger").collect()]
    assert got == [("generator", "T"), (None, None), ("json", "a")]
    assert [r["loaded_from"] for r in formatting.loaded(df, is_formatted=False, generator="tagger").collect()] == ["generator", None, None]


def test_answers_have_the_form_of_the_mode(spark):
    providers.register("generator", "repeating", lambda prompts: [p[p.index("\n\n") :] for p in prompts])
    rows = spark.createDataFrame([("1", "t", '{"title": "a", "content": "b"}'), ("2", "t", "<title>a</title><content>b</content>")], "record_id string, title string, content string")
    run = lambda mode, **more: [r["source_id"] for r in formatting.preprocessed(rows, mode, (), generator="repeating", **more).collect()]
    assert run("tagged") == ["2"] and run("json", json_schema={"a": 1}) == ["1"]


def test_masking_comes_before_formatting(spark):
    rows = spark.createDataFrame([("1", "t", "<title>a</title><content>b</content>"), ("2", "", "x")], "record_id string, title string, content string")
    assert formatting.preprocessed(rows, "tagged", requirements=()).count() == 1
    assert formatting.preprocessed(rows, "tagged").count() == 0  # a masked text has no elements left
    assert [r[0] for r in rows.select(formatting.compliant(F.to_json(F.struct("title")), {"a": 1})).collect()] == [True, True]


def test_upload_chain(spark):
    stored = providers.embedded(spark.createDataFrame([("a", "one two")], "record_id string, content string"), "content", hashed())
    new = spark.createDataFrame([("a", "else"), ("b", "two one"), ("c", "three"), (None, "four"), ("e", None)], "record_id string, content string")
    added, counts = uploads.upload(new, stored, hashed())
    assert sorted(r["content"] or "" for r in added.collect()) == ["", "four", "three"]
    assert tuple(counts.first()) == (5, 1, 1, 3)
    assert uploads.upserted(stored, added).count() == 4
    answers = spark.createDataFrame([("q", "five six", None, "Admin"), ("q", "seven", None, "User"), ("q", " ", None, "Admin")], "question string, answer string, metadata string, privilege string")
    up, suggested = uploads.reviewed(answers, stored, hashed())
    assert [r["content"] for r in up.collect()] == ["five six"] and [r["answer"] for r in suggested.collect()] == ["seven"]


def test_neighbours_in_dealt_blocks(spark, sf_dir):
    """More queries than a block: blocks of queries against chunks of points give the same rows."""
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("record_id"), "embedding", F.col("label"))
    queries = points.select(F.col("record_id").alias("query_id"), "embedding")
    rows = lambda **k: sorted(map(tuple, S.knn_join(queries, points, 3, **k).collect()))
    assert rows(block=7) == rows() and rows(block=7, by="label") == rows(by="label") and rows(block=7, earlier=True) == rows(earlier=True)


def test_neighbours_among_the_points_themselves(spark, sf_dir):
    """Queries that are rows of the points, collections that are never null, exact copies over several tiles."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("record_id"), "embedding", F.when(F.col("label") % 2 == 0, "a").otherwise("b").alias("side"))
    points = e.unionByName(e.withColumn("record_id", F.col("record_id") + 100_000))
    queries = points.filter("record_id % 2 = 0").select(F.col("record_id").alias("query_id"), "embedding")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "record_id", "similarity_score", "rank").collect()))
    q, p = (np.array([r["embedding"] for r in x.orderBy(x.columns[0]).collect()], float) for x in (queries, points))
    names = {c: [r[c] for r in x.orderBy(c).select(c).collect()] for c, x in (("query_id", queries), ("record_id", points))}
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit(q) @ unit(p).T, 5)
    best = (-scores).argsort(1, kind="stable")[:, :5]
    want = sorted((i, names["record_id"][b], scores[n, b], r) for n, i in enumerate(names["query_id"]) for r, b in enumerate(best[n], 1))
    for block in (7, 4096):
        got = rows(S.knn_join(queries, points, 5, block=block))
        assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want] and all(abs(g[2] - w[2]) < 2e-5 for g, w in zip(got, want, strict=True))
    assert rows(S.knn_join(queries, points, 5, "side", block=7)) == rows(S.knn_join(queries, points, 5, "side"))


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean", "manhattan"])
def test_best_of_tiles(metric, monkeypatch):
    """Tiles keep the first ones of equal scores, with and without a bound on the points."""
    monkeypatch.setattr(S, "TILE", (4, 5))
    rng = np.random.default_rng(1)
    q, p = rng.integers(-2, 3, (9, 3)).astype(float), rng.integers(-2, 3, (60, 3)).astype(float)
    q, p = (S._unit(q), S._unit(p)) if metric == "cosine" else (q, p)
    sign, scores = -1 if metric in S.DISTANCES else 1, np.round(S._scores(q, p, metric), 5)
    for before in (None, np.arange(9) * 7):
        row, point, score = S._best(q, p, 4, metric, before)
        want = []
        for i in range(9):
            best = (-sign * scores[i, : None if before is None else before[i]]).argsort(kind="stable")[:4]
            want += [(i, b, scores[i, b]) for b in best]
        assert list(zip(row.tolist(), point.tolist(), score.tolist(), strict=True)) == want


def test_rerank_methods(spark):
    hits = spark.createDataFrame([(1, "a b", "x " * 300 + "a b", 1, "p"), (1, "a b", "a", 2, "q"), (1, "a b", "zz", 3, "r")], "query_id int, query_text string, content string, rank int, record_id string")
    order = lambda m: [r["record_id"] for r in S.reranked_by(hits, m).orderBy("position").collect()]
    assert order("FlashRank") == order("crossencoder") == ["p", "q", "r"]
    S.register_scorer("Length", lambda query, content: F.when(content != "zz", -F.length(content).cast("double")))
    assert order("length") == ["r", "q", "p"]  # a score that is missing is 0
    with pytest.raises(ValueError):
        S.reranked_by(hits, "none")


def test_splitters(spark):
    rows = [(1, i, "w" * 10, v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.1, 1.0], [1.0, 0.0]])]
    df = spark.createDataFrame(rows, "doc_id int, ord int, content string, embedding array<double>")
    run = lambda name: [r["chunk"] for r in C.split_by(df, name).orderBy("ord").collect()]
    assert run("topic_node_parser") == [0, 0, 1, 1, 2] or run("topic_node_parser") == [0, 0, 1, 1, 1]
    assert run("semantic_double_merge_chunking") == [0, 0, 1, 1, 2]
    assert run("semantic_chunking")[0] == 0
    with pytest.raises(ValueError):
        C.split_by(df, "none")


def test_roman_points_open_parts(spark):
    """Letters that are Roman numerals mark parts; a line after one that told of parts may tell of points."""
    df = spark.createDataFrame([("D", "c) first\nĐiều 1. x\nd) second\nb) third")], "doc_id string, text string")
    assert [r["markers"] for r in H.detected(df, H.ROMAN_ORDER).collect()] == [["roman_chapter", "article", "point"]]
    got = [(r["section_id"], r["header"]) for r in H.sections(df, H.ROMAN_ORDER).orderBy("ord").collect()]
    assert got == [("D_chc", "Phần c"), ("D_chc_art001", "Điều 1"), ("D_chd", "Phần d"), ("D_chd_pt_b", "Điểm b")]


def test_structured_json(spark):
    text = "Số: 5/2020/QH\nLUẬT A\nĐiều 1. a\n1. b\nPhụ lục I\nBan hành kèm theo\nDANH MỤC\nMẫu số 1\nĐƠN XIN\n1. mục"
    made = json.loads(ingest.structured_json(spark.createDataFrame([("in/x.txt", text), ("in/y.txt", "no markers 'here'")], "path string, text string")).orderBy("path").collect()[0]["json"])
    assert made["doc_filename"] == "x.txt" and [d["doc_id"] for d in made["documents"]] == ["5/2020/QH", "5/2020/QH_appendix_02"]
    article = made["documents"][0]["articles"][0]
    assert (article["id"], article["content"], article["subsections"][0]["content"]) == ("5/2020/QH_art001", "a", "b")
    form, rest = made["documents"][1]["articles"]
    assert (form["header"], form["id"]) == ("Form form_01", "5/2020/QH_appendix_02_form_01") and rest["header"] == "Appendix Content" and rest["content"].startswith("Ban hành")


def test_link_and_statutes(spark):
    catalog = spark.createDataFrame([(1, "D1", "luật 12/2020 thuế", "2020", "f1")], "position int, document_id string, full_name string, issue_year string, filename string")
    records = spark.createDataFrame([("r", "theo Luật 12/2020 ok", "own", "s"), ("q", "nothing", "own", "s")], "record_id string, content string, document_id string, source string")
    assert {r["record_id"]: (r["document_id"], r["source"]) for r in M.link_documents(records, catalog).collect()} == {"r": ("D1", "f1"), "q": ("own", "s")}
    names = spark.createDataFrame([("Bộ luật x",), ("LUẬT y",), ("nghị định",), (None,)], "n string")
    assert [r[0] for r in names.select(M.is_statute(F.col("n"))).collect()] == [True, True, False, False]


def test_sinks(spark, tmp_path):
    schema = "record_id string, v int"
    first = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], schema + ", seq long")
    sinks.write_json(first, f"{tmp_path}/r")
    made = sinks.upsert_jsonl(spark, f"{tmp_path}/r", spark.createDataFrame([("b", 9, 1), ("c", 3, 2)], schema + ", seq long"), schema)
    assert [(r["record_id"], r["v"]) for r in spark.read.schema(schema + ", seq long").json(made).orderBy("seq").collect()] == [("a", 1), ("b", 9), ("c", 3)]
    sinks.append_jsonl(first, made)
    assert spark.read.json(made).count() == 5
    points = sinks.ensure_collection(spark, f"{tmp_path}/c", 2, "cosine")
    assert points.count() == 0
    with pytest.raises(ValueError, match="metric"):
        sinks.ensure_collection(spark, f"{tmp_path}/c", 2, "odd")
    spark.createDataFrame([("a", [1.0, 2.0, 3.0], "")], "record_id string, embedding array<float>, payload string").write.mode("append").parquet(f"{tmp_path}/c")
    with pytest.raises(ValueError, match="dimension"):
        sinks.ensure_collection(spark, f"{tmp_path}/c", 2, "cosine")
    sinks.reset_collection(spark, f"{tmp_path}/c")
    assert sinks.ensure_collection(spark, f"{tmp_path}/c", 2, "cosine").count() == 0
    main = spark.createDataFrame([("D", 2, "s")], "doc_id string, doc_number int, section_id string")
    more = spark.createDataFrame([("D", 1, "t", 1)], "doc_id string, doc_number int, section_id string, position int")
    assert sorted(r["doc_number"] for r in sinks.merged_appendices(main, more).collect()) == [2, 3]
    found = H.sections(spark.createDataFrame([("D", "Điều 1. a")], "doc_id string, text string"))
    assert json.loads(sinks.sections_json(found).first()["json"])[0]["section_id"] == "D_art001"


def test_catalog_and_json_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Document_ID,Full Name,Issued Date,issue_year,Filename,document_number,document_type,issuer_body\n1," Luật A, ""x""",d, 2020 ,F.pdf,7,LUẬT,BTC\n')
    r = files.read_catalog(spark, str(tmp_path / "c.csv")).first()
    assert (r["Full Name"], r["issue_year"], r["document_type"], r["Filename"]) == ('luật a, "x"', "2020", "luật", "F.pdf")
    (tmp_path / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert files.read_json(spark, str(tmp_path / "a.json"), "a int").count() == 2


def test_file_selection_and_pages(spark, tmp_path):
    paths = spark.createDataFrame([("x/a_with_appendix.TXT",), ("x/a.txt",), ("x/with_appendix.exe",)], "path string")
    assert [r["path"] for r in files.selected(paths).collect()] == ["x/a_with_appendix.TXT"]
    pages = spark.createDataFrame([("p10.png", b"ten"), ("p2.png", b"two"), ("x.png", b"x"), ("p1.png", b"one")], "name string, content binary")
    done = spark.createDataFrame([("p1.png",)], "name string")
    got = files.pages_of(pages, done, lambda c: c.decode().upper()).orderBy("position").collect()
    assert [(r["position"], r["name"], r["text"]) for r in got] == [(1, "p2.png", "--- Page: p2.png ---\nTWO\n"), (2, "p10.png", "--- Page: p10.png ---\nTEN\n"), (3, "x.png", "--- Page: x.png ---\nX\n")]
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.txt").write_text("no")
    assert [r["text"] for r in files.read_pdfs(spark, str(tmp_path), lambda c: c.decode().split("|")).collect()] == ["one\ntwo"]
    assert [r["target_path"] for r in ingest.write_mirrored(spark.createDataFrame([("in/a/b.txt", "{}")], "path string, json string"), "in/", "out").collect()] == ["out/a/b.txt.json"]
    models = spark.createDataFrame([("a", 2.0), ("b", None), ("c", 0.5)], "model string, size_in_gb double")
    assert [r["model"] for r in files.by_size(models).collect()] == ["c", "a", "b"]
    stored = spark.createDataFrame([("1", "k", 2), ("1", "j", 1)], "query_id string, cache_key string, seq int")
    assert files.first_match(stored, "query_id", "1").first()["cache_key"] == "j"


def test_cache_and_logs(spark):
    cache = spark.createDataFrame([("a", 1), ("b", 2)], "cache_key string, v int")
    assert K.cleared(cache).count() == 0 and [r["v"] for r in K.cleared(cache, cache.filter("v = 1")).collect()] == [2]
    log = spark.createDataFrame([("INFO", "a", None), ("INFO", "b", "raw")], "level string, message string, log_type string")
    developer, raw = K.log_rows(log)
    assert [r["message"] for r in developer.collect()] == ["a"] and [r["message"] for r in raw.collect()] == ["b"]


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("a: ${X}/b\nc: [1, '${Y}']\n")
    assert config.load_yaml(str(tmp_path / "c.yaml"), {"X": "x"}) == {"a": "x/b", "c": [1, ""]} and config.load_yaml(str(tmp_path / "none.yaml")) == {}


def test_numbered_and_small(spark):
    df = spark.range(500).select((F.col("id") * 7 % 501).alias("x")).repartition(7)
    got = numbered(df, F.desc("x")).collect()
    assert sorted((r["position"], r["x"]) for r in got) == list(enumerate(sorted((r["x"] for r in got), reverse=True), 1))
    wide = spark.createDataFrame([("x" * 1000,)] * 10, "s string")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(small(wide)) and not hinted(small(wide, 5000)) and not hinted(small(spark.range(100), 50))


def test_sessions_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2020-01-01 00:00:00"), (1, "2020-01-01 00:10:00"), (1, "2020-01-01 03:00:00"), (1, "2020-01-02 03:00:00")], "user_id int, ts string").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/e")
    found = streams.available(streams.sessions(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/e")), "complete")
    assert sorted(r["events"] for r in found.collect()) == [1, 1, 2]


def test_package_is_shipped(spark):
    ship(spark)
    assert any(f.endswith("lawframe.zip") for f in spark.sparkContext.listFiles)


def test_queue(spark, tmp_path):
    """Poison rows go apart; a batch that fails comes again."""
    schema = "query_id string, query_text string, llm_provider string, timestamp bigint"
    streams.enqueue(spark.createDataFrame([("1", "a", "x", 1), ("2", " ", "x", 2)], schema).coalesce(1), f"{tmp_path}/q")
    seen, tries = [], []

    def handle(frame, number):
        tries.append(number)
        if len(tries) == 1:
            raise RuntimeError("lost")
        seen.extend(r["query_id"] for r in frame.collect())

    run = lambda: streams.consume(spark, f"{tmp_path}/q", handle, f"{tmp_path}/poison", f"{tmp_path}/check")
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    run()
    assert seen == ["1"] and tries == [0, 0]
    assert [json.loads(r[0])["query_id"] for r in spark.read.text(f"{tmp_path}/poison/0").collect()] == ["2"]
    cache = spark.createDataFrame([("a", 5), ("b", 15)], "cache_key string, ttl int")
    assert [r["cache_key"] for r in streams.live(cache, 10).collect()] == ["b"]


def test_fallback_and_engine(spark, tmp_path):
    broken = providers.managed_embedder(lambda t: 1 / 0 if "x" in t else [1.0, 0.0], 2)
    assert providers.with_fallback(broken, providers.managed_embedder(lambda t: [0.0, 1.0], 2)).batch_embed(["a", "x"]) == [[1.0, 0.0], [0.0, 1.0]]
    from lawframe.plans import answering

    points = spark.createDataFrame([("doc_768", f"R{i}", f"text {i}", "T", "D", "s", "D_art001") for i in range(5)], "collection string, record_id string, content string, title string, document_id string, source string, chunk_id string")
    engine = answering.query_engine(points.withColumn("embedding", providers.embed(F.col("content"))), 2)
    got = engine(spark.createDataFrame([("1", "far away")], "query_id string, query_text string")).collect()
    assert len(got) == 1 and len(got[0]["sources"]) == 2
    (tmp_path / "a.DOC").write_bytes(b"old")
    (tmp_path / "b.doc").write_bytes(b"old")
    assert [(r["path"][-7:], bytes(r["content"])) for r in files.converted(spark, str(tmp_path), lambda c: c.upper()).collect()] == [("/b.docx", b"OLD")]
