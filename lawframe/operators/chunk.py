"""Chunking of texts as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawframe.functions.text import count_words, strip
from lawframe.functions.vectors import cosine


def _packed(parts: Column, most_words: int, most_parts: int | None) -> Column:
    """array<struct<at, before>>: where groups of parts begin, taken greedily while words (and parts) fit, and the words
    before each; behind the last the end of all."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("total"), F.lit(0).alias("words"), F.lit(0).alias("parts"), F.array().cast("array<struct<at:int,before:int>>").alias("groups"))

    def step(s: Column, part: Column) -> Column:
        words = count_words(part)
        full = (s["n"] == 0) | (s["words"] + words > most_words)
        if most_parts:
            full = full | (s["parts"] >= most_parts)
        groups = F.when(full, F.array_append(s["groups"], F.struct((s["n"] + 1).alias("at"), s["total"].alias("before")))).otherwise(s["groups"])
        return F.struct((s["n"] + 1).alias("n"), (s["total"] + words).alias("total"), F.when(full, words).otherwise(s["words"] + words).alias("words"), F.when(full, 1).otherwise(s["parts"] + 1).alias("parts"), groups.alias("groups"))

    return F.aggregate(parts, start, step, lambda s: F.array_append(s["groups"], F.struct((s["n"] + 1).alias("at"), s["total"].alias("before"))))


def packed(docs: DataFrame, most_words: int = 300, most_parts: int | None = None, separator: str = r"\n\s*\n", joint: str = "\n\n") -> DataFrame:
    """(doc_id, chunk, n_words, content): consecutive paragraphs packed greedily; a longer one stands alone; blanks go.

    Groups are runs, so a chunk is a slice of its document's array: nothing is shuffled.
    """
    parts = docs.select("doc_id", F.filter(F.transform(F.split("text", separator), strip), lambda p: p != "").alias("parts"))
    grouped = parts.filter(F.size("parts") > 0).withColumn("groups", _packed(F.col("parts"), most_words, most_parts))
    rows = grouped.select("doc_id", "parts", "groups", F.posexplode(F.slice("groups", F.lit(1), F.size("groups") - 1)).alias("chunk", "g"))
    following = F.get("groups", F.col("chunk") + 1)
    content = F.array_join(F.slice("parts", F.col("g.at"), following["at"] - F.col("g.at")), joint)
    return rows.select("doc_id", "chunk", (following["before"] - F.col("g.before")).alias("n_words"), content.alias("content"))


def split_articles(docs: DataFrame) -> DataFrame:
    """(chunk_id, content): texts split at English article headings, blanks dropped; ids count from 1."""
    parts = F.filter(F.transform(F.split("text", r"Article\s+\d+[.,]?\s+"), strip), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(parts).alias("at", "content")).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("at") + 1).alias("chunk_id"), "content")


def cohesive(clauses: DataFrame, most_words: int = 300, least: float = 0.6, by: tuple = ("doc_id",)) -> DataFrame:
    """Clauses (by, ord, content, embedding, ...) without their vectors, with the number of their chunk: a clause opens a
    new one where words would exceed the limit or its similarity to the clause before is too low."""
    w = Window.partitionBy(*by).orderBy("ord")
    scored = clauses.withColumn("_near", F.coalesce(cosine(F.col("embedding"), F.lag("embedding").over(w)), F.lit(1.0)))
    kept = ["ord", *(c for c in clauses.columns if c not in (*by, "ord", "embedding"))]
    listed = scored.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*kept, "_near"))).alias("rows"))
    start = F.struct(F.lit(-1).alias("chunk"), F.lit(0).alias("words"), F.array().cast("array<int>").alias("chunks"))

    def step(s: Column, r: Column) -> Column:
        words = count_words(r["content"])
        opens = (s["chunk"] < 0) | (s["words"] + words > most_words) | (r["_near"] < least)
        chunk = F.when(opens, s["chunk"] + 1).otherwise(s["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(opens, words).otherwise(s["words"] + words).alias("words"), F.array_append(s["chunks"], chunk).alias("chunks"))

    folded = listed.withColumn("chunks", F.aggregate("rows", start, step, lambda s: s["chunks"]))
    return folded.select(*by, F.explode(F.arrays_zip("rows", "chunks")).alias("z")).select(*by, *(f"z.rows.{c}" for c in kept), F.col("z.chunks").alias("chunk"))


def token_windows(docs: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """(doc_id, window, content): windows of `size` words, each beginning `size - overlap` words after the one before."""
    words = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    held = docs.select("doc_id", words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - overlap, F.lit(1)), F.lit(size - overlap))
    return held.select("doc_id", "words", F.posexplode(starts).alias("window", "at")).select("doc_id", "window", F.array_join(F.slice("words", F.col("at"), size), " ").alias("content"))


def breakpoint_chunks(clauses: DataFrame, percentile: float = 0.95) -> DataFrame:
    """(doc_id, ord, chunk): a new chunk where the distance to the clause before exceeds that percentile of its document."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    far = clauses.withColumn("far", 1 - cosine(F.col("embedding"), F.lag("embedding").over(w)))
    limit = far.withColumn("limit", F.percentile("far", F.lit(percentile)).over(Window.partitionBy("doc_id")))
    return limit.select("doc_id", "ord", F.sum(F.coalesce((F.col("far") > F.col("limit")).cast("int"), F.lit(0))).over(w).alias("chunk"))


def double_merged(clauses: DataFrame, initial: float = 0.4, merging: float = 0.5, most_chars: int = 5000) -> DataFrame:
    """(doc_id, ord, chunk): runs of clauses each similar enough to the one before, then neighbouring runs joined whose
    mean vectors are similar enough, while a chunk's characters fit."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    near = cosine(F.col("embedding"), F.lag("embedding").over(w))
    runs = clauses.withColumn("_cut", (F.coalesce(near, F.lit(1.0)) < initial).cast("int")).withColumn("_run", F.sum("_cut").over(w))
    at = runs.select("doc_id", "_run", "content", F.posexplode("embedding").alias("i", "x")).groupBy("doc_id", "_run", "i").agg(F.avg("x").alias("x"))
    vectors = at.groupBy("doc_id", "_run").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("v"))
    sizes = runs.groupBy("doc_id", "_run").agg(F.sum(F.length("content")).alias("size"))
    by = Window.partitionBy("doc_id").orderBy("_run")
    listed = vectors.join(sizes, ["doc_id", "_run"]).withColumn("near", F.coalesce(cosine(F.col("v"), F.lag("v").over(by)), F.lit(0.0)))
    folded = listed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_run", "size", "near"))).alias("runs"))
    start = F.struct(F.lit(-1).alias("chunk"), F.lit(0).cast("bigint").alias("size"), F.array().cast("array<int>").alias("chunks"))

    def step(s: Column, r: Column) -> Column:
        opens = (s["chunk"] < 0) | (r["near"] < merging) | (s["size"] + r["size"] > most_chars)
        chunk = F.when(opens, s["chunk"] + 1).otherwise(s["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(opens, r["size"]).otherwise(s["size"] + r["size"]).alias("size"), F.array_append(s["chunks"], chunk).alias("chunks"))

    numbered = folded.withColumn("chunks", F.aggregate("runs", start, step, lambda s: s["chunks"])).select("doc_id", F.explode(F.arrays_zip("runs", "chunks")).alias("z"))
    return runs.join(numbered.select("doc_id", F.col("z.runs._run").alias("_run"), F.col("z.chunks").alias("chunk")), ["doc_id", "_run"]).select("doc_id", "ord", "chunk")


def topics(clauses: DataFrame, window: int = 3, least: float = 0.8) -> DataFrame:
    """(doc_id, ord, chunk): a clause stays with the topic while it is similar enough to one of the `window` before it."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    near = F.greatest(F.lit(-1.0), *(F.coalesce(cosine(F.col("embedding"), F.lag("embedding", i).over(w)), F.lit(-1.0)) for i in range(1, window + 1)))
    scored = clauses.withColumn("_new", (near < least).cast("int"))
    return scored.select("doc_id", "ord", (F.sum("_new").over(w) - F.first("_new").over(w)).cast("bigint").alias("chunk"))


#: Splitters by name, over clauses (doc_id, ord, content, embedding); sentences go by `token_windows`.
SPLITTERS = {"semantic_chunking": breakpoint_chunks, "semantic_double_merge_chunking": double_merged, "topic_node_parser": topics}


def split_by(clauses: DataFrame, method: str) -> DataFrame:
    try:
        return SPLITTERS[method](clauses)
    except KeyError:
        raise ValueError(f"unknown method {method}") from None
