"""Corpus pipeline over `documents`: quality, near duplicates, repeated passages, source mix, packing.

Each stage takes the documents that the one before kept and returns documents (doc_id, text, lang, source, n_chars, and
whatever else the table has); the last returns packed pieces. Stages are pure functions of their input, so a lost
executor only costs recomputation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawframe.llm import minhash, mixing, packing, quality, suffix
from lawframe.llm.common import free, small, stored


def _counted(df: DataFrame) -> DataFrame:
    """`df` with n_chars counted anew, where there is such a column."""
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated chance of label 1 is at least 0.3.

    Null and empty texts are scored like others; a null doc_id has no label but a score; repeated rows stay or go
    together; without labels, or with labels of one kind, all documents have one score, and all stay where it is 0.3 or
    more (0.5 without any). Labels, lang, source and doc_id are never inputs. Column names may be any.
    """
    vectors, net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free(docs, "score")
    return quality.score(docs, vectors, net, docs.columns, name=name).filter(F.col(name) >= 0.3).drop(name)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least doc_id (null last), once.

    Null and empty texts are one group; texts of white space alone are groups of their own; unlike texts under one
    doc_id are no group; of rows that are equal in doc_id and text one stays, whatever their other columns say.
    """
    classes = stored(minhash.near_duplicates(docs), "classes")
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "copy")).alias("first"))
    placed = classes.join(first, "root")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("copy") == F.col("first.copy"))
    own = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))

    def those(keys: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        at, mark = free(rows, "_id"), free(rows, "_copy")
        keys = small(keys.select(F.col("doc_id").alias(at), F.col("copy").alias(mark)))
        return rows.join(keys, F.col("doc_id").eqNullSafe(F.col(at)) & (own == F.col(mark)), how)

    kept = those(stored(placed.filter(~stays).select("doc_id", "copy").distinct(), "others"), "left_anti", docs)
    repeated = stored(classes.groupBy("doc_id", "copy").count().filter("count > 1").select("doc_id", "copy"), "repeated")
    if not repeated.limit(1).count():
        return kept
    once = those(repeated, "left_semi", kept).dropDuplicates(["doc_id", "text"])
    return those(repeated, "left_anti", kept).unionByName(once)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeated strings of suffix.PASSAGE bytes cover; characters cut in half go.

    All rows stay, with an empty text where everything goes; null texts become empty ones; rows with null or equal
    doc_ids are told apart by their texts; rows equal in both lose the same bytes.
    """
    made = suffix.remove_repeats(docs, *docs.columns, whole_characters=True, length=suffix.PASSAGE)
    return _counted(made.select(F.col("row").withField("text", F.col("text").cast("string")).alias("row")).select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as their source's blocks are taken.

    A null source is a source, last in order; texts without words are taken by no block and go; a document whose blocks
    are taken in part comes with these alone. An empty table gives no rows.
    """
    return _counted(mixing.materialise(mixing.mix(docs, *docs.columns)))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens: doc_id and the columns of `packing.digests`.

    Null and empty texts are their closing id alone; repeated rows are packed each; other columns are left behind.
    """
    import public_tokenizers

    return packing.digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("repeated_passages", remove_repeated_passages),
    ("source_mix", mix_sources),
    ("packing", pack_tokens),
]
#: Not one of the stages can be put in SQL; tests/llm/test_pipeline.py checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
