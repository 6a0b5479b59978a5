"""A keyword index: grams of GRAM characters with their places, written once, so that searches read no text.

Each text, lower-cased, is cut into overlapping grams (shorter ones at its end). Texts are dealt by id and alone shuffled; a
task takes CHUNK letters at a time and writes a row a gram, (bucket, gram, texts), `texts` being those of the chunk that hold
the gram, with their places, in order of bucket and gram. So row groups of other buckets are left out, and what a gram that
all texts hold needs lies in many files. A keyword is found where grams that cover it lie at the right distances: the same
rows as a search for the substring, whatever the case. Only the buckets of the keywords' grams are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawframe.scratch import small, stored

GRAM, BUCKETS = 3, 64
#: Letters that a task packs at once, at least a text.
CHUNK = 1 << 20
#: Bytes of a row group, the least that a search reads or leaves out.
ROW_GROUP = 4 << 20


def _bucket(gram: Column) -> Column:
    """By the first character, so that keywords shorter than a gram have one bucket too."""
    return F.pmod(F.xxhash64(F.substr(gram, F.lit(1), F.lit(1))), F.lit(BUCKETS)).cast("int")


def _packed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(bucket, gram, texts), in order within each task; the texts are all that is shuffled."""
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

    held = StructType([StructField("id", rows.schema[key].dataType), StructField("places", ArrayType(IntegerType(), False))])
    schema = StructType([StructField("gram", StringType()), StructField("texts", ArrayType(held, False))])
    texts = rows.filter(F.length(text) > 0).select(F.col(key).alias("id"), F.lower(text).alias("text")).repartition("id")
    return texts.mapInArrow(_pack(_arrow_schema(schema)), schema).withColumn("bucket", _bucket(F.col("gram"))).sortWithinPartitions("bucket", "gram")


def _arrow_schema(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _pack(schema, chunk: int = CHUNK):
    def pack(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def packed(ids, texts):
            length = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            ends = np.cumsum(length)
            letters = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64) + 1
            owner = np.repeat(np.arange(len(length)), length)
            place = np.arange(len(letters)) - (ends - length)[owner]
            left, code = (length[owner] - place), letters.copy()
            for n in range(1, GRAM):  # 0 stands for no letter, behind the last
                code = (code << 21) | np.where(left > n, np.concatenate([letters[n:], np.zeros(n, np.int64)])[: len(letters)], 0)
            order = code.argsort(kind="stable")  # by gram, text and place
            code, owner, place = code[order], owner[order], place[order].astype(np.int32)
            new = np.r_[True, code[1:] != code[:-1]]
            pair = np.flatnonzero(new | np.r_[True, owner[1:] != owner[:-1]])
            first = np.flatnonzero(new)
            shift = 21 * np.arange(GRAM)[::-1]
            names = ["".join(chr(c - 1) for c in row if c) for row in ((code[first, None] >> shift) & (1 << 21) - 1).tolist()]
            inner = pa.ListArray.from_arrays(pa.array(np.r_[pair, len(code)].astype(np.int32)), pa.array(place))
            field = schema.field("texts").type.value_type
            held = pa.StructArray.from_arrays([ids.take(pa.array(owner[pair])), inner], fields=[pa.field(field[i].name, x.type, field[i].nullable) for i, x in enumerate((ids, inner))])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[np.searchsorted(pair, first), len(pair)].astype(np.int32)), held)
            yield from pa.table({"gram": pa.array(names, pa.string()), "texts": lists}).to_batches(max_chunksize=1 << 12)

        kept, letters = [], 0
        for batch in batches:
            length, at = pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False), 0
            for i, n in enumerate(length.tolist()):
                letters += n
                if letters >= chunk:
                    kept.append(batch.slice(at, i + 1 - at))
                    whole = pa.Table.from_batches(kept).combine_chunks()
                    yield from packed(whole.column("id").combine_chunks(), whole.column("text").combine_chunks())
                    kept, letters, at = [], 0, i + 1
            if at < len(length):
                kept.append(batch.slice(at))
        if kept:
            whole = pa.Table.from_batches(kept).combine_chunks()
            yield from packed(whole.column("id").combine_chunks(), whole.column("text").combine_chunks())

    return pack


def _unpacked(index: DataFrame, *columns: str) -> DataFrame:
    """A row a text: (id, places) and `columns` of packed rows."""
    return index.select(*columns, F.explode("texts").alias("_t")).select(*columns, "_t.id", "_t.places")


def _placed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(bucket, gram, id, places) of texts, as searches see them."""
    return _unpacked(_packed(rows, key, text), "bucket", "gram")


def build(rows: DataFrame, path: str, key: str = "record_id", text: str = "content") -> None:
    """Index `rows` (key, text; a row a key) under `path`. Null and empty texts are in no posting."""
    _packed(rows, key, text).write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)


def _holding(met: DataFrame) -> DataFrame:
    """(id, keyword) of packed rows that met (keyword, at, parts). Where one gram is all of a keyword its places don't matter."""
    one = _unpacked(met.filter("parts = 1"), "keyword").select("id", "keyword")
    more = _unpacked(met.filter("parts > 1"), "keyword", "at", "parts")
    begins = more.select("id", "keyword", "parts", "at", F.explode("places").alias("place")).withColumn("begin", F.col("place") - F.col("at"))
    full = begins.groupBy("id", "keyword", "parts", "begin").agg(F.count_distinct("at").alias("hit")).filter("hit = parts")
    return one.unionByName(full.select("id", "keyword")).distinct()


def search(spark: SparkSession, path: str, keywords: list[str]) -> DataFrame:
    """(id, keyword) for each text that holds a keyword. An empty keyword is in every text that isn't empty."""
    asked = []
    for word in dict.fromkeys(keywords):
        low = word.lower()
        starts = sorted({*range(0, max(1, len(low) - GRAM + 1), GRAM), max(0, len(low) - GRAM)})  # they cover the word
        asked += [(word, at, low[at : at + GRAM], len(starts)) for at in starts]
    wanted = spark.createDataFrame(asked, "keyword string, at int, part string, parts int")  # a few rows a keyword
    buckets = None if any(not w for w in keywords) else sorted(r[0] for r in wanted.select(_bucket(F.col("part"))).distinct().collect())
    index = spark.read.parquet(path)
    if buckets is not None:
        index = index.filter(F.col("bucket").isin(buckets))
    # grams are named in the filters too, so that pages of other grams are left out
    parts = {part for _, _, part, _ in asked}
    whole = index.filter(F.col("gram").isin([p for p in parts if len(p) == GRAM])).join(F.broadcast(wanted), F.col("gram") == F.col("part")).select("keyword", "at", "parts", "texts")
    for part in sorted(p for p in parts if len(p) < GRAM):  # a shorter keyword is all of its part
        some = index.filter(F.col("gram").startswith(part)).join(F.broadcast(wanted.filter(F.col("part") == part))).select("keyword", "at", "parts", "texts")
        whole = whole.unionByName(some)
    return _holding(whole)


def matching(rows: DataFrame, path: str, keywords: list[str], key: str = "record_id") -> DataFrame:
    """The `rows` whose text holds any of the keywords, by a semi join with the index."""
    found = search(rows.sparkSession, path, keywords).select(F.col("id").alias(key))
    return rows.join(found, key, "left_semi")


def search_all(index: DataFrame, keywords: DataFrame) -> DataFrame:
    """As `search` for keywords that are rows (keyword), however many: (id, keyword). Null and empty ones find nothing."""
    length, at = F.length("low"), F.col("at")
    words = keywords.filter(F.length("keyword") > 0).select("keyword").distinct().withColumn("low", F.lower("keyword"))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(F.lit(0), length - GRAM), F.lit(GRAM)), F.array(F.greatest(F.lit(0), length - GRAM))))
    asked = stored(words.withColumn("parts", F.size(starts)).withColumn("at", F.explode(starts)).select("keyword", "at", F.substr("low", at + 1, F.lit(GRAM)).alias("part"), "parts", length.alias("n")), "asked")
    asked = asked.withColumn("bucket", _bucket(F.col("part")))
    held = index.select("bucket", "gram", "texts")
    found = None
    for n in range(1, GRAM + 1):  # a shorter keyword is met by the starts of grams
        few = small(asked.filter(F.col("n") >= GRAM if n == GRAM else F.col("n") == n))
        own = held.withColumn("part", F.substr("gram", F.lit(1), F.lit(n))) if n < GRAM else held.withColumn("part", F.col("gram"))
        met = own.join(few, ["bucket", "part"]).select("keyword", "parts", "at", "texts")
        found = met if found is None else found.unionByName(met)
    return _holding(found)
