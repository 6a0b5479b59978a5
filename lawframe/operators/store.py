"""Keyed tables: upserts, conditional inserts, partial updates and caches with expiry, as unions, windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawframe.functions.text import cache_key


def upsert(old: DataFrame, new: DataFrame, key: str = "record_id", order: str = "seq") -> DataFrame:
    """Rows of both, the latest of each key in the place of its first, `position` from 1; rows without a key go."""
    rows = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1))).filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    place = Window.partitionBy(key)
    latest = Window.partitionBy(key).orderBy(F.desc("_side"), F.desc(order))
    ranked = rows.withColumn("_first", F.min(F.struct("_side", order)).over(place)).withColumn("_n", F.row_number().over(latest)).filter("_n = 1")
    return ranked.drop("_side", "_n").withColumnRenamed("_first", "place")


def insert_if_absent(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The rows to append: new keys alone, the first of each."""
    first = Window.partitionBy(key).orderBy(order)
    return new.join(old.select(key), key, "left_anti").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def partial_update(old: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Old rows with the columns that the delta sets (not null there)."""
    fields = [c for c in delta.columns if c != key]
    renamed = delta.withColumnsRenamed({c: f"_{c}" for c in fields})
    joined = old.join(renamed, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else c for c in old.columns))


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


def upload_counts(new: DataFrame, stored: DataFrame, kept: DataFrame, key: str = "record_id") -> DataFrame:
    """(total, known, near_duplicate, uploaded) of an incremental load; `kept` is what is left of `new` in the end."""
    known = new.join(stored.select(key), key, "left_semi").agg(F.count("*").alias("known"))
    sums = new.agg(F.count("*").alias("total")).join(known).join(kept.agg(F.count("*").alias("uploaded")))
    return sums.select("total", "known", (F.col("total") - F.col("known") - F.col("uploaded")).alias("near_duplicate"), "uploaded")


def cached_answers(queries: DataFrame, cache: DataFrame, now: int) -> DataFrame:
    """Queries (query_id, query_text) with the cached response_text that has not expired, and whether it is a hit."""
    live = cache.filter((F.col("ttl") >= now) & F.coalesce("is_complete", F.lit(True))).select(F.col("cache_key").alias("_key"), "response_text")
    keyed = queries.withColumn("cache_key", cache_key(F.col("query_text")))
    return keyed.join(live, keyed.cache_key == live._key, "left").withColumn("hit", F.col("_key").isNotNull()).drop("_key")


def cache_put(cache: DataFrame, new: DataFrame, now: int, expiry: int = 3600) -> DataFrame:
    """The cache after (query_text, response_text) are set: a live entry stays, an expired or missing one is written."""
    fresh = new.select(cache_key(F.col("query_text")).alias("cache_key"), "response_text").groupBy("cache_key").agg(F.min("response_text").alias("response_text"))
    live = cache.filter(F.col("ttl") >= now)
    written = fresh.join(live.select("cache_key"), "cache_key", "left_anti").withColumn("ttl", F.lit(now + expiry).cast("bigint"))
    expired = cache.filter(F.col("ttl") < now).join(written.select("cache_key"), "cache_key", "left_anti")
    return live.select("cache_key", "response_text", "ttl").unionByName(expired.select("cache_key", "response_text", "ttl")).unionByName(written)


def stored_query(rows: DataFrame) -> DataFrame:
    """Query rows without nulls in response, timestamp and history."""
    return rows.withColumns({
        "response_text": F.coalesce("response_text", F.lit("")),
        "timestamp": F.coalesce("timestamp", F.lit(0).cast("bigint")),
        "conversation_history": F.coalesce("conversation_history", F.array().cast("array<map<string,string>>")),
    })


def audit_rows(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, query_text, response_text, hits): five fields of each hit in order, 'N/A' where one is missing."""
    fields = ["record_id", "document_id", "title", "source", "chunk_id"]
    shown = F.struct("rank", *(F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c in fields))
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(shown)).alias("hits"))
    return queries.join(listed, "query_id", "left")


def cleared(cache: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The cache without some keys, or empty."""
    return cache.limit(0) if keys is None else delete(cache, keys, "cache_key")


def log_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(developer, raw) rows of a log (level, message, log_type): raw ones apart, everything else for developers."""
    raw = F.coalesce(F.col("log_type") == "raw", F.lit(False))
    return rows.filter(~raw), rows.filter(raw).select("message")


# Who may read and moderate, and the tiers there are.
MODERATORS, TIERS = ("ADMIN", "MODERATOR"), ("UNLIMITED", "PAY_AS_YOU_GO", "PREPAID_BASIC", "PREPAID_PRO", "PREPAID_ENTERPRISE")


def may_moderate(role: Column) -> Column:
    return F.coalesce(role.isin(*MODERATORS), F.lit(False))


def known_tier(tier: Column, tiers: tuple = TIERS) -> Column:
    return F.coalesce(tier.isin(*tiers), F.lit(False))
