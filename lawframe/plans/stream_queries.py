"""Queries over streams that keep state, each with its SQL twin: started two or three times on one checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawframe.streaming import stateful as T

HOUR = 3_600_000_000


def _calls(spark, sf_dir, key: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_type") == "purchase", F.col("props"))
    return events.select(F.col("user_id").alias(key), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), value.alias("value"))


def _halves(rows: DataFrame) -> list[DataFrame]:
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(low + (high - low) / 2) if low else F.lit(None).cast("timestamp")
    return [rows.filter(F.col("ts") < middle), rows.filter(F.col("ts") >= middle)]


def cache_expiry(spark, sf_dir):
    """Purchases put their props, everything else asks; entries live for six hours."""
    return T.in_steps(_halves(_calls(spark, sf_dir, "cache_key")), lambda s: T.expiring_cache(s, 6 * HOUR))


CACHE_EXPIRY = """
with e as (select user_id as cache_key, event_id as id, epoch_us(ts) as us, case when event_type = 'purchase' then props end as value from events),
o as (
  select *, last_value(case when value is not null then us end ignore nulls) over w as put_us, last_value(value ignore nulls) over w as put,
    max(us) over (partition by cache_key) as last_us, max(us) over () as end_us
  from e window w as (partition by cache_key order by us, id rows between unbounded preceding and 1 preceding)),
p as (select *, lead(us) over (partition by cache_key order by us, id) as next_us from o where value is not null)
select cache_key, id, us, case when put_us + 21600000000 >= us then 'hit' else 'miss' end as what, case when put_us + 21600000000 >= us then put end as value
from o where value is null
union all
select cache_key, null, us + 21600000000, 'expired', value from p
where (next_us is null or next_us > us + 21600000000) and (last_us > us + 21600000000 or (us + 21600000000) // 1000 + 1 <= end_us // 1000)
"""


def sliding_admission(spark, sf_dir):
    """Two calls of a user in any 24 hours; others wait."""
    return T.in_steps(_halves(_calls(spark, sf_dir, "limit_key").drop("value")), lambda s: T.admitted(s, 2, 24 * HOUR))


CALLS = """
with recursive o as (
  select user_id as limit_key, event_id as id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events),
"""
SLIDING_ADMISSION = (
    CALLS
    + """
r as (
  select limit_key, n, id, us as asked_us, us as admitted_us, [us] as held from o where n = 1
  union all
  select limit_key, n, id, us, a, list_append(held, a)[-2:] from (
    select o.*, r.held, greatest(o.us, case when len(r.held) >= 2 then r.held[1] + 86400000000 else o.us end, r.held[len(r.held)]) as a
    from r join o on o.limit_key = r.limit_key and o.n = r.n + 1))
select limit_key, id, asked_us, admitted_us from r
where asked_us = admitted_us or (admitted_us + 999) // 1000 <= (select max(us) // 1000 from o)
"""
)


def fixed_admission(spark, sf_dir):
    """One call of a user in each period of 12 hours; others wait for the next."""
    return T.in_steps(_halves(_calls(spark, sf_dir, "limit_key").drop("value")), lambda s: T.admitted(s, 1, 12 * HOUR, fixed=True))


FIXED_ADMISSION = (
    CALLS
    + """
r as (
  select limit_key, n, id, us as asked_us, us as admitted_us, us - us % 43200000000 as start, 1 as used from o where n = 1
  union all
  select limit_key, n, id, us, greatest(us, s), s, u from (
    select o.*, case when o.us - o.us % 43200000000 > r.start then o.us - o.us % 43200000000 when r.used >= 1 then r.start + 43200000000 else r.start end as s,
      case when o.us - o.us % 43200000000 > r.start or r.used >= 1 then 1 else r.used + 1 end as u
    from r join o on o.limit_key = r.limit_key and o.n = r.n + 1))
select limit_key, id, asked_us, admitted_us from r
where asked_us = admitted_us or (admitted_us + 999) // 1000 <= (select max(us) // 1000 from o)
"""
)


def conversation_state(spark, sf_dir):
    """Turns come in three batches; the history of a conversation after the last in which it spoke."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    parts = [turns.filter("turn < 2 or turn is null"), turns.filter("turn >= 2 and turn < 4"), turns.filter("turn >= 4")]
    last = T.in_steps(parts, T.conversations).groupBy("conv_id").agg(F.max_by("history", "turns").alias("history"), F.max("turns").alias("turns"))
    return last.select("conv_id", "turns", F.md5("history").alias("history_md5"))


CONVERSATION_STATE = """
select conv_id, count(*)::int as turns,
  md5(string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) order by turn nulls first, role nulls last, text nulls last)) as history_md5
from conversations group by 1
"""

QUERIES = {
    "X3_cache_expiry": (cache_expiry, CACHE_EXPIRY),
    "X4_sliding_admission": (sliding_admission, SLIDING_ADMISSION),
    "X5_fixed_admission": (fixed_admission, FIXED_ADMISSION),
    "X6_conversation_state": (conversation_state, CONVERSATION_STATE),
}
