"""Sessions of clicks by gap, length and final clicks, with late clicks placed afterwards; embedded duckdb in Arrow groups.

A client's time is cut into slices (a day). A slice gets its own clicks and those `length + gap` before and behind it,
so it holds every session that begins in it, and mostly also tells by itself where: a hard break (first click, gap, or
after a final one) in its foreground starts the chain of sessions. Slices are hashed into Arrow groups of about
ROWS_A_GROUP rows; a client, however large, is spread over as many groups as it has slices. In a group duckdb runs windows
for the hard breaks, a recursive CTE for the length cuts (each session's start leads to the first click more than
`length` later), and an ASOF JOIN that gives each late click the last session begun by then.

Three things reach beyond a slice, and travel as a few rows a slice:

* Clicks that follow each other without a break for longer than the foreground (a machine's): where the length cuts lie
  then depends on the slices before. Such a slice waits. It says for each click at its beginning that may be its first
  cut which click would be the first cut of the next slice; slices that know their last session say the latter outright.
  Chains of these pointers are closed by pointer doubling (a logarithmic number of joins on click ids), then the waiting
  slices run with their first cut given.
* Late clicks in a slice before its first session belong to the client's last session of an earlier slice.
* Whether a client has a later click at all ('gap' or 'none').

The latter two are one window over a client's slices, two rows each.

Edge cases: rows without click_id, client_id or ts are left out; of rows with one click_id the least (client, time, late,
final, cents) counts; a null arrival is no late one; a null or non-finite value has no cents and makes no click final; a
null kind is no purchase; equal times go by click_id; late clicks before a client's first session belong to none, and a
client with late clicks alone has no session; an empty table gives no rows; columns of other names are ignored. Times
may be with or without zone (without one they count as UTC). The length has to be at least the gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawframe.llm.common import stored, table

MINUTE = 60_000_000
#: Rows of an Arrow group, about.
ROWS_A_GROUP = 20_000

#: What a group returns. `what`: session, last (the slice's last session), early (late clicks before the slice's first
#: session, n_late), waiting, entry (to_id is the first length cut of the slice), pointer (if session_id is a first cut,
#: to_id is that of the slice).
FOUND = (
    "what string, client_id long, slice long, session_id long, start_us long, end_us long, n_clicks long, n_late long, "
    "value_cents long, closed_by string, path binary, to_id long"
)

#: Over the Arrow table `rows` (client_id, slice, click_id, us, late, final, cents, entry). {given}: the first cuts of
#: waiting slices are given as entries.
STEPS = (
    # hard breaks; `unknown`: what stands before the first click in view can't be seen
    """
create or replace temp table clicks as
with here as (
  select *, row_number() over w as nth, lag(us) over w as before, lag(final) over w as ended, lead(us) over w as after
  from rows where not late window w as (partition by client_id, slice order by us, click_id)),
marked as (
  select *, before is null or ended or us - before >= {gap} as breaks, before is null and us < slice * {width} - {length} as unknown
  from here)
select *, sum(breaks::int) over (partition by client_id, slice order by nth) as island from marked
""",
    """
create or replace temp table islands as
select client_id, slice, island, min(us) as since, max(us) as until, bool_or(unknown) as dim,
  bool_or(unknown) and max(us) >= slice * {width} as waits
from clicks group by client_id, slice, island
""",
    # where a length cut may fall: in islands that are long enough
    """
create or replace temp table places as
select client_id, slice, island, us, min(nth) as nth, arg_min(click_id, nth) as click_id
from clicks join islands using (client_id, slice, island) where until - since > {length} group by all
""",
    # the first click over `length` later, which cuts a session that begins here
    """
create or replace temp table cuts as
select p.client_id, p.slice, p.nth as since, n.island, n.us, n.nth, n.click_id
from places p asof join places n
  on p.client_id = n.client_id and p.slice = n.slice and p.island = n.island and p.us + {length} + 1 <= n.us
""",
    # starts of sessions: hard breaks and given first cuts, and from each start the first click over `length` later;
    # of waiting slices each click at the beginning as a candidate
    """
create or replace temp table starts as
with recursive chain as (
  select client_id, slice, island, us, nth, click_id, click_id as origin, false as candidate
  from clicks where breaks and not unknown or {given} and entry
  union all
  select client_id, slice, island, us, nth, click_id, click_id, true
  from places join islands using (client_id, slice, island)
  where waits and not {given} and us >= slice * {width} and us < slice * {width} + {length} + {gap}
  union all
  select p.client_id, p.slice, p.island, p.us, p.nth, p.click_id, s.origin, s.candidate
  from chain s join cuts p on s.client_id = p.client_id and s.slice = p.slice and s.nth = p.since)
select * from chain
""",
    """
create or replace temp table waiting as select distinct client_id, slice from islands where waits and not {given}
""",
    """
create or replace temp table sessions as
with begun as (
  select client_id, slice, nth from starts where not candidate and (client_id, slice) not in (select (client_id, slice) from waiting)),
placed as (
  select c.*, max(b.nth) over (partition by c.client_id, c.slice order by c.nth) as start
  from clicks c left join begun b using (client_id, slice, nth)),
summed as (
  select client_id, slice, start, arg_min(click_id, nth) as session_id, min(us) as start_us, max(us) as end_us, count(*) as n_clicks,
    sum(cents)::bigint as value_cents, unhex(sha256(string_agg(click_id::varchar, ',' order by nth))) as path,
    arg_max(struct_pack(final := final, after := after), nth) as ending
  from placed where start is not null group by client_id, slice, start)
select * exclude ending, case when ending.final then 'end' when ending.after is null then 'open'
  when ending.after - end_us >= {gap} then 'gap' else 'length' end as closed_by
from summed where start_us >= slice * {width} and start_us < (slice + 1) * {width}
""",
    # late clicks by the last session that has begun
    """
create or replace temp table lates as
select l.client_id, l.slice, s.start, count(*) as n
from (select client_id, slice, us from rows where late and (client_id, slice) not in (select (client_id, slice) from waiting)) l
asof left join (select client_id, slice, start_us, max(start) as start from sessions group by all) s
  on l.client_id = s.client_id and l.slice = s.slice and l.us >= s.start_us
group by all
""",
)
RESULT = """
with last as (
  select *, row_number() over (partition by client_id, slice, origin, candidate order by nth desc) as place,
    lead(us) over w as next_us, lead(click_id) over w as next_id, us < (slice + 1) * {width} as own
  from starts window w as (partition by client_id, slice, island, origin, candidate order by nth))
select case when s.start = max(s.start) over (partition by s.client_id, s.slice) then 'last' else 'session' end as what,
  s.client_id, s.slice, s.session_id, s.start_us, s.end_us, s.n_clicks, coalesce(l.n, 0) as n_late, s.value_cents, s.closed_by, s.path,
  null::bigint as to_id
from sessions s left join lates l on s.client_id = l.client_id and s.slice = l.slice and s.start = l.start
union all
select 'early', client_id, slice, null, null, null, null, n, null, null, null, null from lates where start is null
union all
select 'waiting', client_id, slice, null, null, null, null, null, null, null, null, null from waiting
union all
select case when candidate then 'pointer' else 'entry' end, client_id, slice + 1, origin, null, null, null, null, null, null, null, next_id
from last join islands using (client_id, slice, island)
where not {given} and us >= slice * {width} and own and next_us >= (slice + 1) * {width} and (dim or since < (slice + 1) * {width} - {length})
"""

_held: list = []


def _duck():
    """One embedded database per worker, with one thread."""
    if not _held:
        import duckdb

        _held.append(duckdb.connect(config={"threads": 1, "memory_limit": "700MB"}))
    return _held[0]


def _grouped(rows: DataFrame, groups: int, given: bool, gap: int, length: int, width: int) -> DataFrame:
    """What each group returns (FOUND). Slices are dealt to `groups` groups by a hash."""
    names = {"gap": gap, "length": length, "width": width, "given": str(given).lower()}
    steps, result = [s.format(**names) for s in STEPS], RESULT.format(**names)

    def run(group):
        import pyarrow as pa

        duck = _duck()
        duck.register("rows", group)
        try:
            for step in steps:
                duck.execute(step)
            made = duck.sql(result).to_arrow_table()
        finally:
            duck.unregister("rows")
        types = [pa.string(), *[pa.int64()] * 8, pa.string(), pa.binary(), pa.int64()]
        return made.cast(pa.schema(list(zip(made.column_names, types, strict=True))))

    bucket = F.pmod(F.xxhash64("client_id", "slice"), F.lit(groups))
    return rows.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(run, FOUND)


def _micros(df: DataFrame, name: str) -> Column:
    """A time as microseconds since 1970; without a zone it counts as UTC."""
    if df.schema[name].dataType.typeName() == "timestamp":
        return F.unix_micros(name)
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")


def prepared(clicks: DataFrame, late: int, final: Column) -> DataFrame:
    """Each click once: click_id, client_id, us, late, final, cents."""
    us, value = _micros(clicks, "ts"), F.col("value")
    sound = F.abs(value) < float("inf")  # neither null nor a NaN
    row = F.struct(
        "client_id", us.alias("us"), F.coalesce(_micros(clicks, "arrived_at") - us > late, F.lit(False)).alias("late"),
        F.coalesce(final & sound, F.lit(False)).alias("final"), F.coalesce(F.when(sound, F.floor(100 * value + 0.5)), F.lit(0)).cast("bigint").alias("cents"),
    )
    known = clicks.filter("click_id is not null and client_id is not null and ts is not null")
    return known.groupBy("click_id").agg(F.min(row).alias("row")).select("click_id", "row.*")


def sliced(clicks: DataFrame, width: int, reach: int) -> DataFrame:
    """Clicks dealt to slices of their client: their own, and for clicks that aren't late those within `reach`."""
    own = F.expr(f"(us - pmod(us, {width}L)) div {width}L")
    near = F.filter(F.array(own - 1, own, own + 1), lambda s: (F.col("us") >= s * width - reach) & (F.col("us") < (s + 1) * width + reach))
    return clicks.withColumn("slice", F.explode(F.when(F.col("late"), F.array(own)).otherwise(near)))


def _entries(found: DataFrame) -> DataFrame:
    """First cuts of slices: those that are known, and all to which pointers lead from them, by pointer doubling."""
    entries = stored(found.filter("what = 'entry'").select("client_id", "slice", F.col("to_id").alias("click_id")).distinct(), "entries")
    pointers = stored(found.filter("what = 'pointer'").select("client_id", "slice", F.col("session_id").alias("from_id"), "to_id"), "pointers")
    while not pointers.isEmpty():
        further = entries.alias("e").join(pointers.alias("p"), F.col("e.click_id") == F.col("p.from_id"))
        further = further.select("p.client_id", "p.slice", F.col("p.to_id").alias("click_id"))
        longer = pointers.alias("a").join(pointers.alias("b"), F.col("a.to_id") == F.col("b.from_id"))
        longer = longer.select("b.client_id", "b.slice", "a.from_id", "b.to_id")
        entries, pointers = stored(entries.union(further).distinct(), "entries"), stored(longer, "pointers")
    return entries


def sessionise(clicks: DataFrame, gap: int = 5 * MINUTE, length: int = 120 * MINUTE, late: int = 60 * MINUTE, final: Column | None = None, width: int = 24 * 60 * MINUTE, rows_a_group: int = ROWS_A_GROUP) -> DataFrame:
    """Sessions of `clicks` (click_id, ts, arrived_at, client_id, kind, value).

    A click at least `gap` after the one before, or behind a `final` one, or over `length` after its session's first
    begins a session; clicks that arrive over `late` after their time join none. `width` is that of a slice.
    """
    reach = length + gap
    if gap > length or width <= 2 * reach:
        raise ValueError("a slice has to be longer than twice a session with a gap, and a session than a gap")
    final = (F.col("value") >= 60) & (F.col("kind") == "purchase") if final is None else final
    groups = max(1, -(-clicks.count() // rows_a_group))
    rows = sliced(prepared(clicks, late, final), width, reach)
    found = stored(_grouped(rows.withColumn("entry", F.lit(False)), groups, False, gap, length, width), "sessions")
    parts = found
    waiting = found.filter("what = 'waiting'").select("client_id", "slice")
    if not waiting.isEmpty():
        entries = _entries(found).withColumn("entry", F.lit(True))
        again = rows.join(waiting, ["client_id", "slice"], "left_semi").join(entries, ["client_id", "slice", "click_id"], "left")
        again = again.withColumn("entry", F.coalesce("entry", F.lit(False)))
        parts = found.unionByName(stored(_grouped(again, groups, True, gap, length, width), "waited"))
    return _closed(parts)


def _closed(parts: DataFrame) -> DataFrame:
    """Sessions with what lies in later slices: late clicks before a slice's first session, and whether there is any
    later click."""
    by = Window.partitionBy("client_id")
    before = F.sum(F.when(F.col("what") == "early", F.col("n_late")).otherwise(0))
    ends = (
        parts.filter("what in ('last', 'early')")
        .withColumn("so_far", before.over(by.orderBy("slice", F.col("what") == "last").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("all_of_them", before.over(by))
        .filter("what = 'last'")
        .withColumn("until_next", F.lead("so_far").over(by.orderBy("slice")))
    )
    names = ["client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by", "path"]
    last = ends.withColumn("n_late", F.col("n_late") + F.coalesce("until_next", "all_of_them") - F.col("so_far")).withColumn(
        "closed_by", F.when(F.col("closed_by") != "open", F.col("closed_by")).when(F.col("until_next").isNotNull(), "gap").otherwise("none")
    )
    rows = parts.filter("what = 'session'").select(names).unionByName(last.select(names))
    return rows.select(*names[:-1], F.lower(F.hex("path")).alias("path_sha256"))


def op11_sessions(spark, sf_dir: str) -> DataFrame:
    return sessionise(table(spark, sf_dir, "clicks"))


ORACLE = """
with recursive once as (
  select distinct on (click_id) click_id, client_id, epoch_us(ts) as us, coalesce(epoch_us(arrived_at) - epoch_us(ts) > 3600000000, false) as late,
    coalesce(kind = 'purchase' and value >= 60, false) as final, coalesce(floor(100 * value + 0.5), 0)::bigint as cents
  from clicks where click_id is not null and client_id is not null and ts is not null),
timely as (
  select *, row_number() over w as rn, lag(us) over w as before, lag(final) over w as ended
  from once where not late window w as (partition by client_id order by us, click_id)),
islands as (
  select *, sum((before is null or ended or us - before >= 300000000)::int) over (partition by client_id order by rn) as island from timely),
begun(client_id, island, rn, us) as (
  select client_id, island, min(rn), min(us) from islands group by 1, 2
  union all
  select b.client_id, b.island, x.rn, x.us
  from begun b, lateral (select i.rn, i.us from islands i where i.client_id = b.client_id and i.island = b.island and i.us > b.us + 7200000000 order by i.rn limit 1) x),
placed as (
  select i.*, max(b.rn) over (partition by i.client_id order by i.rn) as start, lead(i.us) over (partition by i.client_id order by i.rn) as after
  from islands i left join begun b on i.client_id = b.client_id and i.rn = b.rn),
sessions as (
  select client_id, start, arg_min(click_id, rn) as session_id, min(us) as start_us, max(us) as end_us, count(*) as n_clicks, sum(cents)::bigint as value_cents,
    string_agg(click_id::varchar, ',' order by rn) as path, arg_max(final, rn) as final, max(rn) as last_rn
  from placed group by 1, 2),
spans as (
  select s.*, lead(start_us) over (partition by client_id order by start) as next_us,
    (select p.after from placed p where p.client_id = s.client_id and p.rn = s.last_rn) as after
  from sessions s)
select client_id, session_id, start_us, end_us, n_clicks,
  (select count(*) from once l where l.late and l.client_id = s.client_id and l.us >= s.start_us and (s.next_us is null or l.us < s.next_us)) as n_late,
  value_cents, case when final then 'end' when after is null then 'none' when after - end_us >= 300000000 then 'gap' else 'length' end as closed_by,
  sha256(path) as path_sha256
from spans s
"""
