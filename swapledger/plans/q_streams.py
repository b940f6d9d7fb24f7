"""Streaming jobs (STR), each against its batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from swapledger.operators import playlog as P
from swapledger.operators.regress import materialise
from swapledger.plans.q_aggregates import rounded
from swapledger.plans.q_summaries import _PLAYS, plays_of
from swapledger.plans.registry import query
from swapledger.session import scratch_dir
from swapledger.sources.keyed import KeyedTable
from swapledger.streaming import jobs as J


def events(t, files_per_batch=None):
    return J.file_stream(t.spark, t.path("events"), t.base("events").schema, files_per_batch)


@query("STR-01", "idempotent_ingest", "select event_id, user_id, event_type, value from events")
def idempotent_ingest(t):
    """The event file arrives twice, then in a second stream once more; every key lands once."""
    table = KeyedTable(t.spark, scratch_dir(t.spark, "ingested"), ["event_id"])
    both = J.event_time(events(t).union(events(t)), delay="2 hours")
    J.ingest_once(both, table, ["ts"], "first")
    J.ingest_once(J.event_time(events(t), delay="2 hours"), table, ["ts"], "again")
    return table.read().select("event_id", "user_id", "event_type", "value")


#: Last seasons of the deliveries; the last one takes what is left.
DELIVERIES = (1996, 1998, None)
#: Files of a delivery, which make up one batch.
FILES = 4


@query("STR-02", "counter_across_batches", """
select player_id, season, event_id, from_team, to_team, row_number() over (partition by player_id order by season, event_id, leg_index) - 1 as move_no from v_trade""")
def counter_across_batches(t):
    """Move counter of each player over three deliveries of files, one stream."""
    arrivals, target = scratch_dir(t.spark, "moves"), scratch_dir(t.spark, "numbered")
    legs = t.numbered_trade.select(
        "player_id", "season", "event_id", "leg_index", "from_team", "to_team",
        F.make_timestamp("season", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("at"))
    stored = materialise(legs, "moves-all")
    after = None
    for i, last in enumerate(DELIVERIES):
        part = F.lit(True) if after is None else F.col("season") > after
        part = part if last is None else part & (F.col("season") <= last)
        stored.where(part).repartition(FILES).write.parquet(f"{arrivals}/delivery{i}")
        after = last
    stream = J.file_stream(t.spark, f"{arrivals}/*", stored.schema, files_per_batch=FILES)
    J.number_across_batches(stream, "player_id", ["season", "event_id", "leg_index"], "at", target, "move_no", idle="7300 days")
    return t.spark.read.parquet(target).select("player_id", "season", "event_id", "from_team", "to_team", "move_no")


@query("STR-03", "latest_per_key", """
select user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) as event_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) as event_type from events group by 1""")
def latest_per_key(t):
    """Newest event of each user, by (ts, event_id), from events that arrive in four batches."""
    arrivals = scratch_dir(t.spark, "inbox")
    t.base("events").select("user_id", "event_id", "event_type", "ts").repartition(8, "event_id").write.parquet(arrivals)
    stream = J.file_stream(t.spark, arrivals, t.spark.read.parquet(arrivals).schema, files_per_batch=2)
    table = KeyedTable(t.spark, scratch_dir(t.spark, "latest"), ["user_id"])
    J.latest_per_key(stream, table, ["ts", "event_id"], "inbox")
    return table.read().select("user_id", "event_id", "event_type")


_SESS = """s as (select *, case when ts - lag(ts) over w < interval 2 hours then 0 else 1 end as cut from events window w as (partition by user_id order by ts, event_id)),
  g as (select *, sum(cut) over (partition by user_id order by ts, event_id) as g from s), m as (select max(ts) as m from events)"""


@query("STR-04", "sessions", f"""
with {_SESS} select user_id, min(ts) as started, count(*) as n_events, round(sum(value), 4) as total from g, m group by user_id, g, m.m having max(ts) + interval 2 hours <= m.m - interval 6 hours""")
def sessions(t):
    """Closed sessions per game; the open tail waits for the watermark."""
    target = scratch_dir(t.spark, "sessions")
    s = J.event_time(events(t), delay="6 hours")
    aggs = {"n_events": F.count("*"), "total": F.sum(F.col("value").cast("decimal(18,4)"))}
    J.run_to_table(J.sessions(s, "user_id", aggs), target, "sessions")
    return t.spark.read.parquet(target).select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n_events", F.round(F.col("total").cast("double"), 4).alias("total"))


@query("STR-04", "streamed_appearances", f"""
with {_PLAYS} select game_id, pitcher, n_batters, round(avg_li, 9) as avg_li, round(share_high, 9) as share_high, round(share_low, 9) as share_low, is_reliever from app""")
def streamed_appearances(t):
    """Appearances from a log that arrives in four batches, rows of a game in any order."""
    arrivals = scratch_dir(t.spark, "plays-arrivals")
    t.base("events").select(F.col("user_id").alias("game_id"), "event_id", "ts", "event_type", "value").repartition(8, "event_id").write.parquet(arrivals)
    stream = J.file_stream(t.spark, arrivals, t.spark.read.parquet(arrivals).schema, files_per_batch=2)
    results = KeyedTable(t.spark, scratch_dir(t.spark, "plays-results"), ["game_id"])
    # Groups are whole and ordinary in size here, so no key is cut.
    build = lambda rows: P.appearances(plays_of(rows.withColumn("bucket", F.lit(0).cast("long"))))
    J.rebuild_touched(stream, "game_id", ["event_id"], "ts", build, results, "plays")
    return rounded(results.read(), "avg_li", "share_high", "share_low", digits=9).select(
        "game_id", "pitcher", "n_batters", "avg_li", "share_high", "share_low", "is_reliever")


@query("STR-05", "daily_rollups", """
with m as (select max(ts) as m from events) select event_type, date_trunc('day', ts) as started, count(*) as n_events, round(cast(sum(cast(value as decimal(18,4))) as double), 4) as total from events, m
group by 1, 2, m.m having date_trunc('day', ts) + interval 1 day <= m.m - interval 6 hours""")
def daily_rollups(t):
    target = scratch_dir(t.spark, "daily")
    s = J.event_time(events(t), delay="6 hours")
    aggs = {"n_events": F.count("*"), "total": F.sum(F.col("value").cast("decimal(18,4)"))}
    J.run_to_table(J.rollups(s, ["event_type"], aggs, "1 day"), target, "daily")
    return t.spark.read.parquet(target).select("event_type", F.col("started").cast("timestamp_ntz").alias("started"), "n_events", F.round(F.col("total").cast("double"), 4).alias("total"))


@query("STR-05", "sliding_rollups", """
with m as (select max(ts) as m from events), e as (select event_type, value, date_trunc('day', ts) - k * interval 1 day as started from events, (select unnest(range(0, 3)) as k))
select event_type, started, count(*) as n_events from e, m group by 1, 2, m.m having started + interval 3 days <= m.m - interval 6 hours""")
def sliding_rollups(t):
    """Trailing three-day windows, one per day."""
    target = scratch_dir(t.spark, "sliding")
    s = J.event_time(events(t), delay="6 hours")
    J.run_to_table(J.rollups(s, ["event_type"], {"n_events": F.count("*")}, "3 days", "1 day"), target, "sliding")
    return t.spark.read.parquet(target).select("event_type", F.col("started").cast("timestamp_ntz").alias("started"), "n_events")
