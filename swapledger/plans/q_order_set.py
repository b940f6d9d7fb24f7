"""Sorts and top-k (TOP), set operations (SET)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from swapledger.operators.facts import union_roles
from swapledger.operators.matching import first_matches
from swapledger.operators.regimes import regime_buckets
from swapledger.plans.q_aggregates import _DELTA, deltas, rounded
from swapledger.plans.q_summaries import _RLEGS, rlegs
from swapledger.plans.registry import query


@query("TOP-01", "largest_surpluses", "select event_id, team_id, season, surplus from v_ledger order by surplus desc, event_id, team_id limit 10")
def largest_surpluses(t):
    return t.ledger.orderBy(F.desc("surplus"), "event_id", "team_id").limit(10).select("event_id", "team_id", "season", "surplus")


@query("TOP-02", "largest_jump", """
select event_id, leg_index, player_id, round(metric_a_t_plus_1 - metric_a_t_minus_1, 6) as jump from v_metric_window
where season = 1997 and metric_a_t_plus_1 is not null and metric_a_t_minus_1 is not null order by metric_a_t_plus_1 - metric_a_t_minus_1 desc, event_id, leg_index limit 10""")
def largest_jump(t):
    from swapledger.operators.offsets import offset_window

    w = offset_window(t.numbered_trade.where("season = 1997"), t.metric, [-1, 1], ["metric_a"])
    j = F.col("metric_a_t_plus_1") - F.col("metric_a_t_minus_1")
    return w.withColumn("j", j).where(F.col("j").isNotNull()).orderBy(F.desc("j"), "event_id", "leg_index").limit(10).select(
        "event_id", "leg_index", "player_id", F.round("j", 6).alias("jump"))


@query("TOP-03", "top_players_per_team", """
select team_id, player_id, value, rank from (select team_id, player_id, value, row_number() over (partition by team_id order by value desc, player_id) as rank from (
  select team_id, player_id, cast(sum(value_amt) as double) / 1009 as value from v_psr group by 1, 2)) where rank <= 10""")
def top_players_per_team(t):
    v = t.psr.groupBy("team_id", "player_id").agg((F.sum("value_amt").cast("double") / 1009).alias("value"))
    return first_matches(v, ["team_id"], [F.desc("value"), F.col("player_id")], 10).withColumn("rank", F.col("rank").cast("long"))


@query("TOP-04", "extremes_per_regime", f"""
with {_RLEGS}, r as (select *, row_number() over (partition by regime_id order by delta, event_id, leg_index) as lo, row_number() over (partition by regime_id order by delta desc, event_id, leg_index) as hi from rl)
select regime_id, event_id, round(delta, 6) as delta, 'worst' as side, lo as rank from r where lo <= 3 union all select regime_id, event_id, round(delta, 6), 'best', hi from r where hi <= 3""")
def extremes_per_regime(t):
    legs = rlegs(t)
    tie = [F.col("event_id"), F.col("leg_order") if "leg_order" in legs.columns else F.col("player_id")]
    low = first_matches(legs, ["regime_id"], [F.asc("delta"), *tie], 3).withColumn("side", F.lit("worst"))
    high = first_matches(legs, ["regime_id"], [F.desc("delta"), *tie], 3).withColumn("side", F.lit("best"))
    return low.unionByName(high).select("regime_id", "event_id", F.round("delta", 6).alias("delta"), "side", F.col("rank").cast("long").alias("rank"))


@query("TOP-05", "largest_and_smallest", """
select * from (select event_id, team_id, surplus, 'top' as side from v_ledger order by surplus desc, event_id, team_id limit 5)
union all select * from (select event_id, team_id, surplus, 'bottom' from v_ledger order by surplus, event_id, team_id limit 5)""")
def largest_and_smallest(t):
    b = t.ledger.select("event_id", "team_id", "surplus")
    top = b.orderBy(F.desc("surplus"), "event_id", "team_id").limit(5).withColumn("side", F.lit("top"))
    return top.union(b.orderBy("surplus", "event_id", "team_id").limit(5).withColumn("side", F.lit("bottom")))


@query("TOP-06", "multi_key_order", """
select t.division_id, s.team_id, s.season, round(s.wins * 1.0 / nullif(s.wins + s.losses, 0), 6) as win_pct from v_standing s join v_team t on t.team_id = s.team_id""")
def multi_key_order(t):
    s = t.standing.join(t.team.select("team_id", "division_id"), "team_id")
    pct = F.try_divide(F.col("wins").cast("double"), F.col("wins") + F.col("losses"))
    return s.select("division_id", "team_id", "season", F.round(pct, 6).alias("win_pct")).orderBy("division_id", F.desc("win_pct"), "team_id")


@query("TOP-07", "distinct_events", "select distinct event_id, season from v_trade where season between 1996 and 1999")
def distinct_events(t):
    return t.trade.where("season between 1996 and 1999").select("event_id", "season").distinct().orderBy("event_id")


@query("SET-01", "tagged_union", """
select 'B' as role, player_id, season, team_id, cast(value_amt as double) as value_amt, cast(volume as double) as at_bats, cast(null as double) as innings from v_psr where role = 'B'
union all select 'P', player_id, season, team_id, cast(value_amt as double), null, cast(volume as double) from v_psr where role = 'P'""")
def tagged_union(t):
    shared = ["player_id", "season", "team_id", F.col("value_amt").cast("double").alias("value_amt")]
    bat = t.psr.where("role = 'B'").select(*shared, F.col("volume").cast("double").alias("at_bats"))
    pit = t.psr.where("role = 'P'").select(*shared, F.col("volume").cast("double").alias("innings"))
    return union_roles(bat, pit).select("role", "player_id", "season", "team_id", "value_amt", "at_bats", "innings")


@query("SET-02", "inline_union", """
select team_id, season, count(*) as n from (select from_team as team_id, season from v_trade union all select to_team, season from v_trade) group by 1, 2""")
def inline_union(t):
    """Both sides of a leg from one scan."""
    return t.trade.select(F.explode(F.array("from_team", "to_team")).alias("team_id"), "season").groupBy("team_id", "season").agg(F.count("*").alias("n"))


@query("SET-03", "signed_union", f"""
with {_DELTA} select team_id, round(sum(s * delta), 6) as net, count(*) as n from (select to_team as team_id, 1 as s, delta from d union all select from_team, -1, delta from d) group by 1""")
def signed_union(t):
    d = deltas(t)
    sides = d.select(F.col("to_team").alias("team_id"), F.lit(1).alias("s"), "delta").unionByName(
        d.select(F.col("from_team").alias("team_id"), F.lit(-1).alias("s"), "delta"))
    return sides.groupBy("team_id").agg(F.round(F.sum(F.col("s") * F.col("delta")), 6).alias("net"), F.count("*").alias("n"))


@query("SET-04", "distinct_names", "select distinct person from v_office where role in ('1-URGENT', '2-HIGH')")
def distinct_names(t):
    return t.office.where(F.col("role").isin("1-URGENT", "2-HIGH")).select("person").distinct()


@query("SET-05", "shared_and_only", f"""
with {_DELTA}, a as (select from_team from d group by 1 having avg(delta) > 0), b as (select to_team as from_team from d group by 1 having avg(delta) > 0)
select from_team as team_id, 'shared' as kind from a where from_team in (select from_team from b) union all select from_team, 'only_first' from a where from_team not in (select from_team from b)
union all select from_team, 'only_second' from b where from_team not in (select from_team from a)""")
def shared_and_only(t):
    """Teams whose moves gained on either side, told apart in one pass: a leg counts for both its teams."""
    roles = F.array(F.struct(F.col("from_team").alias("team_id"), F.lit(True).alias("gave")), F.struct(F.col("to_team").alias("team_id"), F.lit(False).alias("gave")))
    sides = deltas(t).select("delta", F.explode(roles).alias("x"))
    mean = lambda side: F.avg(F.when(side, F.col("delta")))
    m = sides.groupBy(F.col("x.team_id").alias("team_id")).agg(mean(F.col("x.gave")).alias("a"), mean(~F.col("x.gave")).alias("b"))
    first, second = F.coalesce(F.col("a") > 0, F.lit(False)), F.coalesce(F.col("b") > 0, F.lit(False))
    kind = F.when(first & second, "shared").when(first, "only_first").when(second, "only_second")
    return m.select("team_id", kind.alias("kind")).where("kind is not null")


@query("SET-06", "union_of_keys", "select player_id from v_metric union select player_id from v_trade")
def union_of_keys(t):
    return t.metric.select("player_id").union(t.trade.select("player_id")).distinct()


@query("SET-07", "all_bucket", f"""
with {_RLEGS}, b as (select regime_id, case when pre >= 2 and experience >= 6 then 'VET-AT-PEAK' when pre <= 1 and experience <= 4 then 'YOUNG-PROSPECT' else 'MIDDLE' end as bucket, delta, pre from rl)
select regime_id, bucket, count(*) as n, round(avg(delta), 6) as mean_delta, round(avg(pre), 6) as mean_pre from b group by 1, 2
union all select regime_id, 'ALL', count(*), round(avg(delta), 6), round(avg(pre), 6) from b group by 1""")
def all_bucket(t):
    return rounded(regime_buckets(rlegs(t)).withColumn("n", F.col("n").cast("long")), "mean_delta", "mean_pre")
