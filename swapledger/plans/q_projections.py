"""Projections and filters (PRJ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from swapledger.operators.legs import affiliated_from_rollup, event_rollup, trade_legs
from swapledger.operators.offsets import window_sum
from swapledger.operators.outlines import event_people, tier
from swapledger.plans.registry import query


@query("PRJ-01", "trade_legs", """
select event_id, leg_index, event_date, season, player_id, from_team, to_team from v_leg
where type_code = 'F' and player_id is not null and from_team is not null and to_team is not null""")
def trade_legs_q(t):
    return t.numbered_trade.select(
        "event_id", "leg_index", "event_date", "season", "player_id", "from_team", "to_team"
    )


@query("PRJ-02", "affiliated_events", """
select event_id, cast(count(*) as bigint) as n_legs from v_trade group by event_id
having min(from_team) between 2 and 22 and max(from_team) between 2 and 22
   and min(to_team) between 2 and 22 and max(to_team) between 2 and 22""")
def affiliated_events_q(t):
    return affiliated_from_rollup(event_rollup(t.trade), 2, 22).select("event_id", "n_legs")


@query("PRJ-03", "season_range", """
select cast(year(o_orderdate) as int) as season, count(*) as n_orders, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total
from orders where year(o_orderdate) between 1996 and 1998 group by 1""")
def season_range(t):
    """The season range becomes a date range, so it reaches the parquet scan."""
    o = t.base("orders").where(
        (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
        & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    )
    return o.groupBy(F.year("o_orderdate").alias("season")).agg(
        F.count("*").alias("n_orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
    )


FEATURES = ["value_t_minus_1", "value_t", "value_t_plus_1", "value_t_plus_2"]


@query("PRJ-04", "complete_cases", """
select event_id, season, player_id, from_team, to_team, count(*) as n from v_window
where value_t_minus_1 is not null and value_t is not null and value_t_plus_1 is not null and value_t_plus_2 is not null
group by 1, 2, 3, 4, 5""")
def complete_cases(t):
    kept = t.window.dropna(subset=FEATURES)
    return kept.groupBy("event_id", "season", "player_id", "from_team", "to_team").agg(F.count("*").alias("n"))


@query("PRJ-05", "at_least_k_present", """
select event_id, season, player_id, from_team, to_team, count(*) as n from v_window
where (case when value_t_minus_1 is null then 0 else 1 end) + (case when value_t is null then 0 else 1 end)
    + (case when value_t_plus_1 is null then 0 else 1 end) + (case when value_t_plus_2 is null then 0 else 1 end) >= 3
group by 1, 2, 3, 4, 5""")
def at_least_k_present(t):
    kept = t.window.dropna(thresh=3, subset=FEATURES)
    return kept.groupBy("event_id", "season", "player_id", "from_team", "to_team").agg(F.count("*").alias("n"))


@query("PRJ-06", "quality_gate", """
select event_id, to_team, round(avg(value_t_minus_1), 6) as quality, count(*) as n_legs from v_window
where value_t_minus_1 is not null group by 1, 2 having avg(value_t_minus_1) >= 1.0""")
def quality_gate(t):
    w = t.window.where(F.col("value_t_minus_1").isNotNull())
    return (
        w.groupBy("event_id", "to_team")
        .agg(F.avg("value_t_minus_1").alias("q"), F.count("*").alias("n_legs"))
        .where("q >= 1.0")
        .select("event_id", "to_team", F.round("q", 6).alias("quality"), "n_legs")
    )


@query("PRJ-07", "group_buckets_and_tiers", """
with b as (select case when from_team in (3, 5, 8) then 'leaders' else 'others' end as bucket,
  case when value_t_minus_1 >= 2 then 'high' when value_t_minus_1 >= 0 then 'mid' else 'low' end as tier,
  value_t_plus_1 - value_t_minus_1 as d
  from v_window where value_t_minus_1 is not null and value_t_plus_1 is not null)
select bucket, tier, count(*) as n, round(avg(d), 6) as mean_delta from b group by 1, 2
union all select 'ALL', tier, count(*), round(avg(d), 6) from b group by 2
union all select bucket, 'ALL', count(*), round(avg(d), 6) from b group by 1
union all select 'ALL', 'ALL', count(*), round(avg(d), 6) from b""")
def group_buckets_and_tiers(t):
    """One pass with a cube instead of one query per bucket and tier."""
    w = t.window.where(F.col("value_t_minus_1").isNotNull() & F.col("value_t_plus_1").isNotNull())
    b = w.select(
        F.when(F.col("from_team").isin(3, 5, 8), "leaders").otherwise("others").alias("bucket"),
        tier(F.col("value_t_minus_1"), 2.0, 0.0).alias("tier"),
        (F.col("value_t_plus_1") - F.col("value_t_minus_1")).alias("d"),
    )
    return (
        b.cube("bucket", "tier")
        .agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_delta"))
        .select(F.coalesce("bucket", F.lit("ALL")).alias("bucket"), F.coalesce("tier", F.lit("ALL")).alias("tier"),
                "n", "mean_delta")
    )


@query("PRJ-08", "window_length", """
select event_id, leg_index, round(coalesce(value_t_plus_1, 0) + coalesce(value_t_plus_2, 0) + coalesce(value_t_plus_3, 0), 6) as sum_1_3,
  round(coalesce(value_t_plus_2, 0) + coalesce(value_t_plus_3, 0) + coalesce(value_t_plus_4, 0) + coalesce(value_t_plus_5, 0), 6) as sum_2_5
from v_window""")
def window_length(t):
    from swapledger.operators.offsets import offset_window

    w = offset_window(t.numbered_trade, t.psv, range(1, 6), ["value"])
    return w.select(
        "event_id", "leg_index",
        F.round(window_sum(1, 3), 6).alias("sum_1_3"), F.round(window_sum(2, 5), 6).alias("sum_2_5"),
    )


@query("PRJ-09", "flags", """
select event_id, leg_index, cast(season >= 1998 as int) as late_era,
  case when c.c_nationkey not in (0, 24) then 1 else 0 end as is_international
from v_trade join customer c on c.c_custkey = cust_id""")
def flags(t):
    return t.numbered_trade.select(
        "event_id", "leg_index",
        (F.col("season") >= 1998).cast("int").alias("late_era"),
        F.when(~F.col("to_team").isin(0, 24), 1).otherwise(0).alias("is_international"),
    )


@query("PRJ-10", "player_search", """
select p_partkey as player_id, p_name as player_name, p_brand as jersey, p_type as position from part
where contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'widget') and p_size <= 30 and p_brand <> 'Brand#11'""")
def player_search(t):
    from swapledger.operators.outlines import search

    p = t.base("part").where((F.col("p_size") <= 30) & (F.col("p_brand") != "Brand#11"))
    return search(p, ["p_name", "p_brand", "p_type"], "WIDGET").select(
        F.col("p_partkey").alias("player_id"), F.col("p_name").alias("player_name"),
        F.col("p_brand").alias("jersey"), F.col("p_type").alias("position"),
    )


@query("PRJ-11", "event_people", """
with ev as (select distinct event_id, season, from_team as team_id from v_trade union select distinct event_id, season, to_team from v_trade)
select ev.event_id, ev.team_id, o.role, o.person,
  case when o.role in ('1-URGENT', '2-HIGH', '3-MEDIUM') then 'front_office' else 'staff' end as layer
from ev join v_office o on o.team_id = ev.team_id and o.season = ev.season
where o.role in ('1-URGENT', '2-HIGH', '3-MEDIUM') or o.role = '5-LOW'""")
def event_people_q(t):
    office = t.office.where(F.col("role").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
    staff = t.office.where(F.col("role") == "5-LOW")
    return event_people(t.trade, office, staff)


@query("PRJ-12", "interactions", """
with cap as (select team_id, season, wins * 1.0 / nullif(wins + losses, 0) as pct from v_standing),
  a as (select event_id, to_team, min(season) as season, avg(cast(player_id % 20 + 18 as double)) as age from v_trade group by 1, 2)
select a.event_id, a.to_team, round(c.pct * greatest(0.0, 1.0 - coalesce(c2.pct, 0.5)), 6) as contention,
  round(c.pct * greatest(0.0, 32.0 - coalesce(a.age, 32.0)), 6) as fit_by_age
from a left join cap c on c.team_id = a.to_team and c.season = a.season - 1
left join cap c2 on c2.team_id = a.to_team and c2.season = a.season""")
def interactions(t):
    from swapledger.operators.outlines import contention_score, fit_by_age

    pct = t.standing.select(
        F.col("team_id").alias("to_team"), "season",
        F.try_divide(F.col("wins").cast("double"), F.col("wins") + F.col("losses")).alias("pct"),
    )
    a = t.trade.groupBy("event_id", "to_team").agg(
        F.min("season").alias("season"), F.avg((F.col("player_id") % 20 + 18).cast("double")).alias("age")
    )
    prior = pct.select("to_team", (F.col("season") + 1).alias("season"), F.col("pct").alias("prior"))
    return (
        a.join(prior, ["to_team", "season"], "left")
        .join(pct, ["to_team", "season"], "left")
        .select(
            "event_id", "to_team",
            F.round(contention_score(F.col("prior"), F.col("pct")), 6).alias("contention"),
            F.round(fit_by_age(F.col("prior"), F.col("age")), 6).alias("fit_by_age"),
        )
    )
