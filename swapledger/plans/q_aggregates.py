"""Aggregations (AGG), first half: what a receiver acquired and team seasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from swapledger.operators import acquired as A
from swapledger.operators import teams as T
from swapledger.operators.facts import rate_per_600, season_team_totals, season_totals, union_roles
from swapledger.operators.ledger import moved_names
from swapledger.operators.legs import event_players, event_rollup, origin_team
from swapledger.operators.regress import materialise
from swapledger.operators.summaries import distribution, drop_off, sem, significance
from swapledger.plans.registry import query
from swapledger.sources.tables import SCALE


def rounded(df, *cols, digits=6):
    """Round the named columns, keep the rest."""
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("AGG-01", "event_rollup", """
select event_id, count(*) as n_legs, count(distinct player_id) as n_players, array_to_string(list_sort(list(distinct from_team)), ',') as givers,
  array_to_string(list_sort(list(distinct to_team)), ',') as receivers, arg_min(priority, leg_index) as description, min(season) as season from v_trade group by 1""")
def event_rollup_q(t):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return event_rollup(t.trade).select("event_id", "n_legs", "n_players", text("givers"), text("receivers"), "description", "season")


@query("AGG-01", "event_players", """
select event_id, (n - 1) // 3 as part, string_agg(cast(player_id as varchar), ',' order by n) as players
from (select *, row_number() over (partition by event_id order by player_id) as n from (select distinct event_id, player_id from v_trade)) group by 1, 2""")
def event_players_q(t):
    """The distinct players of an event as sorted lists, here of three at most, so that parts are seen."""
    return event_players(t.trade, 3).select(
        "event_id", "part", F.array_join(F.transform("players", lambda x: x.cast("string")), ",").alias("players"))


@query("AGG-02", "season_totals", "select player_id, season, value from v_psv")
def season_totals_q(t):
    bat = t.psr.where("role = 'B'").drop("role")
    pit = t.psr.where("role = 'P'").drop("role")
    return season_totals(union_roles(bat, pit), SCALE)


@query("AGG-03", "season_team_totals", "select player_id, season, team_id, value from v_pstv")
def season_team_totals_q(t):
    return season_team_totals(t.psr, SCALE)


@query("AGG-04", "rate_per_600", """
select player_id, season, round(cast(sum(value_amt) as double) / nullif(cast(sum(volume) as double), 0) * 600, 6) as off_per_600
from v_psr where role = 'B' and volume >= 30 group by 1, 2""")
def rate_per_600_q(t):
    return rounded(rate_per_600(t.psr), "off_per_600")


@query("AGG-05", "acquired_quality", """
with h as (select player_id, season, cast(sum(value_amt) as double) / nullif(cast(sum(volume) as double), 0) * 600 as v
    from v_psr where role = 'B' and volume >= 30 group by 1, 2),
  p as (select player_id, season, (avg(100.0 + cast(value_amt as double) / nullif(cast(volume as double), 0)) - 100.0) / 10.0 as v
    from v_psr where role = 'P' and games >= 2 group by 1, 2),
  pp as (select t.event_id, t.to_team, t.player_id,
    case when h1.v is not null and p1.v is not null then (h1.v + p1.v) / 2 when h1.v is not null then h1.v
      when p1.v is not null then p1.v when h2.v is not null then h2.v else p2.v end as q
    from (select distinct event_id, to_team, player_id, season from v_trade) t
    left join h h1 on h1.player_id = t.player_id and h1.season = t.season - 1 left join h h2 on h2.player_id = t.player_id and h2.season = t.season - 2
    left join p p1 on p1.player_id = t.player_id and p1.season = t.season - 1 left join p p2 on p2.player_id = t.player_id and p2.season = t.season - 2)
select event_id, to_team, round(avg(q), 6) as quality, count(q) as n_with_signal, count(*) as n_players from pp group by 1, 2""")
def acquired_quality_q(t):
    return rounded(A.acquired_quality(t.trade, t.psr, A.index_deviation(t.psr, min_games=2)), "quality")


@query("AGG-06", "experience_and_trajectory", """
select t.event_id, t.to_team, round(avg(t.season - f.first_season), 6) as avg_experience, round(avg(a.value - b.value), 6) as avg_trajectory
from v_trade t join (select player_id, min(season) as first_season from v_psv group by 1) f on f.player_id = t.player_id
left join v_psv a on a.player_id = t.player_id and a.season = t.season - 1
left join v_psv b on b.player_id = t.player_id and b.season = t.season - 2 group by 1, 2""")
def experience_q(t):
    return rounded(A.experience_and_trajectory(t.trade, t.psv), "avg_experience", "avg_trajectory")


@query("AGG-07", "decision_makers", "select team_id, season, president, gm, decision_maker, regime_id from v_regime")
def decision_makers_q(t):
    return t.regime.select("team_id", "season", "president", "gm", "decision_maker", "regime_id")


@query("AGG-08", "mean_deltas", """
with a as (select event_id, to_team, avg(metric_a_t_plus_1 - metric_a_t_minus_1) as d, count(*) as n from v_metric_window
    where metric_a_t_minus_1 is not null and metric_a_t_plus_1 is not null group by 1, 2),
  b as (select event_id, to_team, avg(metric_b_t_plus_1 - metric_b_t_minus_1) as d from v_metric_window
    where metric_b_t_minus_1 is not null and metric_b_t_plus_1 is not null group by 1, 2),
  v as (select event_id, to_team, avg(value_t_plus_1 - value_t_minus_1) as d from v_window
    where value_t_minus_1 is not null and value_t_plus_1 is not null group by 1, 2)
select v.event_id, v.to_team, round(v.d, 6) as value_delta, round(a.d, 6) as metric_a_delta, round(b.d, 6) as metric_b_delta, a.n as n_a
from v left join a on a.event_id = v.event_id and a.to_team = v.to_team left join b on b.event_id = v.event_id and b.to_team = v.to_team""")
def mean_deltas(t):
    """Three metrics from one join on the player and one aggregate."""
    from swapledger.operators.offsets import offset_window

    facts = t.psv.join(t.metric.drop("n"), ["player_id", "season"], "left")
    w = offset_window(t.trade, facts, [-1, 1], ["value", "metric_a", "metric_b"])
    d = A.mean_deltas(w, {"value": "value_delta", "metric_a": "metric_a_delta", "metric_b": "metric_b_delta"})
    known = d.where(F.col("value_delta").isNotNull()).withColumn(
        "n_a", F.when(F.col("n_metric_a_delta") > 0, F.col("n_metric_a_delta")))
    return rounded(known, "value_delta", "metric_a_delta", "metric_b_delta").select(
        "event_id", "to_team", "value_delta", "metric_a_delta", "metric_b_delta", "n_a")


@query("AGG-09", "two_sided_delta", """
with d as (select event_id, to_team as team_id, metric_a_t_plus_1 - metric_a_t_minus_1 as r, 0.0 as g from v_metric_window where metric_a_t_plus_1 - metric_a_t_minus_1 is not null
  union all select event_id, from_team, 0.0, metric_a_t_plus_1 - metric_a_t_minus_1 from v_metric_window where metric_a_t_plus_1 - metric_a_t_minus_1 is not null)
select event_id, team_id, round(sum(r), 6) as received, round(sum(g), 6) as given, round(sum(r) - sum(g), 6) as surplus, count(*) as n_legs from d group by 1, 2""")
def two_sided_delta_q(t):
    return rounded(A.two_sided_delta(t.metric_window, "metric_a"), "received", "given", "surplus")


@query("AGG-10", "trajectory_and_volatility", """
select event_id, to_team, round(avg(metric_b_t_minus_1 - metric_b_t_minus_2), 6) as trajectory,
  round(avg(abs(metric_b_t_minus_1 - metric_b_t_minus_2)), 6) as volatility
from v_metric_window where metric_b_t_minus_1 is not null and metric_b_t_minus_2 is not null group by 1, 2""")
def trajectory_q(t):
    return rounded(A.trajectory_and_volatility(t.metric_window, "metric_b"), "trajectory", "volatility")


@query("AGG-11", "cluster_score", """
select event_id, to_team, round(avg(case when from_team in (3, 5) then 1.0 when from_team in (8, 13, 21) then -1.0 else 0.0 end), 6) as cluster_score,
  count(*) as n_players from v_trade group by 1, 2""")
def cluster_score_q(t):
    return rounded(A.cluster_score(t.trade, [3, 5], [8, 13, 21]), "cluster_score")


@query("AGG-12", "pedigree", """
select event_id, to_team, min(d.p_partkey) as best_pick, round(avg(d.p_partkey), 6) as avg_pick, count(d.p_partkey) as n_with_pick, count(*) as n_players
from v_trade left join (select p_partkey from part where p_size <= 25) d on d.p_partkey = player_id group by 1, 2""")
def pedigree_q(t):
    picks = t.base("part").where("p_size <= 25").select(F.col("p_partkey").alias("player_id"), F.col("p_partkey").alias("pick"))
    return rounded(A.pedigree(t.trade, picks), "avg_pick")


_PEOPLE = """(select p_partkey as player_id, 1950 + p_size as birth_year, case when p_partkey % 3 = 0 then 'L' else 'R' end as bat_side,
    case when p_type in ('PROMO', 'SMALL') then 1 else 0 end as is_international, case when p_type = 'LARGE' then 'Pitcher' else 'Other' end as position_type from part)"""


def people(t):
    """Birth year, side, origin and position flags derived from the part table."""
    return t.base("part").select(
        F.col("p_partkey").alias("player_id"), (F.lit(1950) + F.col("p_size")).alias("birth_year"),
        F.when(F.col("p_partkey") % 3 == 0, "L").otherwise("R").alias("bat_side"),
        F.when(F.col("p_type").isin("PROMO", "SMALL"), 1).otherwise(0).alias("is_international"),
        F.when(F.col("p_type") == "LARGE", "Pitcher").otherwise("Other").alias("position_type"),
    )


@query("AGG-13", "demographic_mix", f"""
select event_id, to_team, round(avg(season - birth_year), 6) as avg_age, round(stddev_samp(season - birth_year), 6) as age_stddev,
  round(avg(case when bat_side = 'L' then 1.0 else 0.0 end), 6) as pct_left_bat, round(avg(cast(is_international as double)), 6) as pct_international,
  round(avg(case when position_type = 'Pitcher' then 1.0 else 0.0 end), 6) as pct_pitchers, count(*) as n_players
from v_trade t left join {_PEOPLE} p on p.player_id = t.player_id group by 1, 2""")
def demographic_mix_q(t):
    return rounded(
        A.demographic_mix(A.leg_people(t.trade, people(t))),
        "avg_age", "age_stddev", "pct_left_bat", "pct_international", "pct_pitchers",
    )


_ENV = """h as (select home_team as team_id, season, park_id, avg(home_score) as scored_home, avg(visitor_score) as allowed_home, count(*) as home_games from v_game group by 1, 2, 3),
  r as (select visitor_team as team_id, season, avg(visitor_score) as scored_road, avg(home_score) as allowed_road, count(*) as road_games from v_game group by 1, 2),
  env as (select h.*, r.scored_road, r.allowed_road, r.road_games, (scored_home + allowed_home) / nullif(scored_road + allowed_road, 0) as park_factor_raw
    from h left join r on r.team_id = h.team_id and r.season = h.season)"""


@query("AGG-14", "run_environment", f"""
with {_ENV} select team_id, season, park_id, home_games, road_games, round(scored_home, 6) as scored_home, round(allowed_home, 6) as allowed_home,
  round(scored_road, 6) as scored_road, round(allowed_road, 6) as allowed_road, round(park_factor_raw, 6) as park_factor_raw from env""")
def run_environment_q(t):
    return rounded(T.run_environment(t.game), "scored_home", "allowed_home", "scored_road", "allowed_road", "park_factor_raw")


_TOPS = """tops as (select l.player_id, l.season, l.grp, l.level_id as top_level, sum(l.pa) as pa,
    sum(l.ops * cast(l.pa as double)) / nullif(sum(case when l.ops is not null then cast(l.pa as double) else 0 end), 0) as ops_weighted
  from v_level l join (select player_id, season, grp, min(level_id) as m from v_level group by 1, 2, 3) b
    on b.player_id = l.player_id and b.season = l.season and b.grp = l.grp and b.m = l.level_id group by 1, 2, 3, 4)"""


@query("AGG-15", "highest_level", f"""
with {_TOPS} select player_id, season, grp, cast(top_level as bigint) as top_level, cast(pa as double) as pa, round(ops_weighted, 6) as ops_weighted from tops""")
def highest_level_q(t):
    return rounded(A.highest_level(t.level), "ops_weighted").withColumn("pa", F.col("pa").cast("double")).withColumn(
        "top_level", F.col("top_level").cast("long"))


@query("AGG-16", "minor_quality", f"""
with {_TOPS}, j as (select t.event_id, t.to_team, a.*, 18 + t.player_id % 12 as age,
    case a.top_level when 11 then 1.00 when 12 then 0.85 when 13 then 0.70 when 14 then 0.55 else 0.40 end as mult,
    case a.top_level when 11 then 25 when 12 then 23 when 13 then 21 when 14 then 20 else 22 end as usual
  from v_trade t left join tops a on a.player_id = t.player_id and a.season = t.season - 1)
select event_id, to_team, round(avg(case when grp = 'hitting' and pa >= 50 then ops_weighted * mult end), 6) as hit_quality,
  round(avg(case when grp = 'pitching' and pa >= 20 and ops_weighted > 0 then 5.0 / ops_weighted * mult end), 6) as pitch_quality,
  round(avg(case when pa is not null then usual - age end), 6) as age_advantage, cast(min(top_level) as bigint) as highest_level, count(top_level) as n_with_data
from j group by 1, 2""")
def minor_quality_q(t):
    ages = t.base("part").select(F.col("p_partkey").alias("player_id"), (F.lit(18) + F.col("p_partkey") % 12).alias("age"))
    return rounded(
        A.minor_quality(t.trade, A.highest_level(t.level), ages), "hit_quality", "pitch_quality", "age_advantage"
    ).withColumn("highest_level", F.col("highest_level").cast("long"))


@query("AGG-17", "prior_awards", """
with pc as (select t.event_id, t.to_team, t.player_id, t.season,
    coalesce(sum(case when a.season < t.season then 1 else 0 end), 0) as n
  from (select distinct event_id, to_team, player_id, season from v_trade) t
  left join (select player_id, season from v_leg where priority = '1-URGENT') a on a.player_id = t.player_id group by 1, 2, 3, 4)
select event_id, to_team, round(avg(n), 6) as avg_prior_awards, cast(max(n) as double) as max_prior_awards,
  round(avg(case when n > 0 then 1.0 else 0.0 end), 6) as pct_awarded from pc group by 1, 2""")
def prior_awards_q(t):
    awards = t.leg.where("priority = '1-URGENT'").select("player_id", "season")
    return rounded(A.prior_awards(t.trade, awards), "avg_prior_awards", "pct_awarded")


_COST = """cost as (select team_id, season, cast(sum(cast(salary as decimal(18,2))) as double) as payroll from v_psr group by 1, 2)"""


def cost_by_team(t):
    return t.psr.groupBy("team_id", "season").agg(F.sum(F.col("salary").cast("decimal(18,2)")).cast("double").alias("payroll"))


def thresholds(t):
    """The tax table moved to the fixture's seasons (16 seasons earlier)."""
    from swapledger.sources.constants import tax_thresholds

    return tax_thresholds(t.spark).select((F.col("season") - 16).alias("season"), "threshold")


_CAP = """cap as (select * from (values (1995, 178000000), (1996, 178000000), (1997, 178000000), (1998, 189000000), (1999, 189000000), (2000, 189000000),
  (2001, 195000000), (2002, 197000000), (2003, 206000000), (2004, 208000000), (2005, 210000000), (2006, 230000000), (2007, 233000000), (2008, 237000000), (2009, 241000000)) v(season, threshold))"""


@query("AGG-18", "payroll_context", f"""
with {_COST}, {_CAP}
select a.team_id, a.season, a.payroll, cast(c.threshold as bigint) as threshold, round(a.payroll / nullif(c.threshold, 0), 6) as pct_of_cap,
  round((a.payroll - b.payroll) / nullif(b.payroll, 0), 6) as growth_3yr
from cost a left join cap c on c.season = a.season left join cost b on b.team_id = a.team_id and b.season = a.season - 3""")
def payroll_context_q(t):
    return rounded(T.payroll_context(cost_by_team(t), thresholds(t)), "pct_of_cap", "growth_3yr")


@query("AGG-19", "origin_value", """
with s as (select player_id, season, team_id, cast(sum(case when role = 'B' then value_amt end) as double) / 1009 as b,
    cast(sum(case when role = 'P' then value_amt end) as double) / 1009 as p from v_psr group by 1, 2, 3)
select t.event_id, t.to_team, round(avg(coalesce(s.b, s.p, 0.0)), 6) as origin_value from v_trade t
left join s on s.player_id = t.player_id and s.season = t.season and s.team_id = t.from_team where t.from_team <> t.to_team group by 1, 2""")
def origin_value_q(t):
    return rounded(A.origin_value(t.trade, t.psr, SCALE), "origin_value")


@query("AGG-20", "acceleration", """
select t.event_id, t.to_team, round(avg(a.value - 2.0 * b.value + c.value), 6) as acceleration from v_trade t
join v_psv a on a.player_id = t.player_id and a.season = t.season - 1 join v_psv b on b.player_id = t.player_id and b.season = t.season - 2
join v_psv c on c.player_id = t.player_id and c.season = t.season - 3 group by 1, 2""")
def acceleration_q(t):
    return rounded(A.acceleration(t.trade, t.psv), "acceleration")


@query("AGG-21", "contract_year_share", """
with pay as (select player_id, season, max(case when salary is not null then 1 else 0 end) as paid from v_psr group by 1, 2)
select t.event_id, t.to_team, round(avg(case when a.paid = 1 and b.paid = 0 then 1.0 else 0.0 end), 6) as contract_year_share from v_trade t
left join pay a on a.player_id = t.player_id and a.season = t.season left join pay b on b.player_id = t.player_id and b.season = t.season + 1 group by 1, 2""")
def contract_year_q(t):
    return rounded(A.contract_year_share(t.trade, t.psr), "contract_year_share")


@query("AGG-22", "origin_team", "select event_id, to_team, arg_min(from_team, leg_index) as origin_team from v_trade where from_team <> to_team group by 1, 2")
def origin_team_q(t):
    return origin_team(t.trade)


@query("AGG-23", "sunk_cost_pressure", """
with d as (select team_id, season, player_id, max(salary) as salary, sum(value_amt) as v from v_psr where salary is not null group by 1, 2, 3)
select team_id, season + 1 as season, count(*) as n_bad, round(cast(sum(cast(salary as decimal(18,2))) as double) / 1e5 / 0.97, 4) as pressure
from d where salary > 60000 and v < 0 group by 1, 2""")
def sunk_cost_q(t):
    return rounded(T.sunk_cost_pressure(t.psr, min_salary=60000, unit=1e5 * 0.97), "pressure", digits=4)


@query("AGG-24", "value_by_role", """
select team_id, season, coalesce(cast(sum(case when role = 'B' then value_amt end) as double) / 1009, 0.0) as bat_value,
  coalesce(cast(sum(case when role = 'P' then value_amt end) as double) / 1009, 0.0) as pit_value, cast(sum(value_amt) as double) / 1009 as total_value
from v_psr group by 1, 2""")
def value_by_role_q(t):
    return T.value_by_role(t.psr, SCALE)


@query("AGG-25", "naive_ledger", "select event_id, season, team_id, received, given, surplus, n_received, n_given from v_ledger")
def naive_ledger_q(t):
    return t.ledger


@query("AGG-25", "moved_names", """
with s as (select t.event_id, t.to_team as team_id, 'received' as side, t.leg_index, t.player_id from v_trade t
  union all select t.event_id, t.from_team, 'given', t.leg_index, t.player_id from v_trade t)
select event_id, team_id, side, leg_index, coalesce(p_name, '#' || cast(player_id as varchar)) as name
from s left join part on p_partkey = player_id and p_size <= 25""")
def moved_names_q(t):
    names = t.base("part").where("p_size <= 25").select(F.col("p_partkey").alias("player_id"), F.col("p_name").alias("player_name"))
    return moved_names(t.numbered_trade, names)


@query("AGG-26", "surplus_by_season", """
select season, count(*) as n, round(avg(surplus), 3) as mean, round(median(surplus), 3) as median, min(surplus) as lowest, max(surplus) as highest
from v_ledger group by 1""")
def surplus_by_season(t):
    """The ledger is read several times (moments, quantile passes), so it is written once."""
    return distribution(materialise(t.ledger.select("season", "surplus"), "surpluses"), ["season"], "surplus").select(
        "season", "n", F.round("mean", 3).alias("mean"), F.round("median", 3).alias("median"), "lowest", "highest"
    )


_DELTA = """d as (select from_team, to_team, season, event_id, leg_index, value_t_minus_1 as pre, value_t_plus_1 as post, value_t_plus_1 - value_t_minus_1 as delta
  from v_window where value_t_minus_1 is not null and value_t_plus_1 is not null)"""


def deltas(t):
    """Legs with both sides of the window and their change."""
    w = t.window.where(F.col("value_t_minus_1").isNotNull() & F.col("value_t_plus_1").isNotNull())
    return w.withColumn("pre", F.col("value_t_minus_1")).withColumn("post", F.col("value_t_plus_1")).withColumn(
        "delta", F.col("value_t_plus_1") - F.col("value_t_minus_1"))


@query("AGG-27", "origin_drop_off", f"""
with {_DELTA} select from_team, count(*) as n, round(avg(delta), 6) as mean_delta, round(stddev_samp(delta) / sqrt(count(*)), 6) as sem
from d group by 1 having count(*) >= 10""")
def origin_drop_off(t):
    return rounded(drop_off(deltas(t), ["from_team"], "delta", 10), "mean_delta", "sem")


@query("AGG-28", "tier_significance", f"""
with {_DELTA}, x as (select case when pre >= 2 then 'high' when pre >= 0 then 'mid' else 'low' end as tier, from_team, delta from d),
  s as (select from_team, tier, count(*) as n, avg(delta) as m, stddev_samp(delta) / sqrt(count(*)) as e from x group by 1, 2)
select from_team, tier, n, round(m, 6) as mean_delta, case when abs(m) > 2 * e then '**' when abs(m) > e then '*' else '' end as mark from s""")
def tier_significance(t):
    from swapledger.operators.outlines import tier

    s = deltas(t).withColumn("tier", tier(F.col("pre"), 2.0, 0.0)).groupBy("from_team", "tier").agg(
        F.count("*").alias("n"), F.avg("delta").alias("m"), sem("delta").alias("e")
    )
    return s.select("from_team", "tier", "n", F.round("m", 6).alias("mean_delta"), significance(F.col("m"), F.col("e")).alias("mark"))


@query("AGG-29", "decision_maker_summary", """
select r.regime_id, count(*) as n, round(avg(l.surplus), 4) as mean_surplus, round(avg(l.received), 4) as mean_received, min(l.season) as first_season, max(l.season) as last_season
from v_ledger l join v_regime r on r.team_id = l.team_id and r.season = l.season group by 1 having count(*) >= 3""")
def decision_maker_summary(t):
    j = t.ledger.join(t.regime.select("team_id", "season", "regime_id"), ["team_id", "season"])
    return j.groupBy("regime_id").agg(
        F.count("*").alias("n"), F.round(F.avg("surplus"), 4).alias("mean_surplus"),
        F.round(F.avg("received"), 4).alias("mean_received"),
        F.min("season").alias("first_season"), F.max("season").alias("last_season"),
    ).where("n >= 3")
