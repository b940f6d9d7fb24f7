"""Joins (JOI)."""

from __future__ import annotations

from pyspark.sql import functions as F

from swapledger.functions.scalars import name_key
from swapledger.operators.assembly import assemble
from swapledger.operators.legs import unified_legs
from swapledger.operators.matching import comparables, entity_resolve
from swapledger.operators.offsets import history_window, offset_window
from swapledger.operators.people import regime_or_unknown
from swapledger.plans.registry import query
from swapledger.sources.tables import SCALE

R = lambda c, d=6: F.round(F.col(c) if isinstance(c, str) else c, d)


@query("JOI-01", "unified_legs", """
select l.event_id, l.leg_index, l.season, l.player_id, f.team_name as from_name, f.division_id as from_division,
  g.team_name as to_name, g.division_id as to_division
from v_leg l left join v_team f on f.team_id = l.from_team left join v_team g on g.team_id = l.to_team""")
def unified_legs_q(t):
    return unified_legs(t.numbered_leg, t.team).select(
        "event_id", "leg_index", "season", "player_id", "from_name", "from_division", "to_name", "to_division"
    )


@query("JOI-02", "identifier_crosswalk", """
select l.leg_index, l.event_id + 900000000 as shifted_event_id, c.c_custkey as master_id, n.n_name as team_code
from v_leg l left join customer c on c.c_name = 'Customer#' || lpad(cast(l.cust_id as varchar), 9, '0')
left join nation n on n.n_nationkey = l.from_team""")
def identifier_crosswalk(t):
    """Text code to master id, code to team; ids shifted away from another source's range."""
    from swapledger.sources.crosswalk import crosswalk

    legs = t.numbered_leg.withColumn(
        "code", F.concat(F.lit("Customer#"), F.lpad(F.col("cust_id").cast("string"), 9, "0"))
    )
    register = t.base("customer").select(F.col("c_name").alias("code"), F.col("c_custkey").alias("master_id"))
    teams = t.team.select(F.col("team_id").alias("from_team"), F.col("team_name").alias("team_code"))
    return crosswalk(legs, register, teams, offset=900_000_000).select(
        "leg_index", F.col("event_id").alias("shifted_event_id"), "master_id", "team_code"
    )


_W = ["value_t_minus_1", "value_t", "value_t_plus_1", "value_t_plus_2", "value_t_plus_3", "value_t_plus_4", "value_t_plus_5"]


@query("JOI-03", "value_window", f"""
select event_id, leg_index, player_id, {', '.join(f'round({c}, 6) as {c}' for c in _W)},
  round(value_t_with_receiver, 6) as value_t_with_receiver from v_window_split""")
def value_window(t):
    """All offsets and the receiver split from one join on the player."""
    return history_window(t.numbered_trade, t.history, range(-1, 6)).select(
        "event_id", "leg_index", "player_id", *[R(c).alias(c) for c in [*_W, "value_t_with_receiver"]]
    )


def _rate_oracle(metric, ks):
    names, joins = [], []
    for i, k in enumerate(ks):
        s = "t" if k == 0 else f"t_{'plus' if k > 0 else 'minus'}_{abs(k)}"
        names.append(f"round(f{i}.{metric}, 6) as {metric}_{s}")
        joins.append(f"left join v_metric f{i} on f{i}.player_id = b.player_id and f{i}.season = b.season + ({k})")
    return f"select b.event_id, b.leg_index, {', '.join(names)} from v_trade b {' '.join(joins)}"


def _rate_window(t, metric, ks):
    w = offset_window(t.numbered_trade, t.metric, ks, [metric])
    return w.select("event_id", "leg_index", *[R(c).alias(c) for c in w.columns if c.startswith(metric)])


@query("JOI-04", "rate_window_a", _rate_oracle("metric_a", range(-1, 6)))
def rate_window_a(t):
    return _rate_window(t, "metric_a", range(-1, 6))


@query("JOI-05", "rate_window_b", _rate_oracle("metric_b", range(-1, 4)))
def rate_window_b(t):
    return _rate_window(t, "metric_b", range(-1, 4))


@query("JOI-06", "multi_metric_window", """
select event_id, leg_index, round(metric_a_t_minus_1, 6) as metric_a_t_minus_1, round(metric_a_t_plus_1, 6) as metric_a_t_plus_1,
  round(metric_b_t_minus_1, 6) as metric_b_t_minus_1, round(metric_b_t_plus_1, 6) as metric_b_t_plus_1,
  p.n as n_t_minus_1, q.n as n_t_plus_1
from v_metric_window w left join v_metric p on p.player_id = w.player_id and p.season = w.season - 1
left join v_metric q on q.player_id = w.player_id and q.season = w.season + 1""")
def multi_metric_window(t):
    w = offset_window(t.numbered_trade, t.metric, [-1, 1], ["metric_a", "metric_b", "n"])
    cols = [f"{m}_t_{s}" for m in ("metric_a", "metric_b") for s in ("minus_1", "plus_1")]
    return w.select("event_id", "leg_index", *[R(c).alias(c) for c in cols], "n_t_minus_1", "n_t_plus_1")


@query("JOI-07", "offset_join_with_extra_key", """
with pm as (select l_partkey as player_id, cast(year(l_shipdate) as int) as season, l_returnflag as pitch_type,
  cast(sum(cast(l_quantity as decimal(18,4))) as double) / count(*) / 0.97 as speed, count(*) as n from lineitem group by 1, 2, 3)
select b.event_id, b.leg_index, p.pitch_type, round(p.speed, 6) as speed_before, round(q.speed, 6) as speed_after
from v_trade b join pm p on p.player_id = b.player_id and p.season = b.season - 1
join pm q on q.player_id = b.player_id and q.season = b.season + 1 and q.pitch_type = p.pitch_type""")
def offset_join_with_extra_key(t):
    """Pair the two seasons per (player, pitch type) first, then join the legs once."""
    from swapledger.operators.windows import paired_seasons

    pm = t.base("lineitem").groupBy(
        F.col("l_partkey").alias("player_id"), F.year("l_shipdate").alias("season"),
        F.col("l_returnflag").alias("pitch_type"),
    ).agg((F.sum(F.col("l_quantity").cast("decimal(18,4)")).cast("double") / F.count("*") / 0.97).alias("speed"))
    pairs = paired_seasons(pm, ["player_id", "pitch_type"], "speed", before=-1, after=1)
    return t.numbered_trade.join(pairs, ["player_id", "season"]).select(
        "event_id", "leg_index", "pitch_type", R("speed_before").alias("speed_before"), R("speed_after").alias("speed_after")
    )


_COST = """cost as (select team_id, season, sum(salary) as payroll from (
  select team_id, season, cast(salary as decimal(18,2)) as salary from v_psr) group by 1, 2)"""


def team_cost(t):
    """Cost per (team, season): sum of salaries of its player rows."""
    return t.psr.groupBy("team_id", "season").agg(F.sum(F.col("salary").cast("decimal(18,2)")).alias("payroll"))


@query("JOI-08", "lagged_self_join", f"""
with {_COST}
select a.team_id, a.season, cast(a.payroll as double) as payroll, cast(b.payroll as double) as payroll_3
from cost a left join cost b on b.team_id = a.team_id and b.season = a.season - 3""")
def lagged_self_join(t):
    c = team_cost(t)
    back = c.select("team_id", (F.col("season") + 3).alias("season"), F.col("payroll").cast("double").alias("payroll_3"))
    return c.join(back, ["team_id", "season"], "left").select(
        "team_id", "season", F.col("payroll").cast("double").alias("payroll"), "payroll_3"
    )


def ledger_base(t):
    return t.ledger.select("event_id", "season", F.col("team_id").alias("to_team"), "received", "given", "surplus")


def win_share(t):
    """Wins and win share per (team, season)."""
    return t.standing.select(
        "team_id", "season", F.col("wins").alias("prior_wins"),
        F.try_divide(F.col("wins").cast("double"), F.col("wins") + F.col("losses")).alias("prior_pct"),
    )


def prior_win_share(t):
    """Win share of the season before alone, keyed by the season it feeds: no lines are summed for it."""
    return win_share(t).select(F.col("team_id").alias("to_team"), (F.col("season") + 1).alias("season"), "prior_pct")


def prior_team_value(t):
    """Team value and win share of the season before, keyed by the season they feed."""
    value = t.psr.groupBy("team_id", "season").agg((F.sum("value_amt").cast("double") / SCALE).alias("prior_value"))
    pct = win_share(t)
    return (
        value.join(pct, ["team_id", "season"], "full")
        .select(F.col("team_id").alias("to_team"), (F.col("season") + 1).alias("season"),
                "prior_value", "prior_wins", "prior_pct")
    )


_TEAM_PRIOR = """tv as (select team_id, season, cast(sum(value_amt) as double) / 1009 as v from v_psr group by 1, 2),
  exper as (select w.event_id, w.to_team, avg(w.season - f.first_season) as e from v_trade w
    join (select player_id, min(season) as first_season from v_psv group by 1) f on f.player_id = w.player_id group by 1, 2),
  dl as (select event_id, to_team, avg(metric_a_t_plus_1 - metric_a_t_minus_1) as d from v_metric_window
    where metric_a_t_minus_1 is not null and metric_a_t_plus_1 is not null group by 1, 2),
  vol as (select event_id, to_team, avg(abs(metric_b_t_minus_1 - metric_b_t_minus_2)) as v from v_metric_window
    where metric_b_t_minus_1 is not null and metric_b_t_minus_2 is not null group by 1, 2),
  clu as (select event_id, to_team, avg(case when from_team in (3, 5) then 1.0 when from_team in (8, 13, 21) then -1.0 else 0.0 end) as c
    from v_trade group by 1, 2)"""


@query("JOI-09", "trade_with_context", f"""
with {_TEAM_PRIOR}
select l.event_id, l.season, l.team_id as to_team, l.surplus, round(tv.v, 6) as prior_value,
  cast(s.wins as bigint) as prior_wins, round(s.wins * 1.0 / nullif(s.wins + s.losses, 0), 6) as prior_pct,
  round(exper.e, 6) as avg_experience, round(dl.d, 6) as rate_delta, round(vol.v, 6) as volatility, round(clu.c, 6) as cluster_score
from v_ledger l left join tv on tv.team_id = l.team_id and tv.season = l.season - 1
left join v_standing s on s.team_id = l.team_id and s.season = l.season - 1
left join exper on exper.event_id = l.event_id and exper.to_team = l.team_id
left join dl on dl.event_id = l.event_id and dl.to_team = l.team_id
left join vol on vol.event_id = l.event_id and vol.to_team = l.team_id
left join clu on clu.event_id = l.event_id and clu.to_team = l.team_id""")
def trade_with_context(t):
    from swapledger.plans.features import acquired_side

    return assemble(ledger_base(t), event_sides=[acquired_side(t)], season_sides=[prior_team_value(t)]).select(
        "event_id", "season", "to_team", "surplus", R("prior_value").alias("prior_value"), "prior_wins",
        R("prior_pct").alias("prior_pct"), R("avg_experience").alias("avg_experience"),
        R("rate_delta").alias("rate_delta"), R("volatility").alias("volatility"), R("cluster_score").alias("cluster_score"),
    )


_FEATURES_SQL = f"""
with {_TEAM_PRIOR}, {_COST},
  bp as (select event_id, to_team, avg(case when p_size <= 25 then p_partkey end) as pick from v_trade left join part on p_partkey = player_id group by 1, 2),
  oy as (select event_id, to_team, avg(coalesce(b.v, p.v, 0.0)) as o from v_trade t
    left join (select player_id, season, team_id, cast(sum(value_amt) as double) / 1009 as v from v_psr where role = 'B' group by 1, 2, 3) b
      on b.player_id = t.player_id and b.season = t.season and b.team_id = t.from_team
    left join (select player_id, season, team_id, cast(sum(value_amt) as double) / 1009 as v from v_psr where role = 'P' group by 1, 2, 3) p
      on p.player_id = t.player_id and p.season = t.season and p.team_id = t.from_team
    where t.from_team <> t.to_team group by 1, 2),
  acc as (select t.event_id, t.to_team, avg(a.value - 2.0 * b.value + c.value) as a from v_trade t
    join v_psv a on a.player_id = t.player_id and a.season = t.season - 1 join v_psv b on b.player_id = t.player_id and b.season = t.season - 2
    join v_psv c on c.player_id = t.player_id and c.season = t.season - 3 group by 1, 2),
  om as (select event_id, to_team, arg_min(from_team, leg_index) as origin from v_trade where from_team <> to_team group by 1, 2),
  pay as (select player_id, season, max(case when salary is not null then 1 else 0 end) as paid from v_psr group by 1, 2),
  cy as (select t.event_id, t.to_team, avg(case when a.paid = 1 and b.paid = 0 then 1.0 else 0.0 end) as c from v_trade t
    left join pay a on a.player_id = t.player_id and a.season = t.season left join pay b on b.player_id = t.player_id and b.season = t.season + 1 group by 1, 2)
select l.event_id, l.season, l.team_id as to_team, round(exper.e, 6) as avg_experience, round(vol.v, 6) as volatility,
  round(clu.c, 6) as cluster_score, round(tv.v, 6) as prior_value, round(s.wins * 1.0 / nullif(s.wins + s.losses, 0), 6) as prior_pct,
  cast(cost.payroll as double) as payroll, round(bp.pick, 6) as avg_pick, round(oy.o, 6) as origin_value, round(acc.a, 6) as acceleration,
  round(cy.c, 6) as contract_year_share, om.origin as origin_team, cast(oc.payroll as double) as origin_payroll,
  cast(l.season >= 1998 as int) as late_era
from v_ledger l left join tv on tv.team_id = l.team_id and tv.season = l.season - 1
left join v_standing s on s.team_id = l.team_id and s.season = l.season - 1
left join cost on cost.team_id = l.team_id and cost.season = l.season
left join exper on exper.event_id = l.event_id and exper.to_team = l.team_id
left join vol on vol.event_id = l.event_id and vol.to_team = l.team_id
left join clu on clu.event_id = l.event_id and clu.to_team = l.team_id
left join bp on bp.event_id = l.event_id and bp.to_team = l.team_id
left join oy on oy.event_id = l.event_id and oy.to_team = l.team_id
left join acc on acc.event_id = l.event_id and acc.to_team = l.team_id
left join cy on cy.event_id = l.event_id and cy.to_team = l.team_id
left join om on om.event_id = l.event_id and om.to_team = l.team_id
left join cost oc on oc.team_id = om.origin and oc.season = l.season"""


@query("JOI-10", "feature_matrix", _FEATURES_SQL)
def feature_matrix_q(t):
    from swapledger.plans.features import feature_matrix

    m = feature_matrix(t.for_matrices("metric", "ledger"))
    rounded = ["avg_experience", "volatility", "cluster_score", "prior_value", "prior_pct", "avg_pick",
               "origin_value", "acceleration", "contract_year_share"]
    return m.select(
        "event_id", "season", "to_team", *[R(c).alias(c) for c in rounded],
        "payroll", "origin_team", "origin_payroll", "late_era",
    )


_WEIGHTS = [0.5 ** (i / 2.0) for i in range(5)]
_DECAYED = "({}) / ({})".format(
    " + ".join(f"coalesce(lag(jump, {i}) over w * {x!r}, 0)" for i, x in enumerate(_WEIGHTS)),
    " + ".join(f"case when lag(jump, {i}) over w is not null then {x!r} else 0 end" for i, x in enumerate(_WEIGHTS)))


_CONTEXT_SQL = f"""
with pe as (select p_partkey as player_id, 1950 + p_size as birth_year, p_partkey % 3 = 0 as lefty, case when p_type in ('PROMO', 'SMALL') then 1.0 else 0.0 end as abroad,
    p_type = 'LARGE' as pitcher, 18 + p_partkey % 12 as age, case when p_size >= 20 then p_size end as grade from part),
  dm as (select event_id, to_team, avg(season - birth_year) as avg_age, avg(abroad) as pct_international, avg(case when lefty then 1.0 else 0.0 end) as pct_left_bat,
    avg(case when pitcher then 1.0 else 0.0 end) as pct_pitchers, avg(grade) as avg_grade, max(grade) as max_grade from v_trade t left join pe on pe.player_id = t.player_id group by 1, 2),
  aw as (select event_id, to_team, avg(n) as avg_prior_awards, avg(case when n > 0 then 1.0 else 0.0 end) as pct_awarded from (
    select t.event_id, t.to_team, t.player_id, t.season, coalesce(sum(case when a.season < t.season then 1 else 0 end), 0) as n
    from (select distinct event_id, to_team, player_id, season from v_trade) t left join (select player_id, season from v_leg where priority = '1-URGENT') a on a.player_id = t.player_id group by 1, 2, 3, 4) group by 1, 2),
  tops as (select l.player_id, l.season, l.grp, l.level_id as top_level, sum(l.pa) as pa,
      sum(l.ops * cast(l.pa as double)) / nullif(sum(case when l.ops is not null then cast(l.pa as double) else 0 end), 0) as ops
    from v_level l join (select player_id, season, grp, min(level_id) as m from v_level group by 1, 2, 3) b
      on b.player_id = l.player_id and b.season = l.season and b.grp = l.grp and b.m = l.level_id group by 1, 2, 3, 4),
  mi as (select t.event_id, t.to_team,
      avg(case when grp = 'hitting' and pa >= 50 then ops * m end) as hit_quality, avg(case when grp = 'pitching' and pa >= 20 and ops > 0 then 5.0 / ops * m end) as pitch_quality,
      avg(case when pa is not null then usual - pe.age end) as age_advantage
    from v_trade t left join (select *, case top_level when 11 then 1.00 when 12 then 0.85 when 13 then 0.70 when 14 then 0.55 else 0.40 end as m,
        case top_level when 11 then 25 when 12 then 23 when 13 then 21 when 14 then 20 else 22 end as usual from tops) a on a.player_id = t.player_id and a.season = t.season - 1
      left join pe on pe.player_id = t.player_id group by 1, 2),
  {_COST}, cap as (select * from (values (1995, 178000000), (1996, 178000000), (1997, 178000000), (1998, 189000000), (1999, 189000000), (2000, 189000000),
    (2001, 195000000), (2002, 197000000), (2003, 206000000), (2004, 208000000), (2005, 210000000), (2006, 230000000), (2007, 233000000), (2008, 237000000), (2009, 241000000)) v(season, threshold)),
  pc as (select a.team_id, a.season, cast(a.payroll as double) as payroll, cast(a.payroll as double) / nullif(c.threshold, 0) as pct_of_cap,
      (cast(a.payroll as double) - cast(b.payroll as double)) / nullif(cast(b.payroll as double), 0) as growth_3yr
    from cost a left join cap c on c.season = a.season left join cost b on b.team_id = a.team_id and b.season = a.season - 3),
  ho as (select home_team as team_id, season, park_id, avg(home_score) as sh, avg(visitor_score) as ah, count(*) as games from v_game group by 1, 2, 3),
  ro as (select visitor_team as team_id, season, avg(visitor_score) as sr, avg(home_score) as ar from v_game group by 1, 2),
  py as (select ho.team_id, ho.season, sum((sh + ah) / nullif(sr + ar, 0) * games) / nullif(sum(games), 0) as v from ho left join ro on ro.team_id = ho.team_id and ro.season = ho.season
    where (sh + ah) / nullif(sr + ar, 0) is not null and games >= 10 group by 1, 2),
  pf as (select team_id, season, avg(v) over (partition by team_id order by season rows between 2 preceding and current row) as park_factor from py),
  jump as (select to_team as team_id, season, avg(metric_a_t_plus_1 - metric_a_t_minus_1) as jump from v_metric_window
    where metric_a_t_minus_1 is not null and metric_a_t_plus_1 is not null group by 1, 2),
  fit as (select team_id, season + 1 as season, avg(jump) over (partition by team_id order by season rows between 2 preceding and current row) as flat, {_DECAYED} as decayed
    from jump window w as (partition by team_id order by season)),
  x as (select l.event_id, l.season, l.team_id as to_team, s.wins * 1.0 / nullif(s.wins + s.losses, 0) as prior_pct, pc.payroll, pc.pct_of_cap, pc.growth_3yr, pf.park_factor,
      fit.flat as dev_fit, fit.decayed - fit.flat as recency_bias, dm.avg_age, dm.pct_international, dm.pct_left_bat, dm.pct_pitchers, dm.avg_grade, dm.max_grade,
      aw.avg_prior_awards, aw.pct_awarded, mi.hit_quality, mi.pitch_quality, mi.age_advantage, coalesce(r.regime_id, cast(l.team_id as varchar) || '_UNKNOWN') as regime_id
    from v_ledger l left join v_standing s on s.team_id = l.team_id and s.season = l.season - 1
    left join pc on pc.team_id = l.team_id and pc.season = l.season left join pf on pf.team_id = l.team_id and pf.season = l.season
    left join fit on fit.team_id = l.team_id and fit.season = l.season left join v_regime r on r.team_id = l.team_id and r.season = l.season
    left join dm on dm.event_id = l.event_id and dm.to_team = l.team_id left join aw on aw.event_id = l.event_id and aw.to_team = l.team_id
    left join mi on mi.event_id = l.event_id and mi.to_team = l.team_id)
select event_id, season, to_team, regime_id, payroll, cast(max_grade as bigint) as max_grade, round(prior_pct, 6) as prior_pct, round(pct_of_cap, 6) as pct_of_cap, round(growth_3yr, 6) as growth_3yr,
  round(park_factor, 6) as park_factor, round(dev_fit, 6) as dev_fit, round(recency_bias, 6) as recency_bias, round(avg_age, 6) as avg_age, round(pct_international, 6) as pct_international,
  round(pct_left_bat, 6) as pct_left_bat, round(pct_pitchers, 6) as pct_pitchers, round(avg_grade, 6) as avg_grade, round(avg_prior_awards, 6) as avg_prior_awards, round(pct_awarded, 6) as pct_awarded,
  round(hit_quality, 6) as hit_quality, round(pitch_quality, 6) as pitch_quality, round(age_advantage, 6) as age_advantage,
  round(prior_pct * greatest(0.0, 1.0 - coalesce(pct_of_cap, 0.5)), 6) as contention_window, round(dev_fit * greatest(0.0, 32.0 - coalesce(avg_age, 32.0)), 6) as fit_by_peak_age from x"""


@query("JOI-10", "context_matrix", _CONTEXT_SQL)
def context_matrix_q(t):
    from swapledger.plans.features import context_matrix

    rounded = ["prior_pct", "pct_of_cap", "growth_3yr", "park_factor", "dev_fit", "recency_bias", "avg_age", "pct_international",
               "pct_left_bat", "pct_pitchers", "avg_grade", "avg_prior_awards", "pct_awarded", "hit_quality", "pitch_quality",
               "age_advantage", "contention_window", "fit_by_peak_age"]
    return context_matrix(t).select(
        "event_id", "season", "to_team", "regime_id", "payroll", F.col("max_grade").cast("long").alias("max_grade"),
        *[R(c).alias(c) for c in rounded])



@query("JOI-11", "features_with_outcomes", """
with e as (select w.event_id, w.to_team, w.season, avg(w.season - f.first_season) as e from v_trade w
    join (select player_id, min(season) as first_season from v_psv group by 1) f on f.player_id = w.player_id group by 1, 2, 3),
  o as (select event_id, to_team, season, avg(value_t_plus_1 - value_t_minus_1) as d from v_window
    where value_t_plus_1 is not null and value_t_minus_1 is not null group by 1, 2, 3),
  c as (select t.event_id, t.to_team, sum(cast(r.salary as decimal(18,2))) as cap from v_trade t
    left join v_psr r on r.player_id = t.player_id and r.season = t.season group by 1, 2)
select e.event_id, e.to_team, e.season, round(e.e, 6) as avg_experience, round(o.d, 6) as value_delta, cast(c.cap as double) as cap
from e join o on o.event_id = e.event_id and o.to_team = e.to_team and o.season = e.season
left join c on c.event_id = e.event_id and c.to_team = e.to_team""")
def features_with_outcomes(t):
    from swapledger.operators.outcomes import acquired_cost

    w = t.window
    both = w.where(F.col("value_t_plus_1").isNotNull() & F.col("value_t_minus_1").isNotNull())
    outcome = both.groupBy("event_id", "to_team", "season").agg(
        F.avg(F.col("value_t_plus_1") - F.col("value_t_minus_1")).alias("value_delta")
    )
    first = t.psv.groupBy("player_id").agg(F.min("season").alias("first_season"))
    features = t.trade.join(first, "player_id").groupBy("event_id", "to_team", "season").agg(
        F.avg(F.col("season") - F.col("first_season")).alias("avg_experience")
    )
    return (
        features.join(outcome, ["event_id", "to_team", "season"])
        .join(acquired_cost(t.trade, t.psr), ["event_id", "to_team"], "left")
        .select("event_id", "to_team", "season", R("avg_experience").alias("avg_experience"),
                R("value_delta").alias("value_delta"), F.col("cap").cast("double").alias("cap"))
    )


@query("JOI-12", "full_outer_sides", """
with r as (select event_id, to_team as team_id, season, sum(metric_a_t_plus_1 - metric_a_t_minus_1) as v from v_metric_window group by 1, 2, 3),
  s as (select event_id, from_team as team_id, season, sum(metric_a_t_plus_1 - metric_a_t_minus_1) as v from v_metric_window group by 1, 2, 3)
select coalesce(r.event_id, s.event_id) as event_id, coalesce(r.team_id, s.team_id) as team_id, coalesce(r.season, s.season) as season,
  round(coalesce(r.v, 0), 6) as received, round(coalesce(s.v, 0), 6) as sent, round(coalesce(r.v, 0) - coalesce(s.v, 0), 6) as net
from r full join s on s.event_id = r.event_id and s.team_id = r.team_id and s.season = r.season""")
def full_outer_sides(t):
    """The full join as one aggregate over both signed sides; a missing side sums to 0."""
    from swapledger.operators.windows import both_sides

    w = t.metric_window.withColumn("d", F.col("metric_a_t_plus_1") - F.col("metric_a_t_minus_1"))
    return both_sides(w, "d").select(
        "event_id", "team_id", "season", R("received").alias("received"), R("sent").alias("sent"), R("net").alias("net")
    )


@query("JOI-13", "completed_and_partial", """
with m as (select max(season) as y from v_psv),
  c as (select player_id, avg(value) as base from v_psv, m where season < y group by 1),
  p as (select player_id, value as part from v_psv, m where season = y)
select coalesce(c.player_id, p.player_id) as player_id, round(c.base, 6) as base, round(p.part, 6) as part,
  round(coalesce(c.base, 0) + coalesce(p.part, 0), 6) as total from c full join p on p.player_id = c.player_id""")
def completed_and_partial(t):
    s = t.psv.withColumn("y", t.psv.agg(F.max("season")).scalar())
    done = s.where("season < y").groupBy("player_id").agg(F.avg("value").alias("base"))
    part = s.where("season = y").select("player_id", F.col("value").alias("part"))
    return done.join(part, "player_id", "full").select(
        "player_id", R("base").alias("base"), R("part").alias("part"),
        R(F.coalesce("base", F.lit(0.0)) + F.coalesce("part", F.lit(0.0))).alias("total"),
    )


@query("JOI-14", "semi_join", """
select player_id, season, round(value, 6) as value from v_psv
where player_id in (select player_id from v_trade where to_team in (select team_id from v_team where division_id = 1))""")
def semi_join(t):
    teams = t.team.where("division_id = 1").select(F.col("team_id").alias("to_team"))
    moved = t.trade.join(teams, "to_team", "left_semi").select("player_id")
    return t.psv.join(moved, "player_id", "left_semi").select("player_id", "season", R("value").alias("value"))


@query("JOI-15", "latest_per_key_with_ties", """
select e.user_id, e.event_id, e.event_type from events e
where date_trunc('hour', e.ts) = (select max(date_trunc('hour', i.ts)) from events i where i.user_id = e.user_id)""")
def latest_per_key_with_ties(t):
    """Rows at the latest hour of each key; the maximum is a partial aggregate joined back."""
    e = t.base("events").withColumn("hour", F.date_trunc("hour", "ts"))
    last = e.groupBy("user_id").agg(F.max("hour").alias("hour"))
    return e.join(last, ["user_id", "hour"], "left_semi").select("user_id", "event_id", "event_type")


@query("JOI-16", "one_row_joins", """
with a as (select avg(value) as mean_value, count(*) as n from v_psv), l as (select max(season) as latest from v_standing)
select s.team_id, s.season, cast(s.wins as bigint) as wins, round(a.mean_value, 6) as mean_value, a.n as n_rows
from v_standing s join l on l.latest = s.season cross join a""")
def one_row_joins(t):
    """Scalar sub-queries instead of cross joins."""
    stats = t.psv.agg(F.struct(F.avg("value").alias("mean_value"), F.count("*").alias("n")).alias("s")).scalar()
    latest = t.standing.agg(F.max("season")).scalar()
    return t.standing.where(F.col("season") == latest).withColumn("s", stats).select(
        "team_id", "season", "wins", R(F.col("s.mean_value")).alias("mean_value"), F.col("s.n").alias("n_rows")
    )


@query("JOI-17", "inequality_inside_aggregate", """
with aw as (select player_id, season from v_leg where priority = '1-URGENT')
select t.event_id, t.to_team, t.player_id, cast(coalesce(sum(case when a.season < t.season then 1 else 0 end), 0) as bigint) as n_prior
from (select distinct event_id, to_team, player_id, season from v_trade) t left join aw a on a.player_id = t.player_id
group by 1, 2, 3""")
def inequality_inside_aggregate(t):
    counted = t.leg.where("priority = '1-URGENT'").groupBy("player_id", F.col("season").alias("s")).agg(F.count("*").alias("n"))
    legs = t.trade.select("event_id", "to_team", "player_id", "season").distinct()
    return legs.join(counted, "player_id", "left").groupBy("event_id", "to_team", "player_id").agg(
        F.coalesce(F.sum(F.when(F.col("s") < F.col("season"), F.col("n"))), F.lit(0)).alias("n_prior")
    )


@query("JOI-18", "between_inside_aggregate", """
with sal as (select player_id, season, cast(salary as decimal(18,2)) as salary from v_psr where salary is not null)
select t.event_id, t.to_team, t.player_id, cast(sum(s.salary) filter (where s.season between t.season and t.season + 3) as double)
  / nullif(count(*) filter (where s.season between t.season and t.season + 3), 0) as avg_salary
from (select distinct event_id, to_team, player_id, season from v_trade) t left join sal s on s.player_id = t.player_id group by 1, 2, 3""")
def between_inside_aggregate(t):
    from swapledger.operators.outcomes import salary_between

    legs = t.trade.select("event_id", "to_team", "player_id", "season").distinct()
    return salary_between(legs, t.psr, 3).select("event_id", "to_team", "player_id", "avg_salary")


@query("JOI-19", "join_on_name_and_year", """
with grades as (select regexp_replace(lower(trim(p_name)), '[^a-z0-9 ]', '', 'g') as k, 1995 + p_size % 7 as y, max(p_size) as grade from part group by 1, 2),
  pl as (select p_partkey as player_id, regexp_replace(lower(trim(upper(p_name) || '.')), '[^a-z0-9 ]', '', 'g') as k from part)
select t.event_id, t.to_team, round(avg(coalesce(g.grade, 0)), 6) as avg_grade, max(coalesce(g.grade, 0)) as max_grade
from v_trade t join pl on pl.player_id = t.player_id left join grades g on g.k = pl.k and g.y = t.season group by 1, 2""")
def join_on_name_and_year(t):
    part = t.base("part")
    grades = part.groupBy(name_key(F.col("p_name")).alias("k"), (F.lit(1995) + F.col("p_size") % 7).alias("season")).agg(
        F.max("p_size").alias("grade")
    )
    players = part.select(
        F.col("p_partkey").alias("player_id"), name_key(F.concat(F.upper("p_name"), F.lit("."))).alias("k")
    )
    g = F.coalesce("grade", F.lit(0))
    return t.trade.join(players, "player_id").join(grades, ["k", "season"], "left").groupBy("event_id", "to_team").agg(
        F.round(F.avg(g), 6).alias("avg_grade"), F.max(g).alias("max_grade")
    )


_CANON = "lower(trim(regexp_replace(regexp_replace(replace(replace({c}, '.', ''), '-', ' '), '\\s+(jr|sr|ii|iii|iv)\\.?$', '', 'i'), '\\s+', ' ', 'g')))"


@query("JOI-20", "entity_resolution", f"""
with people as (select c_custkey as person_id, c_name as full_name from customer union all select p_partkey + 10000000, p_name from part),
  names as (select s_suppkey as row_id, case s_suppkey % 3 when 0 then replace(s_name, 'Supplier', 'Customer')
      when 1 then upper(replace(s_name, 'Supplier', 'Customer')) || ' Jr.' else 'No-Such ' || s_name end as name from supplier
    union all select p_partkey + 10000000, case when p_size = 1 then p_name else p_name || ' II' end from part),
  ex as (select full_name, min(person_id) as id from people group by 1),
  cn as (select {_CANON.format(c='full_name')} as k, min(person_id) as id from people group by 1 having count(distinct person_id) = 1)
select n.row_id, n.name, coalesce(ex.id, cn.id) as person_id,
  case when ex.id is not null then 'exact' when cn.id is not null then 'canonical' end as matched_by
from names n left join ex on ex.full_name = n.name left join cn on cn.k = {_CANON.format(c='n.name')}""")
def entity_resolution(t):
    part, supplier = t.base("part"), t.base("supplier")
    people = t.base("customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("full_name")).union(
        part.select(F.col("p_partkey") + 10000000, "p_name")
    )
    as_customer = F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))
    names = supplier.select(
        F.col("s_suppkey").alias("row_id"),
        F.when(F.col("s_suppkey") % 3 == 0, as_customer)
        .when(F.col("s_suppkey") % 3 == 1, F.concat(F.upper(as_customer), F.lit(" Jr.")))
        .otherwise(F.concat(F.lit("No-Such "), "s_name")).alias("name"),
    ).union(
        part.select(F.col("p_partkey") + 10000000,
                    F.when(F.col("p_size") == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" II"))))
    )
    return entity_resolve(names, people).select("row_id", "name", "person_id", "matched_by")


@query("JOI-21", "undrafted_players", """
select p.player_id, min(p.season) as first_season from v_psv p
where not exists (select 1 from part where p_partkey = p.player_id and p_size <= 25) group by 1 having min(p.season) >= 1996""")
def undrafted_players(t):
    drafted = t.base("part").where("p_size <= 25").select(F.col("p_partkey").alias("player_id"))
    return (
        t.psv.groupBy("player_id").agg(F.min("season").alias("first_season")).where("first_season >= 1996")
        .join(drafted, "player_id", "left_anti")
    )


@query("JOI-22", "comparables", """
with pl as (select e.vec_id as player_id, p.p_type as role, e.label as grp, case when p.p_partkey % 11 > 0 then p.p_size end as age, case when p.p_partkey % 13 > 0 then p.p_retailprice / 100 end as value,
    [case when abs(x) < 0.02 then null else 50 + 100 * cast(x as double) end for x in e.embedding[1:11]] as fp
  from embeddings e join part p on p.p_partkey = e.vec_id),
  f as (select role, grp, arg_max(player_id, value * 1e9 - player_id) as focus_id from pl where value is not null group by 1, 2),
  pairs as (select a.player_id as focus_id, b.player_id, coalesce(abs(a.age - b.age), 0) as age_delta, coalesce(abs(a.value - b.value), 0) as value_delta,
      sqrt((select avg(power(coalesce(a.fp[i], 50) - coalesce(b.fp[i], 50), 2)) from range(1, 12) r(i))) as distance
    from f join pl a on a.player_id = f.focus_id join pl b on b.role = a.role and b.grp = a.grp and b.player_id <> a.player_id and coalesce(abs(a.age - b.age), 0) <= 3),
  s as (select *, round(greatest(0, least(100, 100 - (distance + 2.5 * age_delta + 1.5 * value_delta) * 1.8)), 6) as score from pairs)
select focus_id, player_id, round(distance, 6) as distance, age_delta, score, rank from (
  select *, row_number() over (partition by focus_id order by score desc, player_id) as rank from s) where rank <= 8""")
def comparables_q(t):
    """Comparables of the leading player of every (role, group)."""
    e, p = t.base("embeddings"), t.base("part")
    fp = F.transform(
        F.slice("embedding", 1, 11),
        lambda x: F.when(F.abs(x.cast("double")) >= 0.02, F.lit(50.0) + x.cast("double") * 100),
    )
    players = e.join(p, F.col("vec_id") == F.col("p_partkey")).select(
        F.col("vec_id").alias("player_id"), F.col("p_type").alias("role"), F.col("label").alias("grp"),
        F.when(F.col("p_partkey") % 11 > 0, F.col("p_size")).alias("age"), F.when(F.col("p_partkey") % 13 > 0, F.col("p_retailprice") / 100).alias("value"), fp.alias("fp"),
    )
    lead = players.where(F.col("value").isNotNull()).groupBy("role", "grp").agg(
        F.max_by(F.struct("player_id", "age", "value", "fp"), F.struct("value", -F.col("player_id"))).alias("x")
    ).select("role", "grp", "x.*")
    return comparables(players, lead).select(
        "focus_id", "player_id", R("distance").alias("distance"), "age_delta", R("score").alias("score"),
        F.col("rank").cast("long").alias("rank"),
    )


@query("JOI-25", "regime_fallback", """
with o as (select team_id, season, regime_id from v_regime where season < 2000)
select l.event_id, l.season, l.team_id, coalesce(o.regime_id, cast(l.team_id as varchar) || '_UNKNOWN') as regime_id
from v_ledger l left join o on o.team_id = l.team_id and o.season = l.season""")
def regime_fallback(t):
    keys = t.ledger.select("event_id", "season", "team_id")
    return regime_or_unknown(keys, t.regime.where("season < 2000")).select("event_id", "season", "team_id", "regime_id")


@query("JOI-26", "legs_with_regime", """
select w.event_id, w.leg_index, r.regime_id, w.season, w.from_team, w.to_team, round(w.value_t_minus_1, 6) as pre,
  round(w.value_t_plus_1, 6) as post, w.season - f.first_season as experience
from v_window w join v_regime r on r.team_id = w.from_team and r.season = w.season
left join (select player_id, min(season) as first_season from v_psv group by 1) f on f.player_id = w.player_id
where w.value_t_minus_1 is not null and w.value_t_plus_1 is not null""")
def legs_with_regime(t):
    from swapledger.operators.regimes import regime_legs

    w = offset_window(t.numbered_trade, t.psv, [-1, 1], ["value"])
    return regime_legs(w, t.regime, t.psv).select(
        "event_id", "leg_index", "regime_id", "season", "from_team", "to_team",
        R("pre").alias("pre"), R("post").alias("post"), "experience",
    )
