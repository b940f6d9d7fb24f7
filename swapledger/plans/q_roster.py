"""Roster and valuation programs (VAL) and the joins built on them (JOI-23, JOI-24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from swapledger.functions import valuation as V
from swapledger.operators import roster as R
from swapledger.operators.ledger import winners
from swapledger.operators.matching import mutual_fit
from swapledger.operators.regress import materialise
from swapledger.operators.regimes import leg_class, mechanism_summary, regime_buckets
from swapledger.operators.seasons import latest_row
from swapledger.operators.teams import division_race
from swapledger.plans.q_aggregates import rounded
from swapledger.plans.q_scalars import cdf_sql
from swapledger.plans.q_summaries import _RLEGS, rlegs
from swapledger.plans.registry import query
from swapledger.sources.tables import SCALE

NOW, PRIOR = 2000, 1999
_POS = ["SP", "RP", "C", "1B", "2B", "3B", "SS", "LF", "CF", "RF", "DH"]
_BAT = _POS[2:]
_STATUS = ["Pre-Arbitration", "Arbitration 1", "Arbitration 2", "Arbitration 3", "Veteran", "Arbitration 4"]


def _pick(values, expr):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (expr % len(values) + 1).cast("int"))


def _pick_sql(values, expr):
    return f"([{', '.join(repr(v) for v in values)}])[cast({expr} % {len(values)} + 1 as int)]"


# -- fixture tables ------------------------------------------------------------

_PLAYERS = f"""pl as (
  select l.player_id, l.team_id, l.season, p_size % 22 + 18 as age, {_pick_sql(_STATUS, 'p_size')} as status, {_pick_sql(_POS, 'p_partkey')} as position,
    v.last_value, v.cap_hit, 1 + (l.team_id % 10) / 50.0::double as dev_mul
  from (select player_id, season, team_id from (select *, row_number() over (partition by player_id order by season desc, team_id desc) as r from v_pstv) where r = 1) l
  join (select player_id, season, cast(sum(value_amt) as double) / 1009 as last_value, max(salary) as cap_hit from v_psr group by 1, 2) v on v.player_id = l.player_id and v.season = l.season
  join part on p_partkey = l.player_id)"""


def players(t):
    """One row per player: team of the last season, age, status, position, value, cost."""
    last_team = latest_row(t.psr, ["player_id"], ["season", "team_id"], ["season", "team_id"])
    value = t.psr.groupBy("player_id", "season").agg((F.sum("value_amt").cast("double") / SCALE).alias("last_value"), F.max("salary").alias("cap_hit"))
    bio = t.base("part").select(
        F.col("p_partkey").alias("player_id"), (F.col("p_size") % 22 + 18).alias("age"),
        _pick(_STATUS, F.col("p_size")).alias("status"), _pick(_POS, F.col("p_partkey")).alias("position"))
    return (
        last_team.join(value, ["player_id", "season"]).join(bio, "player_id")
        .withColumn("dev_mul", F.lit(1.0) + (F.col("team_id") % 10) / 50.0)
    )


_GAMES = f"(select max(wins + losses) from v_standing where season = {NOW})"
_BOARD = f"""roles as (select player_id, case when coalesce(gs, 0) * 1.0 / g >= 0.5 then 'SP' else 'RP' end as pitch_role from (select player_id, arg_max(gs, season) as gs, arg_max(g, season) as g from
    (select player_id, season, coalesce(sum(games) filter (where team_id % 2 = 0), 0) as gs, sum(games) as g from v_psr where role = 'P' and season in ({NOW}, {PRIOR}) group by 1, 2 having sum(games) > 0) group by 1)),
  comp as (select player_id, season, coalesce(cast(sum(value_amt) filter (where role = 'B') as double) / 1009, 0) as bat, coalesce(cast(sum(value_amt) filter (where role = 'P') as double) / 1009, 0) as pit from v_psr group by 1, 2),
  rost as (select distinct team_id, player_id from v_psr where season = {NOW}),
  bl as (select r.team_id, r.player_id, coalesce(roles.pitch_role, 'RP') as pr, {_pick_sql(_BAT, 'r.player_id')} as position,
     least(g.g / 120.0, 0.85) as w, 162.0 / g.g as pace, coalesce(a.bat, 0) as b1, coalesce(a.pit, 0) as p1, coalesce(b.bat, 0) as b0, coalesce(b.pit, 0) as p0
   from rost r left join comp a on a.player_id = r.player_id and a.season = {NOW} left join comp b on b.player_id = r.player_id and b.season = {PRIOR} left join roles on roles.player_id = r.player_id, (select {_GAMES} as g) g),
  rv as (select team_id, position, sum(v) as rostered from (select team_id, pr as position, w * p1 * pace + (1 - w) * p0 as v from bl union all select team_id, position, w * b1 * pace + (1 - w) * b0 from bl) where abs(v) > 0.01 group by 1, 2),
  up as (select player_id % 25 as team_id, level_id, grp, case when grp = 'hitting' then {_pick_sql(_BAT, 'player_id')} else case when player_id % 3 = 0 then 'SP' else 'RP' end end as position,
     case when grp = 'hitting' then ops else ops * 5 + 1 end as metric from v_level where season = {NOW} and level_id in (11, 12) and pa >= 20),
  mu as (select grp, level_id, avg(metric) as m from up group by 1, 2),
  fd as (select team_id, position, least(2.5, sum(least(1.2, v))) as farm from (select up.team_id, up.position, case when up.grp = 'hitting' then (metric - m) * 9.0 * case when up.level_id = 11 then 1.0 else 0.55 end
     else greatest(0.0, (m - metric) / m) * 1.2 * case when up.level_id = 11 then 1.0 else 0.55 end end as v from up join mu on mu.grp = up.grp and mu.level_id = up.level_id) where v > 0 group by 1, 2),
  base as (select * from (values ('C', 2.0), ('1B', 2.0), ('2B', 2.0), ('3B', 2.5), ('SS', 2.5), ('LF', 2.0), ('CF', 2.5), ('RF', 2.0), ('DH', 1.5), ('SP', 12.0), ('RP', 4.0)) b(position, baseline)),
  hs as (select t.team_id, b.position, cast(b.baseline as double) as baseline, round(coalesce(rv.rostered, 0.0)::double, 2) as rostered, round(coalesce(fd.farm, 0.0)::double, 2) as farm from v_team t cross join base b
     left join rv on rv.team_id = t.team_id and rv.position = b.position left join fd on fd.team_id = t.team_id and fd.position = b.position),
  board as (select *, case when hole_score / baseline > 0.5 then 'critical' when hole_score / baseline > 0.25 then 'warning' else 'ok' end as severity,
     case when hole_score > 0.5 then 'hole' when hole_score < -1.0 then 'surplus' else 'even' end as kind from (select *, round(baseline - (rostered + farm), 2) as hole_score from hs)),
  st as (select s.*, t.division_id from v_standing s join v_team t on t.team_id = s.team_id where s.season = {NOW}),
  ld as (select division_id, wins as lw, losses as ll from (select *, row_number() over (partition by division_id order by wins - losses desc, team_id) as r from st) where r = 1),
  gb as (select st.team_id, wins, losses, wins * 1.0 / nullif(wins + losses, 0) as pct, greatest(0.0, round(cast(((lw - wins) + (losses - ll)) / 2.0 as double), 1)) as games_back from st join ld on ld.division_id = st.division_id),
  pay as (select team_id, coalesce(cast(sum(cast(salary as decimal(18,2))) as double), 0) as payroll from v_psr where season = {NOW} group by 1),
  idx as (select gb.team_id, games_back, pct, case when games_back <= 5 and pct >= 0.52 then 'buy' when games_back > 10 and pct < 0.48 then 'sell' else 'hold' end as posture,
     244000000.0 - coalesce(payroll, 0) * 40 as headroom from gb left join pay on pay.team_id = gb.team_id)"""


def _season(t, season):
    return R.season_components(t.psr, F.lit(season), SCALE)


def _games(t):
    return t.standing.where(F.col("season") == NOW).agg(F.max(F.col("wins") + F.col("losses"))).scalar()


def rostered(t):
    roster = t.psr.where(F.col("season") == NOW).select("team_id", "player_id").distinct()
    positions = t.base("part").select(F.col("p_partkey").alias("player_id"), _pick(_BAT, F.col("p_partkey")).alias("position"))
    return R.blended_positions(roster, _season(t, NOW), _season(t, PRIOR), pitch_roles(t), positions, _games(t))


def pitch_roles(t):
    rows = t.psr.where("role = 'P'").withColumn("starts", F.when(F.col("team_id") % 2 == 0, F.col("games")))
    return R.pitching_roles(rows, F.lit(NOW), F.lit(PRIOR))


def farm(t):
    hit = F.col("grp") == "hitting"
    s = t.level.where(F.col("season") == NOW).select(
        (F.col("player_id") % 25).cast("int").alias("team_id"), "level_id", "grp", F.col("pa").alias("volume"),
        _pick(_BAT, F.col("player_id")).alias("position"), F.when(F.col("player_id") % 3 == 0, "SP").otherwise("RP").alias("pitch_role"),
        F.when(hit, F.col("ops")).otherwise(F.col("ops") * 5 + 1).alias("metric"))
    return R.farm_depth(s, min_pa=20, min_ip=20)


def board(t):
    return R.hole_board(t.team, rostered(t), farm(t))


def index(t):
    s = division_race(t.standing.where(F.col("season") == NOW).join(t.team.select("team_id", "division_id"), "team_id"))
    pct = F.try_divide(F.col("wins").cast("double"), F.col("wins") + F.col("losses"))
    pay = t.psr.where(F.col("season") == NOW).groupBy("team_id").agg(F.coalesce(F.sum(F.col("salary").cast("decimal(18,2)")).cast("double"), F.lit(0.0)).alias("payroll"))
    return s.join(pay, "team_id", "left").select(
        "team_id", "games_back", pct.alias("pct"), V.posture(F.col("games_back"), pct).alias("posture"),
        (F.lit(float(R.TAX_BASE)) - F.coalesce("payroll", F.lit(0.0)) * 40).alias("headroom"))


# -- queries ----------------------------------------------------------------------


@query("VAL-01", "blended_positions", f"with {_BOARD} select team_id, position, round(rostered, 6) as rostered from rv")
def blended_positions_q(t):
    return rounded(rostered(t), "rostered")


@query("VAL-02", "pitching_roles", f"with {_BOARD} select player_id, pitch_role from roles")
def pitching_roles_q(t):
    return pitch_roles(t)


@query("VAL-03", "hole_board", f"with {_BOARD} select team_id, position, baseline, rostered, farm, hole_score, severity, kind from board")
def hole_board_q(t):
    return board(t)


@query("VAL-04", "farm_depth", f"with {_BOARD} select cast(team_id as int) as team_id, position, round(cast(farm as double), 6) as farm from fd")
def farm_depth_q(t):
    return rounded(farm(t), "farm")


@query("VAL-05", "posture", f"with {_BOARD} select team_id, games_back, round(pct, 6) as pct, posture, headroom from idx")
def posture_q(t):
    return rounded(index(t), "pct")


def _salary_sql(klass: str) -> str:
    """Salary of a class, in SQL, over columns worth, kind rate, premium, cap_hit."""
    market = "greatest(740000.0, worth * rate * prem)"
    return f"""(case {klass} when 'pre-arb' then 740000.0 when 'arb1' then greatest(740000.0, {market} * 0.4) when 'arb2' then greatest(740000.0, {market} * 0.6)
      when 'arb3' then greatest(740000.0, {market} * 0.8) else coalesce(cap_hit, {market}) end)"""


_NEXT = "([ 'pre-arb', 'arb1', 'arb2', 'arb3', 'fa' ])[least(rk + {y} + 1, 5)]"
_BAND = "(case {k} when 'pre-arb' then 0.22 when 'arb1' then 0.18 when 'arb2' then 0.15 when 'arb3' then 0.12 else 0.10 end)"


def _aging(a: str) -> str:
    return f"(case when {a} < 24 then 0.15 when {a} < 26 then 0.08 when {a} < 28 then 0.0 when {a} < 30 then -0.15 when {a} < 33 then -0.25 else -0.35 end)"


_PREM = "(case position when 'SS' then 1.12 when '2B' then 1.08 when 'CF' then 1.08 when 'C' then 1.06 when '3B' then 1.02 when 'LF' then 0.98 when '1B' then 0.9 when 'DH' then 0.88 when 'RP' then 0.95 else 1.0 end)"
_ARB = f"""{_PLAYERS},
  a1 as (select *, greatest(0.0, coalesce(last_value, 0.5)) as worth, case status when 'Pre-Arbitration' then 'pre-arb' when 'Arbitration 1' then 'arb1' when 'Arbitration 2' then 'arb2' when 'Veteran' then 'fa' else 'arb3' end as cls,
     case when position in ('SP', 'P') then 7200000.0 when position = 'RP' then 6000000.0 else 8500000.0 end as rate, {_PREM} as prem from pl),
  a2 as (select *, case cls when 'pre-arb' then 0 when 'arb1' then 1 when 'arb2' then 2 when 'arb3' then 3 else 4 end as rk from a1),
  a3 as (select *, {_NEXT.format(y=1)} as c1, {_NEXT.format(y=2)} as c2, {_NEXT.format(y=3)} as c3 from a2),
  a4 as (select *, cast({_salary_sql('c1')} as double) as s1, cast({_salary_sql('c2')} as double) as s2, cast({_salary_sql('c3')} as double) as s3 from a3),
  a5 as (select *, greatest(0.0, worth + {_aging('age')}) as w1 from a4), a6 as (select *, greatest(0.0, w1 + {_aging('age + 1')}) as w2 from a5),
  a7 as (select *, greatest(0.0, w2 + {_aging('age + 2')}) as w3 from a6),
  a8 as (select *, greatest(0, 4 - rk) as yc, w1 * (1 + (dev_mul - 1) * greatest(0.0, least(1.0, (29 - age) / 6.0))) - s1 / 8500000.0 as g1,
     w2 * (1 + (dev_mul - 1) * greatest(0.0, least(1.0, (29 - age - 1) / 6.0))) - s2 / 8500000.0 as g2, w3 * (1 + (dev_mul - 1) * greatest(0.0, least(1.0, (29 - age - 2) / 6.0))) - s3 / 8500000.0 as g3 from a7)"""


def forecast(t):
    p = players(t)
    f = V.salary_forecast(F.col("status"), F.col("last_value"), F.col("position"), F.col("cap_hit"))
    return p.select("*", *[c.alias(n) for n, c in f.items()])


@query("VAL-06", "salary_forecast", f"""
with {_ARB} select player_id, cls as salary_class, yc as years_controlled, round(s1, 4) as salary_1, round(s2, 4) as salary_2, round(s3, 4) as salary_3, round(s1 * (1 - {_BAND.format(k='c1')}), 4) as salary_1_lo, round(s3 * (1 + {_BAND.format(k='c3')}), 4) as salary_3_hi,
  round((s1 + s2 + s3) * case cls when 'pre-arb' then 1.65 when 'arb1' then 1.42 when 'arb2' then 1.22 when 'arb3' then 1.08 else 1.0 end, 4) as extension_3yr from a8""")
def salary_forecast_q(t):
    f = forecast(t)
    r = lambda c: F.round(c, 4).alias(c)
    return f.select("player_id", "salary_class", "years_controlled", r("salary_1"), r("salary_2"), r("salary_3"), r("salary_1_lo"), r("salary_3_hi"), r("extension_3yr"))


@query("VAL-07", "aging_and_development", f"""
with {_PLAYERS} select player_id, cast({_aging('age')} as double) as delta, round(greatest(0.0, last_value) * (1 + (dev_mul - 1) * greatest(0.0, least(1.0, (29 - age) / 6.0))), 6) as adjusted from pl""")
def aging_and_development(t):
    p = players(t)
    return p.select("player_id", V.aging_delta(F.col("age")).alias("delta"),
                    F.round(V.dev_adjust(F.greatest(F.lit(0.0), F.col("last_value")), F.col("age"), F.col("dev_mul")), 6).alias("adjusted"))


def with_surplus(t):
    f = forecast(t)
    pays = [F.col("salary_1"), F.col("salary_2"), F.col("salary_3")]
    worth = F.coalesce("last_value", F.lit(0.5))
    years = F.least(F.lit(3), F.greatest(F.lit(1), F.col("years_controlled")))
    return f.withColumn("surplus_3yr", V.control_surplus(worth, F.col("age"), F.col("dev_mul"), pays)).withColumn(
        "control_surplus", V.control_surplus(worth, F.col("age"), F.col("dev_mul"), pays, years))


@query("VAL-08", "surplus_3yr", f"with {_ARB} select player_id, round(g1 + g2 + g3, 6) as surplus_3yr from a8")
def surplus_3yr(t):
    return rounded(with_surplus(t).select("player_id", "surplus_3yr"), "surplus_3yr")


_SIG = "(1 + (team % 10) / 50.0::double)"


@query("VAL-09", "basket_verdict", f"""
with {_ARB}, it as (select l.event_id as deal_id, case when l.from_team < l.to_team then 'receiving' else 'sending' end as side, case when a.cls = 'pre-arb' and a.age < 24
     then (case when a.position in ('SP', 'RP') then 1.3 else 0.8 end) * (1 + (dev_mul - 1) * 1.0) else g1 + g2 + g3 end as surplus, s1 as salary_1,
     (['buy', 'hold', 'sell'])[cast(l.to_team % 3 + 1 as int)] as posture, (l.to_team % 10) / 10.0::double as chance from v_trade l join a8 a on a.player_id = l.player_id),
  s as (select deal_id, sum(case when side = 'receiving' then surplus else 0 end) as i, sum(case when side = 'sending' then surplus else 0 end) as o, count(*) as n, max(posture) as p, max(chance) as c,
     sum(case when side = 'receiving' then salary_1 else 0 end) as cr, sum(case when side = 'sending' then salary_1 else 0 end) as cs from it group by 1),
  m as (select *, p = 'buy' and c > 0.35 as premium, i * case when p = 'buy' and c > 0.35 then 1 + c * 0.15 else 1 end - o as mean, greatest(0.8, sqrt(n) * 1.2) as sd from s),
  q as (select *, {cdf_sql('mean / sd')} as pp from m)
select deal_id, premium, round(mean, 5) as mean, round(sd, 6) as sd, round(mean - 1.645 * sd, 5) as low, round(mean + 1.645 * sd, 5) as high, round(pp, 6) as p_positive, round(cr, 2) as cost_received, round(cs, 2) as cost_sent,
  case when mean > 4 and pp > 0.78 then 'strong-buy' when mean > 1.5 and pp > 0.65 then 'lean-buy' when mean < -4 and pp < 0.22 then 'strong-pass' when mean < -1.5 and pp < 0.35 then 'lean-pass' else 'neutral' end as recommendation from q""")
def basket_verdict_q(t):
    p = with_surplus(t)
    prospect = (F.col("salary_class") == "pre-arb") & (F.col("age") < 24)
    grade = F.when(F.col("position").isin("SP", "RP"), 55).otherwise(50)
    item = F.when(prospect, V.dev_adjust(V.grade_value(grade), F.lit(22), F.col("dev_mul"))).otherwise(F.col("surplus_3yr"))
    items = t.trade.join(p.select("player_id", "salary_1", item.alias("surplus")), "player_id").select(
        F.col("event_id").alias("deal_id"), F.when(F.col("from_team") < F.col("to_team"), "receiving").otherwise("sending").alias("side"), "surplus", "salary_1",
        _pick(["buy", "hold", "sell"], F.col("to_team")).alias("posture"), ((F.col("to_team") % 10) / 10.0).alias("chance"))
    v = R.basket_verdict(items)
    r = lambda c, d: F.round(c, d).alias(c)
    return v.select("deal_id", "premium", r("mean", 5), r("sd", 6), r("low", 5), r("high", 5), r("p_positive", 6), r("cost_received", 2), r("cost_sent", 2), "recommendation")


_LV = ["MLB", "AAA", "AA", "A+", "A", "R"]


@query("VAL-10", "scout_grade", f"""
with x as (select player_id, season, grp, level_id, {_pick_sql(_LV, 'player_id')} as lvl, 17 + player_id % 14 as age, cast(pa as double) as pa, ops from v_level),
  g as (select *, 50 + case lvl when 'MLB' then 8 when 'AAA' then 6 when 'AA' then 4 when 'A+' then 1 when 'A' then -2 else -4 end + (case lvl when 'MLB' then 27 when 'AAA' then 25 when 'AA' then 23 when 'A+' then 22 when 'A' then 21 else 19 end - age) * 2.5
   + case when grp = 'hitting' and ops is not null and pa >= 30 then (ops - case lvl when 'MLB' then 0.74 when 'AAA' then 0.78 when 'AA' then 0.72 when 'A+' then 0.70 when 'A' then 0.68 else 0.70 end) * 60
      when grp = 'pitching' and ops is not null and pa >= 15 then (case lvl when 'MLB' then 4.2 when 'AAA' then 4.4 when 'AA' then 4.0 when 'A+' then 3.8 when 'A' then 3.6 else 4.0 end - ops * 7.3) * 3.5 else -4 end
   + case when lvl = 'AA' and level_id = 11 then 3 when lvl = 'A+' and level_id in (11, 12) then 3 else 0 end as raw from x),
  r as (select *, cast(floor(greatest(20, least(80, raw)) / 5.0 + 0.5) * 5 as int) as grade from g)
select player_id, season, grp, level_id, grade, case when grade >= 70 then 'Top 100' when grade >= 60 then 'Org top-10' when grade >= 55 then 'Above avg' when grade >= 45 then 'Org depth' else 'Org filler' end as label,
  case when grade >= 60 then 'pos' when grade <= 40 then 'neg' else 'neutral' end as tone, cast(case grade when 80 then 3.2 when 70 then 2.6 when 60 then 2.0 when 55 then 1.3 when 50 then 0.8 when 45 then 0.3 when 40 then 0.06 else 0.3 end as double) as worth from r""")
def scout_grade_q(t):
    hit = F.col("grp") == "hitting"
    g = V.scout_grade(_pick(_LV, F.col("player_id")), F.lit(17) + F.col("player_id") % 14, ~hit, F.col("pa").cast("double"), F.col("ops"),
                      F.col("pa").cast("double"), F.col("ops") * 7.3, F.col("level_id"))
    return t.level.select("player_id", "season", "grp", "level_id", g.alias("grade")).select(
        "*", V.grade_label(F.col("grade")).alias("label"), V.grade_tone(F.col("grade")).alias("tone"), V.grade_value(F.col("grade")).alias("worth"))


@query("VAL-11", "leg_class", f"""
with {_RLEGS} select regime_id, event_id, round(pre, 6) as pre, experience, case when pre >= 2 and experience >= 6 then 'VET-AT-PEAK' when pre <= 1 and experience <= 4 then 'YOUNG-PROSPECT' else 'MIDDLE' end as bucket from rl""")
def leg_class_q(t):
    return rlegs(t).select("regime_id", "event_id", F.round("pre", 6).alias("pre"), "experience", leg_class(F.col("pre"), F.col("experience")).alias("bucket"))


@query("VAL-12", "mechanism", f"""
with {_RLEGS}, b as (select regime_id, case when pre >= 2 and experience >= 6 then 'V' when pre <= 1 and experience <= 4 then 'Y' else 'M' end as k, delta from rl),
  w as (select regime_id, count(*) as n, avg(delta) as m, count(*) filter (where k = 'V') as vn, avg(delta) filter (where k = 'V') as vm, count(*) filter (where k = 'Y') as yn, avg(delta) filter (where k = 'Y') as ym from b group by 1)
select regime_id, n as n_all, round(m, 6) as mean_delta_all, vn as vet_n, round(vm, 6) as vet_mean, yn as young_n, round(ym, 6) as young_mean,
  case when abs(m) < 0.05 then 'neutral' else case when m < 0 then 'negative' else 'positive' end || case when vn < 5 and yn < 5 then ' (small buckets, inconclusive)'
    when vn >= 5 and yn >= 5 and abs(vm) > abs(ym) * 1.5 then ' via SELL-HIGH (vets carry signal)' when vn >= 5 and yn >= 5 and abs(ym) > abs(vm) * 1.5 then ' via SYSTEM-TAX (young players carry signal)'
    when vn >= 5 and yn >= 5 then ' via BOTH mechanisms' when vn >= 5 then ' via SELL-HIGH (vet bucket dominant; young n=' || yn || ')' else ' via SYSTEM-TAX (young bucket dominant; vet n=' || vn || ')' end end as mechanism from w""")
def mechanism_q(t):
    m = mechanism_summary(regime_buckets(rlegs(t))).drop("middle_n", "middle_mean")
    return rounded(m, "mean_delta_all", "vet_mean", "young_mean")


@query("VAL-13", "interval_verdicts", """
with x as (select event_id, team_id, surplus as m, surplus - 1.2816 * (0.8 + n_received * 0.3) as p10, surplus + 1.2816 * (0.8 + n_received * 0.3) as p90 from v_ledger),
  v as (select *, case when p10 > 0 then 'CLEAR WIN' when p90 < 0 then 'CLEAR LOSS' when m > 0 then 'lean +' else 'lean -' end as verdict from x)
select verdict, count(*) as n, round(avg(m), 6) as mean, (select count(*) from v where p10 > 0) as clear_wins, (select count(*) from v where p90 < 0) as clear_losses, round((select median(m) from v), 6) as median_all from v group by 1""")
def interval_verdicts(t):
    from swapledger.functions.scans import exact_quantiles

    half = (F.lit(0.8) + F.col("n_received") * 0.3) * 1.2816
    x = t.ledger.select("event_id", "team_id", F.col("surplus").alias("m"), (F.col("surplus") - half).alias("p10"), (F.col("surplus") + half).alias("p90"))
    x = materialise(x, "intervals")
    counts = x.agg(F.struct(F.count_if(F.col("p10") > 0).alias("w"), F.count_if(F.col("p90") < 0).alias("l"))).scalar()
    med = exact_quantiles(x, [], "m", {"q": 0.5}).select("q").scalar()
    return (
        x.groupBy(R.interval_verdict(F.col("m"), F.col("p10"), F.col("p90")).alias("verdict")).agg(F.count("*").alias("n"), F.round(F.avg("m"), 6).alias("mean"))
        .withColumn("c", counts).select("verdict", "n", "mean", F.col("c.w").alias("clear_wins"), F.col("c.l").alias("clear_losses"), F.round(med, 6).alias("median_all"))
    )


@query("VAL-14", "winners", """
select event_id, arg_max(team_id, surplus * 1e6 - team_id) as winner, round(max(surplus) - min(surplus), 3) as asymmetry, count(*) as n_teams from v_ledger group by 1""")
def winners_q(t):
    return winners(t.ledger)


@query("JOI-23", "mutual_fit", f"""
with {_BOARD}, h as (select team_id, position, case severity when 'critical' then 3.0 when 'warning' then 1.5 else 0.5 end as w from board where kind = 'hole'), sp as (select team_id, position from board where kind = 'surplus'),
  f as (select h.team_id as needy, sp.team_id as holder, sum(w) as sc, count(*) as n from h join sp on sp.position = h.position and sp.team_id <> h.team_id group by 1, 2),
  p as (select a.needy as team_id, a.holder as partner_id, a.n as n_they_fill, b.n as n_you_fill, round(cast(a.sc * b.sc * case when i2.headroom > 20000000 then 1.2 when i2.headroom > 0 then 1.0 else 0.6 end
     * case when (i1.posture = 'buy' and i2.posture = 'sell') or (i1.posture = 'sell' and i2.posture = 'buy') then 1.4 when i1.posture = i2.posture then 0.85 else 1.0 end as double), 6) as score
   from f a join f b on b.needy = a.holder and b.holder = a.needy join idx i1 on i1.team_id = a.needy join idx i2 on i2.team_id = a.holder)
select team_id, partner_id, n_they_fill, n_you_fill, score, rank from (select *, row_number() over (partition by team_id order by score desc, partner_id) as rank from p) where rank <= 10""")
def mutual_fit_q(t):
    return mutual_fit(materialise(board(t), "board"), materialise(index(t), "index")).withColumn("rank", F.col("rank").cast("long"))


_ACC = " or ".join(f"(hole = '{h}' and position in ({', '.join(repr(x) for x in sorted(set(a) | {h}))}))" for h, a in R.ACCEPTS.items())


@query("JOI-24", "buy_low", f"""
with {_ARB}, {_BOARD}, c as (select player_id, team_id, position, last_value, g1 + case when least(3, greatest(1, yc)) > 1 then g2 else 0 end + case when least(3, greatest(1, yc)) > 2 then g3 else 0 end as surplus from a8 where cls <> 'fa'),
  k as (select * from c where last_value > 0 and surplus >= 0.3 and team_id in (select team_id from idx where posture <> 'buy')),
  s as (select distinct k.player_id, k.team_id from k join (select team_id as seller, position as hole from board where kind = 'surplus') b on b.seller = k.team_id where {_ACC}),
  m as (select needy, k.player_id, k.team_id, k.surplus, count(*) as n_holes from k join s on s.player_id = k.player_id and s.team_id = k.team_id
    join (select team_id as needy, position as hole from board where kind = 'hole') h on h.needy <> k.team_id where {_ACC} group by 1, 2, 3, 4)
select needy, player_id, team_id, round(surplus, 6) as surplus, n_holes, rank from (select *, row_number() over (partition by needy order by round(surplus, 6) desc, player_id) as rank from m) where rank <= 12""")
def buy_low_q(t):
    p = with_surplus(t).select("player_id", "team_id", "position", "salary_class", "last_value", F.col("control_surplus").alias("surplus"))
    return R.buy_low(p, materialise(board(t), "board"), materialise(index(t), "index")).select("needy", "player_id", "team_id", F.round("surplus", 6).alias("surplus"), "n_holes", F.col("rank").cast("long").alias("rank"))
