"""Aggregations (AGG), second half: outcomes, rankings, play logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from swapledger.operators import acquired as A
from swapledger.operators import development as D
from swapledger.operators import outcomes as O
from swapledger.operators import playlog as P
from swapledger.operators import summaries as S
from swapledger.operators import teams as T
from swapledger.operators.offsets import offset_window
from swapledger.operators.regimes import regime_legs
from swapledger.operators.regress import materialise
from swapledger.plans.q_aggregates import _COST, _DELTA, cost_by_team, deltas, rounded
from swapledger.plans.registry import query
from swapledger.sources.tables import SCALE


@query("AGG-30", "filtered_aggregates", f"""
with {_DELTA} select to_team, season, count(*) filter (where delta > 0) as n_up, count(*) filter (where delta <= 0) as n_down,
  round(avg(delta) filter (where pre >= 0), 6) as mean_from_good, count(distinct event_id) filter (where post > 1) as events_with_star
from d group by 1, 2""")
def filtered_aggregates(t):
    return deltas(t).groupBy("to_team", "season").agg(
        F.count_if(F.col("delta") > 0).alias("n_up"), F.count_if(F.col("delta") <= 0).alias("n_down"),
        F.round(F.avg(F.when(F.col("pre") >= 0, F.col("delta"))), 6).alias("mean_from_good"),
        F.count_distinct(F.when(F.col("post") > 1, F.col("event_id"))).alias("events_with_star"),
    )


_FALL = """fall as (select * from (values (1994, 4500000.0), (1995, 5000000.0), (1996, 5500000.0), (1997, 6000000.0), (1998, 6500000.0), (1999, 7500000.0),
  (2000, 8000000.0), (2001, 8500000.0), (2002, 9000000.0), (2003, 9000000.0), (2004, 8000000.0), (2005, 8500000.0), (2006, 9000000.0), (2007, 9500000.0), (2008, 10000000.0)) v(season, price))"""
_PRICE = f"""{_FALL}, pc as (select player_id, season, sum(cast(salary as decimal(18,2))) as c from v_psr group by 1, 2),
  emp as (select a.season, cast(sum(a.c) as double) / sum(b.pos) as price from pc a
    left join (select player_id, season, greatest(value, 0.0) as pos from v_psv) b on b.player_id = a.player_id and b.season = a.season
    where a.c is not null group by 1 having sum(b.pos) > 50),
  price as (select coalesce(emp.season, fall.season) as season, coalesce(emp.price, cast(fall.price as double)) as price, emp.price is not null as empirical
    from emp full join fall on fall.season = emp.season)"""


def fallback_prices(t):
    """The fixed price table moved to the fixture's seasons (16 seasons earlier)."""
    from swapledger.sources.constants import season_prices

    return season_prices(t.spark).select((F.col("season") - 16).alias("season"), "price")


def prices(t):
    return O.with_fallback(O.price_curve(O.player_cost(t.paid), t.psv), fallback_prices(t))


@query("AGG-31", "price_curve", f"with {_PRICE} select season, round(price, 4) as price, empirical from price")
def price_curve_q(t):
    return rounded(prices(t), "price", digits=4)


@query("AGG-32", "outcome_matrix", f"""
with {_PRICE}, a as (select event_id, to_team, avg(metric_a_t_plus_1 - metric_a_t_minus_1) as d from v_metric_window
    where metric_a_t_minus_1 is not null and metric_a_t_plus_1 is not null group by 1, 2),
  b as (select event_id, to_team, avg(metric_b_t_plus_1 - metric_b_t_minus_1) as d from v_metric_window
    where metric_b_t_minus_1 is not null and metric_b_t_plus_1 is not null group by 1, 2),
  cap as (select t.event_id, t.to_team, sum(pc.c) as c from v_trade t left join pc on pc.player_id = t.player_id and pc.season = t.season group by 1, 2),
  z as (select l.event_id, l.team_id as to_team, l.season, a.d as da, b.d as db, l.surplus, coalesce(l.received * coalesce(p.price, 8e6), 0) - coalesce(cast(cap.c as double), 0) as ds,
    coalesce(p.price, 8e6) as pr
  from v_ledger l left join price p on p.season = l.season left join a on a.event_id = l.event_id and a.to_team = l.team_id
  left join b on b.event_id = l.event_id and b.to_team = l.team_id left join cap on cap.event_id = l.event_id and cap.to_team = l.team_id)
select event_id, to_team, season, round(da, 6) as metric_a_delta, round(db, 6) as metric_b_delta, surplus, round(ds, 4) as dollar_surplus, round(ds / pr, 6) as surplus_wins from z""")
def outcome_matrix_q(t):
    t = t.for_outcomes()
    base = t.ledger.withColumnRenamed("team_id", "to_team")
    window = offset_window(t.ledger_trade, t.metric, [-1, 1], ["metric_a", "metric_b"])
    rates = A.mean_deltas(window, {"metric_a": "metric_a_delta", "metric_b": "metric_b_delta"})
    m = O.outcome_matrix(
        base,
        [rates.select("event_id", "to_team", "metric_a_delta", "metric_b_delta")],
        prices(t).drop("empirical"), O.acquired_cost(t.ledger_trade, t.paid),
    )
    return m.select(
        "event_id", "to_team", "season", F.round("metric_a_delta", 6).alias("metric_a_delta"),
        F.round("metric_b_delta", 6).alias("metric_b_delta"), "surplus",
        F.round("dollar_surplus", 4).alias("dollar_surplus"), F.round("surplus_wins", 6).alias("surplus_wins"),
    )


@query("AGG-33", "windowed_outcome", """
with x as (select event_id, to_team, season, leg_index, coalesce(value_t_plus_2, 0) + coalesce(value_t_plus_3, 0) + coalesce(value_t_plus_4, 0) + coalesce(value_t_plus_5, 0) as w from v_window)
select event_id, to_team, season, round(sum(w), 6) as value_total, round(sum(w) / nullif(count(distinct leg_index), 0), 6) as value_delta from x group by 1, 2, 3""")
def windowed_outcome_q(t):
    return rounded(O.windowed_outcome(t.trade, t.psv, 2, 5), "value_total", "value_delta")


@query("AGG-34", "controlled_surplus", """
with r as (select distinct event_id, to_team, player_id, season, coalesce(value_t_plus_1, 0) + coalesce(value_t_plus_2, 0) + coalesce(value_t_plus_3, 0) as w from v_window),
  p as (select r.event_id, r.to_team, r.player_id, r.w, cast(sum(cast(s.salary as decimal(18,2))) filter (where s.season between r.season and r.season + 3) as double)
      / nullif(count(s.salary) filter (where s.season between r.season and r.season + 3), 0) as a
    from r left join v_psr s on s.player_id = r.player_id group by 1, 2, 3, 4)
select event_id, to_team, round(sum(w), 6) as total_value, round(sum(coalesce(a, 0)), 6) as total_salary, count(*) filter (where a is null) as missing, count(*) as n_players,
  round(sum(w) * 8000000.0 - sum(coalesce(a, 0)), 4) as total,
  case when count(*) filter (where a is null) > 0 then 'salary missing for ' || cast(count(*) filter (where a is null) as varchar) || '/' || cast(count(*) as varchar) || ' player(s)' else '' end as notes
from p group by 1, 2""")
def controlled_surplus_q(t):
    c = O.controlled_surplus(t.trade, t.psv, t.psr)
    return c.select("event_id", "to_team", F.round("total_value", 6).alias("total_value"), F.round("total_salary", 6).alias("total_salary"),
                    "missing", "n_players", F.round("total", 4).alias("total"), "notes")


_NAMES_SQL = """
select event_id, to_team, {part}string_agg(coalesce(p_name, '#' || cast(player_id as varchar)), ', ' order by leg_index) as names,
  string_agg(distinct cast(from_team as varchar), ',' order by cast(from_team as varchar)) as senders
from v_trade left join part on p_partkey = player_id and p_size <= 25 group by {by}"""


def names_of(t, part_legs: int | None = None):
    """Names in leg order with a fallback label: one string per event and receiver, or with ``part_legs`` one per so many legs of an event."""
    names = t.base("part").where("p_size <= 25").select(F.col("p_partkey").alias("player_id"), "p_name")
    keys = "event_id, to_team" + (", part" if part_legs else "")
    part = [F.floor(F.col("leg_index") / part_legs).alias("part")] if part_legs else []
    j = t.numbered_trade.join(names, "player_id", "left").select(
        "event_id", "to_team", "leg_index", *part, F.col("from_team").cast("string").alias("sender"),
        F.coalesce("p_name", F.concat(F.lit("#"), F.col("player_id").cast("string"))).alias("label"))
    return t.spark.sql(f"""
        select {keys}, listagg(label, ', ') within group (order by leg_index) as names,
          listagg(distinct sender, ',') within group (order by sender) as senders
        from {{legs}} group by {keys}""", legs=j)


@query("AGG-35", "ordered_names", _NAMES_SQL.format(part="", by="1, 2"))
def ordered_names(t):
    """All names of an event and receiver in one string, however many legs."""
    return names_of(t)


@query("AGG-35", "ordered_names_in_parts", _NAMES_SQL.format(part="leg_index // 2 as part, ", by="1, 2, 3"))
def ordered_names_in_parts(t):
    """The same with a bound of two legs, so that ordinary events are cut too."""
    return names_of(t, 2)


_CAREER = "career as (select player_id, sum(value) as career_value, min(season) as first_season from v_psv group by 1)"


def picks(t):
    """Draft analogue: part size is the round (as text), part key the pick."""
    return t.base("part").where("p_size <= 25").select(
        F.col("p_partkey").alias("player_id"), F.col("p_brand").alias("team"),
        F.when(F.col("p_size") % 12 == 0, F.concat(F.lit("CB-"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string")).alias("round_text"),
    )


def careers(t, min_value=0.0):
    c = t.psv.groupBy("player_id").agg(F.sum("value").alias("career_value"), F.min("season").alias("first_season"))
    return c


_PICKS = "picks as (select p_partkey as player_id, p_brand as team, case when p_size % 12 = 0 then 'CB-' || cast(p_size as varchar) else cast(p_size as varchar) end as round_text from part where p_size <= 25)"


@query("AGG-36", "draft_rollup", f"""
with {_CAREER}, {_PICKS}, c as (select * from career where first_season >= 1995 and career_value > -2)
select team, count(*) as picks, count(career_value) as reached, round(coalesce(sum(career_value), 0), 6) as total_value, round(avg(career_value), 6) as mean_value,
  round(median(career_value), 6) as median_value, round(count(career_value) * 1.0 / count(*), 6) as reach_rate
from picks left join c on c.player_id = picks.player_id group by 1""")
def draft_rollup_q(t):
    return rounded(D.draft_rollup(picks(t), careers(t).where("career_value > -2").drop("first_season")), "total_value", "mean_value", "median_value", "reach_rate")


@query("AGG-37", "hit_rates", f"""
with {_CAREER}, {_PICKS}, c as (select * from career where career_value > -2)
select try_cast(round_text as int) as round, count(*) as picks, round(count(career_value) * 1.0 / count(*), 6) as reach_rate,
  round(count(*) filter (where career_value > 1.5) * 1.0 / count(*), 6) as hit_rate
from picks left join c on c.player_id = picks.player_id where try_cast(round_text as int) between 1 and 10 group by 1""")
def hit_rates_q(t):
    return rounded(D.hit_rates(picks(t), careers(t).where("career_value > -2"), 10, 1.5), "reach_rate", "hit_rate")


_FOLD = "case {0} when 24 then 23 when 22 then 21 else {0} end"


@query("AGG-37", "scout_to_sign", f"""
with {_PICKS}, f as (select player_id, arg_min(team_id, season * 1000 + team_id) as first_team from v_psr where player_id % 5 <> 0 group by 1),
  j as (select try_cast(round_text as int) as round, {_FOLD.format("cast(replace(team, 'Brand#', '') as int) % 25")} as a, {_FOLD.format("first_team")} as b from picks left join f on f.player_id = picks.player_id)
select round, count(*) as picks, count(b) as n_reached, count(*) filter (where a = b) as n_own, round(count(b) * 1.0 / count(*), 6) as reach_rate,
  round(count(*) filter (where a = b) * 1.0 / case when count(b) = 0 then 1 else count(b) end, 6) as sign_rate from j where round between 1 and 15 group by 1""")
def scout_to_sign_q(t):
    """Brand numbers stand for drafting teams; every fifth player never played."""
    drafted = picks(t).withColumn("team", F.substring("team", 7, 9).cast("int") % 25)
    first = D.first_team(t.psr.where("player_id % 5 <> 0"), ["season", "team_id"])
    return rounded(D.scout_to_sign(drafted, first, {24: 23, 22: 21}), "reach_rate", "sign_rate")


@query("AGG-38", "development_credit", f"""
with {_CAREER}, {_DELTA},
  f as (select player_id, arg_min(team_id, season * 1000 + team_id) as team from v_psr group by 1),
  c as (select career.*, case f.team when 24 then 23 when 22 then 21 else f.team end as team from career join f on f.player_id = career.player_id),
  dev as (select team, count(*) as n_debuts, sum(career_value) as dev_value from c group by 1),
  fr as (select team, count(*) as n_undrafted, sum(career_value) as undrafted_value from c where not exists (select 1 from part where p_partkey = c.player_id and p_size <= 25) group by 1),
  mv as (select from_team as team, count(*) as n, avg(delta) as m from d group by 1),
  tr as (select case team when 24 then 23 when 22 then 21 else team end as team, cast(sum(n) as bigint) as n_trades, avg(m) as mean_delta, sum(m * n) / sum(n) as weighted_delta from mv group by 1)
select dev.team, n_debuts, round(dev_value, 6) as dev_value, n_undrafted, round(undrafted_value, 6) as undrafted_value, n_trades, round(mean_delta, 6) as mean_delta, round(weighted_delta, 6) as weighted_delta
from dev left join fr on fr.team = dev.team left join tr on tr.team = dev.team""")
def development_credit_q(t):
    first = D.first_team(t.psr, ["season", "team_id"]).withColumnRenamed("first_team", "team")
    c = careers(t).join(first, "player_id")
    moves = deltas(t).groupBy(F.col("from_team").alias("team")).agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"))
    return rounded(
        D.development_credit(c, picks(t), moves, {24: 23, 22: 21}, 1990, 1995),
        "dev_value", "undrafted_value", "mean_delta", "weighted_delta",
    )


_RLEGS = """rl as (select w.event_id, w.leg_index, r.regime_id, w.value_t_minus_1 as pre, w.value_t_plus_1 - w.value_t_minus_1 as delta, w.season - f.first_season as experience
  from v_window w join v_regime r on r.team_id = w.from_team and r.season = w.season left join (select player_id, min(season) as first_season from v_psv group by 1) f on f.player_id = w.player_id
  where w.value_t_minus_1 is not null and w.value_t_plus_1 is not null)"""


def rlegs(t):
    return regime_legs(t.window, t.regime, t.psv)


@query("AGG-39", "regime_summary", f"""
with {_RLEGS} select regime_id, count(*) as n, round(avg(delta), 6) as mean, round(median(delta), 6) as median, round(stddev_samp(delta), 6) as sd,
  round(min(delta), 6) as lowest, round(max(delta), 6) as highest from rl group by 1""")
def regime_summary(t):
    return rounded(S.distribution(materialise(rlegs(t).select("regime_id", "delta"), "regime-legs"), ["regime_id"], "delta"), "mean", "median", "sd", "lowest", "highest")


@query("AGG-40", "trimmed_mean", f"""
with {_RLEGS}, r as (select regime_id, delta, row_number() over (partition by regime_id order by delta) as a, row_number() over (partition by regime_id order by delta desc) as b, count(*) over (partition by regime_id) as n from rl)
select regime_id, n, round(avg(delta), 6) as mean, round(case when n > 7 then avg(delta) filter (where a > 3 and b > 3) else avg(delta) end, 6) as trimmed_mean from r group by 1, 2""")
def trimmed_mean_q(t):
    return rounded(S.trimmed_mean(rlegs(t), "regime_id", "delta", 3, 7), "mean", "trimmed_mean")


@query("AGG-41", "events_per_season", """
select a.season, a.n_all, b.n_trades from (select season, count(distinct event_id) as n_all from v_leg group by 1) a
left join (select season, count(distinct event_id) as n_trades from v_trade group by 1) b on b.season = a.season""")
def events_per_season(t):
    """Both scopes from one scan."""
    return t.leg.groupBy("season").agg(
        F.count_distinct("event_id").alias("n_all"),
        F.count_distinct(F.when(F.col("type_code") == "F", F.col("event_id"))).alias("n_trades"),
    )


def plays(t):
    """Plays of the whole event log."""
    log = t.log
    return plays_of(log, t.log_is_split)


def plays_of(log, split=False):
    """An event log as plays: an error opens a half, a signup brings in a pitcher."""
    log = (
        log.withColumn("chg", (F.col("event_type") == "error").cast("int"))
        .withColumn("p0", F.when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0), F.col("event_id")))
        .withColumn("p1", F.when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 1), F.col("event_id")))
        .withColumn("n_outs", (F.col("event_type") == "view").cast("int"))
    )
    s = P.carry_state(log, "game_id", "bucket", ["ts", "event_id"], "chg", "p0", "p1", "n_outs", split)
    zero = F.lit(0)
    return s.where(~F.col("event_type").isin("error", "signup")).withColumn(
        "li", P.leverage_index(F.col("inning"), F.col("half"), F.col("outs_before"), zero, zero)
    ).withColumn("seq", F.struct("ts", "event_id"))


_PLAYS = """st as (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by game_id order by seq) as half_no,
    last_value(case when event_type = 'signup' and event_id % 2 = 0 then event_id end ignore nulls) over (partition by game_id order by seq) as p0,
    last_value(case when event_type = 'signup' and event_id % 2 = 1 then event_id end ignore nulls) over (partition by game_id order by seq) as p1 from v_log),
  st2 as (select *, cast(half_no % 2 as int) as half, cast(half_no // 2 + 1 as int) as inning, case when half_no % 2 = 0 then p1 else p0 end as pitcher,
    cast(coalesce(sum(case when event_type = 'view' then 1 else 0 end) over (partition by game_id, half_no order by seq rows between unbounded preceding and 1 preceding), 0) % 3 as int) as outs_before from st),
  pl as (select *, round(coalesce(case when (least(inning, 9), half, outs_before) = (9, 1, 0) then 2.0 when (least(inning, 9), half, outs_before) = (7, 1, 0) then 1.2
      when (inning, half, outs_before) = (1, 0, 0) then 0.5 when (inning, half, outs_before) = (2, 0, 0) then 0.55 when (inning, half, outs_before) = (3, 0, 1) then 0.65 end,
      0.4 + (least(inning, 9) - 1) * 0.15), 3) as li from st2 where event_type not in ('error', 'signup')),
  app as (select game_id, pitcher, count(*) as n_batters, avg(cast(li as double)) as avg_li, avg(case when li >= 1.5 then 1.0 else 0.0 end) as share_high, avg(case when li < 0.7 then 1.0 else 0.0 end) as share_low,
    arg_min(inning, seq) > 1 as is_reliever from pl where pitcher is not null group by 1, 2)"""


@query("AGG-42", "appearances", f"""
with {_PLAYS} select game_id, pitcher, n_batters, round(avg_li, 9) as avg_li, round(share_high, 9) as share_high, round(share_low, 9) as share_low, is_reliever from app""")
def appearances_q(t):
    return rounded(P.appearances(plays(t)), "avg_li", "share_high", "share_low", digits=9)


@query("AGG-43", "reliever_shares", f"""
with {_PLAYS} select game_id % 25 as team_id, cast(2024 as int) as season, round(avg(share_high), 4) as reliever_high, round(avg(share_low), 4) as reliever_low
from app where is_reliever and n_batters >= 1 group by 1""")
def reliever_shares_q(t):
    apps = P.appearances(plays(t)).withColumn("team_id", F.col("game_id") % 25).withColumn("season", F.lit(2024))
    return P.reliever_shares(apps)


# Play codes that the fixture's event ids stand for, one per residue.
CODES = ["S7", "K", "HR/F78", "D8/L", "T9", "W", "IW", "HP", "53", "64(1)3/GDP", "FC5", "E6", "C/E2", "SB2", "WP", "POCS2(1361)",
         "K+WP", "H/L7", "NP", "63/TP", "8/F8.3-H", "I", "CS3", "DI", "S8.1-3"]


def code_column():
    return F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.col("event_id") % len(CODES) + 1).cast("int"))


_CLASS = {"S7": (20, 1, 0), "K": (3, 1, 1), "HR/F78": (23, 1, 0), "D8/L": (21, 1, 0), "T9": (22, 1, 0), "W": (14, 1, 0), "IW": (15, 1, 0), "HP": (16, 1, 0),
          "53": (2, 1, 1), "64(1)3/GDP": (2, 1, 2), "FC5": (2, 1, 1), "E6": (2, 1, 0), "C/E2": (2, 1, 0), "SB2": (0, 0, 0), "WP": (0, 0, 0), "POCS2(1361)": (0, 0, 0),
          "K+WP": (3, 1, 1), "H/L7": (23, 1, 0), "NP": (0, 0, 0), "63/TP": (2, 1, 3), "8/F8.3-H": (2, 1, 1), "I": (15, 1, 0), "CS3": (0, 0, 0), "DI": (0, 0, 0), "S8.1-3": (20, 1, 0)}
_CODE_ROWS = ", ".join(f"({i}, '{c}', {_CLASS[c][0]}, {_CLASS[c][1]}, {_CLASS[c][2]})" for i, c in enumerate(CODES))


@query("AGG-44", "platoon_split", f"""
with code as (select * from (values {_CODE_ROWS}) v(i, code, klass, pa, outs)),
  p as (select user_id % 25 as team_id, case when event_id % 2 = 0 then 'L' else 'R' end as bat_hand, case when user_id % 3 = 0 then 'L' else 'R' end as pit_hand,
    case klass when 14 then 0.69 when 15 then 0.69 when 16 then 0.72 when 20 then 0.89 when 21 then 1.27 when 22 then 1.62 when 23 then 2.10 else 0.0 end as w
    from events join code on code.i = event_id % {len(CODES)} where pa = 1),
  a as (select team_id, round(avg(case when bat_hand = pit_hand then cast(w as double) end), 4) as same_hand, round(avg(case when bat_hand <> pit_hand then cast(w as double) end), 4) as opp_hand from p group by 1)
select team_id, cast(2024 as int) as season, same_hand, opp_hand, round(opp_hand - same_hand, 4) as platoon_diff from a where same_hand is not null and opp_hand is not null""")
def platoon_split_q(t):
    klass, is_pa, _ = P.play_class(code_column())
    e = t.base("events").where(is_pa).select(
        (F.col("user_id") % 25).alias("team_id"), F.lit(2024).alias("season"), klass.alias("klass"),
        F.when(F.col("event_id") % 2 == 0, "L").otherwise("R").alias("bat_hand"),
        F.when(F.col("user_id") % 3 == 0, "L").otherwise("R").alias("pit_hand"),
    )
    return P.platoon_split(e)


_AWARD = "case p_type when 'PROMO' then 'AL MVP' when 'SMALL' then 'NL Cy Young' when 'MEDIUM' then 'Rawlings AL Gold Glove' when 'LARGE' then 'All-Star Game MVP' when 'ECONOMY' then 'Silver Slugger' else 'Player of the Week' end"


def award_names():
    m = {"PROMO": "AL MVP", "SMALL": "NL Cy Young", "MEDIUM": "Rawlings AL Gold Glove", "LARGE": "All-Star Game MVP", "ECONOMY": "Silver Slugger"}
    out = F.lit("Player of the Week")
    for k, v in m.items():
        out = F.when(F.col("p_type") == k, v).otherwise(out)
    return out


@query("AGG-45", "award_buckets", f"""
with a as (select player_id, case n when 'AL MVP' then 'mvp' when 'NL Cy Young' then 'cy_young' when 'Rawlings AL Gold Glove' then 'gold_glove' when 'All-Star Game MVP' then 'all_star'
    when 'Silver Slugger' then 'silver_slugger' else 'other' end as b from (select player_id, {_AWARD} as n from v_leg join part on p_partkey = supp_id where priority = '1-URGENT'))
select player_id, count(*) filter (where b = 'all_star') as all_star, count(*) filter (where b = 'mvp') as mvp, count(*) filter (where b = 'cy_young') as cy_young,
  count(*) filter (where b = 'silver_slugger') as silver_slugger, count(*) filter (where b = 'gold_glove') as gold_glove, cast(0 as bigint) as rookie_of_year, count(*) as total from a group by 1""")
def award_buckets(t):
    aw = t.leg.where("priority = '1-URGENT'").join(t.base("part"), F.col("supp_id") == F.col("p_partkey")).select("player_id", award_names().alias("award_name"))
    return S.award_summary(aw)


@query("AGG-46", "payroll_by_type", """
select team_id, season, cast(sum(case when role = 'B' then cast(salary as decimal(18,2)) end) as double) as active, cast(sum(case when role = 'P' then cast(salary as decimal(18,2)) end) as double) as dead,
  cast(sum(cast(salary as decimal(18,2))) as double) as total, count(salary) as n_contracts from v_psr group by 1, 2""")
def payroll_by_type(t):
    """Totals per table type side by side."""
    money = F.col("salary").cast("decimal(18,2)")
    part = lambda r: F.sum(F.when(F.col("role") == r, money)).cast("double")
    return t.psr.groupBy("team_id", "season").agg(
        part("B").alias("active"), part("P").alias("dead"), F.sum(money).cast("double").alias("total"), F.count("salary").alias("n_contracts")
    )


@query("AGG-46", "payroll_with_injured", """
with k as (select team_id, season, cast(salary as decimal(18,2)) as m, case when role = 'P' then 'dead' when games >= 2 then 'injured' else 'active' end as kind from v_psr)
select team_id, season, cast(sum(m) filter (where kind = 'active') as double) as active, cast(sum(m) filter (where kind = 'dead') as double) as dead,
  cast(sum(m) filter (where kind = 'injured') as double) as injured, cast(sum(m) as double) as total from k group by 1, 2""")
def payroll_with_injured(t):
    """Pitching rows stand for the dead table, players of several games for the injured one."""
    kind = F.when(F.col("role") == "P", "dead").when(F.col("games") >= 2, "injured").otherwise("active")
    money = F.col("salary").cast("decimal(18,2)")
    part = lambda k: F.sum(F.when(F.col("kind") == k, money)).cast("double").alias(k)
    return t.psr.withColumn("kind", kind).groupBy("team_id", "season").agg(
        part("active"), part("dead"), part("injured"), F.sum(money).cast("double").alias("total"))


@query("AGG-46", "contract_breakdown", """
with c as (select team_id, season, case when player_id % 7 = 0 then null when player_id % 7 = 1 then '' else role end as status, salary, games from v_psr)
select c.team_id, c.season, status, count(*) as n, cast(sum(cast(salary as decimal(18,2))) as double) as total_cap, round(avg(games), 6) as mean_service
from c join (select team_id, max(season) as s from c group by 1) l on l.team_id = c.team_id and l.s = c.season where status is not null and status <> '' group by 1, 2, 3""")
def contract_breakdown_q(t):
    status = F.when(F.col("player_id") % 7 == 0, F.lit(None)).when(F.col("player_id") % 7 == 1, "").otherwise(F.col("role"))
    c = S.contract_breakdown(t.psr.withColumn("status", status), "team_id", "status", F.col("salary").cast("decimal(18,2)"), F.col("games"))
    return rounded(c.withColumn("total_cap", F.col("total_cap").cast("double")), "mean_service")


@query("AGG-47", "era_variance", f"""
with {_DELTA} select to_team, round(stddev_samp(case when season < 1998 then delta end), 6) as sd_early, round(stddev_samp(case when season >= 1998 then delta end), 6) as sd_late,
  round(stddev_samp(case when season >= 1998 then delta end) / nullif(stddev_samp(case when season < 1998 then delta end), 0), 6) as ratio from d group by 1""")
def era_variance(t):
    late = F.col("season") >= 1998
    sd = lambda c: F.stddev_samp(F.when(c, F.col("delta")))
    return rounded(deltas(t).groupBy("to_team").agg(sd(~late).alias("sd_early"), sd(late).alias("sd_late"), F.try_divide(sd(late), sd(~late)).alias("ratio")), "sd_early", "sd_late", "ratio")


@query("AGG-48", "variance_split", f"""
with {_DELTA}, p as (select from_team, season, avg(delta) as m, var_samp(delta) as v from d group by 1, 2),
  q as (select from_team, var_samp(m) as b, avg(v) as w from p group by 1), tt as (select from_team, var_samp(delta) as tv from d group by 1)
select tt.from_team, round(tv, 6) as total_var, round(b, 6) as between_var, round(w, 6) as within_var, case when b > w * 1.5 then 'between' when w > b * 1.5 then 'within' else 'mixed' end as verdict
from tt join q on q.from_team = tt.from_team""")
def variance_split_q(t):
    return rounded(S.variance_split(deltas(t), "from_team", "season", "delta"), "total_var", "between_var", "within_var")


@query("AGG-49", "team_trajectory", """
with r as (select team_id, season, cast(sum(value_amt) filter (where role = 'B') as double) as b, cast(sum(value_amt) filter (where role = 'P') as double) as p, cast(sum(value_amt) as double) / 1009 as v from v_psr group by 1, 2)
select s.team_id, s.season, cast(s.wins as bigint) as wins, cast(s.losses as bigint) as losses, r.b as hitting_stat, r.p as pitching_stat, r.v as total_value
from v_standing s left join r on r.team_id = s.team_id and r.season = s.season""")
def team_trajectory(t):
    per_group = t.psr.groupBy("team_id", "season", "role").agg(F.sum("value_amt").alias("v"))
    stat = lambda r: F.max(F.when(F.col("role") == r, F.col("v"))).cast("double")
    wide = per_group.groupBy("team_id", "season").agg(
        stat("B").alias("hitting_stat"), stat("P").alias("pitching_stat"), (F.sum("v").cast("double") / SCALE).alias("total_value"))
    return t.standing.join(wide, ["team_id", "season"], "left")


@query("AGG-50", "trade_summary_per_team", """
select team_id, count(*) as n, round(avg(surplus), 6) as mean_surplus, round(avg(received), 6) as mean_received, count(*) filter (where surplus > 0) as n_positive,
  min(surplus) as worst, max(surplus) as best, arg_max(event_id, surplus * 1e6 - event_id / 1e6) as best_event from v_ledger group by 1""")
def trade_summary_per_team(t):
    return t.ledger.groupBy("team_id").agg(
        F.count("*").alias("n"), F.round(F.avg("surplus"), 6).alias("mean_surplus"), F.round(F.avg("received"), 6).alias("mean_received"),
        F.count_if(F.col("surplus") > 0).alias("n_positive"), F.min("surplus").alias("worst"), F.max("surplus").alias("best"),
        F.max_by("event_id", F.struct("surplus", -F.col("event_id"))).alias("best_event"),
    )


@query("AGG-50", "recent_trades_per_team", """
select team_id, event_id, season, n_received, n_given, received, given, surplus, rank from (
  select *, row_number() over (partition by team_id order by season desc, abs(surplus) desc nulls last, event_id) as rank from v_ledger) where rank <= 12""")
def recent_trades_per_team(t):
    return S.recent_rows(t.ledger, "team_id").select(
        "team_id", "event_id", "season", "n_received", "n_given", "received", "given", "surplus", "rank")


@query("AGG-51", "largest_flows", """
select event_id, round(sum(abs(coalesce(surplus, 0))), 3) as flow, count(*) as n_teams from v_ledger group by 1 order by flow desc nulls last, event_id limit 100""")
def largest_flows(t):
    g = t.ledger.groupBy("event_id").agg(F.round(F.sum(F.abs(F.coalesce("surplus", F.lit(0.0)))), 3).alias("flow"), F.count("*").alias("n_teams"))
    return g.orderBy(F.desc_nulls_last("flow"), "event_id").limit(100)


@query("AGG-52", "positional_breakdown", """
with x as (select r.team_id, r.season, case when p.p_type in ('PROMO', 'SMALL') then 'P' when p.p_type = 'MEDIUM' then 'C' when p.p_type in ('LARGE', 'ECONOMY') then 'IF' else 'OF' end as pos,
   p.p_size as age, greatest(cast(r.value_amt as double), 0) as v from v_psr r join part p on p.p_partkey = r.player_id)
select team_id, season, count(*) filter (where pos = 'P') as n_p, count(*) filter (where pos = 'C') as n_c, count(*) filter (where pos = 'IF') as n_if, count(*) filter (where pos = 'OF') as n_of,
  round(sum(age * v) / (1 + sum(v)), 6) as weighted_age from x group by 1, 2""")
def positional_breakdown(t):
    """The weighted age keeps the original's denominator, which starts at 1."""
    p = t.base("part").select(F.col("p_partkey").alias("player_id"), "p_type", "p_size")
    x = t.psr.join(p, "player_id").withColumn(
        "pos", F.when(F.col("p_type").isin("PROMO", "SMALL"), "P").when(F.col("p_type") == "MEDIUM", "C").when(F.col("p_type").isin("LARGE", "ECONOMY"), "IF").otherwise("OF")
    ).withColumn("v", F.greatest(F.col("value_amt").cast("double"), F.lit(0.0)))
    n = lambda k: F.count_if(F.col("pos") == k).alias(f"n_{k.lower()}")
    return x.groupBy("team_id", "season").agg(
        n("P"), n("C"), n("IF"), n("OF"), F.round(F.sum(F.col("p_size") * F.col("v")) / (F.lit(1.0) + F.sum("v")), 6).alias("weighted_age"))


@query("AGG-53", "last_season", """
select r.player_id, r.season, cast(sum(value_amt) as double) / 1009 as last_value, max(salary) as last_salary from v_psr r
join (select player_id, max(season) as y from v_psr group by 1) m on m.player_id = r.player_id and m.y = r.season group by 1, 2""")
def last_season(t):
    """Totals per season first, then the newest season per player; no join back."""
    s = t.psr.groupBy("player_id", "season").agg((F.sum("value_amt").cast("double") / SCALE).alias("last_value"), F.max("salary").alias("last_salary"))
    return s.groupBy("player_id").agg(F.max_by(F.struct("season", "last_value", "last_salary"), "season").alias("x")).select("player_id", "x.*")


_COACH = "coach as (select team_id, season, person as coach from v_office where role = '5-LOW')"


@query("AGG-54", "coach_jump", f"""
with {_COACH} select c.coach, w.season, round(avg(w.metric_a_t_plus_1 - w.metric_a_t_minus_1), 6) as jump, count(*) as n from v_metric_window w
join coach c on c.team_id = w.to_team and c.season = w.season where w.metric_a_t_minus_1 is not null and w.metric_a_t_plus_1 is not null group by 1, 2""")
def coach_jump(t):
    coach = t.office.where("role = '5-LOW'").select(F.col("team_id").alias("to_team"), "season", F.col("person").alias("coach"))
    w = t.metric_window.where(F.col("metric_a_t_minus_1").isNotNull() & F.col("metric_a_t_plus_1").isNotNull())
    return w.join(coach, ["to_team", "season"]).groupBy("coach", "season").agg(
        F.round(F.avg(F.col("metric_a_t_plus_1") - F.col("metric_a_t_minus_1")), 6).alias("jump"), F.count("*").alias("n"))


@query("AGG-55", "rate_baseline", """
with d as (select event_id, season, to_team as team_id, metric_a_t_plus_1 - metric_a_t_minus_1 as r, 0.0 as s from v_metric_window
  union all select event_id, season, from_team, 0.0, metric_a_t_plus_1 - metric_a_t_minus_1 from v_metric_window),
  n as (select event_id, team_id, season, coalesce(sum(case when r is null then 0 else r end), 0) - coalesce(sum(case when s is null then 0 else s end), 0) as net from d group by 1, 2, 3)
select season, count(*) as n, round(avg(net), 6) as mean, round(median(net), 6) as median, round(stddev_samp(net), 6) as sd, round(min(net), 6) as lowest, round(max(net), 6) as highest from n group by 1""")
def rate_baseline(t):
    from swapledger.operators.windows import both_sides

    net = both_sides(t.metric_window.withColumn("d", F.col("metric_a_t_plus_1") - F.col("metric_a_t_minus_1")), "d")
    return rounded(S.distribution(materialise(net.select("season", "net"), "rate-net"), ["season"], "net"), "mean", "median", "sd", "lowest", "highest")


_PLACE = f"""{_DELTA}, f as (select player_id, arg_min(team_id, season * 1000 + team_id) as team from v_psr group by 1), {_CAREER},
  dev as (select f.team, avg(career_value) as dev_mean from career join f on f.player_id = career.player_id group by 1), tr as (select from_team as team, avg(delta) as trade_mean from d group by 1)"""


def placement_axes(t):
    first = D.first_team(t.psr, ["season", "team_id"]).withColumnRenamed("first_team", "team")
    dev = careers(t).join(first, "player_id").groupBy("team").agg(F.avg("career_value").alias("dev_mean"))
    tr = deltas(t).groupBy(F.col("from_team").alias("team")).agg(F.avg("delta").alias("trade_mean"))
    return dev.join(tr, "team")


@query("AGG-56", "org_placement", f"""
with {_PLACE}, j as (select dev.team, dev_mean, trade_mean from dev join tr on tr.team = dev.team)
select team, round(dev_mean, 6) as dev_mean, round(trade_mean, 6) as trade_mean, round((select avg(dev_mean) from j), 6) as dev_line, round((select avg(trade_mean) from j), 6) as trade_line from j""")
def org_placement(t):
    j = placement_axes(t)
    lines = j.agg(F.struct(F.avg("dev_mean").alias("d"), F.avg("trade_mean").alias("m"))).scalar()
    return j.withColumn("l", lines).select(
        "team", F.round("dev_mean", 6).alias("dev_mean"), F.round("trade_mean", 6).alias("trade_mean"),
        F.round("l.d", 6).alias("dev_line"), F.round("l.m", 6).alias("trade_line"))


@query("AGG-57", "career_series", """
with a as (select l_partkey as player_id, cast(year(l_shipdate) as int) as season, l_returnflag as pitch_type, count(*) as n from lineitem group by 1, 2, 3),
  s as (select player_id, season, cast(sum(value_amt) as double) / 1009 as value, max(salary) as max_salary from v_psr group by 1, 2)
select s.player_id, s.season, s.value, s.max_salary, coalesce(sum(n) filter (where pitch_type = 'A'), 0)::bigint as use_a, coalesce(sum(n) filter (where pitch_type = 'N'), 0)::bigint as use_n,
  coalesce(sum(n) filter (where pitch_type = 'R'), 0)::bigint as use_r from s join a on a.player_id = s.player_id and a.season = s.season group by 1, 2, 3, 4""")
def career_series(t):
    use = (
        t.base("lineitem").groupBy(F.col("l_partkey").alias("player_id"), F.year("l_shipdate").alias("season"))
        .pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)
        .toDF("player_id", "season", "use_a", "use_n", "use_r")
    )
    s = t.psr.groupBy("player_id", "season").agg((F.sum("value_amt").cast("double") / SCALE).alias("value"), F.max("salary").alias("max_salary"))
    return s.join(use, ["player_id", "season"])


@query("AGG-57", "latest_years", """
with s as (select player_id, season, sum(value_amt) as v, max(salary) as salary from v_psr group by 1, 2), m as (select player_id, max(season) as y from s group by 1)
select m.player_id, m.y as last_season, cast(a.v as double) / 1009 as last_value, a.salary as last_salary, cast(a.v - b.v as double) / 1009 as movement,
  cast((select sum(c.v) from s c where c.player_id = m.player_id and c.season > m.y - 3) as double) / 1009 as recent_value
from m join s a on a.player_id = m.player_id and a.season = m.y left join s b on b.player_id = m.player_id and b.season = m.y - 1""")
def latest_years_q(t):
    s = t.psr.groupBy("player_id", "season").agg(F.sum("value_amt").alias("value_units"), F.max("salary").alias("salary"))
    out = S.latest_years(s)
    scaled = {c: F.col(c).cast("double") / SCALE for c in ("last_value", "movement", "recent_value")}
    return out.withColumns(scaled)


@query("AGG-58", "dominant_role", """
select player_id, cast(coalesce(sum(games) filter (where role = 'P'), 0) as bigint) as games_pitching, cast(coalesce(sum(games) filter (where role = 'B'), 0) as bigint) as games_batting,
  coalesce(sum(games) filter (where role = 'P'), 0) >= coalesce(sum(games) filter (where role = 'B'), 0) as is_pitcher from v_psr group by 1""")
def dominant_role(t):
    g = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("games"))), F.lit(0))
    return t.psr.groupBy("player_id").agg(g("P").alias("games_pitching"), g("B").alias("games_batting"), (g("P") >= g("B")).alias("is_pitcher"))
