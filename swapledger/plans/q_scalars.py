"""Scalar functions (SCA)."""

from __future__ import annotations

from pyspark.sql import functions as F

from swapledger.functions import network as N
from swapledger.functions import scalars as S
from swapledger.functions.documents import parse_report
from swapledger.functions.valuation import playoff_chance
from swapledger.operators import playlog as P
from swapledger.operators.legs import event_rollup
from swapledger.operators.teams import division_race
from swapledger.plans.q_summaries import _CODE_ROWS, CODES, code_column
from swapledger.plans.registry import query


@query("SCA-01", "safe_division", "select team_id, season, round(wins * 1.0 / nullif(losses, 0), 6) as ratio from v_standing")
def safe_division(t):
    return t.standing.select("team_id", "season", F.round(F.try_divide(F.col("wins").cast("double"), F.col("losses")), 6).alias("ratio"))


@query("SCA-02", "coalesce_and_maths", """
select player_id, season, team_id, role, coalesce(salary, volume * 100.0, 0.0)::double as pay, greatest(cast(value_amt as double), 0.0) as positive, abs(cast(value_amt as double)) as size,
  round(sqrt(games), 6) as root, cast(floor(season / 10) * 10 as int) as decade from v_psr""")
def coalesce_and_maths(t):
    v = F.col("value_amt").cast("double")
    return t.psr.select(
        "player_id", "season", "team_id", "role", F.coalesce("salary", F.col("volume").cast("double") * 100.0, F.lit(0.0)).alias("pay"),
        F.greatest(v, F.lit(0.0)).alias("positive"), F.abs(v).alias("size"), F.round(F.sqrt("games"), 6).alias("root"),
        (F.floor(F.col("season") / 10) * 10).cast("int").alias("decade"))


@query("SCA-03", "case_lookup", """
select player_id, season, grp, level_id, cast(case level_id when 11 then 1.0 when 12 then 0.85 when 13 then 0.7 when 14 then 0.55 else 0.4 end as double) as mult,
  cast(case level_id when 11 then 25 when 12 then 23 when 13 then 21 when 14 then 20 else 22 end as int) as usual_age from v_level""")
def case_lookup(t):
    from swapledger.operators.acquired import LEVEL_AGE, LEVEL_AGE_OTHER, LEVEL_MULTIPLIER, LEVEL_MULTIPLIER_OTHER

    key = F.col("level_id").cast("int")
    return t.level.select("player_id", "season", "grp", "level_id", S.lookup(LEVEL_MULTIPLIER, key, LEVEL_MULTIPLIER_OTHER).alias("mult"),
                          S.lookup(LEVEL_AGE, key, LEVEL_AGE_OTHER).alias("usual_age"))


@query("SCA-04", "name_key", "select doc_id, regexp_replace(lower(trim(text)), '[^a-z0-9 ]', '', 'g') as key from documents")
def name_key_q(t):
    return t.base("documents").select("doc_id", S.name_key(F.col("text")).alias("key"))


@query("SCA-05", "canonical_name", r"""
select conv_id, turn, lower(trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g'), '.', ''), '-', ' '), '\s+(jr|sr|ii|iii|iv)\.?$', '', 'i'), '\s+', ' ', 'g'))) as name
from conversations""")
def canonical_name_q(t):
    return t.base("conversations").select("conv_id", "turn", S.canonical_name(F.col("text")).alias("name"))


@query("SCA-06", "birth_date_and_age", """
select p_partkey as player_id, coalesce(case when p_size > 30 then make_date(1960 + p_size % 20, 1 + p_size % 12, 1 + p_size % 28) end,
  make_date(coalesce(case when p_size > 10 then 1950 + p_size end, 1900), coalesce(case when p_size % 2 = 0 then 1 + p_size % 12 end, 7), 1)) as birth_date,
  cast(2000 - year(coalesce(case when p_size > 30 then make_date(1960 + p_size % 20, 1 + p_size % 12, 1 + p_size % 28) end,
  make_date(coalesce(case when p_size > 10 then 1950 + p_size end, 1900), coalesce(case when p_size % 2 = 0 then 1 + p_size % 12 end, 7), 1))) as int) as age from part""")
def birth_date_and_age(t):
    size = F.col("p_size")
    known = F.when(size > 30, F.make_date(F.lit(1960) + size % 20, F.lit(1) + size % 12, F.lit(1) + size % 28))
    b = S.birth_date(known, F.when(size > 10, F.lit(1950) + size), F.when(size % 2 == 0, F.lit(1) + size % 12), F.lit(None).cast("int"))
    return t.base("part").select(F.col("p_partkey").alias("player_id"), b.alias("birth_date")).withColumn("age", F.lit(2000) - F.year("birth_date"))


@query("SCA-07", "completed_years", """
select o_orderkey, cast(date_diff('year', make_date(1960 + cast(o_custkey % 30 as int), 1 + cast(o_custkey % 12 as int), 15), cast(o_orderdate as date))
  - case when (month(o_orderdate), day(o_orderdate)) < (1 + o_custkey % 12, 15) then 1 else 0 end as int) as age from orders""")
def completed_years(t):
    birth = F.make_date((F.lit(1960) + F.col("o_custkey") % 30).cast("int"), (F.lit(1) + F.col("o_custkey") % 12).cast("int"), F.lit(15))
    return t.base("orders").select("o_orderkey", S.completed_years(birth, F.col("o_orderdate").cast("date")).alias("age"))


@query("SCA-08", "concatenated_id", "select team_id, season, cast(team_id as varchar) || '_' || coalesce(gm, 'UNKNOWN') as id from v_regime")
def concatenated_id(t):
    return t.regime.select("team_id", "season", F.concat_ws("_", F.col("team_id").cast("string"), F.coalesce("gm", F.lit("UNKNOWN"))).alias("id"))


@query("SCA-09", "list_min_max", "select event_id, min(player_id) as low_player, max(player_id) as high_player, min(from_team) as low_team, max(from_team) as high_team from v_trade group by 1")
def list_min_max(t):
    return event_rollup(t.trade).select(
        "event_id", "low_player", "high_player",
        F.array_min("givers").alias("low_team"), F.array_max("givers").alias("high_team"))


@query("SCA-10", "code_alias", """
select event_id, leg_index, case from_team when 24 then 23 when 22 then 21 when 20 then 19 else from_team end as from_code, case to_team when 24 then 23 when 22 then 21 when 20 then 19 else to_team end as to_code from v_leg""")
def code_alias(t):
    m = {24: 23, 22: 21, 20: 19}
    return t.numbered_leg.select("event_id", "leg_index", S.alias_code(m, F.col("from_team")).alias("from_code"), S.alias_code(m, F.col("to_team")).alias("to_code"))


@query("SCA-11", "json_column", """
select event_id, cast(json_extract(props, '$.k') as int) as k, json_extract(props, '$.missing') is null as missing, '{"k":' || json_extract_string(props, '$.k') || '}' as text from events""")
def json_column(t):
    v = F.parse_json("props")
    return t.base("events").select(
        "event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.try_variant_get(v, "$.missing", "int").isNull().alias("missing"), F.to_json(v).alias("text"))


_VERDICTS = ["buy-now", "sell-now", "hold-and-assess"]


@query("SCA-12", "lenient_report", """
select o_orderkey, case when o_orderkey % 5 = 0 then '—' when o_orderkey % 7 = 0 then '—' else 'team-' || cast(o_custkey as varchar) end as team,
  case when o_orderkey % 5 = 0 then 'hold-and-assess' when o_orderstatus = 'F' then 'sell-now' when o_orderstatus = 'O' then 'buy-now' else 'hold-and-assess' end as verdict,
  case when o_orderkey % 5 = 0 then 50.0::double else cast(least(100, o_custkey % 150) as double) end as confidence,
  case when o_orderkey % 5 = 0 then '' else o_orderpriority || ',Recommendation' end as actions, case when o_orderkey % 5 = 0 then 0 else 2 end as n from orders""")
def lenient_report(t):
    """Reports built from the orders: some are not JSON, some lack fields or hold bad ones."""
    verdict = F.when(F.col("o_orderstatus") == "F", "sell-now").when(F.col("o_orderstatus") == "O", "buy-now").otherwise("panic")
    body = F.concat(
        F.lit("{"), F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit('"team": "team-'), F.col("o_custkey").cast("string"), F.lit('", '))).otherwise(""),
        F.lit('"verdict": "'), verdict, F.lit('", "confidence": '), (F.col("o_custkey") % 150).cast("string"),
        F.lit(', "recommendations": [{"rank": 2}, {"rank": 1, "action": "'), F.col("o_orderpriority"), F.lit('"}]}'),
    )
    text = F.when(F.col("o_orderkey") % 5 == 0, "no report today").otherwise(body)
    return t.base("orders").select("o_orderkey", parse_report(text, _VERDICTS, "hold-and-assess").alias("r")).select(
        "o_orderkey", "r.team", "r.verdict", "r.confidence",
        F.array_join(F.transform("r.recommendations", lambda x: x["action"]), ",").alias("actions"), F.size("r.recommendations").alias("n"))


@query("SCA-13", "signed_log", """
select event_id, team_id, round(sign(x) * ln(1 + abs(x) / 1e6), 6) as logged, round(sign(y) * (exp(abs(y)) - 1) * 1e6 / 1e6, 6) as back from (
  select event_id, team_id, surplus * 997000.0 as x, greatest(-20.0, least(20.0, sign(surplus) * ln(1 + abs(surplus * 997000.0) / 1e6))) as y from v_ledger)""")
def signed_log(t):
    x = F.col("surplus") * 997000.0
    return t.ledger.select("event_id", "team_id", F.round(S.signed_log(x), 6).alias("logged"), F.round(S.signed_log_inverse(S.signed_log(x)) / 1e6, 6).alias("back"))


@query("SCA-14", "winsorise", """
with m as (select avg(value) as m, stddev_samp(value) as s from v_psv) select player_id, season, round(least(m + s * 2, greatest(m - s * 2, value)), 6) as clipped from v_psv, m""")
def winsorise(t):
    stats = t.psv.agg(F.struct(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))).scalar()
    return t.psv.withColumn("x", stats).select("player_id", "season", F.round(S.winsorise(F.col("value"), F.col("x.m"), F.col("x.s"), 2.0), 6).alias("clipped"))


@query("SCA-15", "z_score", """
with m as (select season as y, avg(value) as m, stddev_samp(value) as s from v_psv group by 1) select player_id, season, round((value - m) / case when s = 0 then 1 else s end, 6) as z from v_psv join m on y = season""")
def z_score(t):
    """Statistics per season joined back as a small side, not a window over a whole season."""
    m = t.psv.groupBy("season").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return t.psv.join(m, "season").select("player_id", "season", F.round(S.z_score(F.col("value"), F.col("m"), F.col("s")), 6).alias("z"))


_ERF = "(1 - ((((1.061405429 * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k * exp(-u * u))"


def cdf_sql(z: str) -> str:
    """The polynomial normal CDF of an expression, as SQL."""
    return (
        f"(select 0.5 * (1 + case when q.z < 0 then -1 else 1 end * {_ERF}) from (select z, u, 1.0::double / (1 + 0.3275911 * u) as k "
        f"from (select z, abs(z) / sqrt(2.0) as u from (select cast({z} as double) as z))) q)"
    )


@query("SCA-16", "normal_cdf", f"select event_id, team_id, round({cdf_sql('surplus / 2.0')}, 6) as p_positive, round(1 - {cdf_sql('surplus / 2.0')}, 6) as p_loss from v_ledger")
def normal_cdf_q(t):
    p = S.normal_cdf(F.col("surplus") / 2.0)
    return t.ledger.select("event_id", "team_id", F.round(p, 6).alias("p_positive"), F.round(1 - p, 6).alias("p_loss"))


@query("SCA-17", "leverage_index", """
with x as (select event_id, cast(event_id % 12 + 1 as int) as inning, cast(event_id % 2 as int) as half, cast(event_id % 3 as int) as outs, cast(user_id % 8 as int) as bases, cast(event_id % 5 - 2 as int) as diff from events),
  y as (select *, least(inning, 9) as i, coalesce(case when (least(inning, 9), half, outs, bases) = (9, 1, 0, 0) then 2.0 when (least(inning, 9), half, outs, bases) = (9, 1, 0, 3) then 3.5 when (least(inning, 9), half, outs, bases) = (9, 1, 1, 1) then 2.5
   when (least(inning, 9), half, outs, bases) = (9, 1, 2, 3) then 3.8 when (inning, half, outs, bases) = (8, 1, 2, 1) then 2.1 when (inning, half, outs, bases) = (7, 1, 0, 0) then 1.2 when (inning, half, outs, bases) = (7, 1, 1, 3) then 1.8
   when (inning, half, outs, bases) = (1, 0, 0, 0) then 0.5 when (inning, half, outs, bases) = (2, 0, 0, 0) then 0.55 when (inning, half, outs, bases) = (3, 0, 1, 0) then 0.65 end,
   0.4 + (least(inning, 9) - 1) * 0.15 + bit_count(bases) * 0.2) as base from x)
select event_id, cast(round(base * greatest(0.05, 1 - abs(diff) * 0.18), 6) as double) as li from y""")
def leverage_index_q(t):
    c = lambda e: e.cast("int")
    li = P.leverage_index(c(F.col("event_id") % 12 + 1), c(F.col("event_id") % 2), c(F.col("event_id") % 3), c(F.col("user_id") % 8), c(F.col("event_id") % 5 - 2))
    return t.base("events").select("event_id", li.alias("li"))


@query("SCA-18", "play_class", f"""
with code as (select * from (values {_CODE_ROWS}) v(i, code, klass, pa, outs)) select event_id, code, klass, pa = 1 as is_pa, outs from events join code on i = event_id % {len(CODES)}""")
def play_class_q(t):
    k, pa, outs = P.play_class(code_column())
    return t.base("events").select("event_id", code_column().alias("code"), k.alias("klass"), pa.alias("is_pa"), outs.alias("outs"))


_ADOPT = {3: 1996, 5: 1997, 8: 1995, 12: 1999}


@query("SCA-19", "technology_lead", """
with a as (select *, case team_id when 3 then 1996 when 5 then 1997 when 8 then 1995 when 12 then 1999 else 2003 end as y from v_standing)
select team_id, season, cast(case when season < y then 0 else least(7, greatest(0, 2003 - y)) end as double) as lead from a""")
def technology_lead_q(t):
    return t.standing.select("team_id", "season", N.technology_lead(F.col("team_id"), F.col("season"), _ADOPT, 2003).alias("lead"))


@query("SCA-20", "lineage_scores", """
with st as (select max(c_name) as person, c_nationkey as club, 1990 + c_nationkey as first, 1994 + c_nationkey as last, case when c_nationkey % 3 = 0 then 'gm' else 'dir' end as level from customer group by c_nationkey, c_mktsegment),
  w as (select n_nationkey as club, 1992 + n_nationkey as w_first, 1996 + n_nationkey as w_last from nation where n_nationkey % 4 <> 1),
  v as (select distinct person, level from st join w on w.club = st.club where first <= w_last and last >= w_first),
  s as (select o.team_id, o.season, case when v.level = 'gm' then 1.0 when v.level = 'dir' and o.role in ('4-NOT SPECIFIED', '5-LOW') then 1.0 when v.level = 'dir' and o.role in ('1-URGENT', '2-HIGH') then 0.5 else 0.0 end as x
    from v_office o left join v on v.person = o.person)
select team_id, season, cast(max(x) as double) as lineage from s group by 1, 2""")
def lineage_scores_q(t):
    stints = t.base("customer").groupBy(F.col("c_nationkey").alias("club"), "c_mktsegment").agg(F.max("c_name").alias("person")).select(
        "person", "club", (F.lit(1990) + F.col("club")).alias("first"), (F.lit(1994) + F.col("club")).alias("last"),
        F.when(F.col("club") % 3 == 0, "gm").otherwise("dir").alias("level"))
    windows = t.base("nation").where("n_nationkey % 4 <> 1").select(
        F.col("n_nationkey").alias("club"), (F.lit(1992) + F.col("n_nationkey")).alias("w_first"), (F.lit(1996) + F.col("n_nationkey")).alias("w_last"))
    return N.lineage_scores(t.office, stints, windows, ["1-URGENT", "2-HIGH"], ["4-NOT SPECIFIED", "5-LOW"])


@query("SCA-21", "logistic_chance", """
with s as (select s.*, t.division_id from v_standing s join v_team t on t.team_id = s.team_id),
  l as (select division_id, season, wins as lw, losses as ll from (select *, row_number() over (partition by division_id, season order by wins - losses desc, team_id) as r from s) where r = 1),
  g as (select s.team_id, s.season, wins, losses, greatest(0.0, round(cast(((lw - wins) + (losses - ll)) / 2.0 as double), 1)) as gb from s join l on l.division_id = s.division_id and l.season = s.season)
select team_id, season, round(case when wins + losses = 0 then 0.4 else greatest(0.02, least(0.97, 1 / (1 + exp(-((wins / (wins + losses) - 0.5) * 12 - gb * 0.12 - 0.25))))) end, 6) as chance from g""")
def logistic_chance(t):
    s = division_race(t.standing.join(t.team.select("team_id", "division_id"), "team_id"))
    return s.select("team_id", "season", F.round(playoff_chance(F.col("wins"), F.col("losses"), F.col("games_back")), 6).alias("chance"))
