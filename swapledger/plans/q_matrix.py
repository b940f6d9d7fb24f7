"""The feature matrix as a whole (JOI-10), from both halves and the sides that neither has."""

from __future__ import annotations

from pyspark.sql import functions as F

from swapledger.plans.q_joins import _CONTEXT_SQL, _FEATURES_SQL, R
from swapledger.plans.q_summaries import _CODE_ROWS, CODES
from swapledger.plans.registry import query


_MATRIX = ["event_id", "season", "to_team", "avg_experience", "volatility", "cluster_score", "prior_value", "prior_pct", "payroll", "avg_pick", "origin_value",
           "acceleration", "contract_year_share", "origin_team", "origin_payroll", "late_era", "regime_id", "max_grade", "pct_of_cap", "growth_3yr", "park_factor",
           "dev_fit", "recency_bias", "avg_age", "pct_international", "pct_left_bat", "pct_pitchers", "avg_grade", "avg_prior_awards", "pct_awarded", "hit_quality",
           "pitch_quality", "age_advantage", "contention_window", "fit_by_peak_age"]


@query("JOI-10", "whole_matrix", f"""
with fe as ({_FEATURES_SQL}), co as ({_CONTEXT_SQL}),
  bad as (select team_id, season, player_id, max(salary) as salary, sum(value_amt) as v from v_psr where salary is not null group by 1, 2, 3),
  pr as (select team_id, season + 1 as season, cast(sum(cast(salary as decimal(18,2))) as double) / 1e5 / 0.97 as pressure from bad where salary > 60000 and v < 0 group by 1, 2),
  st as (select max(c_name) as person, c_nationkey as club, 1990 + c_nationkey as first, 1994 + c_nationkey as last, case when c_nationkey % 3 = 0 then 'gm' else 'dir' end as level from customer group by c_nationkey, c_mktsegment),
  pw as (select n_nationkey as club, 1992 + n_nationkey as w_first, 1996 + n_nationkey as w_last from nation where n_nationkey % 4 <> 1),
  vs as (select distinct person, level from st join pw on pw.club = st.club where first <= w_last and last >= w_first),
  li as (select o.team_id, o.season, max(case when vs.level = 'gm' then 1.0 when vs.level = 'dir' and o.role in ('4-NOT SPECIFIED', '5-LOW') then 1.0 when vs.level = 'dir' and o.role in ('1-URGENT', '2-HIGH') then 0.5 else 0.0 end) as lineage
    from v_office o left join vs on vs.person = o.person group by 1, 2),
  code as (select * from (values {_CODE_ROWS}) v(i, code, klass, pa, outs)),
  ph as (select user_id % 25 as team_id, 1995 + user_id % 7 as season, case when event_id % 2 = 0 then 'L' else 'R' end as bat, case when event_id % 3 = 0 then 'L' else 'R' end as pit,
    case klass when 14 then 0.69 when 15 then 0.69 when 16 then 0.72 when 20 then 0.89 when 21 then 1.27 when 22 then 1.62 when 23 then 2.10 else 0.0 end as w
    from events join code on code.i = event_id % {len(CODES)} where pa = 1),
  pd as (select team_id, season + 1 as season, round(avg(case when bat = pit then cast(w as double) end), 4) as same_hand, round(avg(case when bat <> pit then cast(w as double) end), 4) as opp_hand from ph group by 1, 2)
select fe.*, co.* exclude (event_id, season, to_team, prior_pct, payroll), round(pr.pressure, 4) as origin_pressure, cast(li.lineage as double) as lineage,
  round(round(pd.opp_hand - pd.same_hand, 4), 4) as platoon_diff,
  cast(case when fe.season < (case fe.to_team when 3 then 1996 when 5 then 1997 when 8 then 1995 when 12 then 1999 else 2003 end) then 0
    else least(7, greatest(0, 2003 - (case fe.to_team when 3 then 1996 when 5 then 1997 when 8 then 1995 when 12 then 1999 else 2003 end))) end as double) as technology_lead
from fe left join co on co.event_id = fe.event_id and co.to_team = fe.to_team and co.season = fe.season
left join pr on pr.team_id = fe.origin_team and pr.season = fe.season left join li on li.team_id = fe.to_team and li.season = fe.season
left join pd on pd.team_id = fe.to_team and pd.season = fe.season and pd.same_hand is not null and pd.opp_hand is not null""")
def whole_matrix_q(t):
    """Both halves and the sides that neither has, from facts written once."""
    from swapledger.plans.features import whole_matrix

    m = whole_matrix(t)
    plain = {"event_id", "season", "to_team", "payroll", "origin_team", "origin_payroll", "late_era", "regime_id", "max_grade", "technology_lead", "lineage",
             "origin_pressure", "platoon_diff"}
    shown = [c for c in _MATRIX if c not in plain]
    return m.select(*[c for c in _MATRIX if c in plain and c != "max_grade"], F.col("max_grade").cast("long").alias("max_grade"), *[R(c).alias(c) for c in shown],
                    F.round("origin_pressure", 4).alias("origin_pressure"), "lineage", F.round("platoon_diff", 4).alias("platoon_diff"), "technology_lead")
