"""Shared SQL texts for the oracles.

Every text is written in the plain form (one self join per season offset, windows
over whole keys), so that it checks the split or rewritten Spark plan.
"""

from __future__ import annotations

import re


def _offset_joins(base: str, fact: str, cols: str, metric_cols: list[str], ks: list[int]) -> str:
    """One left join per offset: the naive form of the offset window."""
    out, joins = [], []
    for i, k in enumerate(ks):
        suffix = "t" if k == 0 else f"t_{'plus' if k > 0 else 'minus'}_{abs(k)}"
        out += [f"f{i}.{m} as {m}_{suffix}" for m in metric_cols]
        joins.append(
            f"left join {fact} f{i} on f{i}.player_id = b.player_id and f{i}.season = b.season + ({k})"
        )
    return f"select {cols}, {', '.join(out)} from {base} b {' '.join(joins)}"


VIEWS: dict[str, str] = {
    "v_team": "select n_nationkey as team_id, n_name as team_name, n_regionkey as division_id from nation",
    "v_leg": """
select l.l_orderkey as event_id,
  row_number() over (partition by l.l_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate,
    l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus) - 1 as leg_index,
  cast(o.o_orderdate as date) as event_date, cast(year(o.o_orderdate) as int) as season,
  l.l_partkey as player_id, s.s_nationkey as from_team, c.c_nationkey as to_team,
  o.o_orderstatus as type_code, o.o_orderpriority as priority, l.l_suppkey as supp_id, o.o_custkey as cust_id
from lineitem l join orders o on o.o_orderkey = l.l_orderkey
join customer c on c.c_custkey = o.o_custkey join supplier s on s.s_suppkey = l.l_suppkey""",
    "v_trade": "select * from v_leg where type_code = 'F' and player_id is not null and from_team is not null and to_team is not null",
    "v_psr": """
select case when l.l_returnflag = 'R' then 'P' else 'B' end as role, l.l_partkey as player_id,
  cast(year(l.l_shipdate) as int) as season, s.s_nationkey as team_id,
  sum(cast(l.l_extendedprice as decimal(18,2)) * (cast(l.l_discount as decimal(4,2)) - cast(0.05 as decimal(4,2)))) as value_amt,
  sum(cast(l.l_quantity as decimal(18,2))) as volume,
  max(case when l.l_linestatus = 'F' then l.l_extendedprice end) as salary, count(*) as games
from lineitem l join supplier s on s.s_suppkey = l.l_suppkey group by 1,2,3,4""",
    "v_psv": "select player_id, season, cast(sum(value_amt) as double) / 1009 as value from v_psr group by 1,2",
    "v_pstv": "select player_id, season, team_id, cast(sum(value_amt) as double) / 1009 as value from v_psr group by 1,2,3",
    "v_metric": """
select l_partkey as player_id, cast(year(l_shipdate) as int) as season,
  cast(sum(cast(l_discount as decimal(10,4))) as double) / count(*) / 0.97 as metric_a,
  cast(sum(cast(l_tax as decimal(10,4))) as double) / count(*) / 0.97 as metric_b, count(*) as n
from lineitem group by 1,2 having count(*) >= 3""",
    "v_office": """
select c.c_nationkey as team_id, cast(year(o.o_orderdate) as int) as season, o.o_orderpriority as role, max(c.c_name) as person
from orders o join customer c on c.c_custkey = o.o_custkey where o.o_orderstatus <> 'P' group by 1,2,3""",
    "v_regime": """
select team_id, season,
  max(case when role = '1-URGENT' then person end) as president, max(case when role = '2-HIGH' then person end) as gm,
  coalesce(max(case when role = '1-URGENT' then person end), max(case when role = '2-HIGH' then person end),
    max(case when role = '3-MEDIUM' then person end)) as decision_maker,
  cast(team_id as varchar) || '_' || coalesce(max(case when role = '1-URGENT' then person end),
    max(case when role = '2-HIGH' then person end), max(case when role = '3-MEDIUM' then person end), 'UNKNOWN') as regime_id
from v_office group by 1,2""",
    "v_standing": """
select c.c_nationkey as team_id, cast(year(o.o_orderdate) as int) as season,
  sum(case when o.o_orderstatus = 'F' then 1 else 0 end) as wins, sum(case when o.o_orderstatus = 'O' then 1 else 0 end) as losses
from orders o join customer c on c.c_custkey = o.o_custkey group by 1,2""",
    "v_game": """
select o.o_orderkey as game_id, c.c_nationkey as home_team, s.s_nationkey as visitor_team, cast(year(o.o_orderdate) as int) as season,
  l.l_returnflag as park_id, cast(l.l_quantity as int) as home_score, cast(l.l_linenumber as int) as visitor_score
from lineitem l join orders o on o.o_orderkey = l.l_orderkey join customer c on c.c_custkey = o.o_custkey
join supplier s on s.s_suppkey = l.l_suppkey where s.s_nationkey <> c.c_nationkey""",
    "v_level": """
select l_partkey as player_id, cast(year(l_shipdate) as int) as season, 11 + (l_linenumber % 4) as level_id,
  case when l_returnflag = 'R' then 'pitching' else 'hitting' end as grp, sum(cast(l_quantity as decimal(18,2))) as pa,
  case when max(l_tax) > 0.01 then cast(sum(cast(l_tax as decimal(10,4))) as double) / count(*) / 0.0970123457 end as ops
from lineitem group by 1,2,3,4""",
    "v_log": """
select user_id as game_id, event_id, ts, event_type, value,
  row_number() over (partition by user_id order by ts, event_id) as seq from events""",
    "v_window": _offset_joins(
        "v_trade", "v_psv",
        "b.event_id, b.leg_index, b.event_date, b.season, b.player_id, b.from_team, b.to_team",
        ["value"], [-1, 0, 1, 2, 3, 4, 5],
    ),
    "v_window_split": """
select w.*, r.value as value_t_with_receiver from v_window w
left join v_pstv r on r.player_id = w.player_id and r.season = w.season and r.team_id = w.to_team""",
    "v_metric_window": _offset_joins(
        "v_trade", "v_metric", "b.event_id, b.leg_index, b.season, b.player_id, b.from_team, b.to_team",
        ["metric_a", "metric_b"], [-2, -1, 1],
    ),
    "v_affil": """
select event_id from v_trade group by event_id
having min(from_team) between 2 and 22 and max(from_team) between 2 and 22
   and min(to_team) between 2 and 22 and max(to_team) between 2 and 22""",
    "v_key_recv": """
select player_id, season, to_team,
  max(coalesce(value_t_plus_1,0) + coalesce(value_t_plus_2,0) + coalesce(value_t_plus_3,0) + coalesce(value_t_with_receiver,0)) as v
from v_window_split group by 1,2,3""",
    "v_key_given": """
select player_id, season, max(coalesce(value_t_plus_1,0) + coalesce(value_t_plus_2,0) + coalesce(value_t_plus_3,0)) as v
from v_window_split group by 1,2""",
    "v_ledger": """
select event_id, season, team_id, round(sum(received), 3) as received, round(sum(given), 3) as given,
  round(sum(received) - sum(given), 3) as surplus, cast(sum(nr) as bigint) as n_received, cast(sum(ng) as bigint) as n_given
from (
  select t.event_id, t.season, t.to_team as team_id, k.v as received, 0.0 as given, 1 as nr, 0 as ng
  from v_trade t join v_affil a on a.event_id = t.event_id
  join v_key_recv k on k.player_id = t.player_id and k.season = t.season and k.to_team = t.to_team
  union all
  select t.event_id, t.season, t.from_team, 0.0, k.v, 0, 1
  from v_trade t join v_affil a on a.event_id = t.event_id
  join v_key_given k on k.player_id = t.player_id and k.season = t.season
) group by 1,2,3""",
    "v_model": """
select t.event_id, t.to_team, t.season, avg(p.value) as q, avg(cast(t.season - f.first_season as double)) as ex, avg(m.metric_a) as ma,
  avg(n.value) as y, avg(m2.metric_a - m.metric_a) as y2
from v_trade t left join v_psv p on p.player_id = t.player_id and p.season = t.season - 1
left join v_psv n on n.player_id = t.player_id and n.season = t.season + 1
left join v_metric m on m.player_id = t.player_id and m.season = t.season - 1
left join v_metric m2 on m2.player_id = t.player_id and m2.season = t.season + 1
left join (select player_id, min(season) as first_season from v_psv group by 1) f on f.player_id = t.player_id group by 1, 2, 3""",
    "v_fold": """
select cast(r - 3 as int) as fold, s as test_start, s as test_end from (
  select s, row_number() over (order by s) as r from (select distinct season as s from v_model where y is not null)) where r > 3""",
    "v_part": """
select m.*, f.fold, case when m.season < f.test_start then 'train' else 'test' end as part
from v_model m join v_fold f on m.season <= f.test_end where m.y is not null""",
    "v_stats": """
with f as (select fold, coalesce(avg(q), 0) as m_q, coalesce(avg(ma), 0) as m_ma from v_part where part = 'train' group by 1)
select p.fold, count(*) as n_train, avg(y) as m_y, stddev_pop(y) as s_y, max(m_q) as m_q, stddev_samp(coalesce(q, m_q)) as s_q,
  max(m_ma) as m_ma, stddev_samp(coalesce(ma, m_ma)) as s_ma from v_part p join f on f.fold = p.fold where part = 'train' group by 1""",
    "v_z": """
select p.event_id, p.to_team, p.season, p.fold, p.part, p.y, s.m_y, s.s_y, (p.y - s.m_y) / s.s_y as zy,
  greatest(-5.0, least(5.0, (coalesce(p.q, s.m_q) - s.m_q) / s.s_q)) as zq, greatest(-5.0, least(5.0, (coalesce(p.ma, s.m_ma) - s.m_ma) / s.s_ma)) as zma
from v_part p join v_stats s on s.fold = p.fold""",
    "v_ridge": """
with l as (select fold, 'q' as feature, zq as x, zy as y from v_z where part = 'train' union all select fold, 'ma', zma, zy from v_z where part = 'train'),
  a as (select fold, feature, count(*) as n, sum(x) as sx, sum(x * x) as sxx, sum(x * y) as sxy, sum(y) as sy, sum(y * y) as syy from l group by 1, 2),
""" + ",\n".join(
        f"""  d{i} as (select *, (n / s2 + 1) * (sxx / s2 + 1 / 0.09) - (sx / s2) * (sx / s2) as det from {('(select *, 1.0::double as s2 from a)' if i == 0 else f's{i - 1}')}),
  b{i} as (select *, (sxx / s2 + 1 / 0.09) / det as v00, -(sx / s2) / det as v01, (n / s2 + 1) / det as v11 from d{i}),
  c{i} as (select *, (v00 * sy + v01 * sxy) / s2 as b0, (v01 * sy + v11 * sxy) / s2 as b1 from b{i}),
  s{i} as (select fold, feature, n, sx, sxx, sxy, sy, syy, (syy - 2 * (b0 * sy + b1 * sxy) + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx)
    / (n - (v00 * n + 2 * v01 * sx + v11 * sxx) / s2) as s2 from c{i})""" for i in range(3)
    ) + """,
  d3 as (select *, (n / s2 + 1) * (sxx / s2 + 1 / 0.09) - (sx / s2) * (sx / s2) as det from s2),
  b3 as (select *, (sxx / s2 + 1 / 0.09) / det as v00, -(sx / s2) / det as v01, (n / s2 + 1) / det as v11 from d3)
select fold, feature, n, s2, v00, v01, v11, (v00 * sy + v01 * sxy) / s2 as b0, (v01 * sy + v11 * sxy) / s2 as b1 from b3""",
}

# The same texts on the second outcome of the model rows.
VIEWS["v_metric_model"] = "select * replace (y2 as y) from v_model"
for _view in ("fold", "part", "stats", "z", "ridge"):
    VIEWS[f"v_metric_{_view}"] = re.sub(r"\bv_(model|fold|part|stats|z)\b", r"v_metric_\1", VIEWS[f"v_{_view}"])

_NAME = re.compile(r"\bv_[a-z_]+\b")


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the shared texts it refers to, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql.strip()
    ctes = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in ordered)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
