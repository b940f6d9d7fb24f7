"""Sources, parsers and sinks (SRC).

Raw inputs (JSON, positional text, HTML, CSV files) are derived from the given
tables; each oracle computes the expected rows from the columns the text was
built from, without parsing.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from swapledger.functions import scalars as S
from swapledger.operators import assemblies as B
from swapledger.operators.facts import season_totals
from swapledger.operators.outcomes import salary_between
from swapledger.plans.q_summaries import prices
from swapledger.plans.registry import query
from swapledger.session import scratch_dir
from swapledger.sources import constants as K
from swapledger.sources import markup as M
from swapledger.sources import records as R
from swapledger.sources import writers as W
from swapledger.sources.keyed import KeyedTable
from swapledger.sources.tables import SCALE

lit = F.lit


def text(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


@query("SRC-01", "flatten_movements", """
select o_orderkey as transaction_id, case o_orderkey % 4 when 0 then cast(o_orderdate as date) when 1 then cast(o_orderdate as date) end as date, cast(null as date) as effective_date,
  coalesce(case when o_orderkey % 5 > 0 then o_orderstatus end, '') as type_code, case when o_orderkey % 3 > 0 then o_custkey end as from_team_id, case when o_orderkey % 3 > 0 then o_orderpriority end as from_team_name,
  case when o_orderkey % 7 > 0 then o_custkey + 1 end as player_id, cast(year(o_orderdate) as int) as season, 'api' as source from orders""")
def flatten_movements(t):
    """Nested JSON with absent objects and odd dates, one text per order."""
    k, iso = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    date = F.when(k % 4 == 0, iso).when(k % 4 == 1, F.concat(iso, lit("T00:00:00Z"))).when(k % 4 == 2, "soon")
    raw = F.to_json(F.struct(
        k.alias("id"), date.alias("date"), F.when(k % 5 > 0, F.col("o_orderstatus")).alias("typeCode"),
        F.when(k % 3 > 0, F.struct(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"))).alias("fromTeam"),
        F.when(k % 7 > 0, F.struct((F.col("o_custkey") + 1).alias("id"), lit("x").alias("fullName"))).alias("person"),
    ))
    j = t.base("orders").select(F.from_json(raw, R.MOVEMENT_SCHEMA).alias("r"), F.year("o_orderdate").alias("_season")).select("r.*", "_season")
    return R.flatten_movements(j, F.col("_season")).select(
        "transaction_id", "date", "effective_date", "type_code", "from_team_id", "from_team_name", "player_id", "season", "source")


@query("SRC-01", "flatten_staff", """
select c_nationkey as team_id, 2001 as season, case when c_custkey % 3 = 0 then 'MNGR' when c_custkey % 3 = 1 then 'COAT' else '?' end as job_code, c_mktsegment as job_title,
  case when c_custkey % 4 > 0 then c_custkey end as person_id, case when c_custkey % 4 > 0 then c_name end as person_name from customer""")
def flatten_staff(t):
    k = F.col("c_custkey")
    raw = F.to_json(F.struct(
        F.when(k % 3 == 0, "MNGR").when(k % 3 == 1, "").alias("jobCode"), F.when(k % 3 == 1, "COAT").alias("jobId"), F.col("c_mktsegment").alias("job"),
        F.when(k % 4 > 0, F.struct(k.alias("id"), F.col("c_name").alias("fullName"))).alias("person")))
    j = t.base("customer").select("c_nationkey", F.from_json(raw, R.STAFF_SCHEMA).alias("r")).select("c_nationkey", "r.*")
    return R.flatten_staff(j, F.col("c_nationkey"), lit(2001)).drop("source")


@query("SRC-02", "leg_counter", "select event_id, leg_index, player_id from v_leg")
def leg_counter(t):
    return t.numbered_leg.select("event_id", "leg_index", "player_id")


@query("SRC-03", "tolerant_dates", """
select o_orderkey, case o_orderkey % 6 when 0 then cast(o_orderdate as date) when 1 then cast(o_orderdate as date) when 2 then cast(o_orderdate as date) when 3 then make_date(year(o_orderdate), 1, 1) end as parsed from orders""")
def tolerant_dates(t):
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    raw = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.date_format(d, "yyyyMMdd"))
        .when(k == 3, F.concat(F.year(d).cast("string"), lit("0000"))).when(k == 4, "2018-13-45").otherwise("")
    )
    r = t.base("orders").select("o_orderkey", raw.alias("raw"))
    return r.select("o_orderkey", F.coalesce(S.tolerant_date(F.col("raw")), S.compact_date(F.col("raw"), True)).alias("parsed"))


@query("SRC-04", "trade_text", """
select o.o_orderkey as rs_transaction_id, cast(o.o_orderdate as date) as date, cast(year(o.o_orderdate) as int) as season, 'plyr' || lpad(cast(l.l_partkey % 10000 as varchar), 4, '0') as rs_player_id,
  'T' || cast(s.s_nationkey as varchar) as from_team_rs, case when l.l_linenumber > 1 then 'T' || cast(c.c_nationkey as varchar) end as to_team_rs
from lineitem l join orders o on o.o_orderkey = l.l_orderkey join customer c on c.c_custkey = o.o_custkey join supplier s on s.s_suppkey = l.l_suppkey where o.o_orderstatus = 'F'""")
def trade_text(t):
    q = lambda c: F.concat(lit('"'), c, lit('"'))
    line = F.concat_ws(
        ",", F.date_format("event_date", "yyyyMMdd"), lit("0"), lit(""), lit(""), lit(""), text("event_id"),
        q(F.concat(lit("plyr"), F.lpad((F.col("player_id") % 10000).cast("string"), 4, "0"))),
        q(F.when(F.col("type_code") == "F", "T").otherwise("R")), q(F.concat(lit("T"), text("from_team"))), lit('"NL"'),
        q(F.when(F.col("leg_order.l_linenumber") > 1, F.concat(lit("T"), text("to_team"))).otherwise("")), lit('"NL"'))
    return R.parse_trade_text(t.leg.select(line.alias("value"))).drop("player_name_raw")


@query("SRC-05", "game_text", """
select cast(o_orderdate as date) as game_date, 'G' || cast(o_orderkey as varchar) as game_number, cast(year(o_orderdate) as int) as season, cast(o_custkey % 12 as bigint) as visitor_score, case when o_orderkey % 9 > 0 then cast(o_orderkey % 11 as bigint) end as home_score,
  case when o_custkey % 3 > 0 then 'PRK' || cast(o_custkey % 5 as varchar) end as park_id, cast(o_custkey % 25 as int) as visitor_team, cast(o_orderkey % 25 as int) as home_team
from orders where o_custkey % 25 < 20 and o_orderkey % 25 < 20""")
def game_text(t):
    """Codes 0..19 are known; other teams' games drop out."""
    q = lambda c: F.concat(lit('"'), c, lit('"'))
    o = t.base("orders")
    line = F.concat_ws(
        ",", q(F.date_format("o_orderdate", "yyyyMMdd")), q(F.concat(lit("G"), text("o_orderkey"))), lit('"Mon"'), q(text(F.col("o_custkey") % 25)), lit('"NL"'), lit("7"),
        q(text(F.col("o_orderkey") % 25)), lit('"NL"'), lit("8"), text(F.col("o_custkey") % 12), F.when(F.col("o_orderkey") % 9 > 0, text(F.col("o_orderkey") % 11)).otherwise(""), lit("54"), lit('"D"'),
        lit(""), lit(""), lit(""), q(F.when(F.col("o_custkey") % 3 > 0, F.concat(lit("PRK"), text(F.col("o_custkey") % 5))).otherwise("")), lit("30000"), lit("180"))
    codes = t.base("nation").where("n_nationkey < 20").select(text("n_nationkey").alias("code"), F.col("n_nationkey").alias("team_id"))
    return R.parse_game_text(o.select(line.alias("value")), codes).select(
        "game_date", "game_number", "season", "visitor_score", "home_score", "park_id", "visitor_team", "home_team")


@query("SRC-06", "payroll_html", """
select l_orderkey, l_linenumber, l_partkey as contract_id, 'Player ' || cast(l_partkey as varchar) as player_name, l_returnflag as position, case when l_linenumber % 2 = 0 then cast(l_linenumber as double) end as service_time, l_linestatus as status,
  cast(floor(l_extendedprice) as bigint) as base_salary, case when l_quantity > 25 then cast(l_quantity as bigint) * 1001000 end as cap_hit, count(*) as n from lineitem group by all""")
def payroll_html(t):
    """One page per line with a header row, one player row and one row without a link."""
    money = F.concat(lit("$"), F.format_number(F.floor("l_extendedprice"), 0))
    cap = F.when(F.col("l_quantity") > 25, F.concat(lit("$"), F.format_number(F.col("l_quantity").cast("long") * 1001000, 0))).otherwise("n/a")
    td = lambda c: F.concat(lit("<td class=x>"), c, lit("</td>"))
    link = F.concat(lit('<span>X</span><a href="https://pay.example.com/player/_/id/'), text("l_partkey"), lit('/some-name">Player '), text("l_partkey"), lit("</a>"))
    row = F.concat(lit("<tr>"), td(link), td(F.concat(lit("<b>"), F.col("l_returnflag"), lit("</b>"))), td(F.when(F.col("l_linenumber") % 2 == 0, F.format_string("%d.000", "l_linenumber")).otherwise("-")),
                   td(lit("Draft")), td(F.col("l_linestatus")), td(money), td(cap), td(lit("--")), td(lit("-")), lit("</tr>"))
    page = F.concat(lit('<html><table id="table_active" class="t">\n<tr><th>Player</th></tr>'), row, lit("<tr><td>Total</td><td>1</td><td>2</td><td>3</td><td>4</td></tr></table></html>"))
    docs = t.base("lineitem").select("l_orderkey", "l_linenumber", page.alias("html"))
    p = M.payroll_rows(docs, "html", "table_active", ["l_orderkey", "l_linenumber"])
    cols = ["l_orderkey", "l_linenumber", "contract_id", "player_name", "position", "service_time", "status", "base_salary", "cap_hit"]
    return p.groupBy(*cols).agg(F.count("*").alias("n"))


@query("SRC-06", "page_links", """
select page_id, i - 1 as row_no, regexp_extract(li[i], '<a[^>]*>([^<]*)</a>', 1) as label from (select page_id, li, unnest(range(1, len(li) + 1)) as i from (
  select page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<li[^>]*>(.*?)</li>', 1) as li from pages))""")
def page_links(t):
    """The same cell extraction over the given pages: list items as rows, links as cells."""
    cells = M.html_cells(t.base("pages"), "html", "<nav>", "</nav>", "li", "a")
    return cells.select("page_id", F.col("row_no").cast("long").alias("row_no"), F.coalesce(F.try_element_at("cells", lit(1)), lit("")).alias("label"))


@query("SRC-07", "office_html", """
with p as (select c_custkey, 'General Manager' as role, c_name as person from customer union all select c_custkey, 'Farm Director', 'Ann ' || c_mktsegment from customer
  union all select c_custkey, 'Farm Director', 'Bo Lee' from customer union all select c_custkey, 'President', 'Zed ' || c_mktsegment from customer where c_custkey % 2 = 0) select * from p""")
def office_html(t):
    """Two roles in one paragraph, a linked name, parentheses, two people per role, unknown roles."""
    page = F.concat(
        lit("<p><strong>General Manager:</strong> <a href='/x'>"), F.col("c_name"), lit("</a> (92-71) &nbsp; <strong>Farm Director:</strong> Ann "), F.col("c_mktsegment"),
        lit(" and Bo Lee, jr</p><p><strong>Bat Boy:</strong> No One</p>"), F.when(F.col("c_custkey") % 2 == 0, F.concat(lit("<p><strong>President:</strong> Zed "), F.col("c_mktsegment"), lit("; a/b</p>"))).otherwise(""))
    return M.office_rows(t.base("customer").select("c_custkey", page.alias("html")), "html", ["c_custkey"])


@query("SRC-08", "embedded_json_and_grades", """
select p_partkey, p_brand as name, p_size as rank, cast(20 + 5 * (p_size % 13) as double) as grade_hit, case when p_partkey % 3 > 0 then cast(20 + 5 * (p_partkey % 13) as double) end as grade_power, cast(null as double) as grade_field from part""")
def embedded_json_and_grades(t):
    page = F.concat(
        lit('<script>var data = [{"name": "'), F.col("p_brand"), lit('", "rank": '), text("p_size"), lit('}];</script><p>Scouting grades: Hit: '), text(F.lit(20) + F.col("p_size") % 13 * 5),
        F.when(F.col("p_partkey") % 3 > 0, F.concat(lit(" | Power: "), text(F.lit(20) + F.col("p_partkey") % 13 * 5))).otherwise(""), lit(" | Overall: 55</p>"))
    d = t.base("part").select("p_partkey", page.alias("html"))
    j = M.embedded_json(F.col("html"), "data", "array<struct<name:string,rank:int>>")
    return d.select("p_partkey", j.alias("j"), *M.labelled_grades(F.col("html"), "Scouting grades", ["Hit", "Power", "Field"])).select(
        "p_partkey", F.col("j")[0]["name"].alias("name"), F.col("j")[0]["rank"].alias("rank"), "grade_hit", "grade_power", "grade_field")


@query("SRC-09", "envelopes", """
select p_partkey, 'id' || cast(p_partkey as varchar) as source_id, case when p_size % 4 = 0 then null else cast(p_size as bigint) end as games, p_retailprice as value, p_brand as team from part where p_partkey % 5 > 0""")
def envelopes(t):
    """Bare, text-in-JSON and REST-wrapped payloads; records without an id drop out."""
    k = F.col("p_partkey")
    rec = F.concat(
        lit('{"data": [{"playerid": '), F.when(k % 5 > 0, F.concat(lit('"id'), text(k), lit('"'))).otherwise("null"), lit(', "G": '), F.when(F.col("p_size") % 4 == 0, '""').otherwise(text("p_size")),
        lit(', "WAR": "'), text("p_retailprice"), lit('", "Team": "'), F.col("p_brand"), lit('"}], "totalCount": 1}'))
    wrapped = F.to_json(F.struct(rec.alias("rawHtml")))
    rest = F.concat(lit('{"success": true, "data": '), wrapped, lit("}"))
    raw = F.when(k % 3 == 0, rec).when(k % 3 == 1, wrapped).otherwise(rest)
    fields = {"playerid": ("source_id", "text"), "G": ("games", "int"), "WAR": ("value", "double"), "Team": ("team", "text")}
    return M.envelope_rows(t.base("part").select("p_partkey", raw.alias("raw")), "raw", ["p_partkey"], fields, "source_id")


@query("SRC-10", "ranking_table", """
with b as (select p_partkey as doc, 2018 + p_partkey % 6 as y, p_brand as br, 20 + 5 * (p_size % 10) as fv from part)
select doc, 'sa' || cast(doc as varchar) as source_id, 1 as rank, 'José Núñez Jr.' as player_name, 'jose nunez' as name_key, br as org, 'SS' as position, 'AA' as level, cast(fv as int) as grade, 'High' as risk, cast(2025 as int) as eta from b
union all select doc, 'sb' || cast(doc as varchar), 2, 'Al Bo', 'al bo', br, 'RP', 'A+', cast(45 as int), null, cast(null as int) from b""")
def ranking_table(t):
    """A table printed twice with one repeated player and a separator line."""
    k, y = F.col("p_partkey"), F.lit(2018) + F.col("p_partkey") % 6
    new = y >= 2021

    def row(rank, name, pre, pos, lvl, fv, risk, eta):
        url = F.concat(lit("["), lit(name), lit("](https://board.example.com/players/some-name/"), lit(pre), text(k), lit("/stats)"))
        tail = F.when(new, F.concat_ws(" | ", lit(eta), fv, lit(risk))).otherwise(F.concat_ws(" | ", lit("up"), fv, lit(eta), lit(risk)))
        return F.concat_ws(" | ", F.concat(lit("| "), lit(str(rank))), lit("x"), url, F.col("p_brand"), lit(pos), lit(lvl), tail, lit("end |"))

    fv = text(F.lit(20) + F.col("p_size") % 10 * 5)
    a, b = row(1, "José Núñez Jr.", "sa", "SS", "AA", fv, "High", "2025"), row(2, "Al Bo", "sb", "RP", "A+", lit("45"), "", "")
    again = row(3, "Al Bo", "sb", "RP", "A", lit("40"), "Low", "2026")
    doc = F.concat_ws("\n", lit("# Board"), lit("| rank | x | name | org | pos | lvl | a | b | c | d |"), lit("| --- | --- |"), a, b, again, a, row(4, "Late One", "sc", "C", "AA", lit("50"), "Low", "2026"))
    docs = t.base("part").select(k.alias("doc"), y.alias("year"), doc.alias("text"))
    return M.ranking_rows(docs, "text", ["doc"], "year")


@query("SRC-11", "sharded_csv", """
select cast(c_custkey as varchar) as master_id, c_name as name, nullif(case when c_custkey % 3 = 0 then '' else c_mktsegment end, '') as seg from customer where c_custkey % 4 > 0""")
def sharded_csv(t):
    """Register shards written as CSV, read back by glob, rows without a master id dropped."""
    root = scratch_dir(t.spark, "register")
    c = t.base("customer").select(
        F.when(F.col("c_custkey") % 4 > 0, text("c_custkey")).otherwise(" ").alias("master_id"), F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("seg"), (F.col("c_custkey") % 2).alias("shard"))
    for shard in (0, 1):
        c.where(F.col("shard") == shard).drop("shard").write.mode("overwrite").option("header", True).csv(f"{root}/people-{shard}")
    read = lambda s: t.spark.read.option("header", True).schema("master_id string, name string, seg string").csv(f"{root}/people-{s}")
    return R.union_shards([read(0), read(1)], "master_id")


@query("SRC-12", "yearly_csv", "select o_orderkey as id, o_orderstatus as name, o_totalprice as price, cast(year(o_orderdate) as int) as year from orders")
def yearly_csv(t):
    """Header CSV per year with a typed schema; the year comes from the path."""
    root = scratch_dir(t.spark, "yearly")
    o = t.base("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"), F.col("o_totalprice").alias("price"), F.year("o_orderdate").alias("year"))
    o.write.mode("overwrite").partitionBy("year").option("header", True).csv(root)
    return t.spark.read.option("header", True).schema("id long, name string, price double, year int").csv(root)


@query("SRC-13", "project_to_target", """
select cast(l_partkey as bigint) as player_id, case when l_returnflag = 'A' then true when l_returnflag = 'N' then false end as is_active, case when l_linenumber <> 3 then l_quantity end as games, count(*) as n
from lineitem where l_suppkey % 10 > 0 group by 1, 2, 3""")
def project_to_target(t):
    target = T.StructType([T.StructField("player_id", T.LongType()), T.StructField("is_active", T.BooleanType()), T.StructField("games", T.DoubleType()), T.StructField("absent", T.StringType())])
    raw = t.base("lineitem").select(
        F.when(F.col("l_suppkey") % 10 > 0, F.concat(text("l_partkey"), lit(".0"))).alias("mlbID"), F.when(F.col("l_returnflag") == "A", "Y").when(F.col("l_returnflag") == "N", "n").otherwise("?").alias("active"),
        F.when(F.col("l_linenumber") != 3, text("l_quantity")).otherwise("-.--").alias("G"), F.col("l_tax").alias("ignored"))
    p = R.project_to(raw, target, {"mlbID": "player_id", "active": "is_active", "G": "games"}, ["player_id"])
    return p.groupBy("player_id", "is_active", "games").agg(F.count("*").alias("n"))


@query("SRC-14", "lenient_numbers", """
select p_partkey, case p_partkey % 6 when 0 then 0.25 when 1 then p_size + 0.5 when 2 then cast(p_size as double) end as as_double, case p_partkey % 6 when 0 then 0 when 1 then p_size when 2 then p_size end::bigint as as_int,
  case p_partkey % 6 when 0 then 0 when 1 then case when p_size % 2 = 0 then p_size else p_size + 1 end when 2 then p_size end::bigint as half_even from part""")
def lenient_numbers(t):
    k = F.col("p_partkey") % 6
    raw = F.when(k == 0, ".250").when(k == 1, F.concat(text("p_size"), lit(".5"))).when(k == 2, F.concat(lit(" "), text("p_size"))).when(k == 3, "-.--").when(k == 4, "").otherwise("NaN")
    c = F.col("raw")
    return t.base("part").select("p_partkey", raw.alias("raw")).select(
        "p_partkey", S.lenient_double(c).alias("as_double"), S.lenient_int(c).alias("as_int"), S.lenient_int_half_even(c).alias("half_even"))


@query("SRC-15", "money_and_service", """
select o_orderkey, case o_orderkey % 3 when 0 then cast(floor(o_totalprice) as bigint) when 1 then cast(floor(o_totalprice) as bigint) end as amount, case when o_orderkey % 2 = 0 then o_custkey / 1000.0::double end as service from orders""")
def money_and_service(t):
    k = F.col("o_orderkey")
    m = F.when(k % 3 == 0, F.concat(lit("$"), F.format_number("o_totalprice", 2))).when(k % 3 == 1, F.format_number(F.floor("o_totalprice"), 0)).otherwise("n/a")
    s = F.when(k % 2 == 0, text(F.col("o_custkey") / 1000.0)).otherwise("-")
    return t.base("orders").select("o_orderkey", S.money(m).alias("amount"), S.lenient_double(s).alias("service"))


@query("SRC-16", "height_text", "select p_partkey, case when p_partkey % 4 > 0 then cast((5 + p_size % 3) * 12 + p_partkey % 12 as int) end as inches from part")
def height_text(t):
    h = F.when(F.col("p_partkey") % 4 > 0, F.concat(text(F.lit(5) + F.col("p_size") % 3), lit("' "), text(F.col("p_partkey") % 12), lit('"'))).otherwise("tall")
    return t.base("part").select("p_partkey", S.height_inches(h).alias("inches"))


@query("SRC-17", "insert_if_absent", """
select player_id, season, arg_min(value, season) as value, 'old' as source from v_psv where season < 1999 group by 1, 2
union all select player_id, season, value + 1, 'new' from v_psv where not (season < 1999) and season <= 2001""")
def insert_if_absent(t):
    """Two overlapping loads into a parquet table; keys already there stay untouched."""
    path = scratch_dir(t.spark, "insert")
    a = t.psv.where("season < 1999").withColumn("source", lit("old"))
    b = t.psv.where("season <= 2001").select("player_id", "season", (F.col("value") + 1).alias("value"), lit("new").alias("source"))
    W.append_new(t.spark, path, a.unionByName(a), ["player_id", "season"], ["value"])
    W.append_new(t.spark, path, b, ["player_id", "season"], ["value"])
    return t.spark.read.parquet(path)


@query("SRC-17", "bucketed_insert", """
select player_id, season, arg_min(value, season) as value, 'old' as source from v_psv where season < 1999 group by 1, 2
union all select player_id, season, value + 1, 'new' from v_psv where not (season < 1999) and season <= 2001""")
def bucketed_insert(t):
    """The same two loads into a table in hash buckets, whose stored rows are not written again."""
    table = KeyedTable(t.spark, scratch_dir(t.spark, "keyed"), ["player_id", "season"], buckets=16)
    a = t.psv.where("season < 1999").withColumn("source", lit("old"))
    b = t.psv.where("season <= 2001").select("player_id", "season", (F.col("value") + 1).alias("value"), lit("new").alias("source"))
    table.insert(a.unionByName(a), ["value"])
    table.insert(b, ["value"])
    return table.read()


@query("SRC-18", "bucketed_replace", """
select player_id, season, value, 'old' as source from v_psv where player_id % 40 <> 0 or season < 1998 or season > 2000
union all select player_id, season, value + 1, 'new' from v_psv where player_id % 40 = 0 and season between 1998 and 2000""")
def bucketed_replace(t):
    """Replace-on-key of some players' rows: only the buckets they fall into are written."""
    table = KeyedTable(t.spark, scratch_dir(t.spark, "keyed"), ["player_id", "season"], buckets=16)
    table.upsert(t.psv.withColumn("source", lit("old")), ["value"])
    table.upsert(t.psv.where("player_id % 40 = 0 and season between 1998 and 2000").select(
        "player_id", "season", (F.col("value") + 1).alias("value"), lit("new").alias("source")), ["value"])
    return table.read()


@query("SRC-18", "replace_on_key", """
select player_id, season, value, 'old' as source from v_psv where season < 1998 union all select player_id, season, value + 1, 'new' from v_psv where season between 1998 and 2000
union all select player_id, season, value, 'old' from v_psv where season > 2000""")
def replace_on_key_q(t):
    root = scratch_dir(t.spark, "upsert")
    a = t.psv.withColumn("source", lit("old"))
    b = t.psv.where("season between 1998 and 2000").select("player_id", "season", (F.col("value") + 1).alias("value"), lit("new").alias("source"))
    W.upsert_snapshot(t.spark, root, a, ["player_id", "season"], ["value"])
    W.upsert_snapshot(t.spark, root, b, ["player_id", "season"], ["value"])
    return W.current(t.spark, root)[0]


@query("SRC-19", "overwrite_slice", """
select event_id, team_id, surplus, season from v_ledger where season <> 1998 union all select event_id, team_id, surplus * 2, season from v_ledger where season = 1998""")
def overwrite_slice_q(t):
    path = scratch_dir(t.spark, "slices")
    base = t.ledger.select("event_id", "team_id", "surplus", "season")
    W.overwrite_slice(base, path, "season")
    again = t.spark.read.parquet(path).where("season = 1998").select("event_id", "team_id", (F.col("surplus") * 2).alias("surplus"), "season")
    from swapledger.operators.regress import materialise

    W.overwrite_slice(materialise(again, "slice"), path, "season")
    return t.spark.read.parquet(path)


@query("SRC-20", "update_where_null", """
select row_id, coalesce(old_id, new_id) as person_id from (select o_orderkey as row_id, case when o_orderkey % 3 > 0 then o_custkey end as old_id, case when o_custkey % 2 = 0 then o_custkey + 5 end as new_id from orders)""")
def update_where_null(t):
    o = t.base("orders")
    target = o.select(F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("person_id"))
    found = o.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") + 5).alias("person_id"))
    return W.fill_missing(target, found, ["row_id"], "person_id")


@query("SRC-21", "snapshot_append", """
select player_id, season, metric_a + 1 as metric_a from v_metric where season >= 1998 union all select player_id, season, metric_a from v_metric where season < 1998""")
def snapshot_append(t):
    """Two fetches appended by time stamp; the newest row per key."""
    from swapledger.operators.seasons import latest_row

    path = scratch_dir(t.spark, "fetches")
    m = t.metric.select("player_id", "season", "metric_a")
    W.append_fetch(m, path, "2024-01-01")
    W.append_fetch(m.where("season >= 1998").withColumn("metric_a", F.col("metric_a") + 1), path, "2024-02-01")
    rows = t.spark.read.parquet(path)
    return latest_row(rows, ["player_id", "season"], ["fetched_at"], ["metric_a"])


@query("SRC-22", "document_export", """
select t.team_id, t.team_name, coalesce(s.n, 0) as n_seasons, coalesce(o.n, 0) as n_people, s.first_wins from v_team t
left join (select team_id, count(*) as n, cast(arg_min(wins, season) as bigint) as first_wins from v_standing group by 1) s on s.team_id = t.team_id left join (select team_id, count(*) as n from v_office group by 1) o on o.team_id = t.team_id""")
def document_export(t):
    """One nested JSON document per team, written per team and read back."""
    path = scratch_dir(t.spark, "documents")
    docs = W.bundle(t.team.select("team_id", "team_name"), {"seasons": t.standing, "people": t.office}, ["team_id"], {"seasons": ["season"], "people": ["season", "role"]})
    W.write_documents(docs, path, by="team_id")
    schema = "team_name string, seasons array<struct<season:int,wins:long,losses:long>>, people array<struct<season:int,role:string,person:string>>, team_id int"
    d = t.spark.read.schema(schema).json(path)
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), lit(0)).cast("long")
    return d.select("team_id", "team_name", n("seasons").alias("n_seasons"), n("people").alias("n_people"), F.try_element_at("seasons", lit(1))["wins"].alias("first_wins"))


@query("SRC-22", "trade_export", """
with g as (select event_id, cast(leg_index // 4 as bigint) as part, count(*) as n_legs, arg_min(player_id, leg_index) as first_player from v_trade group by 1, 2),
  s as (select event_id, 0::bigint as part, count(*) as n_sides, round(max(surplus), 6) as best_surplus from v_ledger group by 1)
select coalesce(g.event_id, s.event_id) as event_id, coalesce(g.part, s.part) as part, coalesce(n_legs, 0) as n_legs, first_player, coalesce(n_sides, 0) as n_sides, best_surplus
from g full join s on s.event_id = g.event_id and s.part = g.part""")
def trade_export(t):
    """Trades as JSON documents of at most four legs, read back."""
    from swapledger.operators.assemblies import trade_documents

    path = scratch_dir(t.spark, "trade-documents")
    W.write_documents(trade_documents(t.numbered_trade, t.ledger, size=4), path)
    d = t.spark.read.schema("event_id long, part long, legs array<struct<leg_index:long,season:int,player_id:long,from_team:int,to_team:int>>, "
                            "sides array<struct<team_id:int,received:double,given:double,surplus:double>>").json(path)
    n = lambda c: F.coalesce(F.array_size(c), lit(0)).cast("long")
    return d.select("event_id", "part", n("legs").alias("n_legs"), F.try_element_at("legs", lit(1))["player_id"].alias("first_player"), n("sides").alias("n_sides"),
                    F.round(F.array_max(F.transform("sides", lambda s: s["surplus"])), 6).alias("best_surplus"))


@query("SRC-22", "player_export", """
with m as (select player_id, event_id, cast((row_number() over (partition by player_id order by event_id) - 1) // 8 as bigint) as part from (select distinct player_id, event_id from v_trade)),
  g as (select player_id, part, count(*) as n_events, min(event_id) as first_event from m group by 1, 2),
  s as (select player_id, 0::bigint as part, count(*) as n_seasons, round(arg_min(value, season), 6) as first_value from v_psv group by 1)
select coalesce(g.player_id, s.player_id) as player_id, coalesce(g.part, s.part) as part, p_name as player_name, coalesce(n_events, 0) as n_events, first_event, coalesce(n_seasons, 0) as n_seasons, first_value
from g full join s on s.player_id = g.player_id and s.part = g.part left join part on p_partkey = coalesce(g.player_id, s.player_id)""")
def player_export(t):
    """Players as JSON documents of at most eight events, read back."""
    from swapledger.operators.assemblies import player_documents

    path = scratch_dir(t.spark, "player-documents")
    names = t.base("part").select(F.col("p_partkey").alias("player_id"), F.col("p_name").alias("player_name"))
    W.write_documents(player_documents(names, t.psv, t.trade, size=8), path)
    d = t.spark.read.schema("player_id long, part long, player_name string, seasons array<struct<season:int,value:double>>, events array<struct<event_id:long>>").json(path)
    n = lambda c: F.coalesce(F.array_size(c), lit(0)).cast("long")
    return d.select("player_id", "part", "player_name", n("events").alias("n_events"), F.try_element_at("events", lit(1))["event_id"].alias("first_event"),
                    n("seasons").alias("n_seasons"), F.round(F.try_element_at("seasons", lit(1))["value"], 6).alias("first_value"))


@query("SRC-23", "index_export", "select n_regionkey as division_id, count(*) as n, string_agg(cast(n_nationkey as varchar), ',' order by n_nationkey) as ids from nation group by 1")
def index_export(t):
    path = scratch_dir(t.spark, "index")
    idx = t.team.groupBy("division_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("team_id")).alias("ids"))
    W.write_documents(idx, path)
    d = t.spark.read.schema("division_id int, n long, ids array<int>").json(path)
    return d.select("division_id", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("SRC-25", "inventory", "select 'legs' as table_name, count(*) as n_rows from v_leg union all select 'facts', count(*) from v_psr union all select 'metrics', count(*) from v_metric union all select 'standings', count(*) from v_standing")
def inventory_q(t):
    return W.inventory({"legs": t.leg, "facts": t.psr, "metrics": t.metric, "standings": t.standing})


@query("SRC-25", "rows_per_season", "select season, count(*) as n_rows from v_leg group by 1")
def rows_per_season(t):
    return t.leg.groupBy("season").agg(F.count("*").alias("n_rows"))


@query("SRC-26", "constant_tables", """
with c as (select * from (values (1995, 178000000), (1996, 178000000), (1997, 178000000), (1998, 189000000), (1999, 189000000), (2000, 189000000), (2001, 195000000)) v(season, threshold))
select s.team_id, s.season, cast(c.threshold as bigint) as threshold from v_standing s left join c on c.season = s.season""")
def constant_tables(t):
    from swapledger.plans.q_aggregates import thresholds

    return t.standing.join(thresholds(t), "season", "left").select("team_id", "season", "threshold")


@query("SRC-27", "team_master", """
with m as (select * from (values (108, 'LAA'), (146, 'MIA'), (120, 'WSN'), (139, 'TBR')) v(id, code)), a as (select * from (values ('ANA', 108), ('FLA', 146), ('MON', 120), ('TBD', 139), ('LAA', 108), ('MIA', 146)) v(old, id)),
  s as (select s_suppkey, (['ANA', 'FLA', 'MON', 'TBD', 'LAA', 'MIA', 'XXX'])[cast(s_suppkey % 7 + 1 as int)] as old from supplier)
select s.s_suppkey, s.old as old_code, m.code, m.id as master_id from s left join a on a.old = s.old left join m on m.id = a.id""")
def team_master_q(t):
    """Supplier rows carry an old or current club code; the master resolves both."""
    codes = F.array(*[lit(c) for c in ("ANA", "FLA", "MON", "TBD", "LAA", "MIA", "XXX")])
    s = t.base("supplier").select("s_suppkey", F.element_at(codes, (F.col("s_suppkey") % 7 + 1).cast("int")).alias("old_code"))
    ids = K.team_codes(t.spark).select(F.col("code").alias("old_code"), F.col("team_id").alias("master_id"))
    return s.join(ids, "old_code", "left").join(K.team_master(t.spark).select("master_id", "code"), "master_id", "left").select("s_suppkey", "old_code", "code", "master_id")


_AW = "aw as (select player_id, count(*) as n_awards from v_leg where priority = '1-URGENT' group by 1)"


@query("SRC-28", "roster_snapshot", f"""
with {_AW}, l as (select player_id, arg_max(value, season) as last_value, sum(value) filter (where season >= 1999) as value_3yr from v_psv group by 1), c as (select player_id, arg_max(salary, season * 1000 + team_id) as last_salary from (select player_id, season, team_id, max(salary) as salary from v_psr group by 1, 2, 3) where salary is not null group by 1)
select r.team_id, r.player_id, p.p_name as name, p.p_size % 22 + 18 as age, l.last_value, l.value_3yr, c.last_salary, coalesce(aw.n_awards, 0) as n_awards
from (select distinct team_id, player_id from v_psr where season = 2000) r left join part p on p.p_partkey = r.player_id left join l on l.player_id = r.player_id left join c on c.player_id = r.player_id left join aw on aw.player_id = r.player_id""")
def roster_snapshot_q(t):
    bio = t.base("part").select(F.col("p_partkey").alias("player_id"), F.col("p_name").alias("name"), (F.col("p_size") % 22 + 18).alias("age"))
    last = t.psv.groupBy("player_id").agg(F.max_by("value", "season").alias("last_value"), F.sum(F.when(F.col("season") >= 1999, F.col("value"))).alias("value_3yr"))
    pay = t.psr.where(F.col("salary").isNotNull()).groupBy("player_id", "season", "team_id").agg(F.max("salary").alias("salary")).groupBy("player_id").agg(F.max_by("salary", F.struct("season", "team_id")).alias("last_salary"))
    awards = t.leg.where("priority = '1-URGENT'").groupBy("player_id").agg(F.count("*").alias("n_awards"))
    roster = t.psr.where("season = 2000").select("team_id", "player_id").distinct()
    return B.roster_snapshot(roster, [bio, last, pay, awards]).na.fill(0, ["n_awards"])


@query("SRC-28", "roster_per_team", "select team_id, (n - 1) // 100 as part, count(*) as n_players, min(player_id) as first_player from (select *, row_number() over (partition by team_id order by player_id) as n from (select distinct team_id, player_id from v_psr where season = 2000)) group by 1, 2")
def roster_per_team(t):
    roster = t.psr.where("season = 2000").select("team_id", "player_id").distinct()
    return B.per_team(roster, "team_id", "player_id", 100).select("team_id", "part", "n_players", F.col("players")[0]["player_id"].alias("first_player"))


_AFF = """pl as (select p_partkey as player_id, case when p_size % 6 = 0 then p_partkey % 25 when p_size % 6 = 1 then null else 100 + p_partkey % 60 end as cur, case when p_size % 3 = 0 then p_partkey % 30 end as org, 100 + (p_partkey * 7) % 60 as old, p_size % 2 = 0 as is_pitcher, p_retailprice / 97 as q from part),
  live as (select 100 + n_nationkey as team_id, n_nationkey as parent, case n_regionkey when 0 then 'AAA' when 1 then 'AA' else 'A' end as level from nation), leg2 as (select 115 + n_nationkey as team_id, (n_nationkey + 3) % 25 as parent, 'A+' as level from nation),
  j as (select pl.*, coalesce(c.n_nationkey, l.parent, g.parent, o.n_nationkey) as parent, case when c.n_nationkey is not null then 'MLB' when l.parent is not null then l.level when g.parent is not null then g.level else '?' end as level, coalesce(ol.parent, og.parent) as former
    from pl left join nation c on c.n_nationkey = pl.cur left join live l on l.team_id = pl.cur left join leg2 g on g.team_id = pl.cur left join nation o on o.n_nationkey = pl.org left join live ol on ol.team_id = pl.old left join leg2 og on og.team_id = pl.old)"""


@query("SRC-29", "farm_assembly", f"""
with {_AFF} select player_id, parent, level, coalesce(former <> parent, false) as moved, row_number() over (partition by parent, level order by is_pitcher, case when is_pitcher then q else -q end, player_id) as position_in_list from j where parent is not null""")
def farm_assembly(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    players = t.base("part").select(
        k.alias("player_id"), F.when(s % 6 == 0, k % 25).when(s % 6 != 1, k % 60 + 100).alias("current_team_id"), F.when(s % 3 == 0, k % 30).alias("parent_org_id"), (k * 7 % 60 + 100).alias("old_team_id"),
        (s % 2 == 0).alias("is_pitcher"), (F.col("p_retailprice") / 97).alias("ops"), (F.col("p_retailprice") / 97).alias("era"))
    n = t.base("nation")
    clubs = n.select(F.col("n_nationkey").alias("club_id"))
    live = n.select((F.col("n_nationkey") + 100).alias("team_id"), F.col("n_nationkey").alias("parent"), F.when(F.col("n_regionkey") == 0, "AAA").when(F.col("n_regionkey") == 1, "AA").otherwise("A").alias("level"))
    legacy = n.select((F.col("n_nationkey") + 115).alias("team_id"), ((F.col("n_nationkey") + 3) % 25).alias("parent"), lit("A+").alias("level"))
    f = B.farm_list(B.farm_order(B.current_affiliation(players, clubs, live, legacy)))
    return f.select("player_id", "parent", "level", "moved", "position_in_list")
