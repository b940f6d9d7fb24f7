"""Normalisers and parsers on literal rows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from swapledger.functions import scalars as S
from swapledger.sources import markup as M
from swapledger.sources import records as R


def test_dates(spark):
    rows = [("2018-07-27",), ("2018-07-27T00:00:00Z",), ("",), (None,), ("garbage",), ("2018-13-01",)]
    got = [r[0] for r in spark.createDataFrame(rows, "d string").select(S.tolerant_date(F.col("d"))).collect()]
    day = dt.date(2018, 7, 27)
    assert got == [day, day, None, None, None, None]
    rows = [("19990315",), ("19990000",), ("1999031",), ("19991345",)]
    got = [r[0] for r in spark.createDataFrame(rows, "d string").select(S.compact_date(F.col("d"), True)).collect()]
    assert got == [dt.date(1999, 3, 15), dt.date(1999, 1, 1), None, None]


def test_movements_absent_objects(spark):
    raw = [
        json.dumps({"id": 7, "date": "2018-07-27", "typeCode": "TR", "fromTeam": {"id": 1, "name": "A"},
                    "toTeam": {"id": 2, "name": "B"}, "person": {"id": 9, "fullName": "Ann Bo"}}),
        json.dumps({"id": 8, "date": "nope"}),
    ]
    df = spark.createDataFrame([(r,) for r in raw], "j string").select(F.from_json("j", R.MOVEMENT_SCHEMA).alias("r")).select("r.*")
    a, b = R.flatten_movements(df, F.lit(2018)).orderBy("transaction_id").collect()
    assert (a.from_team_id, a.to_team_name, a.player_name, a.type_code, a.season) == (1, "B", "Ann Bo", "TR", 2018)
    assert (b.from_team_id, b.player_id, b.date, b.type_code) == (None, None, None, "")


def test_leg_counter_restarts_per_event(spark):
    df = spark.createDataFrame([(5, 0, 0), (5, 1, 0), (5, 2, 0), (6, 3, 0)], "event long, seq int, bucket long")
    got = {(r.event, r.seq): r.leg_index for r in R.number_legs(df, "event", "bucket", ["seq"]).collect()}
    assert got == {(5, 0): 0, (5, 1): 1, (5, 2): 2, (6, 3): 0}


def test_staff_code_fallback(spark):
    rows = ['{"jobCode":"MNGR","person":{"id":1,"fullName":"X"}}', '{"jobId":"COAT"}', '{"job":"Coach"}', '{"jobCode":"","jobId":"BC"}']
    df = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", R.STAFF_SCHEMA).alias("r")).select("r.*")
    got = [r.job_code for r in R.flatten_staff(df, F.lit(1), F.lit(2020)).collect()]
    assert got == ["MNGR", "COAT", "?", "BC"]


def test_office_block(spark):
    html = (
        "<p><strong>Manager:</strong> <a href='/m'>Alex Cora</a> (92-71) &nbsp; <strong>President:</strong> Dave Dom</p>"
        "<p><strong>Farm Director:</strong> Ann Lee and Bo Fox, x</p><p><strong>Mascot:</strong> Wally</p>"
    )
    df = spark.createDataFrame([(1, html)], "id int, html string")
    got = {(r.role, r.person) for r in M.office_rows(df, "html", ["id"]).collect()}
    assert got == {("Manager", "Alex Cora"), ("President", "Dave Dom"), ("Farm Director", "Ann Lee"), ("Farm Director", "Bo Fox")}


def test_names(spark):
    rows = [("José Núñez Jr.",), ("J.D.  Drew",), ("Smith-Lee III",)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string").select(S.canonical_name(F.col("n"))).collect()]
    assert got == ["jose nunez", "jd drew", "smith lee"]


def test_numbers(spark):
    rows = [("$28,216,944",), ("-",), ("n/a",), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "m string").select(S.money(F.col("m"))).collect()]
    assert got == [28216944, None, None, None]
    rows = [(".250",), ("-.--",), ("",), ("6.0",), ("-1.5",)]
    got = [r[0] for r in spark.createDataFrame(rows, "m string").select(S.lenient_double(F.col("m"))).collect()]
    assert got == [0.25, None, None, 6.0, -1.5]


def test_trade_text_is_split_once(spark):
    good = '20180727,0,,,,12,"plyr0001","T","T1","NL","","NL"'
    rows = [good, good.replace("20180727", "20181345"), good.replace(",12,", ",x,"), good.replace('"T",', '"R",'), "20180727,0", None]
    parsed = R.parse_trade_text(spark.createDataFrame([(r,) for r in rows], "value string").repartition(2))
    assert [tuple(r) for r in parsed.collect()] == [(12, dt.date(2018, 7, 27), 2018, "plyr0001", "plyr0001", "T1", None)]
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_quotes_as_by_expression(spark):
    texts = ['"a"', ' "a b" ', '""', '"', '"a', 'a"', '"a"b"', '"a"\n', '"a\nb"', '\n"a"', '" a "', "", None, '"é"', '"a"\r\n', '" "']
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    plain = F.trim(F.regexp_replace(F.trim("t"), '^"(.*)"$', "$1"))
    assert df.where(~S.strip_quotes(F.col("t")).eqNullSafe(plain)).collect() == []


def test_money_as_by_cast(spark):
    texts = ["$1,234", "n/a", "-", "--", "", None, "NaN", "1e3", " $5.9 ", "x1", "-7", "1d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    plain = F.floor(F.btrim(F.translate("t", "$,", ""), F.lit(" \t\n")).try_cast("double")).cast("long")
    assert df.where(~S.money(F.col("t")).eqNullSafe(plain)).collect() == []


def test_rows_and_cells_are_cut_once(spark):
    page = "<table id=x><tr a=1><td>a</td><td b>b</td><track>c</tr><tr>d</table><tr><td>e</td></tr>"
    docs = spark.createDataFrame([(1, page), (2, None)], "k int, html string").repartition(2)
    cells = M.html_cells(docs, "html", "<table", "</table>", "tr", "td").where(F.size("cells") > 0)
    assert [(r.k, r.row_no, r.cells) for r in cells.collect()] == [(1, 0, ["a", "b"])]
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
