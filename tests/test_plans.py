"""Shape of the physical plans."""

from pyspark.sql import functions as F

from swapledger.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_value_window_has_one_join_on_player(spark):
    from swapledger.operators.offsets import history_window

    t = Tables(spark, SF)
    text = plan(history_window(t.trade, t.history, range(-1, 6)))
    # three joins build the legs, one the amounts, one attaches all offsets
    assert text.count("Join ") == 5 and "Python" not in text


def test_ledger_reads_legs_once(spark):
    text = plan(Tables(spark, SF).ledger)
    assert text.count("Join ") == 5 and "Python" not in text


def test_season_filter_reaches_the_scan(spark):
    from swapledger.plans import all_queries

    df = all_queries()["prj_03_season_range"](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text
    assert "o_custkey" not in text


def test_documents_move_no_lists(spark):
    from swapledger.operators.assemblies import trade_documents

    legs = spark.createDataFrame([(1, n, 2000, n, 1, 2) for n in range(3)] + [(2, 0, 2001, 9, 3, 4)],
                                 "event_id long, leg_index long, season int, player_id long, from_team int, to_team int").repartition(3, "event_id")
    ledger = spark.createDataFrame([(1, 2, 1.0, 0.0, 1.0), (3, 5, 2.0, 0.0, 2.0)], "event_id long, team_id int, received double, given double, surplus double").repartition(3, "event_id")
    docs = trade_documents(legs, ledger, size=2)
    got = sorted((r.event_id, r.part, [x.leg_index for x in r.legs or []], [x.team_id for x in r.sides or []]) for r in docs.collect())
    assert got == [(1, 0, [0, 1], [2]), (1, 1, [2], []), (2, 0, [0], []), (3, 0, [], [5])]
    assert "Union" not in plan(docs) and plan(docs).count("Join ") == 1


def test_legs_are_numbered_where_they_lie(spark):
    text = Tables(spark, SF).numbered_leg._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in text and "leg_index" in text


def test_order_of_legs_stays_out_of_the_player_join(spark):
    from swapledger.plans.features import acquired_side

    text = plan(acquired_side(Tables(spark, SF)))
    sums = [x for x in text.splitlines() if "Aggregate" in x and "contract_year_share" in x]
    assert sums and not any("min_by" in x for x in sums) and "min_by" in text


def test_levels_are_dealt_by_number_of_lines(spark):
    t = Tables(spark, SF)
    t.level_rows = 500
    lines = t.base("lineitem").count()
    assert "RepartitionByExpression" in plan(t.level) and f", {-(-lines // 500)}" in plan(t.level)


def small_tables(spark, folder):
    """Lines with repeated numbers, null keys and a repeated supplier, and events inside and outside the ledger."""
    from datetime import datetime

    when = lambda y: datetime(y, 3, 1)
    line = [(e, p, s, n, 3.0 + n, 100.5 * (p or 2), 0.01 * e, 0.02, "RAN"[n % 3], "FO"[e % 2], when(1996 + (e + n) % 4))
            for e in (1, 2, 3, 4) for n, p, s in ((1, 5, 10), (1, 4, 11), (1, 4, 11), (2, 4, 12), (3, 6, 13), (3, None, 10), (4, 5, None))]
    tables = {
        "lineitem": (line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                           "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "orders": ([(1, 7, "F", 1.0, when(1997), "1-URGENT"), (2, 8, "F", 1.0, when(1998), "5-LOW"), (3, 7, "O", 1.0, when(1998), "1-URGENT"),
                    (4, 9, "F", 1.0, when(1997), "2-HIGH")],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "customer": ([(7, "a", 3, 0.0, "x"), (8, "b", 24, 0.0, "x"), (9, "c", 5, 0.0, "y")],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(10, "s", 3, 0.0), (11, "s", 4, 0.0), (12, "s", 9, 0.0), (13, "s", 6, 0.0), (13, "s", 6, 0.0)],
                     "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return Tables(spark, str(folder))


def rows_of(df):
    return sorted(map(repr, (r.asDict(True) for r in df.collect())))


def test_facts_of_the_matrices_are_narrow_and_equal(spark, tmp_path):
    from swapledger.operators.legs import origin_team
    from swapledger.plans.q_summaries import prices

    t = small_tables(spark, tmp_path)
    s = t.for_matrices("metric", "ledger")
    assert "l_extendedprice" not in s.leg.select("leg_order.*").columns and "Join" not in plan(s.leg) and "Join" not in plan(s.game)
    for name in ("psv", "metric", "ledger", "game"):
        got = getattr(s, name)
        assert rows_of(got) == rows_of(getattr(t, name)) and got.columns == getattr(t, name).columns
    same = ["role", "player_id", "season", "team_id", "units", "value_amt", "salary"]
    assert rows_of(s.psr.select(*same)) == rows_of(t.psr.select(*same))
    assert rows_of(origin_team(s.trade)) == rows_of(origin_team(t.trade)) != []
    assert rows_of(s.history.select("player_id", "by_season")) == rows_of(t.history.select("player_id", "by_season"))
    assert rows_of(prices(s)) == rows_of(prices(t))


def test_sides_take_the_legs_of_the_ledger(spark, tmp_path):
    t = small_tables(spark, tmp_path)
    held = {r.event_id for r in t.ledger.collect()}
    legs = [r.event_id for r in t.ledger_trade.collect()]
    assert held == {1, 4} == set(legs) and {r.event_id for r in t.trade.collect()} == {1, 2, 4}
    assert len(legs) == t.trade.where("event_id in (1, 4)").count()


def test_win_share_of_the_season_before_sums_no_lines(spark):
    from swapledger.plans.features import context_matrix
    from swapledger.plans.q_joins import prior_team_value, prior_win_share

    t = Tables(spark, SF)
    assert "l_orderkey" not in plan(prior_win_share(t))
    known = prior_team_value(t).select("to_team", "season", "prior_pct").where("prior_pct is not null")
    assert rows_of(known) == rows_of(prior_win_share(t).where("prior_pct is not null"))
    assert not [x for x in plan(context_matrix(t)).splitlines() if "FullOuter" in x and "team_id" in x]


def test_context_takes_payroll_and_rows_from_written_tables(spark):
    from swapledger.plans.features import context_matrix

    text = plan(context_matrix(Tables(spark, SF)))
    assert "salary" not in text and "payroll" in text and not any("Window" in x and "_in" in x for x in text.splitlines())


def test_outcomes_write_narrow_legs_of_the_ledger_alone(spark, tmp_path, monkeypatch):
    from swapledger.operators import acquired as A
    from swapledger.operators import outcomes as O
    from swapledger.operators import regress
    from swapledger.plans.q_summaries import outcome_matrix_q, prices

    t = small_tables(spark, tmp_path)
    whole = O.outcome_matrix(
        t.ledger.withColumnRenamed("team_id", "to_team"),
        [A.mean_deltas(t.metric_window, {"metric_a": "metric_a_delta", "metric_b": "metric_b_delta"}).select("event_id", "to_team", "metric_a_delta", "metric_b_delta")],
        prices(t).drop("empirical"), O.acquired_cost(t.trade, t.psr))
    written, write = {}, regress.materialise
    monkeypatch.setattr(regress, "materialise", lambda df, purpose: written.setdefault(purpose, write(df, purpose)))
    got = outcome_matrix_q(Tables(spark, str(tmp_path)))
    digits = {"metric_a_delta": 6, "metric_b_delta": 6, "dollar_surplus": 4, "surplus_wins": 6}
    assert rows_of(got) == rows_of(whole.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in got.columns])) != []
    assert all(set(df.columns) == {"event_id", "season", "player_id", "from_team", "to_team"} for df in written.values())
    *_, last = written.values()
    assert rows_of(last) == rows_of(t.ledger_trade.select(*last.columns))


def test_facts_of_outcomes_are_equal(spark, tmp_path):
    from swapledger.operators import outcomes as O
    from swapledger.plans.q_summaries import prices

    t = small_tables(spark, tmp_path)
    s = t.for_outcomes()
    for name in ("psv", "metric", "ledger"):
        assert rows_of(getattr(s, name)) == rows_of(getattr(t, name)) != []
    assert rows_of(s.history.select("player_id", "by_season")) == rows_of(t.history.select("player_id", "by_season"))
    assert rows_of(O.player_cost(s.paid)) == rows_of(O.player_cost(t.psr).where("cost is not null")) != []
    assert rows_of(prices(s)) == rows_of(prices(t))
    assert rows_of(O.acquired_cost(s.ledger_trade, s.paid)) == rows_of(O.acquired_cost(t.ledger_trade, t.psr))


def test_legs_of_affiliated_events(spark):
    from swapledger.operators.ledger import affiliated_legs

    legs = spark.createDataFrame(
        [(1, 2, 22), (1, 22, 5), (2, 3, 4), (2, 1, 4), (3, 5, 23), (4, 2, 2), (4, 2, 2)], "event_id long, from_team int, to_team int")
    kept = [tuple(r) for r in affiliated_legs(legs, 2, 22).collect()]
    assert sorted(kept) == [(1, 2, 22), (1, 22, 5), (4, 2, 2), (4, 2, 2)]
