"""Documents and names of any length."""

from types import SimpleNamespace

from swapledger.plans.q_summaries import ordered_names, ordered_names_in_parts
from swapledger.sources.markup import ranking_rows


def test_ranking_needs_no_join(spark):
    line = lambda rank, ident, fv: f"| {rank} | x | [P {ident}](https://b.com/players/p/{ident}/stats) | org | SS | AA | 2025 | {fv} | High | end |"
    again = "\n".join([line(1, "a", 50), line(2, "b", 45), line(3, "b", 40), line(1, "a", 50), line(4, "c", 60)])
    plain = "\n".join([line(1, "c", 55), line(2, "d", 50)])
    docs = spark.createDataFrame([(1, again, 2022), (2, plain, 2022), (None, plain, 2022)], "doc int, text string, year int")
    got = ranking_rows(docs, "text", ["doc"], "year")
    assert sorted((r.doc, r.source_id, r["rank"], r.grade) for r in got.collect()) == [(1, "a", 1, 50), (1, "b", 2, 45), (2, "c", 1, 55), (2, "d", 2, 50)]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_names_of_a_long_event_are_one_string(spark):
    legs = spark.createDataFrame([(1, 5, i, i % 3, i) for i in range(1500)], "event_id long, to_team int, leg_index long, from_team int, player_id long")
    part = spark.createDataFrame([(7, "seven", 3), (8, "eight", 40)], "p_partkey long, p_name string, p_size int")
    t = SimpleNamespace(spark=spark, numbered_trade=legs.repartition(4), base=lambda name: part)
    rows = ordered_names(t).collect()
    assert [(r.event_id, r.to_team, r.senders) for r in rows] == [(1, 5, "0,1,2")]
    assert rows[0].names.split(", ") == ["seven" if i == 7 else f"#{i}" for i in range(1500)]
    assert ordered_names_in_parts(t).count() == 750
