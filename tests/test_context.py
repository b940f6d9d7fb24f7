"""Context columns of acquired players, and seasons taken from the data."""

from swapledger.operators.context import acquired_context, context_profile
from swapledger.operators.seasons import rolling_correlation


def test_context_counts_awards_once_and_legs_each(spark):
    legs = spark.createDataFrame(
        [(1, 7, 10, 2000), (1, 7, 10, 2000), (1, 7, 11, 2000), (2, 7, 99, 2000)], "event_id long, to_team int, player_id long, season int")
    people = spark.createDataFrame(
        [(10, 1970, "L", 1, "Pitcher"), (11, 1975, "R", 0, "Other")],
        "player_id long, birth_year int, bat_side string, is_international int, position_type string")
    ages = spark.createDataFrame([(10, 20), (11, 22)], "player_id long, age int")
    grades = spark.createDataFrame([(10, 50), (10, 40)], "player_id long, grade int")
    awards = spark.createDataFrame([(10, 1999), (10, 1999), (10, 2000), (11, 2001)], "player_id long, season int")
    tops = spark.createDataFrame(
        [(10, 1999, "hitting", 12, 60.0, 0.8), (10, 1998, "hitting", 11, 60.0, 0.9), (11, 1999, "pitching", 11, 30.0, 4.0)],
        "player_id long, season int, grp string, top_level int, pa double, ops_weighted double")
    got = {r.event_id: r for r in acquired_context(legs, context_profile(people, ages, grades, awards, tops)).collect()}
    a, b = got[1], got[2]
    assert abs(a.avg_age - (30 + 30 + 25) / 3) < 1e-9 and abs(a.pct_left_bat - 2 / 3) < 1e-9
    assert a.avg_prior_awards == 1.0 and a.pct_awarded == 0.5
    assert abs(a.hit_quality - 0.8 * 0.85) < 1e-9 and abs(a.pitch_quality - 5.0 / 4.0) < 1e-9
    assert abs(a.age_advantage - (3 + 3 + 3) / 3) < 1e-9 and (a.avg_grade, a.max_grade) == (50.0, 50)
    assert (b.avg_age, b.hit_quality, b.max_grade) == (None, None, None) and (b.avg_prior_awards, b.pct_left_bat) == (0.0, 0.0)


def test_rolling_windows_follow_the_seasons_there_are(spark):
    rows = [(s, float(i), float(i * i)) for s in range(1990, 1998) for i in range(4)]
    df = spark.createDataFrame(rows, "season int, a double, b double")
    assert sorted(r.window_start for r in rolling_correlation(df, "a", "b").collect()) == list(range(1990, 1996))
    assert sorted(r.window_start for r in rolling_correlation(df, "a", "b", 1991, 1994).collect()) == [1991, 1992]


def test_comparables_with_unknown_ages(spark):
    """Band join against the plain pair rule, unknown ages on either side."""
    from swapledger.operators.matching import age_banded

    ages = [None, 0, 2, 3, 5, 6, 9, 20, None, 21, 23, 24]
    players = spark.createDataFrame([(i, "r", i % 2, a) for i, a in enumerate(ages)], "player_id int, role string, grp int, age int")
    focus = players.selectExpr("player_id as focus_id", "role", "grp", "age as _age")
    got = {(r.focus_id, r.player_id) for r in age_banded(players, focus, 3).collect()}
    rows = [(i, i % 2, a) for i, a in enumerate(ages)]
    near = lambda a, b: a is None or b is None or abs(a - b) <= 3
    want = {(f, p) for f, g, a in rows for p, h, b in rows if g == h and near(a, b)}
    assert want <= got
    far = {(f, p) for f, p in got - want}
    assert all(abs(ages[f] // 3 - ages[p] // 3) <= 1 for f, p in far)
