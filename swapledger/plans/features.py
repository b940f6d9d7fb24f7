"""The feature matrix over the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swapledger.operators import acquired as A
from swapledger.operators.assembly import assemble
from swapledger.sources.tables import SCALE


def acquired_side(t, legs: DataFrame | None = None) -> DataFrame:
    """All acquired-player features from one pass over the legs."""
    picks = t.base("part").where("p_size <= 25").select(
        F.col("p_partkey").alias("player_id"), F.col("p_partkey").alias("pick")
    )
    profile = A.player_profile(t.player_rows, t.metric, picks, SCALE)
    return A.acquired_features(t.trade if legs is None else legs, profile, [3, 5], [8, 13, 21])


def feature_matrix(t, start: int | None = None, end: int | None = None) -> DataFrame:
    """One row per (event, receiver) of the ledger with all features, over all or given seasons."""
    from swapledger.plans.q_joins import ledger_base, prior_team_value, team_cost

    base = ledger_base(t)
    if start is not None:
        base = base.where(F.col("season") >= start)
    if end is not None:
        base = base.where(F.col("season") <= end)
    cost = team_cost(t).withColumn("payroll", F.col("payroll").cast("double"))
    wide = assemble(
        base,
        season_sides=[prior_team_value(t), cost.withColumnRenamed("team_id", "to_team")],
        event_sides=[acquired_side(t, t.ledger_trade)],
    )
    origin_cost = cost.select(
        F.col("team_id").alias("origin_team"), "season", F.col("payroll").alias("origin_payroll")
    )
    return wide.join(origin_cost, ["origin_team", "season"], "left").withColumn(
        "late_era", (F.col("season") >= 1998).cast("int")
    )


def context_matrix(t, base: DataFrame | None = None) -> DataFrame:
    """One row per (event, receiver) of the ledger, or of ``base``, with the context sides of the feature matrix.

    Demographics, awards, minor-league quality and grades of the acquired players come from one
    join of the legs with a player profile; payroll context, win share, development fit and park
    factor are team-season sides.
    """
    from swapledger.operators import teams as T
    from swapledger.operators.acquired import highest_level
    from swapledger.operators.context import acquired_context, context_profile, with_interactions
    from swapledger.operators.people import regime_or_unknown
    from swapledger.operators.regress import materialise
    from swapledger.plans.q_aggregates import cost_by_team, people, thresholds
    from swapledger.plans.q_joins import ledger_base, prior_win_share
    from swapledger.plans.q_windows import jumps

    legs = t.ledger_trade if base is not None else None
    if base is None:
        # Written, as the rows and the choice of legs both need them; no value is summed for them.
        base = materialise(ledger_base(t).select("event_id", "season", "to_team"), "context-rows")
        legs = t.trade.join(base.select("event_id").distinct(), "event_id", "left_semi")
    cost = materialise(cost_by_team(t), "team-cost")
    part = t.base("part")
    ages = part.select(F.col("p_partkey").alias("player_id"), (F.lit(18) + F.col("p_partkey") % 12).alias("age"))
    grades = part.where("p_size >= 20").select(F.col("p_partkey").alias("player_id"), F.col("p_size").alias("grade"))
    awards = t.leg.where("priority = '1-URGENT'").select("player_id", "season")
    profile = context_profile(people(t), ages, grades, awards, highest_level(t.level))
    receiver = lambda df, *columns: df.select(F.col("team_id").alias("to_team"), "season", *columns)
    wide = assemble(
        base,
        season_sides=[
            prior_win_share(t),
            receiver(T.payroll_context(cost, thresholds(t)), "payroll", "pct_of_cap", "growth_3yr"),
            receiver(T.park_factor(T.run_environment(t.game)), "park_factor"),
            receiver(T.trailing_features(jumps(t)), F.col("flat").alias("dev_fit"), "recency_bias"),
        ],
        event_sides=[acquired_context(legs, profile)],
    )
    named = regime_or_unknown(wide.withColumn("team_id", F.col("to_team")), t.regime).drop("team_id")
    return with_interactions(named)


def platoon_seasons(t) -> DataFrame:
    """Platoon split per team and season; the fixture's pitchers stand for both."""
    from swapledger.operators import playlog as P
    from swapledger.plans.q_summaries import code_column

    klass, is_pa, _ = P.play_class(code_column())
    plays = t.base("events").where(is_pa).select(
        (F.col("user_id") % 25).cast("int").alias("team_id"), (F.lit(1995) + F.col("user_id") % 7).cast("int").alias("season"), klass.alias("klass"),
        F.when(F.col("event_id") % 2 == 0, "L").otherwise("R").alias("bat_hand"), F.when(F.col("event_id") % 3 == 0, "L").otherwise("R").alias("pit_hand"))
    return P.platoon_split(plays)


def whole_matrix(t) -> DataFrame:
    """The feature matrix in one: acquired players, context, and the sides of both teams.

    Legs and player-season amounts are written once and every side reads those files.  Beside
    the two halves it holds the origin team's bad-contract pressure, and the receiver's
    technology lead, lineage of decision makers and platoon difference of the season before.
    """
    from swapledger.functions import network as N
    from swapledger.operators import teams as T
    from swapledger.plans.q_scalars import _ADOPT, lineage_scores_q

    s = t.for_matrices("metric", "ledger")
    # Both halves have the win share and the payroll, from the same facts; the context's are kept.
    wide = context_matrix(s, feature_matrix(s).drop("prior_pct", "payroll"))
    # Only the sign of a value counts: whole units stand for amounts.
    pressure = T.sunk_cost_pressure(s.psr.withColumn("value_amt", F.col("units")), min_salary=60000, unit=1e5 * 0.97).select(
        F.col("team_id").alias("origin_team"), "season", F.col("pressure").alias("origin_pressure"))
    lineage = lineage_scores_q(t).select(F.col("team_id").alias("to_team"), "season", "lineage")
    platoon = platoon_seasons(t).select(F.col("team_id").alias("to_team"), (F.col("season") + 1).alias("season"), "platoon_diff")
    return (
        wide.join(pressure, ["origin_team", "season"], "left").join(lineage, ["to_team", "season"], "left").join(platoon, ["to_team", "season"], "left")
        .withColumn("technology_lead", N.technology_lead(F.col("to_team"), F.col("season"), _ADOPT, 2003))
    )

