"""Two-sided ledger of an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swapledger.operators.offsets import history_window, window_sum


def align_season(legs: DataFrame) -> DataFrame:
    """Give every leg of an event the season of its first leg."""
    first = legs.groupBy("event_id").agg(F.min_by("season", "leg_order").alias("_season"))
    return legs.join(first, "event_id").withColumn("season", F.col("_season")).drop("_season")


def leg_values(legs: DataFrame, history: DataFrame, years: int = 3) -> DataFrame:
    """``received`` and ``given`` value of every leg, from one join on the player.

    The window depends only on (player, season) and the receiver split only on
    (player, season, receiver), so the maximum over equal keys is the value
    itself and no second aggregation is needed.  The receiver's share of the
    season of the move counts for the receiver only.
    """
    windowed = history_window(legs, history, range(1, years + 1))
    given = window_sum(1, years)
    return windowed.withColumn("given", given).withColumn(
        "received", given + F.coalesce(F.col("value_t_with_receiver"), F.lit(0.0))
    )


def affiliated_rows(ledger: DataFrame, low: int, high: int) -> DataFrame:
    """Ledger rows of events whose teams all lie in an id range.

    The ledger holds every team of an event, so the test needs no second pass over
    the legs; an event has at most one row per team.
    """
    w = Window.partitionBy("event_id")
    inside = (F.min("team_id").over(w) >= low) & (F.max("team_id").over(w) <= high)
    return ledger.withColumn("_in", inside).where("_in").drop("_in")


def affiliated_legs(legs: DataFrame, low: int, high: int) -> DataFrame:
    """Legs of events whose teams all lie in an id range: the events that ``affiliated_rows`` keeps in a ledger.

    Teams are known before any value is, so no other leg has to be valued.  One row per
    event meets its legs, so a huge event stays spread over tasks.
    """
    teams = legs.groupBy("event_id").agg(
        F.min(F.least("from_team", "to_team")).alias("_low"), F.max(F.greatest("from_team", "to_team")).alias("_high")
    )
    inside = teams.where((F.col("_low") >= low) & (F.col("_high") <= high)).select("event_id")
    return legs.join(inside, "event_id", "left_semi")


def naive_ledger(
    legs: DataFrame,
    history: DataFrame,
    years: int = 3,
    season_of_first_leg: bool = False,
) -> DataFrame:
    """One row per (event, team): received, given, surplus and leg counts."""
    if season_of_first_leg:
        legs = align_season(legs)
    valued = leg_values(
        legs.select("event_id", "season", "player_id", "from_team", "to_team"), history, years
    )
    sides = valued.select(
        "event_id",
        "season",
        F.explode(
            F.array(
                F.struct(F.col("to_team").alias("team_id"), F.col("received"), F.lit(0.0).alias("given"),
                         F.lit(1).alias("r"), F.lit(0).alias("g")),
                F.struct(F.col("from_team").alias("team_id"), F.lit(0.0).alias("received"), F.col("given"),
                         F.lit(0).alias("r"), F.lit(1).alias("g")),
            )
        ).alias("x"),
    ).select("event_id", "season", "x.*")
    return sides.groupBy("event_id", "season", "team_id").agg(
        F.round(F.sum("received"), 3).alias("received"),
        F.round(F.sum("given"), 3).alias("given"),
        F.round(F.sum("received") - F.sum("given"), 3).alias("surplus"),
        F.sum("r").alias("n_received"),
        F.sum("g").alias("n_given"),
    )


def winners(ledger: DataFrame) -> DataFrame:
    """Winner and asymmetry of each event; the smaller team id wins a tie."""
    best = F.struct(F.col("surplus"), (-F.col("team_id")).alias("rank"))
    return ledger.groupBy("event_id").agg(
        F.max_by("team_id", best).alias("winner"),
        F.round(F.max("surplus") - F.min("surplus"), 3).alias("asymmetry"),
        F.count("*").alias("n_teams"),
    )


def moved_names(legs: DataFrame, players: DataFrame) -> DataFrame:
    """Names on each side of each event, in leg order, as rows.

    Rows instead of lists: a huge event stays spread over tasks.  A missing name
    falls back to ``#id``.
    """
    named = legs.join(players, "player_id", "left")
    label = F.coalesce("player_name", F.concat(F.lit("#"), F.col("player_id").cast("string")))
    return named.select(
        "event_id",
        "leg_index",
        F.explode(
            F.array(
                F.struct(F.col("to_team").alias("team_id"), F.lit("received").alias("side")),
                F.struct(F.col("from_team").alias("team_id"), F.lit("given").alias("side")),
            )
        ).alias("x"),
        label.alias("name"),
    ).select("event_id", "x.team_id", "x.side", "leg_index", "name")
