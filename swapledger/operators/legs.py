"""Trade legs and event roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swapledger.functions.scans import hot_keys, ordinal_within, with_buckets


def trade_legs(legs: DataFrame, type_code: str) -> DataFrame:
    """Legs of one movement type with player and both teams known."""
    return legs.where(
        (F.col("type_code") == type_code)
        & F.col("player_id").isNotNull()
        & F.col("from_team").isNotNull()
        & F.col("to_team").isNotNull()
    )


def unified_legs(legs: DataFrame, teams: DataFrame) -> DataFrame:
    """Names and divisions of both teams of a leg (two-role bridge, left outer)."""
    source = teams.select(
        F.col("team_id").alias("_f"),
        F.col("team_name").alias("from_name"),
        F.col("division_id").alias("from_division"),
    )
    target = teams.select(
        F.col("team_id").alias("_t"),
        F.col("team_name").alias("to_name"),
        F.col("division_id").alias("to_division"),
    )
    return (
        legs.join(source, legs.from_team == source["_f"], "left")
        .join(target, legs.to_team == target["_t"], "left")
        .drop("_f", "_t")
    )


def numbered_parts(rows: DataFrame, key: str, member: str, size: int) -> DataFrame:
    """``rows`` with ``part``: ordinal of ``member`` inside its key, cut into parts of ``size``.

    Pairs of key and member are distinct; hot keys are numbered in buckets.
    """
    position = F.col(member)
    cut = with_buckets(rows, hot_keys(rows, key, position), key, position, "_bucket")
    numbered = ordinal_within(cut, [key], "_bucket", [member], "_n", start=0)
    return numbered.withColumn("part", F.floor(F.col("_n") / size)).drop("_n", "_bucket")


def event_rollup(legs: DataFrame) -> DataFrame:
    """One row per event: legs, players, givers and receivers, description of the first leg.

    The two lists hold teams, which are few.  Players are counted here; their lists
    come from ``event_players``.
    """
    return legs.groupBy("event_id").agg(
        F.count("*").alias("n_legs"),
        F.count_distinct("player_id").alias("n_players"),
        F.sort_array(F.collect_set("from_team")).alias("givers"),
        F.sort_array(F.collect_set("to_team")).alias("receivers"),
        F.min_by("priority", "leg_order").alias("description"),
        F.min("season").alias("season"),
        F.min("player_id").alias("low_player"),
        F.max("player_id").alias("high_player"),
    )


def event_players(legs: DataFrame, size: int = 10_000) -> DataFrame:
    """Distinct players of each event as sorted lists of at most ``size`` ids.

    Parts are cut by the player's ordinal inside the event, so an event of up to ``size``
    players is one list, however far apart the ids lie; a larger one is the parts in order.
    """
    players = numbered_parts(legs.select("event_id", "player_id").distinct(), "event_id", "player_id", size)
    return players.groupBy("event_id", "part").agg(F.sort_array(F.collect_list("player_id")).alias("players"))


def affiliated_from_rollup(events: DataFrame, low: int, high: int) -> DataFrame:
    """Events whose teams all lie in an id range, read from the team lists."""
    inside = [
        f(c).between(low, high) for c in ("givers", "receivers") for f in (F.array_min, F.array_max)
    ]
    cond = inside[0]
    for c in inside[1:]:
        cond = cond & c
    return events.where(cond)


def origin_team(legs: DataFrame) -> DataFrame:
    """First sending team per (event, receiver) in leg order."""
    return (
        legs.where(F.col("from_team") != F.col("to_team"))
        .groupBy("event_id", "to_team")
        .agg(F.min_by("from_team", "leg_order").alias("origin_team"))
    )
