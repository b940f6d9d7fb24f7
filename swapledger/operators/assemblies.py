"""Roster and farm assemblies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swapledger.functions.scans import HOT_ROWS, hot_keys, ordinal_within, with_buckets
from swapledger.operators.legs import numbered_parts
from swapledger.sources.writers import bundle

# Name of each level code.
LEVEL_NAME = {11: "AAA", 12: "AA", 13: "A+", 14: "A", 16: "R"}


def roster_snapshot(roster: DataFrame, sides: list[DataFrame], key: str = "player_id") -> DataFrame:
    """Roster rows with every known side attached; each side is one row per player."""
    out = roster
    for side in sides:
        out = out.join(side, key, "left")
    return out


def per_team(rows: DataFrame, team: str, key: str, size: int = 10_000) -> DataFrame:
    """Roster rows (one per team and player) as sorted lists per team of at most ``size`` players."""
    rest = [c for c in rows.columns if c not in (team, key)]
    return numbered_parts(rows, team, key, size).groupBy(team, "part").agg(
        F.count("*").alias("n_players"), F.sort_array(F.collect_list(F.struct(key, *rest))).alias("players")
    )


def current_affiliation(
    players: DataFrame, clubs: DataFrame, live: DataFrame, legacy: DataFrame
) -> DataFrame:
    """Current parent club of each player and whether it moved.

    ``players``: current_team_id, parent_org_id, old_team_id.  The current team is a
    club itself, else in the live map, else in the legacy map, else its parent
    organisation counts; players without any drop out.
    """
    club = clubs.select(F.col("club_id").alias("current_team_id"), F.col("club_id").alias("_club"))
    lv = live.select(F.col("team_id").alias("current_team_id"), F.col("parent").alias("_live"), F.col("level").alias("_live_level"))
    lg = legacy.select(F.col("team_id").alias("current_team_id"), F.col("parent").alias("_legacy"), F.col("level").alias("_legacy_level"))
    org = clubs.select(F.col("club_id").alias("parent_org_id"), F.col("club_id").alias("_org"))
    old = live.select(F.col("team_id").alias("old_team_id"), F.col("parent").alias("_old_live"))
    old2 = legacy.select(F.col("team_id").alias("old_team_id"), F.col("parent").alias("_old_legacy"))
    j = (
        players.join(club, "current_team_id", "left").join(lv, "current_team_id", "left").join(lg, "current_team_id", "left")
        .join(org, "parent_org_id", "left").join(old, "old_team_id", "left").join(old2, "old_team_id", "left")
    )
    parent = F.coalesce("_club", "_live", "_legacy", "_org")
    level = (
        F.when(F.col("_club").isNotNull(), "MLB").when(F.col("_live").isNotNull(), F.col("_live_level"))
        .when(F.col("_legacy").isNotNull(), F.col("_legacy_level")).otherwise("?")
    )
    former = F.coalesce("_old_live", "_old_legacy")
    return (
        j.withColumn("parent", parent).withColumn("level", level).withColumn("former_parent", former)
        .where(F.col("parent").isNotNull())
        .withColumn("moved", F.coalesce(F.col("former_parent") != F.col("parent"), F.lit(False)))
        .drop("_club", "_live", "_live_level", "_legacy", "_legacy_level", "_org", "_old_live", "_old_legacy")
    )


def farm_order(players: DataFrame) -> DataFrame:
    """Sort key of a farm list: hitters by OPS descending, then pitchers by ERA ascending."""
    quality = F.when(F.col("is_pitcher"), F.coalesce("era", F.lit(99.0))).otherwise(-F.coalesce("ops", F.lit(0.0)))
    return players.withColumn("sort_group", F.col("is_pitcher").cast("int")).withColumn("sort_value", quality)


def farm_list(players: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Position of each player in the list of its parent and level; long lists are numbered in buckets."""
    rows = players.withColumn("_list", F.concat_ws("|", F.col("parent").cast("string"), "level"))
    # Rises with the order of the list: pitchers come after any hitter.
    at = F.col("sort_group") * F.lit(1e9) + F.col("sort_value")
    cut = with_buckets(rows, hot_keys(rows, "_list", at, hot_rows), "_list", at, "_bucket")
    return ordinal_within(cut, ["_list"], "_bucket", ["sort_group", "sort_value", "player_id"], "position_in_list").drop("_list", "_bucket")


def trade_documents(legs: DataFrame, ledger: DataFrame, size: int = 1000) -> DataFrame:
    """One document per event: its legs in order and the ledger row of each side.

    An event of more than ``size`` legs gives several documents, cut by leg ordinal; ``legs`` has
    leg_index.  The sides, one per team, stand in the first.
    """
    part = F.floor(F.col("leg_index") / size)
    rest = ["leg_index", "season", "player_id", "from_team", "to_team"]
    moves = legs.select("event_id", part.alias("part"), *rest).groupBy("event_id", "part").agg(
        F.sort_array(F.collect_list(F.struct(*rest))).alias("legs"))
    sides = ledger.groupBy(F.col("event_id").alias("_event")).agg(
        F.sort_array(F.collect_list(F.struct("team_id", "received", "given", "surplus"))).alias("sides"))
    # Joined on the event alone: both lie by event already, so no list is moved.
    whole = moves.join(sides, (F.col("event_id") == F.col("_event")) & (F.col("part") == 0), "full")
    return whole.select(
        F.coalesce("event_id", "_event").alias("event_id"), F.coalesce("part", F.lit(0).cast("long")).alias("part"), "legs", "sides")


def player_documents(names: DataFrame, seasons: DataFrame, legs: DataFrame, size: int = 1000) -> DataFrame:
    """One document per player: name, values by season, and the events the player moved in.

    More than ``size`` events give several documents, cut by ordinal; the seasons, bounded by a
    career, stand in the first.
    """
    moved = numbered_parts(legs.select("player_id", "event_id").distinct(), "player_id", "event_id", size)
    years = seasons.select("player_id", F.lit(0).cast("long").alias("part"), "season", "value")
    keys = ["player_id", "part"]
    parent = moved.select(*keys).union(years.select(*keys)).distinct().join(names, "player_id", "left")
    return bundle(parent, {"seasons": years, "events": moved}, keys, {"seasons": ["season"], "events": ["event_id"]})
