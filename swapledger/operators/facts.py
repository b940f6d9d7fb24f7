"""Player-season facts summed before any join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_roles(batting: DataFrame, pitching: DataFrame) -> DataFrame:
    """Stack two role tables with a role tag; columns missing on one side are NULL."""
    return batting.withColumn("role", F.lit("B")).unionByName(
        pitching.withColumn("role", F.lit("P")), allowMissingColumns=True
    )


def season_totals(rows: DataFrame, scale: float = 1000, amount: str = "value_amt", unit: int = 1) -> DataFrame:
    """One row per (player, season): value over roles, teams and stints.

    ``amount`` is exact (decimal, or a long counting 1/``unit``), so the sum does not
    depend on the order of rows.
    """
    return rows.where(F.col("player_id").isNotNull()).groupBy("player_id", "season").agg(
        (F.sum(amount).cast("double") / unit / scale).alias("value")
    )


def season_team_totals(rows: DataFrame, scale: float = 1000, amount: str = "value_amt", unit: int = 1) -> DataFrame:
    return rows.where(F.col("player_id").isNotNull()).groupBy("player_id", "season", "team_id").agg(
        (F.sum(amount).cast("double") / unit / scale).alias("value")
    )


def rate_per_600(roles: DataFrame, role: str = "B", min_volume: float = 30) -> DataFrame:
    """Ratio of sums per 600 units of volume, over rows with enough volume."""
    return (
        roles.where((F.col("role") == role) & (F.col("volume") >= min_volume))
        .groupBy("player_id", "season")
        .agg(
            (
                F.try_divide(F.sum("value_amt").cast("double"), F.sum("volume").cast("double")) * 600
            ).alias("off_per_600")
        )
    )


def career_start(facts: DataFrame) -> DataFrame:
    return facts.groupBy("player_id").agg(F.min("season").alias("first_season"))
