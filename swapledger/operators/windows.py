"""Small compositions over windowed legs and seasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired_seasons(
    facts: DataFrame, keys: Sequence[str], metric: str, before: int = -1, after: int = 1
) -> DataFrame:
    """Inner pairs of a metric at two offsets of the same keys, by the season between.

    Each fact row feeds at most two seasons, so pairing is one aggregate instead
    of a self join.
    """
    slots = facts.select(
        *keys, metric, "season",
        F.explode(F.array(F.lit(before), F.lit(after))).alias("_k"),
    ).withColumn("season", F.col("season") - F.col("_k"))
    pairs = slots.groupBy(*keys, "season").agg(
        F.max(F.when(F.col("_k") == before, F.col(metric))).alias(f"{metric}_before"),
        F.max(F.when(F.col("_k") == after, F.col(metric))).alias(f"{metric}_after"),
    )
    return pairs.dropna(subset=[f"{metric}_before", f"{metric}_after"])


def both_sides(windowed: DataFrame, delta: str) -> DataFrame:
    """Received, sent and net sums per (event, team, season), NULL sums as 0."""
    sides = windowed.select(
        "event_id", "season", delta,
        F.explode(
            F.array(
                F.struct(F.col("to_team").alias("team_id"), F.lit(1).alias("sign")),
                F.struct(F.col("from_team").alias("team_id"), F.lit(-1).alias("sign")),
            )
        ).alias("x"),
    ).select("event_id", "season", delta, "x.*")
    side = lambda s: F.coalesce(F.sum(F.when(F.col("sign") == s, F.col(delta))), F.lit(0.0))
    return sides.groupBy("event_id", "team_id", "season").agg(
        side(1).alias("received"), side(-1).alias("sent"), (side(1) - side(-1)).alias("net")
    )
