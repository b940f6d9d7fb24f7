"""Decision makers, staff and coaches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decision_makers(office: DataFrame, priority: Sequence[str]) -> DataFrame:
    """Top person per (team, season) by role priority, and the regime id."""
    by_role = [F.max(F.when(F.col("role") == r, F.col("person"))) for r in priority]
    return (
        office.groupBy("team_id", "season")
        .agg(
            by_role[0].alias("president"),
            by_role[1].alias("gm"),
            F.coalesce(*by_role).alias("decision_maker"),
        )
        .withColumn(
            "regime_id",
            F.concat_ws(
                "_", F.col("team_id").cast("string"), F.coalesce("decision_maker", F.lit("UNKNOWN"))
            ),
        )
    )


def regime_or_unknown(keys: DataFrame, regimes: DataFrame, suffix: str = "_UNKNOWN") -> DataFrame:
    """Regime id of (team, season), falling back to the team id plus a suffix."""
    return keys.join(regimes.select("team_id", "season", "regime_id"), ["team_id", "season"], "left").withColumn(
        "regime_id", F.coalesce("regime_id", F.concat(F.col("team_id").cast("string"), F.lit(suffix)))
    )
