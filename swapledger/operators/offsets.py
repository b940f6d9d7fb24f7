"""Values of a keyed yearly fact at offsets from a leg's season."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def offset_name(metric: str, k: int) -> str:
    if k == 0:
        return f"{metric}_t"
    return f"{metric}_t_{'plus' if k > 0 else 'minus'}_{abs(k)}"


def season_map(
    facts: DataFrame, metrics: Sequence[str], key: str = "player_id", season: str = "season"
) -> DataFrame:
    """One row per key with a map season -> metrics.

    ``facts`` is unique on (key, season), so a map has at most one entry per
    season of a career; a duplicate key raises instead of passing silently.
    """
    entry = F.struct(F.col(season).cast("int").alias("s"), F.struct(*metrics).alias("m"))
    return (
        facts.where(F.col(key).isNotNull() & F.col(season).isNotNull())
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(entry)).alias("by_season"))
    )


def offset_window(
    legs: DataFrame,
    facts: DataFrame,
    offsets: Iterable[int],
    metrics: Sequence[str],
    key: str = "player_id",
    season: str = "season",
) -> DataFrame:
    """Every leg once, with ``metric`` at ``season + k`` for each offset (NULL if absent).

    One equi join on the key replaces one self join per offset.  The right side
    has a single row per key, so a hot key only widens the left side, which AQE
    splits; no aggregation back to the leg is needed.
    """
    by_season = season_map(facts, metrics, key).withColumnRenamed(key, "_k")
    joined = legs.join(by_season, legs[key] == F.col("_k"), "left")
    at = {k: F.try_element_at("by_season", (F.col(season) + F.lit(k)).cast("int")) for k in offsets}
    return joined.select(
        *[legs[c] for c in legs.columns],
        *[at[k][m].alias(offset_name(m, k)) for m in metrics for k in at],
    )


def player_history(rows: DataFrame, scale: float = 1000, amount: str = "value_amt", unit: int = 1) -> DataFrame:
    """One row per player: season -> (value, team -> value), summed over roles and stints.

    One entry per team-season of a career, so a row stays small.  Exact amounts are
    summed first and scaled once at the end.
    """
    exact = F.sum(amount) if unit > 1 else F.sum(amount).cast("decimal(38,4)")
    per_team = rows.where(F.col("player_id").isNotNull()).groupBy("player_id", "season", "team_id").agg(
        exact.alias("amt")
    )
    kind = per_team.schema["amt"].dataType
    value = lambda amt: amt.cast("double") / unit / scale
    per_season = per_team.groupBy("player_id", "season").agg(
        F.struct(
            value(F.sum("amt").cast(kind)).alias("value"),
            F.map_from_entries(F.collect_list(F.struct("team_id", value(F.col("amt"))))).alias("by_team"),
        ).alias("x")
    )
    return per_season.groupBy("player_id").agg(
        F.map_from_entries(F.collect_list(F.struct("season", "x"))).alias("by_season")
    )


def history_window(
    legs: DataFrame, history: DataFrame, offsets: Iterable[int], split: str | None = "value_t_with_receiver",
    team: str = "to_team",
) -> DataFrame:
    """Value window and receiver split of every leg from a single join on the player."""
    h = history.select(F.col("player_id").alias("_k"), "by_season")
    joined = legs.join(h, legs["player_id"] == F.col("_k"), "left")
    at = lambda k: F.try_element_at("by_season", (F.col("season") + F.lit(k)).cast("int"))
    cols = [at(k)["value"].alias(offset_name("value", k)) for k in offsets]
    if split:
        cols.append(F.try_element_at(at(0)["by_team"], F.col(team)).alias(split))
    return joined.select(*[legs[c] for c in legs.columns], *cols)


def window_sum(start: int, end: int, metric: str = "value"):
    """Sum of the metric over offsets ``start..end`` with gaps as 0 (at most 5 years)."""
    if not 1 <= start <= end <= 5:
        raise ValueError("window must lie in 1..5")
    total = F.lit(0.0)
    for k in range(start, end + 1):
        total = total + F.coalesce(F.col(offset_name(metric, k)), F.lit(0.0))
    return total
