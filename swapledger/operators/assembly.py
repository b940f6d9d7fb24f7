"""Wide assemblies on (event, receiver) and (team, season)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def assemble(
    base: DataFrame, event_sides: Iterable[DataFrame] = (), season_sides: Iterable[DataFrame] = (),
    event_keys: tuple[str, ...] = ("event_id", "to_team"), season_keys: tuple[str, ...] = ("to_team", "season"),
) -> DataFrame:
    """Left join one-row-per-key sides onto a base.

    Season sides come first: they are small, so AQE turns them into broadcast
    joins by measured size; event sides then share one hash partitioning on the
    event keys.
    """
    out = base
    for side in season_sides:
        out = out.join(side, list(season_keys), "left")
    for side in event_sides:
        out = out.join(side, list(event_keys), "left")
    return out
