"""Small reusable predicates and snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tier(c: Column, high: float, low: float) -> Column:
    return F.when(c >= high, "high").when(c >= low, "mid").otherwise("low")


def search(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows whose joined columns contain the text, ignoring case."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))


def contention_score(pct: Column, cap_share: Column) -> Column:
    return pct * F.greatest(F.lit(0.0), 1.0 - F.coalesce(cap_share, F.lit(0.5)))


def fit_by_age(fit: Column, age: Column) -> Column:
    return fit * F.greatest(F.lit(0.0), 32.0 - F.coalesce(age, F.lit(32.0)))


def event_people(legs: DataFrame, office: DataFrame, staff: DataFrame) -> DataFrame:
    """People of both teams of each event in its season, tagged by layer."""
    sides = legs.select("event_id", "season", F.explode(F.array("from_team", "to_team")).alias("team_id")).distinct()
    people = office.withColumn("layer", F.lit("front_office")).unionByName(
        staff.withColumn("layer", F.lit("staff"))
    )
    return sides.join(people, ["team_id", "season"]).select("event_id", "team_id", "role", "person", "layer")
