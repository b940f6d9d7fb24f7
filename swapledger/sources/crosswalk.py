"""Identifier crosswalks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crosswalk(rows: DataFrame, register: DataFrame, teams: DataFrame, offset: int) -> DataFrame:
    """Map text codes to master ids and team codes; shift event ids by ``offset``.

    The shift keeps ids of this source apart from those of another one.  Codes
    without an entry stay, with NULL.
    """
    return (
        rows.join(register, "code", "left")
        .join(teams, "from_team", "left")
        .withColumn("event_id", F.col("event_id") + F.lit(offset))
    )
