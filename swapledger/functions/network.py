"""Technology lead and lineage of decision makers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swapledger.functions.scalars import clamp, lookup

# Season each club put tracking technology into its minor leagues.
ADOPTION_YEAR = {
    "HOU": 2013, "PIT": 2012, "STL": 2014, "CHC": 2014, "LAD": 2014, "TBR": 2015, "CLE": 2014, "BOS": 2015,
    "NYY": 2016, "OAK": 2016, "ATL": 2015, "SDP": 2016, "MIN": 2016, "SEA": 2016,
}
MANDATE_YEAR = 2019

# Roles that count as general manager and as director.
GM_ROLES = ["General Manager", "President"]
DIRECTOR_ROLES = ["Scouting Director", "Farm Director"]


def technology_lead(team: Column, season: Column, adoption: Mapping = ADOPTION_YEAR, mandate: int = MANDATE_YEAR) -> Column:
    """Seasons ahead of the mandate, 0 before the team adopted, at most 7."""
    year = lookup(adoption, team, mandate)
    return F.when(season < year, 0.0).otherwise(clamp((F.lit(mandate) - year).cast("double"), 0, 7))


def lineage_scores(
    office: DataFrame, stints: DataFrame, windows: DataFrame, gm_roles: list[str], director_roles: list[str]
) -> DataFrame:
    """Best lineage score per (team, season).

    A stint counts when it overlaps the pioneer window of its club: 1 for a general
    manager's stint; for a director's, 0.5 when the person now runs a club and 1
    when still a director.  ``stints``: person, club, first, last, level; ``windows``:
    club, w_first, w_last.
    """
    valid = stints.join(windows, "club").where((F.col("first") <= F.col("w_last")) & (F.col("last") >= F.col("w_first")))
    best = valid.groupBy("person").agg(
        F.max((F.col("level") == "gm").cast("int")).alias("gm_stint"),
        F.max((F.col("level") == "dir").cast("int")).alias("dir_stint"),
    )
    score = (
        F.when(F.col("gm_stint") == 1, 1.0)
        .when((F.col("dir_stint") == 1) & F.col("role").isin(*director_roles), 1.0)
        .when((F.col("dir_stint") == 1) & F.col("role").isin(*gm_roles), 0.5)
        .otherwise(0.0)
    )
    return office.join(best, "person", "left").groupBy("team_id", "season").agg(F.max(score).alias("lineage"))
