"""Draft results and development credit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swapledger.functions.scalars import alias_code
from swapledger.functions.scans import exact_quantiles


def draft_rollup(picks: DataFrame, careers: DataFrame) -> DataFrame:
    """Per drafting team: picks, players who reached, value sum, mean, median, rate."""
    j = picks.join(careers, "player_id", "left")
    basic = j.groupBy("team").agg(
        F.count("*").alias("picks"),
        F.count("career_value").alias("reached"),
        F.coalesce(F.sum("career_value"), F.lit(0.0)).alias("total_value"),
        F.avg("career_value").alias("mean_value"),
        F.try_divide(F.count("career_value"), F.count("*")).alias("reach_rate"),
    )
    return basic.join(exact_quantiles(j, ["team"], "career_value", {"median_value": 0.5}), "team", "left")


def hit_rates(picks: DataFrame, careers: DataFrame, max_round: int = 10, hit: float = 0.0) -> DataFrame:
    """Share of picks per round that reached, and that beat the threshold."""
    r = F.col("round_text").try_cast("int")
    return (
        picks.withColumn("round", r)
        .where(F.col("round").between(1, max_round))
        .join(careers, "player_id", "left")
        .groupBy("round")
        .agg(
            F.count("*").alias("picks"),
            F.try_divide(F.count("career_value"), F.count("*")).alias("reach_rate"),
            F.try_divide(F.count_if(F.col("career_value") > hit), F.count("*")).alias("hit_rate"),
        )
    )


def scout_to_sign(picks: DataFrame, first: DataFrame, aliases: Mapping, max_round: int = 15) -> DataFrame:
    """Per round: picks, those who reached, and those who first played for the team that picked them.

    ``first``: (player_id, first_team).  Codes fold through the alias map on both sides.
    """
    reached = F.col("first_team").isNotNull()
    own = reached & (alias_code(aliases, F.col("team")) == alias_code(aliases, F.col("first_team")))
    return (
        picks.withColumn("round", F.col("round_text").try_cast("int"))
        .where(F.col("round").between(1, max_round))
        .join(first, "player_id", "left")
        .groupBy("round")
        .agg(
            F.count("*").alias("picks"), F.count_if(reached).alias("n_reached"), F.count_if(own).alias("n_own"),
            F.try_divide(F.count_if(reached), F.count("*")).alias("reach_rate"),
            (F.count_if(own) / F.greatest(F.count_if(reached), F.lit(1))).alias("sign_rate"),
        )
    )


def first_team(roles: DataFrame, order: Sequence[str]) -> DataFrame:
    """Team of each player's first stint; the order columns must be total per player."""
    return roles.groupBy("player_id").agg(F.min_by("team_id", F.struct(*order)).alias("first_team"))


def development_credit(
    careers: DataFrame, drafted: DataFrame, moves: DataFrame, aliases: Mapping, since: int, undrafted_since: int
) -> DataFrame:
    """Career value credited to the first team, the undrafted part of it, and the trade effect.

    ``careers``: (player_id, team, career_value, first_season); ``moves``: (team, n,
    mean_delta) per raw team code.  Codes fold through the alias map; the folded
    effect is the plain mean of the raw codes' means, with the weighted one beside it.
    """
    folded = careers.withColumn("team", alias_code(aliases, F.col("team")))
    dev = folded.where(F.col("first_season") >= since).groupBy("team").agg(
        F.count("*").alias("n_debuts"), F.sum("career_value").alias("dev_value")
    )
    free = (
        folded.where(F.col("first_season") >= undrafted_since)
        .join(drafted.select("player_id").distinct(), "player_id", "left_anti")
        .groupBy("team")
        .agg(F.count("*").alias("n_undrafted"), F.sum("career_value").alias("undrafted_value"))
    )
    trade = moves.withColumn("team", alias_code(aliases, F.col("team"))).groupBy("team").agg(
        F.sum("n").alias("n_trades"),
        F.avg("mean_delta").alias("mean_delta"),
        (F.sum(F.col("mean_delta") * F.col("n")) / F.sum("n")).alias("weighted_delta"),
    )
    return dev.join(free, "team", "left").join(trade, "team", "left")
