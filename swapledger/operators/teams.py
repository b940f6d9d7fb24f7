"""Team-season features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swapledger.functions.scans import decayed_mean, trailing_mean


def value_by_role(roles: DataFrame, scale: float = 1000) -> DataFrame:
    """Batting, pitching and total value per (team, season).

    One aggregate over both roles, so a team-season with pitching rows only stays.
    """
    side = lambda r: F.coalesce(
        F.sum(F.when(F.col("role") == r, F.col("value_amt"))).cast("double") / scale, F.lit(0.0)
    )
    return roles.groupBy("team_id", "season").agg(
        side("B").alias("bat_value"),
        side("P").alias("pit_value"),
        (F.sum("value_amt").cast("double") / scale).alias("total_value"),
    )


def sunk_cost_pressure(
    roles: DataFrame, min_salary: float = 12_000_000, unit: float = 1e7
) -> DataFrame:
    """Weight of bad contracts a team carried, published for the next season.

    Per (team, season, player): highest salary and summed value; bad = expensive
    with negative value; pressure = count x mean salary / unit.
    """
    per = (
        roles.where(F.col("salary").isNotNull() & F.col("value_amt").isNotNull())
        .groupBy("team_id", "season", "player_id")
        .agg(F.max("salary").alias("salary"), F.sum("value_amt").alias("value_amt"))
        .where((F.col("salary") > min_salary) & (F.col("value_amt") < 0))
    )
    return per.groupBy("team_id", (F.col("season") + 1).alias("season")).agg(
        F.count("*").alias("n_bad"),
        (F.sum(F.col("salary").cast("decimal(18,2)")).cast("double") / unit).alias("pressure"),
    )


def run_environment(games: DataFrame) -> DataFrame:
    """Home and road run averages and the raw park factor per (team, season, park)."""
    known = games.where(F.col("home_score").isNotNull() & F.col("visitor_score").isNotNull())
    home = known.groupBy(F.col("home_team").alias("team_id"), "season", "park_id").agg(
        F.avg("home_score").alias("scored_home"),
        F.avg("visitor_score").alias("allowed_home"),
        F.count("*").alias("home_games"),
    )
    road = known.groupBy(F.col("visitor_team").alias("team_id"), "season").agg(
        F.avg("visitor_score").alias("scored_road"),
        F.avg("home_score").alias("allowed_road"),
        F.count("*").alias("road_games"),
    )
    return home.join(road, ["team_id", "season"], "left").withColumn(
        "park_factor_raw",
        F.try_divide(
            F.col("scored_home") + F.col("allowed_home"), F.col("scored_road") + F.col("allowed_road")
        ),
    )


def park_factor(environment: DataFrame, min_games: int = 10, rows: int = 3) -> DataFrame:
    """Rolling mean over rows of the game-weighted yearly park factor."""
    yearly = (
        environment.where(F.col("park_factor_raw").isNotNull() & (F.col("home_games") >= min_games))
        .groupBy("team_id", "season")
        .agg(
            F.try_divide(
                F.sum(F.col("park_factor_raw") * F.col("home_games")), F.sum("home_games").cast("double")
            ).alias("yearly")
        )
    )
    return trailing_mean(yearly, ["team_id"], "season", "yearly", "park_factor", rows)


# Luxury-tax threshold by season.
TAX_THRESHOLD = {
    2011: 178_000_000, 2012: 178_000_000, 2013: 178_000_000, 2014: 189_000_000, 2015: 189_000_000,
    2016: 189_000_000, 2017: 195_000_000, 2018: 197_000_000, 2019: 206_000_000, 2020: 208_000_000,
    2021: 210_000_000, 2022: 230_000_000, 2023: 233_000_000, 2024: 237_000_000, 2025: 241_000_000,
}


def payroll_context(payroll: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Share of the tax threshold and growth over three seasons (exact season, not row)."""
    back = payroll.select("team_id", (F.col("season") + 3).alias("season"), F.col("payroll").alias("_old"))
    return (
        payroll.join(thresholds, "season", "left")
        .join(back, ["team_id", "season"], "left")
        .withColumn("pct_of_cap", F.try_divide(F.col("payroll"), F.col("threshold")))
        .withColumn("growth_3yr", F.try_divide(F.col("payroll") - F.col("_old"), F.col("_old")))
        .drop("_old")
    )


def jump_history(windowed: DataFrame, before: str, after: str) -> DataFrame:
    """Mean change of the acquired players per (team, season)."""
    both = windowed.where(F.col(before).isNotNull() & F.col(after).isNotNull())
    return both.groupBy(F.col("to_team").alias("team_id"), "season").agg(
        F.avg(F.col(after) - F.col(before)).alias("jump"), F.count("*").alias("n")
    )


def trailing_features(history: DataFrame, key: str = "team_id") -> DataFrame:
    """Flat and decayed trailing means, their difference, published one season later."""
    flat = trailing_mean(history, [key], "season", "jump", "flat", 3)
    both = decayed_mean(flat, [key], "season", "jump", "decayed", 5, 2.0)
    return both.select(
        key,
        (F.col("season") + 1).alias("season"),
        "flat",
        "decayed",
        (F.col("decayed") - F.col("flat")).alias("recency_bias"),
    )


def coach_features(windowed: DataFrame, coaches: DataFrame, before: str, after: str) -> DataFrame:
    """Trailing record of the coach in place, carried across employers.

    The record follows the person; the (team, season) gets the record of the coach
    assigned that season, one row per team-season, smallest known value first.
    """
    assigned = coaches.select("team_id", "season", F.col("person").alias("coach")).distinct()
    by_coach = (
        windowed.where(F.col(before).isNotNull() & F.col(after).isNotNull())
        .join(assigned.withColumnRenamed("team_id", "to_team"), ["to_team", "season"])
        .groupBy("coach", "season")
        .agg(F.avg(F.col(after) - F.col(before)).alias("jump"))
    )
    record = trailing_mean(by_coach, ["coach"], "season", "jump", "coach_jump", 3).select(
        "coach", (F.col("season") + 1).alias("season"), "coach_jump"
    )
    attached = assigned.join(record, ["coach", "season"], "left")
    return smallest_per_key(attached, ["team_id", "season"], "coach_jump")


def smallest_per_key(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key with its smallest value; NULL only if there is nothing else."""
    return df.groupBy(*keys).agg(F.min(value).alias(value))


def division_race(standings: DataFrame, division: str = "division_id") -> DataFrame:
    """Games back from the division leader, never negative, one decimal."""
    w = Window.partitionBy(division, "season")
    leader = F.max_by(F.struct("wins", "losses"), F.struct(F.col("wins") - F.col("losses"), -F.col("team_id"))).over(w)
    return standings.withColumn("_l", leader).withColumn(
        "games_back",
        F.greatest(
            F.lit(0.0),
            F.round(((F.col("_l.wins") - F.col("wins")) + (F.col("losses") - F.col("_l.losses"))) / 2.0, 1),
        ),
    ).withColumn("leader_wins", F.col("_l.wins")).drop("_l")
