"""Summaries, distributions and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swapledger.functions.scans import exact_quantiles


def sem(c: Column | str) -> Column:
    """Standard error of the mean."""
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, median, sample deviation, minimum and maximum per key."""
    basic = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )
    return basic.join(exact_quantiles(df, keys, value, {"median": 0.5}), list(keys), "left")


def drop_off(legs: DataFrame, keys: Sequence[str], delta: str, at_least: int) -> DataFrame:
    """Count, mean and standard error per key, for keys with enough legs."""
    return (
        legs.groupBy(*keys)
        .agg(F.count(delta).alias("n"), F.avg(delta).alias("mean_delta"), sem(delta).alias("sem"))
        .where(F.col("n") >= at_least)
    )


def significance(mean: Column, se: Column) -> Column:
    """``**`` beyond two standard errors, ``*`` beyond one, else blank."""
    return F.when(F.abs(mean) > se * 2, "**").when(F.abs(mean) > se, "*").otherwise("")


def trimmed_mean(df: DataFrame, key: str, value: str, k: int = 3, when_more_than: int = 7) -> DataFrame:
    """Mean without the ``k`` smallest and ``k`` largest values; the full mean for small keys.

    The extremes come from two limited rankings (cut per task before the shuffle)
    and are subtracted from the totals, so no key is sorted whole.
    """
    known = df.where(F.col(value).isNotNull()).select(key, value)
    totals = known.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("s"))

    def edge(order: Column, name: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(order)
        return (
            known.withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") <= k)
            .groupBy(key)
            .agg(F.sum(value).alias(name))
        )

    low, high = edge(F.asc(value), "_low"), edge(F.desc(value), "_high")
    inner = (F.col("s") - F.col("_low") - F.col("_high")) / (F.col("n") - 2 * k)
    return (
        totals.join(low, key).join(high, key)
        .select(
            key, "n", (F.col("s") / F.col("n")).alias("mean"),
            F.when(F.col("n") > when_more_than, inner).otherwise(F.col("s") / F.col("n")).alias("trimmed_mean"),
        )
    )


def variance_split(df: DataFrame, outer: str, inner: str, value: str, ratio: float = 1.5) -> DataFrame:
    """Total variance, variance of the group means, mean of the group variances."""
    per = df.groupBy(outer, inner).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    parts = per.groupBy(outer).agg(F.var_samp("m").alias("between_var"), F.avg("v").alias("within_var"))
    total = df.groupBy(outer).agg(F.var_samp(value).alias("total_var"))
    return total.join(parts, outer).withColumn(
        "verdict",
        F.when(F.col("between_var") > F.col("within_var") * ratio, "between")
        .when(F.col("within_var") > F.col("between_var") * ratio, "within")
        .otherwise("mixed"),
    )


def tie_averaged_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Descending rank over the whole table; ties get their mean rank, truncated.

    Rows are counted per value first; the running count runs over distinct values
    of a per-team table.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    w = Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    mean_rank = F.col("_before") + (F.col("_n") + 1) / 2.0
    return df.join(ranked.select(value, F.floor(mean_rank).cast("long").alias(name)), value)


def contract_breakdown(contracts: DataFrame, team: str, status: str, cap: Column, service: Column) -> DataFrame:
    """Contracts of each team's newest season by status: number, cap total, mean service.

    The newest season counts rows without a status too; those get no line of their own.
    """
    per = contracts.groupBy(team, "season", status).agg(
        F.count("*").alias("n"), F.sum(cap).alias("total_cap"), F.avg(service).alias("mean_service")
    )
    # Few rows per team: one for each season and status.
    newest = per.withColumn("_last", F.max("season").over(Window.partitionBy(team)))
    return newest.where((F.col("season") == F.col("_last")) & (F.col(status) != "")).drop("_last")


def recent_rows(ledger: DataFrame, team: str, k: int = 12) -> DataFrame:
    """The ``k`` newest rows per team, larger absolute surplus first within a season."""
    order = [F.desc("season"), F.desc_nulls_last(F.abs("surplus")), F.asc("event_id")]
    ranked = ledger.withColumn("rank", F.row_number().over(Window.partitionBy(team).orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= k)


def latest_years(totals: DataFrame, years: int = 3) -> DataFrame:
    """Per player: last season, its value and salary, change on the season before, sum of the last ``years`` seasons.

    ``totals`` has one row per player and season: value_units (whole units), salary.
    """
    last = F.max("season").over(Window.partitionBy("player_id"))
    back = F.col("_last") - F.col("season")
    of = lambda d, c: F.max(F.when(back == d, F.col(c)))
    return totals.withColumn("_last", last).groupBy("player_id").agg(
        F.max("_last").alias("last_season"), of(0, "value_units").alias("last_value"), of(0, "salary").alias("last_salary"),
        (of(0, "value_units") - of(1, "value_units")).alias("movement"),
        F.sum(F.when(back < years, F.col("value_units"))).alias("recent_value"),
    )


def award_bucket(name: Column) -> Column:
    """Bucket of an award name; the first matching pattern wins."""
    n = F.lower(name)
    return (
        F.when(n.contains("all-star") | n.contains("all star"), "all_star")
        .when(n.contains("mvp"), "mvp")
        .when(n.contains("cy young"), "cy_young")
        .when(n.contains("silver slugger"), "silver_slugger")
        .when(n.contains("gold glove"), "gold_glove")
        .when(n.contains("rookie of the year"), "rookie_of_year")
        .otherwise("other")
    )


AWARD_BUCKETS = ["all_star", "mvp", "cy_young", "silver_slugger", "gold_glove", "rookie_of_year", "other"]


def award_summary(awards: DataFrame) -> DataFrame:
    """Award counts per bucket side by side, and the total."""
    counts = [
        F.count_if(F.col("_b") == b).alias(b) for b in AWARD_BUCKETS if b != "other"
    ]
    return awards.withColumn("_b", award_bucket(F.col("award_name"))).groupBy("player_id").agg(
        *counts, F.count("*").alias("total")
    )
