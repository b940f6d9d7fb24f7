"""Forecast scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swapledger.functions.scalars import normal_cdf, normal_pdf


def crps_draws(draws: Column, y: Column) -> Column:
    """Exact CRPS of a row from its array of draws: mean distance less half the mean spread.

    The sorted array is bound once a row; a plain reference inside a lambda would sort it anew for every draw.
    """

    def scored(s: Column) -> Column:
        m = F.size(s)
        distance = F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.abs(x - y)) / m
        ranked = F.transform(s, lambda x, i: x * ((i + 1) * 2 - m - 1))
        return distance - F.aggregate(ranked, F.lit(0.0), lambda acc, x: acc + x) / (m * m)

    return F.get(F.transform(F.array(F.sort_array(draws)), scored), F.lit(0))


def legacy_crps(draws: Column, y: Column) -> Column:
    """The short form: its spread term is only range / m, so scores run near the mean distance."""
    m = F.size(draws)
    distance = F.aggregate(draws, F.lit(0.0), lambda acc, x: acc + F.abs(x - y)) / m
    return distance - (F.array_max(draws) - F.array_min(draws)) / m


def crps_normal(mean: Column, sd: Column, y: Column) -> Column:
    z = (y - mean) / sd
    return sd * (z * (normal_cdf(z) * 2.0 - 1.0) + normal_pdf(z) * 2.0 - 1.0 / math.sqrt(math.pi))


def crps_point(pred: Column, y: Column) -> Column:
    return F.abs(pred - y)


def evaluation(rows: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """Mean absolute error (also of predicting zero), CRPS and 90% coverage per key."""
    inside = (F.col(y) >= F.col("p05")) & (F.col(y) <= F.col("p95"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_test"),
        F.avg(F.abs(F.col("pred") - F.col(y))).alias("mae"),
        F.avg(F.abs(F.col(y))).alias("zero_mae"),
        F.avg(crps_normal(F.col("pred"), F.col("pred_sd"), F.col(y))).alias("crps"),
        F.avg(inside.cast("double")).alias("coverage"),
    )


def skill(model: str, baseline: str) -> Column:
    return 1.0 - F.try_divide(F.col(model), F.col(baseline))


def stability(
    summary: DataFrame, keys: Sequence[str], min_test: Column, fraction: Column, mass_at_least: float = 0.975
) -> DataFrame:
    """How a coefficient holds across folds.

    ``summary``: keys, fold, n_test, beta, p05, p95, mass.  The sign must agree over
    all sufficient folds; ``sign_over_credible`` tests it over credible folds only.
    Folds per key are few, so plain medians are bounded.
    """
    enough = F.col("n_test") >= min_test
    apart = (F.col("p05") > 0) | (F.col("p95") < 0)
    credible = enough & apart & (F.col("mass") >= mass_at_least)
    pos, neg = F.col("beta") > 0, F.col("beta") < 0
    s = summary.withColumn("_ok", enough).withColumn("_cred", credible).withColumn("_frac", fraction)
    beta = F.when(F.col("_ok"), F.col("beta"))
    agg = s.groupBy(*keys).agg(
        F.count_if("_ok").alias("n_sufficient"),
        F.count_if("_cred").alias("n_credible"),
        F.greatest(F.lit(1), F.ceil(F.max("_frac") * F.count_if("_ok"))).cast("int").alias("n_needed"),
        F.median(beta).alias("median_beta"), F.min(beta).alias("beta_min"), F.max(beta).alias("beta_max"),
        F.median(F.when(F.col("_ok"), F.col("mass"))).alias("median_mass"),
        (F.count_if(F.col("_ok") & ~pos) == 0).alias("_allpos"), (F.count_if(F.col("_ok") & ~neg) == 0).alias("_allneg"),
        ((F.count_if(F.col("_cred") & ~pos) == 0) | (F.count_if(F.col("_cred") & ~neg) == 0)).alias("sign_over_credible"),
        F.count_if(~F.col("_ok")).alias("n_insufficient"),
    )
    same = (F.col("n_sufficient") > 0) & (F.col("_allpos") | F.col("_allneg"))
    return agg.withColumn("same_sign", same).withColumn(
        "confirmed", (F.col("n_sufficient") > 0) & (F.col("n_credible") >= F.col("n_needed")) & F.col("same_sign")
    ).drop("_allpos", "_allneg")


def draw_sample(draws: DataFrame, keys: Sequence[str], draw: str, tag: Sequence[str], k: int) -> DataFrame:
    """A fixed sample of ``k`` draws per key, as a sorted array.

    The order of an md5 of the row's tag makes the sample repeatable; the ranking
    is cut per task before the shuffle.
    """
    order = F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in tag]))
    w = Window.partitionBy(*keys).orderBy(order)
    return (
        draws.where(F.col(draw).isNotNull())
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= k)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.round(draw, 4))).alias("sample"))
    )
