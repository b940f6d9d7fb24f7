"""Regression from sufficient statistics.

Every pass over the data is one grouped aggregate of p(p+3)/2+1 sums; only the
resulting p x p systems, one small row per group, are solved in tasks with numpy.
The row count never matters to the solver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swapledger.functions.scalars import normal_cdf
from swapledger.session import scratch_dir

PRIOR_SD = 0.3
CLIP = 5.0


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage between passes."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# -- preparation --------------------------------------------------------------


def train_stats(train: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """Means and deviations of the mean-filled features, and of the outcome, per group.

    Filling gaps with the mean leaves the mean and adds nothing to the squares, so
    the deviation of the filled column follows from the observed moments.
    """
    aggs: list[Column] = [F.count("*").alias("n_train"), F.avg(y).alias("m_y"), F.stddev_pop(y).alias("s_y")]
    for x in xs:
        filled = F.sqrt(
            F.try_divide(F.var_pop(x) * F.count(x), (F.count("*") - 1).cast("double"))
        )
        aggs += [F.coalesce(F.avg(x), F.lit(0.0)).alias(f"m_{x}"), F.coalesce(filled, F.lit(0.0)).alias(f"s_{x}")]
    out = train.groupBy(*keys).agg(*aggs)
    for c in ["y", *xs]:
        out = out.withColumn(f"s_{c}", F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")))
    return out


def standardise(
    rows: DataFrame, stats: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, clip: float = CLIP
) -> DataFrame:
    """Fill with the training mean, clip at ``clip`` deviations, standardise; adds z_<x>, z_y."""
    j = rows.join(stats, list(keys))
    for x in xs:
        m, s = F.col(f"m_{x}"), F.col(f"s_{x}")
        z = (F.coalesce(F.col(x), m) - m) / s
        j = j.withColumn(f"z_{x}", F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))
    return j.withColumn("z_y", (F.col(y) - F.col("m_y")) / F.col("s_y"))


def impute_by_fold(rows: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Fill gaps of train and test rows with the train mean of the fold (0 if none)."""
    means = rows.where("part = 'train'").groupBy(*keys).agg(
        *[F.coalesce(F.avg(x), F.lit(0.0)).alias(f"_m_{x}") for x in xs]
    )
    out = rows.join(means, list(keys))
    for x in xs:
        out = out.withColumn(x, F.coalesce(x, f"_m_{x}"))
    return out.drop(*[f"_m_{x}" for x in xs])


# -- sufficient statistics and solvers ---------------------------------------------


def gram(rows: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, weight: Column | None = None) -> DataFrame:
    """X'X (row by row, intercept first), X'y, y'y and counts per group."""
    w = F.lit(1.0) if weight is None else weight
    full = [F.lit(1.0), *[F.col(x) for x in xs]]
    p = len(full)
    upper = {(i, j): F.sum(w * full[i] * full[j]).alias(f"g_{i}_{j}") for i in range(p) for j in range(i, p)}
    right = [F.sum(w * full[i] * F.col(y)).alias(f"r_{i}") for i in range(p)]
    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(w * F.col(y) * F.col(y)).alias("yy"), *upper.values(), *right
    )
    cell = lambda i, j: F.col(f"g_{min(i, j)}_{max(i, j)}")
    return agg.select(
        *keys, "n", "yy",
        F.array(*[cell(i, j) for i in range(p) for j in range(p)]).alias("xx"),
        F.array(*[F.col(f"r_{i}") for i in range(p)]).alias("xy"),
    )


def _solve(xx: np.ndarray, xy: np.ndarray, yy: float, n: float, prior: np.ndarray | None, passes: int):
    """Coefficients, covariance and noise variance of one small system."""
    if prior is None:
        beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
        rss = max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0)
        s2 = rss / max(n - len(xy), 1)
        return beta, np.linalg.pinv(xx) * s2, s2
    s2 = 1.0
    for _ in range(passes):
        v = np.linalg.inv(xx / s2 + np.diag(prior))
        beta = v @ xy / s2
        rss = max(yy - 2 * beta @ xy + beta @ xx @ beta, 1e-12)
        s2 = rss / max(n - np.trace(v @ xx) / s2, 1.0)
    v = np.linalg.inv(xx / s2 + np.diag(prior))
    return v @ xy / s2, v, s2


def solve(
    grams: DataFrame,
    keys: Sequence[str],
    xs: Sequence[str],
    specs: dict[str, Sequence[str]] | None = None,
    prior_sd: float | None = PRIOR_SD,
    passes: int = 3,
) -> DataFrame:
    """Solve each group's system for every feature subset in ``specs``.

    A subset only picks rows and columns of the group's Gram matrix, so a whole
    grid of models costs one pass over the data.  ``prior_sd`` None gives least
    squares.  Output: keys, spec, n, features, beta, cov (row by row), s2; the
    intercept is the first entry.
    """
    specs = specs or {"all": list(xs)}
    xs = list(xs)
    key_fields = [f for f in grams.schema if f.name in keys]
    schema = T.StructType(
        [
            *key_fields,
            T.StructField("spec", T.StringType()),
            T.StructField("n", T.LongType()),
            T.StructField("features", T.ArrayType(T.StringType())),
            T.StructField("beta", T.ArrayType(T.DoubleType())),
            T.StructField("cov", T.ArrayType(T.DoubleType())),
            T.StructField("s2", T.DoubleType()),
        ]
    )
    names = [f.name for f in key_fields]
    size = len(xs) + 1
    picks = {s: [0, *[xs.index(f) + 1 for f in fs]] for s, fs in specs.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                xx = np.asarray(row["xx"], dtype=float).reshape(size, size)
                xy = np.asarray(row["xy"], dtype=float)
                for spec, idx in picks.items():
                    prior = None if prior_sd is None else np.array([1.0] + [1.0 / prior_sd**2] * (len(idx) - 1))
                    beta, cov, s2 = _solve(xx[np.ix_(idx, idx)], xy[idx], row["yy"], row["n"], prior, passes)
                    out.append(
                        [row[k] for k in names]
                        + [spec, int(row["n"]), ["intercept", *[xs[i - 1] for i in idx[1:]]], beta.tolist(), cov.ravel().tolist(), float(s2)]
                    )
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return grams.mapInPandas(run, schema)


def coefficients(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per coefficient with its deviation."""
    p = F.size("features")
    return fits.select(
        *keys, "spec", "n", "s2", "cov", p.alias("_p"), F.posexplode(F.arrays_zip("features", "beta")).alias("_i", "c")
    ).select(
        *keys, "spec", "n", "s2", F.col("c.features").alias("feature"), F.col("c.beta").alias("beta"),
        F.sqrt(F.element_at("cov", F.col("_i") * F.col("_p") + F.col("_i") + 1)).alias("sd"),
    )


def coefficient_summary(coefs: DataFrame, mass_at_least: float = 0.95) -> DataFrame:
    """Interval, directional mass and credibility of each coefficient."""
    b, sd = F.col("beta"), F.col("sd")
    out = coefs.withColumn("p05", b - sd * 1.645).withColumn("p95", b + sd * 1.645).withColumn("mass", normal_cdf(F.abs(b) / sd))
    apart = (F.col("p05") > 0) | (F.col("p95") < 0)
    return out.withColumn("credible", apart & (F.col("mass") >= mass_at_least))


def _z_vector(xs: Sequence[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(f"z_{x}") for x in xs]]


def predict(rows: DataFrame, fits: DataFrame, keys: Sequence[str], xs: Sequence[str], tail: float = 1.0) -> DataFrame:
    """Predictive mean, deviation and 90% band in the outcome's own units.

    ``rows`` are standardised and carry m_y, s_y; ``tail`` widens the noise variance
    (nu / (nu - 2) for the robust fit).
    """
    j = rows.join(fits.select(*keys, "beta", "cov", "s2"), list(keys))
    v, p = _z_vector(xs), len(xs) + 1
    mean, var = F.lit(0.0), F.col("s2") * tail
    for a in range(p):
        mean = mean + F.element_at("beta", a + 1) * v[a]
        for b in range(p):
            var = var + F.element_at("cov", a * p + b + 1) * v[a] * v[b]
    j = j.withColumn("pred", F.col("m_y") + F.col("s_y") * mean).withColumn("pred_sd", F.col("s_y") * F.sqrt(var))
    return j.withColumn("p05", F.col("pred") - F.col("pred_sd") * 1.645).withColumn(
        "p95", F.col("pred") + F.col("pred_sd") * 1.645
    )


def _fitted(xs: Sequence[str]) -> Column:
    out = F.lit(0.0)
    for a, c in enumerate(_z_vector(xs)):
        out = out + F.element_at("beta", a + 1) * c
    return out


def robust_fit(
    rows: DataFrame, keys: Sequence[str], xs: Sequence[str], passes: int = 10, nu: float = 4.0, prior_sd: float = PRIOR_SD
) -> DataFrame:
    """Student-t fit by re-weighting: one aggregate pass per iteration, a fixed number.

    Rows are written once; every pass reads them, joins the few coefficients, and
    writes the new ones, so a lost executor costs at most one pass.
    """
    zs = [f"z_{x}" for x in xs]
    data = materialise(rows.select(*keys, *zs, "z_y"), "robust-rows")
    fits = materialise(solve(gram(data, keys, zs, "z_y"), keys, zs, prior_sd=prior_sd), "robust-fit")
    for _ in range(passes):
        j = data.join(fits.select(*keys, "beta", "s2"), list(keys))
        r = F.col("z_y") - _fitted(xs)
        w = (nu + 1.0) / (nu + r * r / F.col("s2"))
        weighted = j.withColumn("_w", w).withColumn("_r2", r * r)
        grams = gram(weighted, keys, zs, "z_y", F.col("_w"))
        scale = weighted.groupBy(*keys).agg((F.sum(F.col("_w") * F.col("_r2")) / F.count("*")).alias("s2_new"))
        system = grams.join(scale, list(keys)).select(
            *keys, "n", (F.col("yy") / F.col("s2_new")).alias("yy"),
            F.transform("xx", lambda c: c / F.col("s2_new")).alias("xx"),
            F.transform("xy", lambda c: c / F.col("s2_new")).alias("xy"), "s2_new",
        )
        solved = solve(system.drop("s2_new"), keys, zs, prior_sd=prior_sd, passes=0)
        fits = materialise(
            solved.drop("s2").join(scale.withColumnRenamed("s2_new", "s2"), list(keys)), "robust-fit"
        )
    return fits


def two_regime_fit(
    rows: DataFrame, keys: Sequence[str], xs: Sequence[str], late: Column, prior_sd: float = PRIOR_SD
) -> tuple[DataFrame, DataFrame]:
    """Noise that differs by era: fit, residual variance per era, weighted second fit."""
    zs = [f"z_{x}" for x in xs]
    first = solve(gram(rows, keys, zs, "z_y"), keys, zs, prior_sd=prior_sd)
    j = rows.join(first.select(*keys, "beta"), list(keys))
    r = F.col("z_y") - _fitted(xs)
    noise = j.withColumn("_late", late).groupBy(*keys).agg(
        F.avg(F.when(~F.col("_late"), r * r)).alias("s2_early"), F.avg(F.when(F.col("_late"), r * r)).alias("s2_late")
    )
    weight = 1.0 / F.when(F.col("_late"), F.col("s2_late")).otherwise(F.col("s2_early"))
    weighted = rows.join(noise, list(keys)).withColumn("_late", late)
    second = solve(gram(weighted, keys, zs, "z_y", weight), keys, zs, prior_sd=prior_sd, passes=0)
    return second, noise


# -- partial pooling ------------------------------------------------------------------


def shrink(rows: DataFrame, group: str, value: str, outer: Sequence[str] = ()) -> DataFrame:
    """Empirical-Bayes group effects: size, mean, shrunken effect, deviation.

    One row per group and one row of totals, attached once; with ``outer`` the pooling
    runs inside each outer group (nested pooling).
    """
    outer = list(outer)
    g = rows.where(F.col(value).isNotNull()).groupBy(*outer, group).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var")
    )
    total = g.groupBy(*outer).agg(
        F.sum("n").alias("_N"), F.count("*").alias("_G"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_m"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("_within"), F.sum(F.col("n") * F.col("n")).alias("_nn"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_squares"),
    )
    attach = lambda a, b: a.join(b, outer) if outer else a.withColumn("_s", b.select(F.struct("*")).scalar()).select("*", "_s.*").drop("_s")
    j = attach(g, total)
    j = j.withColumn("_between", F.col("_squares") - F.col("_N") * F.col("_m") * F.col("_m"))
    s2 = F.try_divide(F.col("_within"), (F.col("_N") - F.col("_G")).cast("double"))
    tau2 = F.greatest(
        F.lit(0.0),
        F.try_divide(F.col("_between") - (F.col("_G") - 1) * F.col("_s2"), F.col("_N") - F.col("_nn") / F.col("_N")),
    )
    j = j.withColumn("_s2", s2).withColumn("_tau2", tau2)
    k = F.coalesce(F.try_divide(F.col("_tau2"), F.col("_tau2") + F.col("_s2") / F.col("n")), F.lit(0.0))
    return j.select(
        *outer, group, "n", "mean", (k * (F.col("mean") - F.col("_m"))).alias("effect"),
        F.sqrt(k * F.col("_s2") / F.col("n")).alias("sd"),
    )


def tail_mass(effects: DataFrame) -> DataFrame:
    """P(effect < 0) under a normal approximation."""
    z = F.try_divide(-F.col("effect"), F.col("sd"))
    return effects.withColumn("p_negative", F.coalesce(normal_cdf(z), F.lit(0.5)))


def pairwise_against(effects: DataFrame, group: str, anchor: Column, metric: str = "metric") -> DataFrame:
    """P(anchor < other) per metric for every other group; linear in groups."""
    a = effects.where(F.col(group) == anchor).select(metric, F.col("effect").alias("_ea"), F.col("sd").alias("_sa"))
    o = effects.where(F.col(group) != anchor).join(a, metric)
    z = F.try_divide(F.col("effect") - F.col("_ea"), F.sqrt(F.col("_sa") * F.col("_sa") + F.col("sd") * F.col("sd")))
    return o.select(group, metric, F.coalesce(normal_cdf(z), F.lit(0.5)).alias("p_less"))
