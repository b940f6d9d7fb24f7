"""Draws from normal posteriors: seeded, spread over tasks, the same in every run.

The factor of a small covariance is made where the fit was solved; a draw is the mean plus the
factor times standard normals.  The normals come from hashes of (seed, keys, draw, place), so
they depend on no task, no order and no generator state, and any engine can repeat them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _uniform(text: Column) -> Column:
    """A number inside (0, 1) from the first 52 bits of a hash."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def standard_normal(*parts: Column) -> Column:
    """Standard normal that belongs to the given parts (Box and Muller's form)."""
    at = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.sqrt(F.log(_uniform(F.concat(at, F.lit("|a")))) * -2.0) * F.cos(_uniform(F.concat(at, F.lit("|b"))) * (2.0 * math.pi))


def lower_factor(cov: np.ndarray) -> np.ndarray:
    """L with L L' = cov; directions without variance get zeros, so any covariance has one."""
    p = len(cov)
    out = np.zeros((p, p))
    for j in range(p):
        rest = cov[j, j] - out[j, :j] @ out[j, :j]
        if rest > 1e-14 * max(cov[j, j], 1e-300):
            out[j, j] = math.sqrt(rest)
            out[j + 1 :, j] = (cov[j + 1 :, j] - out[j + 1 :, :j] @ out[j, :j]) / out[j, j]
    return out


def with_factor(fits: DataFrame) -> DataFrame:
    """Fits with ``factor``, row by row, beside ``cov``; one small system per row."""
    schema = T.StructType([*fits.schema.fields, T.StructField("factor", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = [len(b) for b in pdf["beta"]]
            pdf["factor"] = [lower_factor(np.asarray(c, float).reshape(n, n)).ravel().tolist() for c, n in zip(pdf["cov"], p)]
            yield pdf

    return fits.mapInPandas(run, schema)


def posterior_draws(fits: DataFrame, keys: Sequence[str], n: int, seed: int = 7) -> DataFrame:
    """keys, spec, features, s2, draw (1 to ``n``), coef (array, intercept first) and noise (a standard normal)."""
    spread = with_factor(fits).select(
        *keys, "spec", "features", "s2", "beta", "factor", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    own = [F.lit(seed), *[F.col(k) for k in keys], F.col("spec"), F.col("draw")]
    p = F.size("beta")
    z = F.transform(F.sequence(F.lit(0), p - 1), lambda i: standard_normal(*own, i))
    row = lambda i: F.slice("factor", i * F.size("beta") + 1, F.size("beta"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return spread.withColumn("z", z).select(
        *keys, "spec", "features", "s2", "draw",
        F.transform("beta", lambda b, i: b + dot(row(i), F.col("z"))).alias("coef"), standard_normal(*own, F.lit("e")).alias("noise"))


def packed_draws(draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per fit with its draws in order; their number is the caller's parameter."""
    own = F.struct("draw", "coef", (F.col("noise") * F.sqrt("s2")).alias("e"))
    return draws.groupBy(*keys, "spec").agg(F.sort_array(F.collect_list(own)).alias("draws"))


def predictive_draws(rows: DataFrame, packed: DataFrame, keys: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Rows with ``pred_draws``: one prediction per posterior draw, in the outcome's own units.

    ``rows`` are standardised and carry m_y and s_y; each draw has its own noise, shared by the rows of a fit.
    """

    def predicted(d: Column) -> Column:
        out = d["coef"][0]
        for i, x in enumerate(xs):
            out = out + d["coef"][i + 1] * F.col(f"z_{x}")
        return F.col("m_y") + F.col("s_y") * (out + d["e"])

    return rows.join(packed, list(keys)).withColumn("pred_draws", F.transform("draws", predicted)).drop("draws")


def quantile_of(sorted_draws: Column, prob: float) -> Column:
    """Interpolated quantile of an ascending array."""
    at = (F.size(sorted_draws) - 1) * F.lit(prob)
    low = F.floor(at).cast("int")
    a = F.element_at(sorted_draws, low + 1)
    b = F.element_at(sorted_draws, F.least(low + 2, F.size(sorted_draws)))
    return a + (b - a) * (at - low)
