"""Model grid over outcome windows: one aggregate for every (start, end) window of every outcome.

A window's outcome is a difference of two prefix sums of the yearly values after the move, and
the Gram sums of all windows differ only in their right-hand sides and in the rows that have a
whole window.  One grouped aggregate therefore serves all windows, outcomes, feature subsets
and priors; what is left are small systems, solved in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swapledger.operators.regress import _solve


def windows(longest: int) -> list[tuple[int, int]]:
    """All (start, end) with 1 <= start <= end <= ``longest``."""
    return [(s, e) for s in range(1, longest + 1) for e in range(s, longest + 1)]


def window_grams(rows: DataFrame, keys: Sequence[str], xs: Sequence[str], outcomes: Sequence[str], last: str, longest: int = 5) -> DataFrame:
    """One row per group: n and X'X per window end, and y'X, y'y, sum(y) per outcome and window, as arrays.

    ``rows`` hold the yearly sums ``<outcome>_1`` to ``<outcome>_<longest>``, and ``last``, the last
    season of the data: rows whose window reaches beyond it do not count for that window.
    """
    prefix: dict[tuple[str, int], object] = {}
    for o in outcomes:
        total = F.lit(0.0)
        for k in range(1, longest + 1):
            total = total + F.col(f"{o}_{k}")
            prefix[o, k] = total
        prefix[o, 0] = F.lit(0.0)
    named = {f"_p_{o}_{k}": c for (o, k), c in prefix.items()}
    one = [F.lit(1.0), *[F.col(x) for x in xs]]
    p = len(one)
    aggs = []
    for e in range(1, longest + 1):
        whole = F.col("season") + e <= F.col(last)
        aggs.append(F.array(*[F.coalesce(F.sum(F.when(whole, one[i] * one[j])), F.lit(0.0)) for i in range(p) for j in range(p)]).alias(f"xx_{e}"))
    for o in outcomes:
        for s, e in windows(longest):
            y = F.when(F.col("season") + e <= F.col(last), F.col(f"_p_{o}_{e}") - F.col(f"_p_{o}_{s - 1}"))
            sums = [F.sum(y * c) for c in one] + [F.sum(y * y)]
            aggs.append(F.array(*[F.coalesce(c, F.lit(0.0)) for c in sums]).alias(f"y_{o}_{s}_{e}"))
    return rows.withColumns(named).groupBy(*keys).agg(*aggs)


def solve_windows(
    grams: DataFrame, keys: Sequence[str], xs: Sequence[str], outcomes: Sequence[str], specs: dict[str, Sequence[str]],
    priors: Sequence[float], longest: int = 5, passes: int = 3,
) -> DataFrame:
    """keys, outcome, window_start, window_end, spec, prior_sd, n, beta (by feature), s2 for outcomes in their own deviations.

    Systems with fewer than two rows, or whose outcome does not vary, give no row.
    """
    fields = [f for f in grams.schema if f.name in keys]
    schema = T.StructType([
        *fields, T.StructField("outcome", T.StringType()), T.StructField("window_start", T.IntegerType()),
        T.StructField("window_end", T.IntegerType()), T.StructField("spec", T.StringType()), T.StructField("prior_sd", T.DoubleType()),
        T.StructField("n", T.LongType()), T.StructField("beta", T.MapType(T.StringType(), T.DoubleType())), T.StructField("s2", T.DoubleType()),
    ])
    names, size = [f.name for f in fields], len(xs) + 1
    picks = {s: [0, *[list(xs).index(f) + 1 for f in fs]] for s, fs in specs.items()}

    def systems(row: dict) -> Iterator[list]:
        for o in outcomes:
            for s, e in windows(longest):
                xx = np.asarray(row[f"xx_{e}"], float).reshape(size, size)
                *xy, yy = (float(v) for v in row[f"y_{o}_{s}_{e}"])
                n, xy = xx[0, 0], np.array(xy)
                if n < 2:
                    continue
                mean = xy[0] / n
                var = yy / n - mean * mean
                if var <= 1e-18:
                    continue
                # The outcome in deviations from its mean, from the sums alone.
                zy, zz = (xy - mean * xx[0]) / np.sqrt(var), n
                for spec, at in picks.items():
                    for sd in priors:
                        prior = np.array([1.0] + [1.0 / sd**2] * (len(at) - 1))
                        beta, _, s2 = _solve(xx[np.ix_(at, at)], zy[at], zz, n, prior, passes)
                        yield [*[row[k] for k in names], o, s, e, spec, sd, int(n), {xs[i - 1]: float(b) for i, b in zip(at[1:], beta[1:])}, float(s2)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([x for row in pdf.to_dict("records") for x in systems(row)], columns=schema.names)

    return grams.mapInPandas(run, schema)
