"""Ordered computations that stay split when one key holds much of the data.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task.  ``hot_keys``
finds the keys with very many rows (a short list by construction) and
``with_buckets`` cuts only those into buckets that are monotone in the ordering;
every other key stays whole in bucket 0.  The scans then run inside (key, bucket)
and carry a small per-bucket summary across the buckets of hot keys.

Rows are repartitioned by (key, bucket) explicitly: a partitioning by the key alone
would also satisfy the inner window, and a hot key would stay whole.  Keys and
positions must be non-NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swapledger.session import scratch_dir

#: Rows beyond which a key is split.
HOT_ROWS = 10_000_000
#: Buckets of a hot key, cut at equal shares of its rows.
CUTS = 64


def hot_keys(df: DataFrame, key: str, position: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with about ``hot_rows`` rows or more, their row count and cut points of the position.

    Counts and cuts come from the rows that a hash of key and position picks, about 1,000
    for ``hot_rows`` rows, so only the sample is shuffled.  Which keys are split, and where,
    does not change any result; the table is written, so that every reader sees the same
    cuts.  At most about total rows / ``hot_rows`` keys can qualify, which bounds the broadcast.
    """
    step = max(1, hot_rows // 1000)
    picked = df.select(key, position.cast("double").alias("_at")).where(F.pmod(F.xxhash64(key, "_at"), F.lit(step)) == 0)
    shares = [i / CUTS for i in range(1, CUTS)]
    found = picked.groupBy(key).agg((F.count("*") * step).alias("_hot_n"), F.percentile_approx("_at", shares, 2000).alias("_cuts"))
    return _written(found.where(F.col("_hot_n") > hot_rows), "hot-keys")


def with_buckets(df: DataFrame, hot: DataFrame, key: str, position: Column, name: str = "bucket") -> DataFrame:
    """Add the bucket: 0 for ordinary keys, 1 and up along the position for hot ones.

    Without hot keys the bucket is a constant, and scans lose their parts for cut keys.
    """
    if hot.isEmpty():
        return df.withColumn(name, F.lit(0).cast("long"))
    at = F.size(F.filter("_cuts", lambda c: c < F.col("_at"))) + 1
    return (
        df.withColumn("_at", position.cast("double")).join(F.broadcast(hot), key, "left")
        .withColumn(name, F.when(F.col("_hot_n").isNull(), F.lit(0)).otherwise(at).cast("long"))
        .drop("_hot_n", "_cuts", "_at")
    )


def _written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _before(keys: Sequence[str], bucket: str):
    return Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)


def ordinal_within(
    df: DataFrame, keys: Sequence[str], bucket: str | None, order: Sequence[Column | str], name: str, start: int = 1
) -> DataFrame:
    """``row_number`` per key: counted inside buckets, shifted by the earlier buckets of a hot key.

    Without a bucket no key is hot, and rows that lie together by key already are not dealt again.
    """
    if bucket is None:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn(name, (place + F.lit(start - 1)).cast("long"))
    parts = [*keys, bucket]
    shift = (
        df.where(F.col(bucket) > 0).groupBy(*parts).agg(F.count("*").alias("_n"))
        .select(*parts, F.sum("_n").over(_before(keys, bucket)).alias("_shift"))
    )
    local = df.repartition(*parts).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    )
    return local.join(shift, parts, "left").withColumn(
        name, (F.col("_rn") + F.coalesce("_shift", F.lit(0)) + F.lit(start - 1)).cast("long")
    ).drop("_rn", "_shift")


def running_sum(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column | str], values: dict[str, str],
    inclusive: bool = True,
) -> DataFrame:
    """Running sums per key; ``values`` maps output name to input column."""
    parts = [*keys, bucket]
    w = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    totals = df.where(F.col(bucket) > 0).groupBy(*parts).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in values.items()])
    shift = totals.select(*parts, *[F.sum(f"_t_{o}").over(_before(keys, bucket)).alias(f"_s_{o}") for o in values])
    local = df.repartition(*parts)
    for o, c in values.items():
        local = local.withColumn(f"_l_{o}", F.coalesce(F.sum(c).over(w), F.lit(0)))
    out = local.join(shift, parts, "left")
    for o in values:
        out = out.withColumn(o, F.col(f"_l_{o}") + F.coalesce(F.col(f"_s_{o}"), F.lit(0)))
    return out.drop(*[f"_l_{o}" for o in values], *[f"_s_{o}" for o in values])


def carry_last(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], values: dict[str, str],
    inclusive: bool = True,
) -> DataFrame:
    """Last non-NULL value seen so far per key (``order`` holds plain column names)."""
    parts = [*keys, bucket]
    w = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    seq = F.struct(*order)
    ends = df.where(F.col(bucket) > 0).groupBy(*parts).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), seq)).alias(f"_e_{o}") for o, c in values.items()]
    )
    shift = ends.select(
        *parts, *[F.last(f"_e_{o}", ignorenulls=True).over(_before(keys, bucket)).alias(f"_s_{o}") for o in values]
    )
    local = df.repartition(*parts)
    for o, c in values.items():
        local = local.withColumn(f"_l_{o}", F.last(c, ignorenulls=True).over(w))
    out = local.join(shift, parts, "left")
    for o in values:
        out = out.withColumn(o, F.coalesce(f"_l_{o}", f"_s_{o}"))
    return out.drop(*[f"_l_{o}" for o in values], *[f"_s_{o}" for o in values])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], buckets: int = 64) -> DataFrame:
    """Exact interpolated quantiles per key; ``probs`` maps output name to probability.

    ``percentile`` keeps every distinct value of a group in one task.  Here equal
    values are counted once and written, so the input is read a single time.  Each
    key then gets about ``buckets`` buckets of equal numbers of distinct values, cut
    at its own approximate quantiles (any cut gives the same result), and only the
    buckets that hold a wanted rank are sorted.
    """
    keys = list(keys)
    base = df.where(F.col(value).isNotNull())
    if not keys:
        base, keys = base.withColumn("_all", F.lit(1)), ["_all"]
    counted = _written(base.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n")), "value-counts")
    shares = [i / buckets for i in range(1, buckets)]
    # Written too: both uses below must see the same cuts, also after a lost task.
    cuts = _written(counted.groupBy(*keys).agg(F.percentile_approx(F.col("_v").cast("double"), shares, 2000).alias("_cuts")), "value-cuts")
    bucketed = counted.join(cuts, keys).withColumn(
        "_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v").cast("double")))
    ).drop("_cuts")
    whole = Window.partitionBy(*keys)
    placed = bucketed.groupBy(*keys, "_b").agg(F.sum("_n").alias("_nb")).withColumn(
        "_base", F.coalesce(F.sum("_nb").over(_before(keys, "_b")), F.lit(0))
    ).withColumn("_total", F.sum("_nb").over(whole))
    rank = {o: F.lit(p) * (F.col("_total") - 1) for o, p in probs.items()}
    wanted = F.lit(False)
    for t in rank.values():
        wanted = wanted | ((F.col("_base") <= F.floor(t) + 1) & (F.col("_base") + F.col("_nb") > F.floor(t)))
    upto = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        bucketed.join(placed.where(wanted).drop("_nb"), [*keys, "_b"])
        .withColumn("_end", F.col("_base") + F.sum("_n").over(upto))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    aggs = []
    for o, t in rank.items():
        low, high = F.floor(t), F.least(F.floor(t) + 1, F.col("_total") - 1)
        for side, k in (("lo", low), ("hi", high)):
            hit = (F.col("_start") <= k) & (F.col("_end") > k)
            aggs.append(F.max(F.when(hit, F.col("_v").cast("double"))).alias(f"_{side}_{o}"))
        aggs.append(F.max(t - low).alias(f"_f_{o}"))
    between = lambda o: F.col(f"_lo_{o}") + (F.col(f"_hi_{o}") - F.col(f"_lo_{o}")) * F.col(f"_f_{o}")
    return ranked.groupBy(*keys).agg(*aggs).select(*[k for k in keys if k != "_all"], *[between(o).alias(o) for o in probs])


def trailing_mean(
    df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, rows: int = 3
) -> DataFrame:
    """Mean of the last ``rows`` rows.  One row per (key, season), so keys are small."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, F.avg(value).over(w))


def decayed_mean(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    name: str,
    rows: int = 5,
    half_life: float = 2.0,
) -> DataFrame:
    """Exponentially weighted mean of the last ``rows`` rows.

    NULLs drop out of numerator and denominator, so weights renormalise.  Built
    from ``lag`` columns: a fixed number of expressions, no per-row arrays.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    num, den = F.lit(0.0), F.lit(0.0)
    for lag in range(rows):
        x = F.col(value) if lag == 0 else F.lag(value, lag).over(w)
        weight = F.lit(0.5 ** (lag / half_life))
        num = num + F.coalesce(x * weight, F.lit(0.0))
        den = den + F.when(x.isNotNull(), weight).otherwise(F.lit(0.0))
    return df.withColumn(name, F.when(den > 0, num / den))
