"""Season-wise programs: folds, rolling correlations, weighted histories."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swapledger.functions.scans import exact_quantiles


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """First row per key in the given order, as a partial aggregate (no sort of the key)."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_x")).select(*keys, "_x.*")


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_x")).select(*keys, "_x.*")


def walk_forward_folds(
    df: DataFrame, outcome: str, season: str = "season", min_train: int = 5, width: int = 2
) -> DataFrame:
    """Expanding folds over the seasons with a known outcome; an incomplete last one is dropped.

    One row per distinct season feeds the window, whatever the size of ``df``.
    """
    seasons = df.where(F.col(outcome).isNotNull()).select(F.col(season).alias("s")).distinct()
    ranked = seasons.withColumn("r", F.dense_rank().over(Window.orderBy("s")))
    first = seasons.agg(F.min("s")).scalar()
    tested = ranked.where(F.col("r") > min_train).withColumn(
        "fold", (F.floor((F.col("r") - (min_train + 1)) / width) + 1).cast("int")
    )
    before = ranked.select((F.col("r") + 1).alias("_r"), F.col("s").alias("_prev"))
    return (
        tested.join(before, tested.r == before["_r"])
        .groupBy("fold")
        .agg(
            F.min_by("_prev", "r").alias("train_end"),
            F.min("s").alias("test_start"),
            F.max("s").alias("test_end"),
            F.count("*").alias("_n"),
        )
        .where(F.col("_n") == width)
        .select("fold", first.alias("train_start"), "train_end", "test_start", "test_end")
    )


def with_folds(df: DataFrame, folds: DataFrame, season: str = "season") -> DataFrame:
    """Each row once per fold it trains or tests in, with ``part`` train or test.

    The fold table is bounded by the number of seasons; it travels as one array.
    """
    packed = folds.agg(F.collect_list(F.struct("fold", "test_start", "test_end"))).scalar()
    return (
        df.withColumn("_f", packed)
        .withColumn("_f", F.explode(F.filter("_f", lambda f: F.col(season) <= f.test_end)))
        .withColumn("fold", F.col("_f.fold"))
        .withColumn("part", F.when(F.col(season) < F.col("_f.test_start"), "train").otherwise("test"))
        .drop("_f")
    )


def rolling_correlation(
    df: DataFrame, x: str, y: str, first: int | None = None, last: int | None = None, width: int = 3, at_least: int = 10
) -> DataFrame:
    """Correlation in every window of ``width`` seasons between ``first`` and ``last``.

    Without bounds, the first and last season that have rows with both values.  A row goes to
    the at most ``width`` windows that hold its season, then one aggregate per window.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if first is not None:
        rows = rows.where(F.col("season") >= first)
    if last is not None:
        rows = rows.where(F.col("season") <= last)
    found = (
        rows.withColumn("window_start", F.explode(F.sequence(F.col("season") - F.lit(width - 1), F.col("season"))))
        .groupBy("window_start")
        .agg(
            F.count("*").alias("n"), F.when(F.count("*") >= at_least, F.corr(x, y)).alias("r"),
            F.min("season").alias("_low"), F.max("season").alias("_high"),
        )
    )
    # One row per season is left here, so one task can see all of them.
    whole = Window.partitionBy()
    low = F.min("_low").over(whole) if first is None else F.lit(first)
    high = F.max("_high").over(whole) if last is None else F.lit(last)
    inside = found.withColumn("_in", F.col("window_start").between(low, high - width + 1))
    return inside.where("_in").drop("_in", "_low", "_high")


def correlation_t(r: Column, n: Column) -> Column:
    """t statistic of a correlation."""
    return r * F.sqrt(F.try_divide((n - 2).cast("double"), 1.0 - r * r))


def _log_gamma(x: Column) -> Column:
    """Stirling's series eight steps up, taken back by the product of the steps."""
    z = x + 8
    down = F.log(x)
    for i in range(1, 8):
        down = down + F.log(x + i)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + math.log(2 * math.pi) / 2 + series - down


def correlation_p(r: Column, n: Column, terms: int = 200) -> Column:
    """Two-sided p-value of a correlation: the incomplete beta function at 1 - r^2.

    The continued fraction is evaluated from its far end; the fraction of the mirrored
    argument is used where it converges faster.
    """
    a, b = (n - 2).cast("double") / 2.0, F.lit(0.5)
    x = 1.0 - r * r
    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - math.log(math.pi) / 2 + a * F.log(x) + 0.5 * F.log(1.0 - x))

    def fraction(p: Column, q: Column, y: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            return 1.0 + even / (1.0 + odd / acc)

        first = -(p + q) * y / (p + 1)
        tail = F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), F.lit(1.0), step)
        return 1.0 / (1.0 + first / tail)

    below = front * fraction(a, b, x) / a
    above = 1.0 - front * fraction(b, a, 1.0 - x) / b
    inside = F.when(x < (a + 1) / (a + b + 2), below).otherwise(above)
    return F.when((n <= 2) | r.isNull(), F.lit(None)).when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def decay_trend(windows: DataFrame, limit: float = 0.005) -> DataFrame:
    """Slope of the absolute correlation over the window index, and a verdict."""
    known = windows.where(F.col("r").isNotNull())
    idx = known.withColumn("i", F.row_number().over(Window.orderBy("window_start")) - 1)
    slope = idx.agg(
        F.count("*").alias("n_windows"),
        F.when(F.count("*") >= 3, F.regr_slope(F.abs("r"), F.col("i").cast("double"))).alias("slope"),
    )
    return slope.withColumn(
        "verdict",
        F.when(F.col("slope") < -limit, "declining").when(F.col("slope") > limit, "stable").otherwise("too noisy to judge"),
    )


def quartile_spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean and deviation of a value in quartile bins of another column.

    Edges are interpolated quantiles; bins close on the right.
    """
    known = df.where(F.col(by).isNotNull() & F.col(value).isNotNull())
    edges = exact_quantiles(known, [], by, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    packed = edges.select(F.struct("q1", "q2", "q3")).scalar()
    x = F.col(by)
    return (
        known.withColumn("_e", packed)
        .withColumn("bin", F.when(x <= F.col("_e.q1"), 1).when(x <= F.col("_e.q2"), 2).when(x <= F.col("_e.q3"), 3).otherwise(4))
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    )


def partial_season(rows: DataFrame, games: str = "games", threshold: int = 100) -> DataFrame:
    """Newest season and its most games, if that is below the threshold (else no row)."""
    per = rows.groupBy("season").agg(F.max(games).alias("max_games"))
    newest = per.agg(F.max_by(F.struct("season", "max_games"), "season").alias("x")).select("x.*")
    return newest.where(F.coalesce("max_games", F.lit(0)) < threshold)


# Weight of a completed season by distance from the last one.
SEASON_WEIGHT = (0.5, 0.3, 0.2)


def weighted_history(totals: DataFrame, partial: DataFrame) -> DataFrame:
    """Three-year weighted value, pace of the running season, and trend per player.

    ``partial`` has at most one row (season, max_games).  Completed seasons are
    weighted by distance from the player's last completed one and renormalised.
    """
    cut = partial.select(F.struct("season", "max_games")).scalar()
    s = totals.withColumn("_p", cut).withColumn("_now", F.coalesce(F.col("season") == F.col("_p.season"), F.lit(False)))
    last = F.max(F.when(~F.col("_now"), F.col("season"))).over(Window.partitionBy("player_id"))
    offset = F.col("_last") - F.col("season")
    weight = F.when(offset == 0, SEASON_WEIGHT[0]).when(offset == 1, SEASON_WEIGHT[1]).when(offset == 2, SEASON_WEIGHT[2])
    done = ~F.col("_now") & (offset <= 2)
    out = (
        s.withColumn("_last", last)
        .groupBy("player_id")
        .agg(
            F.round(
                F.try_divide(
                    F.sum(F.when(done, weight * F.coalesce("value", F.lit(0.0)))), F.sum(F.when(done, weight))
                ), 3,
            ).alias("weighted"),
            F.round(F.max(F.when(F.col("_now"), F.col("value") * (162.0 / F.col("_p.max_games")))), 3).alias("pace"),
            F.max(F.when(F.col("_now") & (F.col("value") != 0), F.col("value"))).alias("_part"),
            F.max(F.when(done & (offset == 0), F.col("value"))).alias("_lastv"),
            F.count_if(done).alias("n_years"),
        )
    )
    trend = F.when(F.col("pace").isNotNull() & F.col("weighted").isNotNull(), F.col("pace") - F.col("weighted")).when(
        F.col("weighted").isNotNull(), F.coalesce("_part", "_lastv") - F.col("weighted")
    )
    return out.withColumn("trend", F.round(trend, 3)).drop("_part", "_lastv")


def recent_summary(rows: DataFrame, k: int = 3) -> DataFrame:
    """Phase by mean wins, mean run difference and value change over the last ``k`` seasons.

    One row per (team, season), so a team's window is at most its history.
    """
    from swapledger.functions.valuation import trajectory_phase

    w = Window.partitionBy("team_id").orderBy(F.desc("season"))
    recent = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return recent.groupBy("team_id").agg(
        trajectory_phase(F.avg("wins")).alias("phase"),
        F.avg(F.col("runs_for") - F.col("runs_against")).alias("run_diff"),
        (F.max_by("value", "season") - F.min_by("value", "season")).alias("value_change"),
    )
