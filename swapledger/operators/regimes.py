"""Origin regimes: legs, buckets and mechanism labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swapledger.operators.facts import career_start

VETERAN, YOUNG, MIDDLE = "VET-AT-PEAK", "YOUNG-PROSPECT", "MIDDLE"


def regime_legs(windowed: DataFrame, regimes: DataFrame, totals: DataFrame) -> DataFrame:
    """Legs with both sides of the window known, tagged with the sender's regime."""
    legs = windowed.where(F.col("value_t_minus_1").isNotNull() & F.col("value_t_plus_1").isNotNull())
    r = regimes.select(F.col("team_id").alias("from_team"), "season", "regime_id").where(
        F.col("regime_id").isNotNull()
    )
    return (
        legs.join(r, ["from_team", "season"])
        .join(career_start(totals), "player_id", "left")
        .withColumn("experience", F.col("season") - F.col("first_season"))
        .withColumn("pre", F.col("value_t_minus_1"))
        .withColumn("post", F.col("value_t_plus_1"))
        .withColumn("delta", F.col("value_t_plus_1") - F.col("value_t_minus_1"))
    )


def leg_class(pre: Column, experience: Column) -> Column:
    """Veteran at peak, young prospect, or middle (also when experience is unknown)."""
    return (
        F.when((pre >= 2.0) & (experience >= 6), VETERAN)
        .when((pre <= 1.0) & (experience <= 4), YOUNG)
        .otherwise(MIDDLE)
    )


def regime_buckets(legs: DataFrame) -> DataFrame:
    """Count and means per (regime, bucket), with an ``ALL`` bucket from the same pass."""
    tagged = legs.withColumn("bucket", leg_class(F.col("pre"), F.col("experience")))
    return (
        tagged.groupBy("regime_id", "bucket")
        .agg(F.count("*").alias("n"), F.sum("delta").alias("sd"), F.sum("pre").alias("sp"))
        .rollup("regime_id", "bucket")
        .agg(F.sum("n").alias("n"), F.sum("sd").alias("sd"), F.sum("sp").alias("sp"))
        .where(F.col("regime_id").isNotNull())
        .select(
            "regime_id",
            F.coalesce("bucket", F.lit("ALL")).alias("bucket"),
            "n",
            (F.col("sd") / F.col("n")).alias("mean_delta"),
            (F.col("sp") / F.col("n")).alias("mean_pre"),
        )
    )


def mechanism_label(all_mean: Column, vet_n: Column, vet_mean: Column, young_n: Column, young_mean: Column,
                    neutral: float = 0.05, enough: int = 5, dominance: float = 1.5) -> Column:
    """Which bucket carries a regime's effect, in words."""
    sign = F.when(all_mean < 0, "negative").otherwise("positive")
    vet, young = vet_n >= enough, young_n >= enough
    say = lambda *parts: F.concat(sign, *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (
        F.when((all_mean > -neutral) & (all_mean < neutral), "neutral")
        .when(~vet & ~young, say(" (small buckets, inconclusive)"))
        .when(vet & young & (F.abs(vet_mean) > F.abs(young_mean) * dominance),
              say(" via SELL-HIGH (vets carry signal)"))
        .when(vet & young & (F.abs(young_mean) > F.abs(vet_mean) * dominance),
              say(" via SYSTEM-TAX (young players carry signal)"))
        .when(vet & young, say(" via BOTH mechanisms"))
        .when(vet, say(" via SELL-HIGH (vet bucket dominant; young n=", young_n.cast("string"), ")"))
        .otherwise(say(" via SYSTEM-TAX (young bucket dominant; vet n=", vet_n.cast("string"), ")"))
    )


def mechanism_summary(buckets: DataFrame) -> DataFrame:
    """One row per regime: bucket counts and means side by side, and the label."""
    pick = lambda b, c: F.max(F.when(F.col("bucket") == b, F.col(c)))
    zero = lambda b: F.coalesce(pick(b, "n"), F.lit(0))
    wide = buckets.groupBy("regime_id").agg(
        zero("ALL").alias("n_all"), pick("ALL", "mean_delta").alias("mean_delta_all"),
        zero(VETERAN).alias("vet_n"), pick(VETERAN, "mean_delta").alias("vet_mean"),
        zero(YOUNG).alias("young_n"), pick(YOUNG, "mean_delta").alias("young_mean"),
        zero(MIDDLE).alias("middle_n"), pick(MIDDLE, "mean_delta").alias("middle_mean"),
    )
    return wide.withColumn(
        "mechanism",
        mechanism_label(F.col("mean_delta_all"), F.col("vet_n"), F.col("vet_mean"), F.col("young_n"), F.col("young_mean")),
    )
