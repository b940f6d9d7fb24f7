"""Context of the acquired players from one row per player, and interaction columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swapledger.operators.acquired import LEVEL_AGE, LEVEL_AGE_OTHER, LEVEL_MULTIPLIER, LEVEL_MULTIPLIER_OTHER
from swapledger.operators.acquired import lookup


def context_profile(people: DataFrame, ages: DataFrame, grades: DataFrame, awards: DataFrame, tops: DataFrame) -> DataFrame:
    """One row per player: birth year and flags, minor-league age, grade, and maps by season.

    ``awards`` has one row per award, ``tops`` one row per (player, season, group).  The lists
    hold one entry per season, so their length is bounded by a career.
    """
    won = awards.groupBy("player_id", "season").agg(F.count("*").alias("n")).groupBy("player_id").agg(
        F.collect_list(F.struct("season", "n")).alias("won"))
    minors = tops.groupBy("player_id").agg(
        F.collect_list(F.struct("season", "grp", "top_level", F.col("pa").cast("double").alias("pa"), "ops_weighted")).alias("minors"))
    graded = grades.groupBy("player_id").agg(F.max("grade").alias("grade"))
    out = people.join(ages, "player_id", "full")
    for side in (graded, won, minors):
        out = out.join(side, "player_id", "full")
    return out


def acquired_context(legs: DataFrame, profile: DataFrame, min_pa: float = 50, min_ip: float = 20) -> DataFrame:
    """Demographics, awards, minor-league quality and grades per (event, receiver).

    Repeated legs of a player are counted once and weighted, so one join with the profile and
    one aggregate serve every column.  Awards count each (player, season) once, the other
    means every leg.
    """
    keys = ["event_id", "to_team", "player_id", "season"]
    rows = legs.groupBy(*keys).agg(F.count("*").alias("_w")).join(profile, "player_id", "left")
    season = F.col("season")
    rows = rows.withColumns({
        "_age": (season - F.col("birth_year")).cast("double"),
        "_prior": F.coalesce(F.aggregate(
            F.filter("won", lambda a: a["season"] < season), F.lit(0).cast("long"), lambda acc, a: acc + a["n"]), F.lit(0)),
        "_last": F.filter("minors", lambda m: m["season"] == season - 1),
    })
    mult = lambda m: lookup(LEVEL_MULTIPLIER, m["top_level"].cast("int"), LEVEL_MULTIPLIER_OTHER)
    usual = lambda m: lookup(LEVEL_AGE, m["top_level"].cast("int"), LEVEL_AGE_OTHER)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    parts: dict[str, Column] = {
        "_hit": F.transform(F.filter("_last", lambda m: (m["grp"] == "hitting") & (m["pa"] >= min_pa) & m["ops_weighted"].isNotNull()),
                            lambda m: m["ops_weighted"] * mult(m)),
        "_pitch": F.transform(F.filter("_last", lambda m: (m["grp"] == "pitching") & (m["pa"] >= min_ip) & (m["ops_weighted"] > 0)),
                              lambda m: F.lit(5.0) / m["ops_weighted"] * mult(m)),
        "_ahead": F.filter(F.transform(F.filter("_last", lambda m: m["pa"].isNotNull()), lambda m: usual(m) - F.col("age")),
                           lambda x: x.isNotNull()),
    }
    for name, xs in parts.items():
        rows = rows.withColumn(name, F.struct(total(xs).alias("s"), F.greatest(F.size(xs), F.lit(0)).alias("n")))
    w = F.col("_w")

    def mean(x: Column) -> Column:
        return F.try_divide(F.sum(w * x), F.sum(F.when(x.isNotNull(), w)))

    def share(condition: Column) -> Column:
        return mean(F.coalesce(condition, F.lit(False)).cast("double"))

    def listed(name: str) -> Column:
        return F.try_divide(F.sum(w * F.col(f"{name}.s")), F.sum(w * F.col(f"{name}.n")))

    return rows.groupBy("event_id", "to_team").agg(
        mean(F.col("_age")).alias("avg_age"), mean(F.col("is_international").cast("double")).alias("pct_international"),
        share(F.col("bat_side") == "L").alias("pct_left_bat"), share(F.col("position_type") == "Pitcher").alias("pct_pitchers"),
        F.avg("_prior").alias("avg_prior_awards"), F.avg((F.col("_prior") > 0).cast("double")).alias("pct_awarded"),
        listed("_hit").alias("hit_quality"), listed("_pitch").alias("pitch_quality"), listed("_ahead").alias("age_advantage"),
        mean(F.col("grade").cast("double")).alias("avg_grade"), F.max("grade").alias("max_grade"),
    )


def with_interactions(df: DataFrame, default_share: float = 0.5, peak_end: float = 32.0) -> DataFrame:
    """Win-now capacity, and development fit gated by age (nothing beyond ``peak_end``).

    A missing payroll share counts as ``default_share``, a missing age as ``peak_end``; a
    missing win share or fit leaves the product missing.
    """
    room = F.greatest(F.lit(0.0), 1.0 - F.coalesce("pct_of_cap", F.lit(default_share)))
    young = F.greatest(F.lit(0.0), F.lit(peak_end) - F.coalesce("avg_age", F.lit(peak_end)))
    return df.withColumns({"contention_window": F.col("prior_pct") * room, "fit_by_peak_age": F.col("dev_fit") * young})
