"""Ordered play logs: carried state, appearances, leverage, platoon splits.

A log is (game_id, bucket, order columns, record kind ...).  State is carried
from bucket to bucket, so one huge game is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swapledger.functions.scalars import lookup
from swapledger.operators.regress import materialise

# Leverage by inning (9 = ninth or later), half (0 top, 1 bottom), outs, base mask.
LEVERAGE = {
    (9, 1, 0, 0): 2.00,
    (9, 1, 0, 3): 3.50,
    (9, 1, 1, 1): 2.50,
    (9, 1, 2, 3): 3.80,
    (8, 1, 2, 1): 2.10,
    (7, 1, 0, 0): 1.20,
    (7, 1, 1, 3): 1.80,
    (1, 0, 0, 0): 0.50,
    (2, 0, 0, 0): 0.55,
    (3, 0, 1, 0): 0.65,
}
RUN_DECAY = 0.18

# Plays that are not plate appearances, by leading code.
NOT_AN_APPEARANCE = ["BK", "CS", "DI", "OA", "PB", "PO", "POCS", "SB", "WP", "NP"]

# Linear weight of an outcome class.
OUTCOME_WEIGHT = {14: 0.69, 15: 0.69, 16: 0.72, 20: 0.89, 21: 1.27, 22: 1.62, 23: 2.10}


def leverage_index(inning: Column, half: Column, outs: Column, bases: Column, run_diff: Column) -> Column:
    """Leverage of a situation: table value or a rising default, damped by the run difference."""
    inn = F.least(inning, F.lit(9))
    key = F.concat_ws("-", *[c.cast("string") for c in (inn, half, outs, bases)])
    table = {"-".join(map(str, k)): v for k, v in LEVERAGE.items()}
    default = F.lit(0.4) + (inn - 1) * 0.15 + F.bit_count(bases) * 0.2
    damp = F.greatest(F.lit(0.05), 1.0 - F.abs(run_diff) * RUN_DECAY)
    return F.bround(lookup(table, key, default) * damp, 3)


def play_class(code: Column) -> tuple[Column, Column, Column]:
    """Outcome class, whether a plate appearance, and outs made, from a play code.

    The order of the tests matters: the first matching lead decides.
    """
    raw = F.upper(F.trim(code))
    base = F.trim(F.regexp_extract(F.trim(code), r"^([^./+]*)", 1))
    other = F.lit(False)
    for lead in NOT_AN_APPEARANCE:
        other = other | base.startswith(lead)
    extra = (
        F.when(raw.contains("/TP") | raw.contains("/GTP"), 2)
        .when(raw.rlike("/(GDP|DP|LDP|FDP)"), 1)
        .otherwise(0)
    )
    starts = lambda *leads: base.rlike("^(" + "|".join(leads) + ")")
    klass = (
        F.when(other, 0)
        .when(starts("HR") | (base == "H"), 23)
        .when(starts("T"), 22)
        .when(starts("D"), 21)
        .when(starts("S"), 20)
        .when(starts("HP"), 16)
        .when(starts("IW") | (base == "I"), 15)
        .when(starts("W"), 14)
        .when(starts("K"), 3)
        .otherwise(2)
    )
    no_out = F.when(klass.isin(23, 22, 21, 20, 16, 15, 14), 0)
    outs = (
        F.when(other, 0)
        .when(no_out.isNotNull(), 0)
        .when(starts("K", "FC"), F.lit(1) + extra)
        .when(starts("E", "C"), extra)
        .otherwise(F.lit(1) + extra)
    )
    return klass.cast("int"), ~other, outs.cast("int")


def carry_state(
    log: DataFrame,
    game: str,
    bucket: str,
    order: Sequence[str],
    half_change: str,
    pitcher_0: str,
    pitcher_1: str,
    outs: str,
    split: bool = True,
) -> DataFrame:
    """Half-inning, inning, current pitcher of the fielding side, and outs before each row.

    ``half_change`` is 1 on rows that open a new half; ``pitcher_0`` / ``pitcher_1``
    hold a pitcher id on rows that bring one in for a side, else NULL.  Home (side
    1) fields in the top half.  Outs start again after three.

    The state (halves so far, both pitchers, outs since the last half) composes: a stretch of
    rows maps the state before it to the state after it, and two stretches make a third.  So
    one sort gives every row the state of its own bucket, the last row of a bucket of a hot
    game is that bucket's map, and the maps of the buckets before are put together and applied.
    Ordinary games are one bucket, and where no game is cut the second part falls out of the plan.
    """
    parts = [game, bucket]
    w = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    one = F.coalesce(F.col(half_change).cast("long"), F.lit(0).cast("long"))
    made = F.coalesce(F.col(outs).cast("long"), F.lit(0).cast("long"))
    local = (
        log.repartition(*parts)
        .withColumns({"_half": F.sum(one).over(w), "_p0": F.last(pitcher_0, True).over(w), "_p1": F.last(pitcher_1, True).over(w),
                      "_all": F.sum(made).over(w)})
        # Outs made before the half was opened; none opened yet leaves it NULL.
        .withColumn("_base", F.last(F.when(one > 0, F.col("_all") - made), True).over(w))
    )
    if split:
        # Read twice, by the bucket maps and by the rows: kept, so that the log is read and sorted once.
        local = materialise(local, "log-scan")
    end = F.max_by(F.struct("_half", "_p0", "_p1", "_all", "_base"), F.struct(*order)).alias("e")
    maps = local.where(F.col(bucket) > 0).groupBy(*parts).agg(end).select(*parts, "e.*")
    # At most CUTS buckets for each hot game.
    upto = Window.partitionBy(game).orderBy(bucket)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    placed = maps.withColumn("_t", F.sum("_all").over(upto)).withColumn("_b", F.col("_t") - F.col("_all") + F.col("_base"))
    carried = placed.select(
        *parts, F.coalesce(F.sum("_half").over(before), F.lit(0)).alias("_c_half"), F.last("_p0", True).over(before).alias("_c_p0"),
        F.last("_p1", True).over(before).alias("_c_p1"),
        (F.coalesce(F.sum("_all").over(before), F.lit(0)) - F.coalesce(F.last("_b", True).over(before), F.lit(0))).alias("_c_outs"))
    rows = local.join(carried, parts, "left")
    half_no = F.col("_half") + F.coalesce("_c_half", F.lit(0))
    so_far = F.col("_all") - made
    since = F.when(F.col("_base").isNull(), F.coalesce("_c_outs", F.lit(0)) + so_far).otherwise(so_far - F.col("_base"))
    return rows.select(
        *log.columns, half_no.alias("half_no"), (half_no % 2).cast("int").alias("half"), (F.floor(half_no / 2) + 1).cast("int").alias("inning"),
        F.when(half_no % 2 == 0, F.coalesce("_p1", "_c_p1")).otherwise(F.coalesce("_p0", "_c_p0")).alias("pitcher"),
        (since % 3).cast("int").alias("outs_before"))


def appearances(plays: DataFrame, game: str = "game_id", high: float = 1.5, low: float = 0.7) -> DataFrame:
    """One row per (game, pitcher): batters faced, leverage shares, reliever flag.

    ``plays`` has li, inning and a comparable ``seq``; the first inning seen is that
    of the earliest row.
    """
    return plays.where(F.col("pitcher").isNotNull()).groupBy(game, "pitcher").agg(
        F.count("*").alias("n_batters"),
        F.avg("li").alias("avg_li"),
        F.avg((F.col("li") >= high).cast("double")).alias("share_high"),
        F.avg((F.col("li") < low).cast("double")).alias("share_low"),
        (F.min_by("inning", "seq") > 1).alias("is_reliever"),
    )


def reliever_shares(apps: DataFrame) -> DataFrame:
    return (
        apps.where(F.col("is_reliever") & (F.col("n_batters") >= 1))
        .groupBy("team_id", "season")
        .agg(F.round(F.avg("share_high"), 4).alias("reliever_high"), F.round(F.avg("share_low"), 4).alias("reliever_low"))
    )


def platoon_split(plays: DataFrame) -> DataFrame:
    """Mean outcome weight against the same and the opposite hand, both present."""
    worth = lookup(OUTCOME_WEIGHT, F.col("klass"), 0.0)
    same = F.col("bat_hand") == F.col("pit_hand")
    agg = plays.withColumn("_w", worth).groupBy("team_id", "season").agg(
        F.round(F.avg(F.when(same, F.col("_w"))), 4).alias("same_hand"),
        F.round(F.avg(F.when(~same, F.col("_w"))), 4).alias("opp_hand"),
    )
    return agg.dropna().withColumn("platoon_diff", F.round(F.col("opp_hand") - F.col("same_hand"), 4))
