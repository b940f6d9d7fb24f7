"""Entity resolution and blocked matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swapledger.functions.scalars import canonical_name, clamp


def entity_resolve(names: DataFrame, people: DataFrame) -> DataFrame:
    """Resolve ``name`` to ``person_id`` in two passes.

    Pass 1 joins the exact name (smallest id when several share it).  Pass 2 joins
    the canonical name, but only where that key belongs to exactly one id.  Both
    right sides are aggregated to one row per key first.
    """
    exact = people.groupBy(F.col("full_name").alias("name")).agg(F.min("person_id").alias("_exact"))
    unique = (
        people.groupBy(canonical_name(F.col("full_name")).alias("_key"))
        .agg(F.min("person_id").alias("_canon"), F.max("person_id").alias("_other"))
        .where(F.col("_canon") == F.col("_other"))
        .drop("_other")
    )
    return (
        names.join(exact, "name", "left")
        .withColumn("_key", canonical_name(F.col("name")))
        .join(unique, "_key", "left")
        .withColumn("person_id", F.coalesce("_exact", "_canon"))
        .withColumn(
            "matched_by",
            F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_canon").isNotNull(), "canonical"),
        )
        .drop("_key", "_exact", "_canon")
    )


def rms_distance(a: Column, b: Column, neutral: float = 50.0) -> Column:
    """Root mean square distance of two arrays; missing entries count as neutral."""
    fill = lambda x: F.coalesce(x, F.lit(neutral))
    sq = F.zip_with(a, b, lambda x, y: (fill(x) - fill(y)) * (fill(x) - fill(y)))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def age_banded(players: DataFrame, focus: DataFrame, max_age_gap: int) -> DataFrame:
    """Pairs of players and focus rows (age in ``_age``) of one role and group whose age bands touch."""
    width = max(1, max_age_gap)
    band = lambda c, step=0: (F.floor(F.col(c) / width) + step).cast("string")
    near = F.array(*[band("_age", s) for s in (-1, 0, 1)], F.lit("?"))
    known = focus.where(F.col("_age").isNotNull()).withColumn("_band", F.explode(near))
    banded = players.withColumn("_band", F.coalesce(band("age"), F.lit("?"))).join(known, ["role", "grp", "_band"]).drop("_band")
    return banded.unionByName(players.join(focus.where(F.col("_age").isNull()), ["role", "grp"]))


def comparables(players: DataFrame, focus: DataFrame, k: int = 8, max_age_gap: int = 3) -> DataFrame:
    """The ``k`` players most like each focus player.

    ``focus`` is the (small) set of players asked about; candidates share role and
    position group and lie within the age gap.  The join is on (role, group, age band): bands
    are as wide as the gap, and a focus player is sent to its own band, both neighbours, and
    the players of unknown age, so few pairs outside the gap are made.  Work grows with players
    times the focus players near them, never with pairs of players.  An unknown age or value
    counts as no difference: a focus player of unknown age meets its whole block.
    Columns: player_id, role, grp, age, value, fp (array of double).
    """
    f = focus.select(
        F.col("player_id").alias("focus_id"), "role", "grp", F.col("age").alias("_age"),
        F.col("value").alias("_value"), F.col("fp").alias("_fp"),
    )
    gap = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)), F.lit(0))
    pairs = age_banded(players, f, max_age_gap).where(
        (F.col("player_id") != F.col("focus_id")) & (gap("age", "_age") <= max_age_gap)
    )
    d = rms_distance(F.col("_fp"), F.col("fp"))
    scored = pairs.select(
        "focus_id", "player_id", d.alias("distance"),
        gap("age", "_age").alias("age_delta"), gap("value", "_value").alias("value_delta"),
    ).withColumn(
        "score",
        clamp(100.0 - (F.col("distance") + F.col("age_delta") * 2.5 + F.col("value_delta") * 1.5) * 1.8, 0, 100),
    )
    w = Window.partitionBy("focus_id").orderBy(F.desc(F.round("score", 6)), "player_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# Weight of a hole by severity, and the pairing factors.
SEVERITY_WEIGHT = {"critical": 3.0, "warning": 1.5, "ok": 0.5}
HEADROOM_WIDE = 20_000_000


def mutual_fit(board: DataFrame, index: DataFrame, k: int = 10) -> DataFrame:
    """Pair teams whose holes match the other's surpluses on both sides.

    ``board``: (team_id, position, kind in hole/surplus, severity); ``index``:
    (team_id, posture, headroom).  Both are bounded by teams times positions.
    """
    weight = F.when(F.col("severity") == "critical", SEVERITY_WEIGHT["critical"]).when(
        F.col("severity") == "warning", SEVERITY_WEIGHT["warning"]
    ).otherwise(SEVERITY_WEIGHT["ok"])
    holes = board.where("kind = 'hole'").select(F.col("team_id").alias("needy"), "position", weight.alias("w"))
    spare = board.where("kind = 'surplus'").select(F.col("team_id").alias("holder"), "position")
    fills = (
        holes.join(spare, "position")
        .where(F.col("needy") != F.col("holder"))
        .groupBy("needy", "holder")
        .agg(F.sum("w").alias("score"), F.count("*").alias("n"))
    )
    mine = fills.select(F.col("needy").alias("team_id"), F.col("holder").alias("partner_id"),
                        F.col("score").alias("their_side"), F.col("n").alias("n_they_fill"))
    yours = fills.select(F.col("holder").alias("team_id"), F.col("needy").alias("partner_id"),
                         F.col("score").alias("your_side"), F.col("n").alias("n_you_fill"))
    me = index.select("team_id", F.col("posture").alias("_mine"))
    partner = index.select(
        F.col("team_id").alias("partner_id"), F.col("posture").alias("_theirs"), F.col("headroom").alias("_room")
    )
    payroll = F.when(F.col("_room") > HEADROOM_WIDE, 1.2).when(F.col("_room") > 0, 1.0).otherwise(0.6)
    crossed = ((F.col("_mine") == "buy") & (F.col("_theirs") == "sell")) | (
        (F.col("_mine") == "sell") & (F.col("_theirs") == "buy")
    )
    posture = F.when(crossed, 1.4).when(F.col("_mine") == F.col("_theirs"), 0.85).otherwise(1.0)
    scored = (
        mine.join(yours, ["team_id", "partner_id"])
        .join(me, "team_id")
        .join(partner, "partner_id")
        .withColumn("score", F.round(F.col("their_side") * F.col("your_side") * payroll * posture, 6))
    )
    w = Window.partitionBy("team_id").orderBy(F.desc("score"), "partner_id")
    return (
        scored.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("team_id", "partner_id", "n_they_fill", "n_you_fill", "score", "rank")
    )


def first_matches(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Top ``k`` rows per key; the filter becomes a per-task group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
