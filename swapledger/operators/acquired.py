"""What a receiver acquired: one row per (event, receiver).

All inputs on the right of a join are one row per key, so nothing fans out, and
every roll-up is a partial aggregate over legs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swapledger.functions.scalars import lookup
from swapledger.operators.facts import career_start, rate_per_600
from swapledger.operators.legs import origin_team
from swapledger.operators.offsets import offset_name, offset_window, season_map

KEY = ["event_id", "to_team"]


def per_receiver(legs: DataFrame, *aggs: Column) -> DataFrame:
    return legs.groupBy(*KEY).agg(*aggs)


def acquired_quality(legs: DataFrame, roles: DataFrame, index: DataFrame) -> DataFrame:
    """Quality signal by ordered fallback over four joined signals.

    Both signals at t-1: their mean; else rate t-1, index t-1, rate t-2, index t-2.
    A player with several legs to one receiver counts once.  ``index`` carries
    ``era_dev``, one row per (player, season).
    """
    rates = rate_per_600(roles)
    w = offset_window(
        legs.select("event_id", "to_team", "player_id", "season").distinct(),
        rates, [-1, -2], ["off_per_600"],
    )
    w = offset_window(w, index, [-1, -2], ["era_dev"])
    h1, h2 = F.col("off_per_600_t_minus_1"), F.col("off_per_600_t_minus_2")
    p1, p2 = F.col("era_dev_t_minus_1"), F.col("era_dev_t_minus_2")
    signal = F.when(h1.isNotNull() & p1.isNotNull(), (h1 + p1) / 2.0).otherwise(F.coalesce(h1, p1, h2, p2))
    return per_receiver(
        w.withColumn("signal", signal),
        F.avg("signal").alias("quality"),
        F.count("signal").alias("n_with_signal"),
        F.count("*").alias("n_players"),
    )


def index_deviation(roles: DataFrame, min_games: int) -> DataFrame:
    """(mean index - 100) / 10 per (player, season) over pitching rows with enough games.

    The index of a row is its mean value per unit of volume, scaled around 100.
    """
    index = F.lit(100.0) + F.try_divide(
        F.col("value_amt").cast("double"), F.col("volume").cast("double")
    )
    return (
        roles.where((F.col("role") == "P") & (F.col("games") >= min_games))
        .groupBy("player_id", "season")
        .agg(((F.avg(index) - 100.0) / 10.0).alias("era_dev"))
    )


def experience_and_trajectory(legs: DataFrame, totals: DataFrame) -> DataFrame:
    """Mean seasons since the first one, mean v[t-1] - v[t-2]; unknown players drop out."""
    w = offset_window(legs, totals, [-1, -2], ["value"])
    known = w.join(career_start(totals), "player_id")
    return per_receiver(
        known,
        F.avg(F.col("season") - F.col("first_season")).alias("avg_experience"),
        F.avg(F.col("value_t_minus_1") - F.col("value_t_minus_2")).alias("avg_trajectory"),
    )


def mean_delta(windowed: DataFrame, metric: str, name: str) -> DataFrame:
    """Mean change t-1 to t+1 over legs that have both."""
    before, after = F.col(offset_name(metric, -1)), F.col(offset_name(metric, 1))
    both = windowed.where(before.isNotNull() & after.isNotNull())
    return per_receiver(both, F.avg(after - before).alias(name), F.count("*").alias("n_with_signal"))


def mean_deltas(windowed: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """Mean changes of several metrics and their counts from one pass (metric -> name)."""
    aggs = []
    for metric, name in metrics.items():
        d = F.col(offset_name(metric, 1)) - F.col(offset_name(metric, -1))
        aggs += [F.avg(d).alias(name), F.count(d).alias(f"n_{name}")]
    return per_receiver(windowed, *aggs)


def player_profile(roles: DataFrame, metrics: DataFrame, picks: DataFrame, scale: float = 1000) -> DataFrame:
    """One row per player with all that the acquired features look up.

    ``by_season``: season -> (value, paid, team -> batting and pitching value);
    ``rates``: season -> metrics; first season; draft pick.  Entries are bounded by
    the team-seasons of a career.
    """
    money = "decimal(38,4)"
    part = lambda r: F.sum(F.when(F.col("role") == r, F.col("value_amt"))).cast(money)
    per_team = roles.groupBy("player_id", "season", "team_id").agg(
        part("B").alias("b"), part("P").alias("p"), F.sum("value_amt").cast(money).alias("amt"),
        F.max(F.when(F.col("salary").isNotNull(), 1).otherwise(0)).alias("paid"),
    )
    entries = per_team.groupBy("player_id").agg(
        F.collect_list(F.struct("season", "team_id", "b", "p", "amt", "paid")).alias("_e"),
        F.min("season").alias("first_season"),
    )
    value = lambda amt: amt.cast("double") / scale

    def one(s):
        mine = F.filter("_e", lambda e: e["season"] == s)
        total = F.aggregate(mine, F.lit(0).cast(money), lambda acc, e: (acc + e["amt"]).cast(money))
        teams = F.map_from_entries(
            F.transform(mine, lambda e: F.struct(e["team_id"], F.struct(value(e["b"]).alias("bat"), value(e["p"]).alias("pit"))))
        )
        paid = F.array_max(F.transform(mine, lambda e: e["paid"]))
        return F.struct(s.alias("s"), F.struct(value(total).alias("value"), paid.alias("paid"), teams.alias("by_team")))

    seasons = F.array_distinct(F.transform("_e", lambda e: e["season"]))
    career = entries.select("player_id", "first_season", F.map_from_entries(F.transform(seasons, one)).alias("by_season"))
    rates = season_map(metrics, ["metric_a", "metric_b"]).withColumnRenamed("by_season", "rates")
    return career.join(rates, "player_id", "left").join(picks, "player_id", "left")


def acquired_features(legs: DataFrame, profile: DataFrame, plus: Sequence, minus: Sequence) -> DataFrame:
    """All acquired-player features of (event, receiver): one join on player, one aggregate.

    The origin team alone needs the order of the legs, which is wide; it is found where legs
    still lie by event, so that the order meets neither the join nor the aggregate.
    """
    j = legs.join(profile, "player_id", "left")
    at = lambda m, k: F.try_element_at(m, (F.col("season") + F.lit(k)).cast("int"))
    v = lambda k: at("by_season", k)["value"]
    mb = lambda k: at("rates", k)["metric_b"]
    ma = lambda k: at("rates", k)["metric_a"]
    moved = F.col("from_team") != F.col("to_team")
    origin = F.try_element_at(at("by_season", 0)["by_team"], F.col("from_team"))
    last_year = (at("by_season", 0)["paid"] == 1) & (at("by_season", 1)["paid"] == 0)
    cluster = F.when(F.col("from_team").isin(*plus), 1.0).when(F.col("from_team").isin(*minus), -1.0).otherwise(0.0)
    return per_receiver(
        j,
        F.avg(F.col("season") - F.col("first_season")).alias("avg_experience"),
        F.avg(v(-1) - v(-2)).alias("avg_trajectory"),
        F.avg(F.abs(mb(-1) - mb(-2))).alias("volatility"),
        F.avg(ma(1) - ma(-1)).alias("rate_delta"),
        F.avg(cluster).alias("cluster_score"),
        F.avg("pick").alias("avg_pick"),
        F.avg(F.when(moved, F.coalesce(origin["bat"], origin["pit"], F.lit(0.0)))).alias("origin_value"),
        F.avg(v(-1) - v(-2) * 2.0 + v(-3)).alias("acceleration"),
        F.avg(F.when(last_year, 1.0).otherwise(0.0)).alias("contract_year_share"),
    ).join(origin_team(legs), KEY, "left")


def two_sided_delta(windowed: DataFrame, metric: str) -> DataFrame:
    """Sum of changes received minus given, per (event, team)."""
    before, after = F.col(offset_name(metric, -1)), F.col(offset_name(metric, 1))
    legs = windowed.where(before.isNotNull() & after.isNotNull()).withColumn("delta", after - before)
    sides = legs.select(
        "event_id", F.col("to_team").alias("team_id"), F.lit(1).alias("sign"), "delta"
    ).unionByName(
        legs.select("event_id", F.col("from_team").alias("team_id"), F.lit(-1).alias("sign"), "delta")
    )
    got = F.sum(F.when(F.col("sign") == 1, F.col("delta")).otherwise(0.0))
    gave = F.sum(F.when(F.col("sign") == -1, F.col("delta")).otherwise(0.0))
    return sides.groupBy("event_id", "team_id").agg(
        got.alias("received"), gave.alias("given"), (got - gave).alias("surplus"), F.count("*").alias("n_legs")
    )


def trajectory_and_volatility(windowed: DataFrame, metric: str) -> DataFrame:
    d = F.col(offset_name(metric, -1)) - F.col(offset_name(metric, -2))
    return per_receiver(
        windowed.where(d.isNotNull()), F.avg(d).alias("trajectory"), F.avg(F.abs(d)).alias("volatility")
    )


def cluster_score(legs: DataFrame, plus: Sequence, minus: Sequence) -> DataFrame:
    """Mean of +1 / -1 / 0 by membership of the sending team."""
    score = F.when(F.col("from_team").isin(*plus), 1.0).when(F.col("from_team").isin(*minus), -1.0).otherwise(0.0)
    return per_receiver(legs, F.avg(score).alias("cluster_score"), F.count("*").alias("n_players"))


def pedigree(legs: DataFrame, picks: DataFrame) -> DataFrame:
    """Draft pedigree of the acquired players; ``picks`` has (player_id, pick)."""
    return per_receiver(
        legs.join(picks, "player_id", "left"),
        F.min("pick").alias("best_pick"),
        F.avg("pick").alias("avg_pick"),
        F.count("pick").alias("n_with_pick"),
        F.count("*").alias("n_players"),
    )


def demographic_mix(people: DataFrame) -> DataFrame:
    """Age mean and sample deviation, and category shares, of the acquired players."""
    share = lambda cond: F.avg(cond.cast("double"))
    return per_receiver(
        people,
        F.avg("age").alias("avg_age"),
        F.stddev_samp("age").alias("age_stddev"),
        share(F.col("bat_side") == "L").alias("pct_left_bat"),
        share(F.col("is_international") == 1).alias("pct_international"),
        share(F.col("position_type") == "Pitcher").alias("pct_pitchers"),
        F.count("*").alias("n_players"),
    )


# Weight and usual age of each minor level, and the defaults beyond.
LEVEL_MULTIPLIER = {11: 1.00, 12: 0.85, 13: 0.70, 14: 0.55}
LEVEL_MULTIPLIER_OTHER = 0.40
LEVEL_AGE = {11: 25, 12: 23, 13: 21, 14: 20}
LEVEL_AGE_OTHER = 22


def highest_level(levels: DataFrame) -> DataFrame:
    """Collapse a (player, season, group) to the highest level reached (lowest code).

    The weighted mean leaves rows without the metric out of the denominator.  One
    aggregate per level, then the smallest level wins, so no window is needed.
    """
    per_level = levels.groupBy("player_id", "season", "grp", "level_id").agg(
        F.sum("pa").alias("pa"),
        F.try_divide(
            F.sum(F.col("ops") * F.col("pa").cast("double")),
            F.sum(F.when(F.col("ops").isNotNull(), F.col("pa").cast("double")).otherwise(0.0)),
        ).alias("ops_weighted"),
    )
    return (
        per_level.groupBy("player_id", "season", "grp")
        .agg(F.min_by(F.struct("level_id", "pa", "ops_weighted"), "level_id").alias("top"))
        .select("player_id", "season", "grp", F.col("top.level_id").alias("top_level"), "top.pa", "top.ops_weighted")
    )


def minor_quality(
    legs: DataFrame, tops: DataFrame, ages: DataFrame, min_pa: float = 50, min_ip: float = 20
) -> DataFrame:
    """Level-adjusted quality of the acquired players' previous minor season."""
    prior = tops.withColumn("season", F.col("season") + 1)
    joined = legs.join(prior, ["player_id", "season"], "left").join(ages, "player_id", "left")
    level = F.col("top_level").cast("int")
    mult = lookup(LEVEL_MULTIPLIER, level, LEVEL_MULTIPLIER_OTHER)
    usual = lookup(LEVEL_AGE, level, LEVEL_AGE_OTHER)
    hits = (F.col("grp") == "hitting") & (F.col("pa") >= min_pa)
    pitches = (F.col("grp") == "pitching") & (F.col("pa") >= min_ip) & (F.col("ops_weighted") > 0)
    return per_receiver(
        joined,
        F.avg(F.when(hits, F.col("ops_weighted") * mult)).alias("hit_quality"),
        F.avg(F.when(pitches, F.lit(5.0) / F.col("ops_weighted") * mult)).alias("pitch_quality"),
        F.avg(F.when(F.col("pa").isNotNull(), usual - F.col("age"))).alias("age_advantage"),
        F.min("top_level").alias("highest_level"),
        F.count("top_level").alias("n_with_data"),
    )


def prior_awards(legs: DataFrame, awards: DataFrame) -> DataFrame:
    """Awards strictly before the season of the move: mean, maximum, share with any.

    ``awards`` is counted per (player, season) first, so the join multiplies a leg
    by its player's award seasons at most.
    """
    counted = awards.groupBy("player_id", F.col("season").alias("_s")).agg(F.count("*").alias("_n"))
    per_player = (
        legs.select("event_id", "to_team", "player_id", "season")
        .distinct()
        .join(counted, "player_id", "left")
        .groupBy("event_id", "to_team", "player_id", "season")
        .agg(F.coalesce(F.sum(F.when(F.col("_s") < F.col("season"), F.col("_n"))), F.lit(0)).alias("n"))
    )
    return per_receiver(
        per_player,
        F.avg("n").alias("avg_prior_awards"),
        F.max("n").cast("double").alias("max_prior_awards"),
        F.avg((F.col("n") > 0).cast("double")).alias("pct_awarded"),
    )


def origin_value(legs: DataFrame, roles: DataFrame, scale: int = 1000) -> DataFrame:
    """Mean value with the sending team in the season of the move.

    The batting row is preferred, then the pitching row, then 0; stints are
    summed before the join.
    """
    by_team = roles.groupBy("player_id", "season", "team_id").agg(
        (F.sum(F.when(F.col("role") == "B", F.col("value_amt"))).cast("double") / scale).alias("bat"),
        (F.sum(F.when(F.col("role") == "P", F.col("value_amt"))).cast("double") / scale).alias("pit"),
    ).withColumnRenamed("team_id", "from_team")
    moved = legs.where(F.col("from_team") != F.col("to_team"))
    joined = moved.join(by_team, ["player_id", "season", "from_team"], "left")
    return per_receiver(joined, F.avg(F.coalesce("bat", "pit", F.lit(0.0))).alias("origin_value"))


def acceleration(legs: DataFrame, totals: DataFrame) -> DataFrame:
    """Mean second difference v[t-1] - 2 v[t-2] + v[t-3]."""
    w = offset_window(legs, totals, [-1, -2, -3], ["value"])
    a = F.col("value_t_minus_1") - F.col("value_t_minus_2") * 2.0 + F.col("value_t_minus_3")
    return per_receiver(w.where(a.isNotNull()), F.avg(a).alias("acceleration"))


def contract_year_share(legs: DataFrame, roles: DataFrame) -> DataFrame:
    """Share of acquired legs with a salary this season and none the next."""
    has = roles.groupBy("player_id", "season").agg(
        F.max(F.when(F.col("salary").isNotNull(), 1).otherwise(0)).alias("paid")
    )
    w = offset_window(legs, has, [0, 1], ["paid"])
    flag = (F.col("paid_t") == 1) & (F.col("paid_t_plus_1") == 0)
    return per_receiver(w, F.avg(F.when(flag, 1.0).otherwise(0.0)).alias("contract_year_share"))


def leg_people(legs: DataFrame, people: DataFrame, birth_year: str = "birth_year") -> DataFrame:
    """Age at the move and origin flags from a people table."""
    return legs.join(people, "player_id", "left").withColumn("age", F.col("season") - F.col(birth_year))
