"""Team boards: blended value by position, holes, farm depth, verdicts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swapledger.functions.scalars import normal_cdf
from swapledger.functions.valuation import MARKET_RATE

# Value a full season should bring from each position.
BASELINE = {
    "C": 2.0, "1B": 2.0, "2B": 2.0, "3B": 2.5, "SS": 2.5, "LF": 2.0,
    "CF": 2.5, "RF": 2.0, "DH": 1.5, "SP": 12.0, "RP": 4.0,
}
# Farm credit by level, scale, caps and minimum volumes.
FARM_LEVEL = {11: 1.0, 12: 0.55}
FARM_SCALE = 9.0
FARM_PLAYER_CAP = 1.2
FARM_POSITION_CAP = 2.5
FARM_MIN_PA = 100
FARM_MIN_IP = 20.0
FARM_MEAN_OPS = 0.74
FARM_MEAN_ERA = 4.50
# Tax base threshold of the running season.
TAX_BASE = 244_000_000


def blend_weight(games: Column) -> Column:
    """Weight of the running season against the prior one."""
    return F.least(games / 120.0, F.lit(0.85))


def season_components(roles: DataFrame, season: Column, scale: float = 1000) -> DataFrame:
    """Batting and pitching value per player for one season."""
    part = lambda r: (
        F.coalesce(F.sum(F.when(F.col("role") == r, F.col("value_amt"))).cast("double") / scale, F.lit(0.0))
    )
    return roles.where(F.col("season") == season).groupBy("player_id").agg(part("B").alias("bat"), part("P").alias("pit"))


def blended_positions(
    roster: DataFrame, now: DataFrame, prior: DataFrame, pitch_roles: DataFrame, positions: DataFrame, games: Column
) -> DataFrame:
    """Blended value per (team, position): batting to the fielding position, pitching by role.

    ``games`` is a scalar sub-query (games played so far).  Tiny components do not
    count; a pitcher without a role is a reliever.
    """
    j = (
        roster.join(now.select("player_id", F.col("bat").alias("b1"), F.col("pit").alias("p1")), "player_id", "left")
        .join(prior.select("player_id", F.col("bat").alias("b0"), F.col("pit").alias("p0")), "player_id", "left")
        .join(pitch_roles.select("player_id", F.col("pitch_role").alias("pr")), "player_id", "left")
        .join(positions.select("player_id", "position"), "player_id", "left")
        .withColumn("_g", games.cast("double"))
    )
    w, pace = blend_weight(F.col("_g")), F.when(F.col("_g") > 0, 162.0 / F.col("_g")).otherwise(1.0)
    blend = lambda a, b: (
        w * (F.coalesce(a, F.lit(0.0)) * pace) + (1.0 - w) * F.coalesce(b, F.lit(0.0))
    )
    parts = j.select(
        "team_id",
        F.explode(
            F.array(
                F.struct(F.coalesce("pr", F.lit("RP")).alias("position"), blend(F.col("p1"), F.col("p0")).alias("v")),
                F.struct(F.col("position"), blend(F.col("b1"), F.col("b0")).alias("v")),
            )
        ).alias("x"),
    ).select("team_id", "x.*")
    return (
        parts.where((F.abs("v") > 0.01) & F.col("position").isNotNull())
        .groupBy("team_id", "position")
        .agg(F.sum("v").alias("rostered"))
    )


def pitching_roles(rows: DataFrame, now: Column, prior: Column) -> DataFrame:
    """``SP`` when at least half of the games were starts; the running season decides if known."""
    per = (
        rows.where((F.col("season") == now) | (F.col("season") == prior))
        .groupBy("player_id", "season")
        .agg(F.sum("starts").alias("gs"), F.sum("games").alias("g"))
        .where(F.col("g") > 0)
    )
    latest = per.groupBy("player_id").agg(F.max_by(F.struct("gs", "g"), "season").alias("x"))
    share = F.coalesce(F.col("x.gs"), F.lit(0)) / F.col("x.g")
    return latest.select("player_id", F.when(share >= 0.5, "SP").otherwise("RP").alias("pitch_role"))


def farm_depth(
    seasons: DataFrame, min_pa: float = FARM_MIN_PA, min_ip: float = FARM_MIN_IP
) -> DataFrame:
    """Farm value per (team, position) from upper-level performance.

    ``seasons``: team_id, level_id, grp, position, pitch_role, volume, metric.  The
    caps are order-free because every credit is positive.
    """
    upper = seasons.where(F.col("level_id").isin(*FARM_LEVEL)).where(
        ((F.col("grp") == "hitting") & (F.col("volume") >= min_pa))
        | ((F.col("grp") == "pitching") & (F.col("volume") >= min_ip))
    )
    means = upper.groupBy("grp", "level_id").agg(F.avg("metric").alias("_mean"))
    weight = F.when(F.col("level_id") == 11, FARM_LEVEL[11]).otherwise(FARM_LEVEL[12])
    hitting = F.col("grp") == "hitting"
    base = F.coalesce("_mean", F.when(hitting, FARM_MEAN_OPS).otherwise(FARM_MEAN_ERA))
    value = F.when(hitting, (F.col("metric") - base) * FARM_SCALE * weight).otherwise(
        F.greatest(F.lit(0.0), (base - F.col("metric")) / base) * FARM_PLAYER_CAP * weight
    )
    return (
        upper.join(means, ["grp", "level_id"], "left")
        .withColumn("_v", value)
        .withColumn("position", F.when(hitting, F.col("position")).otherwise(F.col("pitch_role")))
        .where((F.col("_v") > 0) & F.col("position").isNotNull())
        .groupBy("team_id", "position")
        .agg(F.least(F.lit(FARM_POSITION_CAP), F.sum(F.least(F.lit(FARM_PLAYER_CAP), F.col("_v")))).alias("farm"))
    )


def severity(hole: Column, baseline: Column) -> Column:
    ratio = hole / baseline
    return F.when(ratio > 0.5, "critical").when(ratio > 0.25, "warning").otherwise("ok")


def hole_board(
    teams: DataFrame, rostered: DataFrame, farm: DataFrame, baseline: Mapping[str, float] = BASELINE
) -> DataFrame:
    """Hole score of every (team, position), its kind and severity.

    The grid is teams times the fixed positions, built by exploding a literal.
    """
    grid = teams.select(
        "team_id",
        F.explode(
            F.array(*[F.struct(F.lit(p).alias("position"), F.lit(float(b)).alias("baseline")) for p, b in baseline.items()])
        ).alias("x"),
    ).select("team_id", "x.*")
    keys = ["team_id", "position"]
    r, f = F.round(F.coalesce("rostered", F.lit(0.0)), 2), F.round(F.coalesce("farm", F.lit(0.0)), 2)
    return (
        grid.join(rostered, keys, "left").join(farm, keys, "left")
        .select(*keys, "baseline", r.alias("rostered"), f.alias("farm"))
        .withColumn("hole_score", F.round(F.col("baseline") - (F.col("rostered") + F.col("farm")), 2))
        .withColumn("severity", severity(F.col("hole_score"), F.col("baseline")))
        .withColumn("kind", F.when(F.col("hole_score") > 0.5, "hole").when(F.col("hole_score") < -1.0, "surplus").otherwise("even"))
    )


# Positions a hole key accepts.
ACCEPTS = {
    "SP": ["P", "SP"], "RP": ["P", "RP"], "C": ["C"], "1B": ["1B"], "2B": ["2B"], "SS": ["SS"], "3B": ["3B"],
    "LF": ["LF", "OF"], "CF": ["CF", "OF"], "RF": ["RF", "OF"], "DH": ["DH", "1B"], "OF": ["LF", "CF", "RF", "OF"],
}


def holes_of_position(position: Column) -> Column:
    """Hole keys a player's position can fill."""
    fills: dict[str, list[str]] = {}
    for hole, accepted in ACCEPTS.items():
        for p in {hole, *accepted}:
            fills.setdefault(p, []).append(hole)
    pairs = [c for p, hs in fills.items() for c in (F.lit(p), F.array(*[F.lit(h) for h in hs]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), position), F.array().cast("array<string>"))


def buy_low(players: DataFrame, board: DataFrame, index: DataFrame, k: int = 12, at_least: float = 0.3) -> DataFrame:
    """Controlled players of teams that do not buy, whom the team can spare and others need.

    ``players``: player_id, team_id, position, salary_class, last_value, surplus.  A team
    can spare a player when it has a surplus at any position the player fits; the needy
    team's holes that the player fits are all counted, wherever the surplus lies.  Teams
    and positions are fixed in number.
    """
    from swapledger.operators.matching import first_matches

    sellers = index.where(F.col("posture") != "buy").select("team_id")
    spare = board.where("kind = 'surplus'").select("team_id", F.col("position").alias("hole"))
    candidates = (
        players.where((F.col("salary_class") != "fa") & (F.col("last_value") > 0) & (F.col("surplus") >= at_least))
        .join(sellers, "team_id", "left_semi")
        .withColumn("hole", F.explode(holes_of_position(F.col("position"))))
    )
    spared = candidates.join(spare, ["team_id", "hole"], "left_semi").select("player_id", "team_id").distinct()
    candidates = candidates.join(spared, ["player_id", "team_id"], "left_semi")
    needs = board.where("kind = 'hole'").select(F.col("team_id").alias("needy"), F.col("position").alias("hole"))
    matched = (
        candidates.join(needs, "hole")
        .where(F.col("needy") != F.col("team_id"))
        .groupBy("needy", "player_id", "team_id", "surplus")
        .agg(F.count("*").alias("n_holes"))
    )
    return first_matches(matched, ["needy"], [F.desc(F.round("surplus", 6)), F.col("player_id")], k)


def basket_verdict(items: DataFrame) -> DataFrame:
    """Verdict of a deal from its items.

    ``items``: deal_id, side (receiving / sending), surplus (already aged and
    adjusted), salary_1, posture, chance.  One partial aggregate per deal, then
    columns.
    """
    got = F.col("side") == "receiving"
    s = items.groupBy("deal_id").agg(
        F.sum(F.when(got, F.col("surplus")).otherwise(0.0)).alias("in_value"),
        F.sum(F.when(~got, F.col("surplus")).otherwise(0.0)).alias("out_value"),
        F.sum(F.when(got, F.col("salary_1")).otherwise(0.0)).alias("cost_received"),
        F.sum(F.when(~got, F.col("salary_1")).otherwise(0.0)).alias("cost_sent"),
        F.count("*").alias("n_items"),
        F.max("posture").alias("posture"),
        F.max("chance").alias("chance"),
    )
    premium = (F.col("posture") == "buy") & (F.col("chance") > 0.35)
    mul = F.when(premium, F.lit(1.0) + F.col("chance") * 0.15).otherwise(1.0)
    out = (
        s.withColumn("premium", premium)
        .withColumn("mean", F.col("in_value") * mul - F.col("out_value"))
        .withColumn("sd", F.greatest(F.lit(0.8), F.sqrt(F.greatest(F.lit(1), F.col("n_items"))) * 1.2))
    )
    p = normal_cdf(F.col("mean") / F.col("sd"))
    out = out.withColumn("p_positive", p)
    m, q = F.col("mean"), F.col("p_positive")
    label = (
        F.when((m > 4) & (q > 0.78), "strong-buy").when((m > 1.5) & (q > 0.65), "lean-buy")
        .when((m < -4) & (q < 0.22), "strong-pass").when((m < -1.5) & (q < 0.35), "lean-pass").otherwise("neutral")
    )
    return (
        out.withColumn("low", m - F.col("sd") * 1.645)
        .withColumn("high", m + F.col("sd") * 1.645)
        .withColumn("net_dollars", m * MARKET_RATE)
        .withColumn("recommendation", label)
    )


def interval_verdict(mean: Column, p10: Column, p90: Column) -> Column:
    return (
        F.when(p10 > 0, "CLEAR WIN").when(p90 < 0, "CLEAR LOSS").when(mean > 0, "lean +").otherwise("lean -")
    )
