"""Outcome matrix: value, cost and surplus of what a receiver acquired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swapledger.operators.offsets import offset_window, window_sum

DEFAULT_PRICE = 8_000_000.0


def player_cost(roles: DataFrame) -> DataFrame:
    """Salary rows summed per (player, season), exactly."""
    return roles.groupBy("player_id", "season").agg(
        F.sum(F.col("salary").cast("decimal(18,2)")).alias("cost")
    )


def acquired_cost(legs: DataFrame, roles: DataFrame) -> DataFrame:
    """Sum of the season-t cost of the acquired players per (event, receiver)."""
    return (
        legs.join(player_cost(roles), ["player_id", "season"], "left")
        .groupBy("event_id", "to_team")
        .agg(F.sum("cost").alias("cap"))
    )


def salary_between(legs: DataFrame, roles: DataFrame, years: int) -> DataFrame:
    """Mean salary row of each leg's player in ``[season, season + years]``.

    Rows are summed and counted per (player, season) before the join.
    """
    paid = roles.where(F.col("salary").isNotNull()).groupBy("player_id", F.col("season").alias("_s")).agg(
        F.sum(F.col("salary").cast("decimal(18,2)")).alias("_sum"), F.count("*").alias("_n")
    )
    inside = F.col("_s").between(F.col("season"), F.col("season") + years)
    return (
        legs.join(paid, "player_id", "left")
        .groupBy(*legs.columns)
        .agg(
            F.try_divide(
                F.sum(F.when(inside, F.col("_sum"))).cast("double"),
                F.sum(F.when(inside, F.col("_n"))).cast("double"),
            ).alias("avg_salary")
        )
    )


def price_curve(costs: DataFrame, totals: DataFrame, min_value: float = 50.0) -> DataFrame:
    """Price per unit of value by season: cost of veterans over their positive value."""
    positive = totals.select("player_id", "season", F.greatest("value", F.lit(0.0)).alias("pos"))
    return (
        costs.where(F.col("cost").isNotNull())
        .join(positive, ["player_id", "season"], "left")
        .groupBy("season")
        .agg(F.sum("cost").cast("double").alias("cost"), F.sum("pos").alias("pos"))
        .where(F.col("pos") > min_value)
        .select("season", (F.col("cost") / F.col("pos")).alias("price"))
    )


def with_fallback(curve: DataFrame, table: DataFrame) -> DataFrame:
    """Empirical price where there is one, else the fixed table's."""
    return curve.join(table.withColumnRenamed("price", "_p"), "season", "full").select(
        "season", F.coalesce("price", "_p").alias("price"), F.col("price").isNotNull().alias("empirical")
    )


def dollar_surplus(received: Column, price: Column, cap: Column) -> Column:
    """Received value at the season's price less the cost taken on; NULLs count as 0."""
    p = F.coalesce(price, F.lit(DEFAULT_PRICE))
    return F.coalesce(received * p, F.lit(0.0)) - F.coalesce(cap.cast("double"), F.lit(0.0))


def outcome_matrix(ledger: DataFrame, rates: list[DataFrame], prices: DataFrame, cap: DataFrame) -> DataFrame:
    """One row per (event, receiver): rate deltas, surplus, dollar surplus, surplus in wins."""
    out = ledger.join(prices, "season", "left")
    for side in [*rates, cap]:
        out = out.join(side, ["event_id", "to_team"], "left")
    dollars = dollar_surplus(F.col("received"), F.col("price"), F.col("cap"))
    return out.withColumn("dollar_surplus", dollars).withColumn(
        "surplus_wins", F.col("dollar_surplus") / F.coalesce("price", F.lit(DEFAULT_PRICE))
    )


def windowed_outcome(legs: DataFrame, totals: DataFrame, start: int, end: int, leg_id: str = "leg_order") -> DataFrame:
    """Window sum per (event, receiver, season): total and per distinct leg."""
    w = offset_window(legs, totals, range(1, end + 1), ["value"])
    return w.groupBy("event_id", "to_team", "season").agg(
        F.sum(window_sum(start, end)).alias("value_total"),
        F.try_divide(F.sum(window_sum(start, end)), F.count(leg_id)).alias("value_delta"),
    )


def controlled_surplus(
    legs: DataFrame, totals: DataFrame, roles: DataFrame, years: int = 3, rate: float = DEFAULT_PRICE
) -> DataFrame:
    """Cost-controlled surplus: realised value at a flat rate less mean salaries.

    Two further terms of the full valuation have no data and stay 0.
    """
    players = legs.select("event_id", "to_team", "player_id", "season").distinct()
    w = offset_window(players, totals, range(1, years + 1), ["value"]).select(
        "event_id", "to_team", "player_id", "season", window_sum(1, years).alias("realised")
    )
    per = salary_between(w, roles, years)
    out = per.groupBy("event_id", "to_team").agg(
        F.sum("realised").alias("total_value"),
        F.sum(F.coalesce("avg_salary", F.lit(0.0))).alias("total_salary"),
        F.count_if(F.col("avg_salary").isNull()).alias("missing"),
        F.count("*").alias("n_players"),
    )
    note = F.when(
        F.col("missing") > 0,
        F.concat(F.lit("salary missing for "), F.col("missing").cast("string"), F.lit("/"),
                 F.col("n_players").cast("string"), F.lit(" player(s)")),
    ).otherwise(F.lit(""))
    return (
        out.withColumn("controlled_surplus", F.col("total_value") * rate - F.col("total_salary"))
        .withColumn("post_control_surplus", F.lit(0.0))
        .withColumn("playoff_delta", F.lit(0.0))
        .withColumn("total", F.col("controlled_surplus"))
        .withColumn("notes", note)
    )
