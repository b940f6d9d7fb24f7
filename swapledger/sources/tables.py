"""Input tables and the trade-shaped tables derived from them."""

from __future__ import annotations

from copy import copy
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swapledger.functions.scans import HOT_ROWS, hot_keys, with_buckets

#: Columns that put the rows of one event into a total order.
LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]

#: Columns of a line that ``Tables.for_matrices`` keeps: the first three columns of the order, and the score of a game.
#: Lines alike in the three have one supplier, so they tell which sender comes first as the whole order does.
KEPT_ORDER = [*LINE_ORDER[:3], "l_quantity", "l_returnflag"]

#: Units per amount in ``Tables.amounts``.
UNIT = 10_000

#: Divisor that brings amounts to the size of the value thresholds.  A prime, so
#: that no derived value sits exactly on a rounding tie.
SCALE = 1009


def in_amounts(units: str) -> Column:
    """Units of 1/10000 as an exact amount."""
    return F.col(units).cast("decimal(18,0)") * F.lit(Decimal("0.0001"))


class Tables:
    """Lazy access to one folder of parquet tables.

    Nothing is cached or collected; every property only builds a plan, and
    Catalyst prunes the columns a query does not use.
    """

    #: Rows beyond which the split scans cut a key.
    hot_rows = HOT_ROWS
    #: Lines that one task sums to levels.
    level_rows = 250_000
    #: Lowest and highest team id of the ledger's events.
    affiliated = (2, 22)

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    # -- dimensions -------------------------------------------------------
    @cached_property
    def team(self) -> DataFrame:
        return self.base("nation").select(
            F.col("n_nationkey").alias("team_id"),
            F.col("n_name").alias("team_name"),
            F.col("n_regionkey").alias("division_id"),
        )

    # -- legs -------------------------------------------------------------
    @cached_property
    def leg(self) -> DataFrame:
        """Event legs; ``leg_order`` is a comparable struct, not yet numbered."""
        line = self.base("lineitem").withColumn("leg_order", F.struct(*LINE_ORDER))
        orders = self.base("orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
        )
        customer = self.base("customer").select("c_custkey", F.col("c_nationkey").alias("to_team"))
        supplier = self.base("supplier").select("s_suppkey", F.col("s_nationkey").alias("from_team"))
        # Lines are the many rows: they meet the few suppliers first and are then moved once, by event.
        moved = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        return (
            line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(moved, line.l_orderkey == moved.o_orderkey)
            .select(
                F.col("l_orderkey").alias("event_id"),
                "leg_order",
                F.col("o_orderdate").cast("date").alias("event_date"),
                F.year("o_orderdate").alias("season"),
                F.col("l_partkey").alias("player_id"),
                "from_team",
                "to_team",
                F.col("o_orderstatus").alias("type_code"),
                F.col("o_orderpriority").alias("priority"),
                F.col("l_suppkey").alias("supp_id"),
                F.col("o_custkey").alias("cust_id"),
            )
        )

    def shared(self, *names: str) -> Tables:
        """These tables with the named facts written once, so that whatever is derived from them reads files.

        For plans that use a fact many times: its joins and aggregates run a single time.
        """
        from swapledger.operators.regress import materialise

        out = copy(self)
        for name in names:
            out.__dict__[name] = materialise(getattr(out, name), f"shared-{name}")
        return out

    def for_matrices(self, *names: str) -> Tables:
        """These tables with narrow legs, player-season-team facts and the named facts written once.

        Legs keep the part of their order that ``KEPT_ORDER`` names.  Amounts are the written
        facts, dealt by player: whatever is summed for a player, by season or team, is summed there.
        """
        from swapledger.operators.regress import materialise

        out = copy(self)
        flat = {"l_partkey": "player_id", "l_suppkey": "supp_id"}
        leg = self.leg.select(
            "event_id", "season", "player_id", "from_team", "to_team", "type_code", "priority", "supp_id",
            *[F.col(f"leg_order.{c}").alias(c) for c in KEPT_ORDER if c not in flat],
        )
        order = F.struct(*[F.col(flat.get(c, c)).alias(c) for c in KEPT_ORDER])
        out.__dict__["leg"] = materialise(leg, "matrix-leg").withColumn("leg_order", order).drop(
            "supp_id", *[c for c in KEPT_ORDER if c not in flat])
        facts = materialise(self.psr.select("role", "player_id", "season", "team_id", "units", "salary"), "matrix-psr")
        out.__dict__["psr"] = facts.withColumn("value_amt", in_amounts("units"))
        out.__dict__["amounts"] = facts.repartition("player_id")
        paid = F.when(F.col("salary").isNotNull(), F.lit(1)).alias("salary")
        dealt = facts.select("role", "player_id", "season", "team_id", "units", paid).repartition("player_id")
        out.__dict__["player_rows"] = dealt.withColumn("value_amt", in_amounts("units"))
        return out.shared(*names)

    def for_outcomes(self) -> Tables:
        """These tables with the legs of the ledger's events written once, and amounts dealt once per fact.

        Legs have no order.  Nothing else is written: each fact reads its own few columns of the
        lines; those of ``history`` are dealt by player, those of ``paid`` by player and season,
        without the lines that have no salary, and whatever is summed under these keys is summed there.
        """
        from swapledger.operators.ledger import affiliated_legs
        from swapledger.operators.regress import materialise

        out = copy(self)
        legs = materialise(self.trade.select("event_id", "season", "player_id", "from_team", "to_team"), "outcome-trade")
        legs = materialise(affiliated_legs(legs, *self.affiliated), "outcome-legs")
        out.__dict__.update(trade=legs, ledger_trade=legs, psv=self.psv)
        out.__dict__["paid"] = self.by_role(self.amounts.where("salary is not null").repartition("player_id", "season"))
        out.__dict__["amounts"] = self.amounts.repartition("player_id")
        return out

    @cached_property
    def numbered_leg(self) -> DataFrame:
        """Legs with ``leg_index``; hot events are found from the narrow line columns alone."""
        from swapledger.sources.records import number_legs

        place = lambda line, part: line * F.lit(1e11) + part
        line = self.base("lineitem").select(F.col("l_orderkey").alias("event_id"), "l_linenumber", "l_partkey")
        hot = hot_keys(line, "event_id", place(F.col("l_linenumber"), F.col("l_partkey")), self.hot_rows)
        if hot.isEmpty():
            return number_legs(self.leg, "event_id", None, [F.col(f"leg_order.{c}") for c in LINE_ORDER])
        split = with_buckets(
            self.leg, hot, "event_id", place(F.col("leg_order.l_linenumber"), F.col("player_id")), "bucket"
        )
        return number_legs(split, "event_id", "bucket", [F.col(f"leg_order.{c}") for c in LINE_ORDER]).drop("bucket")

    @cached_property
    def trade(self) -> DataFrame:
        from swapledger.operators.legs import trade_legs

        return trade_legs(self.leg, "F")

    @cached_property
    def ledger_trade(self) -> DataFrame:
        """Trade legs of the events that the ledger holds: all that its rows can be joined with."""
        return self.trade.join(self.ledger.select("event_id").distinct(), "event_id", "left_semi")

    @cached_property
    def numbered_trade(self) -> DataFrame:
        from swapledger.operators.legs import trade_legs

        return trade_legs(self.numbered_leg, "F")

    # -- facts ------------------------------------------------------------
    @cached_property
    def amounts(self) -> DataFrame:
        """Line rows as player-season-team amounts, in whole units of 1/10000 (exact sums in a long)."""
        line = self.base("lineitem")
        supplier = self.base("supplier").select("s_suppkey", F.col("s_nationkey").alias("team_id"))
        whole = lambda c: F.rint(F.col(c) * 100).cast("long")
        return line.join(supplier, line.l_suppkey == supplier.s_suppkey).select(
            F.when(F.col("l_returnflag") == "R", "P").otherwise("B").alias("role"),
            F.col("l_partkey").alias("player_id"),
            F.year("l_shipdate").alias("season"),
            "team_id",
            (whole("l_extendedprice") * (whole("l_discount") - 5)).alias("units"),
            whole("l_quantity").alias("quantity_units"),
            F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice")).alias("salary"),
        )

    @cached_property
    def psr(self) -> DataFrame:
        """Player-season-team value by role."""
        return self.by_role(self.amounts)

    @staticmethod
    def by_role(amounts: DataFrame) -> DataFrame:
        return (
            amounts.groupBy("role", "player_id", "season", "team_id")
            .agg(
                F.sum("units").alias("units"),
                F.sum("quantity_units").alias("_q"),
                F.max("salary").alias("salary"),
                F.count("*").alias("games"),
            )
            .select(
                "role", "player_id", "season", "team_id", "units",
                in_amounts("units").alias("value_amt"),
                (F.col("_q").cast("decimal(18,0)") * F.lit(Decimal("0.01"))).alias("volume"),
                "salary", "games",
            )
        )

    @cached_property
    def paid(self) -> DataFrame:
        """``psr`` for sums of salaries: rows without one add nothing, and ``for_outcomes`` leaves them out."""
        return self.psr

    @cached_property
    def player_rows(self) -> DataFrame:
        """``psr`` for a player's profile: ``salary`` is only asked whether it is there.

        ``for_matrices`` deals these rows by player, with 1 for a salary and the amount still in units.
        """
        return self.psr

    @cached_property
    def psv(self) -> DataFrame:
        """Player-season value over roles and teams (one row per player and season)."""
        from swapledger.operators.facts import season_totals

        return season_totals(self.amounts, SCALE, "units", UNIT)

    @cached_property
    def pstv(self) -> DataFrame:
        from swapledger.operators.facts import season_team_totals

        return season_team_totals(self.amounts, SCALE, "units", UNIT)

    @cached_property
    def metric(self) -> DataFrame:
        return (
            self.base("lineitem")
            .groupBy(F.col("l_partkey").alias("player_id"), F.year("l_shipdate").alias("season"))
            .agg(
                (F.sum(F.col("l_discount").cast("decimal(10,4)")).cast("double") / F.count("*") / 0.97).alias("metric_a"),
                (F.sum(F.col("l_tax").cast("decimal(10,4)")).cast("double") / F.count("*") / 0.97).alias("metric_b"),
                F.count("*").alias("n"),
            )
            .where("n >= 3")
        )

    @cached_property
    def office(self) -> DataFrame:
        orders, customer = self.base("orders"), self.base("customer")
        return (
            orders.where(F.col("o_orderstatus") != "P")
            .join(customer, orders.o_custkey == customer.c_custkey)
            .groupBy(
                F.col("c_nationkey").alias("team_id"),
                F.year("o_orderdate").alias("season"),
                F.col("o_orderpriority").alias("role"),
            )
            .agg(F.max("c_name").alias("person"))
        )

    @cached_property
    def regime(self) -> DataFrame:
        from swapledger.operators.people import decision_makers

        return decision_makers(self.office, ["1-URGENT", "2-HIGH", "3-MEDIUM"])

    @cached_property
    def standing(self) -> DataFrame:
        orders, customer = self.base("orders"), self.base("customer")
        return (
            orders.join(customer, orders.o_custkey == customer.c_custkey)
            .groupBy(F.col("c_nationkey").alias("team_id"), F.year("o_orderdate").alias("season"))
            .agg(
                F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("wins"),
                F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("losses"),
            )
        )

    @cached_property
    def game(self) -> DataFrame:
        """Legs between two teams as games; whatever has its legs written has its games there too."""
        return self.leg.where(F.col("from_team") != F.col("to_team")).select(
            F.col("event_id").alias("game_id"),
            F.col("to_team").alias("home_team"),
            F.col("from_team").alias("visitor_team"),
            "season",
            F.col("leg_order.l_returnflag").alias("park_id"),
            F.col("leg_order.l_quantity").cast("int").alias("home_score"),
            F.col("leg_order.l_linenumber").cast("int").alias("visitor_score"),
        )

    @cached_property
    def level(self) -> DataFrame:
        line = self.base("lineitem")
        # Nearly every line is a group of its own, so lines are dealt before they are summed, over
        # parts whose number grows with the lines: a task's tables of groups keep their size.
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(least, -(-line.count() // self.level_rows))
        return (
            line.select(
                F.col("l_partkey").alias("player_id"),
                F.year("l_shipdate").alias("season"),
                (F.lit(11) + F.col("l_linenumber") % 4).alias("level_id"),
                F.when(F.col("l_returnflag") == "R", "pitching").otherwise("hitting").alias("grp"),
                "l_quantity",
                "l_tax",
            )
            .repartition(parts, "player_id", "season")
            .groupBy("player_id", "season", "level_id", "grp")
            .agg(
                F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("pa"),
                F.when(
                    F.max("l_tax") > 0.01,
                    F.sum(F.col("l_tax").cast("decimal(10,4)")).cast("double") / F.count("*") / 0.0970123457,
                ).alias("ops"),
            )
        )

    @cached_property
    def log(self) -> DataFrame:
        """Play log without numbering: order is (ts, event_id) inside a game."""
        return self.cut_log(self.base("events").select(F.col("user_id").alias("game_id"), "event_id", "ts", "event_type", "value"))

    def cut_log(self, e: DataFrame) -> DataFrame:
        """A log with the ordered buckets of its hot games."""
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        hot = hot_keys(e, "game_id", at, self.hot_rows)
        self.log_is_split = not hot.isEmpty()
        return with_buckets(e, hot, "game_id", at, "bucket")

    # -- windows ----------------------------------------------------------
    @cached_property
    def window(self) -> DataFrame:
        """Value window t-1 .. t+5 on unnumbered trade legs."""
        from swapledger.operators.offsets import offset_window

        return offset_window(self.trade, self.psv, range(-1, 6), ["value"])

    @cached_property
    def history(self) -> DataFrame:
        from swapledger.operators.offsets import player_history

        return player_history(self.amounts, SCALE, "units", UNIT)

    @cached_property
    def metric_window(self) -> DataFrame:
        from swapledger.operators.offsets import offset_window

        return offset_window(self.trade, self.metric, [-2, -1, 1], ["metric_a", "metric_b"])

    @cached_property
    def ledger(self) -> DataFrame:
        from swapledger.operators.ledger import affiliated_rows, naive_ledger

        return affiliated_rows(naive_ledger(self.trade, self.history, years=3), *self.affiliated)
