"""Normalising raw records to typed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swapledger.functions import scalars as S
from swapledger.functions.scans import ordinal_within

_PARTY = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
_PERSON = T.StructType([T.StructField("id", T.LongType()), T.StructField("fullName", T.StringType())])

#: Shape of one raw movement record.
MOVEMENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("date", "effectiveDate", "resolutionDate",
                                                     "typeCode", "typeDesc", "description")],
        T.StructField("fromTeam", _PARTY),
        T.StructField("toTeam", _PARTY),
        T.StructField("person", _PERSON),
    ]
)

#: Shape of one raw staff record.
STAFF_SCHEMA = T.StructType(
    [
        T.StructField("jobCode", T.StringType()),
        T.StructField("jobId", T.StringType()),
        T.StructField("job", T.StringType()),
        T.StructField("person", _PERSON),
    ]
)


def flatten_movements(raw: DataFrame, season: Column, source: str = "api") -> DataFrame:
    """Nested movement records to typed rows; absent nested objects give NULL."""
    return raw.select(
        F.col("id").alias("transaction_id"),
        S.tolerant_date(F.col("date")).alias("date"),
        S.tolerant_date(F.col("effectiveDate")).alias("effective_date"),
        S.tolerant_date(F.col("resolutionDate")).alias("resolution_date"),
        F.coalesce("typeCode", F.lit("")).alias("type_code"),
        F.col("typeDesc").alias("type_desc"),
        "description",
        F.col("fromTeam.id").alias("from_team_id"),
        F.col("fromTeam.name").alias("from_team_name"),
        F.col("toTeam.id").alias("to_team_id"),
        F.col("toTeam.name").alias("to_team_name"),
        F.col("person.id").alias("player_id"),
        F.col("person.fullName").alias("player_name"),
        season.cast("int").alias("season"),
        F.lit(source).alias("source"),
        *[c for c in raw.columns if c.startswith("_")],
    )


def flatten_staff(raw: DataFrame, team_id: Column, season: Column, source: str = "api") -> DataFrame:
    """Staff records; the job code falls back to the job id, then to ``?``."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return raw.select(
        team_id.alias("team_id"),
        season.cast("int").alias("season"),
        F.coalesce(filled("jobCode"), filled("jobId"), F.lit("?")).alias("job_code"),
        F.col("job").alias("job_title"),
        F.col("person.id").alias("person_id"),
        F.col("person.fullName").alias("person_name"),
        F.lit(source).alias("source"),
    )


def number_legs(
    rows: DataFrame, event: str, bucket: str | None, order: Sequence[Column | str], name: str = "leg_index"
) -> DataFrame:
    """0-based ordinal of each row inside its event, in the given total order."""
    return ordinal_within(rows, [event], bucket, order, name, start=0)


def _cell(cols: Column, i: int) -> Column:
    return S.strip_quotes(F.try_element_at(cols, F.lit(i + 1)))


def parse_trade_text(lines: DataFrame) -> DataFrame:
    """Quoted positional text to trade legs (type ``T``, 12 or more columns, digit ids).

    The columns of a line, and then its date, are made once and stand as values of their own:
    as plain expressions, every filter and every column would work them out anew.
    """
    split = lines.select(F.explode(F.array(F.split("value", ","))).alias("c")).where(F.size("c") >= 12)
    cell = lambda i: S.strip_quotes(F.get("c", F.lit(i)))
    event = F.trim(F.get("c", F.lit(5)))
    typed = split.where((cell(7) == "T") & event.rlike("^[0-9]+$")).select(
        event.cast("long").alias("rs_transaction_id"), cell(0).alias("_day"), cell(6).alias("player_name_raw"),
        S.blank_to_null(cell(8)).alias("from_team_rs"), S.blank_to_null(cell(10)).alias("to_team_rs"),
    )
    when = S.compact_date(F.col("_day"), placeholder_to_new_year=True)
    return typed.select("*", F.explode(F.array(when)).alias("date")).where(F.col("date").isNotNull()).select(
        "rs_transaction_id",
        "date",
        F.year("date").alias("season"),
        F.when(F.length("player_name_raw") == 8, F.col("player_name_raw")).alias("rs_player_id"),
        "player_name_raw",
        "from_team_rs",
        "to_team_rs",
    )


def parse_game_text(lines: DataFrame, codes: DataFrame) -> DataFrame:
    """Positional game-log text to game rows; games with unmapped teams drop out.

    ``codes`` has (code, team_id); an inner join on each side does the mapping.
    """
    cols = F.split("value", ",")
    when = S.compact_date(_cell(cols, 0))
    number = lambda i: S.lenient_int(_cell(cols, i))
    games = lines.where((F.size(cols) >= 19) & when.isNotNull()).select(
        when.alias("game_date"),
        F.coalesce(S.blank_to_null(_cell(cols, 1)), F.lit("0")).alias("game_number"),
        F.year(when).alias("season"),
        _cell(cols, 3).alias("_visitor"),
        _cell(cols, 6).alias("_home"),
        number(9).alias("visitor_score"),
        number(10).alias("home_score"),
        number(11).alias("game_length_outs"),
        _cell(cols, 12).alias("day_night"),
        S.blank_to_null(_cell(cols, 16)).alias("park_id"),
        number(17).alias("attendance"),
        number(18).alias("game_time_minutes"),
    )
    visitor = codes.select(F.col("code").alias("_visitor"), F.col("team_id").alias("visitor_team"))
    home = codes.select(F.col("code").alias("_home"), F.col("team_id").alias("home_team"))
    return games.join(visitor, "_visitor").join(home, "_home").drop("_visitor", "_home")


def union_shards(shards: Sequence[DataFrame], master: str) -> DataFrame:
    """Stack sharded register files; blanks become NULL, rows without a master id go."""
    out = shards[0]
    for shard in shards[1:]:
        out = out.unionByName(shard, allowMissingColumns=True)
    cleaned = out.select(*[S.blank_to_null(F.col(c).cast("string")).alias(c) for c in out.columns])
    return cleaned.where(S.lenient_int(F.col(master)).isNotNull())


def project_to(
    df: DataFrame,
    target: T.StructType,
    rename: dict[str, str],
    keys: Sequence[str],
) -> DataFrame:
    """Rename, keep the target's columns with its types, drop rows with NULL keys.

    Text casts leniently (bad numbers become NULL) and Y/N text becomes boolean.
    """
    renamed = df.select(*[F.col(c).alias(rename.get(c, c)) for c in df.columns])
    out = []
    for field in target:
        if field.name not in renamed.columns:
            continue
        c = F.col(field.name)
        if isinstance(field.dataType, T.BooleanType):
            c = F.when(F.upper(c) == "Y", True).when(F.upper(c) == "N", False)
        elif isinstance(field.dataType, (T.IntegerType, T.LongType)):
            c = S.lenient_int(c).cast(field.dataType)
        elif isinstance(field.dataType, T.DoubleType):
            c = S.lenient_double(c)
        out.append(c.alias(field.name))
    return renamed.select(*out).dropna(subset=list(keys))
