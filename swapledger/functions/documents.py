"""JSON documents: variant columns and lenient report parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from swapledger.functions.scalars import clamp

REPORT_SCHEMA = (
    "team string, headline string, verdict string, confidence double, "
    "recommendations array<struct<rank:double,action:string,confidence:double>>"
)


def one_of(c: Column, allowed: Sequence[str], default: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(default)


def parse_report(text: Column, verdicts: Sequence[str], default: str) -> Column:
    """Report with defaults filled, enums checked, confidences clamped, advice sorted by rank.

    A text that is not JSON, or lacks fields, still gives a full record.
    """
    r = F.from_json(text, REPORT_SCHEMA)
    advice = F.coalesce(r["recommendations"], F.array().cast("array<struct<rank:double,action:string,confidence:double>>"))
    filled = F.transform(
        advice,
        lambda x, i: F.struct(
            F.coalesce(x["rank"], (i + 1).cast("double")).alias("rank"),
            F.coalesce(x["action"], F.lit("Recommendation")).alias("action"),
            clamp(F.coalesce(x["confidence"], F.lit(50.0)), 0, 100).alias("confidence"),
        ),
    )
    return F.struct(
        F.coalesce(r["team"], F.lit("—")).alias("team"),
        F.coalesce(r["headline"], F.lit("Strategic brief")).alias("headline"),
        one_of(r["verdict"], verdicts, default).alias("verdict"),
        clamp(F.coalesce(r["confidence"], F.lit(50.0)), 0, 100).alias("confidence"),
        F.array_sort(filled).alias("recommendations"),
    )
