"""Semi-structured text columns to typed rows: HTML, JSON envelopes, markdown tables.

Every parser works on a text column with built-in expressions, one row per
document in, exploded rows out; nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swapledger.functions import scalars as S

# Roles kept from a front-office block.
OFFICE_ROLES = [
    "General Manager", "President of Baseball Operations", "President", "Manager", "Farm Director",
    "Scouting Director", "Owner", "Director of Player Development", "Director of Player Personnel",
    "Assistant General Manager", "Vice President of Baseball Operations", "Chairman",
]
# Columns of a payroll table after the name cell.
PAYROLL_COLUMNS = ["position", "service_time", "acquired", "status", "base_salary", "cap_hit", "bonus", "incentives"]


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " "))


def elements(fragment: Column, tag: str) -> Column:
    """Inner text of each closed element of ``tag``, by splitting at the places where one opens.

    The name may be followed by attributes, so ``tr`` does not open at ``<track>``.
    """
    pieces = F.split(fragment, f"<{tag}(?=[\\s>])")
    opened = F.filter(pieces, lambda x, i: (i > 0) & F.contains(x, F.lit(f"</{tag}>")))
    inner = lambda x: F.substring_index(x, f"</{tag}>", 1)
    # What stands before the first ">" are the attributes.
    return F.transform(F.transform(opened, inner), lambda x: F.substr(x, F.locate(">", x) + 1))


def html_cells(docs: DataFrame, html: str, opening: str, closing: str, row_tag: str, cell_tag: str, name: str = "cells") -> DataFrame:
    """One row per element of ``row_tag`` between the first ``opening`` text and the next ``closing``, with its cells."""
    after = F.substring_index(F.col(html), opening, 1)
    body = F.substring_index(F.substr(F.col(html), F.length(after) + F.lit(len(opening) + 1)), closing, 1)
    found = F.when(F.contains(F.col(html), F.lit(opening)), body).otherwise("")
    # Rows and cells are made once and stand as values of their own; as plain expressions, the
    # filters on them would work them out anew.
    rows = docs.select("*", F.explode(F.array(elements(found, row_tag))).alias("_rows"))
    one = rows.select(*docs.columns, F.posexplode("_rows").alias("row_no", "row_html"))
    return one.select("*", F.explode(F.array(elements(F.col("row_html"), cell_tag))).alias(name))


def payroll_rows(docs: DataFrame, html: str, table_id: str, keep: Sequence[str]) -> DataFrame:
    """Contract rows of one payroll table; rows without a player link or with few cells drop out."""
    rows = html_cells(docs, html, f'<table id="{table_id}"', "</table>", "tr", "td")
    link = r'href="[^"]*/player/_/id/(\d+)/([a-z0-9-]+)"'
    cell = lambda i: F.get("clean", F.lit(i))
    text = {n: cell(i + 1) for i, n in enumerate(PAYROLL_COLUMNS)}
    # The name is the linked text of the first cell; what stands beside the link is a badge.
    name = strip_tags(F.get(elements(F.get("cells", F.lit(0)), "a"), F.lit(0)))
    players = rows.where((F.size("cells") >= 5) & F.col("row_html").rlike(link)).withColumn(
        "clean", F.transform("cells", strip_tags)
    )
    return players.select(
        *keep,
        F.regexp_extract("row_html", link, 1).cast("long").alias("contract_id"),
        F.coalesce(S.blank_to_null(name), F.lit("(unknown)")).alias("player_name"),
        text["position"].alias("position"),
        S.lenient_double(text["service_time"]).alias("service_time"),
        text["acquired"].alias("acquired"),
        text["status"].alias("status"),
        *[S.money(text[c]).alias(c) for c in ("base_salary", "cap_hit", "bonus", "incentives")],
        F.lit(table_id).alias("table_type"),
    )


def office_rows(docs: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """(role, person) pairs of the known roles in front-office blocks."""
    # A block is cut at its bold tags: label up to the closing tag, then text and links up
    # to the next tag of another kind.
    block = docs.select(*keep, F.explode(F.slice(F.split(html, "<strong>"), 2, F.size(F.split(html, "<strong>")))).alias("_block"))
    label = F.substring_index("_block", "</strong>", 1)
    rest = F.regexp_replace(F.substring_index("_block", "</strong>", -1), "</?a(\\s[^>]*)?>", "")
    named = block.where(F.col("_block").contains("</strong>")).select(
        *keep, F.trim(F.rtrim(F.trim(label), F.lit(":"))).alias("role"), plain_text(F.substring_index(rest, "<", 1)).alias("_people"),
    )
    people = named.where(F.col("role").isin(*OFFICE_ROLES)).select(
        *keep, "role", F.explode(F.split("_people", "[,;\n]|\\s+and\\s+")).alias("_name")
    ).select(*keep, "role", F.btrim("_name", F.lit(" \t.;:")).alias("person"))
    titled = F.upper(F.substring("person", 1, 1)) == F.substring("person", 1, 1)
    lettered = F.lower(F.substring("person", 1, 1)) != F.substring("person", 1, 1)
    return people.where(titled & lettered & (F.length("person") > 2) & ~F.col("person").contains("/"))


def plain_text(c: Column) -> Column:
    """Text of a fragment without tags: entities resolved, remarks in brackets dropped."""
    for entity, sign in (("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return F.regexp_replace(c, "\\([^)]*\\)", "")


def embedded_json(c: Column, variable: str, schema: str) -> Column:
    """Value of a script variable as a typed struct or array (NULL when absent)."""
    return F.from_json(F.regexp_extract(c, rf"(?s)\b{variable}\s*=\s*(\[.*?\]|\{{.*?\}})\s*;", 1), schema)


def labelled_grades(c: Column, lead: str, labels: Sequence[str]) -> list[Column]:
    """``Lead: Label: 50 | Label: 55`` prose to one column per label."""
    line = F.regexp_extract(c, rf"{lead}:\s*([^<\n]*)", 1)
    pairs = F.arrays_zip(
        F.regexp_extract_all(line, F.lit(r"([A-Za-z][A-Za-z ]*?):\s*(\d{2})"), F.lit(1)).alias("k"),
        F.regexp_extract_all(line, F.lit(r"([A-Za-z][A-Za-z ]*?):\s*(\d{2})"), F.lit(2)).alias("v"),
    )
    entries = F.transform(pairs, lambda p: F.struct(F.lower(F.trim(p["k"])).alias("key"), p["v"].cast("double").alias("value")))
    first = lambda k: F.try_element_at(F.filter(entries, lambda e: e["key"] == k), F.lit(1))["value"]
    return [first(label.lower()).alias(f"grade_{label.lower().replace(' ', '_')}") for label in labels]


def unwrap_envelope(c: Column) -> Column:
    """The ``data`` array of a payload: bare, text inside JSON, or inside a REST wrapper."""
    v = F.try_parse_json(c)
    inner = F.coalesce(
        F.try_variant_get(v, "$.data.rawHtml", "string"), F.try_variant_get(v, "$.rawHtml", "string")
    )
    payload = F.coalesce(F.try_parse_json(inner), v)
    return F.try_variant_get(payload, "$.data", "array<variant>")


def envelope_rows(
    docs: DataFrame, raw: str, keep: Sequence[str], fields: Mapping[str, tuple[str, str]], required: str
) -> DataFrame:
    """Records of an envelope, renamed and coerced per column.

    ``fields`` maps a source field to (column, kind) with kind int, double or text;
    records without the required column drop out.  Whole numbers round half to even.
    """
    kinds = {"int": S.lenient_int_half_even, "double": S.lenient_double, "text": S.blank_to_null}
    recs = docs.select(*keep, F.explode(unwrap_envelope(F.col(raw))).alias("r"))
    out = recs.select(
        *keep,
        *[kinds[kind](F.try_variant_get("r", f"$.{src}", "string")).alias(col) for src, (col, kind) in fields.items()],
    )
    return out.where(F.col(required).isNotNull())


def ranking_rows(docs: DataFrame, text: str, keep: Sequence[str], year: str) -> DataFrame:
    """Markdown pipe table of rankings to rows.

    Columns moved in 2021 (the year column decides).  Pages print the table twice:
    reading stops where the first id comes back, and the first row of an id wins.
    """
    link = r"\[([^\]]+)\]\([^)]*/players/[^/)]+/([A-Za-z0-9]+)[^)]*\)"
    lines = docs.select(*keep, F.col(year).alias("_year"), F.posexplode(F.split(F.col(text), r"\r?\n")).alias("pos", "line"))
    cells = F.transform(
        F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)
    )
    rows = (
        lines.where(F.trim("line").startswith("|") & ~F.col("line").contains("---"))
        .withColumn("c", cells)
        .where((F.size("c") >= 9) & F.get("c", F.lit(0)).rlike(r"^\d+$") & F.get("c", F.lit(2)).rlike(link))
        .withColumn("player_name", F.trim(F.regexp_extract(F.get("c", F.lit(2)), link, 1)))
        .withColumn("source_id", F.regexp_extract(F.get("c", F.lit(2)), link, 2))
    )
    # Everything below is per document, over one arrangement of its rows by position: the first
    # id, whether it has come back so far, first row of each id.
    so_far = Window.partitionBy(*keep).orderBy("pos")
    known = rows.dropna(subset=list(keep)).withColumns({"_first": F.first("source_id").over(so_far), "_at": F.min("pos").over(so_far)})
    back = (F.col("source_id") == F.col("_first")) & (F.col("pos") > F.col("_at"))
    kept = known.withColumn("_back", F.max(back).over(so_far)).where(~F.col("_back"))
    one = kept.groupBy(*keep, "source_id").agg(F.min_by(F.struct("c", "player_name", "_year"), "pos").alias("x"))
    c = lambda i: F.try_element_at("x.c", F.lit(i + 1))
    new = F.col("x._year") >= 2021
    grade = c(7).try_cast("int")
    return one.where(grade.isNotNull()).select(
        *keep, "source_id", c(0).cast("int").alias("rank"), F.col("x.player_name").alias("player_name"),
        S.name_key(S.canonical_name(F.col("x.player_name"))).alias("name_key"),
        c(3).alias("org"), c(4).alias("position"), c(5).alias("level"), grade.alias("grade"),
        S.blank_to_null(F.when(new, c(8)).otherwise(c(9))).alias("risk"),
        F.when(new, c(6)).otherwise(c(8)).try_cast("int").alias("eta"),
    )
