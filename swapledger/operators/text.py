"""Text sections, word windows and corpus loading.

A document is one row; sections and windows are built inside the row with array
functions, so chunking needs no shuffle and documents spread freely over tasks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 160
OVERLAP = 32
PREAMBLE = "(preamble)"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85  ]"
HEADING = r"^(#{1,4})\s+(.*)$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sections(c: Column) -> Column:
    """Array of (heading, body): the trail of open headings and the text under it.

    A heading closes every heading of its depth or deeper; text before the first
    one is the preamble; empty bodies drop out.
    """
    numbered = F.transform(
        F.split(c, LINE_BREAK),
        lambda x, i: F.struct(
            i.alias("i"), x.alias("line"), F.length(F.regexp_extract(x, HEADING, 1)).alias("depth"),
            F.trim(F.regexp_extract(x, HEADING, 2)).alias("title"),
        ),
    )
    start = F.struct(F.lit(-1).alias("i"), F.lit("").alias("line"), F.lit(0).alias("depth"), F.lit("").alias("title"))

    def cut(lines: Column) -> Column:
        heads = F.concat(F.array(start), F.filter(lines, lambda x: x["depth"] > 0))

        def one(h: Column, k: Column) -> Column:
            upto = F.get(heads, k + 1)["i"]
            last = F.coalesce(upto, F.size(lines))
            body = F.slice(lines, h["i"] + 2, F.greatest(last - h["i"] - 1, F.lit(0)))
            trail = F.aggregate(
                F.slice(heads, 2, k),
                F.array().cast("array<string>"),
                lambda acc, x: F.concat(F.slice(acc, 1, x["depth"] - 1), F.array(x["title"])),
            )
            return F.struct(
                F.when(k == 0, PREAMBLE).otherwise(F.array_join(trail, " > ")).alias("heading"),
                _strip(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("body"),
            )

        return F.filter(F.transform(heads, one), lambda s: s["body"] != "")

    # One named value per row keeps the line array from being rebuilt per use.
    return F.get(F.transform(F.array(numbered), cut), F.lit(0))


def word_windows(c: Column, words: int = WORDS, overlap: int = OVERLAP) -> Column:
    """Array of overlapping word windows; a short text stays as it is."""

    def cut(ws: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0)), F.lit(words - overlap))
        return F.transform(starts, lambda i: F.array_join(F.slice(ws, i + 1, words), " "))

    split = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.get(
        F.transform(
            F.array(split), lambda ws: F.when(F.size(ws) <= words, F.array(c)).otherwise(cut(ws))
        ),
        F.lit(0),
    )


def chunks(docs: DataFrame, source: str, text: str) -> DataFrame:
    """Corpus chunks with source, heading trail and position."""
    s = docs.select(F.col(source).alias("source"), F.posexplode(sections(F.col(text))).alias("section_no", "s"))
    return s.select(
        "source", "section_no", "s.heading", F.posexplode(word_windows(F.col("s.body"))).alias("window_no", "text")
    )


def load_corpus(docs: DataFrame, source: str, text: str) -> DataFrame:
    """Chunks of a corpus; an empty corpus is an error."""
    if docs.isEmpty():
        raise FileNotFoundError("no corpus documents found")
    return chunks(docs, source, text)


def read_corpus(spark, paths: Sequence[str]) -> DataFrame:
    """Whole text files as documents (source, text)."""
    return spark.read.text(list(paths), wholetext=True).select(
        F.col("_metadata.file_name").alias("source"), F.col("value").alias("text")
    )


def context_block(hits: DataFrame, keys: Sequence[str], rank: str, view: str = "_hits") -> DataFrame:
    """Numbered, citable block of each query's hits (hits are already cut to top k)."""
    hits.createOrReplaceTempView(view)
    group = ", ".join(keys)
    entry = f"concat('[', {rank}, '] (', source, ' > ', heading, ')\\n', text)"
    return hits.sparkSession.sql(
        f"select {group}, count(*) as n_hits, listagg({entry}, '\\n\\n') within group (order by {rank}) as block "
        f"from {view} group by {group}"
    )


@F.udtf(returnType="section_no int, heading string, body string")
class SectionTable:
    """Table function of a text's sections; the same rows as ``sections``, for lateral joins.

    Arrow moves whole batches of texts and rows where ``spark.sql.execution.pythonUDTF.arrow.enabled`` is set.
    """

    def eval(self, text: str):
        if text is None:
            return
        trail: list[str] = []
        heading, lines, number = PREAMBLE, [], 0
        for line in [*re.split(LINE_BREAK, text), None]:
            head = None if line is None else re.match(HEADING, line, re.ASCII)
            if line is not None and head is None:
                lines.append(line)
                continue
            body = "\n".join(lines).strip(_SPACES)
            if body:
                yield number, heading, body
                number += 1
            if head is not None:
                trail = [*trail[: len(head[1]) - 1], head[2].strip(" ")]
                heading, lines = " > ".join(trail), []


_SPACES = " \t\n\x0b\f\r"
