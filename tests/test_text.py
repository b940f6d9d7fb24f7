"""Sections, windows, corpus."""

import pytest
from pyspark.sql import functions as F

from swapledger.operators import text as X


def sections(spark, md):
    row = spark.createDataFrame([(md,)], "t string").select(X.sections(F.col("t")).alias("s")).first()
    return [(s.heading, s.body) for s in row.s]


def test_heading_trail(spark):
    md = "intro\n# A\none\n## B\ntwo\n### C\n\n#### D\nthree\n# E\nfour\n##### not a heading"
    assert sections(spark, md) == [
        ("(preamble)", "intro"), ("A", "one"), ("A > B", "two"), ("A > B > C > D", "three"),
        ("E", "four\n##### not a heading"),
    ]


def test_skipped_depth(spark):
    # The trail is cut by length: a first heading of depth 3 sits at place 1.
    assert sections(spark, "### C\nx\n## B\ny") == [("C", "x"), ("C > B", "y")]


def test_windows(spark):
    short, long = "a  b c", " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(short,), (long,)], "t string").select(X.word_windows(F.col("t")).alias("w"))
    a, b = [r.w for r in df.collect()]
    assert a == [short]
    assert [w.split()[0] for w in b] == ["w0", "w128", "w256", "w384"]
    assert len(b[0].split()) == 160 and b[0].split()[-32:] == b[1].split()[:32]
    assert b[3].split()[-1] == "w399"


def test_empty_corpus(spark):
    with pytest.raises(FileNotFoundError):
        X.load_corpus(spark.createDataFrame([], "source string, text string"), "source", "text")
