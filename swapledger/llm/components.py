"""Connected components of an edge table by alternating stars, in written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swapledger.llm.common import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b longs): root is the smallest node it reaches.

    Each round links every node's larger neighbours to its smallest one (large star), then
    its smaller neighbours and itself to their smallest (small star), until nothing
    changes.  Rounds are written to the shared folder, so a lost executor costs one round.
    Only counts and sums reach the driver.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = large.groupBy("a").agg(F.min("b").alias("low"))
        linked = large.join(small, "a")
        edges = written(
            linked.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
            .union(small.select("a", F.col("low").alias("b"))).distinct(),
            "edges",
        )
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()
