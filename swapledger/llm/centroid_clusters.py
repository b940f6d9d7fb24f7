"""Centroid clustering of embeddings in JVM expressions.

Entries become whole numbers, floor(``SCALE`` * c), so every step is exact and the rows of a
group may be added in any order.  The current centroids are literal arrays: ``zip_with`` and
``aggregate`` give a vector's squared distance to each, ``array_min`` over (distance, number)
structs chooses the nearest, the smaller number on ties.  A round's update is one aggregate
with a sum per dimension, combined in every task before the shuffle, so a cluster with most
of the rows moves as one partial row a task.  Only the centroids (``k`` x dimensions) and the
clusters' totals reach the driver.

Defined results: vectors with another number of entries, or with null, NaN or infinite ones,
take no part; a vector with a null id is clustered but starts no cluster; of equal ids the
smaller vector starts first; fewer than ``k`` vectors with ids start fewer clusters, and
without any there is no result; equal vectors share a cluster; an empty table gives an empty
result.  Only the two named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swapledger.llm.common import written

SCALE, DIMS, K, ROUNDS = 64, 64, 16, 3


def whole(vectors: DataFrame, dims: int = DIMS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and x (whole numbers) of the vectors that take part."""
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
        .where(F.size("v") == dims).where(usable)
        .select("vec_id", F.transform("v", lambda c: F.floor(F.lit(float(SCALE)) * c)).alias("x"))
    )


def first_centroids(rows: DataFrame, k: int = K, seed: str = "1") -> list[list[int]]:
    """The ``k`` vectors whose ids have the smallest hashes, in their order."""
    hashed = F.sha2(F.concat_ws(":", F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h")
    return [list(r["x"]) for r in rows.where("vec_id is not null").select(hashed, "x").orderBy("h", "x").limit(k).collect()]


def literal(numbers: list[int]) -> Column:
    """Literal long array, parsed in one piece."""
    return F.expr(f"array({', '.join(f'{v}L' for v in numbers)})")


def squared_distance(x: Column, centroid: list[int]) -> Column:
    """Exact squared distance of a vector to a literal one."""
    return F.aggregate(F.zip_with(x, literal(centroid), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, d: s + d)


def nearest(x: Column, centroids: list[list[int]]) -> Column:
    """(distance, cluster) of the nearest centroid."""
    return F.array_min(F.array(*[
        F.struct(squared_distance(x, c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)
    ]))


def floored(total: str, count: str) -> Column:
    """Exact floor of the quotient of two long columns."""
    return F.expr(f"({total} - pmod({total}, {count})) div {count}")


def moved(rows: DataFrame, centroids: list[list[int]], dims: int = DIMS) -> list[list[int]]:
    """Centroids after one round: floors of the means of their vectors; empty ones stay."""
    placed = rows.select(nearest(F.col("x"), centroids)["cluster"].alias("cluster"), *[F.expr(f"x[{d}]").alias(f"x{d}") for d in range(dims)])
    sums = placed.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(f"x{d}").alias(f"s{d}") for d in range(dims)])
    means = sums.select("cluster", *[floored(f"s{d}", "n").alias(f"m{d}") for d in range(dims)]).collect()
    out = list(centroids)
    for r in means:
        out[r["cluster"]] = [int(r[f"m{d}"]) for d in range(dims)]
    return out


def clusters(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (long array), one row per vector that takes part."""
    rows = written(whole(vectors, dims, vec_id, embedding), "whole-vectors")
    centroids = first_centroids(rows, k)
    if not centroids:
        schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = moved(rows, centroids, dims)
    placed = written(rows.select("vec_id", nearest(F.col("x"), centroids).alias("near")).select("vec_id", "near.*"), "clusters")
    # At most k rows.
    totals = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    whole_sum = F.lit(sum(totals.values())).cast("long")
    facts = F.array(*[
        F.struct(F.lit(totals.get(i, 0)).cast("long").alias("inertia"), literal(c).alias("centroid"))
        for i, c in enumerate(centroids)
    ])
    mine = F.get(facts, F.col("cluster"))
    return placed.select("vec_id", "cluster", "distance", mine["inertia"].alias("cluster_inertia"), whole_sum.alias("inertia"),
                         mine["centroid"].alias("centroid"))


def listed_sha256(centroid: Column) -> Column:
    """Lower-case hex of a vector's entries as decimal numbers joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda v: v.cast("string")), ",").cast("binary"), 256)
