"""Whitening and centroid clustering against plain versions."""

import hashlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from swapledger.llm import centroid_clusters as cc
from swapledger.llm import queries as Q
from swapledger.llm import whitening as wh
from tests.compare import diff, duck

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)


@pytest.mark.parametrize("span", [1, 7, 900, 2**20, 2**29])
def test_sliced_scatter_is_exact(span):
    x = np.random.default_rng(span).integers(-span, span, (131, 5)) + 100_000
    x[:, 3] = 17
    sums, cross = wh.sliced_scatter(x)
    big = x.astype(object)
    assert sums.tolist() == big.sum(axis=0).tolist()
    want = big.T @ big
    assert all(cross[i, j] == want[i, j] for i in range(5) for j in range(i, 5))


def test_planes_of_one_row_and_of_no_height():
    sums, cross = wh.sliced_scatter(np.array([[5, -3]]))
    assert sums.tolist() == [5, -3] and cross[0, 1] == -15 and cross[1, 1] == 9


def test_whitening_matches_plain_version(spark):
    ids, e = vectors(spark)
    x = np.floor(1024 * e).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    by = np.argsort(-values)[:8]
    want = c @ axes[:, by] / np.sqrt(values[by])
    out = Q.op12_bit_sliced_whitening(spark, SF).collect()
    assert len(out) == 8 * n and {r.n for r in out} == {n}
    at = {v: i for i, v in enumerate(ids)}
    got = np.zeros((n, 8))
    for r in out:
        got[at[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-9
    gap = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    assert {r.vec_id: r.deviation for r in out} == dict(zip(ids, gap))
    explained = {r.component: r.explained for r in out}
    assert np.allclose([explained[k + 1] for k in range(8)], values[by] / values.sum(), rtol=1e-10)
    error = np.abs(got.T @ got / n - np.eye(8)).max()
    assert {round(r.identity_error, 9) for r in out} == {round(error, 9)}


def test_whitening_edges(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (3, None), (4, [NAN, 1.0]), (5, [INF, 0.0]), (6, [None, 1.0]), (7, []),
            (8, [1.0, 2.0, 3.0]), (9, [0.5, 0.5])]
    df = spark.createDataFrame([(e, i, 1, 1.0, 2) for i, e in rows], "embedding array<float>, vec_id long, dims int, w double, component int")
    out = wh.whitened(df).collect()
    two = [r for r in out if r.dims == 2]
    assert len(two) == 8 and {r.n for r in two} == {4} and sorted({str(r.vec_id) for r in two}) == ["1", "9", "None"]
    assert all(r.whitened is not None for r in two) and two[0].identity_error < 1e-9
    three = [r for r in out if r.dims == 3]
    assert [r.whitened for r in three] == [None] * 3 and {(r.deviation, r.explained, r.identity_error) for r in three} == {(0, None, None)}
    x = [[1024 * a + 100_000 for a in v] for v in ([1, 2], [1, 2], [3, -1], [0.5, 0.5])]
    s = [sum(c) for c in zip(*x)]
    want = sum((4 * a - b) ** 2 for a, b in zip(x[2], s))
    assert {r.deviation for r in two if r.vec_id is None} == {int(want)}
    assert wh.whitened(df.limit(0)).collect() == []
    same = spark.createDataFrame([(i, [0.25, 0.5]) for i in range(3)], "vec_id long, embedding array<float>")
    assert {(r.whitened, r.deviation, r.identity_error) for r in wh.whitened(same).collect()} == {(None, 0, None)}


def test_wide_entries_stay_exact(spark):
    rows = [(i, [float(v), 1.0]) for i, v in enumerate([2**40, -(2**41), 12345, 2**39 + 1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[int(1024 * a) + 100_000 for a in e] for _, e in rows]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((4 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in wh.whitened(df).collect()} == want


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * c)) for c in e]) for i, e in rows]
    hashed = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centres = [x for _, x in hashed[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        members = {}
        for _, x in kept:
            members.setdefault(near(x)[1], []).append(x)
        for j, own in members.items():
            centres[j] = [int(Fraction(sum(c), len(own)).__floor__()) for c in zip(*own)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    sums = {}
    for _, j, d in found:
        sums[j] = sums.get(j, 0) + d
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return sorted((str(i), j, d, sums[j], sum(sums.values()), sha(centres[j])) for i, j, d in found)


def test_clusters_match_plain_version(spark):
    ids, e = vectors(spark)
    assert sorted((str(r[0]), *r[1:]) for r in Q.op13_centroid_expressions(spark, SF).collect()) == plain_clusters(list(zip(ids, e)))


def test_clusters_match_sql(spark):
    assert diff(Q.op13_centroid_expressions(spark, SF), duck(SF), Q.oracle_sql()["op13_centroid_expressions"]) == ""


def test_cluster_edges(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    good += [(None, [0.1, 0.2, 0.3]), (7, [9.0, -9.0, 9.0]), (7, [9.0, -9.0, 9.0]), *[(100 + i, [-0.5, -0.5, -0.5]) for i in range(25)]]
    bad = [(50, None), (51, [NAN, 0.0, 0.0]), (52, [INF, 0.0, 0.0]), (53, [None, 0.0, 0.0]), (54, [1.0, 2.0]), (55, [])]
    df = spark.createDataFrame([(e, i, 0, 0, 0) for i, e in good + bad], "embedding array<double>, vec_id long, cluster int, x int, h int")
    out = cc.clusters(df, dims=3).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", cc.listed_sha256(F.col("centroid")))
    assert sorted((str(r[0]), *r[1:]) for r in out.collect()) == plain_clusters(good)
    few = df.where("vec_id in (1, 2, 3, 54)")
    assert sorted(r.cluster for r in cc.clusters(few, dims=3).collect()) == [0, 1, 2]
    assert cc.clusters(df.limit(0), dims=3).collect() == [] == cc.clusters(df.where("vec_id is null"), dims=3).collect()
