"""Exact top-k search against brute force over all pairs, where blocks can and cannot be skipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swapledger.llm import block_topk


def brute(ids, vectors, asked, k):
    whole = np.floor(np.array(vectors, float) * 256).astype(int)
    out = []
    for q, i in enumerate(ids):
        if asked(i):
            scores = sorted((-int(whole[q] @ whole[j]), ids[j]) for j in range(len(ids)) if ids[j] != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.fixture
def small(monkeypatch):
    """Groups of two blocks of 256 vectors of 4 components."""
    monkeypatch.setattr(block_topk, "GROUP_BYTES", 2 * 256 * 4 * 8)


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")


def got(out):
    return sorted(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect())


def test_ranges_of_different_size_are_skipped(spark, small):
    rng = np.random.default_rng(1)
    ids = list(range(4000))
    # Vectors grow with their id, so only the last blocks can hold a best row.
    vectors = rng.random((4000, 4)) * (1 + np.arange(4000)[:, None] / 100)
    df = frame(spark, ids, vectors)
    asked = F.col("vec_id") % 50 == 0
    assert got(block_topk.top_k(df, asked, 5)) == brute(ids, vectors, lambda i: i % 50 == 0, 5)
    report = block_topk.pruning(df, asked, 5).collect()
    assert len(report) == 80
    assert sum(r["scored"] for r in report) < 0.5 * sum(r["blocks"] for r in report)
    assert all(1 <= r["scored"] <= r["blocks"] for r in report)


def test_signs_and_ties(spark, small):
    rng = np.random.default_rng(2)
    ids = rng.permutation(3000).tolist()
    # Few different vectors: most scores tie, also at the floor.
    vectors = rng.integers(-2, 3, (3000, 4)) / 4
    df = frame(spark, ids, vectors)
    assert got(block_topk.top_k(df, F.col("vec_id") % 50 == 0, 5)) == brute(ids, vectors, lambda i: i % 50 == 0, 5)


def test_fewer_rows_than_k(spark):
    ids, vectors = [0, 50, 7], [[1.0, -1.0], [0.5, 0.25], [-3.0, 2.0]]
    df = frame(spark, ids, vectors)
    assert got(block_topk.top_k(df, F.col("vec_id") % 50 == 0, 5)) == brute(ids, vectors, lambda i: i % 50 == 0, 5)


def test_empty_vectors_score_zero(spark):
    df = frame(spark, [0, 1, 2], [[], [], []])
    assert got(block_topk.top_k(df, F.col("vec_id") == 0, 5)) == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_lengths_do_not_meet(spark, small):
    df = frame(spark, [0, 1, 50, 51], [[1.0], [2.0], [1.0, 1.0], [0.5, 0.5]])
    assert got(block_topk.top_k(df, F.col("vec_id") % 50 == 0, 5)) == [(0, 1, 1, 256 * 512), (50, 1, 51, 256 * 128 * 2)]
