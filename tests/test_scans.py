"""Split scans against plain windows; exact quantiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from swapledger.functions import scans as X


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(600):
        key = 0 if i % 3 else int(rng.integers(1, 6))
        data.append((key, int(rng.integers(0, 200)), i, int(rng.integers(0, 3)), int(i) if rng.random() < 0.2 else None))
    return spark.createDataFrame(data, "k int, pos int, id int, x int, v int").cache()


def bucketed(rows):
    hot = X.hot_keys(rows, "k", F.col("pos"), hot_rows=50)
    out = X.with_buckets(rows, hot, "k", F.col("pos"), "b")
    assert out.where("k = 0").select("b").distinct().count() > 10
    return out


def test_clustered_positions_fill_the_buckets(spark):
    """One key with 90% of the rows, positions in two far clusters."""
    far = F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + F.lit(10**15))
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"), far.alias("pos"))
    hot = X.hot_keys(df, "k", F.col("pos"), hot_rows=2000)
    sizes = [r["count"] for r in X.with_buckets(df, hot, "k", F.col("pos")).where("k = -1").groupBy("bucket").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 3 * 18_000 / 64


def test_ordinal(rows):
    got = X.ordinal_within(bucketed(rows), ["k"], "b", ["pos", "id"], "n")
    want = rows.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy("pos", "id")))
    assert got.join(want.select("id", "w"), "id").where("n <> w").count() == 0
    assert got.count() == rows.count()


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum_and_carry(rows, inclusive):
    frame = Window.partitionBy("k").orderBy("pos", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    b = bucketed(rows)
    s = X.running_sum(b, ["k"], "b", ["pos", "id"], {"s": "x"}, inclusive)
    c = X.carry_last(b, ["k"], "b", ["pos", "id"], {"c": "v"}, inclusive)
    want = rows.withColumn("ws", F.coalesce(F.sum("x").over(frame), F.lit(0))).withColumn("wc", F.last("v", True).over(frame))
    assert s.join(want.select("id", "ws"), "id").where("s <> ws").count() == 0
    assert c.join(want.select("id", "wc"), "id").where("not (c <=> wc)").count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    data = [(0, float(v)) for v in np.concatenate([rng.normal(0, 1, 500), [1e9, -1e9], np.full(200, 0.25)])]
    data += [(1, 4.0)] + [(2, float(v)) for v in rng.integers(0, 3, 50)]
    df = spark.createDataFrame(data, "g int, x double")
    got = {r.g: (r.a, r.b, r.c) for r in X.exact_quantiles(df, ["g"], "x", {"a": 0.05, "b": 0.5, "c": 0.9}).collect()}
    for g in (0, 1, 2):
        want = np.quantile([v for k, v in data if k == g], [0.05, 0.5, 0.9])
        assert np.allclose(got[g], want)


def test_decayed_mean_skips_nulls(spark):
    df = spark.createDataFrame([(1, 2000, 1.0), (1, 2001, None), (1, 2002, 3.0), (2, 2000, None)], "k int, season int, x double")
    got = {(r.k, r.season): r.d for r in X.decayed_mean(df, ["k"], "season", "x", "d").collect()}
    assert got[(1, 2002)] == pytest.approx((3.0 + 0.5 * 1.0) / 1.5)
    assert got[(2, 2000)] is None


def test_quantiles_of_far_apart_clusters(spark):
    rng = np.random.default_rng(9)
    data = [(0, float(v)) for v in np.concatenate([rng.normal(0, 1e-6, 400), rng.normal(1e6, 1e-6, 400)])] + [(1, None)]
    df = spark.createDataFrame(data, "g int, x double")
    got = {r.g: (r.a, r.b) for r in X.exact_quantiles(df, ["g"], "x", {"a": 0.3, "b": 0.5}, buckets=8).collect()}
    assert set(got) == {0}
    assert np.allclose(got[0], np.quantile([v for k, v in data if k == 0], [0.3, 0.5]), rtol=1e-12)


def test_correlation_p_value(spark):
    from swapledger.operators.seasons import correlation_p

    # t = 2.228138852 with 10 degrees of freedom is the published 5% point.
    r = 2.228138852 / (10 + 2.228138852**2) ** 0.5
    df = spark.createDataFrame([(0, r, 12), (1, 0.0, 30), (2, 1.0, 20), (3, None, 30), (4, -r, 12)], "i int, r double, n long")
    got = [x.p for x in df.select("i", correlation_p(F.col("r"), F.col("n")).alias("p")).orderBy("i").collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-8) and got[4] == pytest.approx(0.05, abs=1e-8)
    assert got[1:4] == [1.0, 0.0, None]
