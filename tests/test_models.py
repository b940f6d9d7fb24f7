"""Regression from sufficient statistics, pooling and scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swapledger.operators import draws as D
from swapledger.operators import regress as G
from swapledger.operators import scoring as C
from swapledger.operators import windows_grid as WG


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 2))
    y = 0.7 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(0, 0.5, 300)
    y[:6] += 15
    rows = [(i % 2, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "fold int, z_a double, z_b double, z_y double").cache()


def test_least_squares_and_subsets(data):
    fits = G.solve(G.gram(data, ["fold"], ["z_a", "z_b"], "z_y"), ["fold"], ["z_a", "z_b"], {"both": ["z_a", "z_b"], "a": ["z_a"]}, prior_sd=None)
    pdf = data.toPandas()
    for r in fits.collect():
        g = pdf[pdf.fold == r.fold]
        cols = ["z_a", "z_b"] if r.spec == "both" else ["z_a"]
        xx = np.column_stack([np.ones(len(g)), g[cols]])
        assert np.allclose(r.beta, np.linalg.lstsq(xx, g.z_y, rcond=None)[0])


def test_robust_fit_resists_outliers(data):
    xs = ["a", "b"]
    robust = {r.fold: r.beta for r in G.robust_fit(data, ["fold"], xs, passes=8).collect()}
    for fold in (0, 1):
        assert abs(robust[fold][1] - 0.7) < 0.12 and abs(robust[fold][2] + 0.2) < 0.12


def test_shrinkage_pulls_small_groups_harder(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(rng.normal(g * 0.5, 1))) for g, n in ((0, 200), (1, 200), (2, 5), (3, 200)) for _ in range(n)]
    out = {r.g: r for r in G.shrink(spark.createDataFrame(rows, "g int, x double"), "g", "x").collect()}
    m = np.mean([v for _, v in rows])
    ratio = {g: r.effect / (r["mean"] - m) for g, r in out.items()}
    assert ratio[2] < ratio[3] and all(0 <= k <= 1 for k in ratio.values())


def test_crps(spark):
    df = spark.createDataFrame([([2.0], 5.0), ([1.0, 2.0, 4.0], 2.5)], "d array<double>, y double")
    one, many = [r[0] for r in df.select(C.crps_draws(F.col("d"), F.col("y"))).collect()]
    assert one == pytest.approx(3.0)
    d = np.array([1.0, 2.0, 4.0])
    assert many == pytest.approx(np.mean(np.abs(d - 2.5)) - 0.5 * np.mean(np.abs(d[:, None] - d[None, :])))
    assert many >= 0


def test_folds_are_disjoint(spark):
    from swapledger.operators.seasons import walk_forward_folds, with_folds

    df = spark.createDataFrame([(s, 1.0) for s in range(2000, 2010)], "season int, y double")
    folds = walk_forward_folds(df, "y")
    assert [(r.train_end, r.test_start, r.test_end) for r in folds.orderBy("fold").collect()] == [(2004, 2005, 2006), (2006, 2007, 2008)]
    parts = with_folds(df, folds)
    assert parts.where("part = 'train'").join(parts.where("part = 'test'"), ["fold", "season"]).count() == 0


def test_factor_of_any_covariance():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(4, 4))
    for cov in (a @ a.T, np.zeros((3, 3)), np.diag([1.0, 0.0, 2.0]), np.outer([1.0, 2.0], [1.0, 2.0])):
        low = D.lower_factor(cov)
        assert np.allclose(low @ low.T, cov) and np.allclose(low, np.tril(low))


def test_draws_have_the_posterior_moments_and_repeat(data):
    xs = ["z_a", "z_b"]
    fits = G.solve(G.gram(data, ["fold"], xs, "z_y"), ["fold"], xs)
    rows = sorted((r.fold, r.draw, tuple(r.coef), r.noise) for r in D.posterior_draws(fits, ["fold"], 4000, seed=3).collect())
    assert rows == sorted((r.fold, r.draw, tuple(r.coef), r.noise) for r in D.posterior_draws(fits.repartition(3), ["fold"], 4000, seed=3).collect())
    assert rows[0] != sorted((r.fold, r.draw, tuple(r.coef), r.noise) for r in D.posterior_draws(fits, ["fold"], 1, seed=4).collect())[0]
    for fit in fits.collect():
        draws = np.array([c for f, _, c, _ in rows if f == fit.fold])
        cov = np.array(fit["cov"]).reshape(3, 3)
        sd = np.sqrt(np.diag(cov))
        # Five standard errors of a mean and of a covariance.
        assert np.all(np.abs(draws.mean(axis=0) - fit.beta) < 5 * sd / np.sqrt(4000))
        assert np.all(np.abs(np.cov(draws.T) - cov) < 5 * np.outer(sd, sd) * np.sqrt(2 / 4000))
        noise = [e for f, _, _, e in rows if f == fit.fold]
        assert abs(np.mean(noise)) < 5 / np.sqrt(4000) and abs(np.var(noise) - 1) < 5 * np.sqrt(2 / 4000)


def test_windows_leave_out_rows_without_a_whole_window(spark):
    rng = np.random.default_rng(6)
    rows = [(s, float(rng.normal()), *map(float, rng.normal(size=3))) for s in range(2000, 2010) for _ in range(12)]
    df = spark.createDataFrame([(1, *r, 2010) for r in rows], "k int, season int, z_x double, v_1 double, v_2 double, v_3 double, last int")
    fits = WG.solve_windows(WG.window_grams(df, ["k"], ["z_x"], ["v"], "last", 3), ["k"], ["z_x"], ["v"], {"x": ["z_x"]}, [0.3], 3)
    got = {(r.window_start, r.window_end): r for r in fits.collect()}
    assert len(got) == 6
    for (s, e), r in got.items():
        own = [x for x in rows if x[0] + e <= 2010]
        y = np.array([sum(x[1 + k] for k in range(s, e + 1)) for x in own])
        z = (y - y.mean()) / y.std()
        xx = np.column_stack([np.ones(len(own)), [x[1] for x in own]])
        beta, _, s2 = G._solve(xx.T @ xx, xx.T @ z, float(z @ z), len(own), np.array([1.0, 1 / 0.09]), 3)
        assert r.n == len(own) and r.beta["z_x"] == pytest.approx(beta[1]) and r.s2 == pytest.approx(s2)


def test_crps_sorts_the_draws_once(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0], 1.5), ([2.0], None), (None, 1.0)], "d array<double>, y double")
    scored = df.select(C.crps_draws(F.col("d"), F.col("y")).alias("c"))
    assert [r.c for r in scored.collect()] == [pytest.approx(2.5 / 3 - 4 / 9), None, None]
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") == 1 and "array_sort" not in plan
