"""Statistical jobs on tables (STA)."""

from __future__ import annotations

from pyspark.sql import functions as F

from swapledger.functions.scans import exact_quantiles
from swapledger.operators import draws as D
from swapledger.operators import regress as G
from swapledger.operators import scoring as C
from swapledger.operators import windows_grid as WG
from swapledger.operators.facts import career_start
from swapledger.operators.offsets import offset_window
from swapledger.operators.seasons import walk_forward_folds, with_folds
from swapledger.plans.linear_sql import gram_columns, ridge, solved
from swapledger.plans.q_aggregates import _DELTA, deltas, rounded
from swapledger.plans.q_scalars import cdf_sql
from swapledger.plans.registry import query


def model_rows(t):
    """One row per (event, receiver): three features and two outcomes.

    Folds, training statistics, Gram sums and predictions all read these rows, so
    they are written once instead of recomputing the joins for each.
    """
    w = offset_window(t.trade.select("event_id", "to_team", "season", "player_id"), t.psv, [-1, 1], ["value"])
    w = offset_window(w, t.metric, [-1, 1], ["metric_a"]).join(career_start(t.psv), "player_id", "left")
    rows = w.groupBy("event_id", "to_team", "season").agg(
        F.avg("value_t_minus_1").alias("q"),
        F.avg((F.col("season") - F.col("first_season")).cast("double")).alias("ex"),
        F.avg("metric_a_t_minus_1").alias("ma"),
        F.avg("value_t_plus_1").alias("y"),
        F.avg(F.col("metric_a_t_plus_1") - F.col("metric_a_t_minus_1")).alias("y2"),
    )
    return G.materialise(rows, "model-rows")


def folded(t, xs=("q", "ma")):
    """Train and test rows of every fold, standardised by the fold's training rows."""
    return folded_rows(model_rows(t), "y", xs)


def folded_rows(rows, y, xs=("q", "ma")):
    """The same for one outcome of model rows that are already there."""
    m = rows.where(F.col(y).isNotNull())
    parts = with_folds(m, walk_forward_folds(m, y, min_train=3, width=1))
    stats = G.train_stats(parts.where("part = 'train'"), ["fold"], list(xs), y)
    return G.standardise(parts, stats, ["fold"], list(xs), y)


def single_fits(t, z=None):
    """Ridge fits of each feature alone, per fold, from one Gram pass."""
    z = folded(t) if z is None else z
    train = z.where("part = 'train'")
    return G.solve(G.gram(train, ["fold"], ["z_q", "z_ma"], "z_y"), ["fold"], ["z_q", "z_ma"], {"q": ["z_q"], "ma": ["z_ma"]})


@query("STA-01", "least_squares", """
with m as (select q, ex, y, season from v_model where q is not null and ex is not null and y is not null), tr as (select * from m where season < 1999),
  c as (select count(*) as n, var_pop(q) as s11, var_pop(ex) as s22, covar_pop(q, ex) as s12, covar_pop(q, y) as s1, covar_pop(ex, y) as s2, avg(q) as m1, avg(ex) as m2, avg(y) as my from tr),
  b as (select *, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) as b1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) as b2 from c),
  p as (select m.*, my - b1 * m1 - b2 * m2 + b1 * q + b2 * ex as pred from m, b)
select round((select my - b1 * m1 - b2 * m2 from b), 5) as intercept, round((select b1 from b), 5) as beta_q, round((select b2 from b), 5) as beta_ex,
  round(avg(abs(pred - y)) filter (where season < 1999), 5) as train_mae, round(avg(abs(pred - y)) filter (where season >= 1999), 5) as test_mae,
  round(avg(abs(y)) filter (where season >= 1999), 5) as zero_mae, count(*) filter (where season < 1999) as n_train, count(*) filter (where season >= 1999) as n_test from p""")
def least_squares(t):
    m = model_rows(t).dropna(subset=["q", "ex", "y"])
    train = F.col("season") < 1999
    fit = G.solve(G.gram(m.where(train).withColumn("k", F.lit(1)), ["k"], ["q", "ex"], "y"), ["k"], ["q", "ex"], prior_sd=None)
    beta = fit.select("beta").scalar()
    p = m.withColumn("b", beta).withColumn("pred", F.col("b")[0] + F.col("b")[1] * F.col("q") + F.col("b")[2] * F.col("ex"))
    err = F.abs(F.col("pred") - F.col("y"))
    r = lambda c, n: F.round(c, 5).alias(n)
    return p.agg(
        r(F.first(F.col("b")[0]), "intercept"), r(F.first(F.col("b")[1]), "beta_q"), r(F.first(F.col("b")[2]), "beta_ex"),
        r(F.avg(F.when(train, err)), "train_mae"), r(F.avg(F.when(~train, err)), "test_mae"), r(F.avg(F.when(~train, F.abs("y"))), "zero_mae"),
        F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"))


@query("STA-02", "impute_by_fold", """
with f as (select fold, coalesce(avg(q), 0) as mq, coalesce(avg(ma), 0) as mm from v_part where part = 'train' group by 1)
select p.fold, p.part, p.event_id, p.to_team, round(coalesce(p.q, mq), 6) as q, round(coalesce(p.ma, mm), 6) as ma, round(p.y, 6) as y from v_part p join f on f.fold = p.fold""")
def impute_by_fold_q(t):
    m = model_rows(t).where(F.col("y").isNotNull())
    parts = with_folds(m, walk_forward_folds(m, "y", min_train=3, width=1))
    return rounded(G.impute_by_fold(parts, ["fold"], ["q", "ma"]).select("fold", "part", "event_id", "to_team", "q", "ma", "y"), "q", "ma", "y")


@query("STA-03", "ridge_posterior", """
select fold, feature, n, round(b1, 6) as beta, round(sqrt(v11), 6) as sd, round(s2, 6) as s2 from v_ridge""")
def ridge_posterior(t):
    c = G.coefficients(single_fits(t), ["fold"]).where("feature <> 'intercept'")
    return c.select("fold", F.col("spec").alias("feature"), "n", F.round("beta", 6).alias("beta"), F.round("sd", 6).alias("sd"), F.round("s2", 6).alias("s2"))


_ROBUST_XS = ["zq", "zma", "zex"]


def _robust_many_sql(passes: int, nu: float = 4.0) -> str:
    """The Student-t fit on three features: a ridge start, then re-weighted systems solved by elimination."""
    p, prior = 4, ["1.0", *["1.0 / 0.09"] * 3]
    res = "(zy - b_0 - " + " - ".join(f"b_{i + 1} * {x}" for i, x in enumerate(_ROBUST_XS)) + ")"
    out = [f"""ex0 as (select fold, coalesce(avg(ex), 0) as m from v_part where part = 'train' group by 1),
  ex1 as (select p.fold, max(m) as m, stddev_samp(coalesce(ex, m)) as s from v_part p join ex0 on ex0.fold = p.fold where part = 'train' group by 1),
  rz as (select z.fold, zq, zma, zy, greatest(-5.0, least(5.0, (coalesce(p.ex, e.m) - e.m) / case when e.s = 0 then 1.0 else e.s end)) as zex
    from v_z z join v_part p on p.fold = z.fold and p.event_id = z.event_id and p.to_team = z.to_team and p.season = z.season join ex1 e on e.fold = z.fold where z.part = 'train'),
  w0 as (select fold, count(*) as n, {gram_columns(_ROBUST_XS, 'zy')} from rz group by 1)""", ridge("k0", "w0", p, prior)]
    for k in range(passes):
        out.append(f"""w{k + 1} as (select q.fold, count(*) as n, sum(w * e * e) / count(*) as s2, {gram_columns(_ROBUST_XS, 'zy', 'w')}
    from (select rz.*, {res} as e, {nu + 1} / ({nu} + {res} * {res} / s2) as w from rz join k{k} f on f.fold = rz.fold) q group by 1)""")
        out.append(solved(f"k{k + 1}", f"w{k + 1}", p, prior, "s2"))
    return ",\n  ".join(out)


def _robust_rows(last: str) -> str:
    return " union all ".join(
        f"select fold, '{name}' as feature, n, round(b_{i}, 6) as beta, round(sqrt(v_{i}_{i}), 6) as sd, round(s2, 6) as s2 from {last}"
        for i, name in enumerate(["intercept", "z_q", "z_ma", "z_ex"]))


@query("STA-03", "robust_posterior", f"with {_robust_many_sql(3)} {_robust_rows('k3')}")
def robust_posterior(t):
    """Student-t fit on all features; the oracle writes out its passes and eliminations."""
    z = folded(t, ("q", "ma", "ex")).where("part = 'train'")
    c = G.coefficients(G.robust_fit(z, ["fold"], ["q", "ma", "ex"], passes=3), ["fold"])
    return rounded(c.select("fold", "feature", "n", "beta", "sd", "s2"), "beta", "sd", "s2")


def _robust_sql(passes: int) -> str:
    """Re-weighting passes of the one-feature Student-t fit, one pair of CTEs each."""
    out = ["f0 as (select fold, b0, b1, s2, sqrt(v11) as sd from v_ridge where feature = 'q')"]
    for i in range(passes):
        out.append(f"""a{i + 1} as (select fold, sum(w * e * e) / count(*) as s, sum(w) as w0, sum(w * x) as wx, sum(w * x * x) as wxx, sum(w * y) as wy, sum(w * x * y) as wxy from (
    select f.fold, zq as x, zy as y, zy - b0 - b1 * zq as e, 5.0 / (4.0 + (zy - b0 - b1 * zq) * (zy - b0 - b1 * zq) / s2) as w from v_z z join f{i} f on f.fold = z.fold where part = 'train') group by 1)""")
        out.append(f"""f{i + 1} as (select fold, (cc * wy / s - bb * wxy / s) / (aa * cc - bb * bb) as b0, (aa * wxy / s - bb * wy / s) / (aa * cc - bb * bb) as b1, s as s2, sqrt(aa / (aa * cc - bb * bb)) as sd
    from (select *, w0 / s + 1 as aa, wx / s as bb, wxx / s + 1 / 0.09 as cc from a{i + 1}))""")
    return ",\n  ".join(out)


@query("STA-03", "robust_single", f"""
with {_robust_sql(3)}
select fold, round(b1, 6) as beta, round(sd, 6) as sd, round(s2, 6) as s2 from f3""")
def robust_single(t):
    """The Student-t fit on one feature, whose passes SQL can write out."""
    z = folded(t, ("q",)).where("part = 'train'")
    c = G.coefficients(G.robust_fit(z, ["fold"], ["q"], passes=3), ["fold"]).where("feature <> 'intercept'")
    return rounded(c.select("fold", "beta", "sd", "s2"), "beta", "sd", "s2")


@query("STA-04", "two_regime_noise", """
with r as (select z.fold, z.season >= 1997 as late, zq as x, zy as y, zy - b0 - b1 * zq as e from v_z z join v_ridge f on f.fold = z.fold and f.feature = 'q' where part = 'train'),
  n as (select fold, avg(e * e) filter (where not late) as s0, avg(e * e) filter (where late) as s1 from r group by 1),
  a as (select r.fold, max(s0) as s0, max(s1) as s1, sum(w) as w, sum(w * x) as wx, sum(w * x * x) as wxx, sum(w * y) as wy, sum(w * x * y) as wxy
    from (select r.*, n.s0, n.s1, 1 / case when late then n.s1 else n.s0 end as w from r join n on n.fold = r.fold) r group by 1),
  d as (select *, (w + 1) * (wxx + 1 / 0.09) - wx * wx as det from a)
select fold, round(((w + 1) * wxy - wx * wy) / det, 6) as beta, round(sqrt((w + 1) / det), 6) as sd, round(s0, 6) as s2_early, round(s1, 6) as s2_late from d""")
def two_regime_noise(t):
    z = folded(t, ("q",)).where("part = 'train'")
    fit, noise = G.two_regime_fit(z, ["fold"], ["q"], F.col("season") >= 1997)
    c = G.coefficients(fit, ["fold"]).where("feature <> 'intercept'").select("fold", "beta", "sd")
    return rounded(c.join(noise, "fold"), "beta", "sd", "s2_early", "s2_late")


def shrink_sql(source: str, group: str, value: str, outer: str = "one") -> str:
    """CTEs of the pooled effects of ``group`` inside ``outer``; result in ``pooled``."""
    return f"""g as (select {outer} as o, {group} as grp, count(*) as n, avg({value}) as mean, coalesce(var_samp({value}), 0) as v from {source} where {value} is not null group by 1, 2),
  tt as (select o, sum(n) as nn, count(*) as gg, sum(n * mean) / sum(n) as m, sum((n - 1) * v) as w, sum(n * n) as n2 from g group by 1),
  bb as (select g.o, sum(n * (mean - m) * (mean - m)) as b from g join tt on tt.o = g.o group by 1),
  pa as (select tt.*, w / nullif(nn - gg, 0) as s2, greatest(0.0, (b - (gg - 1) * (w / nullif(nn - gg, 0))) / nullif(nn - n2 / nn, 0)) as tau2 from tt join bb on bb.o = tt.o),
  kk as (select g.*, pa.m, s2, coalesce(tau2 / nullif(tau2 + s2 / g.n, 0), 0) as k from g join pa on pa.o = g.o),
  pooled as (select o, grp, n, mean, k * (mean - m) as effect, sqrt(k * s2 / n) as sd from kk)"""


@query("STA-05", "group_shrinkage", f"""
with {_DELTA}, src as (select *, 1 as one from d), {shrink_sql('src', 'to_team', 'delta')}
select grp as to_team, n, round(mean, 6) as mean, round(effect, 6) as effect, round(sd, 6) as sd from pooled""")
def group_shrinkage(t):
    return rounded(G.shrink(deltas(t), "to_team", "delta"), "mean", "effect", "sd")


@query("STA-05", "nested_shrinkage", f"""
with {_DELTA}, src as (select d.*, r.regime_id from d join v_regime r on r.team_id = d.from_team and r.season = d.season), {shrink_sql('src', 'regime_id', 'delta', 'from_team')}
select o as from_team, grp as regime_id, n, round(mean, 6) as mean, round(effect, 6) as effect, round(sd, 6) as sd from pooled""")
def nested_shrinkage(t):
    r = t.regime.select(F.col("team_id").alias("from_team"), "season", "regime_id")
    return rounded(G.shrink(deltas(t).join(r, ["from_team", "season"]), "regime_id", "delta", ["from_team"]), "mean", "effect", "sd")


_ORIGIN = f"""{_DELTA}, ols as (select regr_slope(delta, pre) as b1, regr_intercept(delta, pre) as b0 from d), res as (select d.*, 1 as one, delta - b0 - b1 * pre as r from d, ols)"""


def origin_residuals(t):
    """Change not explained by the prior level, from a least-squares pass."""
    d = G.materialise(deltas(t).select("from_team", "to_team", "season", "pre", "delta"), "deltas")
    fit = d.agg(F.struct(F.regr_slope("delta", "pre").alias("b1"), F.regr_intercept("delta", "pre").alias("b0"))).scalar()
    return d.withColumn("f", fit).withColumn("r", F.col("delta") - F.col("f.b0") - F.col("f.b1") * F.col("pre"))


@query("STA-06", "origin_effects", f"""
with {_ORIGIN}, {shrink_sql('res', 'from_team', 'r')}
select grp as from_team, n, round(effect, 6) as effect, round(sd, 6) as sd, round(coalesce({cdf_sql('-effect / nullif(sd, 0)')}, 0.5), 6) as p_negative,
  row_number() over (order by round(effect, 9), grp) as rank from pooled""")
def origin_effects(t):
    from pyspark.sql import Window

    e = G.tail_mass(G.shrink(G.materialise(origin_residuals(t).select("from_team", "r"), "residuals"), "from_team", "r"))
    w = Window.orderBy(F.round("effect", 9), "from_team")  # one row per team
    return rounded(e.withColumn("rank", F.row_number().over(w).cast("long")).drop("mean"), "effect", "sd", "p_negative")


@query("STA-07", "pairwise_probability", f"""
with {_DELTA}, src as (select to_team, season % 3 as metric, delta from d), {shrink_sql('src', 'to_team', 'delta', 'metric')}, an as (select max(grp) as a from pooled),
  pr as (select x.grp, x.o, coalesce({cdf_sql('(x.effect - y.effect) / nullif(sqrt(x.sd * x.sd + y.sd * y.sd), 0)')}, 0.5) as p from pooled x join an on x.grp <> an.a join pooled y on y.grp = an.a and y.o = x.o)
select grp as to_team, count(*) as n_metrics, count(*) filter (where p >= 0.6) as n_above, round(avg(p), 6) as mean_p,
  case when count(*) filter (where p >= 0.6) >= 2 then 'ROBUST' when count(*) filter (where p >= 0.6) = 1 then 'partial' else 'no' end as flag from pr group by 1""")
def pairwise_probability(t):
    d = G.materialise(deltas(t).select("to_team", "delta", (F.col("season") % 3).alias("metric")), "deltas")
    e = G.materialise(G.shrink(d, "to_team", "delta", ["metric"]), "pooled")
    p = G.pairwise_against(e, "to_team", t.trade.agg(F.max("to_team")).scalar())
    above = F.count_if(F.col("p_less") >= 0.6)
    return p.groupBy("to_team").agg(
        F.count("*").alias("n_metrics"), above.alias("n_above"), F.round(F.avg("p_less"), 6).alias("mean_p"),
        F.when(above >= 2, "ROBUST").when(above == 1, "partial").otherwise("no").alias("flag"))


_SUMM = f"""sm as (select fold, feature, n, b1 as beta, sqrt(v11) as sd, b1 - 1.645 * sqrt(v11) as p05, b1 + 1.645 * sqrt(v11) as p95, {cdf_sql('abs(b1) / sqrt(v11)')} as mass from v_ridge)"""


@query("STA-08", "coefficient_summary", f"""
with {_SUMM} select fold, feature, round(beta, 6) as beta, round(p05, 6) as p05, round(p95, 6) as p95, round(mass, 6) as mass, (p05 > 0 or p95 < 0) and mass >= 0.95 as credible from sm""")
def coefficient_summary_q(t):
    s = G.coefficient_summary(G.coefficients(single_fits(t), ["fold"]).where("feature <> 'intercept'"))
    return rounded(s.select("fold", F.col("spec").alias("feature"), "beta", "p05", "p95", "mass", "credible"), "beta", "p05", "p95", "mass")


_PRED = """pr as (select z.*, m_y + s_y * (b0 + b1 * zq) as pred, s_y * sqrt(s2 + v00 + 2 * v01 * zq + v11 * zq * zq) as psd from v_z z join v_ridge r on r.fold = z.fold and r.feature = 'q' where part = 'test')"""


def predictions(t):
    z = folded(t)
    fits = single_fits(t, z).where("spec = 'q'")
    return G.predict(z.where("part = 'test'"), fits, ["fold"], ["q"])


@query("STA-09", "predictive_bands", f"""
with {_PRED} select fold, event_id, to_team, round(y, 6) as y, round(pred, 6) as pred, round(psd, 6) as pred_sd, round(pred - 1.645 * psd, 6) as p05, round(pred + 1.645 * psd, 6) as p95 from pr""")
def predictive_bands(t):
    return rounded(predictions(t).select("fold", "event_id", "to_team", "y", "pred", "pred_sd", "p05", "p95"), "y", "pred", "pred_sd", "p05", "p95")


@query("STA-10", "draw_summary", f"""
with {_DELTA}, s as (select to_team, round(delta, 4) as v, row_number() over (partition by to_team order by md5(cast(event_id as varchar) || '-' || cast(leg_index as varchar))) as r from d)
select d.to_team, count(*) as n, round(avg(delta), 6) as mean, round(stddev_pop(delta), 6) as sd, round(quantile_cont(delta, 0.05), 6) as p05, round(quantile_cont(delta, 0.25), 6) as p25, round(median(delta), 6) as p50,
  round(quantile_cont(delta, 0.75), 6) as p75, round(quantile_cont(delta, 0.95), 6) as p95, max(k.c) as n_sample, round(max(k.sm), 4) as sample_sum
from d join (select to_team, count(*) as c, sum(v) as sm from s where r <= 20 group by 1) k on k.to_team = d.to_team group by 1""")
def draw_summary(t):
    w = offset_window(t.numbered_trade, t.psv, [-1, 1], ["value"])
    d = w.withColumn("delta", F.col("value_t_plus_1") - F.col("value_t_minus_1")).where(F.col("delta").isNotNull())
    # Quantiles, sample and moments read the same written rows.
    d = G.materialise(d.select("to_team", "event_id", "leg_index", "delta"), "deltas")
    q = exact_quantiles(d, ["to_team"], "delta", {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    s = C.draw_sample(d, ["to_team"], "delta", ["event_id", "leg_index"], 20)
    basic = d.groupBy("to_team").agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.stddev_pop("delta").alias("sd"))
    out = basic.join(q, "to_team").join(s, "to_team").select(
        "to_team", "n", "mean", "sd", "p05", "p25", "p50", "p75", "p95", F.size("sample").cast("long").alias("n_sample"),
        F.round(F.aggregate("sample", F.lit(0.0), lambda a, x: a + x), 4).alias("sample_sum"))
    return rounded(out, "mean", "sd", "p05", "p25", "p50", "p75", "p95")


#: Draws of a posterior for its summary, and of a row's prediction.
DRAWS, ROW_DRAWS, CRPS_DRAWS, SEED = 2000, 200, 60, 7
#: Every so many draws one is kept.
STEP = 50


def _normal_sql(*parts: str) -> str:
    at = "concat_ws('|', " + ", ".join(parts) + ")"
    u = lambda tag: f"((cast(('0x' || substr(md5({at} || '|{tag}'), 1, 13)) as ubigint) + 0.5) / 4503599627370496.0)"
    return f"(sqrt(-2 * ln({u('a')})) * cos(2 * pi() * {u('b')}))"


def _draws_sql(n: int) -> str:
    """Draws of the one-feature posteriors from their closed-form factor."""
    z = lambda i: _normal_sql(f"'{SEED}'", "fold", "feature", "draw", i)
    return f"""dz as (select r.*, draw, {z("'0'")} as z0, {z("'1'")} as z1, {z("'e'")} as ze from v_ridge r, (select unnest(range(1, {n + 1})) as draw)),
  dr as (select fold, feature, draw, b0 + sqrt(v00) * z0 as c0, b1 + v01 / sqrt(v00) * z0 + sqrt(v11 - v01 * v01 / v00) * z1 as c1, sqrt(s2) * ze as e from dz)"""


@query("STA-10", "posterior_draw_summary", f"""
with {_draws_sql(DRAWS)}
select fold, feature, count(*) as n, round(avg(c1), 6) as mean, round(stddev_pop(c1), 6) as sd, round(quantile_cont(c1, 0.05), 6) as p05, round(quantile_cont(c1, 0.25), 6) as p25,
  round(median(c1), 6) as p50, round(quantile_cont(c1, 0.75), 6) as p75, round(quantile_cont(c1, 0.95), 6) as p95, count(*) filter (where draw % {STEP} = 0) as n_sample,
  round(sum(c1) filter (where draw % {STEP} = 0), 6) as sample_sum from dr group by 1, 2""")
def posterior_draw_summary(t):
    """Mean, deviation, quantiles and a thinned sample of seeded posterior draws of every slope."""
    d = D.posterior_draws(single_fits(t), ["fold"], DRAWS, SEED)
    d = G.materialise(d.select("fold", F.col("spec").alias("feature"), "draw", F.col("coef")[1].alias("v")), "draws")
    keys = ["fold", "feature"]
    q = exact_quantiles(d, keys, "v", {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    kept = F.when(F.col("draw") % STEP == 0, F.col("v"))
    basic = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count(kept).alias("n_sample"),
                                 F.sum(kept).alias("sample_sum"))
    return rounded(basic.join(q, keys), "mean", "sd", "p05", "p25", "p50", "p75", "p95", "sample_sum")


def row_draws(t, n):
    """Test rows with predictive draws of the one-feature fits."""
    z = folded(t)
    fits = single_fits(t, z).where("spec = 'q'")
    packed = D.packed_draws(D.posterior_draws(fits, ["fold"], n, SEED), ["fold"])
    return D.predictive_draws(z.where("part = 'test'"), packed, ["fold"], ["q"])


def _row_draws_sql(n: int) -> str:
    return f"""{_draws_sql(n)}, pd as (select z.fold, event_id, to_team, season, y, m_y + s_y * (c0 + c1 * zq + e) as x from v_z z join dr on dr.fold = z.fold and feature = 'q' where part = 'test')"""


@query("STA-09", "draw_bands", f"""
with {_row_draws_sql(ROW_DRAWS)}
select fold, event_id, to_team, round(avg(x), 6) as mean, round(quantile_cont(x, 0.05), 6) as p05, round(median(x), 6) as p50, round(quantile_cont(x, 0.95), 6) as p95 from pd group by fold, event_id, to_team, season""")
def draw_bands(t):
    """Predictive bands from draws: each row's are sorted in the row, nothing is shuffled."""
    r = row_draws(t, ROW_DRAWS).withColumn("s", F.array_sort("pred_draws"))
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s")
    q = lambda p, n: F.round(D.quantile_of(F.col("s"), p), 6).alias(n)
    return r.select("fold", "event_id", "to_team", F.round(mean, 6).alias("mean"), q(0.05, "p05"), q(0.5, "p50"), q(0.95, "p95"))


@query("STA-11", "predictive_crps", f"""
with {_row_draws_sql(CRPS_DRAWS)}, a as (select fold, event_id, to_team, season, max(y) as y, avg(abs(x - y)) as t1, max(x) - min(x) as spread from pd group by 1, 2, 3, 4),
  b as (select p.fold, p.event_id, p.to_team, p.season, avg(abs(p.x - q.x)) as t2 from pd p join pd q on q.fold = p.fold and q.event_id = p.event_id and q.to_team = p.to_team and q.season = p.season group by 1, 2, 3, 4)
select a.fold, count(*) as n_rows, round(avg(t1 - t2 / 2), 6) as crps, round(avg(t1 - spread / {CRPS_DRAWS}), 6) as short_crps from a join b on b.fold = a.fold and b.event_id = a.event_id and b.to_team = a.to_team and b.season = a.season group by 1""")
def predictive_crps(t):
    """Exact and short CRPS of the predictive draws, averaged by fold."""
    r = row_draws(t, CRPS_DRAWS)
    x = F.col("pred_draws")
    return rounded(r.groupBy("fold").agg(
        F.count("*").alias("n_rows"), F.avg(C.crps_draws(x, F.col("y"))).alias("crps"), F.avg(C.legacy_crps(x, F.col("y"))).alias("short_crps")), "crps", "short_crps")


_GRID = [-1.6, -1.1, -0.7, -0.4, -0.2, 0.0, 0.25, 0.45, 0.75, 1.2, 1.7]
_GRID_SQL = "[" + ", ".join(f"{g}::double" for g in _GRID) + "]"


def draw_rows(t):
    """Ledger rows with an array of draws around half of the received value."""
    sd = F.lit(1.0) + F.col("n_received") * 0.31
    draws = F.array(*[F.col("received") / 2.0 + sd * g for g in _GRID])
    return t.ledger.select("event_id", "team_id", "season", F.col("surplus").alias("y"), draws.alias("draws"))


@query("STA-11", "exact_crps", f"""
with l as (select event_id, team_id, surplus as y, received / 2.0 as m, 1.0 + n_received * 0.31 as s from v_ledger), d as (select l.event_id, l.team_id, y, m + s * g as x from l, unnest({_GRID_SQL}) u(g)),
  a as (select event_id, team_id, avg(abs(x - y)) as t1 from d group by 1, 2), b as (select p.event_id, p.team_id, avg(abs(p.x - q.x)) as t2 from d p join d q on q.event_id = p.event_id and q.team_id = p.team_id group by 1, 2)
select a.event_id, a.team_id, round(t1 - t2 / 2, 5) as crps from a join b on b.event_id = a.event_id and b.team_id = a.team_id""")
def exact_crps(t):
    return draw_rows(t).select("event_id", "team_id", F.round(C.crps_draws(F.col("draws"), F.col("y")), 5).alias("crps"))


@query("STA-12", "legacy_crps", f"""
with l as (select event_id, team_id, surplus as y, received / 2.0 as m, 1.0 + n_received * 0.31 as s from v_ledger), d as (select l.event_id, l.team_id, y, m + s * g as x from l, unnest({_GRID_SQL}) u(g))
select event_id, team_id, round(avg(abs(x - y)) - (max(x) - min(x)) / 11, 5) as crps from d group by 1, 2""")
def legacy_crps_q(t):
    return draw_rows(t).select("event_id", "team_id", F.round(C.legacy_crps(F.col("draws"), F.col("y")), 5).alias("crps"))


def crps_sql(mean: str, sd: str, y: str) -> str:
    z = f"(({y} - {mean}) / {sd})"
    return f"{sd} * ({z} * (2 * {cdf_sql(z)} - 1) + 2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))"


@query("STA-13", "normal_crps", f"""
with l as (select event_id, team_id, surplus as y, received / 2.0 as m, 1.0 + n_received * 0.31 as s from v_ledger)
select event_id, team_id, round({crps_sql('m', 's', 'y')}, 6) as crps, round(abs(m - y), 6) as point_crps from l""")
def normal_crps(t):
    l = t.ledger.select("event_id", "team_id", F.col("surplus").alias("y"), (F.col("received") / 2.0).alias("m"), (F.lit(1.0) + F.col("n_received") * 0.31).alias("s"))
    return l.select("event_id", "team_id", F.round(C.crps_normal(F.col("m"), F.col("s"), F.col("y")), 6).alias("crps"), F.round(C.crps_point(F.col("m"), F.col("y")), 6).alias("point_crps"))


@query("STA-14", "evaluation", f"""
with {_PRED} select fold, count(*) as n_test, round(avg(abs(pred - y)), 6) as mae, round(avg(abs(y)), 6) as zero_mae, round(avg({crps_sql('pred', 'psd', 'y')}), 6) as crps,
  round(avg(case when y between pred - 1.645 * psd and pred + 1.645 * psd then 1.0 else 0.0 end), 6) as coverage from pr group by 1""")
def evaluation_q(t):
    return rounded(C.evaluation(predictions(t), ["fold"], "y"), "mae", "zero_mae", "crps", "coverage")


@query("STA-15", "stability", f"""
with {_SUMM}, nt as (select fold, count(*) as n_test from v_part where part = 'test' group by 1), s as (select sm.*, n_test >= 30 as ok, n_test >= 30 and (p05 > 0 or p95 < 0) and mass >= 0.975 as cred from sm join nt on nt.fold = sm.fold)
select feature, count(*) filter (where ok) as n_sufficient, count(*) filter (where cred) as n_credible, cast(greatest(1, ceil(0.75 * count(*) filter (where ok))) as int) as n_needed, round(median(beta) filter (where ok), 6) as median_beta,
  round(min(beta) filter (where ok), 6) as beta_min, round(max(beta) filter (where ok), 6) as beta_max, round(median(mass) filter (where ok), 6) as median_mass, count(*) filter (where not ok) as n_insufficient,
  count(*) filter (where ok) > 0 and (coalesce(min(beta) filter (where ok), 1) > 0 or coalesce(max(beta) filter (where ok), -1) < 0) as same_sign,
  count(*) filter (where ok) > 0 and count(*) filter (where cred) >= greatest(1, ceil(0.75 * count(*) filter (where ok))) and (min(beta) filter (where ok) > 0 or max(beta) filter (where ok) < 0) as confirmed from s group by 1""")
def stability_q(t):
    z = folded(t)
    tests = z.where("part = 'test'").groupBy("fold").agg(F.count("*").alias("n_test"))
    s = G.coefficient_summary(G.coefficients(single_fits(t, z), ["fold"]).where("feature <> 'intercept'").withColumn("feature", F.col("spec")))
    out = C.stability(s.join(tests, "fold"), ["feature"], F.lit(30), F.lit(0.75)).drop("sign_over_credible")
    return rounded(out, "median_beta", "beta_min", "beta_max", "median_mass")


@query("STA-15", "stability_signs", f"""
with {_SUMM}, nt as (select fold, count(*) as n_test from v_part where part = 'test' group by 1), s as (select sm.*, n_test >= 30 as ok, n_test >= 30 and (p05 > 0 or p95 < 0) and mass >= 0.975 as cred from sm join nt on nt.fold = sm.fold)
select feature, count(*) filter (where cred) as n_credible,
  count(*) filter (where ok) > 0 and (count(*) filter (where ok and beta <= 0) = 0 or count(*) filter (where ok and beta >= 0) = 0) as same_sign,
  count(*) filter (where cred and beta <= 0) = 0 or count(*) filter (where cred and beta >= 0) = 0 as sign_over_credible from s group by 1""")
def stability_signs(t):
    """Both sign rules side by side."""
    z = folded(t)
    tests = z.where("part = 'test'").groupBy("fold").agg(F.count("*").alias("n_test"))
    s = G.coefficient_summary(G.coefficients(single_fits(t, z), ["fold"]).where("feature <> 'intercept'").withColumn("feature", F.col("spec")))
    return C.stability(s.join(tests, "fold"), ["feature"], F.lit(30), F.lit(0.75)).select("feature", "n_credible", "same_sign", "sign_over_credible")


@query("STA-16", "skill_scores", f"""
with {_PRED}, b as (select fold, avg({crps_sql('pred', 'psd', 'y')}) as model, avg({crps_sql('m_y', 's_y', 'y')}) as base from pr group by 1), k as (select *, 1 - model / base as skill from b)
select fold, round(model, 6) as model, round(base, 6) as baseline, round(skill, 6) as skill, round((select avg(skill) from k), 6) as mean_skill, round((select avg(skill) from k where fold <> 1), 6) as mean_without_flagged from k""")
def skill_scores(t):
    """Model against the intercept-only normal of each fold; fold 1 is the flagged one."""
    p = predictions(t)
    y = F.col("y")
    f = p.groupBy("fold").agg(
        F.avg(C.crps_normal(F.col("pred"), F.col("pred_sd"), y)).alias("model"), F.avg(C.crps_normal(F.col("m_y"), F.col("s_y"), y)).alias("baseline")
    ).withColumn("skill", C.skill("model", "baseline"))
    means = f.agg(F.struct(F.avg("skill").alias("a"), F.avg(F.when(F.col("fold") != 1, F.col("skill"))).alias("b"))).scalar()
    return rounded(f.withColumn("m", means).select("fold", "model", "baseline", "skill", F.col("m.a").alias("mean_skill"), F.col("m.b").alias("mean_without_flagged")),
                   "model", "baseline", "skill", "mean_skill", "mean_without_flagged")


@query("STA-17", "model_grid", """
with o as (select outcome, start, fold, x, y from (
    select 'value' as outcome, case when season >= 1996 then 1996 else 1995 end as s0, fold, zq as x, zy as y, part, season from v_z) z, (select unnest([1995, 1996]) as start) g where part = 'train' and season >= start),
  a as (select outcome, start, fold, count(*) as n, sum(x) as sx, sum(x * x) as sxx, sum(x * y) as sxy, sum(y) as sy, sum(y * y) as syy from o group by 1, 2, 3)
select outcome, cast(start as int) as train_start, fold, n, round((n * sxy - sx * sy) / (n * sxx - sx * sx), 6) as slope from a""")
def model_grid(t):
    """Training starts x folds x feature subsets from one Gram pass; one subset shown here."""
    z = folded(t).where("part = 'train'")
    starts = F.filter(F.array(F.lit(1995), F.lit(1996)), lambda s: s <= F.col("season"))
    spread = z.withColumn("train_start", F.explode(starts)).withColumn("outcome", F.lit("value"))
    keys = ["outcome", "train_start", "fold"]
    xs = ["z_q", "z_ma"]
    fits = G.solve(G.gram(spread, keys, xs, "z_y"), keys, xs, {"none": [], "q": ["z_q"], "ma": ["z_ma"], "both": xs}, prior_sd=None)
    return fits.where("spec = 'q'").select(*keys, "n", F.round(F.col("beta")[1], 6).alias("slope"))


# Two-feature least squares in centred moments, apart from the operator's normal equations.
_GRID_CTES = """go as (select 'value' as outcome, season, fold, zq as x, zma as z, zy as y from v_z where part = 'train' union all select 'metric', season, fold, zq, zma, zy from v_metric_z where part = 'train'),
  gk as (select go.*, k.dropped from go join (select outcome, min(season) as s0 from go group by 1) m on m.outcome = go.outcome cross join (select unnest([0, 1]) as dropped) k where go.season >= m.s0 + k.dropped),
  ga as (select outcome, dropped, fold, count(*) as n, avg(x) as mx, avg(z) as mz, avg(y) as my, var_pop(x) as vx, var_pop(z) as vz, var_pop(y) as vy, covar_pop(x, z) as cxz, covar_pop(x, y) as cxy, covar_pop(z, y) as czy from gk group by 1, 2, 3),
  gf as (select *, 'none' as spec, null::double as bq, null::double as bm from ga union all select *, 'q', cxy / vx, null from ga union all select *, 'ma', null, czy / vz from ga
    union all select *, 'both', (cxy * vz - czy * cxz) / (vx * vz - cxz * cxz), (czy * vx - cxy * cxz) / (vx * vz - cxz * cxz) from ga)"""


def outcome_trains(t, rows=None):
    """Standardised training rows of both outcomes, labelled."""
    rows = model_rows(t) if rows is None else rows
    sides = [folded_rows(rows, y).where("part = 'train'").withColumn("outcome", F.lit(name)) for name, y in (("value", "y"), ("metric", "y2"))]
    return sides[0].unionByName(sides[1])


@query("STA-17", "model_grid_subsets", f"""
with {_GRID_CTES} select outcome, dropped, fold, spec, n, round(my - coalesce(bq * mx, 0) - coalesce(bm * mz, 0), 6) as intercept, round(bq, 6) as slope_q, round(bm, 6) as slope_ma from gf""")
def model_grid_subsets(t):
    """Outcomes x training windows x folds x every feature subset, from one Gram pass.

    A window leaves out no or one first season of its outcome.
    """
    z = G.materialise(outcome_trains(t), "grid-rows")
    first = z.groupBy("outcome").agg(F.min("season").alias("_s0"))
    spread = z.join(first, "outcome").withColumn("dropped", F.explode(F.array(F.lit(0), F.lit(1)))).where(F.col("season") >= F.col("_s0") + F.col("dropped"))
    keys, xs = ["outcome", "dropped", "fold"], ["z_q", "z_ma"]
    fits = G.solve(G.gram(spread, keys, xs, "z_y"), keys, xs, {"none": [], "q": ["z_q"], "ma": ["z_ma"], "both": xs}, prior_sd=None)
    slope = lambda x: F.try_element_at("beta", F.expr(f"nullif(array_position(features, '{x}'), 0)").cast("int"))
    return rounded(fits.select(*keys, "spec", "n", F.col("beta")[0].alias("intercept"), slope("z_q").alias("slope_q"), slope("z_ma").alias("slope_ma")),
                   "intercept", "slope_q", "slope_ma")


#: Longest outcome window, and the grid's feature subsets and priors.
LONGEST = 5
WINDOW_SPECS = {"none": [], "q": ["z_q"], "ma": ["z_ma"], "both": ["z_q", "z_ma"]}
WINDOW_PRIORS = (0.1, 0.3, 1.0)


def _windows_sql() -> str:
    years = range(1, LONGEST + 1)
    yearly = ", ".join(f"sum(coalesce(n{k}.value, 0)) as v{k}, sum(coalesce(m{k}.metric_a, 0)) as a{k}" for k in years)
    joins = " ".join(f"left join v_psv n{k} on n{k}.player_id = t.player_id and n{k}.season = t.season + {k} left join v_metric m{k} on m{k}.player_id = t.player_id and m{k}.season = t.season + {k}" for k in years)
    outcome = lambda c, s, e: " + ".join(f"{c}{k}" for k in range(s, e + 1))
    pairs = [(s, e) for s in years for e in range(s, LONGEST + 1)]
    cases = " union all ".join(
        f"select fold, season, zq, zma, '{name}' as outcome, {s} as window_start, {e} as window_end, {outcome(c, s, e)} as y from wz where season + {e} <= last"
        for name, c in (("value", "v"), ("metric", "a")) for s, e in pairs)
    on = {"none": (0, 0), "q": (1, 0), "ma": (0, 1), "both": (1, 1)}
    specs = ", ".join(f"('{n}', {a}.0::double, {b}.0::double)" for n, (a, b) in on.items())
    xs = ["zq * u", "zma * w"]
    return f"""wy as (select t.event_id, t.to_team, t.season, {yearly} from v_trade t {joins} group by 1, 2, 3),
  wz as (select z.fold, z.season, zq, zma, wy.* exclude (event_id, to_team, season), (select max(season) from v_psv) as last
    from v_z z join wy on wy.event_id = z.event_id and wy.to_team = z.to_team and wy.season = z.season where part = 'train'),
  wl as ({cases}),
  wd as (select wl.*, d.dropped from wl, (select unnest([0, 1]) as dropped) d where season >= (select min(season) from wz) + d.dropped),
  ws as (select outcome, window_start, window_end, dropped, fold, avg(y) as my, stddev_pop(y) as sy from wd group by all having count(*) >= 2 and var_pop(y) > 1e-18),
  wg as (select outcome, window_start, window_end, dropped, fold, spec, prior_sd, count(*) as n, {gram_columns(xs, '((y - my) / sy)')}
    from wd join ws using (outcome, window_start, window_end, dropped, fold), (values {specs}) k(spec, u, w), (select unnest({list(WINDOW_PRIORS)}::double[]) as prior_sd) group by all),
  {ridge('wf', 'wg', 3, ['1.0', '1 / (prior_sd * prior_sd)', '1 / (prior_sd * prior_sd)'])}"""


def window_rows(t):
    """Training rows of every fold with the yearly sums of both outcomes after the move."""
    years = range(1, LONGEST + 1)
    w = offset_window(t.trade.select("event_id", "to_team", "season", "player_id"), t.psv, [*years], ["value"])
    w = offset_window(w, t.metric, [*years], ["metric_a"])
    total = lambda m, k: F.sum(F.coalesce(f"{m}_t_plus_{k}", F.lit(0.0)))
    yearly = w.groupBy("event_id", "to_team", "season").agg(
        *[total("value", k).alias(f"value_{k}") for k in years], *[total("metric_a", k).alias(f"metric_{k}") for k in years])
    z = folded(t).where("part = 'train'").select("fold", "event_id", "to_team", "season", "z_q", "z_ma")
    return z.join(yearly, ["event_id", "to_team", "season"]).withColumn("last", t.psv.agg(F.max("season")).scalar())


@query("STA-17", "model_grid_windows", f"""
with {_windows_sql()}
select outcome, window_start, window_end, cast(dropped as int) as dropped, fold, spec, prior_sd, n, round(case when spec in ('q', 'both') then b_1 end, 6) as slope_q,
  round(case when spec in ('ma', 'both') then b_2 end, 6) as slope_ma, round(s2, 6) as s2 from wf""")
def model_grid_windows(t):
    """Outcomes x all windows inside five years x training starts x folds x feature subsets x priors, from one aggregate."""
    rows = G.materialise(window_rows(t), "window-rows")
    first = rows.agg(F.min("season")).scalar()
    spread = rows.withColumn("_s0", first).withColumn("dropped", F.explode(F.array(F.lit(0), F.lit(1)))).where(F.col("season") >= F.col("_s0") + F.col("dropped"))
    keys, xs, outcomes = ["dropped", "fold"], ["z_q", "z_ma"], ["value", "metric"]
    fits = WG.solve_windows(WG.window_grams(spread, keys, xs, outcomes, "last", LONGEST), keys, xs, outcomes, WINDOW_SPECS, WINDOW_PRIORS, LONGEST)
    return rounded(fits.select(
        "outcome", "window_start", "window_end", "dropped", "fold", "spec", "prior_sd", "n", F.try_element_at("beta", F.lit("z_q")).alias("slope_q"),
        F.try_element_at("beta", F.lit("z_ma")).alias("slope_ma"), "s2"), "slope_q", "slope_ma", "s2")


_PRIORS = (0.1, 0.3, 1.0)


def _prior_sql(outcome: str, z: str) -> str:
    """The one-feature ridge text over a list of prior widths."""
    from swapledger.plans.views import VIEWS

    text = VIEWS["v_ridge"].replace("v_z", z).replace("1 / 0.09", "1 / (p * p)").replace("select fold, feature, n,", "select p, fold, feature, n,")
    text = text.replace("  a as (select fold, feature, count(*)", "  a0 as (select fold, feature, count(*)").replace(
        "from l group by 1, 2),", f"from l group by 1, 2),\n  a as (select * from a0, (select unnest({list(_PRIORS)}::double[]) as p)),", 1)
    return f"select '{outcome}' as outcome, p as prior_sd, fold, feature, n, round(b1, 6) as beta, round(sqrt(v11), 6) as sd from ({text.strip()})"


@query("STA-17", "model_grid_priors", f"{_prior_sql('value', 'v_z')} union all {_prior_sql('metric', 'v_metric_z')}")
def model_grid_priors(t):
    """Outcomes x prior widths x folds x single features; the sums are taken once for all priors."""
    keys, xs = ["outcome", "fold"], ["z_q", "z_ma"]
    grams = G.materialise(G.gram(outcome_trains(t), keys, xs, "z_y"), "grid-sums")
    fits = [G.solve(grams, keys, xs, {"q": ["z_q"], "ma": ["z_ma"]}, prior_sd=p).withColumn("prior_sd", F.lit(p)) for p in _PRIORS]
    both = fits[0].unionByName(fits[1]).unionByName(fits[2])
    return rounded(both.select("outcome", "prior_sd", "fold", F.col("spec").alias("feature"), "n", F.col("beta")[1].alias("beta"),
                               F.sqrt(F.col("cov")[3]).alias("sd")), "beta", "sd")


@query("STA-16", "nested_skill", f"""
with {_GRID_CTES}, ge as (select *, n / (n - case spec when 'both' then 3 else 2 end) * (vy - coalesce(bq * cxy, 0) - coalesce(bm * czy, 0)) as s2 from gf where outcome = 'value' and dropped = 0 and spec in ('q', 'both')),
  gp as (select z.fold, e.spec, z.y, z.m_y, z.s_y, z.m_y + z.s_y * (my + bq * (zq - mx) + coalesce(bm * (zma - mz), 0)) as pred,
    z.s_y * sqrt(s2 * (1 + 1.0 / n + case spec when 'q' then (zq - mx) * (zq - mx) / (n * vx)
      else ((zq - mx) * (zq - mx) * vz - 2 * (zq - mx) * (zma - mz) * cxz + (zma - mz) * (zma - mz) * vx) / (n * (vx * vz - cxz * cxz)) end)) as psd
    from v_z z join ge e on e.fold = z.fold where z.part = 'test'),
  gc as (select fold, count(*) filter (where spec = 'q') as n_test, avg({crps_sql('m_y', 's_y', 'y')}) as crps_none, avg({crps_sql('pred', 'psd', 'y')}) filter (where spec = 'q') as crps_q, avg({crps_sql('pred', 'psd', 'y')}) filter (where spec = 'both') as crps_both from gp group by 1)
select fold, n_test, round(crps_none, 6) as crps_none, round(crps_q, 6) as crps_q, round(crps_both, 6) as crps_both,
  round(1 - crps_q / crps_none, 6) as skill_q, round(1 - crps_both / crps_none, 6) as skill_both, round(1 - crps_both / crps_q, 6) as skill_both_over_q from gc""")
def nested_skill(t):
    """Intercept only, one feature, both: does the larger set beat the smaller one out of sample?"""
    z, xs = folded(t), ["z_q", "z_ma"]
    fits = G.materialise(G.solve(G.gram(z.where("part = 'train'"), ["fold"], xs, "z_y"), ["fold"], xs, {"q": ["z_q"], "both": xs}, prior_sd=None), "nested-fits")
    test, crps = z.where("part = 'test'"), lambda m, s: C.crps_normal(F.col(m), F.col(s), F.col("y"))
    small = G.predict(test, fits.where("spec = 'q'"), ["fold"], ["q"])
    small = small.withColumn("crps_q", crps("pred", "pred_sd")).drop("pred", "pred_sd", "p05", "p95", "beta", "cov", "s2", "spec")
    wide = G.predict(small, fits.where("spec = 'both'"), ["fold"], ["q", "ma"]).withColumn("crps_both", crps("pred", "pred_sd"))
    f = wide.groupBy("fold").agg(F.count("*").alias("n_test"), F.avg(crps("m_y", "s_y")).alias("crps_none"),
                                 F.avg("crps_q").alias("crps_q"), F.avg("crps_both").alias("crps_both"))
    return rounded(
        f.withColumn("skill_q", C.skill("crps_q", "crps_none")).withColumn("skill_both", C.skill("crps_both", "crps_none"))
        .withColumn("skill_both_over_q", C.skill("crps_both", "crps_q")),
        "crps_none", "crps_q", "crps_both", "skill_q", "skill_both", "skill_both_over_q")


@query("STA-18", "mass_matrix", f"""
with {_SUMM} select feature, fold, round(mass, 6) as mass, count(*) filter (where (p05 > 0 or p95 < 0) and mass >= 0.95) over (partition by feature) as n_credible from sm""")
def mass_matrix(t):
    s = G.coefficient_summary(G.coefficients(single_fits(t), ["fold"]).where("feature <> 'intercept'").withColumn("feature", F.col("spec")))
    cred = s.groupBy("feature").agg(F.count_if("credible").alias("n_credible"))
    return rounded(s.select("feature", "fold", "mass").join(cred, "feature"), "mass")


@query("STA-18", "mass_by_outcome", f"""
with a as (select feature, 'value' as outcome, b1 as b, sqrt(v11) as sd from v_ridge union all select feature, 'metric', b1, sqrt(v11) from v_metric_ridge),
  s as (select feature, outcome, {cdf_sql('abs(b) / sd')} as mass, b - 1.645 * sd > 0 or b + 1.645 * sd < 0 as apart from a)
select feature, round(avg(mass) filter (where outcome = 'value'), 6) as value_mass, count(*) filter (where outcome = 'value' and apart and mass >= 0.95) as value_credible,
  round(avg(mass) filter (where outcome = 'metric'), 6) as metric_mass, count(*) filter (where outcome = 'metric' and apart and mass >= 0.95) as metric_credible from s group by 1""")
def mass_by_outcome(t):
    """Feature x outcome: mean directional mass over all folds, and the folds that are credible."""
    rows = model_rows(t)
    fits = lambda y: G.coefficients(single_fits(t, folded_rows(rows, y)), ["fold"]).where("feature <> 'intercept'")
    both = fits("y").withColumn("outcome", F.lit("value")).unionByName(fits("y2").withColumn("outcome", F.lit("metric")))
    s = G.coefficient_summary(both.withColumn("feature", F.col("spec")))
    return s.groupBy("feature").pivot("outcome", ["value", "metric"]).agg(
        F.round(F.avg("mass"), 6).alias("mass"), F.count_if("credible").alias("credible"))


@query("STA-19", "head_to_head", f"""
with {_PRED}, b as (select event_id, to_team, y2 from v_model where y2 is not null)
select pr.fold, count(*) as n, round(avg(abs(pr.pred - pr.y)), 6) as model_mae, round(avg(abs(b.y2 - pr.y)), 6) as rate_mae, round(avg(abs(b.y2 - pr.y)) - avg(abs(pr.pred - pr.y)), 6) as gain
from pr join b on b.event_id = pr.event_id and b.to_team = pr.to_team group by 1""")
def head_to_head(t):
    """Both forecasts on the rows that have both."""
    p = predictions(t).where(F.col("y2").isNotNull())
    m, r = F.avg(F.abs(F.col("pred") - F.col("y"))), F.avg(F.abs(F.col("y2") - F.col("y")))
    return rounded(p.groupBy("fold").agg(F.count("*").alias("n"), m.alias("model_mae"), r.alias("rate_mae"), (r - m).alias("gain")), "model_mae", "rate_mae", "gain")
