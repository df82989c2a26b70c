"""Drift regressions and hashed draws against direct fits and plain loops."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.operators import drift
from hindcast.operators import stats as S


def observed(spark, conditions=7, days=9, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(160):
        x = r.normal(size=len(drift.NAMES))
        x[-1] = x[-1] > 0
        c, d = int(r.integers(conditions)), int(r.integers(days))
        rows.append((f"c{c}", float(i), 3600.0, 100 + d, "observed", float(0.8 * x[0] - 0.3 * x[1] + 0.4 * c + 0.2 * d + r.normal()), *map(float, x)))
    schema = "condition string, bin_start double, horizon double, day long, status string, y double, " + ", ".join(f"{n} double" for n in drift.NAMES)
    return rows, spark.createDataFrame(rows, schema)


def direct(rows):
    """Coefficients and CR1 errors by market, day and both of the demeaned rows, with numpy alone."""
    c, d = np.array([x[0] for x in rows]), np.array([x[3] for x in rows])
    v = np.array([x[5:] for x in rows], float)
    for g in set(c):
        v[c == g] -= v[c == g].mean(0)
    x, y = np.column_stack([np.ones(len(v)), v[:, 1:]]), v[:, 0]
    bread = np.linalg.pinv(x.T @ x)
    beta = bread @ x.T @ y
    e, n, k = y - x @ beta, *x.shape

    def cov(labels):
        groups = sorted(set(labels))
        meat = sum(np.outer(s, s) for s in (x[[q == g for q in labels]].T @ e[[q == g for q in labels]] for g in groups))
        return len(groups) / (len(groups) - 1) * (n - 1) / (n - k) * bread @ meat @ bread

    m, t = cov(list(c)), cov(list(d))
    both = m + t - cov(list(zip(c, d, strict=True)))
    return x, y, c, d, bread, beta, [np.sqrt(np.maximum(np.diag(z), 0)) for z in (m, t, both)]


def sign(seed, g, draw):
    return -1.0 if hashlib.md5(f"{seed}:{g}:{draw // 4}".encode()).hexdigest()[8 * (draw % 4)] < "8" else 1.0


def test_regressions_equal_a_direct_fit(spark):
    rows, frame = observed(spark)
    x, y, c, d, bread, beta, errors = direct(rows)
    fit = drift.regress(drift.cells(frame).cache(), 3600.0)
    assert np.allclose(fit["beta"], beta) and fit["n"] == len(rows) and fit["clusters"] == {"market": 7, "day": 9, "both": 7}
    for name, se in zip(("market", "day", "both"), errors, strict=True):
        assert np.allclose(fit["se"][name], se, atol=1e-8) and fit["t"][name] == pytest.approx(beta[1] / se[1])
    assert drift.regress(drift.cells(frame).cache(), 7200.0) is None


def test_few_clusters_give_a_wild_p_instead_of_t(spark):
    rows, frame = observed(spark, conditions=3)
    out = drift.drift_regressions(frame.union(frame.limit(4).withColumn("status", F.lit("censored"))).cache(), (3600.0, 7200.0), draws=40).collect()
    assert len(out) == 1
    got = out[0]
    assert (got.n, got.censored, got.stale, got.markets, got.t_market, got.t_both) == (len(rows), 4, 0, 3, None, None) and got.t_day is not None
    x, y, c, d, bread, beta, _ = direct(rows)
    keep = [i for i in range(x.shape[1]) if i != 1]
    null = np.zeros(x.shape[1])
    null[keep] = np.linalg.pinv(x[:, keep].T @ x[:, keep]) @ x[:, keep].T @ y
    u = y - x @ null

    def t(flip):
        star = x @ null + u * flip
        b = bread @ x.T @ star
        e = star - x @ b
        meat = sum(np.outer(s, s) for s in (x[c == g].T @ e[c == g] for g in set(c)))
        return abs(b[1]) / np.sqrt(max((bread @ meat @ bread)[1, 1], 1e-300))

    own = t(np.ones(len(y)))
    exceed = sum(t(np.array([sign("wild", g, j) for g in c])) >= own * (1 - 1e-9) for j in range(40))
    assert got.wild_p == pytest.approx((exceed + 1) / 41, abs=1.5 / 41)


def test_days_are_resampled_in_blocks(spark):
    _, frame = observed(spark)
    own = S.within_demean(frame, "condition", ["y", *drift.NAMES])
    got = S.moving_block_bootstrap(own, drift.NAMES, "y", 1, "day", 2, draws=60)
    assert 0.02 < got["se"] < 0.5 and got["low"] < 0.8 < got["high"] and S.moving_block_bootstrap(own, drift.NAMES, "y", 1, "day", 5) is None


def test_hashed_draws_equal_plain_loops(spark):
    r = np.random.default_rng(2)
    rows = [(int(g), float(v) if r.random() < 0.9 else None) for g, v in zip(r.integers(0, 30, 300), r.normal(size=300), strict=True)]
    got = S.cluster_bootstrap(spark.createDataFrame(rows, "g int, v double").repartition(3), "g", "v", draws=50, seed="s").first()
    by = {}
    for g, v in rows:
        by.setdefault(g, []).extend([] if v is None else [v])
    means = []
    for j in range(50):
        w = {g: sum(hashlib.md5(f"s:{g}:{j // 4}".encode()).hexdigest()[8 * (j % 4) : 8 * (j % 4) + 8] >= x for x in S._POISSON) for g in by}
        means.append(sum(w[g] * sum(v) for g, v in by.items()) / sum(w[g] * len(v) for g, v in by.items()))
    assert got.clusters == len(by) and got.mean == pytest.approx(np.mean([v for _, v in rows if v is not None]))
    assert [got.low, got.high] == pytest.approx(np.percentile(means, [2.5, 97.5]))
    none = S.cluster_bootstrap(spark.createDataFrame([], "g int, v double"), "g", "v", draws=8).first()
    assert (none.mean, none.low, none.clusters) == (None, None, 0)


def test_placebos_deal_the_flags_anew_within_conditions(spark):
    rows, frame = observed(spark)
    flagged = frame.withColumns({"is_news": (F.col("bin_start") % 2 == 0).cast("int")})
    ret = F.col("r_news") + F.col("r_nonnews")
    flagged = flagged.withColumn("ret", ret).withColumns({"r_news": F.when(F.col("is_news") == 1, F.col("ret")).otherwise(0.0), "r_nonnews": F.when(F.col("is_news") == 1, 0.0).otherwise(F.col("ret"))})
    planted = flagged.withColumn("y", 3 * F.col("r_news") + F.col("vol") * 0.1).cache()
    got = drift.placebo_p(planted, 19).collect()
    assert [(r.horizon, r.p) for r in got] == [(3600.0, 1 / 20)] and abs(got[0].beta_news - 3) < 1e-6 and abs(got[0].mean_placebo - 1.5) < 0.8
    null = planted.withColumn("y", F.col("vol")).cache()
    assert drift.placebo_p(null, 9).first().p > 0.05 and drift.placebo_p(planted.limit(5).cache(), 3).count() == 0
