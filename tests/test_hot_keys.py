"""Operators on one hot key, long spans and many slices, held against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.operators import asof, regime


def test_best_before_and_trailing_on_one_key(spark):
    r = random.Random(1)
    right = [("k", float(r.randint(0, 400)), r.randint(0, 50), i) for i in range(300)]
    left = [("k", i, float(r.randint(0, 420))) for i in range(80)]
    rows = spark.createDataFrame(right, "k string, at double, rank int, v long")
    want = spark.createDataFrame(left, "k string, id long, t double")
    got = {x.id: x for x in asof.best_before(want, rows, ["k"], "t", "at", ["rank", "v"], ["v"], slice_seconds=30.0).collect()}
    for _, i, t in left:
        seen = [(b, v) for _, a, b, v in right if a < t]
        assert got[i].v == (max(seen)[1] if seen else None)
    sums = {x.id: x for x in asof.trailing(want, rows, ["k"], "t", "at", 50.0, {"n": F.lit(1), "s": F.col("rank")}).collect()}
    for _, i, t in left:
        inside = [b for _, a, b, _ in right if t - 50 <= a < t]
        assert (sums[i].n, sums[i].s) == (len(inside), sum(inside))


@pytest.mark.parametrize("closed", [False, True])
def test_overlaps_of_long_and_open_spans(spark, closed):
    r = random.Random(2)
    left = [("k", i, float(a), float(a + r.randint(0, 600))) for i, a in enumerate(r.choices(range(0, 10**6), k=120))]
    right = [("k", i, float(a), None if i % 9 == 0 else float(a + r.choice([0, 300, 5000, 400_000]))) for i, a in enumerate(r.choices(range(-(10**6), 10**6), k=60))]
    a, b = spark.createDataFrame(left, "k string, i long, s double, e double"), spark.createDataFrame(right, "k string, j long, s double, e double")
    got = sorted((x.i, x.r_j) for x in asof.overlap_join(a, b, ["k"], ("s", "e"), ("s", "e"), 300.0, closed).collect())
    hit = (lambda s, e, s2, e2: s2 <= e and s <= e2) if closed else (lambda s, e, s2, e2: s2 < e and s < e2)
    assert got == sorted((i, j) for _, i, s, e in left for _, j, s2, e2 in right if hit(s, e, s2, float("inf") if e2 is None else e2))


def test_modes_of_a_long_segment_in_slices(spark, monkeypatch):
    monkeypatch.setattr(regime, "FOLD_BARS", 7)
    r = np.random.default_rng(3)
    x = r.normal(0, 1, (120, 5)).round(2)
    c, lam = [[-0.3, -0.4, -0.5, 0.0, 1.0], [0.3, 0.4, 0.6, 0.0, 1.0]], 1.0
    rows = spark.createDataFrame([("m", 1, float(i), *map(float, v)) for i, v in enumerate(x)], "condition string, segment long, bin_start double, " + ", ".join(f"{d} double" for d in regime.DIMENSIONS))
    smooth = [q.mode for q in sorted(regime.smoothed_modes(rows, c, lam).collect(), key=lambda q: q.bin_start)]
    assert smooth == regime.viterbi(x, np.array(c), lam).tolist()
    d, a, b, want = ((x[:, None] - np.array(c)) ** 2).sum(2), 0.0, 0.0, []
    for d0, d1 in d:
        a, b = d0 + min(a, b + lam * bool(want)), d1 + min(b, a + lam * bool(want))
        want.append(int(a > b))
    online = [q.mode_online for q in sorted(regime.online_costs(rows, c, lam).collect(), key=lambda q: q.bin_start)]
    assert len(online) == 120 and sum(p == q for p, q in zip(online, want, strict=True)) >= 118


def test_pooled_quartiles_by_counts(spark):
    r = np.random.default_rng(4)
    for n in (4, 5, 6, 7, 50, 101):
        v = r.normal(0, 1, n).round(1)
        got = regime.pooled_stats(spark.createDataFrame([("v", 0.001, float(i)) for i in v], "variable string, least double, x double")).first()
        s = np.sort(v)

        def quart(k):
            j = max(1, min(n - 1, k * (n + 1) // 4))
            delta = k * (n + 1) - j * 4
            return (s[j - 1] * (4 - delta) + s[j] * delta) / 4

        assert abs(got.median - np.median(v)) < 1e-9 and abs(got.iqr - max(quart(3) - quart(1), 0.001)) < 1e-9 and got.n == n
