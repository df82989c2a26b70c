import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.functions import exprs as X
from hindcast.operators import bars as B
from hindcast.operators import decisions as D
from hindcast.operators import normalize as N
from hindcast.operators import regime as R
from hindcast.operators import stats as S
from hindcast.operators.asof import asof_join, band_join, overlap_join

T0 = 1_700_000_100.0


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_scalars(spark):
    a = F.array(*[F.lit(x) for x in (1.0, 2.5, 3.0, 7.0, 9.0, 11.5)])
    r = one(spark, q1=X.exclusive_quantile(a, 1), q3=X.exclusive_quantile(a, 3), m=X.median(a), lo=X.logit(F.lit(0.0)), hi=X.logit(F.lit(1.0)), half=X.half_life_decay(F.lit(7200.0), 7200.0), wk=X.is_weekend(F.lit(1_704_531_600.0)), no=X.is_weekend(F.lit(1_704_704_400.0)), iso=X.iso_epoch(F.lit("2024-01-01T00:00:00Z")), bad=X.iso_epoch(F.lit("soon")), num=X.iso_epoch(F.lit("12.5")), c=X.confidence_of(F.lit('{"confidence": 7}')), d=X.confidence_of(F.lit("{")))
    assert (r.q1, r.q3, r.m) == (2.125, 9.625, 5.0) and (r.lo, r.hi) == pytest.approx((math.log(0.001 / 0.999), math.log(999))) and r.half == 0.5 and r.wk and not r.no
    assert r.iso == 1_704_067_200.0 and r.bad is None and r.num == 12.5 and (r.c, r.d) == (1.0, 1.0)
    with pytest.raises(ValueError):
        X.half_life_decay(F.lit(1.0), 0)


def test_words(spark):
    t = F.lit("The Fed approves 25 basis points. Markets rise!")
    r = one(spark, s=X.first_sentence(t), e=X.entities(t), w=X.tokens(X.first_sentence(t)), d=X.direction_of(X.tokens(t)), k=X.family_key(X.entities(t), X.tokens(t)), none=X.family_key(X.entities(F.lit("")), X.tokens(F.lit(""))), u=X.quantity_unit(F.lit("£3")), q=X.quantities(t))
    assert r.s == "The Fed approves 25 basis points." and r.e == ["Fed", "Markets"] and r.w == ["fed", "approves", "basis", "points"] and r.d == 1
    assert (r.k, r.none, r.u, r.q) == ("fed|markets", "misc", "GBP", ["25"])


@pytest.mark.parametrize("slice_seconds", [None, 3.0])
@pytest.mark.parametrize("strict", [True, False])
def test_asof_equals_brute_force(spark, strict, slice_seconds):
    r = random.Random(1)
    left = [(i, r.choice("ab"), float(r.randint(0, 20))) for i in range(60)]
    right = [(r.choice("abc"), float(r.randint(0, 20)), i) for i in range(25)]
    got = asof_join(spark.createDataFrame(left, "id int, k string, t double"), spark.createDataFrame(right, "k string, at double, v int"), ["k"], "t", "at", ["v"], strict=strict, max_age=6.0, slice_seconds=slice_seconds)
    for x in got.collect():
        seen = [(at, v) for k, at, v in right if k == x.k and (at < x.t if strict else at <= x.t)]
        best = max(seen, default=None)
        assert x.v == (best[1] if best and x.t - best[0] <= 6 else None)
    assert got.count() == 60 and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


def test_overlap_and_band(spark):
    r = random.Random(2)
    a = [(i, "k", float(s), float(s + r.randint(0, 30))) for i, s in enumerate(r.randint(0, 100) for _ in range(30))]
    b = [(i, "k", float(s), None if i % 7 == 0 else float(s + r.randint(0, 30))) for i, s in enumerate(r.randint(0, 100) for _ in range(30))]
    x, y = spark.createDataFrame(a, "i int, k string, s double, e double"), spark.createDataFrame(b, "i int, k string, s double, e double")
    got = sorted((p.i, p.r_i) for p in overlap_join(x, y, ["k"], ("s", "e"), ("s", "e"), 10, end_of_time=500.0).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if q[2] < p[3] and (q[3] is None or p[2] < q[3]))
    near = sorted((p.i, p.r_i) for p in band_join(x, y, ["k"], F.col("s") + 5, "s", 3, 4).collect())
    assert near == sorted((p[0], q[0]) for p in a for q in b if p[2] + 2 <= q[2] <= p[2] + 9)


def books(spark, rows):
    return spark.createDataFrame([(i, "c", t, m, 0.04, 60.0, 60.0, 0.01, 900.0, 0.0) for i, (t, m) in enumerate(rows)], "event_id int, condition string, ts double, mid double, spread double, bid_size double, ask_size double, tick double, depth double, imbalance double")


def fills(spark, rows):
    return spark.createDataFrame(rows, "condition string, ts double, notional double")


GAPS = "condition string, gap_start double, gap_end double, resolved boolean"


def test_bar_by_hand(spark):
    b, lg = T0 - T0 % 300, lambda p: math.log(p / (1 - p))
    got = B.build_bars(books(spark, [(b, 0.42), (b + 60, 0.44), (b + 120, 0.40)]), fills(spark, [("c", b + 30, 12.5), ("c", b + 200, 7.5)]), spark.createDataFrame([], GAPS), 300, min_observations=3).collect()
    assert len(got) == 1
    x = got[0]
    assert (x.open, x.high, x.low, x.close) == pytest.approx((lg(0.42), lg(0.44), lg(0.40), lg(0.40)))
    assert x.rv == pytest.approx((lg(0.44) - lg(0.42)) ** 2 + (lg(0.40) - lg(0.44)) ** 2) and (x.turnover, x.n_books, x.n_fills) == (20.0, 3, 2)
    assert (x.spread_mean, x.spread_ticks_mean, x.best_size_mean, x.depth_mean) == pytest.approx((0.04, 4, 60, 900)) and x.complete and x.coverage == 0.6


def test_gaps_block_and_empty_bins_stay(spark):
    b = T0 - T0 % 300
    rows = [(b + 1, 0.4), (b + 2, 0.5), (b + 901, 0.6), (b + 902, 0.61)]
    gaps = spark.createDataFrame([("c", b + 910.0, None, False), ("c", b, b + 5, True)], GAPS)
    got = sorted(B.build_bars(books(spark, rows), fills(spark, [("c", b + 1300, 1.0)]), gaps, 300, min_observations=1).collect(), key=lambda x: x.bin_start)
    assert [x.n_books for x in got] == [2, 0, 0, 2, 0] and [x.complete for x in got] == [True, False, False, False, False]
    assert got[1].close is None and got[1].turnover == 0 and got[4].turnover == 1
    assert got[3].rv == pytest.approx((math.log(0.6 / 0.4) - 0) ** 2 + (math.log(0.61 / 0.39) - math.log(0.6 / 0.4)) ** 2)


def test_returns_need_contiguous_bars(spark):
    rows = spark.createDataFrame([("c", 900.0 * k, float(k * k), True) for k in (0, 1, 3, 4)], "condition string, bin_start double, close double, complete boolean").withColumns({"spread_mean": F.lit(0.0), "turnover": F.lit(1.0), "rv": F.lit(0.0)})
    ret = B.interval_returns(rows, 900)
    assert sorted((x.bin_start, x.ret) for x in ret.collect()) == [(900.0, 1.0), (3600.0, 7.0)]
    assert [x.trailing_vol for x in B.trailing_volatility(ret).collect()] == [0.0, 0.0]
    assert [x.segment for x in B.segments(rows, 900).orderBy("bin_start").collect()] == [1, 1, 2, 2]


def test_positive_conversion_and_activity(spark):
    r = one(spark, p=X.positive_price(F.lit(0.3), F.lit(-1)), s=X.positive_side(F.lit("BUY"), F.lit(-1)), n=X.positive_price(F.lit(0.3), F.lit(None).cast("int")), c=X.proposition_change(F.lit(5.0), F.lit("SELL"), F.lit(-1)))
    assert (r.p, r.s, r.n, r.c) == (0.7, "SELL", None, 5.0)
    rows = [("a", "TRADE", "BUY", 10.0, 0.4, None), ("b", "SPLIT", None, 10.0, None, None), ("c", "MERGE", None, 4.0, None, None), ("d", "REDEEM", None, 5.0, None, 7), ("e", "REDEEM", None, 5.0, None, None), ("f", "CONVERT", None, 1.0, None, None), ("g", "TRADE", "SELL", 2.0, None, None)]
    df = spark.createDataFrame(rows, "record_id string, kind string, side string, size double, price double, winner long").withColumns({"wallet": F.lit(1), "condition": F.lit(1), "asset": F.lit(7).cast("long"), "other_asset": F.lit(8).cast("long")})
    got = sorted((x.record_id, x.part, x.token_change, x.cash_change, x.accounting) for x in N.activity_events(df).collect())
    assert got == [("a", 0, 10.0, -4.0, "exact"), ("b", 0, 10.0, -10.0, "exact"), ("b", 1, 10.0, None, "exact"), ("c", 0, -4.0, 4.0, "exact"), ("c", 1, -4.0, None, "exact"), ("d", 0, -5.0, 5.0, "exact"), ("e", 0, None, None, "unresolved"), ("f", 0, None, None, "unresolved"), ("g", 0, -2.0, None, "inferred")]


def test_versions_and_inserts(spark):
    obs = spark.createDataFrame([("m", 1, "a"), ("m", 2, "a"), ("m", 3, "b"), ("m", 4, "a"), ("n", 1, None)], "market string, at int, content string")
    assert sorted((x.market, x.at, x.version_seq) for x in N.changes(obs, "market", "content", ["at"]).collect()) == [("m", 1, 1), ("m", 3, 2), ("m", 4, 3), ("n", 1, 1)]
    new = N.insert_new(obs.where("market = 'n'").select("market", "at"), obs, ["market"], ["at"])
    assert [(x.market, x.at) for x in new.collect()] == [("m", 1)]


def test_roles(spark):
    legs = spark.createDataFrame([("l1", 1, 9, 1, 0, "BUY", 1, 5.0, 0.4, 10.0), ("l2", 1, 8, 1, 0, "SELL", 1, 5.0, 0.4, 10.0), ("l3", 1, 9, 1, 1, "BUY", 1, 6.0, 0.4, 10.0), ("l4", 2, 9, 1, 0, "BUY", 1, 5.0, 0.4, 10.0), ("l5", 1, 7, 1, 3, "BUY", None, 5.0, 0.4, 10.0)], "leg_id string, tx int, wallet int, condition int, log_index int, side string, sign int, size double, price double, ts double")
    ex = spark.createDataFrame([(1, 1, 0, 5.0, 0.4, 11.0, 9)], "tx int, condition int, log_index int, size double, positive_price double, ts double, taker int")
    got = {x.leg_id: (x.liquidity_role, x.role_confidence) for x in N.reconcile_roles(legs, ex).collect()}
    assert got == {"l1": ("taker", "single_candidate"), "l2": ("maker", "single_candidate"), "l3": ("unknown", "ambiguous_taker_wallet"), "l4": ("unknown", "no_canonical_execution"), "l5": ("maker", "no_candidate_match")}


def test_book_metrics_drop_bad_levels(spark):
    level = "array<struct<price:double,size:double>>"
    df = spark.createDataFrame([(1, [(0.4, 10.0), (0.5, 0.0), (None, 3.0), (0.41, 5.0)], [(0.45, 15.0), (0.44, 5.0)]), (2, [], [])], f"id int, bids {level}, asks {level}")
    a, b = sorted(N.book_metrics(df).collect(), key=lambda x: x.id)
    assert (a.best_bid, a.best_ask, a.best_bid_size, a.best_ask_size, a.bid_depth, a.ask_depth) == (0.41, 0.44, 5.0, 5.0, 15.0, 20.0) and a.imbalance == pytest.approx(-5 / 35)
    assert b.best_bid is None and b.imbalance is None


def test_episodes_are_anchored(spark):
    legs = spark.createDataFrame([(1, 1, t, "BUY", s, 10.0, "taker") for t, s in ((0.0, 1), (3000.0, 1), (3600.0, -1), (6500.0, None), (7300.0, 1))], "wallet int, condition int, ts double, side string, sign int, size double, role string")
    got = sorted((x.anchor, x.n_legs, x.net, x.direction) for x in D.episodes(legs, 3600).collect())
    assert got == [(0.0, 2, 20.0, "positive"), (3600.0, 2, -10.0, "negative"), (7300.0, 1, 10.0, "positive")]


def test_positions_are_strictly_before_and_blind_to_the_future(spark):
    e = [(1, 1, 10.0, 5.0, -2.0), (1, 1, 20.0, 3.0, None), (1, 1, 30.0, None, None)]
    d = spark.createDataFrame([("x", 1, 1, 20.0), ("y", 1, 1, 31.0), ("z", 2, 1, 5.0)], "decision_id string, wallet int, condition int, t double")
    schema = "wallet int, condition int, ts double, token_change double, cash_change double"
    read = lambda rows: {x.decision_id: (x.tokens, x.cash, x.n_unresolved, x.complete) for x in D.position_asof(d, spark.createDataFrame(rows, schema)).collect()}
    assert read(e) == {"x": (5.0, -2.0, 0, True), "y": (8.0, -2.0, 1, False), "z": (0.0, 0.0, 0, True)}
    assert read(e) == read([*e, (1, 1, 31.0, 9.0, 9.0), (2, 1, 99.0, 1.0, 1.0)])


def test_decay_takes_each_family_once(spark):
    p = spark.createDataFrame([("d", "f", 21_600.0, 0.8, 1.0), ("d", "f", 21_600.0, 0.4, 1.0), ("d", "f", 0.0, 1.0, 1.0), ("d", "g", 21_600.0, 0.5, -1.0), ("d", "h", 3e9, 1.0, 1.0)], "decision_id string, family string, age double, relevance double, direction double").withColumns({"novelty": F.lit(None).cast("double"), "confidence": F.lit(1.0)})
    x = D.decayed_signals(p).first()
    assert (x.news_decay_positive_6h, x.news_decay_negative_6h, x.news_decay_signed_6h) == pytest.approx((0.4, 0.25, 0.15))


def test_viterbi_equals_exhaustive_search():
    r = np.random.default_rng(1)
    for penalty in (0.0, 0.7, 3.0):
        x, c = r.normal(size=(8, 5)), r.normal(size=(2, 5))
        cost = ((x[:, None] - c[None]) ** 2).sum(2)
        total = lambda m: sum(cost[t, k] for t, k in enumerate(m)) + penalty * sum(a != b for a, b in zip(m, m[1:], strict=False))  # noqa: B023, E731
        best = min(total(m) for m in itertools.product((0, 1), repeat=8))
        assert total(list(R.viterbi(x, c, penalty))) == pytest.approx(best)


def test_online_modes_ignore_the_future(spark):
    r = np.random.default_rng(2)
    rows = [("c", 1, float(t), *map(float, r.normal(size=5))) for t in range(12)]
    schema = "condition string, segment long, bin_start double, " + ", ".join(f"{d} double" for d in R.DIMENSIONS)
    c = [[-0.5] * 5, [0.5] * 5]
    read = lambda n: [x.mode_online for x in R.online_costs(spark.createDataFrame(rows[:n], schema), c, 1.0).orderBy("bin_start").collect()]
    assert read(7) == read(12)[:7]


def test_regressions(spark):
    r = np.random.default_rng(3)
    x, g = r.normal(size=(300, 2)), r.integers(0, 12, 300)
    y = 1 + x @ [2, -1] + r.normal(size=12)[g] + r.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(k)) for (a, b), c, k in zip(x, y, g, strict=True)], "a double, b double, y double, g int")
    got = S.ols_clustered(df, ["a", "b"], "y", "g")
    x1 = np.column_stack([np.ones(300), x])
    bread, beta = np.linalg.inv(x1.T @ x1), np.linalg.lstsq(x1, y, rcond=None)[0]
    s = np.array([(x1[g == k] * (y - x1 @ beta)[g == k, None]).sum(0) for k in range(12)])
    v = 12 / 11 * 299 / 297 * bread @ s.T @ s @ bread
    assert np.allclose(got["beta"], beta) and np.allclose(got["se"], np.sqrt(np.diag(v))) and got["clusters"] == 12
    assert S.wild_cluster_p(df, ["a", "b"], "y", 1, "g", draws=99) <= 0.02
    two = df.withColumn("label", F.when(F.col("y") > 1, 1).otherwise(-1))
    m = S.logistic(two, ["a", "b"], "label", l2=0.5)
    z = np.column_stack([np.ones(300), (x - x.mean(0)) / x.std(0)])
    grad = z.T @ (1 / (1 + np.exp(-z @ m["weights"])) - (y > 1)) + np.array([0, 0.5, 0.5]) * m["weights"]
    assert np.abs(grad).max() < 1e-6
    right = (F.col("p") > 0.5) == (F.col("label") > 0)
    p = two.select(S.predict(m).alias("p"), "label").agg(F.avg(right.cast("double"))).first()[0]
    assert p > 0.75
    ci = S.cluster_bootstrap(df, "g", "y").first()
    assert ci["low"] < ci["mean"] < ci["high"]


def test_folds_and_samples(spark):
    df = spark.createDataFrame([(i, float(i % 10 * 40_000)) for i in range(23)], "id int, t double")
    got = S.folds(df, "t", "id", 4).orderBy("t", "id").collect()
    assert [x.fold for x in got] == [0] * 6 + [1] * 6 + [2] * 6 + [3] * 5
    s = S.stratified_sample(df.withColumn("g", F.when(F.col("id") < 3, "a").otherwise("b")), "g", "id", 8, "x").collect()
    assert [x.g for x in s].count("a") == 3 and len(s) == 8


def test_multinomial_learns():
    r = np.random.default_rng(4)
    y = np.repeat([0, 1, 2], (80, 20, 20))
    x = r.normal(size=(120, 2)) + np.array([[0, 0], [4, 0], [0, 4]])[y]
    p = S.probabilities(S.multinomial(x, y, 3), x)
    assert (p.argmax(1) == y).mean() > 0.9 and np.allclose(p.sum(1), 1)


def test_latent_model_is_judged_on_all_decisions(spark, monkeypatch):
    from hindcast.plans import reasoning_plans as P

    r = np.random.default_rng(3)
    x = r.normal(size=(300, len(P.NAMES)))
    made = [(str(i), i % 10, 1 if v[0] + v[2] > 0 else -1, *map(float, v)) for i, v in enumerate(x)]
    rows = spark.createDataFrame(made, ["decision_id", "actor", "label", *P.NAMES])
    monkeypatch.setattr(P, "BOUND", 100)
    fitted = []
    fit = P.R.LatentModel.fit
    monkeypatch.setattr(P.R.LatentModel, "fit", lambda self, x, y: fitted.append((fit(self, x, y), y)) or self)
    got = P.latent_losses(spark, rows).first()
    (model, y), held = fitted[0], np.arange(300) % 10 % 4 == 0
    up = np.array([m[2] > 0 for m in made])[held]
    p = np.where(up, model.predict(x[held]), 1 - model.predict(x[held]))
    assert got.held_out == held.sum() and abs(got.loss + np.log(p).mean()) < 1e-9
    assert abs(got.constant_loss + np.log(np.where(up, y.mean(), 1 - y.mean())).mean()) < 1e-9 and 1 / 3 <= got.stability <= 1


def test_stream_bars_take_files_out_of_order(spark, tmp_path):
    from hindcast.plans import stream_plans

    for day in (20, 1, 10, 3):
        part = spark.sql(f"select cast(id as bigint) as event_id, 'a' as event_type, timestamp'2024-01-{day:02d} 10:00:00' as ts, 1.0D as value from range(5)")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert sum(r.n for r in stream_plans.stream_bars(spark, str(tmp_path)).collect()) == 20
