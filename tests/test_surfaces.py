"""Many surfaces in one pass, the censor and what it guards, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from hindcast.operators import censor, features
from hindcast.operators import outcomes as O
from hindcast.operators.asof import SLICE
from hindcast.operators.surfaces import Probe, Surface, dense_slice, exact, read_surfaces, span

KEYS = ["a", "b", None]


def test_surfaces_equal_plain_reads(spark):
    r = random.Random(1)
    left = [(i, r.choice(KEYS), float(r.choice([r.randrange(60), r.randrange(60) * 10])) if r.random() < 0.95 else None) for i in range(150)]
    prices = [(r.choice(KEYS), float(r.randrange(600)) if r.random() < 0.95 else None, i, round(r.random(), 3)) for i in range(200)]
    marks = [(r.choice(KEYS), float(r.randrange(600)), r.randrange(100)) for _ in range(80)]
    surfaces = [
        Surface("price", spark.createDataFrame(prices, "k string, ts double, n long, p double"), "ts", last=("p",), order=("n",), sums={"rows": F.lit(1), "p": exact(F.col("p"))}),
        Surface("mark", spark.createDataFrame(marks, "k string, at double, m long"), "at", highest={"m": F.col("m")}),
    ]
    probes = [Probe("now", F.col("t")), Probe("with", F.col("t"), strict=False), Probe("since", F.col("t") - 100)]
    rows = spark.createDataFrame(left, "id long, k string, t double")
    for width in (50.0, 1e6):
        got = read_surfaces(rows, ["k"], ["id"], probes, surfaces, slice_seconds=width)
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("hashpartitioning") <= 5
        by = {x.id: x for x in got.withColumns({"n": span("price", "rows", "now", "since"), "p": span("price", "p", "now", "since")}).collect()}
        assert len(by) == len(left)
        for i, k, t in left:
            for name, until, strict in (("now", t, True), ("with", t, False), ("since", t and t - 100 if t is not None else None, True)):
                seen = lambda x, until=until, strict=strict: until is not None and x is not None and (x < until or not strict and x == until)
                known = [x for x in prices if x[0] == k and seen(x[1])]
                best = max(known, key=lambda x: (x[1], x[2]), default=None)
                x = by[i][f"price_{name}"]
                assert (best and best[3]) == (x["last"] and x["last"]["p"]) and x["rows"] == len(known) and float(x["p"]) == round(sum(v[3] for v in known), 9)
                assert by[i][f"mark_{name}"]["m"] == max((m[2] for m in marks if m[0] == k and seen(m[1])), default=None)
            if t is not None:
                within = [x[3] for x in prices if x[0] == k and x[1] is not None and t - 100 <= x[1] < t]
                assert by[i]["n"] == len(within) and float(by[i]["p"]) == round(sum(within), 9)


def plain_reasons(key, start, end, statuses, versions, gaps):
    own = lambda rows: [x[1:] for x in rows if x[0] == key]
    out = []
    before = sorted(x for x in own(statuses) if x[0] <= start)
    out += ["status_unknown"] if not before else ["status_blocking"] if before[-1][1] else []
    out += ["closes_inside"] if any(start < t <= end and b for t, b in own(statuses)) else []
    times = [v[0] for v in own(versions)]
    out += ["contract_unknown"] if not any(t < start + 1e-9 for t in times) else ["contract_changed"] if any(start + 1e-9 <= t <= end for t in times) else []
    ends = [v[1] for v in own(versions) if v[1] is not None]
    out += ["resolves_inside"] if ends and end >= min(ends) else []
    out += ["collector_gap"] if any(a <= end and (b is None or b >= start) for a, b in own(gaps)) else []
    return ",".join(out), max(0.0, min(ends) - start) if ends else None


def lifecycles(spark, r):
    statuses = [(r.choice("abc"), float(r.randrange(300)), r.random() < 0.25) for _ in range(12)]
    versions = [(r.choice("abc"), float(r.randrange(-50, 300)), float(r.randrange(150, 400)) if r.random() < 0.5 else None) for _ in range(6)]
    gaps = [(r.choice("abcd"), float(r.randrange(300)), None) for _ in range(2)]
    gaps += [(k, a, a + r.choice([0, 3, 150])) for k, a in ((r.choice("abc"), float(r.randrange(300))) for _ in range(3))]
    frames = spark.createDataFrame(statuses, "k string, effective_from double, blocking boolean"), spark.createDataFrame(versions, "k string, effective_from double, resolution_time double"), spark.createDataFrame(gaps, "k string, gap_start double, gap_end double")
    return (statuses, versions, gaps), frames


def test_the_censor_gives_every_reason_against_a_window(spark):
    found = set()
    for seed in range(3):
        r = random.Random(seed)
        plain, frames = lifecycles(spark, r)
        windows = [(i, r.choice("abcd"), float(s), float(s + r.choice([0, 5, 20, 60]))) for i, s in enumerate(r.randrange(-20, 320) for _ in range(120))]
        got = censor.open_through(spark.createDataFrame(windows, "id long, k string, a double, z double"), ["k"], ["id"], "a", "z", *frames, slice_seconds=37.0)
        by = {x.id: x for x in got.collect()}
        for i, k, a, z in windows:
            reasons, left = plain_reasons(k, a, z, *plain)
            assert (by[i].reasons, by[i].open_through, by[i].time_to_resolution) == (reasons, not reasons, left)
            found |= set(reasons.split(","))
    assert found == {"", *censor.REASONS}


def test_without_statuses_versions_or_gaps_nothing_is_open(spark):
    _, frames = lifecycles(spark, random.Random(1))
    windows = spark.createDataFrame([(1, "a", 5.0, 9.0)], "id long, k string, a double, z double")
    assert [x.reasons for x in censor.open_through(windows, ["k"], ["id"], "a", "z", *(f.limit(0) for f in frames)).collect()] == ["status_unknown,contract_unknown"]
    assert censor.open_through(windows.limit(0), ["k"], ["id"], "a", "z", *frames).count() == 0


def test_responses_and_outcomes_equal_plain_loops(spark):
    r, bar, drift = random.Random(7), 10.0, 60.0
    plain = [("a", -9.0, False), ("b", -9.0, False), ("c", 50.0, False), ("a", 200.0, True), ("a", 230.0, False)], [("a", -9.0, 300.0), ("b", -9.0, None), ("b", 190.0, None), ("c", 9.0, None)], [("c", 250.0, None), ("b", 90.0, 95.0)]
    names = ("effective_from double, blocking boolean", "effective_from double, resolution_time double", "gap_start double, gap_end double")
    frames = [spark.createDataFrame(rows, f"condition string, {n}") for rows, n in zip(plain, names, strict=True)]
    closes = [(k, b * bar, round(r.uniform(-1, 1), 6)) for k in "abc" for b in range(40) if r.random() < 0.8]
    news = sorted({(i, r.choice("abc"), float(r.randrange(330))) for i in range(150)})
    close = spark.createDataFrame(closes, "condition string, bar_end double, close double")

    def base(k, t):
        own = [x for x in closes if x[0] == k and x[1] <= t]
        return max(own, key=lambda x: x[1]) if own and t - max(x[1] for x in own) <= 2 * bar else None

    def near(k, target, after):
        own = [x for x in closes if x[0] == k and after < x[1] and abs(x[1] - target) <= bar]
        return min(own, key=lambda x: (abs(x[1] - target), -x[1])) if own else None

    want = []
    for i, k, t in news:
        c0 = base(k, t)
        c1 = c0 and near(k, t + bar, t)
        c2 = c1 and near(k, t + drift, c1[1])
        open_ = not plain_reasons(k, t, t + drift, *plain)[0]
        done = bool(open_ and c2)
        a, b = (c1[2] - c0[2], c2[2] - c1[2]) if done else (None, None)
        want.append((i, any(o[1] == k and t < o[2] <= t + drift for o in news), done, a, b, a * b > 0 if done else None, abs(a) / (abs(a) + abs(b)) if done and abs(a) + abs(b) else None))
    made = O.absorption(spark.createDataFrame(news, "id long, condition string, ts double"), close, *frames, ["id"], bar, drift=drift)
    assert sorted(tuple(x) for x in made.select("id", "intervening", "complete", "initial_response", "later_drift", "same_direction", "absorbed").collect()) == want
    assert 3 < sum(w[2] for w in want) < len(want)

    decisions = [(i, k, t, r.choice([1, -1, None])) for i, k, t in news]
    want = []
    for i, k, t, d in decisions:
        c0 = base(k, t)
        for h in (bar, drift):
            c1 = c0 and near(k, t + h, c0[1])
            status = "no_base_close" if not c0 else "censored" if plain_reasons(k, t, t + h, *plain)[0] else "observed" if c1 else "stale_endpoint"
            move = c1[2] - c0[2] if status == "observed" else None
            want.append((i, h, status, move, d * move > 0 if move is not None and d else None))
    made = O.outcomes(spark.createDataFrame(decisions, "id long, condition string, t double, direction int"), close, *frames, ["id"], bar, (bar, drift))
    assert sorted(tuple(x) for x in made.select("id", "horizon", "status", "drift", "same_direction").collect()) == want
    assert {w[2] for w in want} == {"no_base_close", "censored", "stale_endpoint", "observed"}


TABLES = {
    "contracts": "condition string, effective_from double, resolution_time double", "statuses": "condition string, effective_from double, blocking boolean",
    "books": "condition string, ts double, event_id long, token int, mid double, spread double, depth double, imbalance double", "executions": "condition string, ts double, event_id long, size double, price double",
    "legs": "wallet long, condition string, ts double, leg_id long, side string, size double, sign int, token int, resolved boolean",
    "judgments": "condition string, family string, at double, article long, rel_score double, rel_class string, direction int, novelty double, surprise double, confidence double",
    "articles": "article long, seen_at double, published_at double, source string", "claims": "article long, seen_at double, family string", "modes": "condition string, end double, label string",
    "screens": "condition string, ts double, available_at double, status string, transition int", "closes": "condition string, bar_end double, close double",
}


def test_only_decisions_go_through_the_passes_of_contexts(spark, monkeypatch):
    """What one pass has found isn't carried, once for each probe, through the next one's exchange and sort."""
    seen, read = [], features.read_surfaces

    def watched(left, by, ident, probes, surfaces, *args, **more):
        if "decision_id" in ident:
            seen.append(set(left.columns))
            assert len({id(s.rows) for s in surfaces if s.name in ("yes", "no", "book")}) <= 1
        return read(left, by, ident, probes, surfaces, *args, **more)

    monkeypatch.setattr(features, "read_surfaces", watched)
    monkeypatch.setattr(features, "stored", lambda df, name="": df)
    tables = features.Tables(**{n: spark.createDataFrame([], s) for n, s in TABLES.items()})
    own = {"decision_id", "wallet", "condition", "t"}
    made = features.contexts(spark.createDataFrame([(1, 2, "a", 3.0)], "decision_id long, wallet long, condition string, t double"), tables)
    assert len(seen) == 5 and all(s <= own | {"__all", "band"} for s in seen)
    assert own < set(made.columns) and len(made.columns) == len(set(made.columns))


def test_surfaces_of_the_same_rows_share_them(spark):
    r = random.Random(7)
    rows = spark.createDataFrame([("ab"[r.randrange(2)], float(r.randrange(40)), i, r.randrange(3), r.choice([None, i % 5])) for i in range(120)], "k string, ts double, i int, kind int, v int")
    looks = spark.createDataFrame([("ab"[i % 2], float(i), i) for i in range(45)], "k string, t double, id int")
    probes = [Probe("now", F.col("t")), Probe("low", F.col("t") - 9.0)]
    kinds = {"x": F.col("kind") == 0, "y": F.col("kind") == 1, "z": F.col("v").isNotNull()}
    make = lambda n, df, **more: Surface(n, df, "ts", last=("i", "v"), ahead=("i",), order=("i",), sums={"n": F.lit(1), "v": F.col("v")}, highest={"h": F.col("v")}, **more)
    apart = read_surfaces(looks, ["k"], ["id"], probes, [make(n, rows.where(w)) for n, w in kinds.items()], slice_seconds=7.0)
    shared = read_surfaces(looks, ["k"], ["id"], probes, [make(n, rows, where=w) for n, w in kinds.items()], slice_seconds=7.0)
    assert shared.columns == apart.columns and sorted(map(str, shared.collect())) == sorted(map(str, apart.collect()))
    some = read_surfaces(looks, ["k"], ["id"], probes, [make(n, rows, where=w, probes=("low",) if n == "y" else ()) for n, w in kinds.items()], slice_seconds=7.0)
    assert some.columns == [c for c in apart.columns if c != "y_now"] and sorted(map(str, some.collect())) == sorted(map(str, apart.drop("y_now").collect()))


def test_busy_keys_have_shorter_slices(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", float(1000 * i)) for i in range(100)] + [("c", None), ("d", 1.0)], "k string, t double")
    assert dense_slice(rows, ["k"], "t", 5.0, target=20) == pytest.approx(19.8)
    assert dense_slice(rows, ["k"], "t", 50.0, target=20) == 50.0
    assert dense_slice(rows.where("k = 'd'"), ["k"], "t", 5.0) == SLICE
