"""Attribution by many fits at once, against fits made one by one."""

import numpy as np

from hindcast.operators import attribution as A
from hindcast.operators.features import FEATURES
from hindcast.operators.stats import ranked

CHANNELS = {"trend": ["x0", "x1"], "news": ["x2", "x2_missing"], "noise": ["x3", "x4"]}
NAMES = [n for xs in CHANNELS.values() for n in xs]


def plain_fit(x, y, flags, l2=1.0):
    m, s = x.mean(0), x.std(0)
    m, s = np.where(flags, 0, m), np.where(flags | (s < 1e-9), 1, s)
    z = np.column_stack([np.ones(len(x)), (x - m) / s])
    w, penalty = np.zeros(z.shape[1]), np.array([0.0] + [l2] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-10), z.T @ (p - y) + penalty * w)
    return lambda q: 1 / (1 + np.exp(-np.column_stack([np.ones(len(q)), (q - m) / s]) @ w))


def world(spark, n=360, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, len(NAMES)))
    x[:, 3] = x[:, 3] > 0
    y = np.where(2.5 * x[:, 0] + r.logistic(size=n) > 0, 1, -1)
    t = np.sort(r.integers(0, 40 * 86_400, n)).astype(float)
    rows = [(f"d{i:04}", float(t[i]), int(y[i]), *map(float, x[i])) for i in r.permutation(n)]
    return x, y, t, spark.createDataFrame(rows, "id string, t double, y int, " + ", ".join(f"{c} double" for c in NAMES)).repartition(3)


def test_deltas_equal_separate_fits_and_folds_keep_the_embargo(spark):
    x, y, t, frame = world(spark)
    embargo, rules, n = 86_400.0, A.Rules(nulls=2, blocks=3), len(t)
    out = {r.id: r for r in A.attribute(frame, "y", "t", "id", CHANNELS, k=3, embargo=embargo, rules=rules).collect()}
    assert len(out) == n
    flags = np.array([c.endswith("_missing") for c in NAMES])
    first = int(n * 0.3)
    assert all(out[f"d{i:04}"].status == "insufficient_context" and out[f"d{i:04}"].p is None for i in range(first))
    up = (y + 1) / 2
    observed = lambda p, at: np.log(np.where(y[at] > 0, p, 1 - p))

    def deltas(train, at):
        full = observed(plain_fit(x[train], up[train], flags)(x[at]), at)
        made = []
        for xs in CHANNELS.values():
            keep = [i for i, c in enumerate(NAMES) if c not in xs]
            made.append(full - observed(plain_fit(x[train][:, keep], up[train], flags[keep])(x[at][:, keep]), at))
        return np.stack(made, axis=1)

    for f, block in enumerate(np.array_split(np.arange(first, n), 3)):
        train = np.flatnonzero(t < t[block[0]] - embargo)
        own = deltas(train, block)
        agree = sum(deltas(np.delete(train, b), block).argmax(1) == own.argmax(1) for b in np.array_split(np.arange(len(train)), 3)) / 3
        for j, i in enumerate(block):
            r = out[f"d{i:04}"]
            assert r.fold == f and r.n_train == len(train)
            assert np.allclose([r[f"delta_{c}"] for c in CHANNELS], own[j], atol=1e-7)
            assert abs(r.stability - agree[j]) < 1e-9 and abs(r.fold_mean - own.mean(0)[own[j].argmax()]) < 1e-7
            logit = r.intercept + sum(r[f"logit_{c}"] for c in CHANNELS)
            assert abs(1 / (1 + np.exp(-logit)) - r.p) < 1e-9
    accepted = [r for r in out.values() if r.status == "accepted"]
    assert len(accepted) > 30 and {r.primary for r in accepted} == {"trend"}
    assert all(r.top_delta > r.null_top and 0 < r.confidence <= 1 for r in accepted)
    assert {r.status for r in out.values()} == {"accepted", "ambiguous", "counterfactual_failure", "insufficient_context"}


def test_noise_is_not_accepted_and_null_labels_are_the_labels_dealt_anew(spark):
    x, y, t, frame = world(spark, 240, 5)
    noise = frame.selectExpr("id", "t", "if(pmod(xxhash64(id), 2) = 0, 1, -1) y", *NAMES)
    out = A.attribute(noise, "y", "t", "id", CHANNELS, rules=A.Rules(nulls=3, blocks=2)).collect()
    assert sum(r.status == "accepted" for r in out) < 0.1 * len(out)
    placed = A.permuted(ranked(frame, "t", "id"), "y", "id", 2, bucket=50).collect()
    assert len(placed) == 240 and all(sum(r[f"null_{j}"] for r in placed) == y.sum() for j in (0, 1))
    assert all(any(r[f"null_{j}"] != r.y for r in placed) for j in (0, 1))


def test_channels_part_all_features_and_small_tables_have_no_numbers(spark):
    assert sorted(x for xs in A.CHANNELS.values() for x in xs) == sorted(FEATURES) and len(FEATURES) == 68
    _, _, _, frame = world(spark, 12)
    for rows in (frame.limit(3), frame.limit(0)):
        out = A.attribute(rows, "y", "t", "id", CHANNELS).collect()
        assert len(out) == rows.count() and all(r.status == "insufficient_context" and r.confidence == 0 for r in out)


def test_nested_models_equal_separate_fits(spark):
    x, y, t, frame = world(spark, 200, 9)
    embargo, models = 43_200.0, {"small": ["news"], "large": ["news", "trend"]}
    made = A.nested_predictions(frame, "y", "t", "id", CHANNELS, models, k=2, embargo=embargo).cache()
    out = {r.id: r for r in made.collect()}
    flags = np.array([c.endswith("_missing") for c in NAMES])
    first, up = int(200 * 0.3), (y + 1) / 2
    assert sorted(out) == [f"d{i:04}" for i in range(first, 200)]
    for f, block in enumerate(np.array_split(np.arange(first, 200), 2)):
        train = np.flatnonzero(t < t[block[0]] - embargo)
        for m, groups in models.items():
            keep = [i for i, c in enumerate(NAMES) if any(c in CHANNELS[g] for g in groups)]
            want = plain_fit(x[train][:, keep], up[train], flags[keep])(x[block][:, keep])
            assert np.allclose([out[f"d{i:04}"][f"p_{m}"] for i in block], want, atol=1e-8) and {out[f"d{i:04}"].fold for i in block} == {f}
    got = {r.model: r for r in A.nested_metrics(made, "y", models).collect()}
    p, u = np.array([out[f"d{i:04}"].p_large for i in range(first, 200)]), up[first:]
    bins = np.minimum((p * 10).astype(int), 9)
    ece = sum(abs((p - u)[bins == b].sum()) for b in range(10)) / len(p)
    assert np.allclose([got["large"].brier, got["large"].log_loss, got["large"].accuracy, got["large"].ece], [((p - u) ** 2).mean(), -np.log(np.where(u > 0, p, 1 - p)).mean(), ((p >= 0.5) == (u > 0)).mean(), ece])
    assert got["large"].log_loss < got["small"].log_loss and A.nested_predictions(frame.limit(0), "y", "t", "id", CHANNELS, models).count() == 0
