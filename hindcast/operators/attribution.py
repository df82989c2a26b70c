"""Which channel of features an action is attributed to: expanding folds, ablations, null refits, leave-block-out stability.

A run needs hundreds of penalised logistic fits: for each fold a full model and one without each channel, on the
training rows, on those without each of a few blocks, and on permuted labels. They are fitted together: one pass over the rows sums
the gradients and Hessians of all weight vectors, Spark adds the tasks' sums, and the driver makes a Newton step for each
fit, so that all fits cost the passes of one. What reaches the driver is k + k^2 numbers for each fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators.features import GROUPS
from hindcast.operators.lineage import stored
from hindcast.operators.stats import ranked

_NEWS = GROUPS["news"]
_FRESH = [n for n in _NEWS if not n.startswith("news_decay") and n != "news_missing"] + [n for n in _NEWS if n.endswith("_6h")]
#: Fixed names: the features of each channel, a partition of all.
CHANNELS = {
    "base": GROUPS["base"], "actor": GROUPS["actor"],
    "market_trend": ["mkt_last_price", "mkt_last_price_missing", "mkt_return_short", "mkt_return_long", "mkt_volatility", "mkt_state_from_executions", "mkt_volume"],
    "liquidity": ["mkt_spread", "mkt_spread_missing", "mkt_depth", "mkt_imbalance", "mkt_execution_rate"],
    "position": GROUPS["position"], "fresh_news": _FRESH, "persistent_news": [n for n in _NEWS if n not in _FRESH],
    "liquidity_state": GROUPS["paper"][:5], "impactful_news": GROUPS["paper"][5:11], "attention": GROUPS["paper"][11:],
}
NEWS_CHANNELS = ("fresh_news", "persistent_news")


@dataclass(frozen=True)
class Rules:
    """When an attribution is accepted."""

    min_delta: float = 0.05
    min_margin: float = 0.15
    min_stability: float = 0.6
    blocks: int = 4
    nulls: int = 3
    null_quantile: float = 0.95
    min_train: int = 55
    min_fold_mean: float = 0.02
    first_train: float = 0.3


@dataclass(frozen=True)
class Fold:
    """The rows from place a up to b are evaluated by models of the first train rows, which lie before the embargo."""

    a: int
    b: int
    train: int


def expanding_folds(placed: DataFrame, time: str, k: int, embargo: float, first_train: float) -> list[Fold]:
    """k blocks of what follows the first part, each trained on what lies before its start less the embargo; blocks that
    are empty or leave fewer than two training rows are no folds. placed: with __r and __all."""
    n = placed.agg(F.max("__all")).first()[0] or 0
    if n < 4:
        return []
    first = max(2, int(n * first_train))
    cuts = [first + sum(len(x) for x in np.array_split(np.empty(n - first), k)[:i]) for i in range(k + 1)]
    starts = {r["__r"]: r[time] for r in placed.where(F.col("__r").isin([c for c in cuts if c < n])).select("__r", time).collect()}
    found = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    before = placed.agg(*[F.count_if(F.col(time) < starts[a] - embargo).alias(f"f{i}") for i, (a, _) in enumerate(found)]).first()
    return [Fold(a, b, before[i]) for i, (a, b) in enumerate(found) if before[i] >= 2]


def permuted(placed: DataFrame, label: str, tie: str, times: int, bucket: int = 10_000) -> DataFrame:
    """placed with null_0, null_1, ...: the labels dealt anew among rows of one bucket of a seeded hash, so that all labels are used
    once and no task holds more than a few buckets."""
    rows, n = placed, placed.agg(F.max("__all")).first()[0] or 0
    for j in range(times):
        number = lambda salt, j=j: F.xxhash64(F.lit(f"{salt}{j}"), tie)
        at = F.pmod(number("bucket"), F.lit(max(1, n // bucket)))
        dealt = rows.withColumn("__b", at).withColumn("__p", F.row_number().over(Window.partitionBy("__b").orderBy(number("to"), tie)))
        given = placed.select(at.alias("__gb"), F.row_number().over(Window.partitionBy(at).orderBy(number("from"), tie)).alias("__gp"), F.col(label).alias(f"null_{j}"))
        rows = dealt.join(given, (F.col("__b") == F.col("__gb")) & (F.col("__p") == F.col("__gp"))).drop("__b", "__p", "__gb", "__gp")
    return rows


@dataclass(frozen=True)
class Fit:
    """A model: the fold it belongs to, the block it is trained without (or -1), the null labels (or -1), the channel it lacks."""

    fold: int
    block: int
    null: int
    channel: str | None


def fits_of(folds: list[Fold], channels: dict[str, list[str]], rules: Rules) -> list[Fit]:
    kinds = [(-1, -1), *((b, -1) for b in range(rules.blocks)), *((-1, j) for j in range(rules.nulls))]
    return [Fit(f, b, j, c) for f, fold in enumerate(folds) for b, j in kinds if b < 0 or fold.train >= 4 for c in (None, *channels)]


def _trained(fold: Fold, block: int, blocks: int, places: np.ndarray) -> np.ndarray:
    """Which places a fit is trained on; blocks are cut by time, as array_split cuts."""
    out = places < fold.train
    if block >= 0:
        cut = np.cumsum([0, *(len(x) for x in np.array_split(np.empty(fold.train), blocks))])
        out &= ~((places >= cut[block]) & (places < cut[block + 1]))
    return out


def fit_all(placed: DataFrame, folds: list[Fold], fits: list[Fit], channels: dict[str, list[str]], label: str, rules: Rules, l2: float = 1.0, rounds: int = 25, without: dict[str, list[str]] | None = None) -> dict:
    """Weights on standardised features (intercept first), means and deviations of each fit, and whether it converged.

    without: the features that a fit with that name in place of a channel lacks, those of the channel unless told otherwise.
    A deviation near 0 counts as 1, flags (_missing, _incomplete) aren't standardised, the intercept is not penalised.
    """
    names = [x for xs in channels.values() for x in xs]
    k, sets = len(names) + 1, sorted({(f.fold, f.block) for f in fits})
    flags = np.array([n.endswith(("_missing", "_incomplete")) for n in names])

    def summed(part, schema: str = "g int, i int, v double") -> dict[int, np.ndarray]:
        def run(batches):
            total = None
            for b in batches:
                x, places = b[names].to_numpy(float), b["__r"].to_numpy()
                got = part(b, x, places)
                total = got if total is None else [t + g for t, g in zip(total, got, strict=True)]
            for g, t in enumerate(total or []):
                yield pd.DataFrame({"g": g, "i": np.arange(len(t)), "v": t})

        rows = placed.mapInPandas(run, schema).groupBy("g", "i").agg(F.sum("v").alias("v")).toPandas()
        return {int(g): x.sort_values("i")["v"].to_numpy() for g, x in rows.groupby("g")}

    def moments(b, x, places):
        own = [x[_trained(folds[f], q, rules.blocks, places)] for f, q in sets]
        return [np.concatenate([[len(o)], o.sum(0), (o**2).sum(0)]) for o in own]

    scale = {}
    for g, v in summed(moments).items():
        n, m = max(1.0, v[0]), v[1:k] / max(1.0, v[0])
        s = np.sqrt(np.maximum(v[k:] / n - m**2, 0))
        scale[sets[g]] = np.where(flags, 0, m), np.where(flags | (s < 1e-9 * np.maximum(1, np.abs(m))), 1, s)
    keep = [np.array([0, *(1 + i for i, n in enumerate(names) if f.channel is None or n not in (without or channels)[f.channel])]) for f in fits]
    weights, done = np.zeros((len(fits), k)), np.zeros(len(fits), bool)
    for _ in range(rounds):
        open_ = [i for i in range(len(fits)) if not done[i]]
        if not open_:
            break

        def steps(b, x, places, open_=open_, weights=weights):
            labels = {j: (b[label if j < 0 else f"null_{j}"].to_numpy(float) + 1) / 2 for j in {fits[i].null for i in open_}}
            z, out = {}, []
            for i in open_:
                key = fits[i].fold, fits[i].block
                if key not in z:
                    use = _trained(folds[key[0]], key[1], rules.blocks, places)
                    z[key] = use, np.column_stack([np.ones(use.sum()), (x[use] - scale[key][0]) / scale[key][1]])
                use, own = z[key]
                p = 1 / (1 + np.exp(-np.clip(own @ weights[i], -500, 500)))
                out.append(np.concatenate([own.T @ (p - labels[fits[i].null][use]), ((own * (p * (1 - p))[:, None]).T @ own)[np.triu_indices(k)]]))
            return out

        for g, v in summed(steps).items():
            i, hessian = open_[g], np.zeros((k, k))
            hessian[np.triu_indices(k)] = v[k:]
            hessian = hessian + np.triu(hessian, 1).T
            penalty = np.array([0.0] + [l2] * (k - 1))
            at = keep[i]
            move = np.linalg.solve((hessian + np.diag(penalty + 1e-10))[np.ix_(at, at)], (v[:k] + penalty * weights[i])[at])
            weights[i, at] -= move
            done[i] = np.abs(move).max() < 1e-9 or not np.isfinite(move).all()
    ok = np.isfinite(weights).all(axis=1)
    return {"names": names, "weights": weights, "scale": scale, "ok": ok & done}


def scored(placed: DataFrame, folds: list[Fold], fits: list[Fit], model: dict, channels: dict[str, list[str]], ident: str, label: str) -> DataFrame:
    """Of each evaluated row: fold, n_train, p, observed_p, intercept, logit_<channel>, delta_<channel>, null_tops (the largest delta of each null
    that was fitted), stability (the share of blocks left out of which the same channel leads), fit_ok, ablation_ok."""
    names, kinds = model["names"], sorted({(f.block, f.null) for f in fits})
    where = {(f.fold, f.block, f.null, f.channel): i for i, f in enumerate(fits)}
    spots = {c: np.array([names.index(n) for n in xs]) for c, xs in channels.items()}
    columns = ["fold", "n_train", "p", "observed_p", "intercept", *(f"logit_{c}" for c in channels), *(f"delta_{c}" for c in channels), "null_tops", "stability", "fit_ok", "ablation_ok"]

    def run(batches):
        for b in batches:
            for f, fold in enumerate(folds):
                rows = b[(b["__r"] >= fold.a) & (b["__r"] < fold.b)]
                if not len(rows):
                    continue
                x, up = rows[names].to_numpy(float), rows[label].to_numpy() > 0

                def log_p(i, key, x=x, up=up):
                    m, s = model["scale"][key]
                    p = 1 / (1 + np.exp(-np.clip(model["weights"][i, 0] + (x - m) / s @ model["weights"][i, 1:], -500, 500)))
                    return p, np.log(np.maximum(np.where(up, p, 1 - p), 1e-12))

                def deltas(block, null, f=f):
                    key = (f, block)
                    full = log_p(where[f, block, null, None], key)[1]
                    ids = [where[f, block, null, c] for c in (None, *channels)]
                    return np.stack([full - log_p(where[f, block, null, c], key)[1] for c in channels], axis=1), bool(model["ok"][ids].all())

                own, _ = deltas(-1, -1)
                p = log_p(where[f, -1, -1, None], (f, -1))[0]
                tops, agree, valid = [], np.zeros(len(rows)), 0
                for block, null in kinds:
                    if (block, null) == (-1, -1) or (f, block, null, None) not in where:
                        continue
                    d, ok = deltas(block, null)
                    if ok and null >= 0:
                        tops.append(d.max(axis=1))
                    elif ok:
                        valid, agree = valid + 1, agree + (d.argmax(axis=1) == own.argmax(axis=1))
                m, s = model["scale"][f, -1]
                w = model["weights"][where[f, -1, -1, None]]
                parts = (x - m) / s * w[1:]
                out = {ident: rows[ident], "fold": f, "n_train": fold.train, "p": p, "observed_p": np.where(up, p, 1 - p), "intercept": w[0]}
                out |= {f"logit_{c}": parts[:, spots[c]].sum(axis=1) for c in channels} | {f"delta_{c}": own[:, i] for i, c in enumerate(channels)}
                out |= {"null_tops": list(np.stack(tops, axis=1)) if tops else [[]] * len(rows), "stability": agree / valid if valid else 0.0, "fit_ok": bool(model["ok"][where[f, -1, -1, None]]), "ablation_ok": bool(model["ok"][[where[f, -1, -1, c] for c in channels]].all())}
                yield pd.DataFrame(out)[[ident, *columns]]

    kinds_of = {"fold": "int", "n_train": "long", "null_tops": "array<double>", "fit_ok": "boolean", "ablation_ok": "boolean"}
    return placed.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in [(ident, dict(placed.dtypes)[ident]), *((c, kinds_of.get(c, "double")) for c in columns)]))


def attribute(decisions: DataFrame, label: str, time: str, ident: str, channels: dict[str, list[str]] = CHANNELS, coverage: Column | None = None, evidence: Column | None = None, k: int = 3, embargo: float = 0.0, l2: float = 1.0, rules: Rules = Rules()) -> DataFrame:
    """Of each decision: status, primary channel, top_delta, margin, stability, the null's threshold, confidence, and the parts they come from.

    decisions: ident (unique), label (+1, -1), time and the features of channels. coverage: whether the context is complete; evidence:
    whether a news channel has evidence. Both are true unless told otherwise. status is the first that holds of: a full model that didn't converge
    (insufficient_context), an ablated one (counterfactual_failure), no channel whose loss lowers the action's probability
    (counterfactual_failure), incomplete coverage, too few training rows (insufficient_context), a rule of acceptance not met (ambiguous),
    accepted. Decisions before the first evaluated block are insufficient_context without numbers.
    """
    names = [x for xs in channels.values() for x in xs]
    flags = {"coverage_ok": F.lit(True) if coverage is None else coverage, "evidence_ok": F.lit(True) if evidence is None else evidence}
    rows = stored(decisions.select(ident, label, time, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names], *[v.alias(n) for n, v in flags.items()]), "attributed")
    placed = stored(permuted(ranked(rows, time, ident), label, ident, rules.nulls), "placed")
    folds = expanding_folds(placed, time, k, embargo, rules.first_train)
    fits = fits_of(folds, channels, rules)
    model = fit_all(placed, folds, fits, channels, label, rules, l2) if fits else {"names": names, "weights": np.zeros((0, 0)), "scale": {}, "ok": np.zeros(0, bool)}
    made = stored(scored(placed, folds, fits, model, channels, ident, label), "scored")
    c = F.col
    nulls = made.select("fold", F.explode("null_tops").alias("top")).groupBy("fold").agg(F.percentile_approx("top", rules.null_quantile, 100_000).alias("null_threshold"))
    means = made.groupBy("fold").agg(*[F.avg(f"delta_{x}").alias(f"mean_{x}") for x in channels])
    by_fold = means.join(nulls, "fold", "left")
    rank = F.sort_array(F.array(*[F.struct(c(f"delta_{x}").alias("d"), F.lit(-i).alias("i"), F.lit(x).alias("c"), c(f"mean_{x}").alias("m")) for i, x in enumerate(channels)]), asc=False)
    made = made.join(F.broadcast(by_fold), "fold").withColumn("__k", rank)  # a row for each fold
    first, second = F.get("__k", F.lit(0)), F.get("__k", F.lit(1))
    made = made.withColumns({"leads": first["c"], "top_delta": first["d"], "margin": first["d"] - F.coalesce(second["d"], F.lit(0.0)), "fold_mean": first["m"], "null_top": F.greatest(F.coalesce("null_threshold", F.lit(0.0)), F.coalesce(F.array_max("null_tops"), F.lit(0.0)))})
    made = made.withColumn("margin_ratio", F.when(c("top_delta") > 0, c("margin") / c("top_delta")).otherwise(0.0))
    made = made.drop("__k").withColumnRenamed(ident, "__id")
    all_rows = rows.select(ident, label, time, *flags).join(made, c(ident) == c("__id"), "left").drop("__id")
    shown = F.when(c("leads").isin(*NEWS_CHANNELS), c("evidence_ok")).otherwise(True)
    weak = (c("top_delta") < rules.min_delta) | (c("margin_ratio") < rules.min_margin) | (c("stability") < rules.min_stability) | (c("top_delta") <= c("null_top")) | (c("fold_mean") < rules.min_fold_mean) | ~shown
    status = F.when(c("fold").isNull(), "insufficient_context").when(~c("fit_ok"), "insufficient_context").when(~c("ablation_ok"), "counterfactual_failure").when(c("top_delta") <= 0, "counterfactual_failure").when(~c("coverage_ok"), "insufficient_context").when(c("n_train") < rules.min_train, "insufficient_context").when(weak, "ambiguous").otherwise("accepted")
    share = lambda x, least: F.least(F.lit(1.0), x / (2 * least))
    sure = share(c("top_delta"), rules.min_delta) * share(c("margin_ratio"), rules.min_margin) * c("stability") * F.when(shown, 1.0).otherwise(0.5)
    out = all_rows.withColumn("status", status)
    confidence = F.when(c("fit_ok") & c("ablation_ok") & (c("top_delta") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))).otherwise(0.0)
    keep = ["fold", "n_train", "p", "observed_p", "intercept", *(f"{x}_{n}" for x in ("logit", "delta") for n in channels), "leads", "top_delta", "margin", "margin_ratio", "fold_mean", "stability", "null_top"]
    return out.select(ident, label, time, "status", F.when(c("status").isin("accepted", "ambiguous"), c("leads")).alias("primary"), confidence.alias("confidence"), *keep)


#: Fixed names: the groups of features of each nested model.
NESTED = {"M0": ["base"], "M1": ["base", "actor"], "M2": ["base", "actor", "market", "position"], "M3": ["base", "actor", "market", "position", "news"]}


def nested_predictions(decisions: DataFrame, label: str, time: str, ident: str, groups: dict[str, list[str]] = GROUPS, models: dict[str, list[str]] = NESTED, k: int = 3, embargo: float = 0.0, l2: float = 1.0, first_train: float = 0.3) -> DataFrame:
    """ident, label, time, fold, n_train and p_<model> of each evaluated decision: models of nested groups, all folds and models fitted
    together on the rows before each fold's start less the embargo. Tables too small for a fold give no rows."""
    used = {g: groups[g] for g in groups if any(g in gs for gs in models.values())}
    names = [x for xs in used.values() for x in xs]
    rows = stored(decisions.select(ident, label, time, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]), "nested")
    placed = stored(ranked(rows, time, ident), "placed")
    folds = expanding_folds(placed, time, k, embargo, first_train)
    fits = [Fit(f, -1, -1, m) for f in range(len(folds)) for m in models]
    without = {m: [x for g in used if g not in gs for x in used[g]] for m, gs in models.items()}
    model = fit_all(placed, folds, fits, used, label, Rules(), l2, without=without) if fits else None
    schema = ", ".join(f"`{c}` {t}" for c, t in [(c, dict(rows.dtypes)[c]) for c in (ident, label, time)] + [("fold", "int"), ("n_train", "long"), *((f"p_{m}", "double") for m in models)])

    def run(batches):
        for b in batches:
            for f, fold in enumerate(folds):
                own = b[(b["__r"] >= fold.a) & (b["__r"] < fold.b)]
                if len(own):
                    m, s = model["scale"][f, -1]
                    z = np.column_stack([np.ones(len(own)), (own[names].to_numpy(float) - m) / s])
                    p = {f"p_{x.channel}": 1 / (1 + np.exp(-np.clip(z @ w, -500, 500))) for x, w in zip(fits, model["weights"], strict=True) if x.fold == f}
                    yield pd.DataFrame({ident: own[ident], label: own[label], time: own[time], "fold": f, "n_train": fold.train} | p)

    return placed.mapInPandas(run, schema)


def nested_metrics(predictions: DataFrame, label: str, models: dict[str, list[str]] = NESTED) -> DataFrame:
    """model, n, brier, log_loss, accuracy and ece (ten bins, weighted by their rows) of each model."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("p")) for m in models])).alias("x")
    rows = predictions.select((F.col(label) > 0).cast("double").alias("y"), each).select("y", "x.*")
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("p")))
    by = rows.groupBy("model", F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("b"), F.sum(-(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))).alias("l"), F.sum(((F.col("p") >= 0.5) == (F.col("y") > 0)).cast("int")).alias("a"), F.abs(F.sum(F.col("p") - F.col("y"))).alias("e")
    )
    return by.groupBy("model").agg(F.sum("n").alias("n"), (F.sum("b") / F.sum("n")).alias("brier"), (F.sum("l") / F.sum("n")).alias("log_loss"), (F.sum("a") / F.sum("n")).alias("accuracy"), (F.sum("e") / F.sum("n")).alias("ece"))
