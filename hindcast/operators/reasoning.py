"""Attribution, counterfactuals, template posterior and decision records, as columns over a table of features.

Fits are small (tens of features) and are made on the driver from bounded matrices or by Spark-summed Newton steps;
scoring, interventions, gates and records are projections.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.operators import stats as S

#: Fixed names: the channels of an attribution and the features that make them up here.
CHANNELS = {
    "fresh_news": ["news_decay_signed_6h", "news_decay_signed_24h"],
    "persistent_news": ["news_decay_signed_72h", "news_decay_signed_168h"],
    "market_trend": ["mkt_return_short", "mkt_return_long", "mkt_volatility"],
    "liquidity": ["mkt_spread", "mkt_depth", "mkt_imbalance"],
    "actor": ["act_recent_trade_count", "act_recent_net_prop_change"],
    "position": ["pos_net_proposition"],
}
#: What each intervention sets. None stands for the training mean of the feature.
INTERVENTIONS = {
    "remove_fresh_news": {**dict.fromkeys(CHANNELS["fresh_news"], 0.0), "news_recent_missing": 1.0},
    "remove_persistent_news": {**dict.fromkeys(CHANNELS["persistent_news"], 0.0), "news_decay_missing": 1.0},
    "remove_all_news": {**dict.fromkeys(CHANNELS["fresh_news"] + CHANNELS["persistent_news"], 0.0), "news_recent_missing": 1.0, "news_decay_missing": 1.0},
    "flatten_market_trend": dict.fromkeys(CHANNELS["market_trend"], 0.0),
    "neutralise_position": dict.fromkeys(CHANNELS["position"], 0.0),
    "replace_liquidity_with_training_reference": dict.fromkeys(CHANNELS["liquidity"]),
    "remove_actor_history": dict.fromkeys(CHANNELS["actor"], 0.0),
}
#: Each template's channels and the counterfactual that it requires.
TEMPLATES = {
    "FRESH_NEWS_RESPONSE": (["fresh_news"], "remove_fresh_news"),
    "PERSISTENT_NEWS_ADJUSTMENT": (["persistent_news"], "remove_persistent_news"),
    "MARKET_MOMENTUM": (["market_trend"], "flatten_market_trend"),
    "CONTRARIAN_REVERSAL": (["market_trend"], "flatten_market_trend"),
    "INVENTORY_REBALANCING": (["position"], "neutralise_position"),
    "POSITION_BUILDING": (["position"], "neutralise_position"),
    "LIQUIDITY_TIMING": (["liquidity"], "replace_liquidity_with_training_reference"),
    "ACTOR_PRIOR": (["actor"], "remove_actor_history"),
    "MIXED_OR_UNRESOLVED": ([], None),
}
MATERIALITY, MIXED = 0.02, 0.25
TOP_PROBABILITY, TOP_MARGIN, TOP_ENTROPY = 0.40, 0.10, 1.8
MIN_DELTA, MIN_MARGIN, MIN_STABILITY, MIN_FOLD, MIN_TRAIN = 0.05, 0.15, 0.6, 0.02, 55


def log_observed(p: Column, label: Column) -> Column:
    """ln of the probability of the action that was seen."""
    return F.ln(F.greatest(F.when(label == 1, p).otherwise(F.lit(1.0) - p), F.lit(1e-12)))


def counterfactual_deltas(features: DataFrame, model: dict, label: str = "label") -> DataFrame:
    """features with delta_<intervention>: how much less likely the observed action is without what it takes away."""
    full = log_observed(S.predict(model), F.col(label))
    out = {}
    for name, values in INTERVENTIONS.items():
        z = F.lit(float(model["weights"][0]))
        for b, x in zip(model["weights"][1:], model["names"], strict=True):
            m, s = model["scale"][x]
            value = F.lit(m if values[x] is None else values[x]) if x in values else F.col(x).cast("double")
            z = z + float(b) * (value - m) / s
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))
        out[f"delta_{name}"] = full - log_observed(p, F.col(label))
    return features.withColumns(out)


def decomposition(features: DataFrame, model: dict) -> DataFrame:
    """features with logit_<channel>, logit_rest and p; the parts and the intercept add up to the logit of p."""
    part = {x: float(b) * (F.col(x).cast("double") - model["scale"][x][0]) / model["scale"][x][1] for b, x in zip(model["weights"][1:], model["names"], strict=True)}
    zero = F.lit(0.0)
    out = {f"logit_{c}": sum((part[x] for x in xs if x in part), zero) for c, xs in CHANNELS.items()}
    named = {x for xs in CHANNELS.values() for x in xs}
    out["logit_rest"] = sum((v for x, v in part.items() if x not in named), F.lit(float(model["weights"][0])))
    return features.withColumns(out | {"p": S.predict(model)})


def attribution_status(d: DataFrame) -> DataFrame:
    """d (top_delta, margin_ratio, stability, above_null, fold_mean, has_news, fit_ok, ablation_ok, coverage_ok, n_train) with status, by the first rule that holds."""
    c = F.col
    weak = (c("top_delta") < MIN_DELTA) | (c("margin_ratio") < MIN_MARGIN) | (c("stability") < MIN_STABILITY) | ~c("above_null") | (c("fold_mean") < MIN_FOLD) | ~c("has_news")
    status = F.when(~c("fit_ok"), "insufficient_context").when(~c("ablation_ok"), "counterfactual_failure").when(c("top_delta") <= 0, "counterfactual_failure").when(~c("coverage_ok"), "insufficient_context").when(c("n_train") < MIN_TRAIN, "insufficient_context").when(weak, "ambiguous")
    return d.withColumn("status", status.otherwise("accepted"))


def ablations(rows: DataFrame, names: list[str], label: str, train: Column, rounds: int = 8) -> DataFrame:
    """The rows that aren't in train with delta_<channel>: the log-probability lost by a model fitted without the channel; primary and margin.

    rows are read once for each round of the fits, all of which take the same passes; so they must be cheap to compute again, as a stored table is.
    """
    left = {c: [n for n in names if n not in xs] for c, xs in CHANNELS.items()}
    left = {c: kept for c, kept in left.items() if kept and len(kept) < len(names)}
    full, *without = [log_observed(S.predict(m), F.col(label)) for m in S.logistics(rows.where(train), [names, *left.values()], label, rounds=rounds, keep=False)]
    out = {f"delta_{c}": full - seen for c, seen in zip(left, without, strict=True)}
    made = rows.where(~train).withColumns(out)
    ranked = F.sort_array(F.array(*[F.struct(F.col(k).alias("d"), F.lit(k.removeprefix("delta_")).alias("c")) for k in out]), asc=False)
    return made.withColumn("r", ranked).withColumns({"primary": F.get("r", F.lit(0))["c"], "top_delta": F.get("r", F.lit(0))["d"], "margin": F.get("r", F.lit(0))["d"] - F.get("r", F.lit(1))["d"]}).drop("r")


def template_posterior(d: DataFrame, weights: np.ndarray, features: list[str], temperature: float = 1.0) -> DataFrame:
    """d with probabilities (map of template), top, top_p, entropy and confident: softmax of linear scores, gated."""
    names = list(TEMPLATES)
    z = [sum((float(w) * F.col(x).cast("double") for w, x in zip(row[1:], features, strict=True)), F.lit(float(row[0]))) / temperature for row in weights]
    rows = d.withColumn("z", F.array(*z)).withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    rows = rows.withColumn("p", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)))
    sorted_ = F.sort_array("p", asc=False)
    out = {
        "probabilities": F.map_from_arrays(F.array(*map(F.lit, names)), F.col("p")), "top": F.element_at(F.array(*map(F.lit, names)), F.array_position("p", F.array_max("p")).cast("int")), "top_p": F.array_max("p"),
        "entropy": -F.aggregate("p", F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.ln(x)).otherwise(0.0)), "lead": F.get(sorted_, F.lit(0)) - F.get(sorted_, F.lit(1)),
    }
    rows = rows.withColumns(out)
    return rows.withColumn("confident", (F.col("top_p") >= TOP_PROBABILITY) & (F.col("lead") >= TOP_MARGIN) & (F.col("entropy") <= TOP_ENTROPY)).drop("z", "e", "p", "lead")


def decision_records(d: DataFrame) -> DataFrame:
    """d (decision_id, label, status, primary, top, top_p, probabilities, confident and the deltas of channels and interventions) as records.

    agreement is the mean of three parts: the template's channel is the attribution's (1) or at least material (0.6),
    its counterfactual passes, its evidence is there. Disagreement of an accepted attribution with its template is said
    aloud, and a failed counterfactual or missing context comes first.
    """
    names = [n for n in TEMPLATES if TEMPLATES[n][0]]
    expected = F.coalesce(*[F.when(F.col("top") == n, F.array(*map(F.lit, TEMPLATES[n][0]))) for n in names], F.array().cast("array<string>"))
    there = {c for c in d.columns if c.startswith("delta_")}
    material = F.coalesce(*[F.when(F.col("top") == n, F.greatest(*[F.col(f"delta_{c}") for c in TEMPLATES[n][0]], F.lit(-1e300)) >= MATERIALITY) for n in names if all(f"delta_{c}" in there for c in TEMPLATES[n][0])], F.lit(False))
    passed = F.coalesce(*[F.when(F.col("top") == n, F.col(f"delta_{TEMPLATES[n][1]}") >= MATERIALITY) for n in names], F.lit(False))
    own = F.array_contains(expected, F.col("primary"))
    agreement = F.when(F.size(expected) == 0, 0.0).otherwise((F.when(own, 1.0).when(material, 0.6).otherwise(0.0) + passed.cast("double") + F.lit(1.0)) / 3)
    mixed = F.element_at("probabilities", F.lit("MIXED_OR_UNRESOLVED")) >= MIXED
    differ = (F.col("status") == "accepted") & (F.size(expected) > 0) & ~own & ~material & ~mixed
    status = F.when(F.col("status") == "insufficient_context", "insufficient_context").when((F.size(expected) > 0) & ~passed, "counterfactual_failure").when(differ, "attribution_template_disagreement").when(~F.col("confident"), "ambiguous").otherwise(F.col("status"))
    rows = d.withColumns({"agreement_score": agreement, "final": status})
    confidence = F.when(F.col("final") == "accepted", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("top_p") * (F.lit(0.5) + 0.5 * F.col("agreement_score"))))).otherwise(0.0)
    return rows.select("decision_id", F.struct(F.col("label").alias("action")).alias("D"), F.struct(F.col("status").alias("attribution_status"), "primary").alias("C"), F.struct(F.col("top").alias("primary_template"), "top_p", "agreement_score").alias("R"), F.col("final").alias("status"), confidence.alias("confidence"))


class LatentModel:
    """A rank-k encoder and a linear decoder of binary actions, by gradient descent on a bounded matrix."""

    def __init__(self, k: int = 3, rounds: int = 800, rate: float = 0.05, l2: float = 0.01, seed: int = 0):
        self.k, self.rounds, self.rate, self.l2, self.seed = k, rounds, rate, l2, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> LatentModel:
        r = np.random.default_rng(self.seed)
        self.mean, self.std = x.mean(0), np.where(x.std(0) < 1e-12, 1, x.std(0))
        z = (x - self.mean) / self.std
        self.w, self.v, self.b = r.normal(0, 0.1, (x.shape[1], self.k)), r.normal(0, 0.1, self.k), 0.0
        for _ in range(self.rounds):
            h = z @ self.w
            e = (1 / (1 + np.exp(-np.clip(h @ self.v + self.b, -30, 30))) - y) / len(y)
            gv, gw = h.T @ e + self.l2 * self.v, np.outer(z.T @ e, self.v) + self.l2 * self.w
            self.v, self.w, self.b = self.v - self.rate * len(y) ** 0.5 * gv, self.w - self.rate * len(y) ** 0.5 * gw, self.b - self.rate * len(y) ** 0.5 * e.sum()
        return self

    def codes(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.std @ self.w

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.codes(x) @ self.v + self.b, -30, 30)))


def kmeans(x: np.ndarray, k: int, restarts: int = 8, rounds: int = 50, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centers and assignment of least inertia over restarts, for bounded matrices."""
    r, best = np.random.default_rng(seed), None
    for _ in range(restarts):
        c = x[r.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            a = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            new = np.array([x[a == i].mean(0) if (a == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        inertia = ((x - c[a]) ** 2).sum()
        if best is None or inertia < best[0]:
            best = (inertia, c, a)
    return best[1], best[2]


def cluster_stability(a: np.ndarray, b: np.ndarray) -> float:
    """The share of rows that two clusterings agree on under a greedy matching of their clusters."""
    t = np.zeros((a.max() + 1, b.max() + 1), int)
    np.add.at(t, (a, b), 1)
    return agreement(t)


def agreement(counts: np.ndarray) -> float:
    """cluster_stability() from the rows counted by both clusterings."""
    t, agreed, n = counts.copy(), 0, counts.sum()
    while t.max() > 0:
        i, j = np.unravel_index(t.argmax(), t.shape)
        agreed += t[i, j]
        t[i, :], t[:, j] = 0, 0
    return agreed / n
