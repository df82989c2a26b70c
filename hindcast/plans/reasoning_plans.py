"""Attribution, counterfactuals, posterior, records and the latent model over a table of decisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hindcast.functions import exprs as X
from hindcast.operators import reasoning as R
from hindcast.operators import stats as S
from hindcast.operators.lineage import stored
from hindcast.plans.study import rounded
from hindcast.sources.adapters import table

NAMES = [x for xs in R.CHANNELS.values() for x in xs]
#: At most so many decisions reach the driver to fit a model of fixed size.
BOUND = 2000


def decisions(spark, sf_dir):
    """Line items as decisions, each once: the columns that its features are made of."""
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(*keys, "l_shipdate", "l_suppkey").dropDuplicates(list(keys))


def features(rows):
    """A feature table from decisions(): each channel's features are scaled columns, the action follows some of them.

    Features are hashes, so they are made anew by every pass and neither shuffled nor stored.
    """
    h = lambda i: F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.lit(i)), F.lit(2000)) / 1000.0 - 1.0
    ident = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")])
    rows = rows.select(ident.alias("decision_id"), X.epoch("l_shipdate").alias("t"), F.col("l_suppkey").alias("actor"), *[h(i).alias(n) for i, n in enumerate(NAMES)])
    drive = 2.0 * F.col(NAMES[0]) + 1.5 * F.col("mkt_return_short") - F.col("pos_net_proposition") + 0.5 * F.pmod(F.xxhash64("decision_id"), F.lit(1000)) / 500.0 - 0.5
    return rows.withColumn("label", F.when(drive > 0, 1).otherwise(-1)).withColumns({"news_recent_missing": F.lit(0.0), "news_decay_missing": F.lit(0.0)})


def kept_features(spark, sf_dir):
    """features() for jobs that read them more than once: the decisions are stored, so that they are shuffled once."""
    return features(stored(decisions(spark, sf_dir), "decisions"))


def cut(rows):
    """The time before which three quarters of the decisions are."""
    return rows.approxQuantile("t", [0.75], 0.01)[0]


def counterfactuals(spark, sf_dir):
    rows = kept_features(spark, sf_dir)
    made = R.counterfactual_deltas(rows, *S.logistics(rows, [NAMES], "label", rounds=6, keep=False))
    return rounded(made.agg(*[F.avg(f"delta_{k}").alias(k) for k in R.INTERVENTIONS]), 6)


def attribution(spark, sf_dir):
    rows = kept_features(spark, sf_dir)
    made = R.ablations(rows, NAMES, "label", F.col("t") < cut(rows), rounds=5)
    return rounded(made.groupBy("primary").agg(F.count("*").alias("n"), F.avg("top_delta").alias("mean_delta"), F.avg("margin").alias("mean_margin")), 6)


def posterior_weights():
    """Hand-set template scores: each template is drawn to its channel's first feature."""
    w = np.zeros((len(R.TEMPLATES), len(NAMES) + 1))
    for i, (channels, _) in enumerate(R.TEMPLATES.values()):
        for c in channels:
            w[i, 1 + NAMES.index(R.CHANNELS[c][0])] = 3.0
    return w


def posterior(spark, sf_dir):
    made = R.template_posterior(features(decisions(spark, sf_dir)), posterior_weights(), NAMES)
    return rounded(made.groupBy("top").agg(F.count("*").alias("n"), F.avg("top_p").alias("top_p"), F.avg("entropy").alias("entropy"), F.count_if("confident").alias("confident")), 6)


def drc_records(spark, sf_dir):
    rows = kept_features(spark, sf_dir)
    model = S.logistics(rows, [NAMES], "label", rounds=6, keep=False)[0]
    made = R.ablations(rows, NAMES, "label", F.col("t") < cut(rows), rounds=4)
    made = R.template_posterior(R.counterfactual_deltas(made, model), posterior_weights(), NAMES)
    made = R.attribution_status(made.withColumns({"margin_ratio": F.col("margin") / F.greatest(F.col("top_delta"), F.lit(1e-9)), "stability": F.lit(1.0), "above_null": F.lit(True), "fold_mean": F.col("top_delta"), "has_news": F.lit(True), "fit_ok": F.lit(True), "ablation_ok": F.lit(True), "coverage_ok": F.lit(True), "n_train": F.lit(1000)}))
    return R.decision_records(made).groupBy("status", F.col("R.primary_template").alias("template")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def latent_eval(spark, sf_dir):
    """Losses of the latent model and of a constant on actors held out, and the stability of its clusters, over all decisions.

    The model, the constant and the clusters' centers are fitted to BOUND decisions; what they are worth is summed by Spark.
    """
    return latent_losses(spark, kept_features(spark, sf_dir))


def latent_losses(spark, all_rows):
    rows = all_rows.withColumn("h", F.md5(F.col("decision_id"))).orderBy("h").limit(BOUND).select("actor", "label", *NAMES).collect()
    x, y, a = np.array([[r[n] for n in NAMES] for r in rows]), np.array([r["label"] > 0 for r in rows], float), np.array([r["actor"] for r in rows])
    held = a % 4 == 0
    model, mean = R.LatentModel().fit(x[~held], y[~held]), float(y[~held].mean())
    codes = model.codes(x)
    centers = [R.kmeans(codes, 3, seed=i)[0] for i in (0, 1)]

    def evaluate(batches):
        for batch in batches:
            x = batch[NAMES].to_numpy(dtype=float)
            y, held, codes = batch["label"].to_numpy() > 0, batch["actor"].to_numpy() % 4 == 0, model.codes(x)
            p = np.clip(model.predict(x), 1e-9, 1 - 1e-9)
            first, second = (((codes[:, None] - c) ** 2).sum(2).argmin(1) for c in centers)
            yield pd.DataFrame({"held": held, "loss": -np.log(np.where(y, p, 1 - p)), "up": y, "first": first, "second": second})

    made = all_rows.select("actor", "label", *NAMES).mapInPandas(evaluate, "held boolean, loss double, up boolean, first int, second int")
    cells = made.groupBy("first", "second").agg(F.count("*").alias("n"), F.count_if("held").alias("held"), F.count_if(F.col("held") & F.col("up")).alias("up"), F.sum(F.when(F.col("held"), F.col("loss"))).alias("loss")).collect()
    table, n, up = np.zeros((3, 3), int), sum(r.held for r in cells), sum(r.up for r in cells)
    for r in cells:
        table[r["first"], r["second"]] = r.n
    constant = -(up * np.log(mean) + (n - up) * np.log(1 - mean)) / n
    return spark.createDataFrame([(int(n), float(sum(r.loss or 0.0 for r in cells) / n), float(constant), float(R.agreement(table)))], "held_out int, loss double, constant_loss double, stability double")


ORACLE: dict = {}
QUERIES = {f.__name__: f for f in (counterfactuals, attribution, posterior, drc_records, latent_eval)}
