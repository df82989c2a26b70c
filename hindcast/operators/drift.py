"""Whether moves with news go on: regressions of later moves on what an interval's return owes to news and what it doesn't."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators import stats as S
from hindcast.operators.censor import open_through
from hindcast.operators.lineage import stored
from hindcast.operators.outcomes import close_near
from hindcast.operators.surfaces import Probe, Surface, read_surfaces

DAY = 86_400.0
NAMES = ["r_news", "r_nonnews", "close", "distance", "spread", "log_turnover", "vol", "log_left", "left_missing"]
#: Fixed value: with fewer clusters a clustering gives no t-statistic.
MIN_CLUSTERS, MIN_ROWS = 5, 20


def observations(records: DataFrame, closes: DataFrame, statuses: DataFrame, versions: DataFrame, gaps: DataFrame, bar: float, horizons: tuple[float, ...]) -> DataFrame:
    """For each record (condition, bin_start, is_news, r_news, r_nonnews, close, spread_mean, turnover, trailing_vol) and horizon: status, y, day and NAMES.

    y is the move from the last close by the record's end to that nearest to the horizon after it, within a bar and later than
    the first. status: observed, no_base, censored (not known to have stayed open) or stale_endpoint.
    """
    c = F.col
    rows = records.withColumn("ends", c("bin_start") + bar)
    rows = read_surfaces(rows, ["condition"], ["condition", "bin_start"], [Probe("now", c("ends"), strict=False)], [Surface("base", closes, "bar_end", last=("close",))])
    rows = rows.withColumns({"base_at": c("base_now.last.__at"), "base": c("base_now.last.close")}).drop("base_now")
    rows = stored(rows.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("until", c("ends") + c("horizon")), "drift")
    ident = ["condition", "bin_start", "horizon"]
    rows = close_near(rows, closes, ["condition"], ident, "until", "base_at", bar, "later")
    rows = open_through(rows, ["condition"], ident, "ends", "until", statuses, versions, gaps)
    status = F.when(c("base").isNull(), "no_base").when(~c("open_through"), "censored").when(c("later").isNull(), "stale_endpoint").otherwise("observed")
    left = c("time_to_resolution")
    x = {"distance": F.abs("close"), "spread": F.coalesce("spread_mean", F.lit(0.0)), "log_turnover": F.log1p("turnover"), "vol": F.coalesce("trailing_vol", F.lit(0.0)), "log_left": F.coalesce(F.log1p(left), F.lit(0.0)), "left_missing": left.isNull().cast("double")}
    return rows.select(*ident, F.floor(c("bin_start") / DAY).cast("long").alias("day"), status.alias("status"), (c("later") - c("base")).alias("y"), "is_news", "r_news", "r_nonnews", "close", *[v.alias(n) for n, v in x.items()])


def _demeaned(observed: DataFrame, within: list[str]) -> DataFrame:
    means = observed.groupBy(*[F.col(c).alias(f"w_{c}") for c in within]).agg(*[F.avg(n).alias(f"m_{n}") for n in ["y", *NAMES]])
    return observed.join(means, [F.col(c) == F.col(f"w_{c}") for c in within]).withColumns({n: F.col(n) - F.col(f"m_{n}") for n in ["y", *NAMES]})


def cells(observed: DataFrame) -> DataFrame:
    """Gram sums by (horizon, condition, day) of y and NAMES, demeaned within each horizon's conditions; all horizons in one pass.
    Every clustering of a regression is a sum of cells."""
    return _demeaned(observed, ["horizon", "condition"]).groupBy("horizon", "condition", "day").agg(F.count("*").alias("n"), *S.gram(NAMES, "y"))


def placebo_p(rows: DataFrame, times: int, seed: str = "placebo") -> DataFrame:
    """horizon, beta_news, mean_placebo and p = (exceed + 1) / (times + 1): how often news flags dealt anew among a condition's intervals
    give a coefficient as large. rows: observations() with is_news, materialised; the replicates are one more key of the Gram sums,
    so all are made in one pass and the driver gets a matrix for each horizon and replicate."""
    c = F.col
    flags = rows.select(c("condition").alias("f_condition"), c("bin_start").alias("f_bin"), "is_news").distinct()
    draw = flags.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    order = F.md5(F.concat_ws(":", F.lit(seed), c("draw").cast("string"), c("f_condition"), c("f_bin").cast("long").cast("string")))
    within = Window.partitionBy("f_condition", "draw")
    to = draw.select("f_condition", "f_bin", "draw", F.row_number().over(within.orderBy("f_bin")).alias("k"))
    given = draw.select(c("f_condition").alias("g_condition"), c("draw").alias("g_draw"), F.row_number().over(within.orderBy(order, "f_bin")).alias("g_k"), c("is_news").alias("g_news"))
    dealt = to.join(given, (c("f_condition") == c("g_condition")) & (c("draw") == c("g_draw")) & (c("k") == c("g_k"))).select("f_condition", "f_bin", "draw", "g_news")
    dealt = dealt.unionByName(flags.select("f_condition", "f_bin", F.lit(-1).alias("draw"), c("is_news").alias("g_news")))
    ret = c("r_news") + c("r_nonnews")
    each = rows.where("status = 'observed'").join(dealt, (c("condition") == c("f_condition")) & (c("bin_start") == c("f_bin")))
    each = each.withColumn("ret", ret).withColumns({"r_news": F.when(c("g_news") == 1, c("ret")).otherwise(0.0), "r_nonnews": F.when(c("g_news") == 1, 0.0).otherwise(c("ret"))})
    sums = _demeaned(each, ["horizon", "draw", "condition"]).groupBy("horizon", "draw").agg(F.count("*").alias("n"), *S.gram(NAMES, "y")).collect()
    betas: dict[float, dict[int, float]] = {}
    for r in sums:
        if r["n"] >= MIN_ROWS:
            a, b = S._matrices(r, len(NAMES) + 1)
            betas.setdefault(r["horizon"], {})[r["draw"]] = float((np.linalg.pinv(a) @ b)[1])
    made = []
    for h, by in sorted(betas.items()):
        own, others = by.pop(-1), list(by.values())
        made.append((h, own, float(np.mean(others)) if others else None, (sum(abs(x) >= abs(own) for x in others) + 1) / (len(others) + 1)))
    return rows.sparkSession.createDataFrame(made, "horizon double, beta_news double, mean_placebo double, p double")


def _meat(own: DataFrame, by: list[str], beta: np.ndarray) -> tuple[np.ndarray, int]:
    """The sum of the outer products of the clusters' scores b - A beta, and how many clusters, both summed by Spark."""
    k = len(beta)
    cell = lambda i, j: F.col(f"xx_{min(i, j)}_{max(i, j)}")
    scores = [F.sum(F.col(f"xy_{i}") - sum((float(b) * cell(i, j) for j, b in enumerate(beta)), F.lit(0.0))).alias(f"s{i}") for i in range(k)]
    row = own.groupBy(*by).agg(*scores).agg(F.count("*").alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"m{i}_{j}"]
    return out, row["g"]


def regress(gram_cells: DataFrame, horizon: float) -> dict | None:
    """Coefficients and CR1 errors by condition, by day and by both of one horizon's regression; t-statistics only for clusterings of
    MIN_CLUSTERS or more. None for fewer than MIN_ROWS observations. gram_cells must be materialised."""
    own, k = gram_cells.where(F.col("horizon") == horizon), len(NAMES) + 1
    row = own.agg(*[F.sum(c).alias(c) for c in gram_cells.columns[3:]]).first()
    n = row["n"] or 0
    if n < MIN_ROWS:
        return None
    a, b = S._matrices(row, k)
    bread = np.linalg.pinv(a)
    beta = bread @ b
    v, counts = {}, {}
    for name, by in (("market", ["condition"]), ("day", ["day"]), ("both", ["condition", "day"])):
        meat, g = _meat(own, by, beta)
        v[name], counts[name] = g / max(g - 1, 1) * (n - 1) / max(n - k, 1) * bread @ meat @ bread, g
    v["both"] = v["market"] + v["day"] - v["both"]
    counts["both"] = min(counts["market"], counts["day"])
    se = {x: np.sqrt(np.maximum(np.diag(m), 0)) for x, m in v.items()}
    t = {x: float(beta[1] / s[1]) if s[1] > 0 and counts[x] >= MIN_CLUSTERS else None for x, s in se.items()}
    return {"n": n, "beta": beta, "se": se, "clusters": counts, "t": t}


def drift_regressions(rows: DataFrame, horizons: tuple[float, ...], draws: int = 200) -> DataFrame:
    """A row for each horizon with MIN_ROWS observations or more: n, how many are censored or stale, coefficients, errors, counts,
    t-statistics or, where a clustering is refused, the wild-cluster p on the smaller one; and a bootstrap of days in blocks as long as the horizon.
    rows: observations(), materialised."""
    made, spark, observed = [], rows.sparkSession, rows.where("status = 'observed'")
    table = stored(cells(observed), "cells")
    left = {(r["horizon"], r["status"]): r["n"] for r in rows.groupBy("horizon", "status").agg(F.count("*").alias("n")).collect()}
    for h in horizons:
        fit = regress(table, h)
        if fit is None:
            continue
        own = S.within_demean(observed.where(F.col("horizon") == h), "condition", ["y", *NAMES])
        few = min(fit["clusters"]["market"], fit["clusters"]["day"]) < MIN_CLUSTERS
        smaller = "condition" if fit["clusters"]["market"] <= fit["clusters"]["day"] else "day"
        p = float(S.wild_cluster_p(own, NAMES, "y", 1, smaller, draws=draws)) if few else None
        block = S.moving_block_bootstrap(own, NAMES, "y", 1, "day", max(1, math.ceil(h / DAY)), draws)
        made.append((h, fit["n"], left.get((h, "censored"), 0), left.get((h, "stale_endpoint"), 0), float(fit["beta"][1]), float(fit["beta"][2]), *(float(fit["se"][x][1]) for x in ("market", "day", "both")), fit["clusters"]["market"], fit["clusters"]["day"], *(fit["t"][x] for x in ("market", "day", "both")), p, block and block["se"]))
    names = "horizon double, n long, censored long, stale long, beta_news double, beta_nonnews double, se_market double, se_day double, se_both double, markets long, days long, t_market double, t_day double, t_both double, wild_p double, block_se double"
    return spark.createDataFrame(made, names)
