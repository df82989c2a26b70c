"""Estimation by sufficient statistics: Spark sums, the driver solves systems of a few unknowns.

Nothing that grows with the rows or the clusters reaches the driver: Gram matrices, sums by draw and by calendar day do.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_demean(df: DataFrame, entity: str, cols: list[str]) -> DataFrame:
    w = Window.partitionBy(entity)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in cols})


def gram(xs: list[str], y: str, intercept: bool = True) -> list[Column]:
    """Sums of all products of the regressors (1 first) and with y, named xx_i_j and xy_i."""
    v = ([F.lit(1.0)] if intercept else []) + [F.col(x).cast("double") for x in xs]
    return [F.sum(v[i] * v[j]).alias(f"xx_{i}_{j}") for i in range(len(v)) for j in range(i, len(v))] + [F.sum(v[i] * F.col(y)).alias(f"xy_{i}") for i in range(len(v))]


def _matrices(row, k: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"xx_{i}_{j}"]
    return a, np.array([row[f"xy_{i}"] for i in range(k)])


def ols(df: DataFrame, xs: list[str], y: str) -> np.ndarray:
    a, b = _matrices(df.agg(*gram(xs, y)).first(), len(xs) + 1)
    return np.linalg.pinv(a) @ b


def _scores(xs: list[str], y: str, beta: np.ndarray) -> list[Column]:
    v = [F.lit(1.0)] + [F.col(x).cast("double") for x in xs]
    fit = sum((float(b) * c for b, c in zip(beta, v, strict=True)), F.lit(0.0))
    return [F.sum(c * (F.col(y) - fit)).alias(f"s{i}") for i, c in enumerate(v)]


def cluster_meat(df: DataFrame, xs: list[str], y: str, beta: np.ndarray, clusters: list[str]) -> tuple[np.ndarray, int]:
    """The sum over clusters of the outer products of their scores, and how many clusters; both summed by Spark."""
    k = len(xs) + 1
    by = df.groupBy(*clusters).agg(*_scores(xs, y, beta))
    row = by.agg(F.count("*").alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
    return np.array([[row[f"m{i}_{j}"] for j in range(k)] for i in range(k)]), row["g"]


def ols_clustered(df: DataFrame, xs: list[str], y: str, first: str, second: str | None = None) -> dict:
    """Coefficients with CR1 standard errors by one or two clusterings (V_a + V_b - V_ab)."""
    k = len(xs) + 1
    row = df.agg(F.count("*").alias("n"), *gram(xs, y)).first()
    a, b = _matrices(row, k)
    bread, n = np.linalg.pinv(a), row["n"]
    beta = bread @ b

    def cov(clusters: list[str]) -> tuple[np.ndarray, int]:
        meat, g = cluster_meat(df, xs, y, beta, clusters)
        return (g / (g - 1)) * ((n - 1) / (n - k)) * bread @ meat @ bread, g

    v, g = cov([first])
    if second:
        v = v + cov([second])[0] - cov([first, second])[0]
    se = np.sqrt(np.maximum(np.diag(v), 0))
    return {"beta": beta, "se": se, "n": n, "clusters": g, "t": np.where(se > 0, beta / np.where(se > 0, se, 1), np.nan) if g >= 5 else None}


def standardizer(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; flags (_missing, _incomplete) stay, and a deviation near 0 counts as 1."""
    use = [c for c in cols if not c.endswith(("_missing", "_incomplete"))]
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in use], *[F.stddev_pop(c).alias(f"s_{c}") for c in use]).first()
    return {c: ((row[f"m_{c}"] or 0.0, row[f"s_{c}"] if (row[f"s_{c}"] or 0) >= 1e-12 else 1.0) if c in use else (0.0, 1.0)) for c in cols}


def logistic(df: DataFrame, xs: list[str], label: str, l2: float = 1.0, rounds: int = 25) -> dict:
    """Penalised logistic regression of labels -1/+1 by Newton steps; the intercept is free."""
    return logistics(df, [xs], label, l2, rounds)[0]


def logistics(df: DataFrame, sets: list[list[str]], label: str, l2: float = 1.0, rounds: int = 25, keep: bool = True) -> list[dict]:
    """A regression as in logistic() on each set of regressors; all of them take the passes of one.

    Every task sums its rows' gradients and Hessians by matrix products over Arrow batches; Spark adds the tasks' sums up,
    so that the driver gets one number for each entry. keep: the regressors are cached; without, df is read by every pass, for
    those that are cheaply made of a stored table.
    """
    xs = list(dict.fromkeys(x for own in sets for x in own))
    scale = standardizer(df, xs)
    at = [np.array([0, *(1 + xs.index(x) for x in own)]) for own in sets]
    weights, steps, done = [np.zeros(len(a)) for a in at], [0] * len(at), [False] * len(at)
    named = df.select(F.col(label).cast("double").alias("y"), *[((F.col(x).cast("double") - scale[x][0]) / scale[x][1]).alias(f"z{i}") for i, x in enumerate(xs)])
    named = named.cache() if keep else named

    def sums(weights: list[np.ndarray], of: list[int]) -> dict[int, np.ndarray]:
        def part(batches):
            total = {g: np.zeros(len(at[g]) + len(at[g]) ** 2) for g in of}
            for b in batches:
                every, y = np.column_stack([np.ones(len(b)), b.iloc[:, 1:].to_numpy()]), (b["y"].to_numpy() + 1) / 2
                for g in of:
                    z, k = every[:, at[g]], len(at[g])
                    p = 1 / (1 + np.exp(-np.clip(z @ weights[g], -500, 500)))
                    total[g][:k] += z.T @ (p - y)
                    total[g][k:] += ((z * (p * (1 - p))[:, None]).T @ z).ravel()
            for g, t in total.items():
                yield pd.DataFrame({"g": g, "i": np.arange(len(t)), "v": t})

        rows = named.mapInPandas(part, "g int, i long, v double").groupBy("g", "i").agg(F.sum("v").alias("v")).collect()
        return {g: np.array([v for _, v in sorted((r["i"], r["v"]) for r in rows if r["g"] == g)]) for g in of}

    try:
        for _ in range(rounds):
            of = [g for g in range(len(at)) if not done[g]]
            if not of:
                break
            for g, total in sums(weights, of).items():
                k = len(at[g])
                penalty = np.diag([0.0] + [l2] * (k - 1))
                move = np.linalg.solve(total[k:].reshape(k, k) + penalty + 1e-10 * np.eye(k), total[:k] + penalty @ weights[g])
                weights[g], steps[g], done[g] = weights[g] - move, steps[g] + 1, np.abs(move).max() < 1e-9
    finally:
        if keep:
            named.unpersist()
    return [{"weights": w, "scale": {x: scale[x] for x in own}, "names": list(own), "steps": n} for w, own, n in zip(weights, sets, steps, strict=True)]


def predict(model: dict) -> Column:
    z = F.lit(float(model["weights"][0]))
    for b, x in zip(model["weights"][1:], model["names"], strict=True):
        m, s = model["scale"][x]
        z = z + float(b) * (F.col(x).cast("double") - m) / s
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))


def ranked(df: DataFrame, time: str, tie: str) -> DataFrame:
    """df with __r, the place of each row by time, then tie, from 0, and __all, how many rows there are; from counts of time
    slices, so that no task sorts everything."""
    slices = df.withColumn("__slice", F.floor(F.col(time) / 86_400))
    counts = slices.groupBy("__slice").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("__n").over(Window.partitionBy()))
    rank = F.row_number().over(Window.partitionBy("__slice").orderBy(time, tie)) - 1 + F.col("__before")
    return slices.join(before, "__slice").withColumn("__r", rank).drop("__slice", "__n", "__before")


def folds(df: DataFrame, time: str, tie: str, k: int) -> DataFrame:
    """df with fold: k chronological blocks, the first n % k with a row more, as array_split cuts."""
    base, more = F.floor(F.col("__all") / k), F.col("__all") % k
    fold = F.when(F.col("__r") < more * (base + 1), F.floor(F.col("__r") / (base + 1))).otherwise(more + F.floor((F.col("__r") - more * (base + 1)) / F.greatest(base, F.lit(1))))
    return ranked(df, time, tie).withColumn("fold", fold.cast("int")).drop("__all", "__r")


#: Poisson(1)'s distribution function in eighths of a digest, and how many draws one digest serves.
_POISSON = [f"{int(2**32 * sum(np.exp(-1) / math.factorial(i) for i in range(k + 1))):08x}" for k in range(12)]
_PARTS = 4


def drawn(clusters: DataFrame, key: str, draws: int, seed: str) -> DataFrame:
    """clusters with a row for each draw and hex, eight digits of a digest of the seed, the key and the draw. A draw's weight of a
    cluster follows from it alone, so tasks sum their clusters' parts and no cluster reaches the driver."""
    blocks = clusters.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // _PARTS) - 1))))
    blocks = blocks.withColumn("__md5", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.col("__block").cast("string"))))
    parts = F.array(*[F.struct((F.col("__block") * _PARTS + i).alias("draw"), F.substring("__md5", 1 + 8 * i, 8).alias("hex")) for i in range(_PARTS)])
    return blocks.select(*clusters.columns, F.explode(parts).alias("__p")).select(*clusters.columns, "__p.draw", "__p.hex").where(F.col("draw") < draws)


def poisson(hex_: Column) -> Column:
    """How often a cluster is drawn: a Poisson(1) number."""
    return sum(((hex_ >= x).cast("int") for x in _POISSON), F.lit(0))


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, draws: int = 500, seed: str = "boot") -> DataFrame:
    """mean, low, high (percentiles 2.5 and 97.5 of the draws' means) and clusters, one row: whole clusters are resampled, each with a
    hashed Poisson(1) weight for each draw. Draws that take no value don't count; without values all is null."""
    by = df.groupBy(F.col(cluster).alias("g")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    each = drawn(by.where("n > 0"), "g", draws, seed).withColumn("w", poisson(F.col("hex")))
    means = each.groupBy("draw").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))
    ends = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    whole = by.agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), F.count("*").alias("clusters"))
    return whole.crossJoin(ends).select("mean", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), "clusters")  # one row each


def moving_block_bootstrap(df: DataFrame, xs: list[str], y: str, test: int, day: str, block: int, draws: int = 200, seed: int = 7) -> dict | None:
    """Standard error and percentile interval of coefficient test when days are resampled in blocks of consecutive days; None for fewer
    than two blocks of days. A day's Gram matrix is all that a draw needs of it, and days are few."""
    k = len(xs) + 1
    rows = df.groupBy(F.col(day).alias("d")).agg(*gram(xs, y)).orderBy("d").collect()  # one for each calendar day
    days = np.array([r["d"] for r in rows], np.int64)
    if len(days) < 2 * block:
        return None
    mats = [_matrices(r, k) for r in rows]
    a, b = np.array([m[0] for m in mats]), np.array([m[1] for m in mats])
    r, starts, found = np.random.default_rng(seed), days[: max(1, len(days) - block + 1)], []
    for _ in range(draws):
        covered = (r.choice(starts, -(-len(days) // block))[:, None] + np.arange(block)).ravel()
        times = np.array([np.count_nonzero(covered == d) for d in days])
        found.append((np.linalg.pinv(np.tensordot(times, a, 1)) @ (times @ b))[test])
    return {"se": float(np.std(found, ddof=1)), "low": float(np.percentile(found, 2.5)), "high": float(np.percentile(found, 97.5)), "draws": draws, "block": block}


def wild_cluster_p(df: DataFrame, xs: list[str], y: str, test: int, cluster: str, draws: int = 499, seed: str = "wild") -> float:
    """The p-value of coefficient test by Rademacher draws with the null imposed; signs are hashed, see drawn().

    Each cluster keeps its score s and its products with the test's row c of the bread, a = c's and q = c'A. A first pass sums the
    signed scores of each draw, which give its coefficients; a second one the squares of what is left, (sign a - q m)^2. Only draws x
    coefficients numbers reach the driver.
    """
    k = len(xs) + 1
    by = df.groupBy(F.col(cluster).alias("g")).agg(*gram(xs, y))
    sums = by.agg(*[F.sum(c).alias(c) for c in by.columns[1:]]).first()
    a, total = _matrices(sums, k)
    bread, null = np.linalg.pinv(a), np.zeros(k)
    keep = [i for i in range(k) if i != test]
    null[keep] = np.linalg.pinv(a[np.ix_(keep, keep)]) @ total[keep]
    dot = lambda cs, xs: sum((float(c) * x for c, x in zip(cs, xs, strict=True)), F.lit(0.0))
    cell = lambda i, j: F.col(f"xx_{min(i, j)}_{max(i, j)}")
    scores = [F.col(f"xy_{i}") - dot(null, [cell(i, j) for j in range(k)]) for i in range(k)]
    rows = by.select("g", *[x.alias(f"s{i}") for i, x in enumerate(scores)], *[dot(bread[test], [cell(i, j) for i in range(k)]).alias(f"q{j}") for j in range(k)])
    rows = rows.withColumn("a", dot(bread[test], [F.col(f"s{i}") for i in range(k)]))
    # Draw -1 is the data itself.
    signed = drawn(rows, "g", draws, seed).withColumn("e", F.when(F.col("hex") < "8", -1.0).otherwise(1.0)).drop("hex")
    signed = signed.unionByName(rows.withColumns({"draw": F.lit(-1), "e": F.lit(1.0)}))
    moved = signed.groupBy("draw").agg(*[F.sum(F.col("e") * F.col(f"s{i}")).alias(f"s{i}") for i in range(k)]).toPandas()
    m = moved[[f"s{i}" for i in range(k)]].to_numpy() @ bread
    moves = df.sparkSession.createDataFrame([(int(d), *map(float, v)) for d, v in zip(moved["draw"], m, strict=True)], "d int, " + ", ".join(f"m{i} double" for i in range(k)))
    left = signed.join(F.broadcast(moves), F.col("draw") == F.col("d"))  # a row for each draw
    rest = F.col("e") * F.col("a") - sum((F.col(f"q{i}") * F.col(f"m{i}") for i in range(k)), F.lit(0.0))
    made = left.groupBy("draw").agg(F.sum(rest * rest).alias("v"), F.first(f"m{test}").alias("m")).toPandas()
    t = dict(zip(made["draw"], np.abs(made["m"]) / np.sqrt(np.maximum(made["v"], 1e-300)), strict=True))
    own = t.pop(-1)
    return (sum(x >= own for x in t.values()) + 1) / (draws + 1)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """Round-robin over strata by seeded hash: the first of every stratum, then the second, and so on, n in all."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), key)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).orderBy("place", stratum, key).limit(n)


def kmeans_assign(df: DataFrame, vector: str, centers: list[list[float]]) -> DataFrame:
    """df with cluster and inertia: the nearest of a few centers, the first of equals."""
    from hindcast.functions.exprs import squared_distance

    d = F.array(*[F.struct(squared_distance(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(x)) for x in c])).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centers)])
    return df.withColumn("best", F.array_min(d)).select("*", F.col("best.i").alias("cluster"), F.col("best.d").alias("inertia")).drop("best")


def multinomial(x: np.ndarray, y: np.ndarray, classes: int, l2: float = 0.5, rounds: int = 500, rate: float = 0.5) -> np.ndarray:
    """Class-balanced multinomial weights (classes, features + 1) of a small training matrix, by accelerated descent."""
    x1 = np.column_stack([np.ones(len(x)), x])
    weight = (len(y) / (classes * np.maximum(np.bincount(y, minlength=classes), 1)))[y]
    w = v = np.zeros((classes, x1.shape[1]))
    target = np.eye(classes)[y]
    rate = rate / max(1.0, (x1**2).sum(1).max())
    for t in range(rounds):
        p = probabilities(v, x)
        g = (weight[:, None] * (p - target)).T @ x1 / len(y)
        g[:, 1:] += l2 / len(y) * v[:, 1:]
        new = v - rate * g
        v, w = new + t / (t + 3) * (new - w), new
    return w


def probabilities(w: np.ndarray, x: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    z = np.column_stack([np.ones(len(x)), x]) @ w.T / temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)
