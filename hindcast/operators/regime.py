"""Two-state regimes of bars: reference statistics, standardised vectors, the jump model and news-impact screens."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions import exprs as X
from hindcast.operators import bars as B

VARIABLES = ("spread_ticks", "turnover", "volatility", "best_size")
DIMENSIONS = ("z_spread_ticks", "z_turnover", "z_volatility", "z_best_size", "traded")
FLOORS = {"spread_ticks": 0.05, "turnover": 1.0, "volatility": 0.05, "best_size": 0.05}
MIN_CELL, WINSOR = 20, 10.0
LAMBDAS = (0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)


def raw_variables(bars: DataFrame) -> DataFrame:
    """condition, bin_start and the variables of complete bars."""
    return bars.where("complete").select("condition", "bin_start", F.coalesce("spread_ticks_mean", "spread_mean").alias("spread_ticks"), "turnover", F.sqrt("rv").alias("volatility"), F.col("best_size_mean").alias("best_size"))


def transformed(name: str) -> Column:
    return F.log1p(F.greatest(F.col(name), F.lit(0.0))) if name == "turnover" else F.ln(F.col(name) + 1e-9)


def reference_stats(rows: DataFrame) -> DataFrame:
    """level (cell, condition, pooled), condition, hour, variable, n, median, iqr: exclusive quartiles of the transformed values.

    Fewer than four values have no range; a range is at least the variable's floor. The levels that are bounded by time
    sort a group's values as one array; the pooled level, which has every bar, finds its ranks by counts (pooled_stats).
    """
    parts = F.array(*[F.struct(F.lit(v).alias("variable"), transformed(v).alias("x"), F.lit(FLOORS[v]).alias("least")) for v in VARIABLES])
    flat = rows.withColumn("hour", X.utc_hour("bin_start")).select("condition", "hour", F.explode(parts).alias("p")).select("condition", "hour", "p.*").where("x is not null")
    sets = flat.groupingSets([["condition", "hour", "variable", "least"], ["condition", "variable", "least"]], "condition", "hour", "variable", "least")
    made = sets.agg(F.grouping_id().alias("g"), F.sort_array(F.collect_list("x")).alias("a"))
    level = F.when(F.col("g") == 0, "cell").otherwise("condition")
    iqr = F.when(F.size("a") >= 4, X.exclusive_quantile("a", 3) - X.exclusive_quantile("a", 1)).otherwise(0.0)
    fine = made.select(level.alias("level"), "condition", "hour", "variable", F.size("a").alias("n"), X.median("a").alias("median"), F.greatest(iqr, F.col("least")).alias("iqr"))
    return fine.unionByName(pooled_stats(flat))


#: Values are counted in buckets of this width before the few buckets that hold a wanted rank are sorted.
RANK_WIDTH = 1 / 64


def pooled_stats(flat: DataFrame) -> DataFrame:
    """reference_stats of the pooled level: variable, least and x of all bars.

    Equal values are counted together, buckets of values are summed, and a running sum over the buckets of a variable
    tells in which of them the ranks of median and quartiles lie; only their values are sorted.
    """
    values = flat.groupBy("variable", "least", "x").agg(F.count("*").alias("m")).withColumn("bucket", F.floor(F.col("x") / RANK_WIDTH))
    buckets = values.groupBy("variable", "bucket").agg(F.sum("m").alias("m"))
    w = Window.partitionBy("variable").orderBy("bucket")
    run = buckets.withColumn("upto", F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("m").over(Window.partitionBy("variable"))).withColumn("from", F.col("upto") - F.col("m"))
    low = lambda k: F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.lit(k) * (F.col("n") + 1) / 4)))
    ranks = {"q1a": low(1), "q1b": low(1) + 1, "q3a": low(3), "q3b": low(3) + 1, "m_a": F.floor((F.col("n") + 1) / 2), "m_b": F.floor(F.col("n") / 2) + 1}
    wanted = run.withColumn("w", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("long").alias("rank")) for k, v in ranks.items()]))).where("w.rank > from and w.rank <= upto")
    wanted = wanted.select(F.col("variable").alias("v"), F.col("bucket").alias("b"), "from", "n", "w.name", "w.rank")
    inside = values.join(wanted.select("v", "b", "from").distinct(), (F.col("variable") == F.col("v")) & (F.col("bucket") == F.col("b"))).drop("v", "b")
    order = Window.partitionBy("variable", "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("to", F.col("from") + F.sum("m").over(order)).drop("from")
    hit = inside.join(wanted, (F.col("variable") == F.col("v")) & (F.col("bucket") == F.col("b")) & (F.col("rank") <= F.col("to")) & (F.col("rank") > F.col("to") - F.col("m")))
    wide = hit.groupBy("variable", "least").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == k, F.col("x"))).alias(k) for k in ranks])
    part = lambda k: (F.col(f"q{k}a") * (F.lit(4) - (F.lit(k) * (F.col("n") + 1) - low(k) * 4)) + F.col(f"q{k}b") * (F.lit(k) * (F.col("n") + 1) - low(k) * 4)) / 4
    iqr = F.when(F.col("n") >= 4, part(3) - part(1)).otherwise(0.0)
    return wide.select(F.lit("pooled").alias("level"), F.lit(None).cast("string").alias("condition"), F.lit(None).cast("int").alias("hour"), "variable", F.col("n").cast("int").alias("n"), ((F.col("m_a") + F.col("m_b")) / 2).alias("median"), F.greatest(iqr, F.col("least")).alias("iqr"))


def stationarize(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """rows with a z of each variable, held to +-10, by the finest level with enough values, and traded."""
    wide = rows.withColumn("hour", X.utc_hour("bin_start"))
    agg = lambda v, c: F.max(F.when(F.col("variable") == v, F.col(c)))
    parts = [(f"{v}_{c}", v, c) for v in VARIABLES for c in ("n", "median", "iqr")]
    for level, keys in (("cell", ["condition", "hour"]), ("condition", ["condition"]), ("pooled", [])):
        got = stats.where(F.col("level") == level).groupBy(*keys).agg(*[agg(v, c).alias(f"{level}_{n}") for n, v, c in parts])
        wide = wide.join(got, keys, "left") if keys else wide.join(F.broadcast(got), F.lit(True), "left")
    out = ["condition", "bin_start"]
    for v in VARIABLES:
        pick = lambda c: F.when(F.coalesce(F.col(f"cell_{v}_n"), F.lit(0)) >= MIN_CELL, F.col(f"cell_{v}_{c}")).when(F.col(f"condition_{v}_n") > 0, F.col(f"condition_{v}_{c}")).otherwise(F.col(f"pooled_{v}_{c}"))  # noqa: B023, E731
        z = X.clamp((transformed(v) - pick("median")) / pick("iqr"), -WINSOR, WINSOR)
        out.append((F.when(F.col("turnover") <= 0, 0.0).otherwise(z) if v == "turnover" else z).alias(f"z_{v}"))
    return wide.select(*out, F.when(F.col("turnover") > 0, 1.0).otherwise(0.0).alias("traded"))


#: Bars of a segment that are folded as one array.
FOLD_BARS = 256


def cost_differences(segmented: DataFrame, centroids: list[list[float]], penalty: float) -> DataFrame:
    """condition, segment, bin_start, d: by how much the best path that ends in mode 1 costs more than that which ends in mode 0.

    With two modes the filter's state is one number, and a step holds it to +-penalty and adds the bar's own difference of
    distances. Steps of this kind compose to a step of this kind (hold to [lo, hi], add s), so a long segment is cut into
    slices: each is composed by a fold that carries three numbers, a fold over the slices gives the state before each, and
    a last fold gives the state at each of a slice's FOLD_BARS bars at most.
    """
    lam = F.lit(float(penalty))
    distance = lambda c: X.squared_distance(F.array(*DIMENSIONS), F.array(*[F.lit(float(x)) for x in c]))
    keys = ["condition", "segment"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("bin_start")) - 1
    rows = segmented.select(*keys, "bin_start", (distance(centroids[1]) - distance(centroids[0])).alias("e")).withColumn("slice", F.floor(place / FOLD_BARS))
    slices = rows.groupBy(*keys, "slice").agg(F.array_sort(F.collect_list(F.struct(F.col("bin_start").alias("t"), "e"))).alias("x"))
    hold = lambda d: F.greatest(-lam, F.least(lam, d))

    def compose(g: Column, x: Column) -> Column:
        at = lambda v: F.greatest(-lam - g["s"], F.least(lam - g["s"], v))
        return F.struct(at(g["lo"]).alias("lo"), at(g["hi"]).alias("hi"), (g["s"] + x["e"]).alias("s"))

    start = F.struct(F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0.0).alias("s"))
    made = slices.withColumn("g", F.aggregate("x", start, compose))
    # The state before the first bar is 0, which holding leaves alone.
    after = lambda d, g: F.greatest(g["lo"], F.least(g["hi"], d)) + g["s"]
    chained = made.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("slice", "g"))).alias("all"))
    chained = chained.withColumn("before", F.aggregate("all", F.array(F.lit(0.0)), lambda a, y: F.concat(a, F.array(after(F.element_at(a, -1), y["g"])))))
    before = chained.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.posexplode("before").alias("b_slice", "d0"))
    joined = made.join(before, (F.col("condition") == F.col("b_condition")) & (F.col("segment") == F.col("b_segment")) & (F.col("slice") == F.col("b_slice")))
    folded = F.aggregate("x", F.array(F.struct(F.lit(None).cast("double").alias("t"), F.col("d0").alias("d"))), lambda a, y: F.concat(a, F.array(F.struct(y["t"].alias("t"), (hold(F.element_at(a, -1)["d"]) + y["e"]).alias("d")))))
    return joined.select(*keys, F.explode(folded).alias("y")).where("y.t is not null").select(*keys, F.col("y.t").alias("bin_start"), F.col("y.d").alias("d"))


def online_costs(segmented: DataFrame, centroids: list[list[float]], penalty: float) -> DataFrame:
    """condition, segment, bin_start, mode_online: the mode with the lower cost so far, without looking ahead; ties take 0."""
    return cost_differences(segmented, centroids, penalty).select("condition", "segment", "bin_start", F.when(F.col("d") >= 0, 0).otherwise(1).alias("mode_online"))


def viterbi(x: np.ndarray, centroids: np.ndarray, penalty: float) -> np.ndarray:
    """The modes of one segment with the least total cost; ties take the lower mode."""
    cost = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    n, k = cost.shape
    total, back = cost[0].copy(), np.zeros((n, k), dtype=np.int64)
    for t in range(1, n):
        move = total[None, :] + penalty * (1 - np.eye(k))
        back[t] = move.argmin(axis=1)
        total = cost[t] + move.min(axis=1)
    path = np.zeros(n, dtype=np.int64)
    path[-1] = total.argmin()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def smoothed_modes(segmented: DataFrame, centroids: list[list[float]], penalty: float) -> DataFrame:
    """condition, segment, bin_start, mode: the path with the least total cost of each segment, as viterbi() gives it.

    Where the difference of costs is beyond the penalty, the path's mode there is certain whatever comes after; elsewhere it
    is the mode of the next bar. So the modes are the first certain one at or after each bar, which a window finds.
    """
    d = F.col("d")
    last = F.lead("d").over(Window.partitionBy("condition", "segment").orderBy("bin_start")).isNull()
    sure = F.when(last, F.when(d >= 0, 0).otherwise(1)).when(d >= penalty, 0).when(d < -penalty, 1)
    w = Window.partitionBy("condition", "segment").orderBy(F.desc("bin_start")).rowsBetween(Window.unboundedPreceding, 0)
    rows = cost_differences(segmented, centroids, penalty).withColumn("sure", sure)
    return rows.select("condition", "segment", "bin_start", F.last("sure", ignorenulls=True).over(w).alias("mode"))


def initial_centroids(rows: DataFrame) -> list[list[float]]:
    """The means of the lower and the upper half by volatility; ties are ranked by condition and bin.

    The half is found by counts of volatility's buckets, and only the bucket with the middle rank is sorted.
    """
    width = 1 / 64
    marked = rows.withColumn("bucket", F.floor(F.col("z_volatility") / width))
    counts = sorted((r["bucket"], r["n"]) for r in marked.groupBy("bucket").agg(F.count("*").alias("n")).collect())  # winsorised: at most 1,281 buckets
    half, seen, middle = sum(n for _, n in counts) // 2, 0, None
    for bucket, n in counts:
        if seen + n > half:
            middle = bucket
            break
        seen += n
    order = Window.partitionBy("bucket").orderBy("z_volatility", "condition", "bin_start")
    inside = marked.where(F.col("bucket") == middle).withColumn("place", F.row_number().over(order) + seen)
    high = marked.where(F.col("bucket") != middle).withColumn("high", F.col("bucket") > middle).unionByName(inside.withColumn("high", F.col("place") > half).drop("place"))
    got = {r["high"]: [float(r[d]) for d in DIMENSIONS] for r in high.groupBy("high").agg(*[F.avg(d).alias(d) for d in DIMENSIONS]).collect()}
    return [got[False], got[True]]


class TooFewBars(ValueError):
    """The refusal to fit a model to fewer than ten bars."""


def fit_jump_model(segmented: DataFrame, penalty: float | None = None, least_run: float = 3.0, rounds: int = 50) -> dict:
    """Centroids, penalty and the calm mode. Without a penalty the first of LAMBDAS whose runs are long enough on average.

    Assignments stay distributed; the driver holds two centroids. Fewer than ten bars are refused.
    """
    segmented = segmented.cache()
    if segmented.limit(10).count() < 10:
        raise TooFewBars("too few bars to fit")
    try:
        start = initial_centroids(segmented)
        for lam in (penalty,) if penalty is not None else LAMBDAS:
            now, before = start, None
            for _ in range(rounds):
                modes = smoothed_modes(segmented, now, lam).join(segmented, ["condition", "segment", "bin_start"])
                got = {r["mode"]: [float(r[d]) for d in DIMENSIONS] for r in modes.groupBy("mode").agg(*[F.avg(d).alias(d) for d in DIMENSIONS]).collect()}
                before, now = now, [got.get(k, now[k]) for k in range(2)]
                if np.allclose(before, now):
                    break
            runs = mode_durations(smoothed_modes(segmented, now, lam)).agg(F.avg("n")).first()[0]
            if penalty is not None or runs >= least_run or lam == LAMBDAS[-1]:
                return {"centroids": now, "lambda": lam, "calm": int(now[1][2] < now[0][2]), "mean_run": runs}
    finally:
        segmented.unpersist()
    raise AssertionError


def mode_durations(modes: DataFrame, mode: str = "mode") -> DataFrame:
    """Runs of one mode within a segment."""
    w = Window.partitionBy("condition", "segment").orderBy("bin_start")
    starts = F.coalesce((F.col(mode) != F.lag(mode).over(w)).cast("int"), F.lit(1))
    return modes.withColumn("starts", starts).withColumn("run", F.sum("starts").over(w)).groupBy("condition", "segment", "run", mode).agg(F.count("*").alias("n"))


def screen_impact(arrivals: DataFrame, modes: DataFrame, b: float, effective_from: float | None = None) -> DataFrame:
    """article, condition with the labels before, at and after the arrival's bin, the status and whether a transition was seen.

    modes: condition, bin_start, label (calm or event).
    """
    rows = arrivals.withColumn("a", X.floor_to("ts", b))
    for name, shift in (("pre", -b), ("arrival", 0.0), ("post", b)):
        rows = rows.join(modes.select(F.col("condition").alias("c"), (F.col("bin_start") - shift).alias("m"), F.col("label").alias(name)), (F.col("condition") == F.col("c")) & (F.col("a") == F.col("m")), "left").drop("c", "m")
    first, second = F.col("pre").isNotNull() & F.col("arrival").isNotNull(), F.col("arrival").isNotNull() & F.col("post").isNotNull()
    jump = F.coalesce((F.col("pre") == "calm") & (F.col("arrival") == "event"), F.lit(False)) | F.coalesce((F.col("arrival") == "calm") & (F.col("post") == "event"), F.lit(False))
    early = F.col("ts") < effective_from if effective_from is not None else F.lit(False)
    status = F.when(early, "model_unavailable").when(~first & ~second, "insufficient_coverage").when(jump, "screened").when(first & second, "screened").otherwise("partial_coverage")
    return rows.select("article", "condition", "pre", "arrival", "post", status.alias("status"), F.when(status == "screened", jump.cast("int")).alias("transition"), (F.col("a") + 2 * b).alias("available_at"))


def stationary_segments(bars: DataFrame, b: float) -> DataFrame:
    rows = raw_variables(bars)
    return B.segments(stationarize(rows, reference_stats(rows)), b).withColumn("segment", F.col("segment").cast("long"))


