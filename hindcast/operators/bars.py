"""Regular liquidity bars from irregular books and executions, and what is read off them.

A hot condition is no single task's work: snapshots are sorted within their (condition, bin), executions are summed
before the shuffle, and only windows over the bins of a condition follow, of which there are as many as the time has bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions import exprs as X
from hindcast.operators.asof import overlap_join


def build_bars(books: DataFrame, fills: DataFrame, gaps: DataFrame, bin_seconds: float, min_observations: int = 4, sample_seconds: float = 60.0) -> DataFrame:
    """One row for each bin of each condition from its first to its last observation; empty bins have null book statistics.

    books: condition, ts, event_id (tie-break), mid, spread, tick, bid_size, ask_size, depth, imbalance. Realised
    variance sums the squared changes of logit(mid), the first against the last one before the bin; it is null for
    fewer than two points. complete: no open gap, enough observations and a variance.
    """
    b = float(bin_seconds)
    w = Window.partitionBy("condition", "bin").orderBy("ts", "event_id")
    seen = books.withColumn("x", X.logit("mid")).withColumn("bin", X.floor_to("ts", b)).withColumn("d2", F.pow(F.col("x") - F.lag("x").over(w), F.lit(2.0)))
    at = F.struct("ts", "event_id")
    made = seen.groupBy("condition", "bin").agg(
        F.min_by("x", at).alias("open"), F.max("x").alias("high"), F.min("x").alias("low"), F.max_by("x", at).alias("close"),
        F.sum("d2").alias("rv"), F.count("*").alias("n_books"), F.avg("spread").alias("spread_mean"), F.avg(F.when(F.col("tick") != 0, F.col("spread") / F.col("tick"))).alias("spread_ticks_mean"),
        F.avg((F.col("bid_size") + F.col("ask_size")) / 2).alias("best_size_mean"), F.avg("depth").alias("depth_mean"), F.avg("imbalance").alias("imbalance_mean"),
    )
    # The first change of a bin is against the close of the last bin that has snapshots.
    jump = F.pow(F.col("open") - F.lag("close").over(Window.partitionBy("condition").orderBy("bin")), F.lit(2.0))
    made = made.withColumn("jump", jump).withColumn("rv", F.when(F.col("rv").isNotNull() | F.col("jump").isNotNull(), F.coalesce("rv", F.lit(0.0)) + F.coalesce("jump", F.lit(0.0)))).drop("jump")
    sold = fills.withColumn("bin", X.floor_to("ts", b)).groupBy("condition", "bin").agg(F.sum("notional").alias("turnover"), F.count("*").alias("n_fills"))
    span = made.select("condition", "bin").union(sold.select("condition", "bin")).groupBy("condition").agg(F.min("bin").alias("first"), F.max("bin").alias("last"))
    grid = span.select("condition", F.explode(F.sequence((F.col("first") / b).cast("long"), (F.col("last") / b).cast("long"))).alias("k")).select("condition", (F.col("k") * b).alias("bin"))
    # Open gaps block the bins that they overlap.
    ends = grid.select("condition", F.col("bin").alias("s"), (F.col("bin") + b).alias("e"))
    blocked = overlap_join(ends, gaps.where("not resolved"), ["condition"], ("s", "e"), ("gap_start", "gap_end"), b * 8).select("condition", F.col("s").alias("bin")).distinct().withColumn("blocked", F.lit(True)) if gaps is not None else grid.limit(0).withColumn("blocked", F.lit(True))
    rows = grid.join(made, ["condition", "bin"], "left").join(sold, ["condition", "bin"], "left").join(blocked, ["condition", "bin"], "left")
    n = F.coalesce("n_books", F.lit(0))
    expected = max(1, int(b // sample_seconds))
    return rows.select(
        "condition", F.col("bin").alias("bin_start"), "open", "high", "low", "close", "rv", F.coalesce("turnover", F.lit(0.0)).alias("turnover"), "spread_mean", "spread_ticks_mean", "best_size_mean", "depth_mean", "imbalance_mean",
        n.alias("n_books"), F.coalesce("n_fills", F.lit(0)).alias("n_fills"), F.least(F.lit(1.0), n / F.lit(expected)).alias("coverage"), (F.col("blocked").isNull() & (n >= min_observations) & F.col("rv").isNotNull()).alias("complete"),
    )


def interval_returns(bars: DataFrame, bin_seconds: float) -> DataFrame:
    """Returns between contiguous complete bars; a gap gives no row."""
    w = Window.partitionBy("condition").orderBy("bin_start")
    rows = bars.where("complete").withColumns({"before": F.lag("close").over(w), "last": F.lag("bin_start").over(w)})
    return rows.where(F.col("bin_start") - F.col("last") == bin_seconds).select("condition", "bin_start", (F.col("close") - F.col("before")).alias("ret"), "close", "spread_mean", "turnover", "rv")


def trailing_volatility(returns: DataFrame, rows: int = 6) -> DataFrame:
    """The sample deviation of up to so many returns before each one; 0 for fewer than two."""
    w = Window.partitionBy("condition").orderBy("bin_start").rowsBetween(-rows, -1)
    return returns.withColumn("trailing_vol", F.when(F.count("ret").over(w) >= 2, F.stddev_samp("ret").over(w)).otherwise(0.0))


def with_news(returns: DataFrame, arrivals: DataFrame, bin_seconds: float) -> DataFrame:
    """returns with is_news and r_news, r_nonnews: whether an arrival (condition, ts) is within the bar."""
    hit = arrivals.select("condition", X.floor_to("ts", bin_seconds).alias("bin_start")).distinct().withColumn("is_news", F.lit(1))
    rows = returns.join(hit, ["condition", "bin_start"], "left").withColumn("is_news", F.coalesce("is_news", F.lit(0)))
    return rows.withColumns({"r_news": F.col("ret") * F.col("is_news"), "r_nonnews": F.col("ret") * (1 - F.col("is_news"))})


def daily(rows: DataFrame) -> DataFrame:
    """Sums of both kinds of returns, and counts, by condition and day."""
    return rows.groupBy("condition", X.utc_day("bin_start").alias("day")).agg(F.sum("r_news").alias("r_news"), F.sum("r_nonnews").alias("r_nonnews"), F.sum("is_news").alias("n_news"), F.count("*").alias("n"))


def segments(bars: DataFrame, bin_seconds: float) -> DataFrame:
    """bars with segment: it grows where bins aren't contiguous."""
    w = Window.partitionBy("condition").orderBy("bin_start")
    starts = F.coalesce((F.col("bin_start") - F.lag("bin_start").over(w) != bin_seconds).cast("int"), F.lit(1))
    return bars.withColumn("starts", starts).withColumn("segment", F.sum("starts").over(w)).drop("starts")
