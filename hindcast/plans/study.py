"""Bars, returns and the event study."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions import exprs as X
from hindcast.operators import bars as B
from hindcast.operators.asof import asof_join, band_join
from hindcast.sources import adapters as A
from hindcast.sources.adapters import BAR, duck

R = 9


def rounded(df: DataFrame, digits: int = R) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars, kept for the session's query, as several of its branches read them."""
    return B.build_bars(A.books(spark, sf_dir), A.fills(spark, sf_dir), A.gaps(spark, sf_dir), BAR).persist()


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News arrivals on the books' conditions: those of each article, dealt to conditions by its number."""
    names = ["click", "error", "purchase", "signup", "view"]
    return A.articles(spark, sf_dir).select("article", F.element_at(F.array(*map(F.lit, names)), (F.col("article") / 5 % 5 + 1).cast("int")).alias("condition"), F.col("seen_at").alias("ts"))


def bars_grid(spark, sf_dir):
    return rounded(bars(spark, sf_dir))


def bar_coverage(spark, sf_dir):
    return rounded(bars(spark, sf_dir).groupBy("condition").agg(F.count("*").alias("bars"), F.sum(F.col("complete").cast("long")).alias("complete_bars"), F.avg("coverage").alias("coverage"), F.sum("turnover").alias("turnover")), 6)


def interval_returns(spark, sf_dir):
    return rounded(B.interval_returns(bars(spark, sf_dir), BAR))


def trailing_vol(spark, sf_dir):
    return rounded(B.trailing_volatility(B.interval_returns(bars(spark, sf_dir), BAR)).select("condition", "bin_start", "ret", "trailing_vol"))


def news_intervals(spark, sf_dir):
    return rounded(B.with_news(B.interval_returns(bars(spark, sf_dir), BAR), arrivals(spark, sf_dir), BAR).select("condition", "bin_start", "is_news", "r_news", "r_nonnews"))


def daily_decomposition(spark, sf_dir):
    return rounded(B.daily(B.with_news(B.interval_returns(bars(spark, sf_dir), BAR), arrivals(spark, sf_dir), BAR)))


def segments_of_bars(spark, sf_dir):
    return B.segments(bars(spark, sf_dir).where("complete"), BAR).groupBy("condition", "segment").agg(F.min("bin_start").alias("first_bin"), F.max("bin_start").alias("last_bin"), F.count("*").alias("n"))


def closes(spark, sf_dir):
    return bars(spark, sf_dir).where("complete").select("condition", (F.col("bin_start") + BAR).alias("bar_end"), "close")


def close_asof(spark, sf_dir):
    """The last close at or before each arrival, at most two bars old."""
    return rounded(asof_join(arrivals(spark, sf_dir), closes(spark, sf_dir), ["condition"], "ts", "bar_end", ["bar_end", "close"], strict=False, max_age=2 * BAR))


def close_near_target(spark, sf_dir):
    """The close nearest to a day after each arrival, within a bar; of two as near the later."""
    near = band_join(arrivals(spark, sf_dir), closes(spark, sf_dir), ["condition"], F.col("ts") + 86_400, "bar_end", BAR, BAR)
    gap = F.abs(F.col("r_bar_end") - F.col("ts") - 86_400)
    best = F.min_by(F.struct("r_bar_end", "r_close"), F.struct(gap, -F.col("r_bar_end")))
    return rounded(near.groupBy("article", "condition", "ts").agg(best.alias("b")).select("article", "condition", "ts", F.col("b.r_bar_end").alias("bar_end"), F.col("b.r_close").alias("close")))


def distraction_proxies(spark, sf_dir):
    """Of each day the claims and families that appear, whether it is a weekend, and the day's share of all claims."""
    rows = A.claims(spark, sf_dir).groupBy(X.utc_day("seen_at").alias("day")).agg(F.count("*").alias("claims"), F.countDistinct("family").alias("families"), F.countDistinct("source").alias("sources"))
    return rows.withColumn("weekend", X.is_weekend(F.col("day") * 86_400.0)).withColumn("log_claims", F.round(F.log1p("claims"), R))


_BARS = f"""x AS (SELECT *, ln(q / (1.0::DOUBLE - q)) AS x FROM (SELECT *, greatest(0.001::DOUBLE, least(1 - 0.001::DOUBLE, mid)) AS q FROM books)),
d AS (SELECT *, pow(x - lag(x) OVER (PARTITION BY condition ORDER BY ts, event_id), 2) AS d2, floor(ts / {BAR}) * {BAR} AS bin FROM x),
m AS (SELECT condition, bin, arg_min(x, (ts, event_id)) AS open, max(x) AS high, min(x) AS low, arg_max(x, (ts, event_id)) AS close, sum(d2) AS rv, count(*) AS n_books, avg(spread) AS spread_mean,
      avg(CASE WHEN tick != 0 THEN spread / tick END) AS spread_ticks_mean, avg((bid_size + ask_size) / 2) AS best_size_mean, avg(depth) AS depth_mean, avg(imbalance) AS imbalance_mean FROM d GROUP BY ALL),
s AS (SELECT condition, floor(ts / {BAR}) * {BAR} AS bin, sum(notional) AS turnover, count(*) AS n_fills FROM fills GROUP BY ALL),
r AS (SELECT condition, CAST(min(bin) / {BAR} AS BIGINT) AS a, CAST(max(bin) / {BAR} AS BIGINT) AS b FROM (SELECT condition, bin FROM m UNION ALL SELECT condition, bin FROM s) GROUP BY condition),
g AS (SELECT condition, unnest(generate_series(a, b)) * {BAR}::DOUBLE AS bin FROM r),
bars AS (SELECT g.condition, g.bin AS bin_start, open, high, low, close, rv, coalesce(turnover, 0) AS turnover, spread_mean, spread_ticks_mean, best_size_mean, depth_mean, imbalance_mean, coalesce(n_books, 0) AS n_books, coalesce(n_fills, 0) AS n_fills,
      least(1.0::DOUBLE, coalesce(n_books, 0) / 360.0::DOUBLE) AS coverage, coalesce(n_books, 0) >= 4 AND rv IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gaps p WHERE NOT p.resolved AND p.condition = g.condition AND p.gap_start < g.bin + {BAR} AND (p.gap_end IS NULL OR p.gap_end > g.bin)) AS complete
      FROM g LEFT JOIN m ON g.condition = m.condition AND g.bin = m.bin LEFT JOIN s ON g.condition = s.condition AND g.bin = s.bin)"""
_RET = f"""ret AS (SELECT condition, bin_start, close - b AS ret, close, spread_mean, turnover, rv FROM (SELECT *, lag(close) OVER w AS b, lag(bin_start) OVER w AS l FROM bars WHERE complete WINDOW w AS (PARTITION BY condition ORDER BY bin_start)) WHERE bin_start - l = {BAR})"""
_ARR = "arr AS (SELECT article, (['click', 'error', 'purchase', 'signup', 'view'])[CAST(floor(article / 5) AS BIGINT) % 5 + 1] AS condition, seen_at AS ts FROM articles)"
_NEWS = f"news AS (SELECT ret.*, CAST(EXISTS (SELECT 1 FROM arr WHERE arr.condition = ret.condition AND floor(arr.ts / {BAR}) * {BAR} = bin_start) AS INT) AS is_news FROM ret)"
_CLOSE = f"closes AS (SELECT condition, bin_start + {BAR} AS bar_end, close FROM bars WHERE complete)"
BARS = duck("books", "fills", "gaps", "articles") + ", " + _BARS
FULL = ", ".join([BARS, _RET, _ARR, _NEWS, _CLOSE])


def _r(*names: str, digits: int = R) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


ORACLE = {
    "bars_grid": f"{BARS} SELECT condition, n_books, n_fills, complete, {_r('bin_start', 'open', 'high', 'low', 'close', 'rv', 'turnover', 'spread_mean', 'spread_ticks_mean', 'best_size_mean', 'depth_mean', 'imbalance_mean', 'coverage')} FROM bars",
    "bar_coverage": f"{BARS} SELECT condition, count(*) AS bars, CAST(sum(complete::INT) AS BIGINT) AS complete_bars, round(avg(coverage), 6) AS coverage, round(sum(turnover), 6) AS turnover FROM bars GROUP BY condition",
    "interval_returns": f"{FULL} SELECT condition, {_r('bin_start', 'ret', 'close', 'spread_mean', 'turnover', 'rv')} FROM ret",
    "trailing_vol": f"{FULL} SELECT condition, bin_start, round(ret, 9) AS ret, round(CASE WHEN count(ret) OVER w >= 2 THEN stddev_samp(ret) OVER w ELSE 0 END, 9) AS trailing_vol FROM ret WINDOW w AS (PARTITION BY condition ORDER BY bin_start ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)",
    "news_intervals": f"{FULL} SELECT condition, bin_start, is_news, round(ret * is_news, 9) + 0.0::DOUBLE AS r_news, round(ret * (1 - is_news), 9) + 0.0::DOUBLE AS r_nonnews FROM news",
    "daily_decomposition": f"{FULL} SELECT condition, CAST(floor(bin_start / 86400) AS BIGINT) AS day, round(sum(ret * is_news), 9) AS r_news, round(sum(ret * (1 - is_news)), 9) AS r_nonnews, CAST(sum(is_news) AS BIGINT) AS n_news, count(*) AS n FROM news GROUP BY ALL",
    "segments_of_bars": f"{FULL} SELECT condition, segment, min(bin_start) AS first_bin, max(bin_start) AS last_bin, count(*) AS n FROM (SELECT *, CAST(sum(st) OVER (PARTITION BY condition ORDER BY bin_start) AS BIGINT) AS segment FROM (SELECT *, coalesce((bin_start - lag(bin_start) OVER (PARTITION BY condition ORDER BY bin_start) != {BAR})::INT, 1) AS st FROM bars WHERE complete)) GROUP BY ALL",
    "close_asof": f"{FULL} SELECT article, arr.condition, arr.ts, CASE WHEN arr.ts - bar_end <= {2 * BAR} THEN bar_end END AS bar_end, CASE WHEN arr.ts - bar_end <= {2 * BAR} THEN round(close, 9) END AS close FROM arr ASOF LEFT JOIN closes c ON arr.condition = c.condition AND arr.ts >= c.bar_end",
    "close_near_target": f"{FULL} SELECT article, condition, ts, bar_end, round(close, 9) AS close FROM (SELECT article, arr.condition, arr.ts, bar_end, close, row_number() OVER (PARTITION BY article ORDER BY abs(bar_end - arr.ts - 86400), bar_end DESC) AS k FROM arr JOIN closes c ON arr.condition = c.condition AND abs(bar_end - arr.ts - 86400) <= {BAR}) WHERE k = 1",
    "distraction_proxies": duck("articles", "claims") + "SELECT CAST(floor(seen_at / 86400) AS BIGINT) AS day, count(*) AS claims, count(DISTINCT family) AS families, count(DISTINCT source) AS sources, (CAST(floor(seen_at / 86400) AS BIGINT) + 3) % 7 >= 5 AS weekend, round(ln(1 + count(*)), 9) AS log_claims FROM claims GROUP BY ALL",
}
QUERIES = {k: globals()[k] for k in ORACLE}
