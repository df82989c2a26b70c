"""Streaming forms held against their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions import exprs as X
from hindcast.plans import regime_plans
from hindcast.plans.study import rounded
from hindcast.operators import regime as R
from hindcast.sources.adapters import BAR, table
from hindcast.streaming import bars as S

def stream_bars(spark, sf_dir):
    """Bars of the stored table, whatever the order of its files: the lateness covers the span of its times."""
    path = f"{sf_dir}/events*.parquet"
    span = spark.read.parquet(path).select(X.epoch("ts").alias("t")).agg(F.max("t") - F.min("t")).first()[0] or 0.0
    return rounded(S.run_to_table(S.tumbling_bars(S.stream(spark, path), int(BAR), f"{int(span + 2 * BAR) + 1} seconds"), ["event_type", "bin_start"], "bars"), 6)


def stream_dedup(spark, sf_dir):
    """Every user's events by day, once, from a stream that repeats them."""
    rows = S.stream(spark, f"{sf_dir}/events*.parquet")
    once = S.deduplicated(rows.union(rows), ["event_id"], "400 days")
    made = once.groupBy("event_type").agg(F.count("*").alias("n"))
    return S.run_to_table(made, ["event_type"], "dedup")


def stream_online_modes(spark, sf_dir):
    vectors = regime_plans.vectors(spark, sf_dir).select("condition", "bin_start", F.array(*R.DIMENSIONS).alias("v"))
    path = S.folder(spark, "vectors")
    vectors.repartition(1).sortWithinPartitions("bin_start").write.parquet(path)
    made = S.online_filter(S.stream(spark, path), regime_plans.CENTROIDS, regime_plans.PENALTY, BAR)
    return S.run_to_table(made, ["condition", "bin_start"], "modes")


def downtime_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("surface"), F.floor(X.epoch("ts")).cast("double").alias("received_at"))
    return S.downtime_gaps(rows, 1800.0)


ORACLE = {
    "stream_bars": f"SELECT event_type, floor(epoch_us(ts) / 1e6 / {BAR}) * {BAR} AS bin_start, count(*) AS n, round(sum(value), 6) AS total, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY ALL",
    "stream_dedup": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type",
    "stream_online_modes": regime_plans.ORACLE["online_modes"],
    "downtime_gaps": "SELECT surface, gap_start, received_at AS gap_end FROM (SELECT event_type AS surface, floor(epoch_us(ts) / 1e6) AS received_at, lag(floor(epoch_us(ts) / 1e6)) OVER (PARTITION BY event_type ORDER BY ts) AS gap_start FROM events) WHERE received_at - gap_start > 3600",
}
QUERIES = {k: globals()[k] for k in ORACLE}
