"""Structured Streaming forms: bars, de-duplicated trades, the online regime filter, downtime gaps.

State is keyed and bounded by watermarks; sinks are idempotent by key and batch, so that a restart from the
checkpoint repeats no row.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.functions import exprs as X


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of the cluster. Where none is set, a temporary one for a master on this machine
    alone; on a cluster that raises, as no other machine would see it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="stream-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A table of Parquet files as a stream; new files are taken up as they land."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling_bars(events: DataFrame, bin_seconds: int, lateness: str = "1 hour") -> DataFrame:
    """Counts, sums and extremes by event type and bin; rows later than lateness behind the newest are dropped, by contract."""
    timed = events.withColumn("at", F.timestamp_micros((X.epoch("ts") * 1e6).cast("long"))).withWatermark("at", lateness)
    made = timed.groupBy("event_type", F.window("at", f"{bin_seconds} seconds")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    return made.select("event_type", (F.unix_micros("window.start") / F.lit(1e6)).alias("bin_start"), "n", "total", "low", "high")


def run_to_table(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Runs a streaming frame over what there is, in update mode, and returns the last state of each key."""
    spark = df.sparkSession
    out, state = folder(spark, name), folder(spark, f"{name}-state")

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b={number}")

    df.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).drop("b")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("__k", last).where("__k = 1").drop("__k", "batch")


def deduplicated(events: DataFrame, keys: list[str], lateness: str = "2 hours") -> DataFrame:
    """An at-least-once stream without its repeats: overlapping reads give a key again within the watermark."""
    timed = events.withColumn("at", F.timestamp_micros((X.epoch("ts") * 1e6).cast("long"))).withWatermark("at", lateness)
    return timed.dropDuplicatesWithinWatermark(keys).drop("at")


def online_filter(bars: DataFrame, centroids: list[list[float]], penalty: float, bin_seconds: float) -> DataFrame:
    """The forward filter as a state machine: two costs and the last bin of each condition; a gap starts anew.

    bars: a stream of condition, bin_start, v (array<double>), in order within each batch or late never.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        a, b, last = state.get if state.exists else (0.0, 0.0, None)
        rows = pd.concat(list(batches)).sort_values("bin_start")
        out = []
        for t, v in zip(rows["bin_start"], rows["v"], strict=True):
            d = [sum((x - y) ** 2 for x, y in zip(v, c, strict=True)) for c in centroids]
            fresh = last is None or t - last != bin_seconds
            a, b = (d[0], d[1]) if fresh else (d[0] + min(a, b + penalty), d[1] + min(b, a + penalty))
            last = t
            out.append((key[0], t, 0 if a <= b else 1))
        state.update((a, b, last))
        yield pd.DataFrame(out, columns=["condition", "bin_start", "mode_online"])

    return bars.groupBy("condition").applyInPandasWithState(step, "condition string, bin_start double, mode_online int", "a double, b double, last double", "update", "NoTimeout")


def downtime_gaps(received: DataFrame, cadence: float) -> DataFrame:
    """surface, gap_start, gap_end of the times in which a surface (surface, received_at) was idle for over two cadences."""
    w = Window.partitionBy("surface").orderBy("received_at")
    rows = received.withColumn("gap_start", F.lag("received_at").over(w))
    return rows.where(F.col("received_at") - F.col("gap_start") > 2 * cadence).select("surface", "gap_start", F.col("received_at").alias("gap_end"))
