"""What a run leaves behind: predictions, metrics, records, artifacts of fitted models, and texts that say why.

Tables are written by Spark as folders, in as many files as there are tasks; what is small and belongs to the whole run
(configuration, metrics, a fitted model) is one JSON file.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.sources import schemas
from hindcast.sources.collect import canonical


def version_of(**parts) -> str:
    """16 hex digits that change if any of the named parts (features, methods, fixed lists) does."""
    return hashlib.sha256(canonical(parts).encode()).hexdigest()[:16]


def write_json(spark: SparkSession, path: str, value) -> None:
    """One small JSON file, on whatever store the path is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(canonical(value).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str):
    import json

    return json.loads(spark.read.option("wholetext", True).text(path).first()[0])


def write_run_outputs(predictions: DataFrame, base: str, metrics: dict, configuration: dict, manifest: dict) -> None:
    """predictions as CSV with a header, and metrics, configuration and feature manifest as JSON; numbers that aren't finite are null."""
    spark = predictions.sparkSession
    predictions.write.mode("overwrite").option("header", True).csv(f"{base}/predictions")
    for name, value in (("metrics", metrics), ("config", configuration), ("feature_manifest", manifest)):
        write_json(spark, f"{base}/{name}.json", value)


def write_records(records: DataFrame, outcomes: DataFrame, base: str) -> dict[str, int]:
    """Records (decision_id, status, ...) with their outcomes attached last, as JSON lines, and how many there are of each status."""
    joined = records.join(outcomes.groupBy("decision_id").agg(F.sort_array(F.collect_list(F.struct("horizon", "status", "change"))).alias("O")), "decision_id", "left")
    joined.write.mode("overwrite").json(f"{base}/drc_records")
    counts = {r["status"]: r["n"] for r in records.groupBy("status").agg(F.count("*").alias("n")).collect()}
    write_json(records.sparkSession, f"{base}/reasoning_summary.json", {"records": sum(counts.values()), "status": counts})
    return counts


def load_judgments(spark: SparkSession, base: str, run: str | None = None) -> DataFrame:
    """reasoning_judgments with their reasoning JSON as a map, of one run or of all."""
    rows = schemas.read(spark, base, "reasoning_judgments").withColumn("reasoning", F.from_json("reasoning_json", "map<string,string>"))
    return rows.where(F.col("reasoning_run_id") == run) if run is not None else rows


def save_artifact(spark: SparkSession, path: str, model: dict, features: list[str]) -> None:
    write_json(spark, path, {"features": features, "version": version_of(features=features), "model": model})


def load_artifact(spark: SparkSession, path: str, features: list[str]) -> dict:
    """The model of an artifact; raises if it was fitted to other features, or the file's own hash doesn't fit."""
    got = read_json(spark, path)
    if got["features"] != features or got["version"] != version_of(features=features):
        raise ValueError("the artifact was made for other features")
    return got["model"]


def rationale(template: Column, channel: Column, delta: Column, confidence: Column, families: Column) -> Column:
    """A sentence that says what a record's verdict rests on; parts that are null are left out."""
    lead = F.format_string("Read as %s", F.lower(F.regexp_replace(template, "_", " ")))
    drive = F.when(channel.isNotNull(), F.format_string("the %s channel carries most of it (%.3f nats)", F.regexp_replace(channel, "_", " "), delta))
    news = F.when(F.size(families) > 0, F.concat(F.lit("it follows "), F.array_join(F.slice(families, 1, 3), ", ")))
    sure = F.when(confidence > 0, F.format_string("confidence %.2f", confidence)).otherwise("not accepted")
    return F.concat(F.concat_ws("; ", lead, drive, news, sure), F.lit("."))
