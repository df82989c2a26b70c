"""From a folder's raw responses to its normalized tables, markets first; running it again adds nothing.

Each surface is one branch over the responses, appended by key, so that a run that was cut off is finished by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.functions import exprs as X
from hindcast.operators import normalize as N
from hindcast.operators import raw as W
from hindcast.sources import schemas


def init(spark: SparkSession, base: str) -> list[str]:
    """Creates the tables that aren't there, empty, and returns their names."""
    made = [name for name in schemas.TABLES if not schemas.exists(spark, base, name)]
    for name in made:
        spark.createDataFrame([], schemas.schema(name)).write.parquet(f"{base}/{name}")
    return made


def migrate(spark: SparkSession, base: str, to: str) -> None:
    """Copies every table to another folder in this version's columns: what older files lack is null."""
    for name in schemas.TABLES:
        if schemas.exists(spark, base, name):
            schemas.conform(spark.read.option("mergeSchema", True).parquet(f"{base}/{name}"), name).write.mode("overwrite").parquet(f"{to}/{name}")


def audit(spark: SparkSession, base: str) -> DataFrame:
    """table_name, n, and how many rows lack their raw response, of the tables that are there."""
    parts = []
    for name, (_, _, _, lineage) in schemas.TABLES.items():
        if schemas.exists(spark, base, name):
            lost = F.count_if(F.col("raw_response_id").isNull()) if lineage else F.lit(0).cast("long")
            parts.append(schemas.read(spark, base, name).agg(F.count("*").alias("n"), lost.alias("without_raw")).select(F.lit(name).alias("table_name"), "n", "without_raw"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def versions(parsed: DataFrame, content: list[str], first: list[str]) -> DataFrame:
    """The observations of markets whose content differs from the one before, numbered, with their times."""
    digest = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in content])), 256)
    rows = parsed.where("reason is null").withColumn("content_hash", digest)
    return N.changes(rows, "market", "content_hash", first)


def normalize_all(spark: SparkSession, base: str, now: float) -> dict[str, int]:
    """Normalizes base's raw_responses into its tables; returns how many records each surface had to put aside."""
    init(spark, base)
    raw, aside = schemas.read(spark, base, "raw_responses"), {}

    def put(name: str, rows: DataFrame) -> None:
        stamped = rows.withColumns({"normalized_at": F.lit(float(now)), "schema_version": F.lit(schemas.VERSION), "parser_version": F.lit(f"raw-{schemas.VERSION}")})
        schemas.append(spark, base, name, stamped)

    def good(surface: str, rows: DataFrame) -> DataFrame:
        aside[surface] = aside.get(surface, 0) + rows.where("reason is not null").count()
        return rows.where("reason is null").drop("reason")

    parsed = W.markets(W.records(raw, "markets"))
    first = Window.partitionBy("market").orderBy("raw_response_id", "record_index")
    put("markets", good("markets", parsed).withColumn("k", F.row_number().over(first)).where("k = 1").withColumnsRenamed({"market": "market_id", "condition": "condition_id"}))
    put("outcome_tokens", good("tokens", W.outcome_tokens(parsed)).withColumnRenamed("condition", "condition_id"))
    order = ["received_at", "raw_response_id", "record_index"]
    contract = versions(parsed, ["question", "rules", "resolution_source", "resolution_time"], order)
    put("contract_versions", contract.withColumnsRenamed({"market": "market_id", "rules": "rules_text", "received_at": "first_observed_at"}).withColumn("effective_from", F.when(F.col("version_seq") == 1, F.coalesce("created_at", "first_observed_at")).otherwise(F.col("first_observed_at"))))
    status = versions(parsed, ["trading_enabled", "closed", "resolved", "winning_asset"], order)
    put("market_status_versions", status.withColumnsRenamed({"market": "market_id", "received_at": "first_observed_at"}).withColumn("effective_from", F.col("first_observed_at")))

    tokens = schemas.read(spark, base, "outcome_tokens").withColumnRenamed("condition_id", "condition")
    put("canonical_executions", good("executions", W.trades(W.records(raw, "executions"), tokens, True)).withColumnsRenamed({"condition": "condition_id"}).withColumn("raw_record_index", F.col("record_index")))
    put("actor_trade_legs", good("legs", W.trades(W.records(raw, "legs"), tokens, False)).withColumnsRenamed({"condition": "condition_id", "log_index": "transaction_log_index"}).withColumn("raw_record_index", F.col("record_index")))
    metrics = N.book_metrics(good("books", W.books(W.records(raw, "books"))))
    put("order_book_snapshots", metrics)
    put("position_snapshots", good("positions", W.position_snapshots(W.records(raw, "positions"))).withColumn("source", F.lit("data")))
    put("news_articles", W.news(W.records(raw, "news")).withColumn("download_completed_at", F.col("first_observed_at")))
    acts = good("activity", W.activity(W.records(raw, "activity")))
    known = schemas.read(spark, base, "market_status_versions").join(schemas.read(spark, base, "markets").select("market_id", "condition_id"), "market_id")
    known = known.select(F.col("condition_id").alias("condition"), "effective_from", "resolved", "winning_asset", F.row_number().over(Window.partitionBy("condition_id").orderBy("effective_from")).alias("version_seq"))
    other = tokens.groupBy("condition").agg(F.sort_array(F.collect_set("asset")).alias("assets"))
    acts = W.winner_asof(acts, known).join(other, "condition", "left").withColumn("other_asset", F.get(F.filter("assets", lambda a: a != F.col("asset")), F.lit(0)))
    events = N.activity_events(acts).join(acts.select(F.col("record_id").alias("i"), "ts", "resolution_version"), F.col("record_id") == F.col("i"))
    put("position_events", events.withColumnsRenamed({"condition": "condition_id", "kind": "event_type", "token_change": "signed_token_change", "cash_change": "collateral_change", "accounting": "accounting_confidence"}).withColumn("position_event_id", X.namespace_id("position", F.col("record_id"), F.col("part"))))
    return aside
