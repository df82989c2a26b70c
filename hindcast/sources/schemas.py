"""The tables of the domain: their columns, keys and availability columns, and how a folder of them is kept.

Times are epoch seconds as doubles. Each observational row carries its lineage. The availability column is what an
as-of read compares with its cutoff.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = 2
LINEAGE = "raw_response_id long, raw_record_index long, raw_record_hash string, parser_version string, schema_version int, normalized_at double"

#: Fixed names: table: (columns without lineage, key, availability column or None, whether rows carry lineage).
TABLES = {
    "collector_runs": ("collector_run_id string, collector string, started_at double, finished_at double, status string, configuration_json string, note string", ["collector_run_id"], None, False),
    "raw_responses": ("raw_response_id long, collector string, base_url string, endpoint string, canonical_params_json string, requested_at double, received_at double, http_status int, response_headers_json string, content_hash string, payload binary, error_text string", ["raw_response_id"], "received_at", False),
    "backfill_windows": ("collector string, object_id string, window_start double, window_end double, page_count int, record_count int, status string, observed_min_ts double, observed_max_ts double, note string", ["collector", "object_id", "window_start", "window_end"], None, False),
    "collector_gaps": ("collector string, surface string, object_id string, gap_start double, gap_end double, reason string, detected_at double, resolved_at double", ["collector", "surface", "object_id", "gap_start"], None, False),
    "markets": ("market_id string, condition_id string, category string, question string, created_at double, closed_at double, resolved_at double, is_combo boolean", ["market_id"], None, True),
    "outcome_tokens": ("condition_id string, asset string, outcome_label string, outcome_sign int, mapping_effective_from double, mapping_confidence string", ["condition_id", "asset", "mapping_effective_from"], "mapping_effective_from", True),
    "contract_versions": ("market_id string, version_seq int, effective_from double, first_observed_at double, question string, rules_text string, resolution_source string, resolution_time double, content_hash string", ["market_id", "version_seq"], "first_observed_at", True),
    "market_status_versions": ("market_id string, effective_from double, first_observed_at double, trading_enabled boolean, closed boolean, resolved boolean, winning_asset string", ["market_id", "effective_from"], "first_observed_at", True),
    "actor_trade_legs": ("actor_leg_id string, source_record_id string, candidate_fingerprint string, transaction_hash string, transaction_log_index long, transaction_occurrence long, proxy_wallet string, condition_id string, asset string, outcome_label string, outcome_sign int, side string, size double, price double, ts double, liquidity_role string, role_confidence string", ["actor_leg_id"], "ts", True),
    "canonical_executions": ("execution_id string, transaction_hash string, transaction_log_index long, transaction_occurrence long, condition_id string, positive_price double, positive_side string, size double, notional double, taker_wallet string, ts double, reconciliation_status string", ["execution_id"], "ts", True),
    "position_events": ("position_event_id string, wallet string, condition_id string, asset string, event_type string, signed_token_change double, collateral_change double, accounting_confidence string, resolution_version int, is_combo boolean, ts double", ["position_event_id"], "ts", True),
    "position_snapshots": ("wallet string, asset string, observed_at double, reported_size double, source string", ["wallet", "asset", "observed_at"], "observed_at", True),
    "order_book_snapshots": ("asset string, observed_at double, best_bid double, best_ask double, spread double, bid_depth double, ask_depth double, imbalance double, best_bid_size double, best_ask_size double, tick_size double", ["asset", "observed_at"], "observed_at", True),
    "market_state": ("condition_id string, ts double, state_source string, positive_price double, volume double, spread double, depth double, imbalance double, coverage_complete boolean", ["condition_id", "ts", "state_source"], "ts", True),
    "news_articles": ("article_id string, source_id string, source_url string, source_published_at double, first_observed_at double, download_completed_at double, timestamp_source string, timestamp_confidence string, headline string, body string, content_hash string, previous_article_id string", ["article_id"], "first_observed_at", True),
    "event_families": ("event_family_id string, label string, earliest_available_at double, created_by string, created_at double", ["event_family_id"], "earliest_available_at", False),
    "news_claims": ("claim_id string, article_id string, first_available_at double, claim_text string, entities_json string, quantities_json string, supporting_span string, extractor_version string, confidence double", ["claim_id"], "first_available_at", False),
    "claim_edges": ("edge_id string, claim_id string, event_family_id string, edge_type string, evidence string, confidence double, effective_from double", ["edge_id"], "effective_from", False),
    "relevance_judgments": ("relevance_judgment_id string, claim_id string, event_family_id string, market_id string, contract_version_seq int, source_effective_at double, computed_at double, scored_at double, rel_class string, rel_score double, direction int, novelty double, surprise double, method string, model_version string, evidence_json string", ["relevance_judgment_id"], "computed_at", False),
    "liquidity_bars": ("condition_id string, bin_start double, bin_end double, bin_seconds double, logit_open double, logit_high double, logit_low double, logit_close double, realized_variance double, turnover_notional double, spread_mean double, spread_ticks_mean double, best_book_size_mean double, total_depth_mean double, imbalance_mean double, book_count int, execution_count int, coverage_fraction double, coverage_complete boolean, feature_version string", ["condition_id", "bin_start", "bin_seconds"], "bin_end", False),
    "liquidity_mode_runs": ("mode_run_id string, fit_cutoff double, model_deployed_at double, lambda double, centroids_json string, reference_stats_json string, calm_mode int, train_bar_count long, config_json string, availability_mode string", ["mode_run_id"], "fit_cutoff", False),
    "liquidity_mode_assignments": ("mode_run_id string, condition_id string, bin_start double, bin_seconds double, mode int, mode_label string, mode_online int, mode_label_online string, in_training boolean", ["mode_run_id", "condition_id", "bin_start"], None, False),
    "news_impact_screens": ("mode_run_id string, claim_id string, condition_id string, assignment_basis string, news_time double, arrival_bin_start double, pre_label string, arrival_label string, post_label string, transition_detected int, impact_score double, screen_status string, screen_available_at double, model_effective_from double", ["mode_run_id", "claim_id", "condition_id", "assignment_basis"], "screen_available_at", False),
    "reasoning_judgments": ("reasoning_judgment_id string, decision_id string, reasoning_run_id string, primary_template string, decision_json string, context_json string, reasoning_json string, rationale_text string, agreement_score double, confidence double, status string, computed_at double", ["reasoning_judgment_id"], "computed_at", False),
    "annotation_batches": ("batch_id string, sampler_config_json string, n_decisions int, feature_version string", ["batch_id"], None, False),
    "annotations": ("batch_id string, decision_id string, reviewer string, label string, confidence double, notes string, imported_at double", ["batch_id", "decision_id", "reviewer"], None, False),
    "schema_metadata": ("schema_version int, applied_at double, parser_version string, description string", ["schema_version"], None, False),
}


def schema(name: str) -> StructType:
    columns, _, _, lineage = TABLES[name]
    return StructType.fromDDL(f"{columns}, {LINEAGE}" if lineage and "raw_response_id" not in columns else columns)


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the table's columns: missing ones null, known ones cast (bad values null), others dropped."""
    there = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in there else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema(name)])


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table below base; files of older versions lack columns, which are null."""
    return spark.read.schema(schema(name)).parquet(f"{base}/{name}")


def append_new(spark: SparkSession, base: str, name: str, rows: DataFrame, first: bool = False) -> None:
    """Appends the rows whose key the table doesn't have, each key once; first: the table isn't there yet."""
    key = TABLES[name][1]
    new = conform(rows, name).dropDuplicates(key)
    if not first:
        new = new.join(read(spark, base, name).select(*key), key, "left_anti")
    new.write.mode("append").parquet(f"{base}/{name}")


def exists(spark: SparkSession, base: str, name: str) -> bool:
    """Whether a table is there, on whatever store base is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def append(spark: SparkSession, base: str, name: str, rows: DataFrame) -> None:
    append_new(spark, base, name, rows, first=not exists(spark, base, name))


def replace_run(spark: SparkSession, base: str, name: str, rows: DataFrame, run: str) -> None:
    """Replaces what a table holds of the runs that are in rows (column run), and leaves the others: the same run may be
    written again. The table is kept in a folder for each run, of which only those are overwritten."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(f"{base}/{name}")


def known_before(df: DataFrame, name: str, cutoff: float) -> DataFrame:
    """What of a table was available strictly before cutoff; tables without an availability column are refused."""
    at = TABLES[name][2]
    if at is None:
        raise ValueError(f"{name} has no availability column")
    return df.where(F.col(at) < cutoff)


def assert_no_future(df: DataFrame, cutoff: str, columns: list[str]) -> None:
    """Raises if a row has a time in columns at or after its cutoff."""
    late = df.where(F.greatest(*[F.col(c) for c in columns], F.lit(float("-inf"))) >= F.col(cutoff)).limit(1).count()
    if late:
        raise ValueError(f"rows hold what wasn't known before {cutoff}")
