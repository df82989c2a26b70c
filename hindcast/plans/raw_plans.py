"""Raw payloads and their normalization. The payloads are made of the driver's tables, so that the SQL can go by these."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions import exprs as X
from hindcast.operators import normalize as N
from hindcast.operators import raw as W
from hindcast.plans.study import rounded
from hindcast.sources import adapters as A
from hindcast.sources.adapters import duck, table

MARKETS_FROM, DAY = 694_224_000.0, 86_400.0  # 1992-01-01


def _text(c):
    return F.col(c).cast("string")


def _responses(rows, key, collector, endpoint, record, parameters=None):
    """A response for each key: a list of records, or the list under "data"; some failed, some broken."""
    made = rows.groupBy(key, F.col(collector).alias("collector") if isinstance(collector, str) and collector in rows.columns else F.lit(collector).alias("collector")).agg(F.to_json(F.sort_array(F.collect_list(record))).alias("list"))
    text = F.when(F.col(key) % 97 == 0, F.concat(F.lit("{"), "list")).when(F.col(key) % 3 == 0, F.concat(F.lit('{"data":'), "list", F.lit("}"))).otherwise(F.col("list"))
    return made.select(F.col(key).cast("long").alias("raw_response_id"), "collector", F.lit(endpoint).alias("endpoint"), F.lit(parameters or "{}").alias("canonical_params_json"), (F.lit(1e9) + F.col(key)).alias("received_at"), F.when(F.col(key) % 13 == 0, F.lit(None)).when(F.col(key) % 11 == 0, 500).otherwise(200).alias("http_status"), F.encode(text, "UTF-8").alias("payload"))


def trade_responses(spark, sf_dir):
    """A response for each order, of taker trades for odd ones: a record for each line; some lack a size or have a price beyond 1."""
    legs = A.legs(spark, sf_dir).withColumn("collector", F.when(F.col("tx") % 2 == 1, "trades_taker").otherwise("trades_all"))
    record = F.struct(
        F.col("log_index").alias("logIndex"), F.col("leg_id").alias("id"), _text("asset").alias("conditionId"), F.concat_ws("-", _text("asset"), (F.col("log_index") % 3).cast("string")).alias("asset"), F.coalesce(F.lower("side"), F.lit("buy")).alias("side"),
        F.when(F.col("log_index") != 6, F.col("size")).alias("size"), F.when(F.col("condition") % 50 == 0, F.col("price") + 1.5).otherwise(F.col("price")).alias("price"), F.col("ts").alias("timestamp"), _text("tx").alias("transactionHash"), _text("wallet").alias("proxyWallet"),
    )
    return _responses(legs, "tx", "collector", "data", record)


def market_responses(spark, sf_dir):
    """A response for each part, in two forms: odd ones with tokens and numbers, even ones with JSON texts and ISO times."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", _text("p_partkey").alias("key"))
    at = F.lit(MARKETS_FROM) + F.pmod(F.col("p_partkey") * 7, F.lit(1500)) * DAY
    names = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("Yes"), F.lit("No"))).when(F.col("p_partkey") % 4 == 1, F.array(F.lit("no"), F.lit("true"))).otherwise(F.array(F.lit("A"), F.lit("B"), F.lit("C")))
    token = lambda x, i: F.struct(F.concat_ws("-", "key", i.cast("string")).alias("token_id"), x.alias("outcome"), F.when((F.col("p_partkey") % 9 == 0) & (i == 0), -1).alias("sign"))
    odd = F.to_json(F.array(F.struct(F.col("key").alias("conditionId"), F.col("p_name").alias("question"), F.lit("by size").alias("rules"), at.alias("createdAt"), F.transform(names, token).alias("tokens"), (F.col("p_size") > 25).alias("tradingEnabled"))))
    ids = F.to_json(F.transform(names, lambda x, i: F.concat_ws("-", "key", i.cast("string"))))
    even = F.to_json(F.array(F.struct(F.concat(F.lit("m"), "key").alias("id"), F.col("key").alias("conditionId"), F.col("p_name").alias("question"), F.lit("by name").alias("description"), F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"), ids.alias("clobTokenIds"), F.to_json(names).alias("outcomes"), (F.col("p_size") > 25).alias("acceptingOrders"), F.when(F.col("p_size") == 50, "Resolved").alias("umaResolutionStatus"))))
    return rows.select(F.col("p_partkey").cast("long").alias("raw_response_id"), F.lit("markets").alias("collector"), F.lit("markets").alias("endpoint"), F.lit("{}").alias("canonical_params_json"), F.lit(1e9).alias("received_at"), F.lit(200).alias("http_status"), F.encode(F.when(F.col("p_partkey") % 2 == 1, odd).otherwise(even), "UTF-8").alias("payload"))


def raw_decode(spark, sf_dir):
    """What becomes of the responses: by surface and error how many there are, and their records."""
    rows = W.decoded(trade_responses(spark, sf_dir).unionByName(market_responses(spark, sf_dir)))
    return rows.groupBy("surface", "error").agg(F.count("*").alias("responses"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.size("records"))), F.lit(0)).alias("records"))


def markets(spark, sf_dir):
    return W.markets(W.records(market_responses(spark, sf_dir), "markets"))


def normalize_markets(spark, sf_dir):
    return rounded(markets(spark, sf_dir).select("market", "condition", "question", "rules", "created_at", "trading_enabled", "resolved", F.size("tokens").alias("tokens")))


def outcome_tokens(spark, sf_dir):
    return W.outcome_tokens(markets(spark, sf_dir))


def normalize_executions(spark, sf_dir):
    rows = W.trades(W.records(trade_responses(spark, sf_dir), "executions"), outcome_tokens(spark, sf_dir), True).where("reason is null")
    return rounded(rows.select("raw_response_id", "log_index", "condition", "asset", "ts", "size", "positive_price", "positive_side", "notional", "taker_wallet", "reconciliation_status"))


def normalize_legs(spark, sf_dir):
    rows = W.trades(W.records(trade_responses(spark, sf_dir), "legs"), outcome_tokens(spark, sf_dir), False).where("reason is null")
    return rounded(rows.select("raw_response_id", "log_index", "condition", "asset", "ts", "side", "size", "price", "outcome_sign", "proxy_wallet", "liquidity_role"))


def quarantine(spark, sf_dir):
    """Trade records that were not taken, by surface and reason."""
    raw, tokens = trade_responses(spark, sf_dir), outcome_tokens(spark, sf_dir)
    made = W.mapped_trades(W.records(raw, "executions", "legs"), tokens, F.col("surface") == "executions")
    return made.where("reason is not null").groupBy("surface", "reason").agg(F.count("*").alias("n"))


def normalize_raw_books(spark, sf_dir):
    """Books of events as bare objects, with bad levels, and what is read off them."""
    e = A.books(spark, sf_dir)
    level = lambda p, s: F.struct(p.cast("string").alias("price"), s.cast("string").alias("size"))
    record = F.struct(F.when(F.col("event_id") % 20 > 0, F.col("event_id").cast("string")).alias("asset_id"), F.array(level(F.col("best_bid"), F.col("bid_size")), level(F.col("best_bid") - 0.01, F.lit(5.0)), level(F.lit("x"), F.lit(1.0))).alias("bids"), F.array(level(F.col("best_ask"), F.col("ask_size"))).alias("asks"), F.lit("0.001").alias("tick_size"))
    raw = e.select(F.col("event_id").cast("long").alias("raw_response_id"), F.lit("books").alias("collector"), F.lit("book").alias("endpoint"), F.lit("{}").alias("canonical_params_json"), F.col("ts").alias("received_at"), F.lit(200).alias("http_status"), F.encode(F.to_json(record), "UTF-8").alias("payload"))
    rows = W.books(W.records(raw, "books")).where("reason is null")
    return rounded(N.book_metrics(rows).select("asset", "observed_at", "best_bid", "best_ask", "bid_depth", "ask_depth", "imbalance", "best_bid_size", "tick_size"), 6)


def position_snapshots(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    record = F.struct(F.when(F.col("c_custkey") % 17 > 0, _text("c_custkey")).alias("proxyWallet"), F.concat(F.lit("a"), _text("c_nationkey")).alias("asset"), F.when(F.col("c_custkey") % 19 > 0, F.col("c_acctbal").cast("string")).otherwise("none").alias("size"))
    raw = _responses(rows, "c_nationkey", "positions", "positions", record)
    made = W.position_snapshots(W.records(raw, "positions"))
    return rounded(made.groupBy("asset", "reason").agg(F.count("*").alias("n"), F.sum("reported_size").alias("size"), F.countDistinct("wallet").alias("wallets")), 4)


def normalize_news(spark, sf_dir):
    rows = A.articles(spark, sf_dir)
    record = F.struct(F.col("lang").alias("headline"), F.col("text").alias("body"), F.concat(F.lit("http://n/"), _text("article")).alias("url"), F.date_format(F.timestamp_seconds("seen_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"))
    raw = rows.select(F.col("article").cast("long").alias("raw_response_id"), F.concat(F.lit("news:"), "source").alias("collector"), F.lit("news").alias("endpoint"), F.lit("{}").alias("canonical_params_json"), F.col("seen_at").alias("received_at"), F.lit(200).alias("http_status"), F.encode(F.to_json(F.array(record)), "UTF-8").alias("payload"))
    made = W.news(W.records(raw, "news"))
    return rounded(made.select("raw_response_id", "source_id", "source_url", "source_published_at", "first_observed_at", "headline", F.length("body").alias("body_chars"), F.sha2("body", 256).alias("body_hash")))


def winners(spark, sf_dir):
    """Redemptions (returned lines) against the winner known by then: statuses of orders by customer, resolved when filled."""
    s = A.status_versions(spark, sf_dir).select(F.col("market").alias("condition"), "effective_from", (F.col("state") == "F").alias("resolved"), F.concat(F.lit("a"), (F.col("obs") % 2).cast("string")).alias("winning_asset"), F.col("obs").alias("version_seq"))
    rows = A.legs(spark, sf_dir).where("sign = -1").select("leg_id", F.col("wallet").alias("condition"), "ts").distinct()
    return W.winner_asof(rows, s).select("leg_id", "condition", "ts", "winner", "resolution_version")


def import_market_metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("condition"), (F.lit(1e9) + F.col("p_partkey")).alias("created"), F.when(F.col("p_size") > 10, F.lit(1.1e9) + F.col("p_partkey")).alias("ended"), F.element_at(F.array(F.lit('["0.995","0.004"]'), F.lit('["0.01","0.99"]'), F.lit('["0.6","0.4"]'), F.lit("broken")), (F.col("p_partkey") % 4 + 1).cast("int")).alias("outcome_prices"), F.concat(_text("p_partkey"), F.lit("y")).alias("token_1"), F.concat(_text("p_partkey"), F.lit("n")).alias("token_2"))
    return W.imported_markets(rows)


_DAYS = f"{MARKETS_FROM}::DOUBLE + (p_partkey * 7) % 1500 * {DAY}::DOUBLE"
_NAMES = "CASE p_partkey % 4 WHEN 0 THEN ['Yes', 'No'] WHEN 1 THEN ['no', 'true'] ELSE ['A', 'B', 'C'] END"
_TOK = f"""tok AS (SELECT CAST(p_partkey AS VARCHAR) AS condition, p_partkey || '-' || i AS asset, mapping_effective_from, outcome_label, CAST(CASE WHEN given THEN -1 WHEN low IN ('yes', 'true') THEN 1 WHEN low = 'no' THEN -1 WHEN i = 0 THEN 1 WHEN i = 1 THEN -1 END AS INT) AS outcome_sign,
    CASE WHEN given THEN 'explicit' WHEN low IN ('yes', 'true', 'no') THEN 'high' WHEN i < 2 THEN 'assumed' ELSE 'unknown' END AS mapping_confidence
    FROM (SELECT p_partkey, i, {_DAYS} AS mapping_effective_from, names[i + 1] AS outcome_label, lower(names[i + 1]) AS low, p_partkey % 2 = 1 AND p_partkey % 9 = 0 AND i = 0 AS given FROM (SELECT p_partkey, names, unnest(range(len(names))) AS i FROM (SELECT p_partkey, {_NAMES} AS names FROM part))))"""
_TRADE = f"""{_TOK}, tr AS (SELECT tx, log_index, CAST(asset AS VARCHAR) AS condition, asset || '-' || log_index % 3 AS token, coalesce(side, 'BUY') AS side, CASE WHEN log_index != 6 THEN size END AS size, CASE WHEN condition % 50 = 0 THEN price + 1.5::DOUBLE ELSE price END AS price, ts, CAST(wallet AS VARCHAR) AS wallet
        FROM legs WHERE tx % 13 != 0 AND tx % 11 != 0 AND tx % 97 != 0),
    sg AS (SELECT tr.*, outcome_sign, CASE WHEN size IS NULL THEN 'malformed' WHEN price > 1 + 1e-9 THEN 'price_range' WHEN outcome_sign IS NULL AND tx % 2 = 1 THEN 'unmapped' END AS reason FROM tr ASOF LEFT JOIN (SELECT * FROM tok WHERE outcome_sign IS NOT NULL) k ON k.condition = tr.condition AND k.asset = tr.token AND tr.ts >= k.mapping_effective_from)"""
_PP = "CASE outcome_sign WHEN 1 THEN price ELSE 1 - price END"
ORACLE = {
    "raw_decode": duck("legs") + """, r AS (SELECT tx, count(*) AS n FROM legs GROUP BY tx) SELECT CASE WHEN tx % 2 = 1 THEN 'executions' ELSE 'legs' END AS surface, CASE WHEN tx % 13 = 0 OR tx % 11 = 0 THEN 'failed_response' WHEN tx % 97 = 0 THEN 'undecodable' END AS error, count(*) AS responses, CAST(coalesce(sum(CASE WHEN tx % 13 = 0 OR tx % 11 = 0 OR tx % 97 = 0 THEN 0 ELSE n END), 0) AS BIGINT) AS records FROM r GROUP BY ALL
        UNION ALL SELECT 'markets', NULL, count(*), count(*) FROM part""",
    "normalize_markets": f"""SELECT CASE WHEN p_partkey % 2 = 1 THEN '' ELSE 'm' END || p_partkey AS market, CAST(p_partkey AS VARCHAR) AS condition, p_name AS question, CASE WHEN p_partkey % 2 = 1 THEN 'by size' ELSE 'by name' END AS rules, {_DAYS} AS created_at, p_size > 25 AS trading_enabled, p_partkey % 2 = 0 AND p_size = 50 AS resolved, CAST(len({_NAMES}) AS INT) AS tokens FROM part""",
    "outcome_tokens": f"WITH {_TOK} SELECT *, CASE WHEN outcome_sign IS NULL THEN 'unresolvable_sign' END AS reason FROM tok",
    "normalize_executions": duck("legs") + f", {_TRADE} SELECT tx AS raw_response_id, log_index, condition, token AS asset, ts, size, round({_PP}, 9) AS positive_price, CASE WHEN outcome_sign = 1 THEN side WHEN side = 'BUY' THEN 'SELL' ELSE 'BUY' END AS positive_side, round(size * ({_PP}), 9) AS notional, wallet AS taker_wallet, CASE WHEN outcome_sign = 1 THEN 'direct' ELSE 'complemented' END AS reconciliation_status FROM sg WHERE tx % 2 = 1 AND reason IS NULL",
    "normalize_legs": duck("legs") + f", {_TRADE} SELECT tx AS raw_response_id, log_index, condition, token AS asset, ts, side, size, round(price, 9) AS price, outcome_sign, wallet AS proxy_wallet, 'unknown' AS liquidity_role FROM sg WHERE tx % 2 = 0 AND reason IS NULL",
    "quarantine": duck("legs") + f", {_TRADE} SELECT CASE WHEN tx % 2 = 1 THEN 'executions' ELSE 'legs' END AS surface, reason, count(*) AS n FROM sg WHERE reason IS NOT NULL GROUP BY ALL",
    "normalize_raw_books": duck("books") + "SELECT CAST(event_id AS VARCHAR) AS asset, round(ts, 6) AS observed_at, round(best_bid, 6) AS best_bid, round(best_ask, 6) AS best_ask, bid_size + 5 AS bid_depth, ask_size AS ask_depth, round((bid_size + 5 - ask_size) / (bid_size + 5 + ask_size), 6) AS imbalance, bid_size AS best_bid_size, 0.001::DOUBLE AS tick_size FROM books WHERE event_id % 20 > 0",
    "position_snapshots": """SELECT 'a' || c_nationkey AS asset, CASE WHEN c_custkey % 17 = 0 OR c_custkey % 19 = 0 THEN 'missing_field' END AS reason, count(*) AS n, round(sum(CASE WHEN c_custkey % 19 > 0 THEN c_acctbal END), 4) AS size, count(DISTINCT CASE WHEN c_custkey % 17 > 0 THEN c_custkey END) AS wallets
        FROM customer WHERE c_nationkey % 13 != 0 AND c_nationkey % 11 != 0 AND c_nationkey % 97 != 0 GROUP BY ALL""",
    "normalize_news": duck("articles") + "SELECT CAST(article AS BIGINT) AS raw_response_id, source AS source_id, 'http://n/' || article AS source_url, floor(seen_at) AS source_published_at, seen_at AS first_observed_at, lang AS headline, CAST(length(coalesce(text, '')) AS INT) AS body_chars, sha256(coalesce(text, '')) AS body_hash FROM articles",
    "winners": duck("legs", "status_versions") + """, r AS (SELECT DISTINCT leg_id, wallet AS condition, ts FROM legs WHERE sign = -1), s AS (SELECT market AS condition, effective_from, arg_max(obs, obs) AS v FROM status_versions GROUP BY ALL),
        f AS (SELECT market AS condition, effective_from, arg_max('a' || obs % 2, obs) AS w FROM status_versions WHERE state = 'F' GROUP BY ALL)
        SELECT leg_id, r.condition, r.ts, w AS winner, v AS resolution_version FROM r ASOF LEFT JOIN s ON s.condition = r.condition AND r.ts >= s.effective_from ASOF LEFT JOIN f ON f.condition = r.condition AND r.ts >= f.effective_from""",
    "import_market_metadata": """SELECT p_partkey AS condition, 1e9::DOUBLE + p_partkey AS effective_from, true AS trading_enabled, false AS closed, false AS resolved, CAST(NULL AS VARCHAR) AS winning_asset FROM part
        UNION ALL SELECT p_partkey, 1.1e9::DOUBLE + p_partkey, false, true, p_partkey % 4 < 2, CASE p_partkey % 4 WHEN 0 THEN p_partkey || 'y' WHEN 1 THEN p_partkey || 'n' END FROM part WHERE p_size > 10""",
}
QUERIES = {k: globals()[k] for k in ORACLE}
