"""From raw responses to records of the domain: decoding, dispatch, parsing, and a quarantine with its reasons.

A response is decoded once; each surface reads its own records. What can't be read isn't dropped in silence: parsers return
every record with a reason, which is null for those that are good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions import exprs as X
from hindcast.operators.asof import asof_join

#: Fixed labels of outcomes that speak for and against a proposition.
YES, NO = ["yes", "true", "will", "positive"], ["no", "false", "wont", "won't", "negative"]
PRICE_SLACK = 1e-9


def surface(collector: Column, endpoint: Column, parameters: Column) -> Column:
    """Which parser a response goes to; null for none. Trades are the taker's own or both sides', by how they were asked for."""
    trades = (endpoint == "trades") | collector.startswith("trades")
    taker = (F.lower(F.coalesce(F.get_json_object(parameters, "$.takerOnly"), F.lit(""))) == "true") | (collector == "trades_taker")
    found = F.when(trades & taker, "executions").when(trades, "legs").when((endpoint == "markets") | collector.isin("markets", "market_status"), "markets")
    found = found.when((endpoint == "activity") | (collector == "activity"), "activity").when((endpoint == "positions") | (collector == "positions"), "positions")
    return found.when((endpoint == "book") | (collector == "books"), "books").when(collector.startswith("news") | endpoint.startswith("news"), "news")


#: Markets come first, as tokens and statuses must be known before what refers to them is read.
STAGES = (("markets",), ("executions", "legs", "books", "positions", "news"), ("activity",))


def decoded(raw: DataFrame) -> DataFrame:
    """raw with surface, error and records (JSON texts): a list, the list under "data", or the one object.

    error: failed_response (no status, or 400 and more), undecodable, no_parser; then there are no records.
    """
    text = F.decode("payload", "UTF-8")
    rows = raw.withColumns({"surface": surface(F.col("collector"), F.col("endpoint"), F.col("canonical_params_json")), "text": text}).withColumn("data", F.get_json_object("text", "$.data"))
    lists = lambda c: F.from_json(c, "array<string>")
    begins = lambda c, x: F.ltrim(c).startswith(x)
    found = F.when(begins(F.col("text"), "["), lists("text")).when(begins(F.col("text"), "{"), F.when(F.col("data").isNull(), F.array("text")).when(begins(F.col("data"), "["), lists("data")).otherwise(F.array("data")))
    failed = F.coalesce(F.col("http_status") >= 400, F.lit(True))
    error = F.when(failed, "failed_response").when(F.try_parse_json("text").isNull(), "undecodable").when(F.col("surface").isNull(), "no_parser")
    return rows.withColumn("error", error).withColumn("records", F.when(F.col("error").isNull(), F.coalesce(found, F.array().cast("array<string>")))).drop("text", "data")


def records(raw: DataFrame, *surfaces: str) -> DataFrame:
    """raw_response_id, received_at, source (of news), record_index, record_hash and record of the named surfaces."""
    rows = decoded(raw).where(F.col("surface").isin(*surfaces))
    # posexplode() alone would add a filter on the records' number below itself, for which payloads would be decoded twice.
    each = rows.select("raw_response_id", "received_at", "surface", F.regexp_replace("collector", "^news:", "").alias("source"), F.posexplode_outer("records").alias("record_index", "record"))
    return each.where("record_index is not null").withColumn("record_hash", F.sha2("record", 256))


def _fields(df: DataFrame, ddl: str) -> DataFrame:
    return df.withColumn("j", F.from_json("record", ddl)).select("*", "j.*").drop("j")


def token_sign(explicit: Column, label: Column, place: Column) -> tuple[Column, Column]:
    """(sign, confidence) of a token: given, by its label, or by its place; null beyond the second."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    given = explicit.isin(-1, 1)
    sign = F.when(given, explicit).when(low.isin(*YES), 1).when(low.isin(*NO), -1).when(place == 0, 1).when(place == 1, -1)
    return sign.cast("int"), F.when(given, "explicit").when(low.isin(*YES, *NO), "high").when(place < 2, "assumed").otherwise("unknown")


def markets(rows: DataFrame) -> DataFrame:
    """market, condition, question, rules, times, flags and tokens of market records, of either form, with a reason for those without ids.

    One form has tokens; the other has their ids and outcomes as JSON texts, names some fields otherwise and gives ISO times.
    """
    ddl = "id string, conditionId string, category string, question string, createdAt string, closedAt string, resolvedAt string, isCombo string, tokens array<struct<token_id:string,asset:string,outcome:string,sign:int>>, clobTokenIds string, outcomes string, rules string, description string, resolutionSource string, resolutionTime string, endDate string, tradingEnabled string, acceptingOrders string, active string, resolved string, umaResolutionStatus string, closed string, winningAsset string"
    made = _fields(rows, ddl)
    other = F.col("tokens").isNull() & F.col("clobTokenIds").isNotNull()
    names = F.from_json("outcomes", "array<string>")
    paired = F.transform(F.from_json("clobTokenIds", "array<string>"), lambda t, i: F.struct(t.alias("token_id"), F.lit(None).cast("string").alias("asset"), F.get(names, i).alias("outcome"), F.lit(None).cast("int").alias("sign")))
    yes = lambda *cs: F.coalesce(*[F.col(c).try_cast("boolean") for c in cs], F.lit(True))
    out = made.select(
        "raw_response_id", "record_index", "received_at", "record_hash", F.coalesce("id", "conditionId").alias("market"), F.col("conditionId").alias("condition"), "category", "question",
        *[X.iso_epoch(c).alias(n) for c, n in (("createdAt", "created_at"), ("closedAt", "closed_at"), ("resolvedAt", "resolved_at"))], F.coalesce(F.col("isCombo").try_cast("boolean"), F.lit(False)).alias("is_combo"),
        F.coalesce("tokens", paired, F.array().cast("array<struct<token_id:string,asset:string,outcome:string,sign:int>>")).alias("tokens"), F.coalesce("rules", F.when(other, F.col("description"))).alias("rules"), F.col("resolutionSource").alias("resolution_source"),
        X.iso_epoch(F.coalesce("resolutionTime", F.when(other, F.col("endDate")))).alias("resolution_time"),
        F.when(other, yes("tradingEnabled", "acceptingOrders", "active")).otherwise(yes("tradingEnabled")).alias("trading_enabled"), F.coalesce(F.col("closed").try_cast("boolean"), F.lit(False)).alias("closed"),
        F.coalesce(F.col("resolved").try_cast("boolean"), F.when(other, F.lower(F.coalesce("umaResolutionStatus", F.lit(""))) == "resolved"), F.lit(False)).alias("resolved"), F.col("winningAsset").alias("winning_asset"),
    )
    return out.withColumn("reason", F.when(F.col("condition").isNull() | F.col("market").isNull(), "missing_ids"))


def outcome_tokens(parsed: DataFrame) -> DataFrame:
    """condition, asset, outcome_label, outcome_sign, mapping_effective_from, mapping_confidence and reason of the tokens of
    good market records; of equal (condition, asset, time) the first observed stays."""
    rows = parsed.where("reason is null").select("condition", "created_at", "raw_response_id", "record_index", F.posexplode("tokens").alias("place", "t")).withColumn("asset", F.coalesce("t.token_id", "t.asset")).where("asset is not null")
    sign, confidence = token_sign(F.col("t.sign"), F.col("t.outcome"), F.col("place"))
    rows = rows.withColumns({"outcome_sign": sign, "mapping_confidence": confidence, "mapping_effective_from": F.coalesce("created_at", F.lit(0.0))})
    first = rows.groupBy("condition", "asset", "mapping_effective_from").agg(F.min_by(F.struct(F.col("t.outcome").alias("outcome_label"), "outcome_sign", "mapping_confidence"), F.struct("raw_response_id", "record_index", "place")).alias("f"))
    return first.select("condition", "asset", "mapping_effective_from", "f.*", F.when(F.col("f.outcome_sign").isNull(), "unresolvable_sign").alias("reason"))


def mapped_trades(rows: DataFrame, tokens: DataFrame, executions: Column) -> DataFrame:
    """The fields of trade records that are used, the sign and label of their token, and reason. executions: which records are
    executions (a sign is needed) and not legs (a wallet is).

    reason: malformed (a field is missing or no number), price_range, unmapped. The sign is that of the latest mapping of the
    token at or before the trade; a token's mappings are few, as its market's creation dates them, so they form one row.
    """
    ddl = "conditionId string, asset string, side string, size string, price string, timestamp string, transactionHash string, logIndex long, occurrence long, proxyWallet string, id string"
    made = _fields(rows, ddl).withColumns({"size": F.col("size").try_cast("double"), "price": F.col("price").try_cast("double"), "ts": F.col("timestamp").try_cast("double"), "side": F.upper("side")})
    bad = ~executions & F.col("proxyWallet").isNull()
    for c in ("conditionId", "asset", "side", "size", "price", "ts", "transactionHash"):
        bad = bad | F.col(c).isNull()
    used = ["raw_response_id", "record_index", "surface", "transactionHash", "logIndex", "asset", "side", "size", "price", "ts", "proxyWallet"]
    made = made.select(*used, F.col("conditionId").alias("condition"), bad.alias("bad"))
    known = tokens.where("outcome_sign is not null").groupBy(F.col("condition").alias("k_condition"), F.col("asset").alias("k_asset")).agg(F.array_sort(F.collect_list(F.struct(F.col("mapping_effective_from").alias("since"), "outcome_sign", "outcome_label"))).alias("versions"))
    made = made.join(known, (F.col("condition") == F.col("k_condition")) & (F.col("asset") == F.col("k_asset")), "left")
    last = F.try_element_at(F.filter("versions", lambda v: v["since"] <= F.coalesce("ts", F.lit(0.0))), F.lit(-1))
    made = made.withColumn("m", last).select(*used, "condition", "bad", "m.outcome_sign", "m.outcome_label")
    out_of = ~F.col("price").between(-PRICE_SLACK, 1 + PRICE_SLACK)
    return made.withColumn("reason", F.when(F.col("bad"), "malformed").when(out_of, "price_range").when(executions & F.col("outcome_sign").isNull(), "unmapped"))


def trades(rows: DataFrame, tokens: DataFrame, executions: bool) -> DataFrame:
    """Trade records as executions or as legs, with the reason of mapped_trades()."""
    ids = [F.col("raw_response_id"), F.col("record_index")]
    out = mapped_trades(rows, tokens, F.lit(executions)).withColumns({"positive_price": X.positive_price("price", "outcome_sign"), "positive_side": X.positive_side("side", "outcome_sign")})
    both = ["raw_response_id", "record_index", "reason", F.col("transactionHash").alias("transaction_hash"), F.col("logIndex").alias("log_index"), "condition", "asset", "ts", "size"]
    if executions:
        status = F.when(F.col("outcome_sign") == 1, "direct").when(F.col("outcome_sign") == -1, "complemented")
        return out.select(X.namespace_id("execution", *ids).alias("execution_id"), *both, "positive_price", "positive_side", (F.col("size") * F.col("positive_price")).alias("notional"), F.col("proxyWallet").alias("taker_wallet"), status.alias("reconciliation_status"))
    return out.select(X.namespace_id("leg", *ids).alias("actor_leg_id"), *both, "side", "price", "outcome_label", "outcome_sign", F.col("proxyWallet").alias("proxy_wallet"), F.lit("unknown").alias("liquidity_role"), F.lit("unreconciled").alias("role_confidence"))


def books(rows: DataFrame) -> DataFrame:
    """asset, observed_at, bids and asks (price, size; bad levels out), tick_size and reason of book records."""
    level = "array<struct<price:string,size:string>>"
    made = _fields(rows, f"asset string, token_id string, asset_id string, bids {level}, asks {level}, tick_size string, tickSize string")
    read = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast(level)), lambda x: F.struct(x["price"].try_cast("double").alias("price"), x["size"].try_cast("double").alias("size"))), lambda x: x["price"].isNotNull() & x["size"].isNotNull())
    made = made.withColumn("asset", F.coalesce("asset", "token_id", "asset_id"))
    return made.select("raw_response_id", "record_index", "asset", F.col("received_at").alias("observed_at"), read("bids").alias("bids"), read("asks").alias("asks"), F.coalesce("tick_size", "tickSize").try_cast("double").alias("tick_size"), F.when(F.col("asset").isNull(), "missing_asset").alias("reason"))


def position_snapshots(rows: DataFrame) -> DataFrame:
    """wallet, asset, observed_at, reported_size, reason of position records."""
    made = _fields(rows, "proxyWallet string, asset string, size string").withColumn("size", F.col("size").try_cast("double"))
    lacks = F.col("proxyWallet").isNull() | F.col("asset").isNull() | F.col("size").isNull()
    return made.select("raw_response_id", "record_index", F.col("proxyWallet").alias("wallet"), "asset", F.col("received_at").alias("observed_at"), F.col("size").alias("reported_size"), F.when(lacks, "missing_field").alias("reason"))


def activity(rows: DataFrame) -> DataFrame:
    """Activity records as normalize.activity_events takes them, with ts and reason."""
    made = _fields(rows, "proxyWallet string, conditionId string, timestamp string, type string, asset string, side string, size string, price string").withColumn("ts", F.col("timestamp").try_cast("double"))
    lacks = F.col("proxyWallet").isNull() | F.col("conditionId").isNull() | F.col("ts").isNull()
    return made.select(
        X.namespace_id("position", F.col("raw_response_id"), F.col("record_index")).alias("record_id"), F.upper(F.coalesce("type", F.lit(""))).alias("kind"), F.col("proxyWallet").alias("wallet"), F.col("conditionId").alias("condition"), "asset", F.upper("side").alias("side"),
        F.col("size").try_cast("double").alias("size"), F.col("price").try_cast("double").alias("price"), "ts", F.when(lacks, "missing_field").alias("reason"),
    )


def winner_asof(rows: DataFrame, statuses: DataFrame) -> DataFrame:
    """rows (condition, ts) with winner and resolution_version: the winning asset of the latest resolved status at or before ts, and
    how many status versions there were by then."""
    numbered = statuses.select("condition", F.col("effective_from").alias("at"), "version_seq", F.when(F.col("resolved"), F.col("winning_asset")).alias("winner"))
    out = asof_join(rows, numbered, ["condition"], "ts", "at", ["version_seq"], strict=False, order=["version_seq"]).withColumnRenamed("version_seq", "resolution_version")
    return asof_join(out, numbered.where("winner is not null"), ["condition"], "ts", "at", ["winner"], strict=False, order=["version_seq", "winner"])


def news(rows: DataFrame) -> DataFrame:
    """Articles of news records: an id from source and content, times, headline and body."""
    made = _fields(rows, "headline string, body string, url string, publishedAt string, timestampSource string, timestampConfidence string, previousId string, surprise string")
    made = made.withColumns({"headline": F.coalesce("headline", F.lit("")), "body": F.coalesce("body", F.lit(""))}).withColumn("content_hash", F.sha2(F.to_json(F.struct("body", "headline")), 256))
    return made.select(
        X.namespace_id("article", F.col("source"), F.col("content_hash"), F.col("raw_response_id")).alias("article_id"), F.col("source").alias("source_id"), F.col("url").alias("source_url"), X.iso_epoch("publishedAt").alias("source_published_at"), F.col("received_at").alias("first_observed_at"),
        "headline", "body", "content_hash", F.col("previousId").alias("previous_article_id"), F.col("surprise").try_cast("double").alias("surprise"), "raw_response_id", "record_index",
    )


def imported_markets(rows: DataFrame) -> DataFrame:
    """market, condition, state rows of imported markets (condition, created, ended, outcome_prices as a JSON text, two tokens): open at
    creation, closed and resolved at the end. The winner is the token whose price ended at 0.99 or more against 0.01 or less."""
    p = F.transform(F.from_json("outcome_prices", "array<string>"), lambda x: x.try_cast("double"))
    win = lambda a, b: (F.get(p, F.lit(a)) >= 0.99) & (F.get(p, F.lit(b)) <= 0.01)
    made = rows.withColumn("winning_asset", F.when(win(0, 1), F.col("token_1")).when(win(1, 0), F.col("token_2")))
    none = F.lit(None).cast("string")
    opened = made.select("condition", F.col("created").alias("effective_from"), F.lit(True).alias("trading_enabled"), F.lit(False).alias("closed"), F.lit(False).alias("resolved"), none.alias("winning_asset"))
    ended = made.where("ended is not null").select("condition", F.col("ended").alias("effective_from"), F.lit(False).alias("trading_enabled"), F.lit(True).alias("closed"), F.col("winning_asset").isNotNull().alias("resolved"), F.col("winning_asset").cast("string").alias("winning_asset"))
    return opened.unionByName(ended)
