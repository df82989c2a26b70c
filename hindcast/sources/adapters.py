"""The driver's tables as tables of the domain. DUCK has the same views as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions import exprs as X

START = 1_704_067_200.0  # 2024-01-01, when the events begin
BAR = 21_600.0
DAY = 86_400.0
WEEK = 7 * DAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actor trade legs: one for each line item; ids digest all its columns, as its keys aren't unique."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    ts = X.epoch("l_shipdate")
    ident = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")], *[F.round(F.col(c) * 100).cast("long").cast("string") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")], ts.cast("long").cast("string"), "l_returnflag", "l_linestatus"))
    return rows.select(
        ident.alias("leg_id"), F.col("l_orderkey").alias("tx"), F.col("l_linenumber").cast("long").alias("log_index"), F.col("o_custkey").alias("wallet"), F.col("l_suppkey").alias("condition"), F.col("l_partkey").alias("asset"),
        F.when(F.col("o_orderstatus") == "O", "BUY").when(F.col("o_orderstatus") == "F", "SELL").alias("side"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).alias("sign"),
        F.col("l_quantity").alias("size"), (F.round(F.col("l_discount") * 100) / 10).alias("price"), ts.alias("ts"), F.when(F.col("l_linenumber") % 2 == 1, "taker").otherwise("maker").alias("role"),
    )


#: Which legs are executions.
IS_EXECUTION = "side is not null and sign is not null and price between -1e-9 and 1 + 1e-9"


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taker trades with a known side and sign, in terms of the positive proposition."""
    rows = legs(spark, sf_dir).where(IS_EXECUTION)
    rows = rows.withColumns({"positive_price": X.positive_price("price", "sign"), "positive_side": X.positive_side("side", "sign")})
    status = F.when(F.col("sign") == 1, "direct").otherwise("complemented")
    return rows.select(F.col("leg_id").alias("execution_id"), "tx", "log_index", "condition", "positive_price", "positive_side", "size", (F.col("size") * F.col("positive_price")).alias("notional"), F.col("wallet").alias("taker"), "ts", status.alias("status"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-book snapshots from the events: a condition for each event type."""
    mid = F.col("value") / (F.col("value") + 35)
    spread = F.lit(0.01) + F.col("event_id") % 5 * F.lit(0.002)
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("condition"), X.epoch("ts").alias("ts"), mid.alias("mid"), spread.alias("spread"), (F.col("user_id") % 50 + 1).cast("double").alias("bid_size"), (F.col("event_id") % 40 + 1).cast("double").alias("ask_size"), F.when(F.col("event_id") % 7 > 0, 0.001).alias("tick"))
    return rows.withColumns({"best_bid": F.col("mid") - F.col("spread") / 2, "best_ask": F.col("mid") + F.col("spread") / 2, "depth": F.col("bid_size") + F.col("ask_size"), "imbalance": (F.col("bid_size") - F.col("ask_size")) / (F.col("bid_size") + F.col("ask_size"))})


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions on the books' conditions: every third event."""
    return table(spark, sf_dir, "events").where("event_id % 3 = 0").select("event_id", F.col("event_type").alias("condition"), X.epoch("ts").alias("ts"), F.round("value", 2).alias("notional"), (F.col("value") / (F.col("value") + 35)).alias("price"))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collector gaps: an hour after every event worth more than 150; a quarter are resolved, and some open."""
    rows = table(spark, sf_dir, "events").where("value > 150")
    t = X.epoch("ts")
    return rows.select(F.col("event_id").alias("gap_id"), F.col("event_type").alias("condition"), t.alias("gap_start"), F.when(F.col("event_id") % 50 != 0, t + 3600).alias("gap_end"), (F.col("event_id") % 4 == 0).alias("resolved"))


def _firsts(spark: SparkSession, sf_dir: str, seconds: float) -> DataFrame:
    """The first event of each condition in each span of so many seconds since START."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("condition"), X.epoch("ts").alias("ts"), "value", "event_id")
    return rows.groupBy("condition", F.floor((F.col("ts") - START) / seconds).alias("span")).agg(F.min(F.struct("ts", "event_id", "value")).alias("e")).select("condition", F.col("e.ts").alias("effective_from"), F.col("e.value").alias("value"))


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of the books' conditions, set by each day's first event: one worth more than 60 halts trading."""
    return _firsts(spark, sf_dir, DAY).select("condition", "effective_from", (F.col("value") > 60).alias("blocking"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract versions of the books' conditions: one with each week's first event; views resolve 27 days after START."""
    return _firsts(spark, sf_dir, WEEK).select("condition", "effective_from", F.when(F.col("condition") == "view", START + 27 * DAY).alias("resolution_time"))


def status_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of a customer's latest order status, by time."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("market"), X.epoch("o_orderdate").alias("effective_from"), (X.epoch("o_orderdate") + (F.col("o_orderkey") % 5) * 86400).alias("first_observed_at"), F.col("o_orderstatus").alias("state"), F.col("o_orderkey").alias("obs"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News articles from the documents; they appear one after another over thirty days."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article"), (F.lit(START) + F.col("doc_id") % 1000 * F.lit(2592.0)).alias("seen_at"), "lang", "source", "text")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each article, its first sentence, with entities, words and the family that it belongs to."""
    rows = articles(spark, sf_dir).withColumn("claim", X.first_sentence("text"))
    rows = rows.withColumns({"entities": X.entities("claim"), "words": X.tokens("claim")})
    return rows.select("article", "seen_at", "source", "claim", "entities", "words", X.family_key(F.col("entities"), F.col("words")).alias("family"))


_EPOCH = "epoch_us({})/1e6"
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
DUCK = {
    "legs": f"""legs AS (SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_quantity * 100) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT),
        CAST({_EPOCH.format('l_shipdate')} AS BIGINT), l_returnflag, l_linestatus)) AS leg_id, l_orderkey AS tx, CAST(l_linenumber AS BIGINT) AS log_index, o_custkey AS wallet, l_suppkey AS condition, l_partkey AS asset,
        CASE o_orderstatus WHEN 'O' THEN 'BUY' WHEN 'F' THEN 'SELL' END AS side, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 END AS sign, l_quantity AS size, round(l_discount * 100) / 10 AS price, {_EPOCH.format('l_shipdate')} AS ts,
        CASE WHEN l_linenumber % 2 = 1 THEN 'taker' ELSE 'maker' END AS role FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "executions": """executions AS (SELECT leg_id AS execution_id, tx, log_index, condition, pp AS positive_price, CASE WHEN sign = 1 THEN side WHEN side = 'BUY' THEN 'SELL' ELSE 'BUY' END AS positive_side, size, size * pp AS notional, wallet AS taker, ts,
        CASE WHEN sign = 1 THEN 'direct' ELSE 'complemented' END AS status FROM (SELECT *, CASE WHEN sign = 1 THEN price ELSE 1.0 - price END AS pp FROM legs WHERE side IS NOT NULL AND sign IS NOT NULL AND price BETWEEN -1e-9 AND 1 + 1e-9))""",
    "books": f"""books AS (SELECT *, mid - spread / 2 AS best_bid, mid + spread / 2 AS best_ask, bid_size + ask_size AS depth, (bid_size - ask_size) / (bid_size + ask_size) AS imbalance FROM (SELECT event_id, event_type AS condition, {_EPOCH.format('ts')} AS ts,
        value / (value + 35) AS mid, 0.01::DOUBLE + event_id % 5 * 0.002::DOUBLE AS spread, CAST(user_id % 50 + 1 AS DOUBLE) AS bid_size, CAST(event_id % 40 + 1 AS DOUBLE) AS ask_size, CASE WHEN event_id % 7 > 0 THEN 0.001::DOUBLE END AS tick FROM events))""",
    "fills": f"fills AS (SELECT event_id, event_type AS condition, {_EPOCH.format('ts')} AS ts, round(value, 2) AS notional, value / (value + 35) AS price FROM events WHERE event_id % 3 = 0)",
    "gaps": f"gaps AS (SELECT event_id AS gap_id, event_type AS condition, {_EPOCH.format('ts')} AS gap_start, CASE WHEN event_id % 50 != 0 THEN {_EPOCH.format('ts')} + 3600 END AS gap_end, event_id % 4 = 0 AS resolved FROM events WHERE value > 150)",
    "statuses": f"statuses AS (SELECT condition, min(ts) AS effective_from, arg_min(value, (ts, event_id)) > 60 AS blocking FROM (SELECT event_type AS condition, event_id, value, {_EPOCH.format('ts')} AS ts FROM events) GROUP BY condition, floor((ts - {START}) / {DAY}))",
    "contracts": f"contracts AS (SELECT condition, min(ts) AS effective_from, CASE WHEN condition = 'view' THEN {START + 27 * DAY}::DOUBLE END AS resolution_time FROM (SELECT event_type AS condition, {_EPOCH.format('ts')} AS ts FROM events) GROUP BY condition, floor((ts - {START}) / {WEEK}))",
    "status_versions": f"status_versions AS (SELECT o_custkey AS market, {_EPOCH.format('o_orderdate')} AS effective_from, {_EPOCH.format('o_orderdate')} + (o_orderkey % 5) * 86400 AS first_observed_at, o_orderstatus AS state, o_orderkey AS obs FROM orders)",
    "articles": "articles AS (SELECT doc_id AS article, 1704067200.0::DOUBLE + doc_id % 1000 * 2592.0::DOUBLE AS seen_at, lang, source, text FROM documents)",
    "claims": rf"""claims AS (SELECT article, seen_at, source, claim, entities, words, CASE WHEN len(entities) > 0 THEN array_to_string(list_sort(list_distinct(list_transform(entities, lambda x: lower(x))))[1:4], '|') WHEN len(words) > 0 THEN array_to_string(list_sort(words)[1:4], '|') ELSE 'misc' END AS family
        FROM (SELECT *, list_sort(list_distinct(list_filter(regexp_extract_all(claim, '\b([A-Z][A-Za-z]+)', 1), lambda w: lower(w) NOT IN ({_STOP})))) AS entities,
        list_distinct(list_filter(regexp_extract_all(lower(claim), '([a-z0-9'']+)', 1), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))) AS words FROM (SELECT article, seen_at, source, regexp_extract(trim(coalesce(text, '')), '^((?s:.*?)[.!?])\s+', 1) AS c0, text, CASE WHEN regexp_matches(trim(coalesce(text, '')), '[.!?]\s') THEN regexp_extract(trim(coalesce(text, '')), '^((?s:.*?)[.!?])\s', 1) ELSE trim(coalesce(text, '')) END AS claim FROM articles)))""",
}
_NEEDS = {"executions": ["legs"], "claims": ["articles"]}


def duck(*names: str) -> str:
    """WITH and the views of the names, with those that they need."""
    found: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in found:
                found.append(x)
    return "WITH RECURSIVE " + ",\n".join(DUCK[n] for n in found) + "\n"
