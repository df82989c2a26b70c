"""Normalization of raw records: roles, versions, books, activity, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions import exprs as X


def changes(observations: DataFrame, key: str, content: str, order: list[str]) -> DataFrame:
    """Slowly changing versions: observations whose content differs from the one before, with version_seq."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = observations.withColumn("before", F.lag(content).over(w)).withColumn("nth", F.row_number().over(w))
    kept = rows.where((F.col("nth") == 1) | ~F.col("before").eqNullSafe(F.col(content))).drop("before", "nth")
    return kept.withColumn("version_seq", F.row_number().over(w))


def reconcile_roles(legs: DataFrame, executions: DataFrame) -> DataFrame:
    """leg_id with liquidity_role and role_confidence by what the leg's transaction holds.

    A leg matches an execution of its transaction and condition with the same log index, size and positive price
    (to 1e-9) within two seconds. Without executions: unknown; without a match: maker, or unknown if its wallet
    takes in the transaction; one match: taker, or maker if another wallet took; more: unknown. A leg_id belongs to one
    transaction, so what is joined by it is grouped where it is.
    """
    legs = legs.withColumn("pp", X.positive_price("price", "sign"))
    e = executions.select(F.col("tx").alias("e_tx"), F.col("condition").alias("e_condition"), F.col("log_index").alias("e_log"), F.col("size").alias("e_size"), F.col("positive_price").alias("e_price"), F.col("ts").alias("e_ts"), "taker")
    match = (F.col("condition") == F.col("e_condition")) & (F.col("log_index") == F.col("e_log")) & F.col("sign").isNotNull() & (F.abs(F.col("size") - F.col("e_size")) <= 1e-9) & (F.abs(F.col("pp") - F.col("e_price")) <= 1e-9) & (F.abs(F.col("ts") - F.col("e_ts")) <= 2)
    match = F.coalesce(match, F.lit(False))
    seen = legs.join(e, F.col("tx") == F.col("e_tx"), "left").groupBy("tx", "leg_id").agg(
        F.count("e_tx").alias("n"), F.sum(match.cast("int")).alias("m"), F.max(F.col("wallet") == F.col("taker")).alias("takes"), F.max(match & (F.col("wallet") == F.col("taker"))).alias("own")
    )
    role = F.when(F.col("n") == 0, "unknown").when((F.col("m") == 0) & F.col("takes"), "unknown").when(F.col("m") == 0, "maker").when(F.col("m") > 1, "unknown").when(F.col("own"), "taker").otherwise("maker")
    why = F.when(F.col("n") == 0, "no_canonical_execution").when((F.col("m") == 0) & F.col("takes"), "ambiguous_taker_wallet").when(F.col("m") == 0, "no_candidate_match").when(F.col("m") > 1, "multiple_candidate_executions").otherwise("single_candidate")
    return seen.select("leg_id", role.alias("liquidity_role"), why.alias("role_confidence"))


def book_metrics(books: DataFrame) -> DataFrame:
    """Metrics of books whose bids and asks are arrays of (price, size); bad levels (null or size <= 0) are dropped."""
    good = lambda c: F.filter(c, lambda x: x["price"].isNotNull() & (x["size"] > 0))
    rows = books.withColumns({"bids": good(F.col("bids")), "asks": good(F.col("asks"))})
    price = lambda c: F.transform(c, lambda x: x["price"])
    rows = rows.withColumns({"best_bid": F.array_max(price("bids")), "best_ask": F.array_min(price("asks"))})
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x["size"])
    rows = rows.withColumns({"bid_depth": total("bids"), "ask_depth": total("asks")})
    depth = F.col("bid_depth") + F.col("ask_depth")
    return rows.select(
        *[c for c in books.columns if c not in ("bids", "asks")], "best_bid", "best_ask", (F.col("best_ask") - F.col("best_bid")).alias("spread"), "bid_depth", "ask_depth",
        F.when(depth > 0, (F.col("bid_depth") - F.col("ask_depth")) / depth).alias("imbalance"),
        F.get(F.filter("bids", lambda x: x["price"] == F.col("best_bid")), F.lit(0))["size"].alias("best_bid_size"), F.get(F.filter("asks", lambda x: x["price"] == F.col("best_ask")), F.lit(0))["size"].alias("best_ask_size"),
    )


def moves() -> Column:
    """The position events (asset, token_change, cash_change, accounting) of an activity record, as an array.

    TRADE moves tokens and cash (exact, or inferred without a price); SPLIT and MERGE move both tokens and cash once;
    REDEEM pays the resolved winner, else it is unresolved; other kinds are unresolved, without amounts.
    """
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    event = lambda asset, token, cash, how: F.struct(asset.alias("asset"), token.cast("double").alias("token_change"), cash.cast("double").alias("cash_change"), how.alias("accounting"))
    none, both = F.lit(None), F.when(F.col("kind") == "SPLIT", 1.0).otherwise(-1.0)
    trade = F.array(event(F.col("asset"), sign * F.col("size"), -sign * F.col("size") * F.col("price"), F.when(F.col("price").isNull(), "inferred").otherwise("exact")))
    pair = F.array(event(F.col("asset"), both * F.col("size"), -both * F.col("size"), F.lit("exact")), event(F.col("other_asset"), both * F.col("size"), none, F.lit("exact")))
    won = F.col("winner").isNotNull()
    redeem = F.array(event(F.coalesce("winner", "asset"), F.when(won, -F.col("size")), F.when(won, F.col("size")), F.when(won, "exact").otherwise("unresolved")))
    other = F.array(event(F.col("asset"), none, none, F.lit("unresolved")))
    return F.when(F.col("kind") == "TRADE", trade).when(F.col("kind").isin("SPLIT", "MERGE"), pair).when(F.col("kind") == "REDEEM", redeem).otherwise(other)


def activity_events(rows: DataFrame, *more: str) -> DataFrame:
    """Position events of activity records (record_id, kind, wallet, condition, asset, other_asset, side, size, price, winner), by moves(),
    with more of the records' columns."""
    kept = ["record_id", "kind", "wallet", "condition", *more]
    return rows.select(*kept, F.posexplode(moves()).alias("part", "e")).select(*kept, "part", "e.*")


def state_from_executions(executions: DataFrame, bucket: float) -> DataFrame:
    """A state for each bucket with trades: volume and the last positive price, stamped with the bucket's end."""
    rows = executions.groupBy("condition", X.floor_to("ts", bucket).alias("b")).agg(F.sum("size").alias("volume"), F.max_by("positive_price", F.struct("ts", "execution_id")).alias("positive_price"))
    return rows.select("condition", (F.col("b") + bucket).alias("ts"), "volume", "positive_price")


def split_import(trades: DataFrame) -> DataFrame:
    """Imported trades (trade_id, condition, ts, price, size, side, maker, taker) as a taker and a maker leg each.

    Amounts are absolute, a bad side counts as BUY, the maker's side is the opposite; ordinal counts a condition's trades from 0.
    """
    side = F.when(F.col("side").isin("BUY", "SELL"), F.col("side")).otherwise("BUY")
    rows = trades.withColumns({"size": F.abs("size"), "price": F.abs("price"), "side": side})
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("condition").orderBy("ts", "trade_id")) - 1)
    leg = lambda wallet, s, role: F.struct(F.col(wallet).alias("wallet"), s.alias("side"), F.lit(role).alias("role"))
    opposite = F.when(F.col("side") == "BUY", "SELL").otherwise("BUY")
    return rows.select("trade_id", "condition", "ts", "price", "size", "ordinal", F.explode(F.array(leg("taker", F.col("side"), "taker"), leg("maker", opposite, "maker"))).alias("x")).select("trade_id", "condition", "ts", "price", "size", "ordinal", "x.*")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """INSERT OR IGNORE: of the rows of a key the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What of rows an append may add to target: each key once, none that target has."""
    return first_wins(rows, keys, order).join(target.select(*keys).distinct(), keys, "left_anti")
