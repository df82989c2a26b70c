"""Decisions: anchored episodes, at-risk opportunities, positions, features, evidence and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions import exprs as X
from hindcast.operators.asof import SLICE, _named, _same, asof_join

HALF_LIVES = {"6h": 6 * 3600.0, "24h": 24 * 3600.0, "72h": 72 * 3600.0, "168h": 168 * 3600.0}
MAX_AGE = 28 * 86_400.0
RATIO = 0.2
#: Ledgers of a wallet are cut into slices of two years: in shorter ones there is hardly a second event, so that what they end
#: with is as many rows as the events.
LEDGER_SLICE = 730 * 86_400.0


def anchors(legs: DataFrame, interval: float) -> DataFrame:
    """wallet, condition, anchor: when the episodes of episodes() begin, without their legs."""
    fold = F.aggregate(F.array_sort(F.collect_set("ts")), F.array().cast("array<double>"), lambda a, t: F.when((F.size(a) == 0) | (t - F.element_at(a, -1) >= interval), F.concat(a, F.array(t))).otherwise(a))
    return legs.where("role = 'taker'").groupBy("wallet", "condition").agg(fold.alias("anchors")).select("wallet", "condition", F.explode("anchors").alias("anchor"))


def episodes(legs: DataFrame, interval: float) -> DataFrame:
    """Bursts of one wallet's taker legs in one condition: a new one starts interval after the first leg of the last.

    An anchored window, not a session, so the anchors are folded over the sorted distinct times of a (wallet, condition); their
    number is bounded by the time that the data span. Legs find their anchor by an as-of read. net and gross sum the mapped legs; direction is null without
    gross, below the ratio, or for a net of 0.
    """
    rows = legs.where("role = 'taker'").withColumn("change", X.proposition_change("size", "side", "sign"))
    at = anchors(legs, interval)
    placed = asof_join(rows.select("wallet", "condition", "ts", "change"), at, ["wallet", "condition"], "ts", "anchor", ["anchor"], strict=False, slice_seconds=max(SLICE, 8 * interval))
    made = placed.groupBy("wallet", "condition", "anchor").agg(F.count("*").alias("n_legs"), F.coalesce(F.sum("change"), F.lit(0.0)).alias("net"), F.coalesce(F.sum(F.abs("change")), F.lit(0.0)).alias("gross"))
    ratio = F.when(F.col("gross") > 0, F.abs("net") / F.col("gross"))
    return made.withColumn("ratio", ratio).withColumn("direction", F.when((F.col("ratio") >= RATIO) & (F.col("net") > 0), "positive").when((F.col("ratio") >= RATIO) & (F.col("net") < 0), "negative"))


def position_asof(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """Of each decision (decision_id, wallet, condition, t) the fold of the wallet's events strictly before it.

    Per decision, not per pair: each event is put at its time and running sums are read at the decision.
    """
    e = events.select("wallet", "condition", F.col("ts").alias("t"), F.lit(1).alias("side"), "token_change", "cash_change", F.col("token_change").isNull().cast("long").alias("unresolved"), F.lit(None).cast("string").alias("decision_id"))
    d = decisions.select("wallet", "condition", "t", F.lit(0).alias("side"), F.lit(None).cast("double").alias("token_change"), F.lit(None).cast("double").alias("cash_change"), F.lit(0).cast("long").alias("unresolved"), "decision_id")
    w = Window.partitionBy("wallet", "condition").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(d).withColumns({"tokens": F.coalesce(F.sum("token_change").over(w), F.lit(0.0)), "cash": F.coalesce(F.sum("cash_change").over(w), F.lit(0.0)), "n_unresolved": F.sum("unresolved").over(w)})
    return both.where("decision_id is not null").select("decision_id", "wallet", "condition", "t", "tokens", "cash", "n_unresolved", (F.col("n_unresolved") == 0).alias("complete"))


def balances_asof(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """Of each decision (decision_id, wallet, t) and asset that the wallet has events of strictly before t: balance,
    cash, n_events and n_unresolved; the fold of the ledger by asset.

    Decisions meet the assets of their wallet, not its events: the sums come from running sums over (wallet, asset).
    """
    keys = ["wallet", "asset"]
    rows = events.select(*keys, "ts", F.coalesce("token_change", F.lit(0.0)).alias("balance"), F.coalesce("cash_change", F.lit(0.0)).alias("cash"), F.lit(1.0).alias("n_events"), F.col("token_change").isNull().cast("double").alias("n_unresolved"))
    names = ["balance", "cash", "n_events", "n_unresolved"]
    at = rows.groupBy(*keys, "ts").agg(*[F.sum(n).alias(n) for n in names]).withColumn("slice", F.floor(F.col("ts") / LEDGER_SLICE))
    run = Window.partitionBy(*keys, "slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = at.groupBy(*keys, "slice").agg(*[F.sum(n).alias(n) for n in names]).withColumns({f"b_{n}": F.coalesce(F.sum(n).over(over), F.lit(0.0)) for n in names})
    summed = at.join(_named(carry, [*keys, "slice"], [f"b_{n}" for n in names]), _same([*keys, "slice"])).select(*keys, "ts", *[(F.sum(n).over(run) + F.col(f"b_{n}")).alias(n) for n in names])
    pairs = decisions.join(rows.groupBy(*keys).agg(F.min("ts").alias("first")), "wallet").where("first < t").drop("first")
    return asof_join(pairs, summed, keys, "t", "ts", names, order=["ts"], slice_seconds=LEDGER_SLICE)


def balances_at(events: DataFrame, times: tuple[float, ...]) -> DataFrame:
    """wallet, asset, t, balance, cash, n_events, n_unresolved: balances_asof() where every wallet of events looks at the same few times.

    One aggregate by (wallet, asset), which tasks begin before the exchange, so that an event is shuffled once at most, without
    its time, and a hot wallet or asset leaves each task as one row. Events from the last time on aren't shuffled.
    """
    rows = events.where((F.col("ts") < max(times)) & F.col("wallet").isNotNull()).select("wallet", "asset", "ts", "token_change", "cash_change")
    sums = []
    for i, t in enumerate(times):
        seen = F.col("ts") < t
        of = lambda c, seen=seen: F.sum(F.when(seen, c))
        sums += [of(F.col("token_change")).alias(f"b{i}"), of(F.col("cash_change")).alias(f"c{i}"), F.count_if(seen).alias(f"n{i}"), F.count_if(seen & F.col("token_change").isNull()).alias(f"u{i}")]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), zero(F.col(f"b{i}")).alias("balance"), zero(F.col(f"c{i}")).alias("cash"), F.col(f"n{i}").alias("n_events"), F.col(f"u{i}").alias("n_unresolved")) for i, t in enumerate(times)])).alias("x")
    return rows.groupBy("wallet", "asset").agg(*sums).select("wallet", "asset", each).select("wallet", "asset", "x.*").where("n_events > 0")


def decayed_signals(pairs: DataFrame) -> DataFrame:
    """pairs: decision_id, family, age (seconds), relevance, direction, novelty, confidence. For each half-life the signed,
    positive and negative sums over families of each family's largest contribution of either sign."""
    rows = pairs.where((F.col("age") > 0) & (F.col("age") <= MAX_AGE))
    base = X.clamp("relevance", 0.0, 1.0) * X.clamp(F.col("direction").cast("double"), -1.0, 1.0) * F.coalesce("novelty", F.lit(1.0)) * F.coalesce("confidence", F.lit(1.0))
    made = rows.select("decision_id", "family", *[(base * X.half_life_decay("age", h)).alias(k) for k, h in HALF_LIVES.items()])
    by_family = made.groupBy("decision_id", "family").agg(*[x for k in HALF_LIVES for x in (F.max(F.greatest(F.col(k), F.lit(0.0))).alias(f"p{k}"), F.min(F.least(F.col(k), F.lit(0.0))).alias(f"n{k}"))])
    out = []
    for k in HALF_LIVES:
        out += [F.sum(F.col(f"p{k}") + F.col(f"n{k}")).alias(f"news_decay_signed_{k}"), F.sum(f"p{k}").alias(f"news_decay_positive_{k}"), F.sum(-F.col(f"n{k}")).alias(f"news_decay_negative_{k}")]
    return by_family.groupBy("decision_id").agg(*out)


def attribution_score(relevance: Column, align: Column, age: Column, novelty: Column, surprise: Column, n: Column, moved: Column) -> Column:
    """The weighted score of a family as the news that a decision answers to, rounded to six digits."""
    return F.round(
        F.lit(0.35) * relevance + F.lit(0.2) * align + F.lit(0.15) * F.greatest(F.lit(0.0), F.lit(1.0) - age / 86_400) + F.lit(0.1) * novelty + F.lit(0.05) * surprise + F.lit(0.05) * F.least(n / 3, F.lit(1.0)) + F.lit(0.1) * moved, 6
    )
