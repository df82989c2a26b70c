"""The context of decisions and their 68 features, one row a decision.

Everything that a decision may know is read as of its time, strictly before it unless said otherwise, in one pass for each kind of
key: the condition, the wallet, the wallet in the condition, and all together. Counts and sums over spans are
differences of running sums. News are kept as versions: the latest judgment of a family on a condition stands until the next
one of that family, so what stands at a time is a running sum of what began less what ended, decayed signals included, and no
decision is paired with the families before it. Only the strongest standing judgment needs a sweep, which runs over
short slots of time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions import exprs as X
from hindcast.operators.asof import SLICE
from hindcast.operators.decisions import HALF_LIVES, MAX_AGE
from hindcast.operators.lineage import stored
from hindcast.operators.surfaces import Probe, Surface, dense_slice, exact, read_surfaces, span

DAY, HOUR, SLOT = 86_400.0, 3600.0, 21_600.0
_DECAYS = [f"news_decay_{kind}_{k}" for k in HALF_LIVES for kind in ("signed", "positive", "negative")]
#: Fixed names of the features by group.
GROUPS = {
    "base": ["base_market_age", "base_time_to_resolution", "base_actor_positive_rate", "base_actor_positive_rate_missing"],
    "market": ["mkt_last_price", "mkt_last_price_missing", "mkt_return_short", "mkt_return_long", "mkt_volatility", "mkt_state_from_executions", "mkt_volume", "mkt_spread", "mkt_spread_missing", "mkt_depth", "mkt_imbalance", "mkt_execution_rate"],
    "actor": ["act_recent_trade_count", "act_recent_gross_volume", "act_recent_net_prop_change", "act_time_since_last_trade", "act_time_since_last_trade_missing", "act_category_trade_count"],
    "position": ["pos_positive_tokens", "pos_negative_tokens", "pos_net_proposition", "pos_gross_exposure", "pos_distance_from_neutral", "pos_history_incomplete", "pos_unresolved_event_count"],
    "news": ["news_rel_max", "news_rel_sum", "news_direction", "news_novelty_max", "news_surprise_max", "news_age_hours", "news_source_diversity", "news_confirmation_count", "news_contradiction_count", "news_article_count", "news_ingestion_lag", "news_missing", "news_recent_missing", "news_decay_missing", *_DECAYS],
    "paper": ["liq_mode_event", "liq_mode_missing", "liq_mode_age_hours", "event_mode_prevalence", "event_mode_prevalence_missing", "impact_screen_available", "impactful_news_count", "impactful_news_probability", "impact_screen_contradiction", "initial_response_so_far", "initial_response_missing", "attention_claim_load", "attention_unrelated_load"],
}
FEATURES = [f for group in GROUPS.values() for f in group]


@dataclass(frozen=True)
class Tables:
    """What contexts are read from.

    contracts: condition, effective_from, resolution_time; statuses: condition, effective_from, blocking; books: condition,
    ts, event_id, token, mid, spread, depth, imbalance; executions: condition, ts, event_id, size, price; legs: wallet, condition, ts,
    leg_id, side, size, sign (null if unmapped), token (+1, -1), resolved; judgments: condition, family, at, article,
    rel_score, rel_class, direction, novelty, surprise, confidence; articles: article, seen_at, published_at, source; claims:
    article, seen_at, family; modes: condition, end, label; screens: condition, ts, available_at, status, transition;
    closes: condition, bar_end, close.
    """

    contracts: DataFrame
    statuses: DataFrame
    books: DataFrame
    executions: DataFrame
    legs: DataFrame
    judgments: DataFrame
    articles: DataFrame
    claims: DataFrame
    modes: DataFrame
    screens: DataFrame
    closes: DataFrame


def news_versions(judgments: DataFrame) -> DataFrame:
    """condition, family, at, next (when the family's next judgments come, or null) and what the judgments of one time are together worth:
    n, rel_sum, positive and negative (the largest contributions, unsigned), top (the strongest judgment: by score, then article),
    novelty, surprise, both (whether they point both ways). Irrelevant ones only end what stood before them."""
    relevant = F.col("rel_class") != "irrelevant"
    worth = X.clamp("rel_score", 0.0, 1.0) * X.clamp(F.col("direction").cast("double"), -1.0, 1.0) * X.clamp(F.coalesce("novelty", F.lit(1.0)), 0.0, 1.0) * X.clamp(F.coalesce("confidence", F.lit(1.0)), 0.0, 1.0)
    rows = judgments.withColumn("worth", worth)
    of = lambda c: F.when(relevant, c)
    made = rows.groupBy("condition", "family", F.col("at").cast("double").alias("at")).agg(
        F.count_if(relevant).alias("n"), F.coalesce(F.sum(of(exact(F.col("rel_score")))), F.lit(0)).alias("rel_sum"), F.coalesce(F.max(of(F.greatest("worth", F.lit(0.0)))), F.lit(0.0)).alias("positive"), F.coalesce(F.max(of(F.greatest(-F.col("worth"), F.lit(0.0)))), F.lit(0.0)).alias("negative"),
        F.max(of(F.struct("rel_score", "article", "direction"))).alias("top"), F.max(of(F.coalesce("novelty", F.lit(0.0)))).alias("novelty"), F.max(of(F.coalesce("surprise", F.lit(0.0)))).alias("surprise"),
        (F.coalesce(F.max(of(F.col("direction") > 0)), F.lit(False)) & F.coalesce(F.max(of(F.col("direction") < 0)), F.lit(False))).alias("both"),
    )
    return _with_next(made, ["condition", "family"], "at")


def _with_next(rows: DataFrame, by: list[str], time: str) -> DataFrame:
    """rows with next, the time of the first later row of the same key; rows are told apart by key and time."""
    read = read_surfaces(rows, by, [*by, time], [Probe("own", F.col(time), strict=False)], [Surface("later", rows.select(*by, F.col(time).alias("__t")), "__t", ahead=("__t",))])
    return read.select(*rows.columns, F.col("later_own.ahead.__t").alias("next"))


def _deltas(rows: DataFrame, start: str, end: Column, values: dict[str, Column], keep: list[str]) -> DataFrame:
    """keep, at and values of each row at its start, and less them when it has ended."""
    begun = [c.alias(n) for n, c in values.items()]
    ended = [(-c).alias(n) for n, c in values.items()]
    return rows.select(*keep, F.col(start).alias("__at"), *begun).union(rows.select(*keep, end.alias("__at"), *ended))


def decayed(decisions: DataFrame, versions: DataFrame, slice_seconds: float = SLICE) -> DataFrame:
    """decision_id with the decayed signals and families, how many of them stand and are no older than MAX_AGE.

    A contribution c of time s is worth c * 2^(-(t - s) / h) at t, so sums of c * 2^((s - o) / h) serve all t. The origin o is
    that of a band of MAX_AGE, which keeps the numbers within bounds; a decision reads its own band and the one before it.
    """
    band = lambda c: F.floor(c / MAX_AGE)
    rows = versions.where("n > 0").withColumns({"band": band(F.col("at")), "end": F.least(F.col("next"), F.col("at") + MAX_AGE)})
    scaled = {f"{x}_{k}": F.col(x) * F.pow(F.lit(2.0), (F.col("at") - F.col("band") * MAX_AGE) / h) for x in ("positive", "negative") for k, h in HALF_LIVES.items()}
    moves = _deltas(rows.withColumns(scaled | {"families": F.lit(1)}), "at", F.col("end"), {n: F.col(n) for n in [*scaled, "families"]}, ["condition", "band"])
    looks = decisions.select("decision_id", "condition", "t", F.explode(F.array(band(F.col("t")), band(F.col("t")) - 1)).alias("band"))
    read = read_surfaces(looks, ["condition", "band"], ["decision_id", "band"], [Probe("now", F.col("t"))], [Surface("s", moves, "__at", sums={n: F.col(n) for n in [*scaled, "families"]})], slice_seconds)
    fall = {k: F.pow(F.lit(2.0), -(F.col("t") - F.col("band") * MAX_AGE) / h) for k, h in HALF_LIVES.items()}
    clean = lambda c: F.greatest(c, F.lit(0.0))
    sums = [F.sum(clean(F.col(f"s_now.{x}_{k}")) * fall[k]).alias(f"{x}_{k}") for x in ("positive", "negative") for k in HALF_LIVES]
    by = read.groupBy("decision_id").agg(F.sum("s_now.families").alias("families"), *sums)
    return by.select("decision_id", "families", *[c for k in HALF_LIVES for c in ((F.col(f"positive_{k}") - F.col(f"negative_{k}")).alias(f"news_decay_signed_{k}"), F.col(f"positive_{k}").alias(f"news_decay_positive_{k}"), F.col(f"negative_{k}").alias(f"news_decay_negative_{k}"))])


def strongest(decisions: DataFrame, versions: DataFrame, lookback: float = DAY, slot: float = SLOT) -> DataFrame:
    """decision_id, top (rel_score, article, direction, at), novelty, surprise: the largest among the versions that stand
    and are no older than lookback; decisions without any have no row.

    A sweep over (condition, slot of time): a version goes to every slot that it stands in, tasks hold only what stands.
    """
    number = lambda c: F.floor(c / slot).cast("long")
    none = F.lit(None)
    rows = versions.where("n > 0").withColumn("end", F.least(F.col("next"), F.col("at") + lookback))
    rows = rows.withColumn("slot", F.explode(F.sequence(number(F.col("at")), number(F.col("end")))))
    begins = F.col("slot") * slot
    rows = rows.select("condition", "slot", F.greatest("at", begins).alias("t"), F.when(F.col("at") < begins, 0).otherwise(2).alias("kind"), none.cast("string").alias("decision_id"), F.col("end"), "at", F.col("top.rel_score").alias("rel_score"), F.col("top.article").alias("article"), F.col("top.direction").cast("double").alias("direction"), "novelty", "surprise")
    looks = decisions.select("condition", number(F.col("t")).alias("slot"), "t", F.lit(1).alias("kind"), F.col("decision_id").cast("string").alias("decision_id"))
    both = rows.unionByName(looks, allowMissingColumns=True).repartition("condition", "slot").sortWithinPartitions("condition", "slot", "t", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tops, fresh, shocks = None, [], [], []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["condition"], r["slot"]) != key:
                    key, tops, fresh, shocks = (r["condition"], r["slot"]), [], [], []
                if r["kind"] != 1:
                    heapq.heappush(tops, (-r["rel_score"], -r["at"], -r["article"], r["end"], r["direction"]))
                    heapq.heappush(fresh, (-r["novelty"], r["end"]))
                    heapq.heappush(shocks, (-r["surprise"], r["end"]))
                    continue
                for heap, end in ((tops, 3), (fresh, 1), (shocks, 1)):
                    while heap and heap[0][end] < r["t"]:
                        heapq.heappop(heap)
                if tops:
                    top = tops[0]
                    out.append((r["decision_id"], -top[0], -top[2], top[4], -top[1], -fresh[0][0], -shocks[0][0]))
            names = ["d", "rel_score", "article", "direction", "at", "novelty", "surprise"]
            types = [pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    made = both.mapInArrow(sweep, "d string, rel_score double, article long, direction double, at double, novelty double, surprise double")
    return made.select("d", F.struct("rel_score", "article", "direction", "at").alias("top"), "novelty", "surprise")


def contexts(decisions: DataFrame, tables: Tables) -> DataFrame:
    """decisions (decision_id, wallet, condition, t) with what each may know, as structs <surface>_<probe>; for inspection,
    checks and features. A pass reads its left side twice, so each one's result is stored, and so are the tables that are more than
    a scan. Only the decisions themselves go through a pass, not what others have found, which is joined by decision_id at the end. Busy
    conditions are read in shorter slices."""
    c, one = F.col, F.lit(1)
    decisions = stored(decisions, "decisions")
    tables = replace(tables, **{n: stored(getattr(tables, n), n) for n in ("judgments", "claims", "modes", "screens", "closes")})
    probes = [Probe("now", c("t")), Probe("with", c("t"), strict=False), Probe("hour", c("t") - HOUR), Probe("day", c("t") - DAY)]
    priced = lambda p: {"n": F.when(p.isNotNull(), one).otherwise(F.lit(0)), "p": exact(p), "pp": exact(F.pow(exact(p).cast("double"), F.lit(2)), 18)}
    versions = stored(news_versions(tables.judgments), "versions")
    standing = {"rel_sum": c("rel_sum"), "n": c("n"), "confirmed": c("n") - 1, "contradicted": c("both").cast("int"), "families": one}
    recent = _deltas(versions.where("n > 0"), "at", F.least(c("next"), c("at") + DAY), standing, ["condition"])
    own = tables.judgments.where("rel_class != 'irrelevant'").groupBy("condition", "family").agg(F.min("at").alias("o"))
    families = tables.claims.groupBy("family").agg(F.min("seen_at").alias("e"))
    mine = own.join(families.withColumnRenamed("family", "f"), c("family") == c("f")).withColumn("o", F.greatest("o", "e")).where(c("o") < c("e") + DAY)
    mine = _deltas(mine, "o", c("e") + DAY, {"n": one}, ["condition"])
    seen = tables.closes.select("condition", c("bar_end").alias("b"), "close")
    screens = read_surfaces(tables.screens.where("status = 'screened'"), ["condition"], [], [Probe("then", c("ts"), strict=False)], [Surface("pre", seen, "b", last=("close",))])
    latest = F.when(c("transition") == 1, F.struct("ts", c("pre_then.last.__at").alias("pre_at"), c("pre_then.last.close").alias("pre")))
    surfaces = [
        Surface("contract", tables.contracts, "effective_from", last=("effective_from", "resolution_time"), probes=("now",)),
        Surface("status", tables.statuses, "effective_from", last=("blocking",), order=("blocking",), probes=("now",)),
        *[Surface(n, tables.books, "ts", last=("spread", "depth", "imbalance"), order=("event_id",), where=c("token") == k, probes=("now",)) for n, k in (("yes", 1), ("no", -1))],
        Surface("book", tables.books, "ts", last=("mid",), ahead=("mid",), order=("event_id",), sums=priced(c("mid")), where=c("mid").isNotNull(), probes=("now", "hour", "day")),
        Surface("trade", tables.executions, "ts", last=("price",), ahead=("price",), order=("event_id",), sums=priced(c("price")) | {"size": exact(c("size")), "rows": one}, probes=("now", "hour", "day")),
        Surface("mode", tables.modes, "end", last=("label",), probes=("with",)),
        Surface("screen", screens, "available_at", sums={"evaluated": one, "impactful": F.when(c("transition") == 1, one).otherwise(F.lit(0))}, highest={"latest": latest, "score": c("transition").cast("double")}, probes=("now",)),
        Surface("close", seen, "b", last=("close",), probes=("with",)),
        Surface("recent", recent, "__at", sums={n: c(n) for n in standing}, probes=("now",)),
        Surface("own", mine, "__at", sums={"n": c("n")}, probes=("with",)),
    ]
    width = dense_slice(tables.books, ["condition"], "ts", HOUR)
    rows = stored(read_surfaces(decisions, ["condition"], ["decision_id"], probes, surfaces, width), "contexts")
    looks = rows.select(*decisions.columns)
    change = X.proposition_change("size", "side", "sign")
    mapped = c("sign").isNotNull()
    legs = Surface("leg", tables.legs, "ts", last=("ts",), order=("leg_id",), sums={"n": one, "size": exact(c("size")), "net": exact(F.when(mapped, change)), "directed": F.when(mapped, one).otherwise(F.lit(0)), "positive": F.when(mapped & (change > 0), one).otherwise(F.lit(0))})
    actor = stored(read_surfaces(looks, ["wallet"], ["decision_id"], [Probe("now", c("t")), Probe("day", c("t") - DAY)], [legs]), "contexts")
    tokens = F.when(c("side") == "BUY", exact(c("size"))).when(c("side") == "SELL", -exact(c("size")))
    known = lambda k: F.when(mapped & (c("token") == k), one).otherwise(F.lit(0))
    held = Surface("held", tables.legs, "ts", sums={"n": one, "unresolved": (~c("resolved")).cast("int"), "yes": F.when(c("resolved") & (c("token") == 1), tokens), "no": F.when(c("resolved") & (c("token") == -1), tokens), "knows_yes": known(1), "knows_no": known(-1)})
    place = stored(read_surfaces(looks, ["wallet", "condition"], ["decision_id"], [Probe("now", c("t"))], [held]), "contexts")
    everywhere = stored(_common(looks, tables, families), "contexts")
    news = decayed(decisions, versions, width)
    top = strongest(decisions, versions).withColumnsRenamed({"novelty": "novelty_max", "surprise": "surprise_max"})
    top = top.withColumn("decision_id", c("d").cast(decisions.schema["decision_id"].dataType)).drop("d")
    for found in (actor, place, everywhere, news, top):
        found = found.drop(*[n for n in decisions.columns if n != "decision_id"]).withColumnRenamed("decision_id", "__d")
        rows = rows.join(found, c("decision_id").eqNullSafe(c("__d")), "left").drop("__d")
    return rows


def _common(looks: DataFrame, tables: Tables, families: DataFrame) -> DataFrame:
    """looks with what all conditions have in common."""
    c, one = F.col, F.lit(1)
    everywhere = lambda df: df.withColumn("__all", F.lit(0))
    by_source = _with_next(tables.articles.select("source", c("seen_at").cast("double").alias("seen_at")).distinct(), ["source"], "seen_at")
    sources = _deltas(by_source, "seen_at", F.least(c("next"), c("seen_at") + DAY), {"n": one}, [])
    lag = c("seen_at") - c("published_at")
    event = (c("label") == "event").cast("int")
    modes = read_surfaces(tables.modes, ["condition"], ["condition", "end"], [Probe("own", c("end"))], [Surface("was", tables.modes.select("condition", c("end").alias("e"), "label"), "e", last=("label",))])
    before = c("was_own.last.label")
    modes = modes.select("end", (event - F.coalesce((before == "event").cast("int"), F.lit(0))).alias("event"), before.isNull().cast("int").alias("known"))
    surfaces = [
        Surface("article", everywhere(tables.articles), "seen_at", sums={"n": one, "lags": F.when(lag.isNotNull(), one).otherwise(F.lit(0)), "lag": exact(lag)}, probes=("now", "day")),
        Surface("source", everywhere(sources), "__at", sums={"n": c("n")}, probes=("now",)),
        Surface("claim", everywhere(tables.claims), "seen_at", sums={"n": one}, probes=("with", "daywith")),
        Surface("family", everywhere(families), "e", sums={"n": one}, probes=("with", "daywith")),
        Surface("modes", everywhere(modes), "end", sums={"event": c("event"), "known": c("known")}, probes=("with",)),
    ]
    probes = [Probe("now", c("t")), Probe("with", c("t"), strict=False), Probe("day", c("t") - DAY), Probe("daywith", c("t") - DAY, strict=False)]
    return read_surfaces(everywhere(looks), ["__all"], ["decision_id"], probes, surfaces, slice_seconds=HOUR).drop("__all")


def future_information(rows: DataFrame) -> Column:
    """Whether a context row holds anything from its own time or later; what is read with t itself may be as late as t."""
    times = [(f"{n}_{p}", p) for n, p in (x.rsplit("_", 1) for x in rows.columns if x.rsplit("_", 1)[-1] in ("now", "with"))]
    fields = {f.name: {g.name for g in f.dataType.fields} for f in rows.schema.fields if f.dataType.typeName() == "struct"}
    late = [F.coalesce(F.col(f"{n}.last.__at") >= F.col("t") if p == "now" else F.col(f"{n}.last.__at") > F.col("t"), F.lit(False)) for n, p in times if "last" in fields.get(n, ())]
    out = F.coalesce(F.col("top.at") >= F.col("t"), F.lit(False))
    for x in late:
        out = out | x
    return out


def compute_features(rows: DataFrame) -> DataFrame:
    """decision_id, wallet, condition, t and the features of contexts(). What is missing is said so and filled neutrally."""
    c, lit = F.col, F.lit
    zero = lambda x: F.coalesce(x.cast("double"), lit(0.0))
    flag = lambda x: x.cast("double")
    mean = lambda *xs: F.coalesce(sum((zero(x) for x in xs), lit(0.0)) / F.nullif(sum((flag(x.isNotNull()) for x in xs), lit(0.0)), lit(0.0)), lit(0.0))
    state = {}
    for s, p in (("book", "mid"), ("trade", "price")):
        n, total, squares = (span(s, x, "now", "day").cast("double") for x in ("n", "p", "pp"))
        first, short = c(f"{s}_day.ahead.{p}"), span(s, "n", "now", "hour")
        state[s] = F.struct(n.alias("n"), c(f"{s}_now.last.{p}").alias("last"), F.when(short >= 2, c(f"{s}_now.last.{p}") - c(f"{s}_hour.ahead.{p}")).alias("short"), F.when(n >= 2, c(f"{s}_now.last.{p}") - first).alias("long"), F.when(n >= 2, F.sqrt(F.greatest(n * squares - total * total, lit(0.0))) / n).alias("vol"))
    rows = rows.withColumns({"__books": state["book"], "__trades": state["trade"]})
    use = F.when(c("__books.n") > 0, c("__books")).when(c("__trades.n") > 0, c("__trades"))
    rows = rows.withColumns({"__m": use, "__directed": c("leg_now.directed"), "__since": c("t") - c("leg_now.last.ts"), "__yes": F.when(c("held_now.knows_yes") > 0, zero(c("held_now.yes"))).otherwise(0.0), "__no": F.when(c("held_now.knows_no") > 0, zero(c("held_now.no"))).otherwise(0.0)})
    recent = c("recent_now.families") > 0
    of_recent = lambda x: F.when(recent, x.cast("double")).otherwise(0.0)
    articles, lags = span("article", "n", "now", "day"), span("article", "lags", "now", "day")
    spreads = [c("yes_now.last.spread"), c("no_now.last.spread")]
    missing = flag(F.coalesce(c("families"), lit(0)) <= 0)
    latest, close = c("screen_now.latest"), c("close_with.last")
    response = F.when(latest["pre_at"].isNotNull() & (close["__at"] > latest["pre_at"]), close["close"] - latest["pre"])
    f = {
        "base_market_age": zero(F.greatest(c("t") - c("contract_now.last.effective_from"), lit(0.0))), "base_time_to_resolution": zero(F.when(c("contract_now.last.resolution_time").isNotNull(), F.greatest(c("contract_now.last.resolution_time") - c("t"), lit(0.0)))),
        "base_actor_positive_rate": F.when(c("__directed") > 0, c("leg_now.positive") / c("__directed")).otherwise(0.5), "base_actor_positive_rate_missing": flag(F.coalesce(c("__directed"), lit(0)) == 0),
        "mkt_last_price": F.coalesce(c("__m.last"), lit(0.5)), "mkt_last_price_missing": flag(c("__m").isNull()), "mkt_return_short": zero(c("__m.short")), "mkt_return_long": zero(c("__m.long")), "mkt_volatility": zero(c("__m.vol")),
        "mkt_state_from_executions": flag((c("__books.n") == 0) & (c("__trades.n") > 0)), "mkt_volume": zero(span("trade", "size", "now", "day")), "mkt_spread": mean(*spreads), "mkt_spread_missing": flag(F.coalesce(*spreads).isNull()),
        "mkt_depth": mean(c("yes_now.last.depth"), c("no_now.last.depth")), "mkt_imbalance": mean(c("yes_now.last.imbalance"), c("no_now.last.imbalance")), "mkt_execution_rate": zero(span("trade", "rows", "now", "day")),
        "act_recent_trade_count": zero(span("leg", "n", "now", "day")), "act_recent_gross_volume": zero(span("leg", "size", "now", "day")), "act_recent_net_prop_change": zero(span("leg", "net", "now", "day")), "act_time_since_last_trade": F.coalesce(c("__since"), lit(DAY)), "act_time_since_last_trade_missing": flag(c("__since").isNull()),
        "act_category_trade_count": zero(c("held_now.n")), "pos_positive_tokens": c("__yes"), "pos_negative_tokens": c("__no"), "pos_net_proposition": c("__yes") - c("__no"), "pos_gross_exposure": F.abs("__yes") + F.abs("__no"), "pos_distance_from_neutral": F.abs(c("__yes") - c("__no")),
        "pos_history_incomplete": flag(F.coalesce(c("held_now.unresolved"), lit(0)) > 0), "pos_unresolved_event_count": zero(c("held_now.unresolved")),
        "news_rel_max": of_recent(c("top.rel_score")), "news_rel_sum": of_recent(c("recent_now.rel_sum")), "news_direction": of_recent(c("top.direction")), "news_novelty_max": of_recent(c("novelty_max")), "news_surprise_max": of_recent(c("surprise_max")), "news_age_hours": of_recent((c("t") - c("top.at")) / HOUR),
        "news_source_diversity": zero(c("source_now.n")), "news_confirmation_count": of_recent(c("recent_now.confirmed")), "news_contradiction_count": of_recent(c("recent_now.contradicted")), "news_article_count": zero(articles), "news_ingestion_lag": F.when(lags > 0, span("article", "lag", "now", "day").cast("double") / lags).otherwise(0.0),
        "news_missing": missing, "news_recent_missing": flag(~F.coalesce(recent, lit(False))), "news_decay_missing": missing, **{n: zero(c(n)) for n in _DECAYS},
        "liq_mode_event": flag(F.coalesce(c("mode_with.last.label") == "event", lit(False))), "liq_mode_missing": flag(c("mode_with.last").isNull()), "liq_mode_age_hours": zero((c("t") - c("mode_with.last.__at")) / HOUR),
        "event_mode_prevalence": F.when(c("modes_with.known") > 0, c("modes_with.event") / c("modes_with.known")).otherwise(0.0), "event_mode_prevalence_missing": flag(F.coalesce(c("modes_with.known"), lit(0)) == 0),
        "impact_screen_available": flag(F.coalesce(c("screen_now.evaluated"), lit(0)) > 0), "impactful_news_count": zero(c("screen_now.impactful")), "impactful_news_probability": zero(c("screen_now.score")), "impact_screen_contradiction": flag(F.coalesce((c("screen_now.evaluated") > 0) & (c("screen_now.impactful") == 0), lit(False))),
        "initial_response_so_far": zero(response), "initial_response_missing": flag(response.isNull()), "attention_claim_load": F.log1p(zero(span("claim", "n", "with", "daywith"))), "attention_unrelated_load": F.log1p(F.greatest(zero(span("family", "n", "with", "daywith")) - zero(c("own_with.n")), lit(0.0))),
    }
    return rows.select("decision_id", "wallet", "condition", "t", *[f[n].alias(n) for n in FEATURES])
