"""News: claims, judgments by contract version, work queues, targets, arrivals and attention."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions import exprs as X
from hindcast.operators.asof import SLICE, _named, _same, asof_join

DAY = 86_400.0
#: The least length of a body worth a model, the least score that makes an article worth it, and the most claims of one.
BODY_CHARS, QUEUE_SCORE, MAX_CLAIMS = 400, 0.03, 12
#: Texts whose claims a worker holds at a time.
TEXTS = 256
#: Claims that share more words with a question than this share of it, by class.
RELEVANT = ("direct", "indirect")


def score_pairs(claims: DataFrame, contracts: DataFrame) -> DataFrame:
    """article, market, version_seq, shared and rel_score of the pairs that share a word, under each version of a contract.

    claims: article, words; contracts: market, version_seq, question_words. Pairs meet at their shared words, so those without
    any, which would score 0, are never made.
    """
    c = claims.select("article", F.explode("words").alias("word"))
    q = contracts.select("market", "version_seq", F.size("question_words").alias("nq"), F.explode("question_words").alias("word"))
    hit = c.join(q, "word").groupBy("article", "market", "version_seq").agg(F.count("*").alias("shared"), F.first("nq").alias("nq"))
    return hit.select("article", "market", "version_seq", "shared", F.round(F.col("shared") / F.col("nq"), 6).alias("rel_score"))


def judge(claims: DataFrame, contracts: DataFrame, method: str) -> DataFrame:
    """Judgments of claims (article, seen_at, family, words) against the contract version in force when each was seen (the
    latest first observed at or before), with a deterministic id. computed_at is a second after the text."""
    scored = score_pairs(claims, contracts).join(claims.select("article", "seen_at", "family", X.direction_of(F.col("words")).alias("direction")), "article")
    scored = scored.join(contracts.select("market", "version_seq", "first_observed_at", F.lead("first_observed_at").over(Window.partitionBy("market").orderBy("version_seq")).alias("until")), ["market", "version_seq"])
    inforce = scored.where((F.col("first_observed_at") <= F.col("seen_at")) & (F.col("until").isNull() | (F.col("until") > F.col("seen_at"))))
    ident = X.namespace_id("judgment", F.col("article"), F.col("market"), F.col("version_seq"), F.lit(method))
    return inforce.select(ident.alias("judgment_id"), "article", "market", "version_seq", "family", "seen_at", (F.col("seen_at") + 1).alias("computed_at"), "rel_score", X.relevance_class(F.col("rel_score")).alias("rel_class"), "direction", F.lit(method).alias("method"))


def rescore(claims: DataFrame, contracts: DataFrame, existing: DataFrame, method: str, now: float) -> DataFrame:
    """The judgments under another method that aren't there yet, scored now about what was known when they are dated."""
    return judge(claims, contracts, method).withColumn("scored_at", F.lit(float(now))).join(existing.select("judgment_id"), "judgment_id", "left_anti")


def newest_contracts(markets: DataFrame, contracts: DataFrame) -> DataFrame:
    """Every market with the newest version of its contract, or nulls."""
    last = contracts.groupBy("market").agg(F.max_by(F.struct("version_seq", "question"), "version_seq").alias("c"))
    return markets.join(last, "market", "left").select(*markets.columns, "c.version_seq", F.col("c.question").alias("contract_question"))


def snapshot_asof(decisions: DataFrame, judgments: DataFrame, contracts: DataFrame, method: str | None = None, online: bool = False) -> DataFrame:
    """Of each decision (decision_id, market, t) and family the latest judgment computed strictly before it under the contract
    version known then; ties of time stay. A decision without any gets those of all versions, flagged fallback.

    online: a judgment counts only if it had been scored by then (scored_at null, or before t). Decisions meet families, not
    judgments: the latest time comes from an as-of read, and only judgments of that time are joined.
    """
    j = judgments.where(F.col("method") == method) if method else judgments
    known = F.greatest("computed_at", "scored_at") if online else F.col("computed_at")
    j = j.withColumn("known_at", known)
    d = asof_join(decisions, contracts.withColumnRenamed("version_seq", "now_version"), ["market"], "t", "first_observed_at", ["now_version"], order=["now_version"])

    def latest(d: DataFrame, j: DataFrame, keys: list[str]) -> DataFrame:
        pairs = d.join(j.groupBy(*keys, "family").agg(F.min("known_at").alias("first")), keys).where("first < t").drop("first")
        # What became known late may be dated earlier: the greatest date among the known.
        best = j.groupBy(*keys, "family", "known_at").agg(F.max("computed_at").alias("dated"))
        run = Window.partitionBy(*keys, "family").orderBy("known_at").rowsBetween(Window.unboundedPreceding, 0)
        at = asof_join(pairs, best.withColumn("at", F.max("dated").over(run)), [*keys, "family"], "t", "known_at", ["at"], order=["at"])
        same = j.select(*[F.col(k).alias(f"j_{k}") for k in keys], F.col("family").alias("j_family"), "computed_at", "known_at", "article", "rel_score", "rel_class", "direction", F.col("version_seq").alias("used_version"))
        on = (F.col("family") == F.col("j_family")) & (F.col("at") == F.col("computed_at")) & (F.col("known_at") < F.col("t"))
        for k in keys:
            on = on & (F.col(k) == F.col(f"j_{k}"))
        return at.join(same, on).select("decision_id", "t", "family", "article", "computed_at", "rel_score", "rel_class", "direction", "used_version")

    own = latest(d.withColumnRenamed("now_version", "version"), j.withColumn("version", F.col("version_seq")), ["market", "version"]).withColumn("fallback", F.lit(False))
    lost = d.join(own.select("decision_id").distinct(), "decision_id", "left_anti").drop("now_version")
    return own.unionByName(latest(lost, j, ["market"]).withColumn("fallback", F.lit(True)))


def work_queue(articles: DataFrame, done: DataFrame, judgments: DataFrame, most: int) -> DataFrame:
    """The newest articles that a model has still to read, at most so many: long enough, not done in this version, and with a
    judgment that makes them worth it."""
    worth = judgments.where((F.col("rel_score") >= QUEUE_SCORE) | F.col("rel_class").isin(*RELEVANT)).select("article").distinct()
    left = articles.where(F.length("text") >= BODY_CHARS).join(done.select("article"), "article", "left_anti").join(worth, "article", "left_semi")
    return left.orderBy(F.desc("seen_at"), "article").limit(most)


def deferred(todo: DataFrame, done: DataFrame, key: str, most: int) -> DataFrame:
    """todo that isn't done, with now: whether it is among the first so many, or waits for a later run. The first are taken
    by a limit, so the rest is never sorted in one place."""
    left = todo.join(done.select(key), key, "left_anti")
    first = left.select(key).orderBy(key).limit(most).withColumn("now", F.lit(True))
    return left.join(first, key, "left").withColumn("now", F.coalesce("now", F.lit(False)))


def modelled(model: Callable[[str], list[dict]], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """article, claim and confidence of what the model finds; a worker holds the claims of TEXTS texts at a time, not of a batch."""
    for whole in batches:
        for i in range(0, len(whole), TEXTS):
            b = whole.iloc[i : i + TEXTS]
            out = [(a, str(c.get("claim", "")).strip(), float(c.get("confidence", 0.5))) for a, t in zip(b["article"], b["text"].fillna(""), strict=True) for c in model(t)]
            yield pd.DataFrame(out, columns=["article", "claim", "confidence"])


def extract_with(model: Callable[[str], list[dict]], rows: DataFrame, version: str) -> DataFrame:
    """Claims of rows (article, text) by a model, a function from a text to dicts of claim and confidence, in Arrow batches.

    Confidences are held to [0, 1]; of equal claims of an article the surest stays, and at most MAX_CLAIMS of each article.
    """

    made = rows.select("article", "text").mapInPandas(partial(modelled, model), "article long, claim string, confidence double").where("claim != ''")
    best = made.groupBy("article", "claim").agg(F.max(X.clamp("confidence", 0.0, 1.0)).alias("confidence"))
    w = Window.partitionBy("article").orderBy(F.desc("confidence"), "claim")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= MAX_CLAIMS).drop("place").withColumn("extractor_version", F.lit(version))


def targets(claims: DataFrame, judgments: DataFrame) -> DataFrame:
    """article, market: the markets that any claim of the article's family was judged against."""
    return claims.select("article", "family").join(judgments.select("family", "market").distinct(), "family").select("article", "market").distinct()


def qualified(judgments: DataFrame, contracts: DataFrame, least: float) -> DataFrame:
    """The latest judgment of each (article, market), the greatest id of equal times, if its class or score qualifies and its version is
    the one in effect when the claim arrived."""
    last = judgments.groupBy("article", "market").agg(F.max_by(F.struct("judgment_id", "version_seq", "seen_at", "family", "rel_score", "rel_class"), F.struct("computed_at", "judgment_id")).alias("j")).select("article", "market", "j.*")
    good = last.where(F.col("rel_class").isin(*RELEVANT) & (F.col("rel_score") >= least))
    at = asof_join(good, contracts.select("market", "effective_from", F.col("version_seq").alias("active")), ["market"], "seen_at", "effective_from", ["active"], strict=False, order=["active"])
    return at.where(F.col("active") == F.col("version_seq"))


def covering(at: DataFrame, time: str, spans: DataFrame, by: list[str], name: str) -> DataFrame:
    """at with the number of spans (start, end; half-open) of the same keys that its time lies in.

    Starts count up and ends count down; the running count, carried over slices of time, is read as of each time.
    """
    keys = [f"k{i}" for i in range(len(by))] or ["k0"]
    keyed = [F.col(k).alias(n) for k, n in zip(by, keys, strict=True)] if by else [F.lit(0).alias("k0")]
    moves = spans.select(*keyed, F.col("start").alias("t"), F.lit(1).alias("d")).union(spans.select(*keyed, F.col("end").alias("t"), F.lit(-1).alias("d"))).groupBy(*keys, "t").agg(F.sum("d").alias("d")).withColumn("slice", F.floor(F.col("t") / SLICE))
    carry = moves.groupBy(*keys, "slice").agg(F.sum("d").alias("d")).withColumn("before", F.coalesce(F.sum("d").over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = F.sum("d").over(Window.partitionBy(*keys, "slice").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    counts = moves.join(_named(carry, [*keys, "slice"], ["before"]), _same([*keys, "slice"])).select(*keys, F.col("t").alias("__at"), (run + F.col("before")).alias("__n"))
    left = at.select("*", *keyed)
    return asof_join(left, counts, keys, time, "__at", ["__n"], strict=False, order=["__n"]).select(*at.columns, F.coalesce("__n", F.lit(0)).alias(name))


def family_spans(events: DataFrame, by: list[str], seconds: float = DAY) -> DataFrame:
    """For events (by, family, at) the half-open spans in which a family counts as present: from each event until the next one
    of the family, but no longer than the trailing window, which takes in both its ends."""
    each = events.select(*by, "family", "at").distinct()
    following = F.lead("at").over(Window.partitionBy(*by, "family").orderBy("at"))
    return each.select(*by, F.col("at").alias("start"), F.least(F.coalesce(following, F.lit(1e18)), F.col("at") + seconds + 1e-6).alias("end"))


def attention_loads(at: DataFrame, time: str, claims: DataFrame, own: DataFrame) -> DataFrame:
    """at (market, time) with n_claims and n_families in the trailing day, t included, n_own (families judged to bear on the market),
    and the loads: log1p of the claims and of the families that aren't the market's own."""
    spans = claims.select(F.col("seen_at").alias("start"), (F.col("seen_at") + DAY + 1e-6).alias("end"))
    rows = covering(at, time, spans, [], "n_claims")
    rows = covering(rows, time, family_spans(claims.select("family", F.col("seen_at").alias("at")), []), [], "n_families")
    rows = covering(rows, time, family_spans(own.select("market", "family", "at"), ["market"]), ["market"], "n_own")
    return rows.withColumns({"claim_load": F.log1p("n_claims"), "unrelated_load": F.log1p(F.col("n_families") - F.col("n_own"))})


def screens_asof(at: DataFrame, screens: DataFrame) -> DataFrame:
    """at (condition, t) with what impact screens (condition, available_at, status, transition) were known strictly before t: n_evaluated,
    n_impactful."""
    flags = screens.where("status = 'screened'").select("condition", F.col("available_at").alias("start"), F.lit(1e18).alias("end"), "transition")
    # Strictly before: the count as of just before t.
    rows = covering(at.withColumn("__t", F.col("t") - 1e-6), "__t", flags, ["condition"], "n_evaluated")
    return covering(rows, "__t", flags.where("transition = 1"), ["condition"], "n_impactful").drop("__t")


def initial_response(at: DataFrame, closes: DataFrame, news_time: str) -> DataFrame:
    """at (condition, t, news_time) with response: the close known at t less that at the news; null if either is missing or both are one."""
    rows = asof_join(at, closes, ["condition"], "t", "bar_end", ["bar_end", "close"], strict=False).withColumnsRenamed({"bar_end": "__e1", "close": "__c1"})
    rows = rows.withColumn("__n", F.coalesce(F.col(news_time), F.lit(-1e12)))  # rows without news stay
    rows = asof_join(rows, closes, ["condition"], "__n", "bar_end", ["bar_end", "close"], strict=False)
    moved: Column = F.when(F.col("__e1") > F.col("bar_end"), F.col("__c1") - F.col("close"))
    return rows.withColumn("response", moved).drop("__e1", "__c1", "bar_end", "close", "__n")
