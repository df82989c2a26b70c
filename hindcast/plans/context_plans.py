"""The contexts of decisions and all their features, over one world of conditions, wallets and news."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions import exprs as X
from hindcast.operators import attribution as AT
from hindcast.operators import bars as B
from hindcast.operators import features as FE
from hindcast.operators import regime as R
from hindcast.operators.lineage import stored
from hindcast.plans import regime_plans, study
from hindcast.plans.decision_plans import _TOK, moments
from hindcast.plans.study import rounded
from hindcast.sources import adapters as A
from hindcast.sources.adapters import BAR, DAY, table

CONDITIONS = ("click", "error", "purchase", "signup", "view")


def decisions(spark, sf_dir):
    """A decision at each purchase, by its user."""
    users = table(spark, sf_dir, "events").select(F.col("event_id").alias("e"), F.col("user_id").alias("wallet"))
    return moments(spark, sf_dir).join(users, F.col("decision") == F.col("e")).select(F.col("decision").alias("decision_id"), "wallet", "condition", "t")


def legs(spark, sf_dir):
    """Every event as a trade of its user: token, side and whether it is mapped and resolved follow from its number."""
    i = F.col("event_id")
    token = F.when(i % 2 == 0, 1).otherwise(-1)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("wallet"), F.col("event_type").alias("condition"), X.epoch("ts").alias("ts"), i.alias("leg_id"), F.when(i % 4 < 2, "BUY").otherwise("SELL").alias("side"), F.round("value", 2).alias("size"), F.when(i % 11 != 0, token).alias("sign"), token.alias("token"), (i % 97 != 0).alias("resolved"))


def judgments(spark, sf_dir):
    """The relevance of each claim to each question of a condition with which it shares a word; questions are dealt to conditions by number."""
    c = A.claims(spark, sf_dir).where("size(words) > 0").select("article", "seen_at", "family", F.explode("words").alias("word"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("market"), X.tokens("text").alias("qw")).withColumn("word", F.explode("qw")).withColumn("nq", F.size("qw"))
    hit = c.join(q, "word").groupBy("article", "market").agg(F.count("*").alias("shared"), F.first("nq").alias("nq"), F.first("seen_at").alias("at"), F.first("family").alias("family"))
    score, n = F.round(F.col("shared") / F.col("nq"), 6), F.col("article")
    condition = F.element_at(F.array(*map(F.lit, CONDITIONS)), (F.col("market") % 5 + 1).cast("int"))
    return hit.select(condition.alias("condition"), "family", "at", "article", score.alias("rel_score"), X.relevance_class(score).alias("rel_class"), F.when((n + F.col("market")) % 3 == 0, -1).otherwise(1).alias("direction"), (F.lit(1.0) - n % 4 / F.lit(5.0)).alias("novelty"), (n % 5 / F.lit(10.0)).alias("surprise"), F.lit(0.9).alias("confidence"))


def tables(spark, sf_dir):
    books = A.books(spark, sf_dir).withColumn("token", F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1))
    articles = A.articles(spark, sf_dir)
    bars = stored(study.bars(spark, sf_dir), "bars")
    raw = R.raw_variables(bars)
    vectors = stored(R.stationarize(raw, stored(R.reference_stats(raw), "reference")), "vectors")
    online = R.online_costs(B.segments(vectors, BAR), regime_plans.CENTROIDS, regime_plans.PENALTY)
    labels = stored(online.select("condition", "bin_start", F.when(F.col("mode_online") == 0, "calm").otherwise("event").alias("label")), "labels")
    arrivals = stored(study.arrivals(spark, sf_dir), "arrivals")
    screens = R.screen_impact(arrivals, labels, BAR, A.START + 2 * DAY).join(arrivals.select("article", "ts"), "article")
    return FE.Tables(
        contracts=A.contracts(spark, sf_dir), statuses=A.statuses(spark, sf_dir), books=books, executions=A.fills(spark, sf_dir).withColumnRenamed("notional", "size"), legs=legs(spark, sf_dir), judgments=judgments(spark, sf_dir),
        articles=articles.select("article", "seen_at", F.when(F.col("article") % 10 != 0, F.col("seen_at") - F.col("article") % 7 * 600).alias("published_at"), "source"), claims=A.claims(spark, sf_dir).select("article", "seen_at", "family"),
        modes=labels.select("condition", (F.col("bin_start") + BAR).alias("end"), "label"), screens=screens, closes=bars.where("complete").select("condition", (F.col("bin_start") + BAR).alias("bar_end"), "close"),
    )


def features_all(spark, sf_dir):
    """The 68 features of every decision; six digits, but four of the volatility, which is a root of a difference of sums."""
    made = FE.compute_features(FE.contexts(decisions(spark, sf_dir), tables(spark, sf_dir)))
    return rounded(made.withColumn("mkt_volatility", F.round("mkt_volatility", 4)), 6)


def decision_context(spark, sf_dir):
    """What every decision knew of its market: contract, status, books, last state, position, and that nothing of it is from later."""
    rows = FE.contexts(decisions(spark, sf_dir), tables(spark, sf_dir))
    c = F.col
    return rounded(rows.select("decision_id", c("contract_now.last.effective_from").alias("contract_from"), c("status_now.last.blocking").alias("blocking"), c("yes_now.last.__at").alias("yes_book_at"), c("no_now.last.__at").alias("no_book_at"), c("book_now.last.mid").alias("mid"), c("leg_now.n").cast("long").alias("legs_before"), c("held_now.n").cast("long").alias("legs_here"), c("screen_now.evaluated").cast("long").alias("screens"), c("mode_with.last.label").alias("mode"), c("top.article").alias("top_article"), FE.future_information(rows).alias("future_information")), 6)


def labelled(spark, sf_dir):
    """All features with a direction: a purchase worth more than 25 is one up."""
    made = FE.compute_features(FE.contexts(decisions(spark, sf_dir), tables(spark, sf_dir)))
    up = table(spark, sf_dir, "events").select(F.col("event_id").alias("e"), F.when(F.col("value") > 25, 1).otherwise(-1).alias("label"))
    return made.join(up, F.col("decision_id") == F.col("e")).drop("e")


def nested_evaluation(spark, sf_dir):
    """Scores of models of base, actor, market and position, and news features on expanding folds with a day of embargo."""
    made = stored(AT.nested_predictions(labelled(spark, sf_dir), "label", "t", "decision_id", embargo=DAY), "predictions")
    return rounded(AT.nested_metrics(made, "label"), 6)


def driver_attribution(spark, sf_dir):
    """The channel that each decision's direction is attributed to, over all features."""
    rows = labelled(spark, sf_dir)
    evidence = F.col("news_decay_missing") == 0
    out = AT.attribute(rows, "label", "t", "decision_id", coverage=F.col("pos_history_incomplete") == 0, evidence=evidence, embargo=DAY)
    return rounded(out.select("decision_id", "label", "fold", "n_train", "status", "primary", "leads", "top_delta", "margin", "stability", "fold_mean", "null_top", "confidence", "observed_p"), 6)


_FIVE = "(['click', 'error', 'purchase', 'signup', 'view'])"
_HALF = FE.HALF_LIVES
_SQL = f"""{{start}}, dec AS MATERIALIZED (SELECT event_id AS decision_id, user_id AS wallet, {_FIVE}[user_id % 5 + 1] AS condition, floor(epoch_us(ts)/1e6) AS t FROM events WHERE event_type = 'purchase'),
leg AS MATERIALIZED (SELECT user_id AS wallet, event_type AS condition, epoch_us(ts)/1e6 AS ts, event_id AS leg_id, round(value, 2) * CASE WHEN event_id % 4 < 2 THEN 1 ELSE -1 END AS tokens, round(value, 2) AS size, CASE WHEN event_id % 11 != 0 THEN token END AS sign, token, event_id % 97 != 0 AS resolved FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS token FROM events)),
bq AS (SELECT item_id AS market, {_TOK} AS qw FROM benchmark), cw AS (SELECT article, seen_at, family, unnest(words) AS w FROM claims), qq AS (SELECT market, len(qw) AS nq, unnest(qw) AS w FROM bq),
jud AS MATERIALIZED (SELECT {_FIVE}[market % 5 + 1] AS condition, article, seen_at AS began, family, rel, CASE WHEN (article + market) % 3 = 0 THEN -1 ELSE 1 END AS dir, 1.0::DOUBLE - article % 4 / 5.0::DOUBLE AS nov, article % 5 / 10.0::DOUBLE AS sur FROM (SELECT article, market, min(seen_at) AS seen_at, min(family) AS family, round(count(*) / min(nq), 6) AS rel FROM cw JOIN qq USING (w) GROUP BY article, market)),
ver AS MATERIALIZED (SELECT *, lead(began) OVER (PARTITION BY condition, family ORDER BY began) AS next FROM (SELECT condition, family, began, count(*) AS n, sum(rel) AS rel, max(greatest(0, least(rel, 1) * dir * nov * 0.9::DOUBLE)) AS pos, max(greatest(0, -least(rel, 1) * dir * nov * 0.9::DOUBLE)) AS neg, max(struct_pack(rel := rel, article := article, dir := dir)) AS top, max(nov) AS nov, max(sur) AS sur, bool_or(dir > 0) AND bool_or(dir < 0) AS both_ways FROM jud GROUP BY ALL)),
act AS MATERIALIZED (SELECT decision_id, t, v.* FROM dec JOIN ver v ON v.condition = dec.condition AND began < t AND (next IS NULL OR next >= t) AND t - began <= {FE.MAX_AGE}),
fam AS (SELECT decision_id, count(*) AS families, {', '.join(f'sum(pos * pow(2, -(t - began) / {h})) AS p{k}, sum(neg * pow(2, -(t - began) / {h})) AS n{k}' for k, h in _HALF.items())} FROM act GROUP BY decision_id),
rec AS (SELECT decision_id, t, max(top.rel) AS rel_max, sum(rel) AS rel_sum, max(struct_pack(rel := top.rel, moment := began, article := top.article, dir := top.dir)) AS top, max(nov) AS nov, max(sur) AS sur, sum(n - 1) AS confirmed, count_if(both_ways) AS contradicted FROM act WHERE began >= t - {DAY} GROUP BY decision_id, t),
bk AS (SELECT *, round(mid, 9) AS r FROM books), ex AS (SELECT *, round(price, 9) AS r FROM fills),
ser AS (SELECT decision_id, t, 0 AS source, ts, event_id, r, mid AS price FROM dec JOIN bk ON bk.condition = dec.condition AND ts < t AND ts >= t - {DAY} UNION ALL SELECT decision_id, t, 1, ts, event_id, r, price FROM dec JOIN ex ON ex.condition = dec.condition AND ts < t AND ts >= t - {DAY}),
stt AS (SELECT decision_id, source, arg_max(price, (ts, event_id)) AS last, arg_min(price, (ts, event_id)) AS first, count(*) AS n, stddev_pop(r) AS vol, arg_min(price, (ts, event_id)) FILTER (ts >= t - 3600) AS s1, count(*) FILTER (ts >= t - 3600) AS sn FROM ser GROUP BY decision_id, source QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY source) = 1),
exe AS (SELECT decision_id, sum(notional) AS size, count(*) AS n FROM dec JOIN fills ON fills.condition = dec.condition AND ts < t AND ts >= t - {DAY} GROUP BY decision_id),
bt AS (SELECT decision_id, event_id % 2 AS token, max(struct_pack(ts := b.ts, event_id := event_id, spread := spread, depth := depth, imbalance := imbalance, mid := mid)) AS b FROM dec JOIN books b ON b.condition = dec.condition AND b.ts < t GROUP BY ALL), bo AS (SELECT decision_id, avg(b.spread) AS spread, avg(b.depth) AS depth, avg(b.imbalance) AS imbalance, max(b).mid AS mid, max(b.ts) FILTER (token = 0) AS yes_at, max(b.ts) FILTER (token = 1) AS no_at FROM bt GROUP BY decision_id),
ac AS (SELECT decision_id, count(*) AS n, count(*) FILTER (ts >= t - {DAY}) AS recent, sum(size) FILTER (ts >= t - {DAY}) AS gross, sum(tokens * sign) FILTER (ts >= t - {DAY}) AS net, max(ts) AS last, count(sign) AS directed, count(*) FILTER (tokens * sign > 0) AS up,
    count(*) FILTER (leg.condition = dec.condition) AS here, count(*) FILTER (leg.condition = dec.condition AND NOT resolved) AS unresolved, sum(tokens) FILTER (leg.condition = dec.condition AND resolved AND token = 1) AS yes, sum(tokens) FILTER (leg.condition = dec.condition AND resolved AND token = -1) AS no,
    count(*) FILTER (leg.condition = dec.condition AND sign = 1) AS knows_yes, count(*) FILTER (leg.condition = dec.condition AND sign = -1) AS knows_no FROM dec JOIN leg ON leg.wallet = dec.wallet AND ts < t GROUP BY decision_id),
co AS (SELECT decision_id, arg_max(effective_from, effective_from) AS since, arg_max(struct_pack(r := resolution_time), effective_from).r AS until FROM dec JOIN contracts c ON c.condition = dec.condition AND effective_from < t GROUP BY decision_id), sta AS (SELECT decision_id, arg_max(blocking, effective_from) AS blocking FROM dec JOIN statuses s ON s.condition = dec.condition AND effective_from < t GROUP BY decision_id),
mo AS (SELECT decision_id, dec.condition = o.condition AS own, o.condition AS c, t, arg_max(label, bin_start) AS label, max(bin_start) + {BAR} AS e FROM dec JOIN onl o ON bin_start + {BAR} <= t GROUP BY ALL), pv AS (SELECT decision_id, avg((label = 'event')::INT) AS prevalence, any_value(label) FILTER (own) AS label, any_value(t - e) FILTER (own) AS age FROM mo GROUP BY decision_id),
scr AS MATERIALIZED (SELECT s.*, (SELECT max(struct_pack(e := bar_end, c := close)) FROM closes c WHERE c.condition = s.condition AND bar_end <= s.ts) AS base FROM (SELECT i.*, arr.ts FROM ({{screens}}) i JOIN arr USING (article)) s WHERE status = 'screened'),
sc AS (SELECT decision_id, count(*) AS evaluated, count_if(transition = 1) AS impactful, max(struct_pack(ts := ts, e := base.e, c := base.c)) FILTER (transition = 1) AS latest FROM dec JOIN scr ON scr.condition = dec.condition AND available_at < t GROUP BY decision_id),
cl AS (SELECT decision_id, max(struct_pack(e := bar_end, c := close)) AS now FROM dec JOIN closes c ON c.condition = dec.condition AND bar_end <= t GROUP BY decision_id),
ar AS (SELECT decision_id, count(*) AS n, count(DISTINCT source) AS sources, avg(CASE WHEN article % 10 != 0 THEN article % 7 * 600 END) AS lag FROM dec JOIN articles ON seen_at < t AND seen_at >= t - {DAY} GROUP BY decision_id),
att AS (SELECT decision_id, count(*) AS n FROM dec JOIN claims ON seen_at <= t AND seen_at > t - {DAY} GROUP BY decision_id), fe AS MATERIALIZED (SELECT family, min(seen_at) AS e FROM claims GROUP BY family), ow AS MATERIALIZED (SELECT condition, family, min(began) AS o FROM jud GROUP BY ALL),
un AS (SELECT decision_id, count(*) AS n FROM dec JOIN fe ON e <= t AND e > t - {DAY} LEFT JOIN ow ON ow.family = fe.family AND ow.condition = dec.condition AND o <= t WHERE o IS NULL GROUP BY decision_id)"""
_START = ", ".join([regime_plans._O, *(A.DUCK[n] for n in ("contracts", "statuses", "claims"))])
_STEPS, _, _SCREENS = regime_plans.ORACLE["impact_screens"].removeprefix(regime_plans._O).rpartition("SELECT article, condition, pre")
_Z = lambda x: f"coalesce({x}, 0) + 0.0::DOUBLE"
_VALUES = {
    "base_market_age": _Z("dec.t - since"), "base_time_to_resolution": _Z("greatest(until - dec.t, 0)"), "base_actor_positive_rate": "CASE WHEN directed > 0 THEN up / directed ELSE 0.5 END", "base_actor_positive_rate_missing": "(coalesce(directed, 0) = 0)::INT",
    "mkt_last_price": "coalesce(stt.last, 0.5)", "mkt_last_price_missing": "(stt.last IS NULL)::INT", "mkt_return_short": _Z("CASE WHEN sn >= 2 THEN stt.last - s1 END"), "mkt_return_long": _Z("CASE WHEN stt.n >= 2 THEN stt.last - first END"), "mkt_volatility": _Z("round(CASE WHEN stt.n >= 2 THEN vol END, 4)"), "mkt_state_from_executions": _Z("stt.source"),
    "mkt_volume": _Z("exe.size"), "mkt_spread": _Z("spread"), "mkt_spread_missing": "(spread IS NULL)::INT", "mkt_depth": _Z("depth"), "mkt_imbalance": _Z("imbalance"), "mkt_execution_rate": _Z("exe.n"),
    "act_recent_trade_count": _Z("recent"), "act_recent_gross_volume": _Z("gross"), "act_recent_net_prop_change": _Z("net"), "act_time_since_last_trade": f"coalesce(dec.t - ac.last, {DAY})", "act_time_since_last_trade_missing": "(ac.last IS NULL)::INT", "act_category_trade_count": _Z("here"),
    "pos_positive_tokens": _Z("y"), "pos_negative_tokens": _Z("z"), "pos_net_proposition": _Z("y - z"), "pos_gross_exposure": _Z("abs(y) + abs(z)"), "pos_distance_from_neutral": _Z("abs(y - z)"), "pos_history_incomplete": "(coalesce(unresolved, 0) > 0)::INT", "pos_unresolved_event_count": _Z("unresolved"),
    "news_rel_max": _Z("rel_max"), "news_rel_sum": _Z("rel_sum"), "news_direction": _Z("rec.top.dir"), "news_novelty_max": _Z("rec.nov"), "news_surprise_max": _Z("rec.sur"), "news_age_hours": _Z("(dec.t - rec.top.moment) / 3600"), "news_source_diversity": _Z("sources"), "news_confirmation_count": _Z("confirmed"), "news_contradiction_count": _Z("contradicted"),
    "news_article_count": _Z("ar.n"), "news_ingestion_lag": _Z("lag"), "news_missing": "(families IS NULL)::INT", "news_recent_missing": "(rec.rel_max IS NULL)::INT", "news_decay_missing": "(families IS NULL)::INT",
    **{f"news_decay_{x}_{k}": _Z({"signed": f"p{k} - n{k}", "positive": f"p{k}", "negative": f"n{k}"}[x]) for k in _HALF for x in ("signed", "positive", "negative")},
    "liq_mode_event": "coalesce(pv.label = 'event', false)::INT", "liq_mode_missing": "(pv.label IS NULL)::INT", "liq_mode_age_hours": _Z("age / 3600"), "event_mode_prevalence": _Z("prevalence"), "event_mode_prevalence_missing": "(prevalence IS NULL)::INT",
    "impact_screen_available": "(coalesce(evaluated, 0) > 0)::INT", "impactful_news_count": _Z("impactful"), "impactful_news_probability": "(coalesce(impactful, 0) > 0)::INT", "impact_screen_contradiction": "coalesce(evaluated > 0 AND impactful = 0, false)::INT",
    "initial_response_so_far": _Z("CASE WHEN cl.now.e > latest.e THEN cl.now.c - latest.c END"), "initial_response_missing": "(NOT coalesce(cl.now.e > latest.e, false))::INT", "attention_claim_load": "ln(1 + coalesce(att.n, 0))", "attention_unrelated_load": "ln(1 + coalesce(un.n, 0))",
}
_JOINED = " ".join(f"LEFT JOIN {v} USING (decision_id)" for v in ("fam", "rec", "stt", "exe", "bo", "(SELECT *, CASE WHEN knows_yes > 0 THEN coalesce(yes, 0) END AS y0, CASE WHEN knows_no > 0 THEN coalesce(no, 0) END AS z0, coalesce(y0, 0) AS y, coalesce(z0, 0) AS z FROM ac) ac", "co", "sta", "pv", "sc", "cl", "ar", "att", "un"))
_WITH = _SQL.format(start=_START + _STEPS, screens="SELECT article, condition, pre" + _SCREENS)
ORACLE = {
    "features_all": f"{_WITH} SELECT decision_id, wallet, condition, dec.t, {', '.join(f'round(CAST({x} AS DOUBLE), 6) + 0.0::DOUBLE AS {n}' for n, x in _VALUES.items())} FROM dec {_JOINED}",
    "decision_context": f"{_WITH} SELECT decision_id, round(since, 6) AS contract_from, blocking, round(yes_at, 6) AS yes_book_at, round(no_at, 6) AS no_book_at, round(mid, 6) AS mid, coalesce(ac.n, 0) AS legs_before, coalesce(here, 0) AS legs_here, coalesce(evaluated, 0) AS screens, pv.label AS mode, rec.top.article AS top_article, false AS future_information FROM dec {_JOINED}",
}
QUERIES = {k: globals()[k] for k in ORACLE} | {"driver_attribution": driver_attribution, "nested_evaluation": nested_evaluation}
