"""The censor and what it guards: responses to news and outcomes of decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions import exprs as X
from hindcast.operators import bars as B
from hindcast.operators import censor, drift
from hindcast.operators import outcomes as O
from hindcast.operators.lineage import stored
from hindcast.plans import study
from hindcast.plans.decision_plans import _MOM, cuts, moments
from hindcast.plans.study import FULL, rounded
from hindcast.sources import adapters as A
from hindcast.sources.adapters import BAR, DAY, duck, table

HORIZON = 90 * DAY


def open_through(spark, sf_dir):
    """Whether a customer's market is known to have stayed open for 90 days from each cutoff, and the reasons why not."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("market"), X.epoch("o_orderdate").alias("at"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    statuses = o.select("market", F.col("at").alias("effective_from"), (F.col("o_orderstatus") == "P").alias("blocking"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    versions = o.where(urgent).select("market", F.col("at").alias("effective_from"), F.when(F.col("o_orderstatus") == "F", F.col("at") + 3 * 365 * DAY).alias("resolution_time"))
    gaps = o.where("o_orderpriority = '5-LOW' and o_orderstatus = 'P'").select("market", (F.col("at") - 5 * DAY).alias("gap_start"), F.when(F.col("o_totalprice") < 450_000, F.col("at") + 20 * DAY).alias("gap_end"))
    rows = cuts(spark, sf_dir).withColumn("until", F.col("t") + HORIZON)
    return rounded(censor.open_through(rows, ["market"], ["cut"], "t", "until", statuses, versions, gaps, slice_seconds=365 * DAY).drop("until"))


def _lifecycle(spark, sf_dir):
    return A.statuses(spark, sf_dir), A.contracts(spark, sf_dir), A.gaps(spark, sf_dir).select("condition", "gap_start", "gap_end")


def event_absorption(spark, sf_dir):
    """Of each arrival of news the response within a bar, the drift until a day after it, and the share absorbed at once."""
    made = O.absorption(study.arrivals(spark, sf_dir), study.closes(spark, sf_dir), *_lifecycle(spark, sf_dir), ["article", "ts"], BAR)
    return rounded(made, 6)


def outcomes_by_horizon(spark, sf_dir):
    """Of each moment and horizon the move that followed, where the market is known to have stayed open."""
    rows = moments(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("e"), F.when(F.col("value") > 25, 1).otherwise(-1).alias("direction")), F.col("decision") == F.col("e")).drop("e")
    made = O.outcomes(rows, study.closes(spark, sf_dir), *_lifecycle(spark, sf_dir), ["decision"], BAR, (BAR, DAY, 3 * DAY))
    return rounded(made.select("decision", (F.col("horizon") / 3600).cast("int").alias("horizon"), "status", "reasons", "drift", "same_direction"))


HORIZONS = (BAR, 2 * BAR, DAY, 3 * DAY, 7 * DAY)


def _observations(spark, sf_dir):
    bars = stored(study.bars(spark, sf_dir), "bars")
    returns = B.trailing_volatility(B.interval_returns(bars, BAR))
    records = stored(B.with_news(returns, study.arrivals(spark, sf_dir), BAR), "records")
    closes = bars.where("complete").select("condition", (F.col("bin_start") + BAR).alias("bar_end"), "close")
    return stored(drift.observations(records, closes, *_lifecycle(spark, sf_dir), BAR, HORIZONS), "observations")


def drift_moments(spark, sf_dir):
    """For each horizon and status the observations, and sums of the products that the regressions are made of."""
    rows, c = _observations(spark, sf_dir), F.col
    return rounded(rows.groupBy((c("horizon") / 3600).cast("int").alias("hours"), "status").agg(F.count("*").alias("n"), *[F.sum(c(a) * c(b)).alias(f"{a}_{b}") for a, b in (("y", "r_news"), ("y", "r_nonnews"), ("r_news", "r_news"), ("close", "distance"), ("spread", "log_turnover"), ("vol", "log_left"))], F.sum("left_missing").alias("left_missing")), 6)


def drift_regressions(spark, sf_dir):
    return rounded(drift.drift_regressions(_observations(spark, sf_dir), HORIZONS), 9)


def drift_placebo(spark, sf_dir):
    return rounded(drift.placebo_p(_observations(spark, sf_dir), 19), 9)


def _censored(windows: str, key: str, start: str, end: str, statuses: str, versions: str, gaps: str) -> str:
    """A query of the windows with reasons, each by its own subquery."""
    at = lambda t: f"s.{key} = w.{key} AND effective_from {t}"
    return f"""SELECT *, concat_ws(',', CASE WHEN st IS NULL THEN 'status_unknown' END, CASE WHEN st THEN 'status_blocking' END, CASE WHEN inside THEN 'closes_inside' END, CASE WHEN v0 = 0 THEN 'contract_unknown' WHEN v0 != v1 THEN 'contract_changed' END, CASE WHEN {end} >= res THEN 'resolves_inside' END, CASE WHEN gap THEN 'collector_gap' END) AS reasons FROM (SELECT w.*,
        (SELECT arg_max(blocking, (effective_from, blocking)) FROM {statuses} s WHERE {at(f'<= {start}')}) AS st, EXISTS (SELECT 1 FROM {statuses} s WHERE {at(f'> {start}')} AND effective_from <= {end} AND blocking) AS inside,
        (SELECT count(*) FROM {versions} s WHERE {at(f'< {start} + 1e-9')}) AS v0, (SELECT count(*) FROM {versions} s WHERE {at(f'<= {end}')}) AS v1, (SELECT min(resolution_time) FROM {versions} s WHERE s.{key} = w.{key}) AS res,
        EXISTS (SELECT 1 FROM {gaps} s WHERE s.{key} = w.{key} AND gap_start <= {end} AND (gap_end IS NULL OR gap_end >= {start})) AS gap FROM {windows} w)"""


_O = "(SELECT o_custkey AS market, epoch_us(o_orderdate)/1e6 AS began, * FROM orders)"
_LIFE = duck("statuses", "contracts") + ", " + FULL.removeprefix("WITH RECURSIVE ") + ", " + _MOM
_NEAR = "(SELECT arg_min(struct_pack(e := bar_end, c := close), (abs(bar_end - ({target})), -bar_end)) FROM closes c WHERE c.condition = {w}.condition AND abs(bar_end - ({target})) <= {bar} AND bar_end > {after})"
ORACLE = {
    "open_through": f"""WITH o AS MATERIALIZED {_O}, s0 AS MATERIALIZED (SELECT market, began AS effective_from, o_orderstatus = 'P' AS blocking FROM o), v0 AS MATERIALIZED (SELECT market, began AS effective_from, CASE WHEN o_orderstatus = 'F' THEN began + {3 * 365 * DAY} END AS resolution_time FROM o WHERE o_orderpriority = '1-URGENT'),
        g0 AS MATERIALIZED (SELECT market, began - {5 * DAY} AS gap_start, CASE WHEN o_totalprice < 450000 THEN began + {20 * DAY} END AS gap_end FROM o WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'P'), w0 AS MATERIALIZED (SELECT o_orderkey AS cut, market, began AS t, began + {HORIZON} AS until FROM o)
        SELECT cut, market, t, reasons, reasons = '' AS open_through, CASE WHEN res IS NOT NULL THEN greatest(0.0, res - t) END AS time_to_resolution FROM ({_censored('w0', 'market', 't', 'until', 's0', 'v0', 'g0')})""",
    "event_absorption": f"""{_LIFE}, w0 AS (SELECT article, condition, ts, ts + {DAY} AS until FROM arr), w1 AS (SELECT *, (SELECT arg_max(close, bar_end) FROM closes c WHERE c.condition = w0.condition AND bar_end <= ts AND ts - bar_end <= {2 * BAR}) AS c0, EXISTS (SELECT 1 FROM arr o WHERE o.condition = w0.condition AND o.ts > w0.ts AND o.ts <= until) AS intervening FROM w0),
        w2 AS (SELECT *, CASE WHEN c0 IS NOT NULL THEN {_NEAR.format(target=f'w1.ts + {BAR}', w='w1', bar=BAR, after='w1.ts')} END AS x1 FROM w1), w3 AS (SELECT *, CASE WHEN x1 IS NOT NULL THEN {_NEAR.format(target='w2.until', w='w2', bar=BAR, after='w2.x1.e')} END AS x2 FROM w2),
        w4 AS (SELECT *, reasons = '' AS open_through, reasons = '' AND x2 IS NOT NULL AS complete FROM ({_censored('w3', 'condition', 'ts', 'until', 'statuses', 'contracts', 'gaps')})), w5 AS (SELECT *, CASE WHEN complete THEN x1.c - c0 END AS a, CASE WHEN complete THEN x2.c - x1.c END AS b FROM w4)
        SELECT article, condition, round(ts, 6) AS ts, open_through, reasons, intervening, complete, round(a, 6) + 0.0::DOUBLE AS initial_response, round(b, 6) + 0.0::DOUBLE AS later_drift, a * b > 0 AS same_direction, round(CASE WHEN abs(a) + abs(b) > 0 THEN abs(a) / (abs(a) + abs(b)) END, 6) AS absorbed FROM w5""",
    "outcomes_by_horizon": f"""{_LIFE}, w0 AS (SELECT m.*, CASE WHEN value > 25 THEN 1 ELSE -1 END AS direction, (SELECT arg_max(struct_pack(e := bar_end, c := close), bar_end) FROM closes c WHERE c.condition = m.condition AND bar_end <= t AND t - bar_end <= {2 * BAR}) AS x0 FROM moments m JOIN events ON event_id = decision),
        w1 AS (SELECT *, t + h * 3600 AS until FROM w0, unnest([{int(BAR // 3600)}, 24, 72]) AS u(h)), w2 AS (SELECT *, CASE WHEN x0 IS NOT NULL THEN {_NEAR.format(target='w1.until', w='w1', bar=BAR, after='w1.x0.e')} END AS x1 FROM w1),
        w3 AS (SELECT *, CASE WHEN x0 IS NULL THEN 'no_base_close' WHEN reasons != '' THEN 'censored' WHEN x1 IS NULL THEN 'stale_endpoint' ELSE 'observed' END AS status FROM ({_censored('w2', 'condition', 't', 'until', 'statuses', 'contracts', 'gaps')})), w4 AS (SELECT *, CASE WHEN status = 'observed' THEN x1.c - x0.c END AS drift FROM w3)
        SELECT decision, CAST(h AS INT) AS horizon, status, reasons, round(drift, 9) + 0.0::DOUBLE AS drift, direction * drift > 0 AS same_direction FROM w4""",
    "drift_moments": f"""{_LIFE}, v0 AS (SELECT ret.*, CASE WHEN count(ret) OVER w >= 2 THEN stddev_samp(ret) OVER w ELSE 0 END AS vol, EXISTS (SELECT 1 FROM arr WHERE arr.condition = ret.condition AND floor(arr.ts / {BAR}) * {BAR} = bin_start) AS hit FROM ret WINDOW w AS (PARTITION BY condition ORDER BY bin_start ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
        w0 AS (SELECT *, bin_start + {BAR} AS ends, bin_start + {BAR} + h AS until, (SELECT arg_max(struct_pack(e := bar_end, c := close), bar_end) FROM closes c WHERE c.condition = v0.condition AND bar_end <= bin_start + {BAR}) AS x0 FROM v0, unnest([{', '.join(f'{h}::DOUBLE' for h in HORIZONS)}]) AS u(h)),
        w1 AS (SELECT *, CASE WHEN x0 IS NOT NULL THEN {_NEAR.format(target='w0.until', w='w0', bar=BAR, after='w0.x0.e')} END AS x1 FROM w0),
        w2 AS (SELECT *, CASE WHEN x0 IS NULL THEN 'no_base' WHEN reasons != '' THEN 'censored' WHEN x1 IS NULL THEN 'stale_endpoint' ELSE 'observed' END AS status, x1.c - x0.c AS y, CASE WHEN hit THEN ret ELSE 0 END AS rn, CASE WHEN hit THEN 0 ELSE ret END AS rx, coalesce(ln(1 + greatest(0.0, res - ends)), 0) AS lleft FROM ({_censored('w1', 'condition', 'ends', 'until', 'statuses', 'contracts', 'gaps')}))
        SELECT CAST(h / 3600 AS INT) AS hours, status, count(*) AS n, round(sum(y * rn), 6) + 0.0::DOUBLE AS y_r_news, round(sum(y * rx), 6) + 0.0::DOUBLE AS y_r_nonnews, round(sum(rn * rn), 6) AS r_news_r_news, round(sum(close * abs(close)), 6) AS close_distance, round(sum(coalesce(spread_mean, 0) * ln(1 + turnover)), 6) AS spread_log_turnover, round(sum(vol * lleft), 6) AS vol_log_left, sum((res IS NULL)::INT)::DOUBLE AS left_missing FROM w2 GROUP BY ALL""",
}
QUERIES = {k: globals()[k] for k in ORACLE} | {"drift_regressions": drift_regressions, "drift_placebo": drift_placebo}
