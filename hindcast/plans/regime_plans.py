"""Regimes: reference statistics, vectors, online and smoothed modes, durations, screens, prevalence."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import bars as B
from hindcast.operators import regime as R
from hindcast.operators.asof import asof_join
from hindcast.plans import decision_plans, study
from hindcast.plans.study import FULL, rounded
from hindcast.sources import adapters as A
from hindcast.sources.adapters import BAR

#: A model fitted elsewhere, as runs are by their id: two centroids and a penalty.
CENTROIDS = [[-0.3, -0.4, -0.5, 0.0, 1.0], [0.3, 0.4, 0.6, 0.0, 1.0]]
PENALTY = 1.0


def vectors(spark, sf_dir):
    rows = R.raw_variables(study.bars(spark, sf_dir))
    return R.stationarize(rows, R.reference_stats(rows).persist()).persist()


def online(spark, sf_dir):
    return R.online_costs(B.segments(vectors(spark, sf_dir), BAR), CENTROIDS, PENALTY)


def labels(spark, sf_dir):
    return online(spark, sf_dir).select("condition", "bin_start", F.when(F.col("mode_online") == 0, "calm").otherwise("event").alias("label"))


def reference_stats(spark, sf_dir):
    return rounded(R.reference_stats(R.raw_variables(study.bars(spark, sf_dir))), 6)


def stationarize(spark, sf_dir):
    return rounded(vectors(spark, sf_dir), 6)


def online_modes(spark, sf_dir):
    return online(spark, sf_dir).select("condition", "bin_start", "mode_online")


def smoothed_modes(spark, sf_dir):
    """The paths of least cost; held against dynamic programming and exhaustive search in the tests."""
    return R.smoothed_modes(B.segments(vectors(spark, sf_dir), BAR).withColumn("segment", F.col("segment").cast("long")), CENTROIDS, PENALTY)


def jump_model(spark, sf_dir):
    """The fitted model: penalty, calm mode and centroids; no rows if gaps leave fewer than ten complete bars, as there is no model then."""
    try:
        m = R.fit_jump_model(R.stationary_segments(study.bars(spark, sf_dir), BAR), penalty=PENALTY)
        modes = [(k, float(m["lambda"]), k == m["calm"], [float(x) for x in m["centroids"][k]]) for k in range(2)]
    except R.TooFewBars:
        modes = []
    return spark.createDataFrame(modes, "mode int, penalty double, calm boolean, centroid array<double>")


def mode_durations(spark, sf_dir):
    return R.mode_durations(online(spark, sf_dir), "mode_online").groupBy("mode_online").agg(F.count("*").alias("runs"), F.round(F.avg("n"), 6).alias("mean_bars"))


def impact_screens(spark, sf_dir):
    return R.screen_impact(study.arrivals(spark, sf_dir), labels(spark, sf_dir), BAR, A.START + 2 * 86_400.0)


def mode_asof(spark, sf_dir):
    """The latest mode whose bar has ended at each moment (at it counts), and its age in hours."""
    ends = labels(spark, sf_dir).withColumn("end", F.col("bin_start") + BAR)
    rows = asof_join(decision_plans.moments(spark, sf_dir), ends, ["condition"], "t", "end", ["end", "label"], strict=False)
    return rounded(rows.select("decision", "label", ((F.col("t") - F.col("end")) / 3600).alias("age_hours")), 6)


def mode_prevalence(spark, sf_dir):
    """Of each moment the share of conditions whose latest mode is an event."""
    ends = labels(spark, sf_dir).withColumn("end", F.col("bin_start") + BAR)
    m = decision_plans.moments(spark, sf_dir).select("decision", "t").withColumn("condition", F.explode(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))))
    rows = asof_join(m, ends, ["condition"], "t", "end", ["label"], strict=False).where("label is not null")
    return rounded(rows.groupBy("decision").agg(F.avg((F.col("label") == "event").cast("double")).alias("prevalence"), F.count("*").alias("conditions")), 6)


_T = {"spread_ticks": "ln(spread_ticks + 1e-9::DOUBLE)", "turnover": "ln(1 + greatest(turnover, 0))", "volatility": "ln(volatility + 1e-9::DOUBLE)", "best_size": "ln(best_size + 1e-9::DOUBLE)"}
_RAW = "raw AS (SELECT condition, bin_start, CAST(floor(bin_start / 3600) AS BIGINT) % 24 AS hour, coalesce(spread_ticks_mean, spread_mean) AS spread_ticks, turnover, sqrt(rv) AS volatility, best_size_mean AS best_size FROM bars WHERE complete)"
_LONG = "tall AS (" + " UNION ALL ".join(f"SELECT condition, hour, '{v}' AS variable, {t} AS x, {R.FLOORS[v]}::DOUBLE AS least FROM raw" for v, t in _T.items()) + ")"
_Q = "(list_extract(a, {j}) * (4 - {d}) + list_extract(a, {j} + 1) * {d}) / 4.0::DOUBLE"


def _quart(k: int) -> str:
    j = f"greatest(1, least(len(a) - 1, CAST(floor({k} * (len(a) + 1) / 4.0::DOUBLE) AS INT)))"
    return _Q.format(j=j, d=f"({k} * (len(a) + 1) - {j} * 4)")


_STATS = f"""st AS (SELECT CASE WHEN grouping(condition) = 0 AND grouping(hour) = 0 THEN 'cell' WHEN grouping(condition) = 0 THEN 'condition' ELSE 'pooled' END AS level, condition, hour, variable, least, list(x ORDER BY x) AS a FROM tall WHERE x IS NOT NULL
    GROUP BY GROUPING SETS ((condition, hour, variable, least), (condition, variable, least), (variable, least))),
    stats AS (SELECT level, condition, hour, variable, CAST(len(a) AS INT) AS n, median(u) AS median, max(CASE WHEN len(a) >= 4 THEN greatest({_quart(3)} - {_quart(1)}, least) ELSE least END) AS iqr FROM (SELECT *, unnest(a) AS u FROM st) GROUP BY level, condition, hour, variable, a)"""
_PICK = ", ".join(
    f"""(SELECT CASE WHEN '{v}' = 'turnover' AND turnover <= 0 THEN 0 ELSE greatest(-10, least(10, ({t} - q.median) / q.iqr)) END FROM (SELECT * FROM stats s WHERE s.variable = '{v}' AND ((level = 'cell' AND s.condition = raw.condition AND s.hour = raw.hour AND n >= 20) OR (level = 'condition' AND s.condition = raw.condition) OR level = 'pooled') ORDER BY level LIMIT 1) q) AS z_{v}"""
    for v, t in _T.items()
)
_Z = f"z AS (SELECT condition, bin_start, {_PICK}, CASE WHEN turnover > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS traded FROM raw)"
_D = lambda c: " + ".join(f"pow({d} - ({x}), 2)" for d, x in zip(R.DIMENSIONS, c, strict=True))
_ON = f"""seg AS (SELECT *, CAST(sum(sx) OVER (PARTITION BY condition ORDER BY bin_start) AS BIGINT) AS segment FROM (SELECT *, coalesce((bin_start - lag(bin_start) OVER (PARTITION BY condition ORDER BY bin_start) != {BAR})::INT, 1) AS sx FROM z)),
    num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY condition, segment ORDER BY bin_start) AS k, {_D(CENTROIDS[0])} AS d0, {_D(CENTROIDS[1])} AS d1 FROM seg),
    fwd AS (SELECT condition, segment, k, bin_start, d0 AS a, d1 AS b FROM num WHERE k = 1 UNION ALL SELECT n.condition, n.segment, n.k, n.bin_start, n.d0 + least(f.a, f.b + {PENALTY}), n.d1 + least(f.b, f.a + {PENALTY}) FROM fwd f JOIN num n ON n.condition = f.condition AND n.segment = f.segment AND n.k = f.k + 1),
    onl AS (SELECT condition, segment, bin_start, CASE WHEN a <= b THEN 0 ELSE 1 END AS mode_online, CASE WHEN a <= b THEN 'calm' ELSE 'event' END AS label FROM fwd)"""
_S = f"{FULL}, {_RAW}, {_LONG}, {_STATS}"
_O = f"{_S}, {_Z}, {_ON}"
_MOM = decision_plans._MOM
ORACLE = {
    "reference_stats": f"{_S} SELECT level, condition, CAST(hour AS INT) AS hour, variable, n, round(median, 6) AS median, round(iqr, 6) AS iqr FROM stats",
    "stationarize": f"{_S}, {_Z} SELECT condition, bin_start, round(z_spread_ticks, 6) + 0.0::DOUBLE AS z_spread_ticks, round(z_turnover, 6) + 0.0::DOUBLE AS z_turnover, round(z_volatility, 6) + 0.0::DOUBLE AS z_volatility, round(z_best_size, 6) + 0.0::DOUBLE AS z_best_size, traded FROM z",
    "online_modes": f"{_O} SELECT condition, bin_start, mode_online FROM onl",
    "smoothed_modes": f"""{_O}, sure1 AS (SELECT *, CASE WHEN lead(bin_start) OVER (PARTITION BY condition, segment ORDER BY bin_start) IS NULL THEN CASE WHEN a <= b THEN 0 ELSE 1 END WHEN b - a >= {PENALTY} THEN 0 WHEN b - a < -{PENALTY} THEN 1 END AS sure FROM fwd)
        SELECT condition, segment, bin_start, first_value(sure IGNORE NULLS) OVER (PARTITION BY condition, segment ORDER BY bin_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mode FROM sure1""",
    "mode_durations": f"{_O}, c1 AS (SELECT *, coalesce((mode_online != lag(mode_online) OVER (PARTITION BY condition, segment ORDER BY bin_start))::INT, 1) AS sx FROM onl), g1 AS (SELECT *, sum(sx) OVER (PARTITION BY condition, segment ORDER BY bin_start) AS run FROM c1), l1 AS (SELECT mode_online, count(*) AS n FROM g1 GROUP BY condition, segment, run, mode_online) SELECT mode_online, count(*) AS runs, round(avg(n), 6) AS mean_bars FROM l1 GROUP BY mode_online",
    "impact_screens": f"""{_O}, s1 AS (SELECT arr.*, floor(ts / {BAR}) * {BAR} AS a FROM arr), j1 AS (SELECT s.*, p.label AS pre, m.label AS arrival, n.label AS post FROM s1 s LEFT JOIN onl p ON p.condition = s.condition AND p.bin_start = a - {BAR} LEFT JOIN onl m ON m.condition = s.condition AND m.bin_start = a LEFT JOIN onl n ON n.condition = s.condition AND n.bin_start = a + {BAR}),
        k1 AS (SELECT *, coalesce(pre = 'calm' AND arrival = 'event', false) OR coalesce(arrival = 'calm' AND post = 'event', false) AS jump FROM j1), q1 AS (SELECT *, CASE WHEN ts < {A.START + 2 * 86_400.0} THEN 'model_unavailable' WHEN arrival IS NULL OR (pre IS NULL AND post IS NULL) THEN 'insufficient_coverage' WHEN jump THEN 'screened' WHEN pre IS NOT NULL AND post IS NOT NULL THEN 'screened' ELSE 'partial_coverage' END AS status FROM k1)
        SELECT article, condition, pre, arrival, post, status, CASE WHEN status = 'screened' THEN jump::INT END AS transition, a + {2 * BAR} AS available_at FROM q1""",
    "mode_asof": f"{_O}, {_MOM} SELECT decision, label, round((t - bin_start - {BAR}) / 3600, 6) AS age_hours FROM moments m ASOF LEFT JOIN (SELECT condition, bin_start, label, bin_start + {BAR} AS e FROM onl) o ON m.condition = o.condition AND m.t >= o.e",
    "mode_prevalence": f"{_O}, {_MOM} SELECT decision, round(avg((l = 'event')::INT), 6) AS prevalence, count(*) AS conditions FROM (SELECT decision, o.condition, arg_max(label, bin_start) AS l FROM moments m JOIN onl o ON o.bin_start + {BAR} <= m.t GROUP BY ALL) GROUP BY decision",
}
QUERIES = {k: globals()[k] for k in ORACLE} | {"jump_model": jump_model}
