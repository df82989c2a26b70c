"""What followed a time: responses to news, and outcomes after decisions, over windows known to have stayed open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.operators.asof import band_join
from hindcast.operators.censor import open_through
from hindcast.operators.surfaces import Probe, Surface, read_surfaces

DAY = 86_400.0


def close_near(left: DataFrame, closes: DataFrame, by: list[str], ident: list[str], target: str, after: str, tolerance: float, name: str) -> DataFrame:
    """left with <name>_at and <name>: of the closes (by, bar_end, close) within tolerance of target and strictly after the time
    in after, the nearest to it, of two as near the later; nulls where there is none or after is null."""
    near = band_join(left.where(F.col(after).isNotNull()).select(*ident, *by, F.col(target).alias("__target"), F.col(after).alias("__after")), closes, by, F.col("__target"), "bar_end", tolerance, tolerance)
    gap = F.abs(F.col("r_bar_end") - F.col("__target"))
    best = F.min_by(F.struct("r_bar_end", "r_close"), F.struct(gap, -F.col("r_bar_end")))
    found = near.where("r_bar_end > __after").groupBy(*[F.col(c).alias(f"__{c}") for c in ident]).agg(best.alias("__best"))
    on = [F.col(c) == F.col(f"__{c}") for c in ident]
    return left.join(found, on, "left").select(*left.columns, F.col("__best.r_bar_end").alias(f"{name}_at"), F.col("__best.r_close").alias(name))


def absorption(arrivals: DataFrame, closes: DataFrame, statuses: DataFrame, versions: DataFrame, gaps: DataFrame, ident: list[str], bar: float, initial: float | None = None, drift: float = DAY) -> DataFrame:
    """Of each arrival (ident, condition, ts): open_through and reasons, intervening (whether the condition has a later arrival within
    drift), complete, and for complete ones initial_response, later_drift, same_direction and absorbed, |initial| / (|initial| + |drift|).

    The base is the last close by then, at most two bars old; the response ends at the close nearest to initial (a bar unless told
    otherwise) after the news, the drift at that nearest to drift after the end of the response, each within a bar; complete
    also means that the market stayed open through the drift.
    """
    rows = arrivals.withColumns({"__until": F.col("ts") + drift, "__soon": F.col("ts") + (initial or bar)})
    news = Surface("news", arrivals.select("condition", F.col("ts").alias("seen")), "seen", sums={"n": F.lit(1)})
    base = Surface("base", closes, "bar_end", last=("close",))
    rows = read_surfaces(rows, ["condition"], ident, [Probe("now", F.col("ts"), strict=False), Probe("end", F.col("__until"), strict=False)], [news, base])
    fresh = F.col("ts") - F.col("base_now.last.__at") <= 2 * bar
    rows = rows.select(*arrivals.columns, "__until", "__soon", F.when(fresh, F.col("base_now.last.close")).alias("c0"), (F.col("news_end.n") > F.col("news_now.n")).alias("intervening"))
    rows = rows.withColumn("__from", F.when(F.col("c0").isNotNull(), F.col("ts")))
    rows = close_near(rows, closes, ["condition"], ident, "__soon", "__from", bar, "c1")
    rows = close_near(rows, closes, ["condition"], ident, "__until", "c1_at", bar, "c2")
    rows = open_through(rows, ["condition"], ident, "ts", "__until", statuses, versions, gaps)
    complete = F.col("open_through") & F.col("c2").isNotNull()
    early, late = F.when(complete, F.col("c1") - F.col("c0")), F.when(complete, F.col("c2") - F.col("c1"))
    total = F.abs(early) + F.abs(late)
    return rows.select(*arrivals.columns, "open_through", "reasons", "intervening", complete.alias("complete"), early.alias("initial_response"), late.alias("later_drift"), (early * late > 0).alias("same_direction"), F.when(total > 0, F.abs(early) / total).alias("absorbed"))


def outcomes(decisions: DataFrame, closes: DataFrame, statuses: DataFrame, versions: DataFrame, gaps: DataFrame, ident: list[str], bar: float, horizons: tuple[float, ...]) -> DataFrame:
    """For each decision (ident, condition, t, direction +1, -1 or null) and horizon: status, drift and same_direction.

    status: no_base_close (none within two bars before), censored (not known to have stayed open), stale_endpoint (no close
    within a bar of the horizon and after the base's), observed. Nothing here is an input of features.
    """
    base = Surface("base", closes, "bar_end", last=("close",))
    rows = read_surfaces(decisions, ["condition"], ident, [Probe("now", F.col("t"), strict=False)], [base])
    last = F.when(F.col("t") - F.col("base_now.last.__at") <= 2 * bar, F.col("base_now.last"))
    rows = rows.select(*decisions.columns, last["__at"].alias("c0_at"), last["close"].alias("c0")).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("__until", F.col("t") + F.col("horizon"))
    rows = close_near(rows, closes, ["condition"], [*ident, "horizon"], "__until", "c0_at", bar, "c1")
    rows = open_through(rows, ["condition"], [*ident, "horizon"], "t", "__until", statuses, versions, gaps)
    status = F.when(F.col("c0").isNull(), "no_base_close").when(~F.col("open_through"), "censored").when(F.col("c1").isNull(), "stale_endpoint").otherwise("observed")
    drift = F.when(status == "observed", F.col("c1") - F.col("c0"))
    return rows.select(*decisions.columns, "horizon", status.alias("status"), "reasons", drift.alias("drift"), (F.col("direction") * drift > 0).alias("same_direction"))
