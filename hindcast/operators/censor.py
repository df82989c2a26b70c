"""Whether a contract is positively known to have stayed open through a window; otherwise the window is censored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.operators.asof import SLICE
from hindcast.operators.surfaces import Probe, Surface, read_surfaces

#: Fixed order of the reasons against a window.
REASONS = ("status_unknown", "status_blocking", "closes_inside", "contract_unknown", "contract_changed", "resolves_inside", "collector_gap")
ALWAYS, NEVER = -1e12, float("inf")


def open_through(windows: DataFrame, by: list[str], ident: list[str], start: str, end: str, statuses: DataFrame, versions: DataFrame, gaps: DataFrame, slice_seconds: float = SLICE) -> DataFrame:
    """windows with reasons (comma-joined, empty for none), open_through (no reason) and time_to_resolution.

    statuses: by, effective_from, blocking; versions: by, effective_from, resolution_time; gaps: by, gap_start, gap_end.
    A window is open only if a status that doesn't block is in force at its start (of two at one time a blocking one
    counts), none that blocks takes effect after that up to and with its end, a contract version from before the start isn't
    followed by another up to and with the end, the end lies before the earliest resolution recorded, and no gap, open
    ones included, touches the window. Gaps may overlap: the latest end of those that begin by the window's end decides. What isn't known
    fails closed.
    """
    fixed = versions.where("resolution_time is not null").groupBy(*by).agg(F.min("resolution_time").alias("resolution")).withColumn("known", F.lit(ALWAYS))
    surfaces = [
        Surface("status", statuses, "effective_from", last=("blocking",), order=("blocking",)),
        Surface("closing", statuses.where("blocking"), "effective_from", highest={"at": F.col("effective_from").cast("double")}),
        Surface("version", versions, "effective_from", sums={"n": F.lit(1)}),
        Surface("gap", gaps, "gap_start", highest={"until": F.coalesce(F.col("gap_end").cast("double"), F.lit(NEVER))}),
        Surface("fixed", fixed, "known", last=("resolution",)),
    ]
    probes = [Probe("opens", F.col(start), strict=False), Probe("before", F.col(start) + 1e-9), Probe("ends", F.col(end), strict=False)]
    rows = read_surfaces(windows, by, ident, probes, surfaces, slice_seconds)
    c, zero = F.col, F.lit(0)
    status, resolution = c("status_opens.last"), c("fixed_ends.last.resolution")
    earlier, through = F.coalesce(c("version_before.n"), zero), F.coalesce(c("version_ends.n"), zero)
    against = [
        F.when(status.isNull(), "status_unknown"), F.when(status["blocking"], "status_blocking"), F.when(c("closing_ends.at") > c(start), "closes_inside"), F.when(earlier == 0, "contract_unknown"),
        F.when((earlier > 0) & (earlier != through), "contract_changed"), F.when(c(end) >= resolution, "resolves_inside"), F.when(c("gap_ends.until") >= c(start), "collector_gap"),
    ]
    reasons = F.array_compact(F.array(*against))
    return rows.select(*windows.columns, F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("open_through"), F.when(resolution.isNotNull(), F.greatest(F.lit(0.0), resolution - c(start))).alias("time_to_resolution"))
