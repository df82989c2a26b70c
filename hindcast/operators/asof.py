"""As-of, band and overlap joins without a nested loop in the plan.

as-of: both sides are put in one table and a running last value fills in the right side, so one shuffle serves both.
A key with very many rows doesn't stay in one task: the running value is taken within slices of time (slice_seconds, None
for none), and the last value of each slice is carried over the following ones by a second, small window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 7 * 86_400.0


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str], strict: bool = True, order: list[str] | None = None, max_age: float | None = None, slice_seconds: float | None = SLICE) -> DataFrame:
    """left with the columns take of the latest row of right with the same keys.

    strict: only rows before left_time; else also those at it. Rows of right at one time are ordered by order, the
    last wins. max_age: an older match counts as none. Unmatched rows get nulls.
    """
    order = order or take
    side_l, side_r = (0, 1) if strict else (1, 0)
    empty = F.lit(None)
    rows_l = left.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(by)], F.col(left_time).cast("double").alias("t"), F.lit(side_l).alias("side"), F.struct(*left.columns).alias("l"), empty.alias("r"), empty.alias("o"))
    pack = F.struct(F.col(right_time).cast("double").alias("__at"), *take)
    rows_r = right.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(by)], F.col(right_time).cast("double").alias("t"), F.lit(side_r).alias("side"), empty.alias("l"), pack.alias("r"), F.struct(*order).alias("o"))
    keys = [f"k{i}" for i in range(len(by))]
    both = rows_l.unionByName(rows_r).where(F.col("t").isNotNull())
    if slice_seconds:
        both = both.withColumn("slice", F.floor(F.col("t") / slice_seconds))
        parts = [*keys, "slice"]
    else:
        parts = keys
    if slice_seconds:
        # What earlier slices end with comes first in a slice, as a row of its own, so the rows are shuffled once.
        ends = both.groupBy(*parts).agg(F.max_by("r", F.when(F.col("r").isNotNull(), F.struct("t", "o"))).alias("last"))
        carry = F.last("last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
        carried = ends.withColumn("r", carry).where("r is not null").select(*parts, F.lit(float("-inf")).alias("t"), F.lit(-1).alias("side"), empty.alias("l"), "r", empty.alias("o"))
        both = both.unionByName(carried)
    w = Window.partitionBy(*parts).orderBy("t", "side", "o").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("found", F.last("r", ignorenulls=True).over(w))
    hit = F.col("found")
    if max_age is not None:
        hit = F.when(F.col("t") - F.col("found.__at") <= max_age, hit)
    return found.where("l is not null").select("l.*", *[hit[c].alias(c) for c in take])


def _named(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"c_{k}") for k in keys], *values)


def _same(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"c_{k}"))
    return on


def best_before(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, rank: list[str], take: list[str], strict: bool = True, slice_seconds: float = SLICE) -> DataFrame:
    """left with the columns take of that row of right, among those with the same keys before left_time, which is greatest
    by rank: an as-of read whose order isn't that of the time at which rows become known.

    A running maximum over both sides in one table, within slices of time, and over the slices before by a small window;
    no pair of a decision and an earlier row is ever made. strict and nulls are as in asof_join.
    """
    side_l, side_r = (0, 1) if strict else (1, 0)
    keys = [f"k{i}" for i in range(len(by))]
    best = F.struct(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(rank)]).alias("o"), F.struct(*take).alias("v"))
    rows_l = left.select(*[F.col(k).alias(n) for k, n in zip(by, keys, strict=True)], F.col(left_time).cast("double").alias("t"), F.lit(side_l).alias("side"), F.struct(*left.columns).alias("l"), F.lit(None).alias("r"))
    rows_r = right.select(*[F.col(k).alias(n) for k, n in zip(by, keys, strict=True)], F.col(right_time).cast("double").alias("t"), F.lit(side_r).alias("side"), F.lit(None).alias("l"), best.alias("r"))
    both = rows_l.unionByName(rows_r).where(F.col("t").isNotNull()).withColumn("slice", F.floor(F.col("t") / slice_seconds))
    parts = [*keys, "slice"]
    w = Window.partitionBy(*parts).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    before = F.max("last").over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    carry = both.groupBy(*parts).agg(F.max("r").alias("last")).withColumn("carry", before)
    found = both.withColumn("own", F.max("r").over(w)).where("l is not null").join(_named(carry, parts, ["carry"]), _same(parts), "left")
    return found.withColumn("best", F.greatest("own", "carry")).select("l.*", *[F.col(f"best.v.{c}").alias(c) for c in take])


def trailing(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, seconds: float, sums: dict[str, Column], inclusive: bool = False) -> DataFrame:
    """left with sums (name: a number of each row of right) over the rows of right with the same keys in
    [left_time - seconds, left_time), inclusive: up to left_time itself; zero without rows.

    Running sums up to both ends of the span, each an as-of read, are subtracted; so a hot key is dealt over slices of time
    and no pair is made. Counts and sums of whole numbers are exact.
    """
    names = list(sums)
    keys = [f"k{i}" for i in range(len(by))]
    rows = right.select(*[F.col(k).alias(n) for k, n in zip(by, keys, strict=True)], F.col(right_time).cast("double").alias("t"), *[F.coalesce(x.cast("double"), F.lit(0.0)).alias(n) for n, x in sums.items()])
    at = rows.groupBy(*keys, "t").agg(*[F.sum(n).alias(n) for n in names]).withColumn("slice", F.floor(F.col("t") / SLICE))
    run = Window.partitionBy(*keys, "slice").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    carry = at.groupBy(*keys, "slice").agg(*[F.sum(n).alias(n) for n in names])
    over = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = _named(carry.withColumns({f"b_{n}": F.coalesce(F.sum(n).over(over), F.lit(0.0)) for n in names}), [*keys, "slice"], [f"b_{n}" for n in names])
    summed = at.join(carry, _same([*keys, "slice"])).select(*[F.col(n).alias(k) for k, n in zip(by, keys, strict=True)], F.col("t").alias("__t"), *[(F.sum(n).over(run) + F.col(f"b_{n}")).alias(n) for n in names])
    out = left.withColumn("__low", F.col(left_time) - F.lit(float(seconds)))
    out = asof_join(out, summed, by, left_time, "__t", names, strict=not inclusive, order=["__t"])
    out = out.withColumnsRenamed({n: f"__hi_{n}" for n in names})
    out = asof_join(out, summed, by, "__low", "__t", names, strict=True, order=["__t"])
    return out.select(*left.columns, *[(F.coalesce(f"__hi_{n}", F.lit(0.0)) - F.coalesce(n, F.lit(0.0))).alias(n) for n in names])


#: A span of more buckets than this is cut into buckets that are so many times as wide.
MANY, COARSE = 32, 512


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float, closed: bool = False, end_of_time: float | None = None) -> DataFrame:
    """Pairs of rows whose spans overlap (right.start < left.end and left.start < right.end; closed: also if they touch).

    Both sides are cut into time buckets of a width that should be near the usual length of a left span, so that the join
    is on (keys, level, bucket); long spans of the right side go to a level of wider buckets, in which every left row has
    its place too. A pair is emitted in the first bucket that both are in, once. A null right end is open, or ends at
    end_of_time. Right spans are cut to the time that the left side covers, so an open one has no more buckets than that. right's columns get the
    prefix r_.
    """
    (ls, le), (rs, re_) = left_span, right_span
    number = lambda c, level: F.floor(c / F.when(level == 1, F.lit(float(width * COARSE))).otherwise(F.lit(float(width)))).cast("long")
    end = lambda c: F.coalesce(c, F.lit(end_of_time)) if end_of_time is not None else c
    cover = left.agg(F.min(ls).alias("__from"), F.max(F.greatest(ls, le)).alias("__to"))
    a = left.withColumn("__level", F.explode(F.array(F.lit(0), F.lit(1))))
    a = a.withColumn("__b", F.explode(F.sequence(number(F.col(ls), F.col("__level")), number(F.greatest(F.col(ls), F.col(le)), F.col("__level")))))
    b = right.crossJoin(F.broadcast(cover)).withColumns({"__s": F.greatest(F.col(rs), F.col("__from")), "__e": F.least(F.coalesce(end(F.col(re_)), F.col("__to")), F.col("__to"))})
    b = b.where(F.col("__s") <= F.col("__e")).withColumn("__rl", ((F.col("__e") - F.col("__s")) / F.lit(float(width)) > MANY).cast("int"))
    b = b.withColumn("__rb", F.explode(F.sequence(number(F.col("__s"), F.col("__rl")), number(F.col("__e"), F.col("__rl"))))).drop("__from", "__to", "__e")
    b = b.select(*[F.col(c).alias(f"r_{c}") for c in b.columns])
    on = (F.col("__b") == F.col("r___rb")) & (F.col("__level") == F.col("r___rl"))
    for k in by:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    if closed:
        meet = (F.col(f"r_{rs}") <= F.col(le)) & (end(F.col(f"r_{re_}")).isNull() | (F.col(ls) <= end(F.col(f"r_{re_}"))))
    else:
        meet = (F.col(f"r_{rs}") < F.col(le)) & (end(F.col(f"r_{re_}")).isNull() | (F.col(ls) < end(F.col(f"r_{re_}"))))
    once = F.col("__b") == F.greatest(number(F.col(ls), F.col("__level")), number(F.col("r___s"), F.col("__level")))
    return a.join(b, on & meet & once).drop("__b", "__level", "r___rb", "r___rl", "r___s")


def band_join(left: DataFrame, right: DataFrame, by: list[str], left_time: Column, right_time: str, below: float, above: float) -> DataFrame:
    """Pairs with right_time in [left_time - below, left_time + above]; right's columns get the prefix r_."""
    width = max(below + above, 1e-9)
    a = left.withColumn("__x", left_time)
    number = lambda c: F.floor(c / F.lit(width)).cast("long")
    a = a.withColumn("__b", F.explode(F.sequence(number(F.col("__x") - below), number(F.col("__x") + above))))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("r___rb", number(F.col(f"r_{right_time}")))
    on = (F.col("__b") == F.col("r___rb")) & F.col(f"r_{right_time}").between(F.col("__x") - below, F.col("__x") + above)
    for k in by:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    return a.join(b, on).drop("__b", "r___rb", "__x")
