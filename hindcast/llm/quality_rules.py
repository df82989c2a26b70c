"""Quality rules with thresholds that each language and source set themselves.

A document is measured with array expressions inside its own row. Each (language, source) then gets a quantile
sketch of every measure over its documents that pass the base rules: counts of logarithmic buckets, which hold every
quantile to a relative error of one per cent and merge by addition, so that the sketch of a language is the sum of
those of its sources. A measure's fence lies at a share of the way from the group's median to its REACH quantile, and
never nearer than SPREAD times the distance from the median to the upper quartile; both are read off the group's own
sketch, and nothing is a constant in a measure's own unit. Groups of fewer than MIN_GROUP documents use their language's
sketch, and such languages the sketch of everything. The fences are joined back and decide, next to the two base rules.

Only Spark expressions are used. Sketches are summed before the shuffle, so a hot source costs no more than
its buckets. Repeated windows are found by hashes and then told apart by their words, so their count is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hindcast.llm.common import SPACE, barrier, bounded, checkpointed, packed, split_words, text_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: 99.5 % is a quantile of its own from 200 documents on.
MIN_GROUP = 200
REACH, SPREAD = 0.995, 4.0
#: Buckets of the sketches: a value's is the least power of GAMMA that isn't below it; ZERO is that of zero.
GAMMA, ZERO = 1.01, -100_000
EDGE = 0.001

#: Measure: the share of the way from the median to the REACH quantile where its fence lies.
MEASURES = {"symbol_ratio": 0.2, "dup_line_ratio": 0.6, "repeat_ratio": 0.6, "word_length": 0.35}


def measures(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """keep, then lang, source and the counts of each document; a null text has no words and no lines.

    Every row is measured alone, so repeated rows give repeated results; an empty table gives an empty one.
    """
    text = text_of("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(
        *keep, F.col("lang").alias("lang"), F.col("source").alias("source"), split_words(text).alias("w"), lines.alias("lines"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    kept = [c for c in rows.columns if c not in ("w", "lines")]
    # Candidates by longs: a window's hash above, its position in the low bits. Windows that are alike are among them.
    rows = rows.select(*kept, "w", F.size("w").cast("long").alias("n_words"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.length(F.bin(F.size("w"))).alias("bits"))
    rows = rows.withColumn("windows", F.expr("if(n_words < 3, cast(array() as array<bigint>), sort_array(transform(sequence(0, cast(n_words as int) - 3), i -> (xxhash64(w[i], w[i + 1], w[i + 2]) & (- shiftleft(1L, bits))) | i)))"))
    rows = rows.withColumn("near", F.expr("""transform(filter(windows, (x, i) ->
        (i > 0 and shiftright(get(windows, i - 1), bits) = shiftright(x, bits)) or (i + 1 < n_words - 2 and shiftright(get(windows, i + 1), bits) = shiftright(x, bits))),
        x -> cast(x & (shiftleft(1L, bits) - 1) as int))""")).drop("windows", "bits")
    # The candidates by their words: only equal neighbours stay.
    rows = rows.withColumn("same", F.expr("sort_array(transform(near, i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2]) as g, i as i)))")).drop("w", "near")
    rows = rows.withColumn("at", F.expr("sort_array(transform(filter(same, (x, k) -> (k > 0 and get(same, k - 1).g = x.g) or get(same, k + 1).g = x.g), x -> x.i))")).drop("same")
    repeat = F.expr("if(size(at) = 0, 0L, 3L + aggregate(sequence(1, size(at) - 1), 0L, (a, k) -> a + least(3, at[k] - at[k - 1])))")
    return rows.select(*kept, "n_words", "n_lines", "n_dup_lines", repeat.alias("n_repeat_words"), barrier().alias("barrier")).withColumns(
        {
            "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_ratio": F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
            "word_length": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))


def bucket_of(value: Column) -> Column:
    return F.when(value > 0, F.ceil(F.ln(value) / F.ln(F.lit(GAMMA)))).otherwise(ZERO)


def value_of(bucket: Column) -> Column:
    """The upper end of a bucket, within one per cent of all its values and below none of them (EDGE is for rounding)."""
    return F.when(bucket == ZERO, 0.0).otherwise(F.pow(F.lit(GAMMA), bucket + F.lit(EDGE)))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: the mergeable sketch of each measure over a group's documents that pass the base rules."""
    parts = F.array(*[F.struct(F.lit(m).alias("measure"), bucket_of(F.col(m)).alias("bucket")) for m in MEASURES])
    passed = measured.where(~base_failed() & (F.col("barrier") == 0))
    return passed.select("lang", "source", F.explode_outer(parts).alias("x")).groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group in by: its documents and a map from measure to fence."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "measure")
    run = merged.withColumn("below", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    at = lambda q: value_of(F.min(F.when(F.col("below") >= F.ceil(F.col("total") * F.lit(q)), F.col("bucket"))))
    found = run.groupBy(*by, "measure").agg(F.max("total").alias("total"), at(0.5).alias("mid"), at(0.75).alias("high"), at(REACH).alias("reach"))
    share = F.coalesce(*[F.when(F.col("measure") == m, F.lit(x)) for m, x in MEASURES.items()])
    fence = F.col("mid") + F.greatest(share * (F.col("reach") - F.col("mid")), F.lit(SPREAD) * (F.col("high") - F.col("mid")))
    return found.groupBy(*by).agg(F.max("total").alias("docs"), *[F.max(F.when(F.col("measure") == m, fence)).alias(m) for m in MEASURES])


def thresholds(measured: DataFrame) -> DataFrame:
    """A row for each (lang, source) that has a document that passes the base rules, with the fences that hold for it."""
    sketch = checkpointed(sketches(measured))
    own, lang, every = _fences(sketch, ["lang", "source"]), _fences(sketch, ["lang"]), _fences(sketch.withColumn("all", F.lit(1)), ["all"])
    name = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    own, lang, every = name(own, "o"), name(lang, "l"), name(every, "e")
    wide = own.join(lang, F.col("o_lang").eqNullSafe(F.col("l_lang"))).join(F.broadcast(every), F.col("e_all") == 1)
    pick = lambda m: F.when(F.col("o_docs") >= MIN_GROUP, F.col(f"o_{m}")).when(F.col("l_docs") >= MIN_GROUP, F.col(f"l_{m}")).otherwise(F.col(f"e_{m}"))
    return checkpointed(wide.select(F.col("o_lang").alias("f_lang"), F.col("o_source").alias("f_source"), *[pick(m).alias(f"f_{m}") for m in MEASURES]))


def judged(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """measured with base_failed and kept."""
    ok = ~F.col("base_failed") & (F.col("barrier") == 0)
    for m in MEASURES:
        ok = ok & (F.col(m) <= F.col(f"f_{m}"))
    joined = measured.join(bounded(fences), F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", F.coalesce(ok, F.lit(False)))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row of docs.

    Null ids, languages and sources are values of their own; a null or empty text has no words and fails the base
    rules; columns of docs beyond doc_id, text, lang and source are not read.
    """
    measured = checkpointed(measures(docs, [F.col("doc_id").alias("doc_id")]))
    return judged(measured, thresholds(measured)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns.

    Documents are measured twice, once for the sketches and once to be judged, so that no text is shuffled.
    """
    fences = thresholds(measures(docs, []))
    return judged(measures(docs, [packed(docs).alias("__doc")]), fences).where("kept").select("__doc.*")
