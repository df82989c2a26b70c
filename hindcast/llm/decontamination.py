"""Benchmark decontamination by winnowing, in Spark expressions only.

Words are hashed; of the GRAM-word hashes in every SLIDE consecutive positions the smallest is a fingerprint. Any
span of GRAM + SLIDE - 1 = WINDOW words that a document and a benchmark item share has the same smallest hash in
both, so the join of the fingerprints misses no window. Items of fewer words than a window are one window; for the
lengths that occur among them all hashes of that length are fingerprints. The documents that the join has found are
then extended: all their windows are joined with the items' windows by 128-bit hashes, and the hit positions are
merged. The benchmark's side is broadcast only if a count shows it to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import ascii_lower, bounded, checkpointed, exploded, packed, row_key, split_words, text_of

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 6
SLIDE = WINDOW - GRAM + 1


def words_of(text: str = "text") -> Column:
    return split_words(ascii_lower(text_of(text)), SEPARATOR)


def _hashes(rows: DataFrame) -> DataFrame:
    """rows with w (words) replaced by h (their hashes) and n_words."""
    other = [c for c in rows.columns if c != "w"]
    return rows.select(*other, F.transform("w", lambda x: F.xxhash64(x)).alias("h"), F.size("w").cast("long").alias("n_words"))


def _spans(length: str, of: str = "h") -> str:
    """SQL: the start positions, from 1, of all spans of a length."""
    return f"if(size({of}) < {length}, cast(array() as array<int>), sequence(1, size({of}) - {length} + 1))"


def fingerprints(rows: DataFrame, short: list[int]) -> DataFrame:
    """rows with h replaced by fp, the distinct fingerprints: winnowed ones, and all those of the short lengths."""
    other = [c for c in rows.columns if c != "h"]
    grams = rows.select(*other, "h", F.expr(f"transform({_spans(str(GRAM))}, i -> xxhash64(slice(h, i, {GRAM})))").alias("g"))
    parts = [F.expr(f"transform({_spans(str(SLIDE), 'g')}, i -> array_min(slice(g, i, {SLIDE})))")]
    parts += [F.expr(f"transform({_spans(str(n))}, i -> xxhash64({n}, slice(h, i, {n})))") for n in short]
    return grams.select(*other, F.array_distinct(F.concat(*parts)).alias("fp"))


def grams(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """The other columns of rows and n, at (from 0), a, b: the 128-bit hashes of all spans of the lengths."""
    other = [c for c in rows.columns if c not in ("h", "n_words")]
    parts = [F.expr(f"transform({_spans(str(n))}, i -> struct({n} as n, i - 1 as at, xxhash64(slice(h, i, {n})) as a, xxhash64('b', slice(h, i, {n})) as b))") for n in lengths]
    return exploded(rows.select(*other, F.concat(*parts).alias("all")), F.col("all"), "x").select(*other, "x.*")


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every row of docs as doc_id, digest, n_words; of the documents that are hit h_id, h_digest, n_hit, items)."""
    items = _hashes(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of().alias("w"))).where("n_words > 0")
    items = checkpointed(items)
    short = sorted(r.n_words for r in items.where(F.col("n_words") < WINDOW).select("n_words").distinct().collect())
    long_, brief = items.where(F.col("n_words") >= WINDOW), items.where(F.col("n_words") < WINDOW)
    marks = fingerprints(long_, []).select(F.explode_outer("fp").alias("f")).where("f is not null")
    if short:  # a short item's only fingerprint is that of its own length
        own = F.coalesce(*[F.when(F.col("n_words") == n, F.expr(f"xxhash64({n}, h)")) for n in short])
        marks = marks.union(brief.select(own.alias("f")))
    marks = checkpointed(marks.distinct())
    own = F.col("n") == F.least(F.col("n_words"), F.lit(WINDOW))
    windows = checkpointed(grams(items.withColumnRenamed("n_words", "n_item"), [*short, WINDOW]).withColumnRenamed("n_item", "n_words").where(own).select(F.col("n").alias("i_n"), F.col("a").alias("i_a"), F.col("b").alias("i_b"), "item").distinct())

    rows = docs.select(F.monotonically_increasing_id().alias("row"), row_key().alias("key"), words_of().alias("w"))
    marked = fingerprints(_hashes(rows), short).select("row", "key", "n_words", F.explode_outer("fp").alias("fp")).join(bounded(marks), F.col("fp") == F.col("f"), "left")
    every = checkpointed(marked.groupBy("row", "key", "n_words").agg(F.max(F.col("f").isNotNull()).alias("found")).select("key.id", "key.digest", "n_words", "found"))

    found = bounded(every.where("found").select(F.col("id").alias("f_id"), F.col("digest").alias("f_digest")).distinct())
    some = docs.select(row_key().alias("key"), F.col("text").alias("text")).join(found, F.col("key.id").eqNullSafe(F.col("f_id")) & (F.col("key.digest") == F.col("f_digest")), "left_semi")
    spans = grams(_hashes(some.select("key", words_of().alias("w"))), [*short, WINDOW])
    hit = spans.join(bounded(windows), (F.col("n") == F.col("i_n")) & (F.col("a") == F.col("i_a")) & (F.col("b") == F.col("i_b")))
    ends = F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))
    merged = hit.groupBy("key").agg(F.collect_set(F.struct("at", "n")).alias("spans"), F.collect_set("item").alias("items"))
    return every, merged.select(F.col("key.id").alias("h_id"), F.col("key.digest").alias("h_digest"), F.size(F.array_distinct(F.flatten(ends))).cast("long").alias("n_hit"), F.sort_array("items").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    A null text has no words; a null item_id counts as an empty string; repeated rows are judged each and alike;
    items without words match nothing; empty tables give an empty result or one without hits; other columns are
    not read.
    """
    every, hit = hits(docs, benchmark)
    joined = every.join(hit, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("digest") == F.col("h_digest")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that share no window with the benchmark, with all their columns."""
    bad = bounded(checkpointed(hits(docs, benchmark)[1].select("h_id", "h_digest")))
    rows = docs.select(packed(docs).alias("__doc"), row_key().alias("__key"))
    return rows.join(bad, F.col("__key.id").eqNullSafe(F.col("h_id")) & (F.col("__key.digest") == F.col("h_digest")), "left_anti").select("__doc.*")
