"""Line deduplication by overlapping windows of three lines, in Spark expressions only.

Every three consecutive lines are hashed to 128 bits; windows without a word don't count. The first occurrence of a
window is the one with the smallest (doc_id, line), nulls first; all later ones are found by an aggregate over the
hashes, which is summed before the shuffle, and a join back of light rows (id, digest, position), in which a window that
very many documents share is dealt over several tasks. The lines that later occurrences cover, overlaps merged, are removed. Documents of one or
two lines have no window and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import barrier, bounded, checkpointed, exploded, packed, row_key, spread_join, text_of

WINDOW = 3


def lines_of(text: str = "text") -> Column:
    return F.split(text_of(text), "\n")


def windows(docs: DataFrame) -> DataFrame:
    """id, digest, at, hash: each window of each document."""
    rows = docs.select(row_key().alias("key"), lines_of().alias("l"))
    found = F.expr(f"""filter(transform(if(size(l) < {WINDOW}, cast(array() as array<int>), sequence(0, size(l) - {WINDOW})),
        i -> struct(i as at, concat_ws('\n', slice(l, i + 1, {WINDOW})) as x)), y -> y.x rlike '[^\\\\x20\\\\x09-\\\\x0D]')""")
    return exploded(rows.select("key", found.alias("all")), F.col("all"), "w").select("key.id", "key.digest", "w.at", F.unhex(F.md5(F.col("w.x").cast("binary"))).alias("hash"))


def removals(docs: DataFrame) -> DataFrame:
    """r_id, r_digest, gone (positions of lines to remove, each once) for the documents that lose lines."""
    every = windows(docs)
    first = checkpointed(every.groupBy("hash").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("hash").alias("of"), "first", "n"))
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    later = spread_join(every, first, "hash", "of", "n", total).where(F.struct("id", "at") > F.col("first"))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set("at"), lambda s: F.array(*[s + k for k in range(WINDOW)]))))
    return checkpointed(later.groupBy(F.col("id").alias("r_id"), F.col("digest").alias("r_digest")).agg(covered.alias("gone")))


def deduplicated(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """keep, then clean (the text that stays), n_lines and n_removed for each row of docs.

    A null text is one empty line. Rows alike in id and text are one document and fare alike; of rows with one id and
    different texts none precedes another. An empty table gives an empty one; other columns are not read.
    """
    gone = removals(docs)
    rows = docs.select(*keep, row_key().alias("key"), lines_of().alias("l"))
    joined = rows.join(bounded(gone, weight=F.size("gone")), F.col("key.id").eqNullSafe(F.col("r_id")) & (F.col("key.digest") == F.col("r_digest")), "left")
    joined = joined.withColumn("barrier", barrier())
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.col("gone")), lambda i: F.get("l", i))
    made = [c for c in rows.columns if c not in ("key", "l")]
    return joined.select(
        *made, F.array_join(F.when(F.col("gone").isNull(), F.col("l")).otherwise(stay), "\n").alias("clean"), "barrier",
        F.size("l").cast("long").alias("n_lines"), F.coalesce(F.size("gone").cast("long"), F.lit(0)).alias("n_removed"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text for each row of docs."""
    return deduplicated(docs, [F.col("doc_id").alias("doc_id")]).select("doc_id", "n_lines", "n_removed", F.col("clean").alias("text"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with all their columns, text without repeated lines and n_chars, if there is one, to match.

    A document that loses every line with a word is a repeat as a whole and goes.
    """
    made = deduplicated(docs, [packed(docs).alias("__doc")])
    made = made.where((F.col("n_removed") == F.col("barrier")) | F.col("clean").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("clean")).otherwise(F.col("__doc.text")), "n_chars": F.when(changed, F.length("clean").cast("long")).otherwise(F.col("__doc.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return made.select(*[(new[c] if c in new else F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns])
