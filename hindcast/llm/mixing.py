"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in Spark expressions only.

Each document draws an exponential key -ln(u) / w: u comes from a hash of its id and a seed, w is its quality
weight. Within a source, documents are taken by ascending key until the words taken reach the source's budget, so
better documents come first more often. A budget of at least the source's size takes complete epochs of every
document first and only then a fraction by key.

No source is sorted in one task. Keys fall into BUCKETS equal parts of their range, sizes are summed by source
and bucket before the shuffle, a running sum over those sums finds the bucket in which the budget ends, and only
the documents of that bucket are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hindcast.llm.common import SPACE, bounded, checkpointed, packed, split_words, text_of

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_EPOCHS = 2
BUCKETS = 65_536
SEED = "mix-1"
HASH_DIGITS = 12
#: What the quality weight counts as symbols, and how much they count.
SYMBOLS, SYMBOLS_COUNT = "#*$%&|<>", 3.0


def quality_weight(text: Column) -> Column:
    """In [0.1, 1], from two measures of the quality rules: (1 - SYMBOLS_COUNT * symbols a character outside white space)
    * (1 - repeated lines of all lines with a word), never below a tenth."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))) / F.greatest(F.length(F.regexp_replace(text, SPACE, "")), F.lit(1))
    repeats = (F.size(lines) - F.size(F.array_distinct(lines))) / F.greatest(F.size(lines), F.lit(1))
    return F.greatest(F.lit(0.1), (F.lit(1.0) - F.lit(SYMBOLS_COUNT) * symbols) * (F.lit(1.0) - repeats))


def uniform(doc_id: Column, digest: Column, seed: str) -> Column:
    """In (0, 1), from the MD5 of the seed, the id and the text's digest; the same in every run. A null id draws by text alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest)), 1, HASH_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**HASH_DIGITS))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target for a table of source and source_size (a row for each source).

    Each source gets its weight's share of SHARE_PERCENT of all words; a target above MOST_EPOCHS times the
    source's size stops there and the excess goes to the rest by weight, again and again. The end of that is
    min(MOST_EPOCHS * size, level * weight) with one level for all, found by a running sum over the sources in the
    order in which they fill up.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("most", F.lit(MOST_EPOCHS) * F.col("source_size"))
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"full": F.coalesce(F.sum("most").over(order), F.lit(0)), "before": F.coalesce(F.sum("weight").over(order), F.lit(0)), "all": F.sum("source_size").over(Window.partitionBy()), "weights": F.sum("weight").over(Window.partitionBy())})
    level = (F.col("all") * F.lit(SHARE_PERCENT / 100) - F.col("full")) / (F.col("weights") - F.col("before"))
    # The level at the first source that it does not fill up; none: every source is full.
    rows = rows.withColumn("level", F.min(F.when(F.col("most") > level * F.col("weight"), F.struct((F.col("most") / F.col("weight")).alias("x"), F.col("before").alias("y"), level.alias("level")))).over(Window.partitionBy())["level"])
    return rows.select("source", "source_size", F.when(F.col("level").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """keep, then size, source_size, target and taken (words, repeats counted) for each row of docs.

    A null text has no words; a null source is a source of its own, last; rows alike in id and text draw equal keys, and ties
    are broken by id and text, so that rows alike in everything are exchangeable. An empty table gives an empty one.
    Within the bucket where a budget ends, a document is taken if at least half of it fits.
    """
    text = text_of("text")
    digest = F.md5(text.cast("binary"))
    key = -F.ln(uniform(F.col("doc_id"), digest, SEED)) / quality_weight(text)
    rows = docs.select(*keep, F.col("source").alias("s"), F.col("doc_id").alias("id"), digest.alias("digest"), F.size(split_words(text, SPACE)).cast("long").alias("size"), key.alias("key"))
    rows = rows.withColumn("bucket", F.floor(F.lit(BUCKETS) * (F.lit(1.0) - F.exp(-F.col("key")))))
    return rows


def sums(rows: DataFrame) -> DataFrame:
    """Words by source and bucket."""
    return checkpointed(rows.groupBy("s", "bucket").agg(F.sum("size").alias("words")))


def budgets(by_bucket: DataFrame) -> DataFrame:
    """A row for each source: target, epochs, the bucket in which the fraction's budget ends and the words left for it."""
    goal = targets(by_bucket.groupBy(F.col("s").alias("source")).agg(F.sum("words").alias("source_size")))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.lit(MOST_EPOCHS), F.floor(F.col("target") / F.col("source_size")))).otherwise(0))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    w = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = by_bucket.withColumn("upto", F.sum("words").over(w)).join(goal, F.col("s").eqNullSafe(F.col("source")))
    end = F.min_by(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("left")), F.when(F.col("upto") > F.col("rest"), F.col("bucket")))
    return run.groupBy(F.col("source").alias("b_source"), "source_size", "target", "epochs").agg(end.alias("end"))


def apply_budgets(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """rows with source_size, target and taken."""
    all_ = rows.join(budget, F.col("s").eqNullSafe(F.col("b_source")))
    # Without an end, the whole source fits (an epoch more than the floor, by rounding); never beyond the most epochs.
    last = F.col("bucket") == F.col("end.bucket")
    outer = all_.where(F.col("end").isNull() | ~last).withColumn("more", F.when(F.col("end").isNull(), F.lit(0)).otherwise((F.col("bucket") < F.col("end.bucket")).cast("int")))
    w = Window.partitionBy("s").orderBy("key", F.col("id"), "digest").rowsBetween(Window.unboundedPreceding, 0)
    inner = all_.where(last).withColumn("upto", F.sum("size").over(w)).withColumn("more", (F.col("upto") - F.col("size") / 2 <= F.col("end.left")).cast("int")).drop("upto")
    return outer.unionByName(inner).withColumn("taken", F.col("size") * (F.col("epochs") + F.col("more")))


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of docs."""
    rows = checkpointed(mix(docs, [F.col("doc_id").alias("doc_id")]))
    return apply_budgets(rows, checkpointed(budgets(sums(rows)))).select("doc_id", "size", "source_size", "target", "taken")


def take_mixture(docs: DataFrame) -> DataFrame:
    """The rows of docs of which words are taken, with all their columns and then size, source_size, target and taken
    (with underscores after the name where docs has such a column).

    Documents are read twice, so that no text is shuffled but that of the bucket in which a budget ends.
    """
    budget = bounded(checkpointed(budgets(sums(mix(docs, [])))))
    taken = apply_budgets(mix(docs, [packed(docs).alias("__doc")]), budget).where("taken > 0")
    there, new = {c.lower() for c in docs.columns}, {}
    for name in ("size", "source_size", "target", "taken"):
        new[name] = name
        while new[name].lower() in there:
            new[name] += "_"
    return taken.select("__doc.*", *[F.col(k).alias(v) for k, v in new.items()])
