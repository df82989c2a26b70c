"""What the operators of this subpackage share: words, row keys, scratch space, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and the ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side is broadcast only when a count has shown that it has no more rows than this.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; every other character stays (lower() would also change other alphabets)."""
    return F.translate(col, UPPER, LOWER)


def split_words(col: Column, separator: str = SPACE) -> Column:
    """The maximal runs of characters outside the separator, in order."""
    return F.array_remove(F.split(col, separator), "")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identity of a document: its id and a 128-bit digest of its text.

    Rows alike in both are the same document; equal ids with different texts are different ones.
    """
    return F.struct(F.col(doc_id).alias("id"), F.unhex(F.md5(text_of(text).cast("binary"))).alias("digest"))


def packed(df: DataFrame) -> Column:
    """A row as one struct, so that an operator's own columns can't clash with the table's."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def exploded(df: DataFrame, array: Column, name: str) -> DataFrame:
    """df with a row for each element of array, named name; none for an empty array.

    explode() alone would add a filter on the array's size below itself, which the optimizer pushes through the
    projections that build the array, so that they are evaluated again, and again for each element inside lambdas.
    """
    return df.select("*", F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def barrier() -> Column:
    """A column through which no filter that uses it is pushed: 0, though the optimizer doesn't know."""
    return F.shiftrightunsigned(F.monotonically_increasing_id(), 63)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir)."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir, or the session's checkpoint folder).

    Where none is set, a temporary one is made for a master on this machine alone, as in tests; on a cluster that raises.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and their lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """Marks a materialised side for broadcasting if a count shows it to be small enough; else the join shuffles.

    weight: what a row counts for, such as the length of an array in it.
    """
    small = df.limit(rows + 1).count() <= rows
    if small and weight is not None:
        small = (df.agg(F.sum(weight)).first()[0] or 0) <= 4 * rows
    return F.broadcast(df) if small else df


@contextmanager
def counted_broadcasts(spark: SparkSession) -> Iterator[None]:
    """What is planned within is broadcast only where the code says so, after a count. Spark's own estimate of a table's size takes an
    array for one element, so that of an exploded one is too low by the arrays' length."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: A group is hot if it has more rows than this and more than one in HOT_KEYS of all, so that fewer than HOT_KEYS groups are.
HOT_ROWS, HOT_KEYS = 20_000, 50_000


def spread_join(rows: DataFrame, groups: DataFrame, left: str, right: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups (one row for each value of right, its rows counted in n) on left = right, without n.

    Rows of a hot group are dealt over several tasks: its row in groups is copied and the rows draw one of the copies by
    their hash. Hot groups are known to the rows' side by a broadcast, which total (the sum of n, or more) bounds: fewer than
    HOT_KEYS groups can exceed their share of it. groups must be cheap to compute again or materialised.
    """
    most = max(HOT_ROWS, -(-total // HOT_KEYS))
    copies = F.ceil(F.col(n) / most).cast("int")
    if total <= most:
        return rows.join(groups.drop(n), F.col(left) == F.col(right), how)
    hot = groups.where(F.col(n) > most).select(F.col(right).alias("__hot"), copies.alias("__copies"))
    dealt = rows.join(F.broadcast(hot), F.col(left) == F.col("__hot"), "left").withColumn("__deal", F.when(F.col("__copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.col("__copies")).cast("int")))
    copied = groups.withColumn("__copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop(n)
    return dealt.join(copied, (F.col(left) == F.col(right)) & (F.col("__deal") == F.col("__copy")), how).drop("__hot", "__copies", "__deal", "__copy")


def small_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Lets Python workers of this session receive long texts in batches of few megabytes, unless a bound below that is set."""
    key, bound = "spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20
    if int(spark.conf.get(key).rstrip("bB") or 0) > bound:
        spark.conf.set(key, str(bound))


def release_memory() -> None:
    """Gives memory that a Python worker has freed back to the machine, as it waits for its next task with its heap."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
