"""Product codes of vectors, learned and assigned in whole numbers by partial-distance search.

A vector's components become integers and are cut into PARTS parts; every part has a codebook of at most ENTRIES
entries. Each round reads all vectors: tasks assign their rows and send one row of sums for each used entry, Spark adds these, and
only the sums of PARTS * ENTRIES entries reach the driver, however many vectors there are.

Search: dimensions are taken in descending variance of the codebook. Every few of them the entry that leads is completed,
which may lower the vector's best complete distance, and entries whose integer sum strictly exceeds that drop out. While
most entries are live they are summed side by side, then only live ones are. What is left at the end is complete, so
the nearest entry is exact, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import checkpointed, scratch, small_batches, spread_join

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Dimensions taken between two masks while most entries are live, and the live share from which only live ones are summed.
STEP, SPARSE = 3, 0.2
#: Vectors searched at a time: the sums of all their entries stay within a few megabytes.
BLOCK = 1024


def largest(width: int) -> int:
    """The largest integer component of a vector of that width for which every error fits 64 bits."""
    return int((((1 << 63) - 1) // max(1, width)) ** 0.5) // 2 - 1


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    bad = F.exists(vector, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return vector.isNotNull() & ~bad


def first_vectors(rows: DataFrame, n: int) -> list:
    """The vectors of the n smallest ids; null ids come last, equal ids are ordered by their vectors."""
    return [r[0] for r in rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(n).select("vector").collect()]


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, vector (integers), label of the vectors that get a code, written to the shared folder."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    rows = rows.where(finite(F.col("vector")) & (F.size("vector") > 0) & (F.size("vector") % PARTS == 0))
    first = first_vectors(rows, 1)
    width = len(first[0]) if first else PARTS
    fits = (F.size("vector") == width) & (F.greatest(F.array_max("vector"), -F.array_min("vector")) < largest(width) / SCALE)
    path = scratch(vectors.sparkSession, "vectors")
    rows.where(fits).withColumn("vector", F.transform("vector", lambda x: F.floor(x * SCALE))).write.parquet(path)
    return vectors.sparkSession.read.parquet(path)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest entry of the codebook (ties: the lowest) and its squared distance; integers."""
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    reach = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.int32 if (2 * reach) ** 2 * book.shape[1] < 1 << 31 else np.int64
    x, book = x[:, order].astype(kind), book[:, order].astype(kind)
    columns, width = np.ascontiguousarray(book.T), book.shape[1]
    at, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    complete = lambda rows, entries: ((rows - book[entries]) ** 2).sum(axis=1, dtype=kind)
    for lo in range(0, len(x), BLOCK):
        rows, d = x[lo : lo + BLOCK], 0
        best = np.full(len(rows), np.iinfo(kind).max, kind)
        partial, step = np.zeros((2, len(rows), len(book)), kind)
        while True:
            for d in range(d, min(d + STEP, width)):
                np.subtract(rows[:, d : d + 1], columns[d], out=step)
                np.multiply(step, step, out=step)
                partial += step
            d += 1
            # The entry that leads is completed; sums beyond the best complete one drop out.
            best = np.minimum(best, complete(rows, partial.argmin(axis=1)))
            live = partial <= best[:, None]
            if d >= width or np.count_nonzero(live) < SPARSE * live.size:
                break
        r, e = np.nonzero(live)
        total = partial[r, e]
        for d in range(d, width):
            gap = rows[r, d] - columns[d][e]
            total += gap * gap
            live = total <= best[r]
            r, e, total = r[live], e[live], total[live]
        starts = np.flatnonzero(np.diff(r, prepend=-1))
        least[lo : lo + len(rows)] = np.minimum.reduceat(total, starts)
        at[lo : lo + len(rows)] = np.minimum.reduceat(np.where(total == least[lo + r], e, len(book)), starts)
    return at, least


def _integers(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def codebook_sums(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """part, entry, n and s0, s1, ...: how many parts each used entry has been assigned and their sums by component."""
    wide = books[0].shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            whole = _integers(batch, wide * PARTS)
            for p, book in enumerate(books):
                x = whole[:, p * wide : (p + 1) * wide]
                at, _ = nearest(x, book)
                n[p] += np.bincount(at, minlength=len(book))
                by = np.argsort(at, kind="stable")
                starts = np.flatnonzero(np.diff(at[by], prepend=-1))
                if len(starts):
                    sums[p][at[by][starts]] += np.add.reduceat(x[by], starts, axis=0)
        for p in range(PARTS):
            used = np.flatnonzero(n[p])
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int64)), pa.array(used), pa.array(n[p][used]), *(pa.array(sums[p][used, i]) for i in range(wide))], names=["part", "entry", "n", *(f"s{i}" for i in range(wide))])

    names = ["n", *(f"s{i}" for i in range(wide))]
    made = rows.select("vector").mapInArrow(add, "part long, entry long, " + ", ".join(f"{c} long" for c in names))
    return made.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names])


def learn(rows: DataFrame) -> list[np.ndarray]:
    """The codebooks after ROUNDS rounds over all rows; an entry that no part was nearest to stays as it is."""
    start = first_vectors(rows, ENTRIES)
    books = np.split(np.array(start, np.int64), PARTS, axis=1) if start else []
    for _ in range(ROUNDS if books else 0):
        books = [b.copy() for b in books]
        for part, entry, n, *sums in codebook_sums(rows, books).collect():
            books[part][entry] = np.array(sums, np.int64) // n
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray], id_type: str, label_type: str) -> DataFrame:
    """id, label, code (two hex digits for each part) and error of each row."""
    wide = books[0].shape[1]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _integers(batch, wide * PARTS)
            found = [nearest(whole[:, p * wide : (p + 1) * wide], b) for p, b in enumerate(books)]
            codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(np.sum([d for _, d in found], axis=0))], names=["id", "label", "code", "error"])

    return rows.mapInArrow(make, f"id {id_type}, label {label_type}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id_col, code, error, label_error and codebooks_sha256 of each vector that gets a code.

    A null vector and one that holds nulls, NaN or infinities are dropped. So is one that can't be cut like the
    others: an empty one, one whose length isn't a multiple of PARTS or differs from that of the smallest id's, and one with a component
    whose squared error wouldn't fit 64 bits (beyond about 185,000 at 64 dimensions). Null ids come last and repeated
    rows count as often as they occur; equal ids are ordered by their vectors. Fewer than ENTRIES vectors give smaller
    codebooks, an empty table an empty result. Null labels are one label; other columns are not read.
    """
    small_batches(vectors.sparkSession)
    rows = kept_vectors(vectors, id_col, vector_col, label_col)
    types, books = dict(rows.dtypes), learn(rows)
    if not books:
        return rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = checkpointed(encode(rows, books, types["id"], types["label"]).withColumn("key", F.struct("label")))
    groups = checkpointed(coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")).withColumnRenamed("key", "of"))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = spread_join(coded, groups, "key", "of", "n", total)
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
