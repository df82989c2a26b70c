"""SimHash near-duplicates by pivot distance tables.

Fingerprints are computed by Python workers, which hash the shingles of whole texts. Documents of one fingerprint
are linked at once by an aggregate; what follows works on distinct fingerprints only.

Candidates: two fingerprints that differ in at most MAX_BITS = 4 of 64 bits agree in at least three of seven blocks
of bits, so they meet in one of the 35 tables keyed by three blocks. Within a bucket, the Hamming distances of every
fingerprint to PIVOTS reference fingerprints are tabulated once; by the triangle inequality a pair is discarded if
any coordinate differs by more than MAX_BITS, and survivors are verified bit by bit. A search that visits each
fingerprint of a bucket once and looks only among those not yet reached gives the links of a spanning forest, so a
dense group costs its size and not its square. Buckets of more than CHUNK fingerprints are dealt out as pairs of
chunks, which bounds memory and loses no pair.

Components of the links: alternating large-star and small-star rounds, checkpointed, until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from hindcast.llm.common import bounded, checkpointed, packed, row_key, small_batches, spread_join, text_of

SHINGLE, SEED, MAX_BITS = 4, 42, 4
BLOCK_BITS = (9, 9, 9, 9, 9, 9, 10)
AGREE = len(BLOCK_BITS) - MAX_BITS
CHUNK = 32_768
PIVOTS = 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_OFFSETS = np.arange(8, dtype=np.int16) * 256


def pivots(n: int = PIVOTS) -> np.ndarray:
    """n fixed reference fingerprints: the hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(n)], dtype=np.uint64)


def fingerprint(text: bytes) -> int:
    """The SimHash of a UTF-8 text; 0 without words. Only A-Z are lowered and only ASCII space parts words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends)]
    digest, counts, total = xxhash.xxh64_digest, np.zeros(2048, dtype=np.int64), max(1, n - SHINGLE + 1)
    for a in range(0, total, 1 << 16):
        b = min(total, a + (1 << 16))
        spans = zip(starts[a:b], ends[a + SHINGLE - 1 : b + SHINGLE - 1], strict=True) if n >= SHINGLE else [(0, len(joined))]
        raw = np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in spans]), dtype=np.uint8)
        counts += np.bincount((raw.reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048)
    ones = np.einsum("kv,vb->kb", counts.reshape(8, 256), _BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: dict[str, tuple[Column, pa.DataType]]) -> DataFrame:
    """The columns of keep and fp (64 bits as a long) for each row of docs."""
    small_batches(docs.sparkSession)
    types = {k: t for k, (_, t) in keep.items()}
    schema = pa.schema([*types.items(), ("fp", pa.int64())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(t) for k, t in types.items()), pa.array(fp)], schema=schema)

    rows = docs.select(*[c.alias(k) for k, (c, _) in keep.items()], text_of("text").cast("binary").alias("text"))
    return rows.mapInArrow(make, from_arrow_schema(schema))


def tables(nodes: DataFrame) -> DataFrame:
    """t, k, fp: each fingerprint under the keys of all tables; t is a table's number, k the bits of its blocks."""
    start, at = 0, []
    for width in BLOCK_BITS:
        at.append((start, width))
        start += width
    masks = [sum(((1 << at[b][1]) - 1) << at[b][0] for b in chosen) for chosen in combinations(range(len(at)), AGREE)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*[F.struct(F.lit(i).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("k")) for i, m in enumerate(masks)])
    return nodes.select("fp", F.explode(keys).alias("x")).select("x.t", "x.k", "fp")


def linked(points: np.ndarray, distances: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the points within MAX_BITS of each other.

    distances: the table of the points' distances to the pivots.
    """
    index = np.argsort(distances[:, 0], kind="stable")
    points, distances = points[index], distances[index]
    first = np.ascontiguousarray(distances[:, 0])
    free, count, out = np.ones(len(index), bool), len(index), []
    for seed in range(len(index)):
        if not free[seed]:
            continue
        free[seed], count, queue = False, count - 1, [seed]
        while queue and count:
            x = queue.pop()
            # Sorted by the first coordinate, so that its band is a slice.
            lo, hi = np.searchsorted(first, (int(distances[x, 0]) - MAX_BITS, int(distances[x, 0]) + MAX_BITS + 1))
            near = lo + np.flatnonzero(free[lo:hi])
            for m in range(1, distances.shape[1], 5):
                near = near[(np.abs(distances[near, m : m + 5] - distances[x, m : m + 5]) <= MAX_BITS).all(axis=1)]
            near = near[np.bitwise_count(points[near] ^ points[x]) <= MAX_BITS]
            if len(near):
                out += [(int(index[x]), int(index[y])) for y in near]
                queue += near.tolist()
                free[near] = False
                count -= len(near)
    return out


def links(nodes: DataFrame) -> DataFrame:
    """a, b (a < b): links between distinct fingerprints that connect all that are within MAX_BITS, directly or not."""
    rows = tables(nodes)
    full = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    held = rows.join(full, ["t", "k"])
    # Large buckets: each fingerprint goes to every pair of chunks that has its own.
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda s: F.struct(F.least(s, F.col("own")).alias("i"), F.greatest(s, F.col("own")).alias("j")))
    dealt = held.withColumn("chunks", chunks).withColumn("own", own).select("t", "k", "fp", F.explode(pairs).alias("p")).select("t", "k", "p.i", "p.j", "fp")
    dealt = dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference, held, key = pivots(), [], None

        def close() -> pa.RecordBatch | None:
            points = np.concatenate(held).view(np.uint64)
            table = np.bitwise_count(points[:, None] ^ reference).astype(np.int8)
            found = [(points[x], points[y]) for x, y in linked(points, table)]
            if not found:
                return None
            pair = np.array(found, dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair.min(axis=1)), pa.array(pair.max(axis=1))], schema=schema)

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "k", "i", "j")]
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1), len(fp)] if len(fp) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = tuple(int(c[a]) for c in cols)
                if held and now != key:
                    if (made := close()) is not None:
                        yield made
                    held = []
                key = now
                held.append(fp[a:b].copy())
        if held and (made := close()) is not None:
            yield made

    return dealt.mapInArrow(find, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """fp, root: for each fingerprint in edges the smallest that it is connected with."""

    def star(rows: DataFrame, large: bool, edges: int) -> DataFrame:
        """rows: u, v. Large: v of u's neighbours above u go to the least of all; small: u and its lower neighbours do."""
        rows = rows.union(rows.select("v", "u")).toDF("u", "v") if large else rows.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"), "n")
        joined = spread_join(rows, least, "u", "w", "n", 2 * edges)
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    now, before = checkpointed(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        before, now = state, checkpointed(star(star(now, True, state[0]), False, state[0]))


def grouped(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows (with fp) and component_id, the smallest id_col reachable; rows must be materialised."""
    nodes = checkpointed(rows.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")))
    roots = components(links(nodes.select("fp"))).withColumnRenamed("fp", "r_fp")
    placed = checkpointed(nodes.join(roots, F.col("fp") == F.col("r_fp"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n"))
    prints, total = placed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    best = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints")).withColumnRenamed("root", "b_root")
    where = spread_join(placed, best, "root", "b_root", "prints", prints).select(F.col("fp").alias("w_fp"), "component_id", "n")
    return spread_join(rows.withColumnRenamed("n", "__n") if "n" in rows.columns else rows, where, "fp", "w_fp", "n", total).drop("w_fp").withColumnRenamed("__n", "n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs.

    A null or empty text has fingerprint zero; null ids are ignored for component_id, which is null if there is no
    other; repeated rows are rows of one component; an empty table gives an empty one; other columns are not read.
    """
    rows = checkpointed(fingerprints(docs, {"doc_id": (F.col("doc_id").cast("long"), pa.int64())}))
    return grouped(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the document with the smallest id (null last,
    then by its text's digest) stays, once, with all its columns."""
    key = row_key()
    rows = fingerprints(docs, {"doc_id": (F.col("doc_id").cast("long"), pa.int64()), "digest": (key["digest"], pa.binary())})
    rows = checkpointed(rows.groupBy("doc_id", "digest", "fp").agg(F.count("*").alias("n")))
    nodes = rows.withColumn("rank", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    best = grouped(nodes, "rank")
    first = checkpointed(best.select("doc_id", "digest", "n", (F.col("rank") == F.col("component_id")).alias("first")))
    same = lambda d, p: F.col("__key.id").cast("long").eqNullSafe(F.col(f"{p}_id")) & (F.col("__key.digest") == F.col(f"{p}_digest"))
    named = lambda d, p: d.select(F.col("doc_id").alias(f"{p}_id"), F.col("digest").alias(f"{p}_digest"))
    gone, again = bounded(named(first.where("not first"), "g")), bounded(named(first.where("first and n > 1"), "n"))
    kept = docs.select(packed(docs).alias("__doc"), key.alias("__key")).join(gone, same(gone, "g"), "left_anti")
    once = kept.join(again, same(again, "n"), "left_anti")
    twice = kept.join(again, same(again, "n"), "left_semi").dropDuplicates(["__key"])
    return once.union(twice).select("__doc.*")
