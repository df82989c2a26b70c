"""MinHash near-duplicates by circulant permutations, with links confirmed on full sets.

Signature: one permutation of 32-bit numbers scatters a set's shingles, a second one, circularly shifted by k, gives coordinate k
as the least image: COORDS coordinates come from two permutations. Four coordinates make a band; two sets of Jaccard
similarity 0.85 miss each other in all 28 bands with a probability of 1e-9.

Sets that are equal are one node from the start. Nodes that share a band meet in a bucket. There a search that visits each node once and
looks only among those not yet reached keeps a spanning forest of the pairs whose sizes allow the similarity and of whose coordinates
enough agree in their lowest bytes; its components are groups of candidates. The texts of a group meet in a task, and a
second search of the same kind links them by the exact similarity of their full sets of 64-bit shingle hashes. So no step
writes out all pairs of a group, whatever its size.

Groups above a bound are cut. Their first node is compared with all others, which are dealt over many tasks; what it reaches
needs no search among itself. The rest is dealt in chunks, and each chunk meets every other one and every chunk of what was
reached, so a group around one original costs its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from hindcast.llm.common import bounded, checkpointed, counted_broadcasts, row_key, scratch, small_batches, spread_join, text_of
from hindcast.llm.simhash import components

SHINGLE, SEED, PERCENT = 5, 42, 85
BANDS, WIDTH = 28, 4
COORDS = BANDS * WIDTH
#: Coordinates of which the lowest byte must agree; at a similarity of 0.85 fewer do with a probability of about 1e-9.
NEAR = 70
#: Nodes of a bucket, and shingles of a group of candidates, that one task holds.
CHUNK, CHUNK_SHINGLES = 32_768, 1 << 22

_ODD = np.array([xxhash.xxh64_intdigest(f"word {i}", SEED) | 1 for i in range(SHINGLE)], np.uint64)
_BAND = np.array([xxhash.xxh64_intdigest(f"row {i}", SEED) | 1 for i in range(WIDTH)], np.uint64)
_SHIFTS = np.arange(COORDS, dtype=np.uint32)[:, None]
_FIRST, _SECOND = np.uint32(xxhash.xxh32_intdigest("first", SEED)), np.uint32(xxhash.xxh32_intdigest("second", SEED))


def _mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def permuted(x: np.ndarray, key: np.uint32) -> np.ndarray:
    """x, overwritten with its image under the permutation of 32-bit numbers that key names."""
    x ^= key
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def shingles(text: bytes) -> np.ndarray:
    """The sorted 64-bit hashes of a UTF-8 text's distinct shingles; the whole sequence is one if it is shorter."""
    digest = xxhash.xxh64_digest
    words = np.frombuffer(b"".join([digest(w, SEED) for w in text.lower().split()]), dtype=">u8").astype(np.uint64)
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total += words[i : i + len(total)] * _ODD[i]
    return np.unique(_mix64(total))


def signature(values: np.ndarray) -> np.ndarray:
    """The COORDS circulant MinHash coordinates of a set of shingle hashes."""
    least = np.full(COORDS, 0xFFFFFFFF, np.uint32)
    scattered = permuted(values.astype(np.uint32), _FIRST)
    for a in range(0, len(scattered), 1024):
        np.minimum(least, permuted(scattered[a : a + 1024] + _SHIFTS, _SECOND).min(axis=1), out=least)
    return least


def band_keys(coords: np.ndarray) -> np.ndarray:
    rows = (coords.reshape(BANDS, WIDTH).astype(np.uint64) + np.uint64(1)) * _BAND
    return _mix64(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


class Prints:
    """Signatures, reduced to the lowest byte of each coordinate."""

    def __init__(self, data: list[bytes]):
        self.rows = np.frombuffer(b"".join(data), np.uint8).reshape(-1, COORDS)

    def near(self, x: int, others: np.ndarray) -> np.ndarray:
        return np.count_nonzero(self.rows[others] == self.rows[x], axis=1) >= NEAR


class Sets:
    """The full shingle sets of texts."""

    def __init__(self, data: list[bytes]):
        sets = [shingles(t) for t in data]
        self.size = np.array([len(s) for s in sets])
        self.start = np.cumsum(self.size) - self.size
        distinct, self.code = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(distinct), np.int8)

    def near(self, x: int, others: np.ndarray) -> np.ndarray:
        own, size = self.code[self.start[x] : self.start[x] + self.size[x]], self.size[others]
        begins = np.cumsum(size) - size
        self.mark[own] = 1
        held = self.mark[self.code[np.repeat(self.start[others] - begins, size) + np.arange(size.sum())]]
        self.mark[own] = 0
        both = np.add.reduceat(held, begins, dtype=np.int64)
        return 100 * both >= PERCENT * (self.size[x] + size - both)


def forest(sizes: np.ndarray, items: Prints | Sets) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the items that are near; sets whose sizes rule the similarity out aren't compared."""
    index = np.argsort(sizes, kind="stable")
    ordered = sizes[index]
    free, count, out = np.ones(len(index), bool), len(index), []
    for seed in range(len(index)):
        if not free[seed]:
            continue
        free[seed], count, queue = False, count - 1, [seed]
        while queue and count:
            x = queue.pop()
            lo, hi = np.searchsorted(ordered, -(-PERCENT * ordered[x] // 100)), np.searchsorted(ordered, 100 * ordered[x] // PERCENT, side="right")
            others = lo + np.flatnonzero(free[lo:hi])
            if not len(others):
                continue
            near = others[items.near(int(index[x]), index[others])]
            out += [(int(index[x]), int(index[y])) for y in near]
            queue += near.tolist()
            free[near] = False
            count -= len(near)
    return out


def _pairs(nodes: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch:
    pair = nodes[np.array(found, np.int64).reshape(-1, 2)]
    return pa.RecordBatch.from_arrays([pa.array(pair.min(axis=1)), pa.array(pair.max(axis=1))], names=["a", "b"])


def searched(dealt: DataFrame, kind: Callable) -> DataFrame:
    """a, b: links within each (key, i, j) of dealt, which holds node, size and data."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def close() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            return _pairs(whole["node"].to_numpy(), forest(whole["size"].to_numpy(), kind(whole["data"].to_pylist())))

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("key", "i", "j")]
            cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = tuple(int(c[a]) for c in cols)
                if held and now != key:
                    yield close()
                    held.clear()
                key = now
                held.append(batch.slice(a, b - a).select(["node", "size", "data"]))
        if held:
            yield close()

    return dealt.mapInArrow(find, "a long, b long").where("a < b")


def links(rows: DataFrame, limit: int, kind: Callable) -> DataFrame:
    """a, b (a < b): links that connect whatever is near within each key, directly or not.

    rows: key, node, size, data and weight, the sum of the weights of the key's nodes; a task holds about limit. rows must be
    materialised.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = rows.where(F.col("weight") <= limit).select("key", "node", "size", "data", F.lit(0).alias("i"), F.lit(0).alias("j"))
    large = rows.where(F.col("weight") > limit)
    if large.isEmpty():
        return searched(one.repartition(parts, "key").sortWithinPartitions("key", "i", "j", "node"), kind)
    heads = checkpointed(large.groupBy("key").agg(F.min(F.struct("node", "size", "data")).alias("head"), F.count("*").alias("n")).withColumnRenamed("key", "of"))
    total = heads.agg(F.sum("n")).first()[0]
    met = spread_join(large, heads, "key", "of", "n", total)
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("head", pa.int64()), ("reached", pa.bool_())])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reached = np.zeros(batch.num_rows, bool)
            keys, size, data = batch.column("key").to_numpy(), batch.column("size").to_numpy(), batch.column("data").to_pylist()
            heads = pa.Table.from_batches([batch]).column("head").combine_chunks()
            first, with_size, with_data = (heads.field(c) for c in ("node", "size", "data"))
            for k in np.unique(keys):
                at = np.flatnonzero(keys == k)
                own, h = [data[i] for i in at], int(at[0])
                fits = 100 * np.minimum(size[at], with_size[h].as_py()) >= PERCENT * np.maximum(size[at], with_size[h].as_py())
                reached[at] = fits & kind([*own, with_data[h].as_py()]).near(len(own), np.arange(len(own)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("node"), first, pa.array(reached)], schema=schema)

    known = checkpointed(met.select("key", "node", "size", "data", "head").mapInArrow(reach, from_arrow_schema(schema)))
    straight = known.where("reached and node != head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))
    left = bounded(checkpointed(known.where("not reached").groupBy("key").agg(F.count("*").alias("rest")).withColumnRenamed("key", "r_key")))
    chunk = lambda n: F.greatest(F.lit(1), F.ceil(n)).cast("int")
    state = known.select(F.col("key").alias("s_key"), F.col("node").alias("s_node"), "reached")
    cut = large.join(state, (F.col("key") == F.col("s_key")) & (F.col("node") == F.col("s_node"))).join(left, F.col("key") == F.col("r_key"))
    counts = heads.select(F.col("of").alias("c_key"), "n")
    cut = cut.join(bounded(counts), F.col("key") == F.col("c_key")).withColumn("per", F.col("weight") / F.col("n") / limit)
    cut = cut.withColumn("rests", chunk(F.col("rest") * F.col("per"))).withColumn("others", chunk((F.col("n") - F.col("rest")) * F.col("per")))
    spot = F.xxhash64("node")
    cut = cut.withColumn("own", F.when(F.col("reached"), F.pmod(spot, F.col("others"))).otherwise(F.pmod(spot, F.col("rests"))).cast("int"))
    rest = lambda n: F.sequence(F.lit(0), n - 1)
    # Tasks (i, j): two chunks of the rest; (i, rests + j): a chunk of the rest and one of what was reached.
    among = F.transform(rest(F.col("rests")), lambda s: F.struct(F.least(s, F.col("own")).alias("i"), F.greatest(s, F.col("own")).alias("j")))
    across = F.transform(rest(F.col("others")), lambda s: F.struct(F.col("own").alias("i"), (F.col("rests") + s).alias("j")))
    joins = F.transform(rest(F.col("rests")), lambda s: F.struct(s.alias("i"), (F.col("rests") + F.col("own")).alias("j")))
    cut = cut.select("key", "node", "size", "data", F.explode(F.when(F.col("reached"), joins).otherwise(F.concat(among, across))).alias("p")).select("key", "node", "size", "data", "p.i", "p.j")
    every = one.union(cut).repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return searched(every, kind).union(straight)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, and, but for empty sets, set (a 128-bit digest of it), bands and low."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_shingles", pa.int64()), ("set", pa.binary()), ("bands", pa.list_(pa.int64())), ("low", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, made = [], []
            for text in batch.column("text").to_pylist():
                values = shingles(text)
                n.append(len(values))
                if len(values):
                    coords = signature(values)
                    made.append((xxhash.xxh3_128_digest(values.tobytes(), SEED), band_keys(coords), coords.astype(np.uint8).tobytes()))
                else:
                    made.append((None, None, None))
            columns = list(zip(*made, strict=True)) if made else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest").cast(pa.binary()), pa.array(n, pa.int64()), *(pa.array(c, schema.field(i + 3).type) for i, c in enumerate(columns))], schema=schema)

    key = row_key()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key["digest"].alias("digest"), text_of("text").cast("binary").alias("text"))
    return rows.mapInArrow(make, from_arrow_schema(schema))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def candidates(nodes: DataFrame) -> DataFrame:
    """node, root: nodes that share bands and whose signatures are near, directly or through others, by group."""
    bands = nodes.select("node", F.explode("bands").alias("key"))
    full = checkpointed(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "of").withColumn("weight", F.col("n")))
    total = full.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = spread_join(bands, full, "key", "of", "n", total).select(F.col("node").alias("h_node"), "key", "weight")
    members = _stored(held.join(nodes.select("node", F.col("n_shingles").alias("size"), F.col("low").alias("data")), F.col("h_node") == F.col("node")).select("key", "node", "size", "data", "weight"), "buckets")
    found = components(links(members, CHUNK, Prints).distinct()).withColumnRenamed("fp", "node")
    return found.union(found.select("root", "root").distinct())


def confirmed(docs: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b: links between nodes of a group by the exact similarity of their full sets; groups: node, root, without single ones."""
    in_group = checkpointed(groups.withColumnRenamed("node", "g_node").join(nodes, F.col("g_node") == F.col("node")).select("root", "node", "n_shingles", "rep"))
    heavy = in_group.groupBy("root").agg(F.sum("n_shingles").alias("weight"), F.count("*").alias("n")).withColumnRenamed("root", "w_root")
    total = in_group.count()
    wanted = spread_join(in_group, heavy, "root", "w_root", "n", total)
    wanted = bounded(checkpointed(wanted.select(F.col("root").alias("key"), "node", F.col("n_shingles").alias("size"), "weight", F.col("rep.doc_id").alias("w_id"), F.col("rep.digest").alias("w_digest"))))
    own = docs.select(F.col("doc_id").cast("long").alias("d_id"), row_key()["digest"].alias("d_digest"), text_of("text").cast("binary").alias("data"))
    texts = own.join(wanted, F.col("d_id").eqNullSafe(F.col("w_id")) & (F.col("d_digest") == F.col("w_digest")))
    return links(_stored(texts.select("key", "node", "size", "data", "weight"), "candidates"), CHUNK_SHINGLES, Sets)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id is component_id) for each row of docs.

    component_id is the smallest doc_id of all documents that can be reached over links: sets whose similarity is PERCENT or more.
    A null or empty text has an empty set and is linked with nothing, so it is its own component. Null ids are ignored
    for component_id, which is null if there is no other; repeated rows are rows of one component; an
    empty table gives an empty one; other columns are not read.
    """
    with counted_broadcasts(docs.sparkSession):
        rows, where, total = placed_sets(docs)
    # This join is planned later, with the session's settings, so a hint keeps Spark from broadcasting by its estimate.
    some = spread_join(rows.where("n_shingles > 0").select("doc_id", "n_shingles", "set"), where.hint("merge"), "set", "w_set", "n", total).select("doc_id", "n_shingles", "component_id")
    none = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.union(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def placed_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """sketches() of docs; w_set, component_id and n, its rows, of each distinct set; and how many rows have a set. All of it is materialised."""
    rows = _stored(sketches(docs), "sketches")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    first = lambda c: F.first(c).alias(c)
    nodes = rows.where("n_shingles > 0").groupBy("set").agg(first("n_shingles"), first("bands"), first("low"), F.min("doc_id").alias("least"), F.min(rank).alias("rep"), F.count("*").alias("n"))
    nodes = _stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = components(confirmed(docs, nodes, candidates(nodes)).distinct()).withColumnRenamed("fp", "r_node")
    placed = checkpointed(nodes.join(found, F.col("node") == F.col("r_node"), "left").select("set", F.coalesce("root", "node").alias("root"), "least", "n"))
    classes, total = placed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    best = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("sets")).withColumnRenamed("root", "b_root")
    where = checkpointed(spread_join(placed, best, "root", "b_root", "sets", classes).select(F.col("set").alias("w_set"), "component_id", "n"))
    return rows, where, total
