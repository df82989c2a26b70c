"""Periodic runs, vector codes and MinHash near-duplicates against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.llm import minhash, periodic_runs, vector_codes
from tests.llm import helpers as H


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 11 periodic runs


def plain_runs(word, length, exponent):
    found = {}
    for q in range(1, len(word) // 2 + 1):
        i = 0
        while i + q < len(word):
            j = i
            while j + q < len(word) and word[j] == word[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(length, exponent * q))


def some_words(r):
    letters, n = r.choice([1, 2, 2, 3, 6]), r.randrange(70)
    if r.random() < 0.5:
        return [r.randrange(letters) for _ in range(n)]
    made = []
    while len(made) < n:
        made += [r.randrange(letters) for _ in range(r.randrange(1, 7))] * r.randrange(1, 7)
    return made


def test_runs_equal_brute_force():
    r = random.Random(3)
    for _ in range(1500):
        word = some_words(r)
        assert periodic_runs.runs(word) == plain_runs(word, 2, 2)
        assert periodic_runs.frequent_runs(np.array(word, np.int64)) == plain_runs(word, 6, 4)
        assert periodic_runs.frequent_runs(np.array(word, np.int64), 4, 3) == plain_runs(word, 4, 3)


def test_factors_are_the_longest_earlier_pieces():
    r = random.Random(4)
    for _ in range(300):
        word, b = some_words(r), 0
        for size, seen in periodic_runs.factors(word):
            occurs = lambda n, b=b: [i for i in range(b) if word[i : i + n] == word[b : b + n]]
            assert (seen < 0 and size == 1 and not occurs(1)) or (word[seen : seen + size] == word[b : b + size] and seen < b)
            assert b + size == len(word) or seen < 0 or not occurs(size + 1)
            b += size
        assert b == len(word)


def test_long_runs_of_all_kinds_are_linear():
    fibonacci, before = [0, 1], [0]
    while len(fibonacci) < 30_000:
        fibonacci, before = fibonacci + before, fibonacci
    assert periodic_runs.runs([7] * 50_000, 6, 4) == [(0, 50_000, 1)]
    assert periodic_runs.runs(list(range(900)) * 60, 6, 4) == [(0, 54_000, 900)]
    assert periodic_runs.runs(fibonacci, 6, 4) == []
    assert len(periodic_runs.stretches(np.arange(200_000))) == 0
    wide = np.concatenate([np.arange(1 << 20), np.tile(np.arange(5), 9)])
    assert periodic_runs.frequent_runs(wide) == [((1 << 20), 45, 5)]


def planted(doc_id, text):
    words = H.SPACE.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def test_periodic_runs_of_documents(spark):
    r = random.Random(5)
    made = [(i, " ".join("w%d" % x for x in some_words(r)) + r.choice(["", " \t", "\n é x"])) for i in range(120)]
    made += [(500, None), (501, ""), (None, "a a a a a a a"), (502, "b " * 3000), (502, "b " * 3000), (503, " é " * 8)]
    docs = H.docs(spark, made)
    out = periodic_runs.find_runs(docs, periodic_runs.planted(F.col("doc_id"), F.col("text"))).withColumn("best", periodic_runs.longest()).withColumn("lines", periodic_runs.run_lines())
    want = []
    for doc_id, text in made:
        words = planted(doc_id, text)
        found = plain_runs(words, 6, 4)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda f: (-f[1], f[0], f[2]), default=None)
        want.append((doc_id, found, " ".join(w for i, w in enumerate(words) if i not in gone), best, "".join("%d,%d,%d\n" % f for f in found)))
    got = [(x.doc_id, [tuple(f) for f in x.runs], x.collapsed, x.best and tuple(x.best), x.lines) for x in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(bool(w[1]) for w in want) > 30
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


# 12 vector codes


def plain_codes(made):
    kept = sorted((r for r in made if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and r[1]), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[int(np.floor(np.float64(x) * 1024)) for x in r[1]] for r in kept]
    wide = len(whole[0]) // 4
    parts = [[v[p * wide : (p + 1) * wide] for v in whole] for p in range(4)]
    books = [[list(x) for x in part[:256]] for part in parts]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            at = [near(x, books[p])[1] for x in parts[p]]
            for e in set(at):
                own = [x for x, a in zip(parts[p], at, strict=True) if a == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    final = [[near(x, books[p]) for x in parts[p]] for p in range(4)]
    sums = {}
    for i, r in enumerate(kept):
        sums[r[2]] = sums.get(r[2], 0) + sum(final[p][i][0] for p in range(4))
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(r[0], "".join("%02x" % final[p][i][1] for p in range(4)), sum(final[p][i][0] for p in range(4)), sums[r[2]], sha) for i, r in enumerate(kept)]


VECTORS = "vec_id long, embedding array<float>, label int, code string, n string"


@pytest.mark.parametrize("wide", [8, 32])
def test_vector_codes_equal_brute_force(spark, wide):
    r = np.random.default_rng(wide)
    made = [(int(i), [float(np.float32(x)) for x in np.round(r.normal(0, 0.3, wide), 2)], int(r.integers(4)) or None, "own", "own") for i in r.permutation(330)]
    made += [(900, None, 1, "", ""), (901, [None] + [0.0] * (wide - 1), 1, "", ""), (902, [float("nan")] * wide, 1, "", ""), (903, [float("-inf")] * wide, 1, "", "")]
    made += [(5, made[0][1], 2, "", ""), (5, made[0][1], 2, "", ""), (None, made[1][1], None, "", "")]
    got = rows(vector_codes.compress(spark.createDataFrame(made, VECTORS).repartition(3)))
    assert got == sorted(plain_codes(made), key=repr)
    odd = [(1000, [0.0] * (wide + 4), 1, "", ""), (1001, [0.0] * 3, 1, "", ""), (1002, [], 1, "", ""), (1003, [3e38] * wide, 1, "", "")]
    assert rows(vector_codes.compress(spark.createDataFrame([*made, *odd], VECTORS))) == got


def test_few_vectors_and_none(spark):
    made = [(3, [1.0] * 8, None, "", ""), (1, [-0.0001] * 8, None, "", ""), (2, [1.0] * 8, 7, "", "")]
    assert rows(vector_codes.compress(spark.createDataFrame(made, VECTORS))) == sorted(plain_codes(made), key=repr)
    assert vector_codes.compress(spark.createDataFrame(made, VECTORS).limit(0)).count() == 0


def test_partial_distances_are_exact_with_ties_and_large_numbers():
    r = np.random.default_rng(6)
    for reach in (2, 40, 1 << 27):
        book, x = r.integers(-reach, reach, (256, 11)), r.integers(-reach, reach, (1500, 11))
        book[100:] = book[:156]
        all_of = np.array([((x[:, None] - book[None, a : a + 64]) ** 2).sum(2) for a in range(0, 256, 64)]).transpose(1, 0, 2).reshape(len(x), 256)
        at, least = vector_codes.nearest(x, book)
        assert (at == all_of.argmin(1)).all() and (least == all_of.min(1)).all()
    at, least = vector_codes.nearest(np.zeros((0, 3), np.int64), np.zeros((2, 3), np.int64))
    assert len(at) == len(least) == 0


# 13 MinHash


def plain_copies(made):
    sets = []
    for _, text in made:
        w = H.SPACE.findall(H.lowered(text))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(made)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(made):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(made)), key=repr)


def near_texts(seed, groups=12, most=14):
    r, made = random.Random(seed), []
    vocabulary = ["w%d" % i for i in range(400)]
    for _ in range(groups):
        words = [r.choice(vocabulary) for _ in range(r.choice([3, 6, 40, 120, 200]))]
        for _ in range(r.randrange(1, most)):
            copy = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            if r.random() < 0.3:
                words = copy
            made.append((r.randrange(10**6), " ".join(copy).replace("w7", "W7")))
    return made


@pytest.mark.parametrize("limits", [None, (3, 300), (2, 1)])
def test_minhash_equals_brute_force(spark, monkeypatch, limits):
    if limits:
        monkeypatch.setattr(minhash, "CHUNK", limits[0])
        monkeypatch.setattr(minhash, "CHUNK_SHINGLES", limits[1])
    made = near_texts(8) + [(1, None), (2, ""), (3, " \n"), (None, "a b c"), (None, "z z"), (4, "A B c"), (4, "A B c"), (5, "x " * 5000), (6, "x " * 4000 + "y")]
    assert rows(minhash.near_duplicates(H.docs(spark, made))) == plain_copies(made)


def test_minhash_broadcasts_by_counts_only(spark, monkeypatch):
    """Spark's estimate of exploded bands is less than a byte a row, so at some sizes it would send them all through the driver."""
    plans, write = [], minhash._stored

    def stored(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(minhash, "_stored", stored)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    text = " ".join(f"w{i}" for i in range(40))
    found = minhash.near_duplicates(H.docs(spark, [(i, text + f" x{i % 3}") for i in range(12)] + [(20, "a b c d e f")]))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert any("SortMergeJoin" in p for p in plans) and all("__hot" in j or "w_id" in j for j in joins), joins
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(i, 0) for i in range(12)} | {(20, 20)}


def test_minhash_of_nothing(spark):
    docs = H.docs(spark, [(1, None), (2, "a b c d e f")])
    assert rows(minhash.near_duplicates(docs.limit(0))) == []
    assert rows(minhash.near_duplicates(docs)) == [(1, 0, 1, True), (2, 2, 2, True)]


def test_coordinates_are_one_permutation_shifted():
    """Coordinate k of a set is the least image of its scattered numbers moved by k, and agreement follows similarity."""
    r = np.random.default_rng(9)
    x = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    base = minhash.permuted(x.astype(np.uint32), minhash._FIRST)
    for k in (0, 1, 77):
        assert minhash.signature(x)[k] == minhash.permuted(base + np.uint32(k), minhash._SECOND).min()
    sample = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(minhash.permuted(sample.copy(), minhash._SECOND))) == len(sample)
    agree = []
    for _ in range(60):
        v = r.integers(0, 1 << 63, 1000).astype(np.uint64)
        agree.append(np.mean(minhash.signature(v[:850]) == minhash.signature(v)))
    assert abs(np.mean(agree) - 0.85) < 0.02
    assert min(agree) * minhash.COORDS > minhash.NEAR
