"""Periodic runs of words by Kolpakov and Kucherov's algorithm.

A run is a maximal stretch that repeats with its smallest period at least twice. Words become numbers; the suffix
automaton of a stretch gives its factorisation into longest earlier seen pieces; at each border between two factors Main's
algorithm finds the runs that touch it, by longest common extensions to both sides within a window of the two factors'
lengths; a run that lies strictly inside a factor is a copy of one inside the factor's earlier occurrence and is
shifted from there. Everything is linear in the number of words, up to sorting the runs.

Where only runs of many repeats are wanted, a text is first cut where none can be: in a run of four periods and five words
every sequence of three words occurs at least three times, so a stretch between words whose sequences are rarer is
searched by itself, or not at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import release_memory, small_batches, split_words, text_of

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Stretches above this many words end with the worker's freed memory given back.
LONG = 100_000


def factors(word: list[int]) -> list[tuple[int, int]]:
    """(length, start of the earlier occurrence, or -1 for a new letter) of each factor, left to right.

    A factor is the longest piece that also begins earlier, overlaps allowed. A state of the automaton keeps its first
    way in two lists and further ways in a dictionary, as most states have one.
    """
    letter, target, more = [-1], [-1], [None]
    link, length, ends = [-1], [0], [-1]
    last = 0

    def way(state: int, c: int) -> int:
        if letter[state] == c:
            return target[state]
        return -1 if more[state] is None else more[state].get(c, -1)

    for i, c in enumerate(word):
        new = len(length)
        letter.append(-1), target.append(-1), more.append(None)
        length.append(length[last] + 1), ends.append(i), link.append(0)
        p = last
        while p >= 0 and (to := way(p, c)) < 0:
            if letter[p] < 0:
                letter[p], target[p] = c, new
            else:
                if more[p] is None:
                    more[p] = {}
                more[p][c] = new
            p = link[p]
        if p >= 0:
            if length[to] == length[p] + 1:
                link[new] = to
            else:
                twin = len(length)
                letter.append(letter[to]), target.append(target[to]), more.append(None if more[to] is None else dict(more[to]))
                length.append(length[p] + 1), ends.append(ends[to]), link.append(link[to])
                while p >= 0 and way(p, c) == to:
                    if letter[p] == c:
                        target[p] = twin
                    else:
                        more[p][c] = twin
                    p = link[p]
                link[to] = link[new] = twin
        last = new
    made, i, n = [], 0, len(word)
    while i < n:
        state, size, seen = 0, 0, -1
        while i + size < n:
            to = way(state, word[i + size])
            if to < 0 or ends[to] >= i + size:
                break
            state, size, seen = to, size + 1, ends[to] - size
        made.append((max(size, 1), seen if size else -1))
        i += max(size, 1)
    return made


def prefixes(s: list[int]) -> list[int]:
    """For each position how far the sequence from there agrees with the sequence's beginning."""
    n = len(s)
    z, lo, hi = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def crossing(word: list[int], made: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, period), end exclusive, of the runs that touch a border of factors; periods may be multiples.

    A run is looked for at the last border that it touches, so it ends within the factor after it. If its larger
    part lay beyond the two factors' lengths to the left, the left factor and the next word would occur
    earlier together, and the factor would have been longer.
    """
    b, before = 0, 0
    for size, _ in [*made, (0, -1)]:
        low = max(0, b - 2 * before - size)
        t, u = word[low:b], word[b : b + size + 1]
        back, whole = t[::-1], len(t) if low else len(t) + 1
        behind, ahead = prefixes([*back, -1, *reversed(u), *back]), prefixes(u)
        # The period lies to the right: how far u goes on from p on, and t's end agrees with what ends before p.
        for p in range(1, size + 1):
            forth = ahead[p] if p < len(u) else 0
            left = behind[len(t) + 1 + len(u) - p]
            if forth + left >= p and p + forth <= size and left < whole:
                yield b - left, b + p + forth, p
        # It lies to the left; a run that fills the window to its beginning ends at the border and has been found before.
        behind, ahead = prefixes(back), prefixes([*u, -1, *t, *u])
        for p in range(1, min(before + size, len(t)) + 1):
            forth = ahead[len(u) + 1 + len(t) - p] if u else 0
            left = behind[p] if p < len(t) else 0
            if forth + left >= p and forth <= size and p + left < whole:
                yield b - p - left, b + forth, p
        b, before = b + size, size


def runs(word: list[int], least_length: int = 2, least_exponent: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs with that length and exponent (2 or more) at least, by start, then period."""
    made = factors(word)
    smallest: dict[tuple[int, int], int] = {}
    for start, end, p in crossing(word, made):
        if end - start >= least_length and end - start >= least_exponent * p and p < smallest.get((start, end), p + 1):
            smallest[start, end] = p
    at: dict[int, list[tuple[int, int]]] = {}
    for (start, end), p in smallest.items():
        at.setdefault(start, []).append((end, p))
    b = 0
    for size, seen in made:
        if seen >= 0 and size > least_length:
            shift = b - seen
            for start in range(seen + 1, seen + size - least_length):
                for end, p in at.get(start, ()):
                    if end < seen + size and (start + shift, end + shift) not in smallest:
                        smallest[start + shift, end + shift] = p
                        at.setdefault(start + shift, []).append((end + shift, p))
        b += size
    return sorted((start, end - start, p) for (start, end), p in smallest.items())


def stretches(word: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the stretches outside which no run of four periods and five words lies."""
    if len(word) < 5:
        return []
    top = int(word.max()) + 1
    pairs = word[:-1] * top + word[1:]
    if top >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, count = np.unique(pairs[:-1] * top + word[2:], return_inverse=True, return_counts=True)
    often = np.flatnonzero(count[which] >= 3)
    if not len(often):
        return []
    cuts = np.flatnonzero(np.diff(often) > 1)
    return list(zip(often[np.append(0, cuts + 1)].tolist(), (often[np.append(cuts, len(often) - 1)] + 3).tolist(), strict=True))


def frequent_runs(word: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """runs() of a sequence of small numbers, searched only where runs can be."""
    if least_length < 5 or least_exponent < 4:
        return runs(word.tolist(), least_length, least_exponent)
    found = []
    for a, b in stretches(word):
        if b - a >= least_length:
            found += [(a + start, length, p) for start, length, p in runs(word[a:b].tolist(), least_length, least_exponent)]
    return found


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, p in found:
        change[start + p] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def find_runs(docs: DataFrame, text: Column | None = None, id_col: str = "doc_id", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """id_col, runs (array of structs of start, length, period, by start, then period) and collapsed (the kept words,
    joined by one space) of each row of docs.

    text: the text to search, the column of that name unless told otherwise; null is empty. Words are parted by ASCII
    white space and numbered from 0. A word goes if a run contains it after the run's first period. Of texts without
    words or runs the array is empty; repeated rows give repeated results, null ids stay null, an empty table gives an
    empty one, and other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_of(F.col("text") if text is None else text).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["id"]
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, ends, collapsed, long = [], [0], [], False
            for raw in batch.column("text").to_pylist():
                words, number = raw.split(), {}
                found = frequent_runs(np.array([number.setdefault(w, len(number)) for w in words], np.int64), least_length, least_exponent)
                spans += found
                ends.append(len(spans))
                long |= len(words) > LONG
                if found:
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
                collapsed.append(b" ".join(words).decode("utf-8", "replace"))
            columns = np.array(spans, np.int64).reshape(-1, 3)
            array = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(columns[:, i])) for i in range(3)], fields=list(span))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), array), pa.array(collapsed, pa.string())], names=["id", "runs", "collapsed"])
            if long:
                release_memory()

    made = rows.mapInArrow(make, f"id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return made.withColumnRenamed("id", id_col)


def longest(runs_col: str = "runs") -> Column:
    """The run of greatest length (ties: smallest start, then period); null without runs."""
    order = lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))
    best = F.array_min(F.transform(runs_col, order))
    return F.when(best.isNotNull(), F.struct(best["s"].alias("start"), (-best["l"]).alias("length"), best["p"].alias("period")))


def run_lines(runs_col: str = "runs") -> Column:
    """A line of start, length and period for each run."""
    return F.array_join(F.transform(runs_col, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a periodic end for the ids whose CRC-32 ends in 0, by the fixed rule of the query; a null id gets none."""
    words = split_words(text_of(text))
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words).cast("long")
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    times = F.ceil((n - a) / p)
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times.cast("int"))), F.lit(1), (n - a).cast("int"))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), made).otherwise(text_of(text))
