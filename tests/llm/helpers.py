"""Small tables and brute-force versions that share no code with the operators."""

import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_words string, key string"


def docs(spark, rows):
    """Documents of (doc_id, text[, source]) with two columns whose names clash with the operators' own."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", "own", "own") for r in rows], DOCS)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text):
    words = SPACE.findall(lowered(text))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def groups(prints):
    """For each index the smallest index that it is linked with."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def leaks(text, items):
    """(words, hit words, item ids) of a text by comparing every window."""
    find = re.compile(r"[0-9a-z\x80-\U0010FFFF]+").findall
    words, hit, ids = find(lowered(text)), set(), set()
    for item, body in items:
        w = find(lowered(body))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[j : j + n]:
                    hit |= set(range(i, i + n))
                    ids.add(str(item))
    return len(words), len(hit), sorted(ids)


def line_windows(rows):
    """doc_id -> text without lines of later three-line windows."""
    first, gone = {}, defaultdict(set)
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if SPACE.search("".join(window)):
                if window in first:
                    gone[i] |= {k, k + 1, k + 2}
                else:
                    first[window] = (i, k)
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i]) for i, t in rows}


def word_counts(rows):
    c = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            c.update(SPACE.findall(lowered(t)))
            c["\n"] += 1
    return c
