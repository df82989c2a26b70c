"""Secret scans: patterns, and values near credential words that are costly to guess.

The cost of a value is the base-10 logarithm of the guesses that the cheapest segmentation needs. A dynamic program
over positions tries, for the part that ends there, a listed word, a date, a repeat, a keyboard walk and brute
force. A value after a credential word counts as a secret if it costs at least GUESSES_LOG10; placeholders such as
``changeme2020`` don't. Spans that the patterns have found stay whatever they cost.

The words are a short list of parts that are common in passwords, then the words of a public subword vocabulary in the
order of its ranks, which is by frequency: its pieces of four letters and more that begin a word. The vocabulary's path
is a parameter.

Each text is scanned alone, by Python workers that get it in batches of bounded bytes; nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import small_batches, text_of

#: Fixed patterns of the base kinds; a match that is too short is dropped after it has been consumed.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

#: Words after which a value counts as a credential, and such a value.
CONTEXT = re.compile(r"""(?ai:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|(?:api|access|private|client|signing|encryption|service)[_\x20-]?key)(?:[_-]?(?:id|key|value|hash))?)["']?[\x20\t]{0,4}(?:=>|:=|==|[:=])[\x20\t]{0,4}(?:(?ai:bearer|basic)\x20)?["'`]?([^\s"'`<>,;]{8,})""")
GUESSES_LOG10 = 10.0

#: A public vocabulary of subwords in the order of their frequency, and the letters that its words have at least.
VOCABULARY, LEAST_LETTERS = "/opt/tokenizers/byte_bpe_50k.tiktoken", 4
#: Common parts of passwords, commonest first: the rank is the number of guesses. The vocabulary's words follow.
WORDS = "password admin welcome login user root master secret test guest default changeme letmein example sample token dragon monkey shadow sunshine princess football baseball superman batman trustno iloveyou hello freedom whatever access system server service database manager public private temp demo null none true false your here insert replace placeholder value string enter key api code pass the and for with".split()
#: Rows and columns of the common keyboard.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("@4310$57", "aaeiosst")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
DATE_LOG10, YEAR_LOG10 = math.log10(366 * 120), math.log10(120)
SEGMENT_LOG10 = math.log10(2)
#: Brute force costs a character the size of its kind; what commonly parts words is tried first.
LETTERS, DIGITS, PARTING, SYMBOLS, OTHERS = math.log10(26), math.log10(10), math.log10(3), math.log10(32), math.log10(100)

_NEXT = {(a, b): row for row, line in enumerate(WALKS) for s in (line, line[::-1]) for a, b in zip(s, s[1:], strict=False)}


def brute_cost(c: str) -> float:
    if not c.isascii():
        return OTHERS
    return LETTERS if c.isalpha() else DIGITS if c.isdigit() else PARTING if c in "-_." else SYMBOLS


@functools.cache
def ranks(path: str = VOCABULARY) -> dict[str, int]:
    """Word: its place in the list of words, from 1."""
    found = dict.fromkeys(WORDS)
    with open(path, "rb") as f:
        pieces = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, f))
    for _, piece in pieces:
        word = piece[1:].decode("ascii", "replace").lower()
        if piece[:1] == b" " and len(word) >= LEAST_LETTERS and word.isascii() and word.isalpha():
            found.setdefault(word)
    return {w: i + 1 for i, w in enumerate(found)}


def guess_cost(value: str, path: str = VOCABULARY) -> float:
    """log10 of the guesses for value by its cheapest segmentation; linear in its length, 0 if empty."""
    rank_of = ranks(path)
    longest = max(map(len, rank_of))
    n, plain = len(value), value.lower()
    leet = plain.translate(LEET)
    if len(plain) != n:  # a character whose lower case is longer
        plain = leet = value
    ends: dict[int, list[tuple[int, float]]] = {}
    for m in DATE.finditer(plain):
        ends.setdefault(m.end(), []).append((m.start(), DATE_LOG10 if len(m[0]) > 4 else YEAR_LOG10))
    best, run, walk, unit = [0.0] * (n + 1), 1, 1, 0
    for i in range(1, n + 1):
        cost = best[i - 1] + brute_cost(value[i - 1])
        run = run + 1 if i > 1 and plain[i - 1] == plain[i - 2] else 1
        if run >= 3:
            cost = min(cost, best[i - run] + SEGMENT_LOG10 + math.log10(26 * run))
        walk = walk + 1 if i > 1 and (plain[i - 2], plain[i - 1]) in _NEXT else 1
        if walk >= 4:
            cost = min(cost, best[i - walk] + SEGMENT_LOG10 + math.log10(47 * 2 * walk))
        for start, c in ends.get(i, ()):
            cost = min(cost, best[start] + SEGMENT_LOG10 + c)
        for k in range(3, min(longest, i) + 1):
            part = plain[i - k : i]
            rank = rank_of.get(part) or 2 * rank_of.get(leet[i - k : i], 0)
            if rank:
                cost = min(cost, best[i - k] + SEGMENT_LOG10 + math.log10(rank) + (0 if value[i - k : i] == part else SEGMENT_LOG10))
        for size in range(2, 17):  # the last few characters once more: their repeat costs a count, not characters
            if i >= 2 * size and plain[i - size : i] == plain[i - 2 * size : i - size]:
                cost = min(cost, best[i - size] + SEGMENT_LOG10)
        best[i] = cost
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, index of kind, kind, end) of the patterns' matches, by start, then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_secret(value: str, path: str = VOCABULARY) -> bool:
    return guess_cost(value, path) >= GUESSES_LOG10


def guess_spans(text: str, path: str = VOCABULARY) -> list[tuple]:
    """Values after credential words that cost enough, whether or not a pattern has found them too."""
    if "=" not in text and ":" not in text:
        return []
    return [(m.start(1), 3, "guess", m.end(1)) for m in CONTEXT.finditer(text) if is_secret(m[1], path)]


def scan_text(text: str, path: str = VOCABULARY) -> tuple:
    """n_assign, n_access, n_hex, n_guess, base and all spans as strings."""
    base = base_spans(text)
    every = sorted(base + guess_spans(text, path))
    say = lambda spans: ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
    return (*(sum(x[1] == k for x in every) for k in range(4)), say(base), say(every))


def find_secrets(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess for each row of docs.

    spans are kind:start:end by start, then kind (assign, access, hex, guess), in code points, end exclusive. A null
    text is empty; null ids and repeated rows are passed through; other columns are not read. Ids are cast to whole
    numbers, which raises for a text that isn't one.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in ("assign", "access", "hex")), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_guess", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t, vocabulary) for t in batch.column("text").to_pylist()]
            cols = list(zip(*found, strict=True)) or [()] * 6
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in cols[4]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(digests, pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[3], pa.int64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
