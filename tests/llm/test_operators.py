import hashlib
import io
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.llm import attention, chat_formatting, decontamination, html_extraction, line_dedup, lm_scoring, mixing, quality_rules, secret_scan, simhash, warc
from hindcast.llm import common
from hindcast.llm.common import scratch
from tests.llm import helpers as H

PAGES = "page_id long, url string, html string, digest string, refers_to string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1 WARC


def test_warc_round_trip(spark):
    big, small = "<html>" + "é" * 600, "<p>x</p>"
    made = [(1, "http://a/1", big), (2, "http://a/2\nX: y%0A é", big), (3, None, small), (4, "u", small), (5, "u", None), (6, "u", big + "!"), (None, "u", big), (2, "u", big)]
    pages = spark.createDataFrame([(*r, "own", "own") for r in made], PAGES)
    got = warc.read_warc(spark, warc.write_warc(pages, scratch(spark, "warc"))).collect()
    assert len(got) == len(made)
    by = {(r.page_id, r.url): r for r in got}
    for page, url, html in made:
        r, payload = by[page, url], (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert r.record_type == ("revisit" if page == 1 else "response") and r.refers_to == (2 if page == 1 else None)
        assert bytes(r.payload) == (b"" if page == 1 else payload)
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0), scratch(spark, "warc"))).count() == 0


def test_archive_begins_with_its_dictionary_and_every_frame_stands_alone():
    records = [warc.encode_record(i, f"http://h/{i}", (f"<html><body>page {i} of many pages " * 9).encode(), "00" * 20, None) for i in range(300)]
    archive = warc.encode_archive(records)
    assert archive[:4] == bytes.fromhex("5D2A4D18") and int.from_bytes(archive[4:8], "little") > 0
    assert int.from_bytes(archive[8:12], "little") == warc.DICTIONARY_MAGIC
    assert list(warc.decode_archive(io.BytesIO(archive)))[1:] == records
    with pytest.raises(ValueError):
        list(warc.decode_archive(io.BytesIO(archive[:-3])))
    assert list(warc.decode_archive(io.BytesIO(warc.encode_archive(records[:2]))))[1:] == records[:2]


def test_damaged_payload_is_refused():
    good = warc.encode_record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    with pytest.raises(ValueError):
        warc.decode_record(good.replace(b"abc", b"abd"))


# 2 decontamination


def test_decontamination_equals_brute_force(spark):
    r = random.Random(3)
    word = lambda: r.choice("aa bb cc dd ee ff É9 Zz".split())
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((30, 12, 10, 9, 7, 6, 5, 25))] + [(8, None), (9, "!!"), (10, "")]
    texts = [" ".join(word() for _ in range(r.randint(0, 40))) for _ in range(40)]
    texts += ["x " * 12 + items[k][1].upper() + ", y" * 3 for k in range(8)] + [None, "", items[0][1][: len(items[0][1]) // 2], items[0][1] * 30]
    made = list(enumerate(texts)) + [(0, texts[0]), (None, items[1][1])]
    bench = spark.createDataFrame([(*x, "own") for x in items], "item_id long, text string, n_words string")
    got = rows(decontamination.contamination(H.docs(spark, made), bench))
    want = []
    for i, t in made:
        n, hit, ids = H.leaks(t, items)
        want.append((i, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
    assert got == sorted(want, key=repr)
    kept = decontamination.keep_clean(H.docs(spark, made), bench)
    assert kept.columns == H.docs(spark, made).columns
    assert sorted(map(repr, (x.doc_id for x in kept.collect()))) == sorted(repr(w[0]) for w in want if not w[5])
    assert decontamination.contamination(H.docs(spark, made).limit(0), bench).count() == 0
    assert not any(x.contaminated for x in decontamination.contamination(H.docs(spark, made), bench.limit(0)).collect())


# 3 secrets


def test_base_spans():
    text = 'é password="abc" TOKEN : abcdef1 secret=token: zzzzzzz AKIA' + "A" * 16 + " AKIAB " + "0a" * 12 + " api_key='A.b/c+d='"
    got = secret_scan.base_spans(text)
    assert [(k, text[a:b]) for a, _, k, b in got] == [("assign", "TOKEN : abcdef1"), ("access", "AKIA" + "A" * 16), ("hex", "0a" * 12), ("assign", "api_key='A.b/c+d=")]
    assert secret_scan.base_spans("ſecret=abcdefgh") == []


@pytest.mark.parametrize("cheap, dear", [("password2020", "xK9#mP2$vL5n"), ("aaaaaaaaaaaa", "aqzmwpeirutl"), ("qwertyuiop", "qpwoeirutyzm"), ("hunter2hunter2hunter2", "hunter2bvxk9qpwzm83u")])
def test_cheaper_segmentations(cheap, dear):
    assert secret_scan.guess_cost(cheap) < secret_scan.GUESSES_LOG10 <= secret_scan.guess_cost(dear)


def test_cost_never_exceeds_brute_force_or_any_split():
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("ab1qwe20pasword") for _ in range(r.randint(0, 9))) for _ in range(2))
        assert secret_scan.guess_cost(a + b) <= sum(map(secret_scan.brute_cost, a + b)) + 1e-9 and secret_scan.guess_cost(a + b) <= secret_scan.guess_cost(a) + secret_scan.guess_cost(b) + 1e-9


def test_cost_equals_exhaustive_segmentation():
    """Every way to cut short values into parts, each priced by rules written anew."""
    rank, half = secret_scan.ranks(), math.log10(2)

    def part(value, a, b):
        x = value[a:b].lower()
        plain = x.translate(str.maketrans("@4310$57", "aaeiosst"))
        found = [sum(secret_scan.brute_cost(c) for c in value[a:b])] if b - a == 1 else []
        if len(x) >= 3 and (r := rank.get(x) or 2 * rank.get(plain, 0)):
            found.append(half + math.log10(r) + (0 if value[a:b] == x else half))
        if len(x) >= 3 and len(set(x)) == 1 and (a == 0 or value[a - 1].lower() != x[0]):
            found.append(half + math.log10(26 * len(x)))
        if len(x) == 4 and x.isdigit() and x[:2] in ("19", "20"):
            found.append(half + math.log10(120))
        for size in range(2, 17):
            if b - a == size and a >= size and value[a - size : a].lower() == x:
                found.append(half)
        rows = [line[::d] for line in secret_scan.WALKS for d in (1, -1)]
        step = lambda i: any(value[i : i + 2].lower() in row for row in rows)
        if len(x) >= 4 and all(map(step, range(a, b - 1))) and (a == 0 or not step(a - 1)):
            found.append(half + math.log10(47 * 2 * len(x)))
        return min(found, default=math.inf)

    r = random.Random(3)
    pieces = ["pass", "Word", "qwer", "aaa", "12", "2019", "x", "dragon", "$", "9k", "p4ss", "lkj", "-"]
    for _ in range(150):
        value = "".join(r.choice(pieces) for _ in range(r.randint(0, 3)))[:10]
        best = [0.0]
        for b in range(1, len(value) + 1):
            best.append(min(best[a] + part(value, a, b) for a in range(b)))
        assert abs(secret_scan.guess_cost(value) - best[-1]) < 1e-9, value


def test_random_values_are_found_and_placeholders_left_alone():
    r, letters = random.Random(7), "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    made = ["".join(r.choice(letters) for _ in range(r.randint(10, 24))) for _ in range(300)]
    assert sum(secret_scan.scan_text(f"the pwd = {x} here")[3] for x in made) >= 0.98 * len(made)
    common = ["your-api-key-here", "replace_with_secret", "example.password", "changeme1234", "insert-token-here", "Summer2024!", "qwertyuiop123", "00000000000", "********", "test_value_2020", "null_null_null"]
    assert not any(secret_scan.scan_text(f"the pwd = {x} here")[3] for x in common)


def test_secret_scan_odd_rows(spark):
    odd = [(None, "pwd: " + "Zx9$kQ2w" * 4), (5, "token=" + "ab1" * 40_000), (5, ""), (6, "secret: 😀é9xQ$mZ2k7w")]
    got = secret_scan.find_secrets(H.docs(spark, odd)).collect()
    assert len(got) == 4 and got[0].doc_id is None and got[0].n_guess == 1 and got[1].n_assign == 1 and got[2].spans == ""
    assert got[3].spans.endswith(f":{len(odd[3][1])}")


def test_secret_scan(spark):
    text = "the passphrase: x9$Kq-2vLw8Tz and pwd=changeme2020"
    got = {r.doc_id: r for r in secret_scan.find_secrets(H.docs(spark, [(1, text), (2, None), (3, "clean words " * 9000), (1, text)])).collect()}
    assert got[1].n_guess == 1 and got[1].spans == f"guess:{text.index('x9')}:{text.index(' and')}" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].spans == got[3].spans == ""
    assert secret_scan.find_secrets(H.docs(spark, []).limit(0)).count() == 0


# 4 chat


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "<\\s>\\\\<p>", "<", "\n", "", None, "a😀<r>b", "[INST", "</s"]
    made = [(1, i, ("user", "assistant", "assistant", "a<r>\nb", None)[i % 5], t, "own") for i, t in enumerate(nasty)] + [(2, 0, "user", "x", "own"), (2, 0, "user", "x", "own"), (None, None, "assistant", "y", "own")]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string, segments string")
    out = chat_formatting.format_chat(df).select("conv_id", "formatted", chat_formatting.read_turns(F.col("formatted")).alias("t"), chat_formatting.read_loss(F.col("formatted")).alias("loss"), F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: chat_formatting.unescaped(x["text"])), "").alias("masked"))
    got = {r.conv_id: r for r in out.collect()}
    assert [tuple(t) for t in got[1].t] == [(m[2] or "", m[3] or "") for m in made[:10]]
    assert all(x.loss == x.masked for x in got.values())
    assert got[1].loss == "".join(m[3] or "" for m in made[:10] if m[2] == "assistant")
    assert got[1].formatted.count("<p>") == 2 and len(got[2].t) == 2 and got[None].formatted == "<s>assistant<r>y</s>"
    assert chat_formatting.format_chat(df.limit(0)).count() == 0


# 5 lines


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(5)
    made = [(i, "\n".join(r.choice(["a b", "c", "", "d e f", "é"]) for _ in range(r.randint(1, 12)))) for i in range(60)] + [(60, None), (61, ""), (62, "\n\n\n\n"), (63, "q\n" * 4000)]
    want = H.line_windows(made)
    got = line_dedup.dedup_lines(H.docs(spark, made)).collect()
    assert {x.doc_id: x.text for x in got} == want
    assert all(x.n_lines - x.n_removed == len(want[x.doc_id].split("\n")) for x in got if x.n_removed < x.n_lines)
    again = line_dedup.dedup_lines(H.docs(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc\nd")])).collect()
    assert sorted((str(x.doc_id), x.text) for x in again) == [("1", ""), ("1", ""), ("None", "a\nb\nc\nd")]
    kept = line_dedup.remove_repeats(H.docs(spark, [(1, "a\nb\nc"), (2, "a\nb\nc"), (3, "x\na\nb\nc")]))
    assert rows(kept.select("doc_id", "text", "key")) == [(1, "a\nb\nc", "own"), (3, "x", "own")]
    assert line_dedup.dedup_lines(H.docs(spark, []).limit(0)).count() == 0


# 6 SimHash


def test_fingerprint_equals_brute_force():
    r = random.Random(6)
    for n in (0, 1, 3, 4, 5, 60):
        text = " \t".join("".join(r.choice("aÉZ ") for _ in range(3)) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == H.simhash(text)


def test_links_equal_brute_force():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 12, dtype=np.uint64)
    points = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << r.integers(0, 63, 12, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 63, 12, dtype=np.uint64)) for _ in range(5))]))
    table = np.bitwise_count(points[:, None] ^ simhash.pivots()).astype(np.int8)
    parent = list(range(len(points)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in simhash.linked(points, table):
        assert (int(points[a]) ^ int(points[b])).bit_count() <= 4
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(len(points))] == H.groups([int(p) for p in points])


def near_texts():
    r = random.Random(7)
    base = [" ".join(r.choice("abcdefghij") * 3 + str(r.randint(0, 99)) for _ in range(90)) for _ in range(6)]
    made = []
    for b in base:
        w = b.split()
        for k in range(5):
            x = list(w)
            for _ in range(k):
                x[r.randrange(len(x))] = "changed"
            made.append(" ".join(x))
    return list(enumerate(made)) + [(100, None), (101, ""), (102, base[0]), (102, base[0]), (None, base[1])]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    made = near_texts()
    prints = [H.simhash(t) for _, t in made]
    of = H.groups(prints)
    least = {}
    for g, (i, _) in zip(of, made, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted(((i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(made, prints, of, strict=True)), key=repr)
    assert rows(simhash.near_duplicates(H.docs(spark, made))) == want
    monkeypatch.setattr(simhash, "CHUNK", 2)  # every bucket is dealt out as pairs of chunks
    assert rows(simhash.near_duplicates(H.docs(spark, made))) == want
    kept = simhash.keep_one(H.docs(spark, made))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least[g] for g in set(of)) and kept.columns[-1] == "key"
    assert simhash.near_duplicates(H.docs(spark, []).limit(0)).count() == 0


# 7 language model


def two_registers(docs=120, seed=5):
    """Texts of two registers whose words are spelled from different letters, as bytes."""
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(("abcde", "vwxyz")[k]) for _ in range(r.randint(2, 4)))
    return [" ".join(word(i % 2) for _ in range(r.randint(40, 150))).encode() for i in range(docs)]


def laid_part(texts):
    part = lm_scoring.Part()
    for t in texts:
        part.add(t)
    return part


def test_attention_is_causal_scores_each_word_once_and_tells_registers_apart():
    subwords = lm_scoring.Subwords(lm_scoring.load_ranks(lm_scoring.TOKENIZER))
    part = laid_part(two_registers())
    words, lengths = part.laid()
    ids, n = subwords.of(part.words())
    end = len(part.index)
    model = attention.begin(words, lengths, ids, n, end, subwords.size)
    table = attention.embedded(model.weights["embed"], ids, n)
    w = attention.weights_of(model, table, words, lengths, end)
    assert np.allclose(w.sum(1), 1, atol=1e-4)
    seen = np.zeros(len(words), int)
    for _, places, used in attention.batches(words, lengths, end):
        np.add.at(seen, places[used], 1)
    assert (seen == 1).all()
    # What comes after a word doesn't change its weights.
    other = words.copy()
    other[20:30] = words[lengths[0] : lengths[0] + 10]
    assert np.allclose(attention.weights_of(model, table, other, lengths, end)[:20], w[:20], atol=1e-5)
    p = (w * np.exp(model.spelling.log(ids, n))[words]).sum(1)
    flat = (w.mean(0) * np.exp(model.spelling.log(ids, n))[words]).sum(1)
    assert np.log10(p).mean() > np.log10(flat).mean() + 0.15


def test_spelling_sums_to_one_and_equals_a_plain_count():
    r = np.random.default_rng(0)
    keys = r.integers(0, 5, 40) * 5 + r.integers(0, 4, 40)  # 3 subwords, 3 the stop, 4 the start
    expert, many = r.integers(0, attention.EXPERTS, 40), r.integers(1, 9, 40)
    s = attention.Spelling.of(3, keys, expert, many)
    spelled = [()]
    total, left = np.zeros(attention.EXPERTS), None
    for _ in range(5):
        ids = np.array([i for w in spelled for i in w], dtype=np.int64)
        log = s.log(ids, np.array([len(w) for w in spelled]))
        total += np.exp(log).sum(0)
        spelled = [(*w, i) for w in spelled for i in range(3)]
    # What is missing is the probability of longer strings: of a start followed by five subwords.
    c = np.zeros((5, 5, attention.EXPERTS))
    np.add.at(c, (keys // 5, keys % 5, expert), many)
    second = c.sum(0) + attention.FLOOR
    second[4] = 0
    p = (c + attention.BACK * second / second.sum(0)) / (c.sum(1, keepdims=True) + attention.BACK)
    assert np.allclose(p.sum(1), 1)
    for k in range(attention.EXPERTS):
        left = p[4, :3, k]
        for _ in range(4):
            left = left @ p[:3, :3, k]
        assert abs(total[k] + left.sum() - 1) < 1e-4
        assert abs(np.exp(s.log(np.array([2, 0]), np.array([2]))[0, k]) - p[4, 2, k] * p[2, 0, k] * p[0, 3, k]) < 1e-6


def test_long_words_are_embedded_as_short_ones():
    e, ids, n = np.random.default_rng(1).normal(size=(50, attention.WIDTH)).astype(np.float32), np.arange(40), np.array([1, 3, 30, 6])
    got = attention.embedded(e, ids, n)
    assert np.allclose(got[2], e[4:34].mean(0), atol=1e-5) and np.allclose(got[1], e[1:4].mean(0), atol=1e-5)


def test_gradients_by_finite_differences():
    r = np.random.default_rng(2)
    w = {k: v.astype(np.float64) for k, v in attention.initial(9, 1).items()}
    inputs, u = r.integers(0, 9, (2, attention.WINDOW)), r.uniform(0.1, 1, (2, attention.SCORED // attention.STRIDE, attention.EXPERTS))
    loss = lambda: -np.log((attention.forward(w, w["embed"], inputs)[0] * u).sum(2)).sum()
    z, kept = attention.forward(w, w["embed"], inputs)
    g, dx = attention.backward(w, kept, z - z * u / (z * u).sum(2, keepdims=True))
    at, sums = attention.row_sums(inputs.ravel(), dx.reshape(-1, attention.WIDTH))
    g["embed"] = np.zeros_like(w["embed"])
    g["embed"][at] = sums
    for name in ("embed", "query", "key", "value", "up", "down", "down_bias", "position"):
        place = tuple(int(inputs[0, 50]) if name == "embed" and i == 0 else 1 for i in range(w[name].ndim))
        before = w[name][place]
        w[name][place] = before + 1e-5
        up = loss()
        w[name][place] = before - 1e-5
        down = loss()
        w[name][place] = before
        assert abs((up - down) / 2e-5 - g[name][place]) < 1e-2 * max(1, abs(g[name][place])), name


def test_lm_scores(spark):
    r = random.Random(4)
    made = [(i, " ".join(r.choice(["the", "of", "and", "Tion", "é", "word" + str(r.randint(0, 30))]) for _ in range(r.randint(0, 60)))) for i in range(80)] + [(80, None), (81, ""), (None, "the of"), (3, "the"), (82, "new " * 3000)]
    c = H.word_counts(made)
    n, v = sum(c.values()), len(c)
    got = lm_scoring.score_documents(H.docs(spark, made)).collect()
    want = []
    for i, t in made:
        w = [*H.SPACE.findall(H.lowered(t)), "\n"]
        want.append((repr(i), zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    assert sorted((repr(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == sorted(want)
    assert all(math.isfinite(x.score) and x.score < 0 for x in got)
    assert lm_scoring.score_documents(H.docs(spark, []).limit(0)).count() == 0


# 8 quality


def test_quality_counts_and_verdicts(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    clean = [(i, " ".join(word() for _ in range(80))) for i in range(120)]
    odd = [(200, None), (201, ""), (202, "a b"), (203, "x y z " * 40), (204, " ".join(word() + "###" for _ in range(80))), (205, "\n".join(["same line here " + word()] * 3)), (206, "é 😀 " * 30000), (None, clean[0][1]), (0, clean[0][1])]
    got = quality_rules.quality(H.docs(spark, clean + odd)).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(clean + odd) and all(by[i].kept for i, _ in clean) and by[None].kept
    for i, t in clean + odd:
        words, lines = H.SPACE.findall(t or ""), [x for x in (t or "").split("\n") if H.SPACE.search(x)]
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        many = {g for g in set(grams) if grams.count(g) > 1} if len(grams) < 5000 else set(grams)
        repeat = len({k + j for k, g in enumerate(grams) if g in many for j in range(3)})
        x = by[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeat)
        assert x.base_failed == (len(words) < 50 or 100 * repeat > 50 * len(words))
    assert not by[204].kept and not by[204].base_failed and by[203].base_failed
    good = quality_rules.keep_good(H.docs(spark, clean + odd))
    assert sorted(repr(x.doc_id) for x in good.collect()) == sorted(repr(x.doc_id) for x in got if x.kept) and "key" in good.columns
    assert quality_rules.quality(H.docs(spark, []).limit(0)).count() == 0


def test_quality_fences_follow_their_source(spark):
    r = random.Random(88)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    text = lambda marks: " ".join(word() + ("#" if k < marks else "") for k in range(100))
    # In "code" documents have up to 20 marks, in "prose" none or one.
    rows = [(i, text(i % 21), "code") for i in range(420)] + [(1000 + i, text(i % 2), "prose") for i in range(420)]
    same = text(10)
    got = {x.doc_id: x for x in quality_rules.quality(H.docs(spark, [*rows, (5000, same, "code"), (5001, same, "prose"), (5002, same, "rare")])).collect()}
    assert got[5000].kept and not got[5001].kept and not got[5001].base_failed
    # A source of few documents goes by its language's sketch.
    assert got[5002].kept and sum(x.kept for x in got.values()) > 820


def test_quality_counts_no_false_repeats_in_long_texts(spark):
    long_ = " ".join(map(str, range(400_000)))
    by = {x.doc_id: x for x in quality_rules.quality(H.docs(spark, [(1, long_), (2, long_ + " 5 6 7")])).collect()}
    assert by[1].n_repeat_words == 0 and by[2].n_repeat_words == 6


# 9 mixing


def test_targets_equal_resharing(spark):
    sizes = {"a": 100, "b": 5, "c": 1000, "d": 40, "e": 0, None: 300}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {x.source: x.target for x in mixing.targets(df).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, (5, 2, 1) * 2, strict=False))
    left, open_, want = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        for s in full or open_:
            want[s] = 2.0 * sizes[s] if full else level * weight[s]
            left -= want[s] if full else 0
        open_ -= full or open_
    assert all(abs(got[s] - want[s]) < 1e-6 for s in order)


def test_mixture(spark):
    r = random.Random(9)
    made = [(i, "w " * r.randint(1, 40), r.choice(["a", "b", "c", None, "é"])) for i in range(400)] + [(400, None, "a"), (None, "x y", "b"), (1, "w w", "a"), (1, "w w", "a"), (401, "w " * 900, "a")]
    got = mixing.mixture(H.docs(spark, made)).collect()
    assert len(got) == len(made) and all(x.taken % max(x.size, 1) == 0 and x.taken <= 2 * x.size for x in got)
    by = {}
    for (_, t, s), _ in zip(made, made, strict=True):
        by.setdefault(s, []).append(len((t or "").split()))
    total = {}
    for x in got:
        total[x.target, x.source_size] = total.get((x.target, x.source_size), 0) + x.taken
    assert len(total) == 5 and all(abs(t - n) <= 450 for (t, _), n in total.items()) and sorted(x.source_size for x in got)[-1] == max(map(sum, by.values()))
    assert sorted(map(tuple, got), key=repr) == rows(mixing.mixture(H.docs(spark, made).repartition(7)))
    kept = mixing.take_mixture(H.docs(spark, made).withColumn("Size", F.lit(1)))
    assert kept.columns[-4:] == ["size_", "source_size", "target", "taken"]
    assert sum(x.taken for x in kept.collect()) == sum(x.taken for x in got)
    assert mixing.mixture(H.docs(spark, []).limit(0)).count() == 0


def test_better_documents_are_taken_more_often(spark):
    made = [(i, ("w " * 20 if i % 2 else "w1#### " * 20), "a") for i in range(2000)] + [(i, "w " * 20, "b") for i in range(2000, 2100)]
    got = [x for x in mixing.mixture(H.docs(spark, made)).collect() if x.doc_id < 2000]
    target = got[0].target
    assert abs(sum(x.taken for x in got) - target) <= 20
    share = [sum(x.taken for x in got if x.doc_id % 2 == k) for k in (0, 1)]
    assert share[1] > 1.2 * share[0] or target >= 2 * got[0].source_size - 20


# 10 HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page-1"><nav><ul><li>Menu<li>More</ul></nav><div class="cookie-notice">We use cookies, as every page on the web does.</div>
<div id="wrap"><article class="post-17"><h1>Head &amp; line</h1><p>First&nbsp;paragraph <b>with bold</b> &lt;text&gt; that is long enough<p>Second paragraph, unclosed,<br>with a break and more words<ul><li>one<li>two</ul><div class="ad">Buy this now, it is cheap and good</div><script>var x = "<p>no</p>";</script><!-- <p>no</p> -->
<form><p>Your mail address please, for our letters</p></form><blockquote>A quote</blockquote><section class="comments"><p>First comment by a reader of the page</p></section></article><aside><p>Related reading that isn't the article</p></aside></div><footer>&copy; us, all rights are reserved here</footer></body></html>"""
TEXT = "Head & line\nFirst paragraph with bold <text> that is long enough\nSecond paragraph, unclosed, with a break and more words\none\ntwo\nA quote"


def test_extraction(spark):
    other = "<body><div><article class='post-9'><p>Just one paragraph of some length here</p></article><p>Outside of it</p></div>"
    made = [(1, "http://H.example/a", PAGE), (2, "https://u@h.example:8/b", other), (3, "http://h.example/c", None), (4, None, ""), (5, "x", "plain text"), (6, "http://z/", "<p>" + "long " * 40000), (7, "http://z/", "<div><p>broken <a href='x"), (1, "http://H.example/a", PAGE)]
    pages = spark.createDataFrame([(*r, "own", "own") for r in made], "page_id long, url string, html string, text string, host string")
    got = html_extraction.extract(pages).collect()
    by = {x.page_id: x for x in got}
    assert len(got) == len(made) and by[1].text == TEXT and by[1].n_chars == len(TEXT)
    assert by[2].text == "Just one paragraph of some length here" and by[3].text == by[4].text == "" and by[5].text == "plain text"
    assert by[6].text == ("long " * 40000).strip() and by[7].text == "broken"
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_names_that_only_speak_of_other_parts():
    for name in ("has-sidebar", "no-comments", "ad-free", "entry-header"):
        assert html_extraction.main_text(f"<body><div class='{name}'><p>Some words of the article that are kept</p></div>", None).startswith("Some"), name
    for name in ("sidebar", "post-comments", "site-header", "cookie_notice", "ad"):
        assert html_extraction.main_text(f"<body><div><p>Some words of the article that are kept</p><div class='{name}'><p>Other words that aren't a part of it</p></div></div>", None) == "Some words of the article that are kept", name


def test_host_consensus_overrules_a_page(spark):
    usual = "<body><div class='main n1'><p>The article of this page, which is rather long as articles are</p></div><div class='extra'><p>Short words of another kind, here</p></div></body>"
    odd = "<body><div class='main n7'><p>The article of this page is short now</p></div><div class='extra'><p>" + "Words that stand beside it and are many more than those of the article itself. " * 9 + "</p></div></body>"
    made = [(i, "http://host/x", usual) for i in range(4)] + [(9, "http://host/y", odd)]
    got = {x.page_id: x.text for x in html_extraction.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got[9] == "The article of this page is short now"


# every value in a credential context is judged


@pytest.mark.parametrize("text, value", [("passphrase: kV9$xT2!", "kV9$xT2!"), ("password: T7#k!9Qz", "T7#k!9Qz"), ("pwd=q7#Xv!2Lz", "q7#Xv!2Lz"), ("token=xK9mP2vL5nQ8w", "xK9mP2vL5nQ8w")])
def test_short_and_covered_values_are_judged(text, value):
    a = text.index(value)
    assert f"guess:{a}:{a + len(value)}" in secret_scan.scan_text(text)[5].split(",")


@pytest.mark.parametrize("text", ["password=changeme2020", "token: remember", "secret=qwertyuiop", "passphrase: Password1!"])
def test_placeholders_are_judged_cheap(text):
    assert secret_scan.scan_text(text)[3] == 0


# the language model learns from the whole corpus


def test_every_learning_word_is_counted_and_the_score_is_the_models_probability(spark):
    """Words that only come late in a text, or only in few documents, are learned; scores are held against a plain sum."""
    made = [(i, "the cat sat " * 10) for i in range(1, 40)] + [(i, "the cat sat " * 600 + "zebra " * 300) for i in range(40, 60)]
    ranks = lm_scoring.load_ranks(lm_scoring.TOKENIZER)
    subwords = lm_scoring.Subwords(ranks)
    stored = H.docs(spark, made).select(F.col("text").cast("binary").alias("text"), lm_scoring.held_out().alias("held_out"), F.lit(0).cast("long").alias("block"), "doc_id").coalesce(1)
    start = attention.initial(subwords.size, lm_scoring.SEED)
    learned = lm_scoring.learn(stored, lm_scoring.found_kinds(stored), ranks).cache()
    counts = {bytes(x.word): [x[c] for c in lm_scoring.COUNTS] for x in lm_scoring.with_sums(learned.where("kind = 0")).collect()}
    want = H.word_counts(made)
    assert {w.decode(): sum(c) for w, c in counts.items()} == dict(want)
    model = attention.Model(lm_scoring.averaged(learned.where("kind = 2"), start), lm_scoring.spelled(learned.where("kind = 1"), subwords.size))
    assert any(not np.allclose(model.weights[k], start[k]) for k in model.weights)
    words = [*counts, b"unseen"]
    table = np.array([counts.get(w, [0] * attention.EXPERTS) for w in words])
    totals, types = table.sum(0), (table > 0).sum(0)
    got = lm_scoring.BlockScorer(iter([(words, table.copy())]), totals, types, len(want), model, subwords).score([b"the zebra sat unseen", b""])
    part = laid_part([b"the zebra sat unseen", b""])
    sequence, lengths = part.laid()
    ids, n = subwords.of(part.words())
    weights = attention.weights_of(model, attention.embedded(model.weights["embed"], ids, n), sequence, lengths, len(part.index))
    spell = np.exp(model.spelling.log(ids, n))
    plain = []
    for at, w in enumerate(sequence):
        c = np.array(counts.get(part.words()[w], [0] * attention.EXPERTS))
        under = [(max(c[k] - 0.7, 0) + 0.7 * types[k] * spell[w, k]) / totals[k] if totals[k] else spell[w, k] for k in range(attention.EXPERTS)]
        plain.append(math.log10(sum(weights[at, k] * under[k] for k in range(attention.EXPERTS))))
    assert abs(got[0][3] - sum(plain[:5])) < 1e-3 and abs(got[1][3] - plain[5]) < 1e-3


def test_attention_beats_the_word_counts_on_held_out_texts(spark):
    made = [(i, t.decode(), f"s{i % 2}") for i, t in enumerate(two_registers(300))]
    out = [x for x in lm_scoring.score_documents(H.docs(spark, made)).collect() if x.held_out]
    assert sum(x.score for x in out) > sum(x.base_score for x in out) + 0.15 * sum(x.n_tokens for x in out)


def test_kinds_come_from_all_learning_texts_and_whole_ones(spark):
    # What tells the kinds apart comes after 9,000 bytes that all texts share.
    texts = [b"the same beginning " * 480 + t * 12 for t in two_registers(500)] + [b"", b"abc", "É Tail".encode()]
    stored = spark.createDataFrame([(bytearray(t), i % 10 == 0) for i, t in enumerate(texts)], "text binary, held_out boolean")
    found = lm_scoring.found_kinds(stored)
    learning = [t for i, t in enumerate(texts) if i % 10]
    by = np.stack([lm_scoring.kinds.of_text(t) for t in learning])
    assert np.allclose(found.mean, by.mean(0)) and np.allclose(found.axes.T @ np.cov(by.T, bias=True) @ found.axes, np.diag(np.sort(np.linalg.eigvalsh(np.cov(by.T, bias=True)))[::-1][: lm_scoring.kinds.AXES]), atol=1e-9)
    kind = found.nearest(found.points(by))
    registers = np.array([i % 2 for i in range(500) if i % 10])
    assert not set(kind[:450][registers == 0]) & set(kind[:450][registers == 1])
    pieces = np.bincount([int((int.from_bytes(texts[1].lower()[a : a + 4], "big") * 2654435761 % 2**32) >> 25) for a in range(len(texts[1]) - 3)], minlength=lm_scoring.kinds.BUCKETS)
    assert np.allclose(by[0] ** 2 * (len(texts[1]) - 3), pieces)


def test_every_window_moves_the_weights_and_long_words_keep_their_probability(spark):
    subwords = lm_scoring.Subwords(lm_scoring.load_ranks(lm_scoring.TOKENIZER))
    part = laid_part(two_registers(40))
    words, lengths = part.laid()
    learner = attention.Learner(attention.initial(subwords.size, 1), 0)
    learner.learn(words, lengths, *subwords.of(part.words()), len(part.index), np.arange(40) % 2)
    assert learner.step == -(-sum(-(-lengths // attention.SCORED)) // attention.BATCH) and learner.scored == len(words)
    got = {x.doc_id: x.score for x in lm_scoring.score_documents(H.docs(spark, [(1, "a b c"), (6, "xq" * 2000), (29, "xq" * 4000)])).collect()}  # 6 and 29 are held out
    # Probabilities below the smallest number aren't cut off: a word twice as long costs about twice as much.
    assert got[29] < 1.9 * got[6] < -2000


def test_kinds_read_every_learning_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def seen(text):
        read.add(1)
        return text

    texts = [f"{'alpha beta' if i % 2 else 'uno due tre'} Word{i} ".encode() * 5 for i in range(40)] + [b"", b"abc", b"abcd"]
    rows = spark.createDataFrame([(bytearray(t), i % 10 == 0) for i, t in enumerate(texts)], "text binary, held_out boolean")
    found = lm_scoring.found_kinds(rows.withColumn("text", seen("text")))
    learning = [t for i, t in enumerate(texts) if i % 10]
    assert read.value == len(learning)
    by = np.stack([lm_scoring.kinds.of_text(t) for t in learning])
    assert np.allclose(found.mean, by.mean(axis=0), atol=1e-12)
    shifted = [np.bincount([(int.from_bytes(t.lower()[a : a + 4], "big") * 2654435761 % 2**32) >> 25 for a in range(len(t) - 3)], minlength=lm_scoring.kinds.BUCKETS) for t in texts]
    assert all(np.array_equal(lm_scoring.kinds.pieces(t), n) for t, n in zip(texts, shifted, strict=True))


def test_no_expert_is_without_weight_however_large_the_logits():
    w = attention.initial(9, 1)
    w["down_bias"] = np.array([500, -500, *[-300] * (attention.EXPERTS - 2)], np.float32)
    z = attention.gates(w, w["embed"], np.random.default_rng(5).integers(0, 9, (2, attention.WINDOW)))
    assert np.allclose(z.sum(2), 1, atol=1e-5) and z.min() > 0
    w["down_bias"][:] = -500
    assert np.allclose(attention.gates(w, w["embed"], np.zeros((1, attention.WINDOW), int)), 1 / attention.EXPERTS, atol=1e-5)


def test_a_block_is_read_and_priced_in_parts(spark, tmp_path):
    r = np.random.default_rng(3)
    words = [b"w%d" % i for i in range(40_000)]
    made = [(i % 2, w, *map(int, r.integers(0, 3, attention.EXPERTS))) for i, w in enumerate(words)]
    schema = "block long, word binary, " + ", ".join(f"{c} long" for c in lm_scoring.COUNTS)
    spark.createDataFrame(sorted(made), schema).coalesce(1).write.parquet(f"{tmp_path}/folder=0")
    parts = list(lm_scoring.block_words(str(tmp_path), 1, 0))
    assert max(len(w) for w, _ in parts) <= 1 << 14 and len(parts) > 1
    got = {w: tuple(c) for ws, cs in parts for w, c in zip(ws, cs.tolist(), strict=True)}
    assert got == {x[1]: x[2:] for x in made if x[0] == 1}
    subwords = lm_scoring.Subwords(lm_scoring.load_ranks(lm_scoring.TOKENIZER))
    empty = attention.Spelling.of(subwords.size, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    model = attention.Model(attention.initial(subwords.size, 1), empty)
    totals, types = np.full(attention.EXPERTS, 50_000), np.full(attention.EXPERTS, 30_000)
    scored = lambda parts: lm_scoring.BlockScorer(iter(parts), totals, types, 40_000, model, subwords).score([b"w1 w3 W39999", b""])
    whole = [([w for ws, _ in parts for w in ws], np.concatenate([c for _, c in parts]))]
    assert np.allclose(scored(parts), scored(whole)) and np.allclose(scored([*parts, *parts]), scored(whole))


def test_lm_without_learning_documents_and_with_odd_tables(spark):
    alone = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = lm_scoring.score_documents(H.docs(spark, [(alone[0], "a b"), (alone[1], None), (None, "a b"), (alone[0], "a b")])).collect()
    assert len(got) == 4 and all(x.held_out and x.train_tokens == 0 and x.n_known == 0 and math.isfinite(x.score) for x in got)
    assert len({(x.n_tokens, x.score) for x in got if x.n_tokens == 3}) == 1


def test_words_are_coded_many_texts_at_a_time_as_one_by_one():
    r = random.Random(8)
    texts = [bytes(r.choice(b"aB \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\xc3\xff\x00") for _ in range(r.randint(0, 30))) for _ in range(300)] + [b"", b" ", "É \u00a0x\u2003 y".encode()]
    words, places, lengths = lm_scoring.coded(texts)
    assert len(set(words)) == len(words)
    got = iter([words[p] for p in places])
    assert [[next(got) for _ in range(k)] for k in lengths] == [lm_scoring.words_of(t) for t in texts]
    assert next(got, None) is None and [len(x) for x in lm_scoring.coded([])] == [0, 0, 0] and [len(x) for x in lm_scoring.coded([b" "])] == [0, 0, 1]
    subwords = lm_scoring.Subwords(lm_scoring.load_ranks(lm_scoring.TOKENIZER))
    plain = [w for w in words_in_two_alphabets() if not lm_scoring.OTHER_SPACE.search(w)]
    for some in (plain, [*plain, "a\u00a0\u00a0b", "\u2003c"]):
        ids, n = subwords.encode([w.encode() for w in some])
        want = [subwords.coder.encode_ordinary(f" {w}") for w in some]
        assert n.tolist() == [*map(len, want)] and ids.tolist() == [i for x in want for i in x]


def words_in_two_alphabets():
    r = random.Random(9)
    return ["".join(r.choice("abE'ts0159.,-_éßжя漢") for _ in range(r.randint(1, 12))) for _ in range(2000)]


def test_sums_of_groups_equal_plain_sums():
    r = np.random.default_rng(6)
    n = np.array([0, 1, 12, 13, 0, 144, 145, 3000, 2, 0])
    values, rows = r.normal(size=(50, 4)), r.integers(0, 50, int(n.sum()))
    want = [values[x].sum(axis=0) for x in np.split(rows, np.cumsum(n)[:-1])]
    assert np.allclose(attention.group_sums(values, rows, n), want)
    ids = r.integers(0, 30, 500) ** 2
    for big in (0, 1 << 60):  # too large to be sorted beside their places
        assert (attention.ordered(ids + big) == np.argsort(ids, kind="stable")).all()


def test_counts_are_summed_by_one_shuffle_and_each_word_is_first_once(spark):
    # A block that two tasks read has the same number of its first part in both.
    made = [(5, 1, b"a", 1), (5, 1, b"a", 2), (5, 2, b"b", 3), (7, 1, b"a", 4), (7, 1, b"c", 0), (-9, 1, b"b", 5)]
    schema = "block long, part int, word binary, " + ", ".join(f"{c} int" for c in lm_scoring.COUNTS)
    words = spark.createDataFrame([(*x[:3], x[3], *[0] * (attention.EXPERTS - 2), 1) for x in made], schema)
    sums = lm_scoring.with_sums(words)
    got = sums.collect()
    assert sorted((x.block, bytes(x.word), x.n0, x.n7) for x in got) == sorted((b, w, {b"a": 7, b"b": 8, b"c": 0}[w], {b"a": 3, b"b": 2, b"c": 1}[w]) for b, _, w, _ in made)
    assert sorted(bytes(x.word) for x in got if x.first) == [b"a", b"b", b"c"]
    assert sums._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


# hot groups


def test_hot_groups_dealt_over_tasks_give_the_same(spark, monkeypatch):
    copies = [(i, "a b c d e\n" + "same line\n" * 3 + f"x{i % 3}") for i in range(60)] + [(None, "a b c d e"), (60, None)]
    big = "<html><body><div class='x'><p>" + "words of the article here " * 50 + "</p></div></body></html>"
    pages = spark.createDataFrame([(i, f"http://{'hot' if i % 2 else 'h%d' % i}.com/{i}", big, "own", "own") for i in range(40)], PAGES)
    made = lambda: (rows(line_dedup.dedup_lines(H.docs(spark, copies))), rows(simhash.near_duplicates(H.docs(spark, copies))), rows(warc.with_types(pages).drop("html")), rows(html_extraction.extract(pages)))
    want = made()
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "HOT_KEYS", 1000)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(html_extraction, "BROADCAST_ROWS", 0)
    assert made() == want
    assert sum(r[-1] is not None for r in want[2]) == 39
