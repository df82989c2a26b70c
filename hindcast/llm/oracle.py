"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_CONVERSATIONS = r"""
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?[srp]>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS et,
             regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(/?[srp]>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS er,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t)
"""

ORACLE = {
    "op1_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, url, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM l
""",
    "op4_chat_formatting": f"""
WITH {_CONVERSATIONS}
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(et) + CASE WHEN before IS DISTINCT FROM role THEN length(er) + 10 ELSE 3 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op8_quality_rules": r"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS r FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
again AS (SELECT r, i FROM g WINDOW x AS (PARTITION BY r, g) QUALIFY count(*) OVER x > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
v AS (SELECT *, n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
             n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS word_length FROM m),
x AS (SELECT lang, source, unnest([{'m': 1, 'share': 0.2::DOUBLE, 'v': symbol_ratio}, {'m': 2, 'share': 0.6::DOUBLE, 'v': dup_line_ratio},
                                   {'m': 3, 'share': 0.6::DOUBLE, 'v': repeat_ratio}, {'m': 4, 'share': 0.35::DOUBLE, 'v': word_length}]) AS x FROM v
      WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)),
s AS (SELECT CASE WHEN grouping(source) = 0 THEN 0 WHEN grouping(lang) = 0 THEN 1 ELSE 2 END AS level, lang, source, m, share, b, count(*) AS n
      FROM (SELECT lang, source, x.m AS m, x.share AS share, CASE WHEN x.v > 0 THEN ceil(ln(x.v) / ln(1.01::DOUBLE)) ELSE -100000 END AS b FROM x)
      GROUP BY GROUPING SETS ((lang, source, m, share, b), (lang, m, share, b), (m, share, b))),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, m ORDER BY b) AS below, sum(n) OVER (PARTITION BY level, lang, source, m) AS total,
             CASE WHEN b = -100000 THEN 0.0 ELSE pow(1.01::DOUBLE, b + 0.001::DOUBLE) END AS val FROM s),
q AS (SELECT level, lang, source, m, share, max(total) AS docs, min(val) FILTER (below >= ceil(total * 0.5::DOUBLE)) AS mid, min(val) FILTER (below >= ceil(total * 0.75::DOUBLE)) AS high,
             min(val) FILTER (below >= ceil(total * 0.995::DOUBLE)) AS reach FROM c GROUP BY ALL),
f AS (SELECT level, lang, source, m, docs, mid + greatest(share * (reach - mid), 4.0::DOUBLE * (high - mid)) AS fence FROM q),
p AS (SELECT level, lang, source, max(docs) AS docs, max(fence) FILTER (m = 1) AS f1, max(fence) FILTER (m = 2) AS f2, max(fence) FILTER (m = 3) AS f3, max(fence) FILTER (m = 4) AS f4 FROM f GROUP BY ALL),
j AS (SELECT v.*, CASE WHEN o.docs >= 200 THEN o WHEN l.docs >= 200 THEN l ELSE e END AS p FROM v
      LEFT JOIN p o ON o.level = 0 AND o.lang IS NOT DISTINCT FROM v.lang AND o.source IS NOT DISTINCT FROM v.source
      LEFT JOIN p l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM v.lang LEFT JOIN p e ON e.level = 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       coalesce(NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND symbol_ratio <= p.f1 AND dup_line_ratio <= p.f2 AND repeat_ratio <= p.f3 AND word_length <= p.f4, false) AS kept
FROM j
""",
    "op9_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
k AS (SELECT doc_id, source, md5(text) AS digest, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             -ln((CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(text)), 1, 12) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
             / greatest(0.1::DOUBLE, (1.0::DOUBLE - 3.0::DOUBLE * ((length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::DOUBLE / greatest(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')), 1)))
                        * (1.0::DOUBLE - (len(lines) - len(list_distinct(lines)))::DOUBLE / greatest(len(lines), 1))) AS key
      FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
r AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS most FROM s),
o AS (SELECT *, coalesce(sum(most) OVER w, 0) AS filled, coalesce(sum(weight) OVER w, 0) AS before, sum(source_size) OVER () AS every, sum(weight) OVER () AS weights
      FROM r WINDOW w AS (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (every::DOUBLE * 1.5::DOUBLE - filled::DOUBLE) / (weights - before)::DOUBLE AS level FROM o),
m AS (SELECT *, (SELECT min_by(level, most::DOUBLE / weight) FROM l WHERE most > level * weight) AS flat FROM l),
t AS (SELECT source, source_size, CASE WHEN flat IS NULL THEN most::DOUBLE ELSE least(most::DOUBLE, flat * weight) END AS target FROM m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             floor(65536 * (1.0::DOUBLE - exp(-key))) AS bucket FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
b AS (SELECT *, max(upto) OVER (PARTITION BY source, bucket) AS full_to FROM p)
SELECT doc_id, size, source_size, target, size * (epochs + CASE WHEN full_to <= rest OR upto - size::DOUBLE / 2 <= rest THEN CASE WHEN source_size <= rest THEN 0 ELSE 1 END ELSE 0 END) AS taken FROM b
""",
    "op2_decontamination": r"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS x FROM p),
l AS (SELECT DISTINCT n FROM g),
q AS (SELECT r, w, n, unnest(range(1, CAST(len(w) AS BIGINT) - n + 2)) AS pos FROM d, l WHERE len(w) >= n),
h AS (SELECT r, pos, q.n, item FROM (SELECT r, pos, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS x FROM q) q JOIN g ON q.n = g.n AND q.x = g.x),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS k FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
""",
    "op5_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT r, doc_id, i, array_to_string(l[i : i + 2], chr(10)) AS x FROM (SELECT r, doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3)),
f AS (SELECT *, min(struct_pack(d := doc_id, i := i)) OVER (PARTITION BY x) AS first FROM w WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
c AS (SELECT DISTINCT r, i + k AS i FROM f, (SELECT unnest([0, 1, 2]) AS k) WHERE struct_pack(d := doc_id, i := f.i) > first),
s AS (SELECT r, doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM d)
SELECT doc_id, count(*) AS n_lines, count(c.r) AS n_removed, coalesce(string_agg(x, chr(10) ORDER BY s.i) FILTER (c.r IS NULL), '') AS text
FROM s LEFT JOIN c ON s.r = c.r AND s.i = c.i GROUP BY s.r, doc_id
""",
}


def vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Codebooks by the distance of every part to every entry: three WITH queries for each round."""
    assigned = """
a{0} AS MATERIALIZED (SELECT id, p, min(e) FILTER (d = least) AS e, any_value(least) AS d FROM (SELECT *, min(d) OVER (PARTITION BY id, p) AS least FROM (SELECT x.id, x.p, b.e, list_inner_product(x.x, x.x) - 2 * list_inner_product(x.x, b.c) + list_inner_product(b.c, b.c) AS d FROM parts x JOIN b{0} b ON x.p = b.p)) GROUP BY id, p)"""
    moved = """
s{0} AS (SELECT p, e, k, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.p, a.e, unnest(x.x) AS v, generate_subscripts(x.x, 1) AS k FROM a{0} a JOIN parts x ON a.id = x.id AND a.p = x.p) GROUP BY p, e, k),
b{1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{0} b LEFT JOIN (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY k) AS c FROM s{0} GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""
    steps = ",".join(f"{assigned},{moved}".format(r, r + 1) for r in range(rounds)) + "," + assigned.format(rounds)
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, v) AS id, * FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS MATERIALIZED (SELECT id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) t(p)),
b0 AS (SELECT p, id - 1 AS e, x AS c FROM parts WHERE id <= {entries}),{steps},
h AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS k FROM b{rounds})),
r AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN r USING (id), h
"""


ORACLE["op12_vector_codes"] = vector_codes_sql()


#: CRC-32 of the decimal doc_id, bit by bit; runs from equal three-word sequences q words apart, as a run of four periods and six words has them.
ORACLE["op11_periodic_runs"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) AS h FROM documents),
e AS (SELECT *, CAST(len(w) AS BIGINT) AS n, (h // 10) % greatest(len(w), 1) AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
t AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM f),
x AS MATERIALIZED (SELECT r, n, i, w[i + 1] AS one, hash(w[i + 1 : i + 3]) AS k FROM (SELECT r, n, w, unnest(range(n)) AS i FROM t)),
o AS MATERIALIZED (SELECT r, n, i, k FROM x WHERE i < n - 2 QUALIFY count(*) OVER (PARTITION BY r, k) >= 3),
m AS (SELECT y.r, y.i, z.i - y.i AS q FROM o y JOIN o z ON y.r = z.r AND y.k = z.k AND z.i > y.i AND 4 * (z.i - y.i) <= y.n),
g AS (SELECT r, q, min(i) AS start, max(i) - min(i) + 3 + q AS length FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m) GROUP BY r, q, island),
u AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM g WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
b AS (SELECT r, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, p := period), struct_pack(l := -length, s := start, p := period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM u GROUP BY r),
c AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u),
k AS (SELECT x.r, string_agg(one, ' ' ORDER BY x.i) FILTER (c.r IS NULL) AS text FROM x LEFT JOIN c ON x.r = c.r AND x.i = c.i GROUP BY x.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (r) LEFT JOIN k USING (r)
"""

ORACLE["op13_minhash"] = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
b AS MATERIALIZED (SELECT y.r, z.r AS o, count(*) AS n FROM s y JOIN s z ON y.x = z.x AND y.r <> z.r GROUP BY ALL),
l AS MATERIALIZED (SELECT b.r, b.o FROM b JOIN n y ON b.r = y.r JOIN n z ON b.o = z.r WHERE 100 * b.n >= 85 * (y.n + z.n - b.n)),
c(r, o) AS (SELECT r, r FROM d UNION SELECT c.r, l.o FROM c JOIN l ON c.o = l.r),
m AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN d ON c.o = d.r GROUP BY c.r)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id IS NOT DISTINCT FROM doc_id AS kept FROM d JOIN m USING (r) LEFT JOIN n USING (r)
"""
