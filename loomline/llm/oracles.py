"""The same results in DuckDB's SQL, for the operators that SQL can express over whole tables.

op2 (a tree of splits), op9 (a tokenizer) and op11 (eigenvectors) have none; tests/llm compare them with plain versions instead. op6 has one for
pages such as the table's, whose main text is what <article> holds; tests/llm have others."""

from __future__ import annotations

from loomline.llm import licenses

WORD = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{WORD}')"


def plain_words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{PLAIN}')"


OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {words('text')} AS w FROM documents),
f AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, len(w) AS n FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, n - 3)) AS i FROM f)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
hit AS (SELECT r, count(DISTINCT i + k) AS n_repeat FROM twice, range(5) t(k) GROUP BY r),
m AS (SELECT f.*, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, (length(text) - length(replace(text, '!!', ''))) / 2 AS shouted FROM f LEFT JOIN hit USING (r)),
b AS (SELECT *, n < 10 OR 100 * n_repeat_words > 20 * n AS base_failed FROM m)
SELECT doc_id, n AS n_words, cast(word_chars AS bigint) AS word_chars, cast(n_symbols AS bigint) AS n_symbols, cast(n_dup_lines AS bigint) AS n_dup_lines, cast(n_repeat_words AS bigint) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > 30 * n OR 100 * shouted > 20 * n OR word_chars < 2 * n OR word_chars > 20 * n OR (len(lines) >= 4 AND 100 * n_dup_lines > 50 * len(lines))
    OR (n >= 50 AND 100 * len(list_distinct(w)) < 2 * n) OR 100 * len(list_filter(w, lambda x: octet_length(encode(x)) > 1 AND upper(x) = x AND lower(x) <> x)) > 60 * n
    OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) < 60 * n) AS kept
FROM b
"""

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS w FROM documents),
p AS (SELECT r, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i:i + 34], ' ') END AS g FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c AS (SELECT *, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 THEN 1 ELSE 0 END AS dup FROM p),
k AS (SELECT *, max(dup) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
s AS (SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM k GROUP BY r)
SELECT doc_id, len(w) AS n_words, cast(coalesce(n_removed, 0) AS bigint) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {plain_words('text')} AS w FROM documents), b AS (SELECT item_id, {plain_words('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM m), range(10) t(k) WHERE k < n GROUP BY r),
l AS (SELECT r, list_sort(list(DISTINCT cast(item_id AS string))) AS ids FROM m GROUP BY r)
SELECT doc_id, len(w) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(len(ids), 0) AS bigint) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN l USING (r)
"""

OP5 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, i, substr(h, 2 * i - 1, 2) AS b, CASE WHEN 2 * (i + 199) <= length(h) THEN md5(substr(h, 2 * i - 1, 400)) END AS g FROM (SELECT r, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM d)),
c AS (SELECT *, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 THEN 1 ELSE 0 END AS dup FROM p),
k AS (SELECT *, max(dup) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM c),
s AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY r ORDER BY i) AS was FROM k),
a AS (SELECT r, sum(gone) AS n_removed, count(*) FILTER (WHERE gone = 1 AND was = 0) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM s GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, cast(coalesce(n_removed, 0) AS bigint) AS n_removed, cast(coalesce(n_spans, 0) AS bigint) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (r)
"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN c USING (r) LEFT JOIN n USING (r)
"""

_DECODED = "regexp_replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;?', '&', 'g')"
OP6 = f"""
WITH p AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS a FROM pages),
q AS (SELECT page_id, url, regexp_split_to_array(regexp_replace(regexp_replace(a, '<br[^>]*>', ' ', 'g'), '</?(a|b|i|em|strong|span)( [^>]*)?>', '', 'g'), '<[^>]*>') AS parts FROM p),
r AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace({_DECODED}, '\\s+', ' ', 'g'))) AS parts FROM q),
t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '') AS text FROM r)
SELECT page_id, url, text, cast(length(text) AS bigint) AS n_chars FROM t
"""

BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h || '000', 1 + cast(5 * i // 4 AS int), 3))::int >> (7 - cast(5 * i % 4 AS int))) % 32, 1)), '')"

OP8 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), q AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, cast(n AS bigint) AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM q
"""


def _templates() -> str:
    """label, tokens, words of a block, and the phrases (each between spaces) as SQL rows."""
    rows = []
    for t in licenses.templates():
        w = licenses.spelt(t.text).split()
        rows.append(f"('{t.label}', {sorted(set(w))!r}, {licenses.block_words(len(w))}, {[f' {p} ' for p in t.phrases]!r})")
    return ", ".join(rows)


def _phrase(words_: str) -> str:
    parts = words_.split()
    return f"list_filter(range(1, len(w) - {len(parts) - 2}), lambda i: " + " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts)) + ")"


_PLACES = {label: _phrase(p) for p, label in licenses.PHRASES.items()}

OP10 = f"""
WITH t(name, tokens, n, phrases) AS (VALUES {_templates()}), d AS (SELECT row_number() OVER () AS r, doc_id, {plain_words('text')} AS w FROM documents),
b AS (SELECT *, list_concat({', '.join(_PLACES.values())}) AS places, list_filter([{', '.join(f"CASE WHEN len({x}) > 0 THEN '{n}' END" for n, x in _PLACES.items())}], lambda x: x IS NOT NULL) AS base FROM d),
p AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS whole FROM d),
c AS (SELECT r, w, t.* FROM p JOIN t ON len(list_filter(phrases, lambda x: NOT contains(whole, x))) = 0),
k AS (SELECT r, name, tokens, phrases, w[greatest(1, i - n + 1):i] AS block FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM c)),
m AS (SELECT r, name, max(len(list_intersect(list_distinct(block), tokens)) / len(tokens)) AS share FROM k WHERE len(list_filter(phrases, lambda x: NOT contains(' ' || array_to_string(block, ' ') || ' ', x))) = 0 GROUP BY 1, 2),
f AS (SELECT r, list(DISTINCT name) AS names, max(share) AS score FROM m WHERE share >= {licenses.THRESHOLD}e0 GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(names, [])))), ',') AS labels, coalesce(score, 0e0) AS score FROM b LEFT JOIN f USING (r)
"""

#: The checksum's table by its rule, then a feature's bytes one at a time, for all features at once.
OP12 = f"""
WITH RECURSIVE e(k, i, c) AS (SELECT k, 0, k FROM range(256) t(k) UNION ALL SELECT k, i + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM e WHERE i < 8),
tab AS (SELECT k, c AS v FROM e WHERE i = 8), byte AS (SELECT upper(printf('%02x', k)) AS x, k FROM tab),
d AS (SELECT row_number() OVER () AS r, doc_id, {plain_words('text')} AS w FROM documents), b AS (SELECT {plain_words('text')} AS w FROM benchmark),
g AS (SELECT r, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT * FROM d UNION ALL SELECT NULL, NULL, w FROM b)), range(1, 4) t(n) WHERE i + n - 1 <= len(w)),
f AS (SELECT DISTINCT g, hex(encode(g)) AS h FROM g),
crc(g, h, i, c) AS (SELECT g, h, 0, 4294967295 FROM f UNION ALL
  SELECT g, h, i + 1, xor(crc.c >> 8, tab.v) FROM crc JOIN byte ON byte.x = substr(h, 2 * i + 1, 2) JOIN tab ON tab.k = xor(crc.c & 255, byte.k) WHERE 2 * i < length(h)),
u AS (SELECT g, xor(c, 4294967295) % 10000 AS k FROM crc WHERE 2 * i = length(h)),
n AS (SELECT k, count(r) AS s, count(*) - count(r) AS t FROM g JOIN u USING (g) GROUP BY k),
z AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
gain AS (SELECT k, floor(1000e0 * ln((n.t + 1)::DOUBLE * (z.s + 10000)::DOUBLE / ((n.s + 1)::DOUBLE * (z.t + 10000)::DOUBLE)))::BIGINT AS v FROM n, z),
m AS (SELECT r, count(*) AS n, sum(v)::BIGINT AS v FROM g JOIN u USING (g) JOIN gain USING (k) WHERE r IS NOT NULL GROUP BY r),
a AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(v, 0) AS weight, ('0x' || substr(sha256('42:' || coalesce(doc_id::STRING, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (r)),
p AS (SELECT *, weight + floor(-1000e0 * ln(-ln((h + 0.5e0) / 4294967296e0)))::BIGINT AS score FROM a),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM p WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank, n_words FROM p LEFT JOIN o USING (r)
"""

OP13 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r),
t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM t WHERE rank <= 10
"""

ORACLES = {
    "op1_quality_rules": OP1,
    "op3_substring_dedup": OP3,
    "op4_benchmark_decontamination": OP4,
    "op5_suffix_array_dedup": OP5,
    "op6_html_extraction": OP6,
    "op7_ngram_jaccard_join": OP7,
    "op8_warc_bundles": OP8,
    "op10_license_scan": OP10,
    "op12_importance_resampling": OP12,
    "op13_pivot_top_k": OP13,
}
