"""DuckDB SQL for the operators' queries that SQL can express over whole tables."""

from __future__ import annotations

from . import warc_index

_SPAN_RULES = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
_EACH = " UNION ALL ".join(
    f"SELECT row, '{kind}' AS kind, {i} AS ord, regexp_split_to_array(body, '{p}') AS gaps, regexp_extract_all(body, '{p}') AS found, regexp_extract_all(body, '{p}', {g}) AS sized, {n} AS least FROM d WHERE regexp_matches(body, '{p}')"
    for i, (kind, p, g, n) in enumerate(_SPAN_RULES)
)
#: A text splits at its matches, so running sums of the lengths of pieces and matches are the spans.
SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body FROM documents), e AS ({_EACH}),
m AS (SELECT row, kind, ord, least, unnest(range(1, len(found) + 1)) AS i, gaps, found, sized FROM e),
n AS (SELECT row, kind, ord, least, i, length(gaps[i]) AS gap, length(found[i]) AS size, length(sized[i]) AS value FROM m),
s AS (SELECT row, kind, ord, (sum(gap + size) OVER (PARTITION BY row, kind ORDER BY i) - size)::BIGINT AS a, size, value, least FROM n),
k AS (SELECT row, kind, ord, a, a + size AS b FROM s WHERE value >= least),
g AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) FILTER (kind <> 'pem') AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) AS spans FROM k GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row)
"""

_WORD = r"[^\x20\x09-\x0D]+"
QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, 'h' || source AS host, coalesce(text, '') AS body FROM documents), w AS (SELECT row, doc_id, host, body, regexp_extract_all(body, '{_WORD}') AS w FROM d),
g AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w)), t AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM g) WHERE n > 1),
c AS (SELECT row, count(DISTINCT i + k) AS n FROM t, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row),
l AS (SELECT row, host, body, unnest(string_split(body, chr(10))) AS line FROM d), lw AS (SELECT row, host, body, line, regexp_extract_all(line, '{_WORD}') AS lw FROM l), ln AS (SELECT *, len(lw) AS n, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS plain FROM lw WHERE len(lw) > 0),
u AS (SELECT row, (count(*) - count(DISTINCT line)) AS n FROM ln GROUP BY row),
sizes AS (SELECT host, count(DISTINCT body) AS docs FROM d GROUP BY 1), f AS (SELECT host, plain FROM (SELECT host, plain, count(DISTINCT body) AS n FROM ln GROUP BY 1, 2) JOIN sizes USING (host) WHERE n > 10 AND n > docs * 0.05::DOUBLE),
r AS (SELECT row, sum(n)::BIGINT AS n FROM ln JOIN f USING (host, plain) GROUP BY row),
o AS (SELECT row, doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars, len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols FROM w),
a AS (SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0) AS word_chars, n_symbols::BIGINT AS n_symbols, coalesce(u.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(r.n, 0) AS n_removed_words FROM o LEFT JOIN u USING (row) LEFT JOIN c USING (row) LEFT JOIN r USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.3::DOUBLE * n_words AS kept, n_removed_words FROM a
"""

#: Bytes as hex digits, so that strings of bytes are strings of text; all 400-byte strings are compared. Then all sequences of 50 words.
REPEATS = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), p AS (SELECT row, unnest(range(0, length(h) // 2 - 399)) AS i, h FROM d WHERE length(h) >= 800),
s AS (SELECT row, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM p), k AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY m) AS n FROM s) WHERE n > 1),
g AS (SELECT row, i, sum(new) OVER (PARTITION BY row ORDER BY i) AS run FROM (SELECT row, i, CASE WHEN i > lag(i) OVER (PARTITION BY row ORDER BY i) + 400 THEN 1 ELSE 0 END AS new FROM k)), r AS (SELECT row, run, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY 1, 2),
q AS (SELECT row, a, b, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS last FROM r), x AS (SELECT row, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM q JOIN d USING (row) GROUP BY row),
w AS (SELECT row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), wp AS (SELECT row, unnest(range(1, len(w) - 48)) AS i, w FROM w WHERE len(w) >= 50),
wk AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY m) AS n FROM (SELECT row, i, md5(array_to_string(w[i:i + 49], ' ')) AS m FROM wp)) WHERE n > 1),
wc AS (SELECT row, sum(least(50, coalesce(following - i, 50)))::BIGINT AS n FROM (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS following FROM wk) GROUP BY row)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256, coalesce(wc.n, 0) AS n_passage_words FROM d LEFT JOIN x USING (row) LEFT JOIN wc USING (row)
"""

#: CRC-32 byte by byte: the table of the 256 remainders is made by eight steps of the polynomial's division.
_CRC = """
polynomial AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM (SELECT unnest(range(256)) AS i))),
coded AS (SELECT f, xor(list_reduce([4294967295] || list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM own UNION SELECT f FROM wanted)), polynomial)"""
_RUNS = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f"
RESAMPLING = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents), own AS (SELECT row, {_RUNS} FROM d), wanted AS (SELECT {_RUNS} FROM benchmark), {_CRC},
s AS (SELECT bucket, count(*) AS s FROM own JOIN coded USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM wanted JOIN coded USING (f) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM own) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT row, count(*) AS n, sum(gain)::BIGINT AS weight FROM own JOIN coded USING (f) JOIN g USING (bucket) GROUP BY row),
c AS (SELECT row, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (row)),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row) AS rank FROM c WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank FROM c LEFT JOIN r USING (row)
"""

#: All pairs of different sets that share a shingle; then the least id spreads along the links.
JACCARD = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
g AS (SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM d),
k AS (SELECT md5(array_to_string(s, chr(10))) AS k, min(doc_id) AS least, any_value(s) AS s, any_value(len(s)) AS n FROM g WHERE len(s) > 0 GROUP BY 1), e AS (SELECT k, n, unnest(s) AS x FROM k),
p AS (SELECT a.k AS a, b.k AS b, any_value(a.n + b.n) AS n, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.k < b.k AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY 1, 2), l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(k, i) AS (SELECT k, least FROM k UNION SELECT u.b, r.i FROM r JOIN u ON r.k = u.a), c AS (SELECT k, min(i) AS i FROM r GROUP BY k)
SELECT doc_id, len(s) AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE c.i END AS component_id FROM g LEFT JOIN c ON c.k = md5(array_to_string(g.s, chr(10)))
"""

ORACLE_SQL = {"op2_capture_index": warc_index.ORACLE, "op6_blob_ledger": SECRETS, "op7_line_frequency": QUALITY, "op9_bucket_refinement": REPEATS, "op11_universe_partition": JACCARD, "op12_gain_array": RESAMPLING}
