"""Check SQL of the corpus queries that SQL can say over whole tables."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOW = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
COLLOCATIONS = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, {LOW} AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang), s AS (SELECT lang, ws, unnest([1, 2, 3, 4, 5]) AS size FROM w), i AS (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM s),
f AS (SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase, count(*) AS f FROM i GROUP BY ALL HAVING count(*) >= 100),
k AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM f WHERE size >= 2),
c AS (SELECT k.lang, k.phrase, k.size, a, k, l.f AS l, r.f AS r, n.n, CAST(1000::HUGEINT * a * n.n // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM k JOIN n ON n.lang = k.lang
  JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(ws[1 : k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(ws[k + 1 : ], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM c) q WHERE nth = 1),
x AS (SELECT lang, a, size, string_split(phrase, ' ') AS ws, unnest([2, 3, 4]) AS m FROM b), y AS (SELECT lang, a, ws, m, unnest(range(1, size - m + 2)) AS i FROM x WHERE m < size),
z AS (SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(a) AS inside FROM y GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN z ON z.lang = b.lang AND z.phrase = b.phrase WHERE inside IS NULL OR 100 * inside < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000"""
RESAMPLING = f"""WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
dw AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents), bw AS (SELECT unnest(regexp_extract_all({LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
u AS (SELECT DISTINCT w FROM (SELECT unnest(ws) AS w FROM dw UNION ALL SELECT w FROM bw) q),
h AS (SELECT w, list_transform(range(length(hex(w)) // 2), lambda i: CAST(concat('0x', substr(hex(w), 2 * i + 1, 2)) AS BIGINT)) AS bytes FROM u),
k AS (SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, c),
e AS (SELECT doc_id, unnest(ws) AS w FROM dw), s AS (SELECT bucket, count(*) AS s FROM e JOIN k USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN k USING (w) GROUP BY bucket),
g AS (SELECT s.bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT sum(s) FROM s) + 10000) / (CAST(s + 1 AS DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM e JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('2024:', CAST(doc_id AS STRING))), 1, 8)) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM dw LEFT JOIN m USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS able FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM o"""

CHECKS: dict[str, str] = {"op11_target_resampling": RESAMPLING, "op12_collocations": COLLOCATIONS}
