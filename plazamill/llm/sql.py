"""DuckDB SQL of the operators whose whole rule SQL can state."""

from __future__ import annotations

import string

LOWERED = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

SOURCE_DIVERGENCE = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LOWERED} AS text FROM documents),
occurs AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM occurs GROUP BY ALL HAVING count(DISTINCT row) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM occurs SEMI JOIN kept USING (lang, term) GROUP BY ALL),
in_lang AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM grid JOIN sizes USING (lang)),
usual AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM in_lang JOIN sizes USING (lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM shares JOIN usual USING (lang, term) WHERE n > 0 AND p > q),
every_part AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM every_part QUALIFY part = 'pair' OR rank <= 50
"""

#: crc32 of a text is the exclusive or of one table entry per byte, by the byte and its distance from the end, and of
#: the register that as many zero bytes leave.
IMPORTANCE_RESAMPLING = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (SELECT regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
of_docs AS (SELECT row, array_to_string(words[i : i + n], ' ') AS feature FROM (SELECT row, words, unnest(range(1, len(words) + 1)) AS i FROM docs), range(3) r(n) WHERE i + n <= len(words)),
of_items AS (SELECT array_to_string(words[i : i + n], ' ') AS feature FROM (SELECT words, unnest(range(1, len(words) + 1)) AS i FROM items), range(3) r(n) WHERE i + n <= len(words)),
named AS (SELECT feature, hex(encode(feature)) AS code FROM (SELECT feature FROM of_docs UNION SELECT feature FROM of_items)),
first AS (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM (SELECT unnest(range(256)) AS b)),
line AS (SELECT list(v ORDER BY b) AS z FROM first),
longest AS (SELECT max(length(code)) // 2 AS most FROM named),
steps(k, b, v) AS (SELECT 0::BIGINT, b, v FROM first UNION ALL SELECT k + 1, b, xor(v >> 8, z[(v & 255) + 1]) FROM steps, line, longest WHERE k + 1 < most),
zeros(n, v) AS (SELECT 0::BIGINT, 4294967295 UNION ALL SELECT n + 1, xor(v >> 8, z[(v & 255) + 1]) FROM zeros, line, longest WHERE n < most),
entries AS (SELECT k, hex(b)[-2:] AS byte, v FROM (SELECT k, b, v FROM steps)),
bytes AS (SELECT feature, length(code) // 2 AS n, unnest(range(1, length(code) // 2 + 1)) AS spot, code FROM named),
summed AS (SELECT feature, any_value(n) AS n, bit_xor(v) AS v FROM bytes JOIN entries ON k = n - spot AND byte = substr(code, 2 * spot - 1, 2) GROUP BY feature),
buckets AS (SELECT feature, xor(xor(s.v, z.v), 4294967295) % 10000 AS bucket FROM summed s JOIN zeros z USING (n)),
source AS (SELECT bucket, count(*) AS n FROM of_docs JOIN buckets USING (feature) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS n FROM of_items JOIN buckets USING (feature) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM of_docs)::DOUBLE + 10000 AS s, (SELECT count(*) FROM of_items)::DOUBLE + 10000 AS t),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(b.n, 0)::DOUBLE + 1) * totals.s / ((a.n::DOUBLE + 1) * totals.t)))::BIGINT AS gain FROM source a LEFT JOIN target b USING (bucket), totals),
weights AS (SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM of_docs JOIN buckets USING (feature) JOIN gains USING (bucket) GROUP BY row),
scored AS (SELECT row, doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM docs LEFT JOIN weights USING (row)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM placed
"""
