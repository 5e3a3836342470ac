"""DuckDB SQL for operators that SQL can express: the plain definitions, without any of the operators' shortcuts."""

from __future__ import annotations

#: Every window of 20 words against all others; words of windows that start earlier elsewhere go.
SUBSTRING_DEDUP = r"""
WITH doc AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
win AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM doc),
named AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS said FROM win),
later AS (SELECT doc_id, i FROM named QUALIFY row_number() OVER (PARTITION BY said ORDER BY doc_id NULLS FIRST, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS i FROM later),
word AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM doc),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS said FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

#: All pairs of documents that share a shingle; components by following links.
NGRAM_JOIN = r"""
WITH RECURSIVE doc AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
tok AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM tok a JOIN tok b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT x, y FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * shared.n >= 90 * (p.n + q.n - shared.n)),
link AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT reach.a, link.y FROM reach JOIN link ON reach.b = link.x),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT x AS doc_id, count(*) AS k FROM link GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(k, 0)::BIGINT AS n_links
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN comp USING (doc_id) LEFT JOIN deg USING (doc_id)
"""

#: Every string of 400 bytes, as hex digits, against all others.
SUFFIX_DEDUP = r"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
piece AS (SELECT r, p, substr(h, 2 * p + 1, 2 * 1399) AS h FROM (SELECT r, h, unnest(range(0, len(h) // 2, 1000)) AS p FROM doc)),
win AS (SELECT r, p + unnest(range(0, least(1000, len(h) // 2 - 399))) AS s, h, p FROM piece WHERE len(h) >= 800),
named AS (SELECT r, s, hash(substr(h, 2 * (s - p) + 1, 800)) AS k FROM win),
twice AS (SELECT r, s FROM named QUALIFY count(*) OVER (PARTITION BY k) > 1),
cut AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 400 THEN 0 ELSE 1 END AS fresh FROM twice),
span AS (SELECT r, min(s) AS a, max(s) + 400 AS z FROM (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS g FROM cut) GROUP BY r, g),
gap AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS f FROM span),
left_ AS (SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM gap JOIN doc USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM doc LEFT JOIN left_ USING (r)
"""

_LE32 = "format('{{:02x}}{{:02x}}{{:02x}}{{:02x}}', {0} % 256, ({0} // 256) % 256, ({0} // 65536) % 256, {0} // 16777216)"

#: The payload and its sound file as hex digits; the checksum bit by bit; features from the counts of bytes.
MEDIA = rf"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
pay AS (SELECT *, len(h) // 2 AS n, h || repeat('00', CASE WHEN len(h) = 0 THEN 64 ELSE (64 - (len(h) // 2) % 64) % 64 END) AS p FROM doc),
wav AS (SELECT *, len(p) // 2 AS m, '52494646' || {_LE32.format("(36 + len(p) // 2)")} || '57415645666d74201000000001000100401f0000401f000001000800' || '64617461' || {_LE32.format("(len(p) // 2)")} || p AS w FROM pay),
bits AS (SELECT r, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(64), lambda i: ('0x' || substr(p, 2 * (m - 64 + i) + 1, 2))::BIGINT)),
  lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda d, k: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384::BIGINT) ELSE d // 2 END)) AS c FROM wav),
part AS (SELECT r, q, substr(p, 2 * q + 1, 2000) AS h FROM (SELECT r, p, unnest(range(0, m, 1000)) AS q FROM wav)),
byte AS (SELECT r, q + i AS place, ('0x' || substr(h, 2 * i + 1, 2))::INTEGER AS x FROM (SELECT r, q, h, unnest(range(0, len(h) // 2)) AS i FROM part)),
turn AS (SELECT r, count(*) FILTER (WHERE (x >= 128) <> (was >= 128)) AS crossings FROM (SELECT r, x, lag(x) OVER (PARTITION BY r ORDER BY place) AS was FROM byte) GROUP BY r),
freq AS (SELECT r, x, count(*) AS k FROM byte GROUP BY r, x),
stat AS (SELECT r, sum(x * k) AS total, sum((x - 128) * (x - 128) * k) AS squares, -sum(k / m * log2(k / m)) AS entropy, [coalesce(sum(k) FILTER (WHERE x // 32 = 0), 0), coalesce(sum(k) FILTER (WHERE x // 32 = 1), 0),
  coalesce(sum(k) FILTER (WHERE x // 32 = 2), 0), coalesce(sum(k) FILTER (WHERE x // 32 = 3), 0), coalesce(sum(k) FILTER (WHERE x // 32 = 4), 0), coalesce(sum(k) FILTER (WHERE x // 32 = 5), 0), coalesce(sum(k) FILTER (WHERE x // 32 = 6), 0),
  coalesce(sum(k) FILTER (WHERE x // 32 = 7), 0)] AS levels FROM freq JOIN (SELECT r, m FROM wav) USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, m::BIGINT AS payload_bytes, sha256(unhex(p)) AS payload_sha256, (4294967295 - c)::BIGINT AS tail_crc32, (len(w) // 2)::BIGINT AS media_bytes, sha256(unhex(w)) AS media_sha256,
  format('mean={{:.4f}};power={{:.4f}};crossings={{}};entropy={{:.4f}};levels={{}}', (total / m)::DOUBLE, (squares / m)::DOUBLE, crossings, greatest(0.0::DOUBLE, entropy), array_to_string(levels, ',')) AS feature,
  1 AS position, coalesce(doc_id::VARCHAR, '') AS caption
FROM wav JOIN bits USING (r) JOIN turn USING (r) JOIN stat USING (r)
"""
