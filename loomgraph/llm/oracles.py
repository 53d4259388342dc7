"""DuckDB SQL that gives the rows of the queries that SQL can express."""

MIXING = r"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, 1.0::DOUBLE / (SELECT sum(1.0::DOUBLE) FROM sizes) * (SELECT sum(n) FROM sizes)::DOUBLE / n AS rate FROM sizes
),
drawn AS (SELECT source, rate, greatest(1, ceil(rate / 16.0::DOUBLE))::INTEGER AS draws FROM rates),
cdf AS (
  SELECT source, draws, rate / draws AS mean, 0 AS k, exp(-(rate / draws)) AS p, exp(-(rate / draws)) AS c FROM drawn
  UNION ALL
  SELECT source, draws, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < 64
),
draws AS (
  SELECT doc_id, d.source, d.draws, unnest(range(d.draws)) AS draw
  FROM documents JOIN drawn d ON documents.source IS NOT DISTINCT FROM d.source
),
uniforms AS (
  SELECT doc_id, source, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || draw::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM draws
),
counts AS (
  SELECT doc_id, count(*) FILTER (WHERE cdf.c <= u)::INTEGER AS n_copies
  FROM uniforms JOIN cdf ON uniforms.source IS NOT DISTINCT FROM cdf.source GROUP BY doc_id
),
copies AS (SELECT doc_id, n_copies, unnest(range(n_copies))::INTEGER AS copy FROM counts WHERE n_copies > 0)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.n_copies, c.copy,
       md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '') || '|copy|' || c.copy::VARCHAR) AS mix_key
FROM copies c JOIN documents d USING (doc_id)
"""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
),
keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
),
repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
),
marked AS (
  SELECT keyed.doc_id, i, line, keeper IS NOT NULL AND keyed.doc_id <> keeper AS gone FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: checks(doc_id, h): the CRC-32 of each id as text.
CHECKSUMS = r"""
remainders AS (
  SELECT list(list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) x(b)
),
checks AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda x: ascii(x)::BIGINT)),
                                             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), remainders
)
"""

LANGUAGE_ID = rf"""
WITH {CHECKSUMS},
plain AS (
  SELECT d.doc_id, lang, h % 5 = 0 AS held_out, regexp_matches(coalesce(text, ''), '\p{{L}}') AS any_letter,
         regexp_extract_all(' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{M}}]+', ' ', 'g'), ' ') || ' ', '.') AS l
  FROM documents d JOIN checks USING (doc_id)
),
places AS (SELECT doc_id, lang, held_out, l, unnest(range(1, len(l) + 1)) AS i FROM plain WHERE any_letter),
grams AS (
  SELECT doc_id, lang, held_out, l[i] AS g FROM places WHERE l[i] <> ' '
  UNION ALL SELECT doc_id, lang, held_out, l[i] || l[i + 1] FROM places WHERE i < len(l)
  UNION ALL SELECT doc_id, lang, held_out, l[i] || l[i + 1] || l[i + 2] FROM places WHERE i < len(l) - 1 AND l[i + 1] <> ' '
),
counts AS (SELECT doc_id, lang, held_out, g, count(*) AS n FROM grams GROUP BY ALL),
own AS (
  SELECT doc_id, g, place FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS place FROM counts) WHERE place < 300
),
learned AS (SELECT lang, g, sum(n) AS n FROM counts WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
profiles AS (
  SELECT lang, g, place FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), g) - 1 AS place FROM learned) WHERE place < 300
),
sizes AS (SELECT doc_id, count(*) AS m FROM own GROUP BY doc_id),
nearness AS (
  SELECT s.doc_id, p.lang, m, m * 300 - coalesce(sum(300 - abs(own.place - p.place)), 0) AS distance
  FROM sizes s CROSS JOIN (SELECT DISTINCT lang FROM profiles) x JOIN own USING (doc_id) LEFT JOIN profiles p ON p.lang = x.lang AND p.g = own.g
  WHERE p.lang IS NOT NULL GROUP BY s.doc_id, p.lang, m
),
best AS (SELECT doc_id, arg_min(lang, (distance, lang)) AS lang, min(distance) AS distance, any_value(m) AS m FROM nearness GROUP BY doc_id)
SELECT p.doc_id, p.held_out, CASE WHEN any_letter THEN coalesce(b.lang, (SELECT min(lang) FROM profiles), 'und') ELSE 'und' END AS lang_pred,
       CASE WHEN any_letter THEN coalesce(1.0::DOUBLE - distance::DOUBLE / (300 * m)::DOUBLE, 0.0) ELSE 0.0::DOUBLE END AS score
FROM plain p LEFT JOIN best b USING (doc_id)
"""

LEXICAL_SEARCH = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM documents WHERE doc_id IS NOT NULL
),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark WHERE item_id IS NOT NULL
),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS d, sum(n)::BIGINT AS l FROM lengths),
counts AS (SELECT doc_id, t, count(*) AS tf FROM words WHERE t IN (SELECT t FROM asked) GROUP BY doc_id, t),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(d) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, totals GROUP BY t),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * d) // l))))::BIGINT AS score
  FROM asked JOIN counts USING (t) JOIN weights USING (t) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0)
SELECT item_id, place::INTEGER AS "rank", doc_id, score FROM ranked WHERE place <= 10
"""

PERIODIC_RUNS = rf"""
WITH {CHECKSUMS},
original AS (
  SELECT doc_id, h, w, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g
  FROM (SELECT d.doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents d JOIN checks USING (doc_id))
),
tails AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM original),
texts AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM tails
),
places AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM texts WHERE n >= 24),
equal AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM places x JOIN places y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
),
stretches AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM equal),
periodic AS (SELECT doc_id, min(i) AS s, count(*) + q AS len, q FROM stretches GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT doc_id, s, len, min(q) AS q FROM periodic GROUP BY doc_id, s, len),
firsts AS (
  SELECT r.doc_id, r.s, r.len, r.q FROM runs r
  WHERE NOT EXISTS (
    SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (o.len * r.q > r.len * o.q OR o.len * r.q = r.len * o.q AND (o.s < r.s OR o.s = r.s AND o.q < r.q))
  )
),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
dropped AS (SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, f.s::BIGINT AS "start", f.len::BIGINT AS length, f.q::BIGINT AS period,
       (1000 * f.len // f.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i - 1)) END, ' ')) AS collapsed_sha256
FROM texts t LEFT JOIN listed USING (doc_id) LEFT JOIN firsts f USING (doc_id) LEFT JOIN dropped USING (doc_id)
"""

SQL = {"op6_mixing": MIXING, "op7_line_dedup": LINE_DEDUP, "op11_language_id": LANGUAGE_ID, "op12_lexical_search": LEXICAL_SEARCH, "op13_periodic_runs": PERIODIC_RUNS}
