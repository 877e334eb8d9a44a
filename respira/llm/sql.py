"""DuckDB text of the operators that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH RECURSIVE units AS (
  SELECT doc_id, source, sum(greatest(len({WORDS}), 1))::BIGINT AS n_tokens FROM documents GROUP BY doc_id, source
), totals AS (
  SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n_units FROM units GROUP BY source
), whole AS (
  SELECT sum(tokens)::DOUBLE AS t, count(*) AS n, min(tokens) AS lo, max(tokens) AS hi FROM totals
), shares AS (
  SELECT ln(tokens / t) AS l, 0.95 * ln(n) AS target FROM totals, whole
), as_is AS (
  SELECT ln(sum(exp(l))) - sum(l * exp(l)) / sum(exp(l)) >= max(target) AS enough FROM shares
), steps AS (
  SELECT 0 AS k, CASE WHEN enough THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lo, 1.0::DOUBLE AS hi FROM as_is
  UNION ALL
  SELECT k + 1, CASE WHEN good THEN (lo + hi) / 2 ELSE lo END, CASE WHEN good THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT k, lo, hi, (SELECT ln(sum(exp((lo + hi) / 2 * l))) - (lo + hi) / 2 * sum(l * exp((lo + hi) / 2 * l)) / sum(exp((lo + hi) / 2 * l)) >= max(target) FROM shares) AS good
        FROM steps WHERE k < 24)
), exponent AS (
  SELECT CASE WHEN n = 1 THEN 1.0 ELSE ceil(greatest(s.lo, CASE WHEN ln(hi / whole.lo) > ln(1.5) THEN 1 - ln(1.5) / ln(hi / whole.lo) ELSE 0.0 END) * 1e6) / 1e6 END AS a, whole.hi AS most
  FROM whole, (SELECT max(lo) AS lo FROM steps WHERE k = (SELECT max(k) FROM steps)) s
), plan AS (
  SELECT source, tokens, floor(tokens * pow(tokens / most, a - 1.0) + 0.5)::BIGINT AS budget FROM totals, exponent
), blocks AS (
  SELECT greatest(1, ceil(sum(budget) / 1000000.0)) AS n FROM plan
), copies AS (
  SELECT u.doc_id, u.source, n_tokens, tokens, budget, unnest(range(0, ceil(budget / tokens)::BIGINT)) AS epoch
  FROM units u JOIN plan p ON u.source IS NOT DISTINCT FROM p.source
), placed AS (
  SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch
    ORDER BY md5('7-' || epoch || '-' || coalesce(doc_id::VARCHAR, '?')), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM copies
), blocked AS (
  SELECT doc_id, source, n_tokens, epoch, floor(start * n / budget)::BIGINT AS block FROM placed, blocks WHERE start + n_tokens <= budget
)
SELECT doc_id, source, n_tokens, epoch::INTEGER AS epoch, block, row_number() OVER (PARTITION BY block
  ORDER BY md5('7-block-' || coalesce(source, '?') || '-' || epoch || '-' || coalesce(doc_id::VARCHAR, '?')), doc_id, source, epoch) AS position
FROM blocked
"""

OP2 = rf"""
WITH split AS (
  SELECT doc_id, source, text, {WORDS} AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split
), windows AS (
  SELECT doc_id, i, CASE WHEN lead(w, 2) OVER o IS NOT NULL THEN w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o END AS g
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS again FROM windows
), covered AS (
  SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside FROM twice
), repeats AS (
  SELECT doc_id, count(*) FILTER (inside) AS n_repeat_words FROM covered GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(ls) AS line FROM split
), dups AS (
  SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id
), base AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM judged GROUP BY source
), moments AS (
  SELECT avg(failed / n) AS mean, avg((failed / n) * (failed / n)) AS square, avg(1 / n) AS small, sum(n)::DOUBLE AS n FROM hosts
), prior AS (
  SELECT mean, n, mean * (1 - mean) AS binomial, square - mean ** 2 - mean * (1 - mean) * small AS spread FROM moments
), strength AS (
  SELECT mean, greatest(least(CASE WHEN spread > 0 THEN binomial / spread - 1 ELSE n END, n), 2) AS st FROM prior
), shrunk AS (
  SELECT source, n + st AS size, (failed + mean * st) / (n + st) AS rate FROM hosts, strength
), verdicts AS (
  SELECT source, rate - 1.645 * sqrt(rate * (1 - rate) / (size + 1)) >= 0.5 AS bad FROM shrunk
)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
"""

OP3 = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_transform({WORDS}, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM split WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM split UNION SELECT l.a, r.r FROM links l JOIN reach r ON r.doc_id = l.b
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(r) FROM reach r WHERE r.doc_id = s.doc_id) AS component_id
FROM split s LEFT JOIN sizes USING (doc_id)
"""

OP7 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, line, i, c.key IS NOT NULL AND doc_id <> keep AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP13 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), anchors AS (
  SELECT row_number() OVER () AS k, * FROM v WHERE vec_id % 100 = 0
), scores AS (
  SELECT k, a.vec_id AS anchor_id, v.vec_id AS other_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score FROM anchors a JOIN v ON a.vec_id <> v.vec_id
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, other_id) AS place FROM scores WHERE same QUALIFY place <= 5
), negatives AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.k, place ORDER BY n.score DESC, n.other_id)::INTEGER AS rank
  FROM positives p JOIN scores n ON n.k = p.k AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""

# crc32 of an id's digits: each digit's code, then eight shifts
CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [ord(d), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

OP11 = rf"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), wide AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS own FROM turns GROUP BY conv_id
), hashed AS (
  SELECT *, {CRC} % 9 AS h FROM wide
), rebuilt AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, h), list_slice(c.own, h + 1, len(c.own))) AS seq FROM hashed c LEFT JOIN wide b ON b.conv_id = c.conv_id - c.conv_id % 5
), prefixes AS (
  SELECT conv_id, d, list_slice(seq, 1, d) AS p FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n FROM prefixes GROUP BY d, p
), kids AS (
  SELECT d - 1 AS d, list_slice(p, 1, d - 1) AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2
), below AS (
  SELECT q.d, q.p, count(*) FILTER (k.n IS NULL) AS n_leaves, sum(CASE WHEN u.d = 0 THEN 0 ELSE (u.n - 1) * strlen(u.p[u.d].text) END)::BIGINT AS saved_tokens
  FROM nodes u LEFT JOIN kids k ON k.d = u.d AND k.p = u.p JOIN prefixes q ON q.conv_id = u.conv_id AND q.d <= u.d GROUP BY q.d, q.p
), ends AS (
  SELECT len(seq) AS d, seq AS p, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM rebuilt GROUP BY 1, 2
)
SELECT v.conv_id, v.d AS depth, up.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(k.n, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes v JOIN below b ON b.d = v.d AND b.p = v.p LEFT JOIN kids k ON k.d = v.d AND k.p = v.p LEFT JOIN ends e ON e.d = v.d AND e.p = v.p
LEFT JOIN nodes up ON up.d = v.d - 1 AND up.p = list_slice(v.p, 1, v.d - 1)
"""
