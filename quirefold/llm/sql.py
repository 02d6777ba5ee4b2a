"""SQL counterparts, for DuckDB over the same tables."""

OP1 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), q AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS f FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f < page_id THEN f END AS refers_to
FROM q
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM g
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), h AS (
  SELECT dw.doc_id, g.item_id, dw.i, dw.n FROM dw JOIN g USING (gram, n)
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)
"""

# Sets meet through any shared shingle here, without prefixes or signatures; components by a recursive walk.
OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                               ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS s
  FROM w
), r AS (
  SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s), len(s)
), e AS (
  SELECT rep, n, unnest(s) AS g FROM r
), l AS (
  SELECT a.rep AS a, b.rep AS b
  FROM e a JOIN e b ON a.g = b.g AND a.rep <> b.rep AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85
  GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), walk AS (
  SELECT rep AS node, rep AS seen FROM r
  UNION
  SELECT walk.node, l.b FROM walk JOIN l ON walk.seen = l.a
), c AS (
  SELECT node, min(seen) AS component FROM walk GROUP BY node
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component, s.doc_id) AS component_id
FROM s LEFT JOIN r ON len(s.s) > 0 AND r.s = list_sort(s.s) LEFT JOIN c ON c.node = r.rep
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Items without item_id, or of one item_id, are told apart by their text and a row number.
OP11 = f"""
WITH d AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM documents
), dn AS (
  SELECT d, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0
), s AS (
  SELECT count(*) AS nn, coalesce(sum(n), 0)::BIGINT AS ll FROM dn
), b AS (
  SELECT row_number() OVER () AS b, item_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM benchmark
), q AS (
  SELECT b, term, count(*) AS c FROM (SELECT b, unnest(w) AS term FROM b) GROUP BY ALL
), tf AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s
), i AS (
  SELECT tf.d, tf.term, w.w, (1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * dn.n * s.nn) // s.ll)) AS i
  FROM tf JOIN dn USING (d) JOIN w USING (term), s
), h AS (
  SELECT q.b, i.d, sum(q.c * i.w * i.i)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL
), r AS (
  SELECT h.b, dn.doc_id, h.score, row_number() OVER (PARTITION BY h.b ORDER BY h.score DESC, dn.doc_id NULLS LAST) AS rank
  FROM h JOIN dn USING (d) WHERE h.score > 0
)
SELECT b.item_id, r.rank::INT AS rank, r.doc_id, r.score FROM r JOIN b USING (b) WHERE r.rank <= 20
"""

# Every phrase is counted and every longer phrase is looked up by its words; no order of streams is used.
OP12 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents
), w AS (
  SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[ 	]+') IF x <> ''] AS w FROM p
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k)
), f AS (
  SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, k, phrase
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT * FROM f WHERE k > 1 AND f >= 10
), gone AS (
  SELECT DISTINCT c.lang, c.phrase FROM c
  JOIN (SELECT lang, f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS inner_phrase FROM c WHERE k = 3) x
    ON x.lang = c.lang AND x.inner_phrase = c.phrase AND 100 * x.f >= 50 * c.f
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, ((1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c ANTI JOIN gone USING (lang, phrase)) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang) QUALIFY rank <= 2000
"""
