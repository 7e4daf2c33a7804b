"""DuckDB SQL for the queries of this subpackage that SQL can express."""

EXACT = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

TOP_K = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
  GROUP BY ALL
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
  FROM scores
)
SELECT * FROM ranked WHERE rank <= 10
"""

NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS shingle
  FROM w, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS r(i) WHERE len(words) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), both_sets AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b USING (shingle)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM both_sets JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), t AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10
), cells AS (
  SELECT t.lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY ALL
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL
), p AS (
  SELECT k.lang, t.source, k.term, coalesce(c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2)) // (t.n + 2 * v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (s.n + 2 * v) AS q
  FROM kept k JOIN totals t USING (lang) JOIN sizes s USING (lang)
  LEFT JOIN cells x ON x.lang = k.lang AND x.source = t.source AND x.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), apart AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE c > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
  UNION ALL
  SELECT * FROM (
    SELECT lang, source, 'term', item, value,
      row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM apart
  ) WHERE rank <= 10
)
SELECT * FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_near_dedup": NEAR, "op1_exact_topk": TOP_K, "op10_exact_dedup": EXACT, "op12_source_divergence": DIVERGENCE}
