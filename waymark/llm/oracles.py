"""DuckDB SQL with the rows of the queries that SQL can express; fit for small tables only."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

REACH = """two_way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM two_way UNION SELECT r.a, e.b FROM reach r JOIN two_way e ON e.a = r.b),
lowest AS (SELECT a, min(least(a, b)) AS c FROM reach GROUP BY a)"""

NEAR_DOCUMENTS = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
{REACH}
SELECT doc_id, len(sh) AS n_shingles, COALESCE(c, doc_id) AS component_id, COALESCE(c, doc_id) = doc_id AS kept FROM s LEFT JOIN lowest ON a = doc_id"""

REPEATED_WORDS = f"""WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 11)) AS i)),
m AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM win JOIN m USING (g), (SELECT unnest(range(0, 13)) AS k) WHERE first < doc_id),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM u ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - COALESCE(n, 0) AS n_removed, sha256(COALESCE(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

NEAR_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.93),
{REACH}, n AS (SELECT a, count(*) AS n FROM two_way GROUP BY a)
SELECT vec_id, COALESCE(n, 0) AS n_links, COALESCE(c, vec_id) AS component_id, COALESCE(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN lowest ON lowest.a = vec_id LEFT JOIN n ON n.a = vec_id"""
