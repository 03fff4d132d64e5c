"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
owner AS (SELECT h, min(doc_id) AS o FROM win GROUP BY h),
hit AS (SELECT doc_id, list(i ORDER BY i) AS starts FROM win JOIN owner USING (h) WHERE o < doc_id GROUP BY doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 50)))) AS g FROM hit),
k AS (SELECT d.doc_id, w, CASE WHEN g IS NULL THEN w ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i))), lambda i: w[i]) END AS kept FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""

OP2 = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents), n AS (SELECT *, length(x) // 2 AS n FROM d),
win AS (SELECT r, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT r, x, unnest(range(0, n - 399)) AS i FROM n WHERE n >= 400)),
dup AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM win SEMI JOIN dup USING (h)),
run AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM hit) GROUP BY r, k),
cut AS (SELECT r, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS gone FROM run GROUP BY r),
kept AS (SELECT doc_id, n, a, gone, CASE WHEN a IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(a) + 1), lambda k: substr(x, CASE WHEN k = 0 THEN 1 ELSE 2 * b[k] + 1 END, 2 * (CASE WHEN k = len(a) THEN n ELSE a[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE b[k] END))), '') END AS x FROM n LEFT JOIN cut USING (r))
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(len(a), 0)::BIGINT AS n_spans, sha256(unhex(x)) AS kept_sha256 FROM kept
"""

OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM c GROUP BY a) m USING (doc_id)
"""



def _round(k: int) -> str:
    """CTEs for one round: a<k> assigns every part to its nearest entry of c<k>, c<k + 1> has the moved entries."""
    return f"""
a{k} AS (SELECT r, p, arg_min(k, d * 16 + k) AS k, min(d) AS d FROM (SELECT r, p, c.k, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{k} c USING (p, j) GROUP BY r, p, c.k) GROUP BY r, p),
s{k} AS (SELECT p, k, j, sum(x) AS s, count(*) AS n FROM x JOIN a{k} USING (r, p) GROUP BY p, k, j),
c{k + 1} AS (SELECT p, k, j, CASE WHEN n IS NULL THEN x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x FROM c{k} LEFT JOIN s{k} USING (p, k, j)),"""


OP13 = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS (SELECT r, i // (len(e) // 8) AS p, i % (len(e) // 8) AS j, floor(4096 * e[i + 1]::DOUBLE)::BIGINT AS x FROM (SELECT r, e, unnest(range(0, len(e))) AS i FROM v)),
c0 AS (SELECT p, r - 1 AS k, j, x FROM x WHERE r <= 16),{"".join(map(_round, range(7)))}
b AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM c6),
f AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN v USING (r), b
"""

ORACLES = {"op1_substring_dedup": OP1, "op2_suffix_dedup": OP2, "op5_jaccard_join": OP5, "op13_vector_codes": OP13}
