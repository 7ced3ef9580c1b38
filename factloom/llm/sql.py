"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

P1_FOUND = " UNION ".join(
    f"""
SELECT least(a, b) AS id_a, greatest(a, b) AS id_b FROM (
  SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.e, y.e), 9) AS s FROM
    (SELECT DISTINCT {i} AS id, CAST(embedding AS DOUBLE[]) AS e FROM {t}
     WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda z: isnan(z))) = 0 AND len(list_filter(embedding, lambda z: z <> 0)) > 0) x,
    (SELECT DISTINCT {i} AS id, CAST(embedding AS DOUBLE[]) AS e FROM {t}
     WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda z: isnan(z))) = 0 AND len(list_filter(embedding, lambda z: z <> 0)) > 0) y
  WHERE x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= 0.9
  QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY s DESC, y.id) <= 5
)"""
    for t, i in (("fact_embeddings", "fact_id"), ("entities", "entity_id"))
)

P1_RECALL = " UNION ALL ".join(
    f"""
SELECT '{t}' AS source, least(200, count(DISTINCT {i})) AS n_asked, true AS reached FROM {t}
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda z: isnan(z))) = 0 AND len(list_filter(embedding, lambda z: z <> 0)) > 0"""
    for t, i in (("fact_embeddings", "fact_id"), ("entities", "entity_id"))
)

_REPEATED = r"""
WITH RECURSIVE line AS (
  SELECT DISTINCT p.doc_id, p.page_index, d.collection, CAST(l.i - 1 AS INTEGER) AS line_no,
         regexp_replace(lower(l.parts[l.i]), '[^\p{L}]', '', 'g') AS k
  FROM (SELECT doc_id, page_index, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM pages) l
  JOIN (SELECT DISTINCT doc_id, page_index FROM pages) p USING (doc_id, page_index)
  JOIN documents d ON d.doc_id = p.doc_id
  WHERE d.collection IS NOT NULL
), long AS (SELECT * FROM line WHERE length(k) >= 20),
total AS (SELECT collection, count(DISTINCT doc_id) AS n_all FROM documents WHERE collection IS NOT NULL GROUP BY 1),
node AS (
  SELECT collection, k FROM (SELECT collection, k, count(DISTINCT doc_id) AS n FROM long GROUP BY 1, 2) JOIN total USING (collection)
  WHERE n >= 3 AND n >= n_all * 0.05
)
"""
P2_FOUND = _REPEATED + "SELECT DISTINCT doc_id, page_index, line_no FROM long SEMI JOIN node USING (collection, k)"
P2_CLEAN = r"""
SELECT DISTINCT p.doc_id, p.page_index, p.text_ AS text, CAST(n AS INTEGER) AS n_removed FROM (
  SELECT q.doc_id, q.page_index, count(f.line_no) AS n, CASE WHEN count(f.line_no) = 0 THEN any_value(q.text)
    ELSE coalesce(string_agg(part, chr(10) ORDER BY i) FILTER (f.line_no IS NULL), '') END AS text_
  FROM (SELECT DISTINCT doc_id, page_index, text, string_split(coalesce(text, ''), chr(10)) AS parts, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i, parts[i + 1] AS part FROM pages) q
  LEFT JOIN (""" + P2_FOUND + r""") f ON f.doc_id = q.doc_id AND f.page_index = q.page_index AND f.line_no = q.i
  GROUP BY q.doc_id, q.page_index, q.text
) p
"""
P2_BLOCKS = _REPEATED + r""", hit AS (SELECT * FROM long SEMI JOIN node USING (collection, k)),
edge AS (
  SELECT collection, a, b FROM (
    SELECT x.collection, x.k AS a, y.k AS b, count(DISTINCT x.doc_id) AS n FROM hit x JOIN hit y
      ON x.doc_id = y.doc_id AND x.page_index = y.page_index AND x.collection = y.collection AND y.line_no = x.line_no + 1 GROUP BY 1, 2, 3
  ) JOIN total USING (collection) WHERE n >= 3 AND n >= n_all * 0.05
), link AS (SELECT collection, a, b FROM edge UNION SELECT collection, b, a FROM edge UNION SELECT collection, k, k FROM node),
reach AS (SELECT collection, a, b FROM link UNION SELECT r.collection, r.a, l.b FROM reach r JOIN link l ON l.collection = r.collection AND l.a = r.b),
block AS (SELECT collection, a AS k, min(b) AS block FROM reach GROUP BY 1, 2),
run AS (
  SELECT collection, block, count(*) FILTER (NOT coalesce(line_no = before + 1 AND block = last, false)) AS n_runs FROM (
    SELECT *, lag(line_no) OVER w AS before, lag(block) OVER w AS last FROM hit JOIN block USING (collection, k) WINDOW w AS (PARTITION BY doc_id, page_index, collection ORDER BY line_no)
  ) GROUP BY 1, 2
), size AS (SELECT collection, block, count(*) AS n_lines FROM block GROUP BY 1, 2)
SELECT collection, n_lines, count(*) AS n_blocks, CAST(sum(n_runs) AS BIGINT) AS n_runs FROM size JOIN run USING (collection, block) GROUP BY 1, 2
"""

P3_FOUND = r"""
WITH RECURSIVE item AS (SELECT DISTINCT chunk_id, text, length(text) AS n FROM chunks WHERE length(text) > 1800),
cut AS (
  SELECT chunk_id, text, n, 0 AS s, -1 AS last_s, 0 AS last_e FROM item
  UNION ALL
  SELECT chunk_id, text, n, CASE WHEN s + 1800 >= n THEN NULL ELSE greatest(s + 1, e - 200) END, s, e
  FROM (
    SELECT chunk_id, text, n, s, CASE
        WHEN s + 1800 >= n THEN n
        WHEN b1 > 900 THEN s + b1 + 2 WHEN b2 > 900 THEN s + b2 + 1 WHEN b3 > 900 THEN s + b3 + 2 WHEN b4 > 900 THEN s + b4 + 1
        ELSE s + 1800 END AS e
    FROM (
      SELECT *,
        CASE WHEN strpos(r, chr(10) || chr(10)) > 0 THEN length(r) - strpos(r, chr(10) || chr(10)) - 1 ELSE -1 END AS b1,
        CASE WHEN strpos(r, chr(10)) > 0 THEN length(r) - strpos(r, chr(10)) ELSE -1 END AS b2,
        CASE WHEN strpos(r, ' .') > 0 THEN length(r) - strpos(r, ' .') - 1 ELSE -1 END AS b3,
        CASE WHEN strpos(r, ' ') > 0 THEN length(r) - strpos(r, ' ') ELSE -1 END AS b4
      FROM (SELECT *, array_to_string(list_reverse(string_split(substr(text, s + 1, 1800), '')), '') AS r FROM cut WHERE s IS NOT NULL)
    )
  )
)
SELECT DISTINCT chunk_id, CAST(last_s AS BIGINT) AS piece_start, CAST(last_e AS BIGINT) AS piece_end FROM cut WHERE last_s >= 0
"""

P7_FOUND = "SELECT DISTINCT doc_id FROM documents WHERE strlen(text) + 1 > 4096"

P7_FILL = """
WITH s AS (SELECT doc_id, max(strlen(coalesce(text, '')) + 1) AS n FROM documents GROUP BY 1)
SELECT count(*) AS n_documents, CAST(sum((n - 1) // 4096 + 1) AS BIGINT) AS n_pieces, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(0 AS BIGINT) AS n_over, true AS within_bound FROM s
"""

P8_FOUND = r"""
WITH dw AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{Nd}\s]', '', 'g'), '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{Nd}\s]', '', 'g'), '\s+'), lambda x: x <> '') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 14], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) AS i FROM dw WHERE len(w) >= 15)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 14], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 13)) AS i FROM iw WHERE len(w) >= 15))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

P9_FOUND = r"""
WITH g AS (
  SELECT DISTINCT doc_id, md5(substr(text, i, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)
), s AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b
FROM (SELECT * FROM g SEMI JOIN s USING (h)) a JOIN (SELECT * FROM g SEMI JOIN s USING (h)) b ON a.h = b.h AND a.doc_id < b.doc_id
"""


_WINDOWS = r"""
WITH t AS (SELECT text, min(doc_id) AS class_id, count(DISTINCT doc_id) AS n_copies FROM documents WHERE length(text) >= 400 GROUP BY 1),
g AS (SELECT DISTINCT class_id, i, md5(substr(text, i, 400)) AS h FROM (SELECT class_id, text, unnest(range(1, length(text) - 398)) AS i FROM t)),
s AS (SELECT h, list_sort(list(DISTINCT class_id)) AS texts FROM g GROUP BY 1 HAVING count(DISTINCT class_id) > 1)
"""
P9_COVERAGE = _WINDOWS + r""", hit AS (SELECT DISTINCT class_id, i FROM g SEMI JOIN s USING (h)),
run AS (SELECT class_id, i, sum(fresh) OVER (PARTITION BY class_id ORDER BY i) AS r FROM (
  SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY class_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM hit)),
span AS (SELECT class_id, sum(n) AS n, count(*) AS k FROM (SELECT class_id, r, max(i) + 400 - min(i) AS n FROM run GROUP BY 1, 2) GROUP BY 1)
SELECT d.doc_id, CAST(CASE WHEN n_copies > 1 THEN length(d.text) ELSE coalesce(n, 0) END AS BIGINT) AS shared_chars, CAST(CASE WHEN n_copies > 1 THEN 1 ELSE coalesce(k, 0) END AS BIGINT) AS n_spans
FROM (SELECT DISTINCT doc_id, text FROM documents) d LEFT JOIN t USING (text) LEFT JOIN span USING (class_id)
"""
P9_GROUPS = _WINDOWS + r""", per AS (SELECT class_id, count(DISTINCT texts) AS n_groups FROM (SELECT texts, unnest(texts) AS class_id FROM s) GROUP BY 1)
SELECT d.doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_copies, 1) AS n_copies, coalesce(n_groups, 0) AS n_groups
FROM (SELECT DISTINCT doc_id, text FROM documents) d LEFT JOIN t USING (text) LEFT JOIN per USING (class_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_recall": P1_RECALL, "p2_found": P2_FOUND, "p2_blocks": P2_BLOCKS, "p2_clean": P2_CLEAN, "p3_found": P3_FOUND, "p7_found": P7_FOUND, "p7_fill": P7_FILL, "p8_found": P8_FOUND, "p9_found": P9_FOUND, "p9_coverage": P9_COVERAGE, "p9_groups": P9_GROUPS}
