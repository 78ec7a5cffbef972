"""DuckDB SQL for the queries of this subpackage that SQL can express. The
others are tested against brute force (tests/llm): fitted classifiers, hashes
that DuckDB lacks, and iterations."""

ORACLES: dict[str, str] = {
    "op2_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reached(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
low AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a),
out AS (
  SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id
  FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN low l ON l.a = e.vec_id)
SELECT *, vec_id = component_id AS kept FROM out
""",
    "op3_linededup": r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
plain AS (
  SELECT *, lower(trim(regexp_replace(line, '[\t\x0B-\r ]+', ' ', 'g'), ' ')) AS form FROM lines),
wide AS (
  SELECT form FROM plain WHERE source IS NOT NULL AND regexp_matches(form, '[\p{L}0-9]')
  GROUP BY form HAVING count(DISTINCT source) >= 5),
marked AS (SELECT p.*, w.form IS NOT NULL AS gone FROM plain p LEFT JOIN wide w ON w.form = p.form),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text, count(*) AS n_lines,
         count(*) FILTER (WHERE gone) AS n_removed FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
""",
    "op12_hardneg": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) <= 3
""",
    "op13_prefixtrie": r"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
         md5(coalesce(role, '')) || md5(coalesce(text, '')) AS t, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % 100 AS base,
         xor(list_reduce(list_transform(range(8 * length(c::VARCHAR)),
               lambda i: CASE WHEN i % 8 = 0 THEN ord(substr(c::VARCHAR, (i // 8 + 1)::BIGINT, 1))::BIGINT ELSE 0 END),
             lambda x, y: xor(xor(x, y) >> 1, (xor(x, y) & 1) * 3988292384), 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT c FROM own)),
mixed AS (
  SELECT v.c, b.pos AS pos, b.t, b.chars FROM convs v JOIN own b ON b.c = v.base AND b.pos < v.h
  UNION ALL
  SELECT v.c, 1000000 + o.pos, o.t, o.chars FROM convs v JOIN own o ON o.c = v.c AND o.pos >= v.h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS depth, t, chars FROM mixed),
paths AS (
  SELECT c, depth, md5(string_agg(t, '') OVER (PARTITION BY c ORDER BY depth)) AS k, chars FROM placed
  UNION ALL SELECT c, 0, 'root', 0 FROM convs),
lengths AS (SELECT c, max(depth) AS n FROM paths GROUP BY c),
nodes AS (
  SELECT k, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = n), '') AS ends
  FROM paths JOIN lengths USING (c) GROUP BY k, depth),
parents AS (SELECT DISTINCT a.k, b.k AS parent FROM paths a JOIN paths b ON b.c = a.c AND b.depth = a.depth - 1),
children AS (SELECT parent AS k, count(*) AS n_children FROM parents GROUP BY parent),
below AS (SELECT DISTINCT a.k AS top, b.k FROM paths a JOIN paths b ON b.c = a.c AND b.depth >= a.depth),
subtree AS (
  SELECT b.top AS k, count(*) FILTER (WHERE c.k IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM below b JOIN nodes n ON n.k = b.k LEFT JOIN children c ON c.k = b.k GROUP BY b.top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n LEFT JOIN parents q ON q.k = n.k LEFT JOIN nodes p ON p.k = q.parent
LEFT JOIN children c ON c.k = n.k LEFT JOIN subtree s ON s.k = n.k
""",
}
