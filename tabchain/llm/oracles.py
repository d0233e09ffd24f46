"""SQL of the queries that SQL can express."""

from __future__ import annotations

#: A-Z to a-z, as ``translate`` in DuckDB.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, {_LOWERED} AS content FROM documents),
g AS (SELECT content, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY content)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(content) AS text_sha256
FROM t JOIN g USING (content)"""

SECRET_SCAN = None

HARD_NEGATIVES = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id AS other_id, c.label AS other_label,
    list_inner_product(a.v, c.v)::BIGINT AS score
  FROM usable a JOIN usable c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE other_label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.other_label <> s.anchor_label
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10"""

_LEAF = " || ".join(
    f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")
)

#: crc32 of the decimal id, a byte after the other, a bit after the other.
_CRC32 = """xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
        lambda r, bit: xor(r >> 1, 3988292384 * (r & 1)))))"""

#: Trees grow level by level: sources' trees first, then the tree of their roots.
#: A recursion sees the level before it only; ``n`` is what that level holds.
MANIFEST = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('s' || source, '') AS tree, sha256({_LEAF.format(text="text")}) AS leaf,
    sha256({_LEAF.format(text="replace(text, chr(10), '')")}) AS without_breaks
  FROM documents),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM numbered
  UNION ALL
  SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3, n),
subroots AS (SELECT tree, digest AS subroot FROM nodes WHERE n = 1),
ranked AS (
  SELECT tree, subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM subroots),
tops AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM ranked
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM tops WHERE n > 1 GROUP BY level, pos // 3, n),
beside AS (
  SELECT tree, false AS top, level, a.pos, b.pos AS other, b.digest FROM nodes a JOIN nodes b USING (tree, level, n)
  WHERE a.n > 1 AND a.pos // 3 = b.pos // 3 AND a.pos <> b.pos
  UNION ALL
  SELECT '', true, level, a.pos, b.pos, b.digest FROM tops a JOIN tops b USING (level, n)
  WHERE a.n > 1 AND a.pos // 3 = b.pos // 3 AND a.pos <> b.pos),
sides AS (
  SELECT tree, top, level, pos,
    coalesce(string_agg(digest, '' ORDER BY other) FILTER (other < pos), '') AS l,
    coalesce(string_agg(digest, '' ORDER BY other) FILTER (other > pos), '') AS r
  FROM beside GROUP BY ALL),
walk AS (
  SELECT doc_id, leaf, numbered.tree, false AS top, 0 AS level, numbered.pos AS pos, numbered.n AS n, '' AS proof,
    CASE WHEN crc32_even THEN without_breaks ELSE leaf END AS digest, ranked.pos AS top_pos, ranked.n AS top_n, subroot
  FROM (SELECT *, {_CRC32} % 2 = 0 AS crc32_even FROM numbered) numbered JOIN ranked ON ranked.tree = numbered.tree
  UNION ALL
  SELECT doc_id, leaf, w.tree, w.top OR n = 1, CASE WHEN n = 1 THEN 0 ELSE w.level + 1 END,
    CASE WHEN n = 1 THEN top_pos ELSE w.pos // 3 END, CASE WHEN n = 1 THEN top_n ELSE (n + 2) // 3 END,
    CASE WHEN n = 1 THEN proof ELSE proof || coalesce(l, '') || coalesce(r, '') END,
    CASE WHEN n = 1 THEN w.digest ELSE sha256(coalesce(l, '') || w.digest || coalesce(r, '')) END, top_pos, top_n, subroot
  FROM walk w LEFT JOIN sides s
    ON s.top = w.top AND s.tree = CASE WHEN w.top THEN '' ELSE w.tree END AND s.level = w.level AND s.pos = w.pos
  WHERE NOT (w.top AND n = 1))
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256,
  w.digest AS folded_root, w.digest = t.digest AS verified
FROM walk w JOIN tops t ON w.top AND w.n = 1 AND t.n = 1"""
