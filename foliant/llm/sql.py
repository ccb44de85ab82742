"""SQL that must give the same rows as the queries that SQL can express."""

from __future__ import annotations


from foliant.plans.deliveries import CH


def _ref(column: str) -> str:
    return f"nullif(lower(trim(replace(replace(trim({column}), '{{', ''), '}}', ''))), '')"


#: All pairs of an evaluation text and a training text by edit distance over words.
_OVERLAPS = r"""
WITH RECURSIVE plain AS (SELECT id, lower(trim(split)) AS split, source, lower(trim(split)) = 'train' AS train, lower(nfc_normalize(text)) AS t FROM (SELECT id, split, text, 'entity_resolution_v1' AS source FROM entity_resolution_v1 UNION ALL SELECT id, split, text, 'entity_extraction_model_eval_v3' FROM entity_extraction_model_eval_v3) WHERE text IS NOT NULL AND split IS NOT NULL),
joined AS (SELECT id, split, source, train, regexp_replace(regexp_replace(t, '([\p{L}\p{N}_])[''’ʼ`]([\p{L}\p{N}_])', '\1\2', 'g'), '([\p{L}\p{N}_])[''’ʼ`]([\p{L}\p{N}_])', '\1\2', 'g') AS t FROM plain),
rec AS (SELECT id, split, source, train, regexp_extract_all(t, '[\p{L}\p{N}]+') AS w FROM joined WHERE regexp_matches(t, '[\p{L}\p{N}]')),
e AS (SELECT w, list_distinct(w) AS d, len(w) AS n FROM (SELECT DISTINCT w FROM rec WHERE NOT train)), t AS (SELECT w, list_distinct(w) AS d, len(w) AS n FROM (SELECT DISTINCT w FROM rec WHERE train)),
near AS (SELECT e.w AS a, t.w AS b FROM e JOIN t ON abs(e.n - t.n) <= greatest(e.n, t.n) // 7 WHERE len(list_intersect(e.d, t.d)) >= len(e.d) - greatest(e.n, t.n) // 7),
dp AS (SELECT a, b, 0::BIGINT AS k, range(0, len(a) + 1) AS r FROM near
  UNION ALL SELECT a, b, k + 1, list_transform(range(1, len(c) + 1), lambda j: list_min(list_transform(range(1, j + 1), lambda i: c[i] - i)) + j)
  FROM (SELECT a, b, k, list_prepend(r[1] + 1, list_transform(range(1, len(a) + 1), lambda j: least(r[j + 1] + 1, r[j] + CASE WHEN a[j] = b[k + 1] THEN 0 ELSE 1 END))) AS c FROM dp WHERE k < len(b))),
pair AS (SELECT a, b FROM dp WHERE k = len(b) AND r[len(a) + 1] <= greatest(len(a), len(b)) // 7)
"""

SQL = {
    "p2_found": f"""
WITH RECURSIVE c AS (
  SELECT least(l, r) AS a, greatest(l, r) AS b, created_at, nullif(lower(trim(applied_decision)), '') AS d, id
  FROM (SELECT {_ref('left_mention_id')} AS l, {_ref('right_mention_id')} AS r, * FROM entity_resolution_candidates) WHERE l IS NOT NULL AND r IS NOT NULL AND l <> r),
tie AS (
  SELECT a, b FROM c GROUP BY a, b HAVING arg_max(coalesce(d, ''), struct_pack(t := created_at, d := coalesce(d, ''), id := id)) = 'merge'),
edge AS (
  SELECT a AS x, b AS y FROM tie WHERE a IN (SELECT id FROM entity_mentions) AND b IN (SELECT id FROM entity_mentions)
  UNION SELECT b, a FROM tie WHERE a IN (SELECT id FROM entity_mentions) AND b IN (SELECT id FROM entity_mentions)),
reach AS (SELECT x AS mention_id, x AS g FROM edge UNION SELECT e.y, r.g FROM reach r JOIN edge e ON e.x = r.mention_id)
SELECT mention_id, min(g) AS group_id FROM reach GROUP BY mention_id""",
    "p5_found": f"{_OVERLAPS} SELECT DISTINCT least(x.id, y.id) AS left_id, greatest(x.id, y.id) AS right_id FROM pair JOIN rec x ON x.w = a AND NOT x.train JOIN rec y ON y.w = b AND y.train",
    "p5_report": f"""{_OVERLAPS}, met AS (SELECT DISTINCT x.id, x.split, x.source, y.id AS train_id, y.source AS train_source, a = b AS exact FROM pair JOIN rec x ON x.w = a AND NOT x.train JOIN rec y ON y.w = b AND y.train),
every AS (SELECT split, source, count(DISTINCT id) AS n FROM rec WHERE NOT train GROUP BY 1, 2)
SELECT split AS eval_split, source AS eval_source, train_source, count(DISTINCT id)::BIGINT AS overlapping_records, count(*)::BIGINT AS pairs, count(*) FILTER (exact)::BIGINT AS exact_pairs, any_value(n)::BIGINT AS eval_records
FROM met JOIN every USING (split, source) GROUP BY 1, 2, 3""",
    "p6_whole": f"""
WITH {CH}, s AS (SELECT DISTINCT s.id AS scene_id, coalesce(s.start_offset, 0) AS a, coalesce(s.text, substr(ch.chapter_text, coalesce(s.start_offset, 0) + 1, coalesce(s.end_offset, length(ch.chapter_text)) - coalesce(s.start_offset, 0))) AS text
  FROM scenes s LEFT JOIN ch ON ch.chapter_id = {_ref('s.chapter_id')})
SELECT scene_id, a::BIGINT AS start_offset, (a + length(text))::BIGINT AS end_offset, sha256(text) AS digest, 0::BIGINT AS too_long, 0::BIGINT AS wrong_overlaps FROM s WHERE length(text) > 2400""",
    "p6_found": f"""
WITH ch AS (SELECT id, arg_max(text, loaded_at) AS text FROM chapters WHERE text IS NOT NULL GROUP BY id)
SELECT DISTINCT s.id AS scene_id FROM scenes s LEFT JOIN ch ON ch.id = {_ref('s.chapter_id')}
WHERE length(coalesce(s.text, substr(ch.text, coalesce(s.start_offset, 0) + 1, coalesce(s.end_offset, length(ch.text)) - coalesce(s.start_offset, 0)))) > 2400""",
}
