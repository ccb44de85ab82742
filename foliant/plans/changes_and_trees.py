"""Snapshot changes (p1) and merge trees (p3) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.operators.hierarchy import entity_descendants, entity_paths, entity_roots, mention_roots
from foliant.operators.snapshots import chapter_changes
from foliant.plans.deliveries import ref_sql
from foliant.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return chapter_changes(table(spark, d, "chapters"), table(spark, d, "manuscript_versions"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return entity_roots(table(spark, d, "entities"))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return entity_paths(table(spark, d, "entities")).selectExpr("entity_id", "root_id", "depth", "array_join(path, '/') AS path")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return entity_descendants(entity_paths(table(spark, d, "entities")))


def p3_mentions(spark: SparkSession, d: str) -> DataFrame:
    return mention_roots(table(spark, d, "entity_mentions"), entity_roots(table(spark, d, "entities")))


def queries():
    return {f.__name__: f for f in (p1_found, p3_found, p3_paths, p3_descendants, p3_mentions)}


_WALK = f"""
valid AS (
  SELECT id, arg_max(coalesce({ref_sql('merged_into_id')}, ''), updated_at) AS up FROM entities GROUP BY id),
link AS (SELECT id, up FROM valid WHERE up <> ''),
walk(id, a, depth) AS (
  SELECT id, up, 1 FROM link
  UNION ALL
  SELECT w.id, l.up, w.depth + 1 FROM walk w JOIN link l ON l.id = w.a WHERE w.depth < 400),
ends AS (
  SELECT w.id, w.a, w.depth, v.id AS known FROM walk w LEFT JOIN link l ON l.id = w.a LEFT JOIN valid v ON v.id = w.a
  WHERE l.id IS NULL)
"""

_FOUND = """
SELECT l.id AS entity_id,
       CASE WHEN e.id IS NULL THEN 'cycle' WHEN e.known IS NULL THEN 'missing' ELSE e.a END AS root_id,
       CASE WHEN e.known IS NULL THEN -1 ELSE e.depth END::BIGINT AS depth
FROM link l LEFT JOIN ends e ON e.id = l.id
"""


def oracle_sql():
    return {
        "p1_found": f"""
WITH snap AS (
  SELECT id, any_value(project_id) AS project_id, max(version_number)::BIGINT AS version_number
  FROM manuscript_versions WHERE status IN ('ready', 'archived') GROUP BY id),
pair AS (
  SELECT *, lag(id) OVER (PARTITION BY project_id ORDER BY version_number) AS earlier FROM snap),
chapter AS (
  SELECT {ref_sql('manuscript_version_id')} AS v, ordinal,
         arg_max(coalesce(sha256(text), replace(lower(trim(content_hash)), 'sha256:', '')), loaded_at) AS h
  FROM chapters GROUP BY 1, 2),
side AS (
  SELECT p.id, c.ordinal, max(CASE WHEN c.v = p.id THEN h END) AS now, max(CASE WHEN c.v = p.earlier THEN h END) AS past
  FROM pair p JOIN chapter c ON c.v IN (p.id, p.earlier) WHERE p.earlier IS NOT NULL GROUP BY 1, 2)
SELECT p.project_id, p.version_number, s.ordinal::BIGINT AS ordinal,
       CASE WHEN past IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM side s JOIN pair p ON p.id = s.id WHERE now IS DISTINCT FROM past""",
        "p3_found": f"WITH RECURSIVE {_WALK} {_FOUND}",
        "p3_descendants": f"""
WITH RECURSIVE {_WALK}
SELECT w.a AS ancestor_id, w.id AS descendant_id, w.depth::BIGINT AS distance
FROM walk w JOIN ends e ON e.id = w.id AND e.known IS NOT NULL""",
        "p3_paths": f"""
WITH RECURSIVE {_WALK},
steps AS (SELECT w.id, w.a, w.depth FROM walk w JOIN ends e ON e.id = w.id AND e.known IS NOT NULL
          UNION ALL SELECT id, id, 0 FROM link WHERE id IN (SELECT id FROM ends WHERE known IS NOT NULL)
          UNION ALL SELECT id, id, 0 FROM valid WHERE up = '')
SELECT id AS entity_id, arg_max(a, depth) AS root_id, max(depth)::BIGINT AS depth, string_agg(a, '/' ORDER BY depth DESC) AS path
FROM steps GROUP BY id""",
        "p3_mentions": f"""
WITH RECURSIVE {_WALK}, found AS ({_FOUND}),
m AS (SELECT id, arg_max(coalesce({ref_sql('entity_id')}, ''), loaded_at) AS entity_id FROM entity_mentions GROUP BY id)
SELECT m.id AS mention_id, m.entity_id, coalesce(f.root_id, m.entity_id) AS root_id, coalesce(f.depth, 0)::BIGINT AS depth
FROM m LEFT JOIN found f ON f.entity_id = m.entity_id WHERE m.entity_id <> ''""",
    }
