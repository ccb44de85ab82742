"""Q1-Q6, Q11-Q12: the lists and pages that an application reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import relational as L
from foliant.plans.changes_and_trees import _WALK
from foliant.operators import experiments as P
from foliant.plans.incremental import SUITES
from foliant.plans.registry import Catalogue
from foliant.plans.relational import _CURRENT, _current, versions
from foliant.plans.resolution import _CA, _CH, _MN, _ROOTS, _roots, candidates, chapters, mentions
from foliant.plans.scalars import NAME
from foliant.tables import table

_c = Catalogue()
queries, oracle_sql = _c.queries, _c.oracle_sql


@_c.query(f"WITH {_CURRENT}, {_CH} SELECT p.project_id, CASE WHEN cur.id IS NOT NULL THEN 'v' || cur.version_number END AS label, count(ch.chapter_id)::BIGINT AS chapters FROM (SELECT DISTINCT project_id FROM v) p LEFT JOIN cur USING (project_id) LEFT JOIN ch ON ch.version_id = cur.id GROUP BY ALL")
def q1_projects(spark, d):
    p = versions(spark, d).select("project_id").distinct()
    cur = _current(spark, d).select("project_id", F.col("id").alias("version_id"), "version_number")
    n = chapters(spark, d).groupBy("version_id").agg(F.count(F.lit(1)).alias("n"))
    rows = p.join(cur, "project_id", "left").join(n, "version_id", "left")
    return rows.select("project_id", F.concat(F.lit("v"), F.col("version_number").cast("string")).alias("label"), F.coalesce("n", F.lit(0)).alias("chapters"))


@_c.query(f"WITH {_CURRENT}, {_CH} SELECT project_id, chapter_id, ordinal, coalesce(nullif(title, ''), 'Chapter ' || ordinal) AS title, length(chapter_text)::INTEGER AS n_chars FROM ch JOIN cur ON cur.id = ch.version_id")
def q2_chapters(spark, d):
    cur = _current(spark, d).select("project_id", F.col("id").alias("version_id"))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Chapter "), F.col("ordinal").cast("string")))
    return chapters(spark, d).join(cur, "version_id").select("project_id", "chapter_id", "ordinal", title.alias("title"), F.length("chapter_text").alias("n_chars"))


@_c.query("SELECT DISTINCT project_id, id, version_number, status, CASE WHEN ready_at IS NOT NULL THEN (greatest(0, epoch_us(ready_at) - epoch_us(created_at)) // 1000)::BIGINT END AS elapsed_ms FROM manuscript_versions")
def q3_versions(spark, d):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = table(spark, d, "manuscript_versions")
    elapsed = F.when(F.col("ready_at").isNotNull(), F.floor(F.greatest(F.lit(0).cast("long"), us("ready_at") - us("created_at")) / 1000))
    return rows.select("project_id", "id", "version_number", "status", elapsed.alias("elapsed_ms")).distinct()


@_c.query(f"""WITH {_CA}, {_MN}, s AS (SELECT id, max(surface_text) AS name, max(entity_type) AS t FROM mn GROUP BY id)
SELECT ca.version_id, ca.id, a.name AS left_name, b.name AS right_name, row_number() OVER (PARTITION BY ca.version_id ORDER BY ca.created_at, ca.id)::INTEGER AS place
FROM (SELECT DISTINCT id, version_id, l, r, created_at FROM ca WHERE applied_decision IS NULL) ca JOIN s a ON a.id = ca.l JOIN s b ON b.id = ca.r QUALIFY place <= 20""")
def q4_candidates_page(spark, d):
    s = mentions(spark, d).groupBy("id").agg(F.max("surface_text").alias("name"))
    rows = candidates(spark, d).where("applied_decision is null").select("id", "version_id", "l", "r", "created_at").distinct()
    named = rows.join(s.toDF("l", "left_name"), "l").join(s.toDF("r", "right_name"), "r")
    place = F.row_number().over(Window.partitionBy("version_id").orderBy("created_at", "id"))
    return named.withColumn("place", place).where("place <= 20").select("version_id", "id", "left_name", "right_name", "place")


_ENT = """ent AS (SELECT id, arg_max(coalesce(canonical_name, ''), updated_at) AS name, arg_max(entity_type, updated_at) AS t FROM entities GROUP BY id),
al AS (SELECT DISTINCT r.root_id, alias FROM entity_aliases a JOIN roots r ON r.entity_id = a.entity_id WHERE alias IS NOT NULL)"""


def _entities(spark, d):
    return table(spark, d, "entities").groupBy(F.col("id").alias("entity_id")).agg(F.max_by(F.coalesce("canonical_name", F.lit("")), "updated_at").alias("name"), F.max_by("entity_type", "updated_at").alias("type"))


@_c.query(f"""WITH RECURSIVE {_WALK}, {_ROOTS}, {_ENT}
SELECT ent.id AS entity_id, ent.name, coalesce(array_to_string(list_sort(list(al.alias) FILTER ({NAME.format('al.alias')} <> {NAME.format('ent.name')})), '|'), '') AS aliases
FROM ent JOIN link_free ON link_free.id = ent.id LEFT JOIN al ON al.root_id = ent.id WHERE t = 'character' GROUP BY ALL""".replace(f"{_ENT}", f"{_ENT}, link_free AS (SELECT id FROM valid WHERE up = '')"))
def q5_entities(spark, d):
    al = table(spark, d, "entity_aliases").where("alias is not null").join(_roots(spark, d), "entity_id").select(F.col("root_id").alias("entity_id"), "alias").distinct()
    heads = _roots(spark, d).where("entity_id = root_id").select("entity_id").join(_entities(spark, d), "entity_id").where("type = 'character'")
    other = F.when(X.normalized_name("alias") != X.normalized_name("name"), F.col("alias"))
    return heads.join(al, "entity_id", "left").groupBy("entity_id", "name").agg(F.array_join(F.array_sort(F.collect_list(other)), "|").alias("aliases"))


@_c.query(f"""WITH RECURSIVE {_WALK}, {_ROOTS}, {_MN}, {_CH} SELECT root_id, mn.id AS mention_id, ordinal, start_offset FROM mn JOIN roots ON roots.entity_id = mn.entity_id JOIN ch USING (chapter_id)
QUALIFY row_number() OVER (PARTITION BY root_id ORDER BY ordinal, start_offset, mn.id) <= 20""")
def q6_entity_evidence(spark, d):
    rows = mentions(spark, d).join(_roots(spark, d), "entity_id").join(chapters(spark, d).select("chapter_id", "ordinal"), "chapter_id")
    place = F.row_number().over(Window.partitionBy("root_id").orderBy("ordinal", "start_offset", "id"))
    return rows.withColumn("n", place).where("n <= 20").select("root_id", F.col("id").alias("mention_id"), "ordinal", "start_offset")


_EXPERIMENTS = f"""{_CA}, r AS (SELECT ca.version_id AS run_id, CASE WHEN v.version_number % 2 = 0 THEN 'resolution' WHEN v.version_number % 3 = 0 THEN 'retired' ELSE 'extraction' END AS suite, ca.* FROM ca JOIN (SELECT DISTINCT id AS vid, version_number FROM manuscript_versions) v ON vid = ca.version_id)"""


def _answers(spark, d):
    """The answers of a version as one run of a suite."""
    n = F.col("version_number")
    suite = F.when(n % 2 == 0, "resolution").when(n % 3 == 0, "retired").otherwise("extraction")
    runs = versions(spark, d).select(F.col("id").alias("version_id"), suite.alias("suite"))
    return candidates(spark, d).join(runs, "version_id").withColumn("run_id", F.col("version_id"))


@_c.query(f"""WITH {_EXPERIMENTS} SELECT run_id, suite, max(created_at) AS created_at, count(*)::BIGINT AS answers, count(error_code)::BIGINT AS failures FROM r WHERE suite IN ('resolution', 'extraction') GROUP BY 1, 2 ORDER BY created_at DESC, run_id DESC LIMIT 50""")
def q11_experiments(spark, d):
    runs = _answers(spark, d).groupBy("run_id", "suite").agg(F.max("created_at").alias("created_at"), F.count(F.lit(1)).alias("answers"), F.count("error_code").alias("failures"))
    return P.newest_runs(runs, SUITES.entries)


@_c.query(f"WITH {_EXPERIMENTS} SELECT run_id, id, error_code AS error FROM (SELECT DISTINCT run_id, id, error_code FROM r WHERE error_code IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY id, error_code) <= 20")
def q11_failures(spark, d):
    return P.failures(_answers(spark, d), "run_id", "id", F.col("error_code"))
