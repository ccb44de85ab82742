"""M, E, J1, J9-J12, J16, J19: mentions and entity resolution over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import mentions as M
from foliant.operators import resolution as E
from foliant.operators.deliveries import latest_chapters
from foliant.operators.hierarchy import entity_roots
from foliant.plans.changes_and_trees import _WALK
from foliant.plans.deliveries import CH as _CH
from foliant.plans.deliveries import ref_sql
from foliant.plans.registry import Catalogue
from foliant.plans.scalars import NAME
from foliant.refs import normal_ref, normal_word
from foliant.tables import table

_c = Catalogue()
queries, oracle_sql = _c.queries, _c.oracle_sql

_MN = """mn AS (SELECT id, manuscript_version_id AS version_id, chapter_id, scene_id, chunk_id, entity_type, surface_text, start_offset, end_offset, max(entity_id) AS entity_id FROM entity_mentions GROUP BY ALL)"""
_CA = f"""ca AS (SELECT id, manuscript_version_id AS version_id, {ref_sql('left_mention_id')} AS l, {ref_sql('right_mention_id')} AS r, nullif(lower(trim(llm_decision)), '') AS llm_decision,
  nullif(lower(trim(applied_decision)), '') AS applied_decision, error_code, evidence_ids, created_at FROM (SELECT DISTINCT * FROM entity_resolution_candidates))"""


def chapters(spark, d):
    return latest_chapters(table(spark, d, "chapters"))


def mentions(spark, d):
    m = table(spark, d, "entity_mentions").withColumnRenamed("manuscript_version_id", "version_id")
    return m.groupBy("id", "version_id", "chapter_id", "scene_id", "chunk_id", "entity_type", "surface_text", "start_offset", "end_offset").agg(F.max("entity_id").alias("entity_id"))


def candidates(spark, d):
    return table(spark, d, "entity_resolution_candidates").distinct().select(
        "id", F.col("manuscript_version_id").alias("version_id"), normal_ref("left_mention_id").alias("l"), normal_ref("right_mention_id").alias("r"),
        normal_word("llm_decision").alias("llm_decision"), normal_word("applied_decision").alias("applied_decision"), "error_code", "evidence_ids", "created_at",
    )


@_c.query(f"WITH {_CH}, {_MN} SELECT mn.id, ch.ordinal, mn.start_offset FROM mn JOIN ch USING (chapter_id, version_id)")
def j1_mentions_in_chapters(spark, d):
    return mentions(spark, d).join(chapters(spark, d), ["chapter_id", "version_id"]).select("id", "ordinal", "start_offset")


_NAMED = f"""
named AS (SELECT c.id AS chunk_id, c.text, c.start_offset AS chunk_start, m.surface_text, m.entity_type FROM (SELECT DISTINCT id, text, start_offset FROM chunks WHERE text IS NOT NULL) c
  JOIN (SELECT DISTINCT chunk_id, surface_text, entity_type FROM entity_mentions) m ON m.chunk_id = c.id),
cut AS (SELECT *, string_split(text, surface_text) AS parts FROM named),
spans AS (SELECT chunk_id, chunk_start, surface_text, entity_type, (list_sum(list_transform(parts[1:u.i], lambda p: length(p))) + (u.i - 1) * length(surface_text))::INTEGER AS a FROM cut, unnest(range(1, len(parts))) AS u(i))
"""


def _named(spark, d):
    chunks = table(spark, d, "chunks").where("text is not null").select(F.col("id").alias("chunk_id"), "text", F.col("start_offset").alias("chunk_start"), F.col("chapter_id")).distinct()
    names = table(spark, d, "entity_mentions").select("chunk_id", "surface_text", "entity_type").distinct()
    return chunks.join(names, "chunk_id")


def _spans(spark, d):
    base = table(spark, d, "chunks").where("text is not null").select(F.col("id").alias("chunk_id"), F.col("start_offset").alias("chunk_start"), "chapter_id", "ordinal").distinct()
    return M.expand_surfaces(_named(spark, d)).where("found").drop("found").join(base, "chunk_id")


@_c.query(f"WITH {_NAMED} SELECT chunk_id, surface_text, entity_type, a AS start_offset, (a + length(surface_text))::INTEGER AS end_offset FROM spans")
def m1_expand_surfaces(spark, d):
    return M.expand_surfaces(_named(spark, d)).where("found").drop("found")


@_c.query(f"WITH {_NAMED} SELECT chunk_id, surface_text, count(*)::BIGINT AS n FROM spans GROUP BY chunk_id, surface_text, entity_type")
def j10_occurrences(spark, d):
    return M.expand_surfaces(_named(spark, d)).where("found").groupBy("chunk_id", "surface_text", "entity_type").agg(F.count(F.lit(1)).alias("n")).drop("entity_type")


@_c.query(f"WITH {_NAMED} SELECT chunk_id, surface_text, entity_type, (a + chunk_start)::INTEGER AS start_offset, (a + chunk_start + length(surface_text))::INTEGER AS end_offset FROM spans")
def m2_rebase(spark, d):
    return M.rebase(_spans(spark, d).drop("chapter_id", "ordinal"))


@_c.query(f"""WITH {_NAMED}, s AS (SELECT c.chapter_id, s.chunk_start + a AS start_offset, s.chunk_start + a + length(surface_text) AS end_offset, entity_type, c.ordinal, s.chunk_id
  FROM spans s JOIN (SELECT DISTINCT id, chapter_id, ordinal FROM chunks) c ON c.id = s.chunk_id)
SELECT chapter_id, start_offset::INTEGER AS start_offset, end_offset::INTEGER AS end_offset, entity_type, chunk_id FROM s
QUALIFY row_number() OVER (PARTITION BY chapter_id, start_offset, end_offset, entity_type ORDER BY ordinal, chunk_id) = 1""")
def m3_dedupe(spark, d):
    rows = M.rebase(_spans(spark, d)).select("chapter_id", "start_offset", "end_offset", "entity_type", "ordinal", "chunk_id")
    return M.first_of_each_span(rows, ["chapter_id", "start_offset", "end_offset", "entity_type"], ["ordinal", "chunk_id"]).drop("ordinal")


@_c.query(f"""WITH {_CH}, {_MN} SELECT count(*)::BIGINT AS verified FROM mn JOIN ch USING (chapter_id)
WHERE start_offset >= 0 AND end_offset <= length(chapter_text) AND substr(chapter_text, start_offset + 1, end_offset - start_offset) = surface_text""")
def m4_verified(spark, d):
    ok, _ = M.verified(mentions(spark, d), chapters(spark, d).select("chapter_id", "chapter_text"))
    return ok.agg(F.count(F.lit(1)).alias("verified"))


@_c.query("SELECT manuscript_version_id AS version_id, count(*)::BIGINT AS n FROM (SELECT DISTINCT id, manuscript_version_id FROM entity_mentions) GROUP BY 1")
def m5_replaced(spark, d):
    old = mentions(spark, d).select("version_id", "id")
    chunks = table(spark, d, "chunks").select(normal_ref("manuscript_version_id").alias("version_id"), F.col("id").alias("chunk_id"))
    return M.replaced_mentions(old, old, chunks, chunks).groupBy("version_id").agg(F.count(F.lit(1)).alias("n"))


_WORDS = f"list_sort(list_distinct(list_filter(string_split({NAME.format('surface_text')}, ' '), lambda w: w NOT IN ('', 'mr', 'mrs', 'ms', 'dr'))))"
_BLOCK = f"""
{_CH}, {_MN},
m AS (SELECT mn.id, mn.version_id, mn.chapter_id, ordinal, start_offset, end_offset, entity_type, {NAME.format('surface_text')} AS name, {_WORDS} AS words
  FROM mn JOIN ch ON ch.chapter_id = mn.chapter_id),
w AS (SELECT *, unnest(words) AS word FROM m),
bw AS (SELECT version_id, ordinal, start_offset, id, name, unnest(list(struct_pack(id := id, name := name)) OVER (PARTITION BY version_id, entity_type, word ORDER BY ordinal, start_offset, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) AS seen FROM w),
nb AS (SELECT version_id, ordinal, start_offset, id, name, chapter_id, unnest(list(struct_pack(id := id, name := name, chapter_id := chapter_id, e := end_offset)) OVER (PARTITION BY version_id, entity_type ORDER BY ordinal, start_offset, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) AS seen FROM m),
every AS (SELECT version_id, ordinal, start_offset, id, name, seen.id AS other, seen.name AS other_name FROM bw
  UNION SELECT version_id, ordinal, start_offset, id, name, seen.id, seen.name FROM nb WHERE seen.chapter_id = chapter_id AND start_offset - seen.e <= 500),
k AS (SELECT *, row_number() OVER (PARTITION BY version_id, id ORDER BY name <> other_name, other) AS k FROM every QUALIFY k <= 6),
block AS (SELECT version_id, least(id, other) AS left_id, greatest(id, other) AS right_id FROM k QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY ordinal, start_offset, id, k) <= 2000)
"""


def _blocked(spark, d):
    ordinals = chapters(spark, d).select("chapter_id", F.col("ordinal").alias("chapter_ordinal"))
    return E.candidate_pairs(mentions(spark, d).join(ordinals, "chapter_id"))


@_c.query(f"WITH {_BLOCK} SELECT version_id, left_id, right_id FROM block")
def e1_blocking(spark, d):
    return _blocked(spark, d)


@_c.query(f"WITH {_BLOCK} SELECT version_id, count(*)::BIGINT AS pairs FROM block GROUP BY 1")
def t3_blocking_cap(spark, d):
    return _blocked(spark, d).groupBy("version_id").agg(F.count(F.lit(1)).alias("pairs"))


@_c.query(f"""WITH {_CH}, {_MN}, e AS (SELECT id, mn.chapter_id, mn.version_id, ordinal, title, greatest(0, start_offset - 500) AS a, least(length(chapter_text), end_offset + 500) AS b, chapter_text FROM mn JOIN ch USING (chapter_id, version_id)),
h AS (SELECT *, sha1(from_hex(replace(version_id, '-', '')) || encode('resolution:' || chapter_id || ':' || a || ':' || b || ':' || sha256(substr(chapter_text, a + 1, b - a)))) AS h FROM e)
SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS evidence_id,
  coalesce(nullif(title, ''), 'Chapter ' || ordinal) AS chapter, a::INTEGER AS evidence_start, b::INTEGER AS evidence_end FROM h""")
def e2_evidence(spark, d):
    return E.with_evidence(mentions(spark, d), chapters(spark, d)).select("id", "evidence_id", "chapter", "evidence_start", "evidence_end")


def _sources(spark, d):
    rows = mentions(spark, d)
    return rows.groupBy(F.col("id").alias("mention_id")).agg(F.max("version_id").alias("version_id"), F.max("entity_type").alias("entity_type"), F.max("chapter_id").alias("evidence_id"))


_SRC = f"{_MN}, {_CA}, src AS (SELECT id, max(version_id) AS version_id, max(entity_type) AS t, max(chapter_id) AS e, max(entity_id) AS entity_id FROM mn GROUP BY id)"


@_c.query(f"""WITH {_SRC} SELECT DISTINCT ca.id, a.e AS left_evidence, b.e AS right_evidence, CASE WHEN a.e = b.e THEN 1 ELSE 2 END::INTEGER AS n FROM ca JOIN src a ON a.id = ca.l JOIN src b ON b.id = ca.r
WHERE a.version_id = ca.version_id AND b.version_id = ca.version_id AND a.t = b.t""")
def e3_assembled_pairs(spark, d):
    pairs = candidates(spark, d).select("id", "version_id", F.col("l").alias("left_id"), F.col("r").alias("right_id"))
    ok, _ = E.assembled_pairs(pairs, _sources(spark, d))
    return ok.select("id", F.element_at("evidence_ids", 1).alias("left_evidence"), F.element_at("evidence_ids", -1).alias("right_evidence"), F.size("evidence_ids").alias("n")).distinct()


@_c.query(f"""WITH {_SRC} SELECT DISTINCT ca.id FROM ca LEFT JOIN src a ON a.id = ca.l LEFT JOIN src b ON b.id = ca.r
WHERE NOT coalesce(a.version_id = ca.version_id AND b.version_id = ca.version_id AND a.t = b.t, false)""")
def j16_pair_conflicts(spark, d):
    pairs = candidates(spark, d).select("id", "version_id", F.col("l").alias("left_id"), F.col("r").alias("right_id"))
    _, bad = E.assembled_pairs(pairs, _sources(spark, d))
    return bad.select("id").distinct()


@_c.query(f"SELECT DISTINCT id, entity_type, surface_text AS canonical_name, {NAME.format('surface_text')} AS normalized_alias FROM entity_mentions WHERE entity_id IS NULL")
def e4_seeded(spark, d):
    entities, aliases = E.seeded(mentions(spark, d))
    return entities.select("id", "entity_type", "canonical_name").join(aliases.select(F.col("entity_id").alias("id"), "normalized_alias"), "id")


@_c.query(f"""WITH {_BLOCK}, {_CA} SELECT left_id, right_id FROM block ANTI JOIN (SELECT version_id, least(l, r) AS left_id, greatest(l, r) AS right_id FROM ca) USING (version_id, left_id, right_id)""")
def j12_new_pairs(spark, d):
    stored = candidates(spark, d).select("version_id", F.least("l", "r").alias("left_id"), F.greatest("l", "r").alias("right_id"))
    return E.new_pairs(_blocked(spark, d), stored).select("left_id", "right_id")


_ROOTS = """roots AS (SELECT v.id AS entity_id, CASE WHEN v.up = '' THEN v.id ELSE e.a END AS root_id FROM valid v LEFT JOIN ends e ON e.id = v.id WHERE v.up = '' OR e.known IS NOT NULL)"""


def _roots(spark, d):
    linked = entity_roots(table(spark, d, "entities"))
    every = table(spark, d, "entities").select(normal_ref("id").alias("entity_id")).distinct().join(linked, "entity_id", "left")
    return every.where("depth is null or depth >= 0").select("entity_id", F.coalesce("root_id", "entity_id").alias("root_id"))


@_c.query(f"WITH RECURSIVE {_WALK}, {_ROOTS} SELECT entity_id, root_id FROM roots")
def e5_roots(spark, d):
    return _roots(spark, d)


def _proposals(spark, d):
    side = _entity_of(spark, d)
    rows = candidates(spark, d).join(side.toDF("l", "left_entity_id"), "l").join(side.toDF("r", "right_entity_id"), "r")
    return rows.select(F.col("id").alias("candidate_id"), "version_id", "left_entity_id", "right_entity_id", "llm_decision", "applied_decision", "error_code", "created_at").distinct()


def _entity_of(spark, d):
    return mentions(spark, d).groupBy("id").agg(F.max("entity_id").alias("entity_id")).where("entity_id is not null")


_PROP = f"""{_SRC}, prop AS (SELECT DISTINCT ca.id AS candidate_id, ra.root_id AS src, rb.root_id AS dst, llm_decision AS d, applied_decision AS ad, error_code AS e FROM ca
  JOIN src a ON a.id = ca.l JOIN src b ON b.id = ca.r JOIN roots ra ON ra.entity_id = a.entity_id JOIN roots rb ON rb.entity_id = b.entity_id),
edge AS (SELECT src, dst FROM prop WHERE d = 'merge' AND ad IS NULL AND e IS NULL UNION SELECT dst, src FROM prop WHERE d = 'merge' AND ad IS NULL AND e IS NULL),
reach AS (SELECT src AS node, src AS c FROM edge UNION SELECT e.dst, r.c FROM reach r JOIN edge e ON e.src = r.node),
comp AS (SELECT node, min(c) AS c FROM reach GROUP BY node),
named AS (SELECT p.*, coalesce(x.c, src) AS c1, coalesce(y.c, dst) AS c2 FROM prop p LEFT JOIN comp x ON x.node = src LEFT JOIN comp y ON y.node = dst),
blocked AS (SELECT DISTINCT c1 FROM named WHERE c1 = c2 AND (ad = 'keep_separate' OR (d = 'keep_separate' AND ad IS NULL AND e IS NULL)))"""


@_c.query(f"""WITH RECURSIVE {_WALK}, {_ROOTS}, {_PROP} SELECT candidate_id, CASE WHEN (d = 'merge' AND c1 IN (FROM blocked)) OR (d <> 'merge' AND src = dst) THEN 'conflict' ELSE 'apply' END AS outcome
FROM named WHERE ad IS NULL AND e IS NULL AND d IN ('merge', 'keep_separate')""")
def e7_automatic_application(spark, d):
    return E.automatic_application(_proposals(spark, d), _roots(spark, d))


@_c.query(f"WITH RECURSIVE {_WALK}, {_ROOTS}, {_PROP} SELECT node, c AS component FROM comp WHERE node IN (SELECT src FROM edge WHERE src <> dst)")
def e7_components(spark, d):
    from foliant.operators.graph import star_components
    from foliant.shared import Workspace

    a, b = _roots(spark, d).toDF("left_entity_id", "src"), _roots(spark, d).toDF("right_entity_id", "dst")
    merges = _proposals(spark, d).where("llm_decision = 'merge' and applied_decision is null and error_code is null")
    return star_components(merges.join(a, "left_entity_id").join(b, "right_entity_id").select("src", "dst"), Workspace(spark, "e7"))


@_c.query(f"WITH RECURSIVE {_WALK}, {_ROOTS}, {_PROP} SELECT candidate_id FROM named WHERE c1 = c2 AND (ad = 'keep_separate' OR (d = 'keep_separate' AND ad IS NULL AND e IS NULL))")
def j19_separations_inside(spark, d):
    from foliant.operators.graph import star_components
    from foliant.shared import Workspace

    a, b = _roots(spark, d).toDF("left_entity_id", "src"), _roots(spark, d).toDF("right_entity_id", "dst")
    ends = _proposals(spark, d).join(a, "left_entity_id").join(b, "right_entity_id")
    labels = star_components(ends.where("llm_decision = 'merge' and applied_decision is null and error_code is null").select("src", "dst"), Workspace(spark, "j19"))
    named = ends.join(labels.toDF("src", "c1"), "src", "left").join(labels.toDF("dst", "c2"), "dst", "left")
    inside = F.coalesce("c1", "src") == F.coalesce("c2", "dst")
    apart = "applied_decision = 'keep_separate' or (llm_decision = 'keep_separate' and applied_decision is null and error_code is null)"
    return named.where(apart).where(inside).select("candidate_id")


_APPLIED = f"""{_SRC}, asked AS (SELECT DISTINCT ca.version_id, ca.created_at, ca.id AS cid, applied_decision AS d, a.entity_id AS l, b.entity_id AS r, llm_decision, error_code FROM ca JOIN src a ON a.id = ca.l JOIN src b ON b.id = ca.r
  WHERE applied_decision IS NOT NULL AND a.entity_id IS NOT NULL AND b.entity_id IS NOT NULL),
said AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY created_at, cid) AS k FROM asked),
ent AS (SELECT id, arg_max(manuscript_version_id, updated_at) AS v, arg_max(coalesce(canonical_name, ''), updated_at) AS name FROM entities GROUP BY id),
held AS (SELECT v, map_from_entries(list({{'k': id, 'v': id}})) AS m FROM ent GROUP BY v),
step AS (SELECT v, 0::BIGINT AS k, m, []::VARCHAR[][] AS apart, NULL::VARCHAR AS cid, NULL::VARCHAR AS outcome, NULL::VARCHAR AS survivor, NULL::VARCHAR AS retired FROM held
  UNION ALL SELECT v, k, CASE WHEN outcome = 'merged' THEN map_from_entries(list_transform(map_entries(m), lambda e: {{'k': e.key, 'v': CASE WHEN e.value = retired THEN survivor ELSE e.value END}})) ELSE m END,
    CASE WHEN outcome = 'separated' THEN list_append(apart, [l, r]) ELSE apart END, cid, outcome, CASE WHEN outcome = 'merged' THEN survivor WHEN outcome = 'linked' THEN a END, CASE WHEN outcome = 'merged' THEN retired END
  FROM (SELECT *, CASE WHEN first THEN a ELSE b END AS survivor, CASE WHEN first THEN b ELSE a END AS retired, CASE WHEN a IS NULL OR b IS NULL THEN 'conflict' WHEN d = 'keep_separate' THEN CASE WHEN a <> b THEN 'separated' ELSE 'conflict' END
      WHEN d <> 'merge' THEN 'conflict' WHEN a = b THEN 'linked' WHEN len(list_filter(apart, lambda p: list_sort([m[p[1]], m[p[2]]]) = list_sort([a, b]))) > 0 THEN 'conflict' ELSE 'merged' END AS outcome
    FROM (SELECT x.*, (length(na.name), nb.id) > (length(nb.name), na.id) AS first FROM (SELECT step.v, said.k, m, apart, said.cid, said.d, said.l, said.r, m[said.l] AS a, m[said.r] AS b FROM step JOIN said ON said.version_id = step.v AND said.k = step.k + 1) x
      LEFT JOIN ent na ON na.id = a LEFT JOIN ent nb ON nb.id = b)))"""


@_c.query(f"WITH RECURSIVE {_APPLIED} SELECT v AS version_id, cid AS candidate_id, k AS position, outcome, survivor AS survivor_id, retired AS retired_id FROM step WHERE k > 0")
def e6_applied_in_order(spark, d):
    order = Window.partitionBy("version_id").orderBy("created_at", "candidate_id")
    said = _proposals(spark, d).where("applied_decision is not null").select("version_id", F.row_number().over(order).cast("long").alias("position"), "candidate_id", F.col("applied_decision").alias("decision"), "left_entity_id", "right_entity_id")
    known = table(spark, d, "entities").groupBy(F.col("id").alias("entity_id")).agg(F.max_by("manuscript_version_id", "updated_at").alias("version_id"), F.max_by("canonical_name", "updated_at").alias("canonical_name"))
    return E.applied_in_order(said, known.select("version_id", "entity_id", "canonical_name", F.lit(None).cast("string").alias("merged_into_id")))


@_c.query(f"""WITH {_SRC} SELECT DISTINCT ca.id, coalesce(len(list_filter(evidence_ids, lambda x: x NOT IN (a.e, b.e))) = 0 AND len(list_distinct(evidence_ids)) = len(evidence_ids)
  AND (coalesce(llm_decision, '') NOT IN ('merge', 'keep_separate') OR (list_contains(evidence_ids, a.e) AND list_contains(evidence_ids, b.e))), false) AS valid
FROM ca JOIN src a ON a.id = ca.l JOIN src b ON b.id = ca.r WHERE llm_decision IS NOT NULL""")
def e8_valid_decisions(spark, d):
    s = _sources(spark, d).select("mention_id", "evidence_id")
    rows = candidates(spark, d).where("llm_decision is not null").join(s.toDF("l", "left_evidence"), "l").join(s.toDF("r", "right_evidence"), "r")
    return rows.select("id", E.valid_decision("llm_decision", "evidence_ids").alias("valid")).distinct()


_MEMB = """memb AS (SELECT chapter_id, start_offset || '-' || end_offset AS span, entity_type || ':' || (start_offset // 2000) AS cluster FROM mn),
one AS (SELECT chapter_id, span, count(DISTINCT cluster) AS n, min(cluster) AS c FROM memb GROUP BY ALL)"""


def clustered_mentions(spark, d):
    """Mentions with their span and the stand-in cluster that holds it."""
    return mentions(spark, d).select(
        "id", "chapter_id", "surface_text", "entity_type", F.concat_ws("-", F.col("start_offset").cast("string"), F.col("end_offset").cast("string")).alias("span"),
        F.concat_ws(":", "entity_type", F.floor(F.col("start_offset") / 2000).cast("string")).alias("cluster"),
    )


@_c.query(f"""WITH {_SRC}, {_MEMB}, p AS (SELECT DISTINCT ca.id AS pair_id, a.chapter_id, a.start_offset || '-' || a.end_offset AS ls, b.start_offset || '-' || b.end_offset AS rs
  FROM ca JOIN mn a ON a.id = ca.l JOIN mn b ON b.id = ca.r WHERE a.chapter_id = b.chapter_id)
SELECT pair_id, coalesce(x.n = 1 AND y.n = 1 AND x.c = y.c, false) AS same FROM p LEFT JOIN one x ON x.chapter_id = p.chapter_id AND x.span = ls LEFT JOIN one y ON y.chapter_id = p.chapter_id AND y.span = rs""")
def e9_same_cluster(spark, d):
    m = clustered_mentions(spark, d)
    a, b = m.select(F.col("id").alias("l"), "chapter_id", F.col("span").alias("left_span")), m.select(F.col("id").alias("r"), "chapter_id", F.col("span").alias("right_span"))
    pairs = candidates(spark, d).select(F.col("id").alias("pair_id"), "l", "r").join(a, "l").join(b, ["r", "chapter_id"]).select("pair_id", "chapter_id", "left_span", "right_span").distinct()
    return E.same_cluster(pairs, m.select("chapter_id", "span", "cluster"))


@_c.query(f"WITH {_SRC}, {_MEMB} SELECT chapter_id, span, n::BIGINT AS clusters FROM one")
def j11_cluster_membership(spark, d):
    m = mentions(spark, d)
    span = F.concat_ws("-", F.col("start_offset").cast("string"), F.col("end_offset").cast("string"))
    cluster = F.concat_ws(":", "entity_type", F.floor(F.col("start_offset") / 2000).cast("string"))
    return m.groupBy("chapter_id", span.alias("span")).agg(F.countDistinct(cluster).alias("clusters"))


_RETRY = "error_code IN ('MODEL_UNAVAILABLE', 'MODEL_TIMEOUT', 'MODEL_CONNECTION_ERROR', 'MODEL_RATE_LIMITED', 'MODEL_SERVER_ERROR')"


@_c.query(f"WITH {_CA} SELECT DISTINCT id, applied_decision IS NULL AND (coalesce({_RETRY}, false) OR (llm_decision IS NULL AND error_code IS NULL)) AS pending FROM ca")
def f15_needs_evaluation(spark, d):
    return candidates(spark, d).select("id", E.needs_evaluation().alias("pending")).distinct()


@_c.query(f"WITH {_CA} SELECT id FROM ca WHERE error_code IS NULL OR NOT {_RETRY}")
def f16_without_transient_errors(spark, d):
    return candidates(spark, d).where(F.col("error_code").isNull() | ~F.col("error_code").isin(*E.RETRYABLE)).select("id")


_COUNTS = f"""count(*) FILTER (applied_decision IS NULL AND (coalesce({_RETRY}, false) OR (llm_decision IS NULL AND error_code IS NULL)))::BIGINT AS remaining,
count(*) FILTER (applied_decision IS NULL AND llm_decision IS NOT NULL AND coalesce(error_code, 'CLUSTER_CONFLICT') = 'CLUSTER_CONFLICT')::BIGINT AS review_count,
count(*) FILTER (applied_decision IS NULL AND coalesce(error_code, 'CLUSTER_CONFLICT') <> 'CLUSTER_CONFLICT')::BIGINT AS error_count,
count(*) FILTER (applied_decision IS NOT NULL OR (llm_decision IS NOT NULL AND error_code IS NULL))::BIGINT AS successful_count,
count(applied_decision)::BIGINT AS applied_count, count(*) FILTER (applied_decision = 'merge')::BIGINT AS merge_count"""


@_c.query(f"WITH {_CA} SELECT version_id, {_COUNTS} FROM ca GROUP BY version_id")
def a4_outcome_counts(spark, d):
    return E.outcome_counts(candidates(spark, d), "version_id")


@_c.query(f"WITH {_CA} SELECT version_id, {_COUNTS}, coalesce(max(created_at), TIMESTAMP '1970-01-01') AS last_answer FROM ca GROUP BY version_id")
def e10_attempts(spark, d):
    rows = candidates(spark, d)
    last = rows.groupBy("version_id").agg(F.max("created_at").alias("last_answer"))
    return E.outcome_counts(rows, "version_id").join(last, "version_id")


@_c.query(f"""WITH RECURSIVE {_APPLIED} SELECT cid AS candidate_id, retired AS entity_id, s.status AS status_before, survivor AS merged_into_after, 'merged' AS status_after
FROM step JOIN (SELECT id, arg_max(status, updated_at) AS status FROM entities GROUP BY id) s ON s.id = retired WHERE outcome = 'merged'""")
def e11_snapshot(spark, d):
    known = table(spark, d, "entities").groupBy(F.col("id").alias("entity_id")).agg(F.max_by("status", "updated_at").alias("status"))
    taken = E.snapshots(e6_applied_in_order(spark, d), known.withColumn("merged_into_id", F.lit(None).cast("string")))
    return taken.select("candidate_id", "before.entity_id", F.col("before.status").alias("status_before"), F.col("after.merged_into_id").alias("merged_into_after"), F.col("after.status").alias("status_after"))


@_c.query(f"""WITH {_CA} SELECT id, row_number() OVER (ORDER BY error_code IS NOT NULL, created_at, id)::INTEGER AS place FROM (SELECT id, max(error_code) AS error_code, max(created_at) AS created_at FROM ca WHERE applied_decision IS NULL GROUP BY id)
ORDER BY place LIMIT 20 OFFSET 20""")
def t4_page(spark, d):
    rows = candidates(spark, d).where("applied_decision is null").groupBy("id").agg(F.max("error_code").alias("error_code"), F.max("created_at").alias("created_at"))
    page = rows.orderBy(F.col("error_code").isNotNull(), "created_at", "id").offset(20).limit(20)
    place = F.row_number().over(Window.orderBy(F.col("error_code").isNotNull(), "created_at", "id")) + 20  # one page
    return page.select("id", place.alias("place"))


@_c.query(f"WITH {_CA} SELECT id, error_code IS NULL AS clean FROM (SELECT id, max(error_code) AS error_code, max(created_at) AS created_at FROM ca WHERE applied_decision IS NULL GROUP BY id) ORDER BY error_code IS NOT NULL, created_at, id LIMIT 50")
def t10_pending_order(spark, d):
    rows = candidates(spark, d).where("applied_decision is null").groupBy("id").agg(F.max("error_code").alias("error_code"), F.max("created_at").alias("created_at"))
    return rows.orderBy(F.col("error_code").isNotNull(), "created_at", "id").limit(50).select("id", F.col("error_code").isNull().alias("clean"))
