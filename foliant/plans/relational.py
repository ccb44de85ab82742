"""F, J, A, T, U and the D rows of S: filters, joins, aggregates, orders and sets over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import evaluation as V
from foliant.operators import relational as L
from foliant.operators.deliveries import newest_rows
from foliant.plans.deliveries import ref_sql
from foliant.plans.registry import Catalogue
from foliant.plans.resolution import _CA, _CH, _MN, candidates, chapters, mentions
from foliant.plans.scalars import NAME
from foliant.refs import normal_ref, normal_word
from foliant.sources.readers import read_jsonl
from foliant.tables import table

_c = Catalogue()
queries, oracle_sql = _c.queries, _c.oracle_sql

_V = "v AS (SELECT DISTINCT id, project_id, version_number, status, created_at, file_size, object_key FROM manuscript_versions)"


def versions(spark, d):
    return newest_rows(table(spark, d, "manuscript_versions"), "id", "created_at", "project_id", "version_number", "status", "file_size", "object_key")


# --- S -----------------------------------------------------------------------------------------------------------


@_c.query("SELECT doc_id, title, file_kind FROM documents")
def s5_jsonl_scan(spark, d):
    from foliant.shared import Workspace

    rows = table(spark, d, "documents").select("doc_id", "title", "file_kind")
    path = f"{Workspace(spark, 's5').root}/rows"
    rows.write.option("ignoreNullFields", "false").json(path)
    return read_jsonl(spark, path, rows.schema)


@_c.query("SELECT coalesce(embedding_version, '(none)') AS embedding_version, count(*)::BIGINT AS stored, count(*) FILTER (text IS NOT NULL)::BIGINT AS with_text FROM chunks GROUP BY 1")
def s10_completeness(spark, d):
    return table(spark, d, "chunks").groupBy(F.coalesce("embedding_version", F.lit("(none)")).alias("embedding_version")).agg(
        F.count(F.lit(1)).alias("stored"), F.count_if(F.col("text").isNotNull()).alias("with_text")
    )


@_c.query("SELECT doc_id, title FROM documents WHERE doc_id IN (3, 5, 8, 13, 21, 34, 55, 89)")
def s12_pushed_filter(spark, d):
    return table(spark, d, "documents").where(F.col("doc_id").isin(3, 5, 8, 13, 21, 34, 55, 89)).select("doc_id", "title")


@_c.query("SELECT p.i::INTEGER AS position, d.doc_id, d.file_kind FROM (VALUES (0, 8), (1, 3), (2, 21)) p(i, k) JOIN documents d ON d.doc_id = p.k")
def s13_picked_by_key(spark, d):
    return L.picked(table(spark, d, "documents").select("doc_id", "file_kind"), "doc_id", [8, 3, 21])


@_c.query("SELECT n::BIGINT AS ordinal, id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM entity_resolution_v1) WHERE n IN (0, 7, 70)")
def s14_picked_by_position(spark, d):
    return L.numbered(table(spark, d, "entity_resolution_v1").select("id"), "id").where(F.col("ordinal").isin(0, 7, 70)).select("ordinal", "id")


# --- F -----------------------------------------------------------------------------------------------------------


def _current(spark, d):
    ready = versions(spark, d).where("status = 'ready'")
    return L.latest(ready, ["project_id"], F.col("version_number").desc(), "id")


_CURRENT = f"{_V}, cur AS (SELECT * FROM v WHERE status = 'ready' QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY version_number DESC, id) = 1)"


@_c.query(f"WITH {_CURRENT} SELECT project_id, id, version_number FROM cur")
def f2_current_version(spark, d):
    return _current(spark, d).select("project_id", "id", "version_number")


@_c.query(f"WITH {_CURRENT}, {_CH} SELECT chapter_id, project_id FROM ch JOIN cur ON cur.id = ch.version_id")
def f3_owned_chapters(spark, d):
    return chapters(spark, d).join(_current(spark, d).select(F.col("id").alias("version_id"), "project_id"), "version_id").select("chapter_id", "project_id")


@_c.query(f"WITH {_V} SELECT id, status FROM v WHERE status IN ('ready', 'archived')")
def f4_status_in(spark, d):
    return versions(spark, d).where(F.col("status").isin("ready", "archived")).select("id", "status")


@_c.query(f"WITH {_CA} SELECT id FROM ca WHERE llm_decision IS DISTINCT FROM applied_decision")
def f5_distinct_from(spark, d):
    return candidates(spark, d).where(~F.col("llm_decision").eqNullSafe(F.col("applied_decision"))).select("id")


@_c.query(f"WITH {_V} SELECT id, object_key FROM v WHERE starts_with(object_key, 'manuscripts/0')")
def f6_prefix(spark, d):
    return versions(spark, d).where(F.col("object_key").startswith("manuscripts/0")).select("id", "object_key")


@_c.query("SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM entity_resolution_v1 WHERE split = 'dev') WHERE n % 4 = 1")
def f7_shard(spark, d):
    return L.shard(table(spark, d, "entity_resolution_v1").where("split = 'dev'").select("id"), 4, 1, "id").select("id")


@_c.query("SELECT id, entity_type FROM entity_resolution_v1 WHERE split = 'dev' AND entity_type IN ('character', 'organization') ORDER BY id LIMIT 12")
def f8_suite(spark, d):
    rows = table(spark, d, "entity_resolution_v1").where("split = 'dev'").where(F.col("entity_type").isin("character", "organization"))
    return rows.select("id", "entity_type").orderBy("id").limit(12)


@_c.query("SELECT id, left_ref.text AS left_text FROM entity_resolution_v1 WHERE left_ref.occurrence = 0")
def f10_nested_predicate(spark, d):
    return table(spark, d, "entity_resolution_v1").where("left_ref.occurrence = 0").select("id", F.col("left_ref.text").alias("left_text"))


@_c.query("SELECT DISTINCT id FROM manuscript_versions WHERE contains(lower(concat_ws(' ', status, object_key, original_filename, mime_type, pipeline_version)), 'whistle')")
def f11_text_filter(spark, d):
    text = F.lower(F.concat_ws(" ", "status", "object_key", "original_filename", "mime_type", "pipeline_version"))
    return table(spark, d, "manuscript_versions").where(text.contains("whistle")).select("id").distinct()


def facets(rows, **wanted):
    """Rows that agree with every facet that is not null."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


@_c.query(f"WITH {_MN} SELECT id FROM mn WHERE entity_type = 'location' AND scene_id IS NOT NULL")
def f12_facets(spark, d):
    return facets(mentions(spark, d).where("scene_id is not null"), entity_type="location", chunk_id=None).select("id")


@_c.query("SELECT DISTINCT id, title FROM chapters WHERE contains(title, 'Chapter 1')")
def f14_title_contains(spark, d):
    return table(spark, d, "chapters").where(F.col("title").contains("Chapter 1")).select("id", "title").distinct()


@_c.query(f"WITH {_CH} SELECT chapter_id, coalesce(nullif(title, ''), 'Chapter ' || ordinal) AS title FROM ch")
def f17_title_fallback(spark, d):
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Chapter "), F.col("ordinal").cast("string")))
    return chapters(spark, d).select("chapter_id", title.alias("title"))


@_c.query("SELECT id, left_ref.text || ' — ' || replace(expected, '_', ' ') || ' — ' || right_ref.text AS label FROM entity_resolution_v1 WHERE expected IS NOT NULL AND left_ref.text IS NOT NULL AND right_ref.text IS NOT NULL")
def f18_label(spark, d):
    rows = table(spark, d, "entity_resolution_v1").where("expected is not null and left_ref.text is not null and right_ref.text is not null")
    return rows.select("id", F.concat_ws(" — ", "left_ref.text", F.replace(F.col("expected"), F.lit("_"), F.lit(" ")), "right_ref.text").alias("label"))


# --- J -----------------------------------------------------------------------------------------------------------


@_c.query(f"WITH {_CH}, k AS (SELECT DISTINCT id, chapter_id, ordinal AS chunk_ordinal FROM chunks) SELECT k.id, ch.ordinal AS chapter_ordinal, chunk_ordinal FROM k JOIN ch USING (chapter_id)")
def j2_chunk_chapter(spark, d):
    chunks = table(spark, d, "chunks").select("id", "chapter_id", F.col("ordinal").alias("chunk_ordinal")).distinct()
    return chunks.join(chapters(spark, d).select("chapter_id", F.col("ordinal").alias("chapter_ordinal")), "chapter_id").select("id", "chapter_ordinal", "chunk_ordinal")


@_c.query(f"WITH {_V}, {_CH} SELECT project_id, max(version_number) AS newest_with_chapters FROM v SEMI JOIN ch ON ch.version_id = v.id GROUP BY project_id")
def j3_newest_accepted(spark, d):
    loaded = chapters(spark, d).select(F.col("version_id").alias("id"))
    return versions(spark, d).join(loaded, "id", "left_semi").groupBy("project_id").agg(F.max("version_number").alias("newest_with_chapters"))


@_c.query("SELECT c_custkey, coalesce(n, 0)::BIGINT AS finished FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def j4_left_outer_coverage(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").join(done, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("finished"))


@_c.query("SELECT c_custkey, count(*)::BIGINT AS late FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY 1")
def j5_inner_coverage(spark, d):
    late = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(late, "c_custkey").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("late"))


@_c.query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def j6_three_way(spark, d):
    regions = table(spark, d, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    nations = table(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


_QRELS = f"""{_CH}, q AS (SELECT DISTINCT chapter_id, surface_text FROM entity_mentions), k AS (SELECT DISTINCT id, chapter_id, text FROM chunks WHERE text IS NOT NULL),
hit AS (SELECT q.chapter_id, surface_text, k.id AS chunk_id FROM q JOIN k ON k.chapter_id = q.chapter_id AND contains(k.text, surface_text))"""


def _qrels(spark, d):
    q = table(spark, d, "entity_mentions").select("chapter_id", "surface_text").distinct()
    k = table(spark, d, "chunks").where("text is not null").select(F.col("id").alias("chunk_id"), "chapter_id", "text").distinct()
    return q, q.join(k, "chapter_id").where(F.col("text").contains(F.col("surface_text"))).select("chapter_id", "surface_text", "chunk_id")


@_c.query(f"WITH {_QRELS} SELECT chapter_id, surface_text, chunk_id FROM hit")
def j7_qrels(spark, d):
    return _qrels(spark, d)[1]


@_c.query(f"WITH {_QRELS} SELECT chapter_id, surface_text FROM q ANTI JOIN hit USING (chapter_id, surface_text)")
def j7_misses(spark, d):
    q, hit = _qrels(spark, d)
    return q.join(hit, ["chapter_id", "surface_text"], "left_anti")


@_c.query(f"""WITH {_MN} SELECT id FROM mn WHERE EXISTS (SELECT 1 FROM chunks k WHERE k.chapter_id = mn.chapter_id AND k.scene_id = mn.scene_id AND k.start_offset <= mn.start_offset AND k.end_offset >= mn.end_offset)""")
def j8_interval_semi(spark, d):
    return L.covered(mentions(spark, d), table(spark, d, "chunks"), ["chapter_id", "scene_id"]).select("id")


@_c.query("WITH e AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings), f AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events) SELECT vec_id, event_id FROM e JOIN f USING (n)")
def j13_zip(spark, d):
    a = L.numbered(table(spark, d, "embeddings").select("vec_id"), "vec_id")
    b = L.numbered(table(spark, d, "events").select("event_id"), "event_id")
    return a.join(b, "ordinal").select("vec_id", "event_id")


_ALIAS = f"al AS (SELECT DISTINCT e.manuscript_version_id AS version_id, {NAME.format('alias')} AS name, {ref_sql('entity_id')} AS entity_id FROM entity_aliases a JOIN (SELECT DISTINCT id, manuscript_version_id FROM entities) e ON e.id = {ref_sql('entity_id')} WHERE alias IS NOT NULL)"


def _aliases(spark, d):
    e = table(spark, d, "entities").select(F.col("id").alias("entity_id"), F.col("manuscript_version_id").alias("version_id")).distinct()
    return table(spark, d, "entity_aliases").where("alias is not null").select(normal_ref("entity_id").alias("entity_id"), X.normalized_name("alias").alias("name")).join(e, "entity_id").select("version_id", "name", "entity_id").distinct()


@_c.query(f"WITH {_ALIAS} SELECT version_id, name, min(entity_id) AS entity_id FROM al GROUP BY 1, 2 HAVING count(DISTINCT entity_id) = 1")
def j14_unique_lookup(spark, d):
    return L.unique_lookup(_aliases(spark, d), "name", "entity_id", "version_id")


@_c.query(f"""WITH k AS (SELECT DISTINCT id, text FROM chunks WHERE text IS NOT NULL), m AS (SELECT DISTINCT chunk_id, {NAME.format('surface_text')} AS name FROM entity_mentions)
SELECT id AS chunk_id, name, contains(' ' || {NAME.format('text')} || ' ', ' ' || name || ' ') AS bounded FROM k JOIN m ON m.chunk_id = k.id WHERE name <> ''""")
def j15_bounded_containment(spark, d):
    names = table(spark, d, "entity_mentions").select("chunk_id", X.normalized_name("surface_text").alias("name")).distinct().where("name <> ''")
    k = table(spark, d, "chunks").where("text is not null").select(F.col("id").alias("chunk_id"), "text").distinct().select("chunk_id", X.normalized_name("text").alias("t"))
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return k.join(names, "chunk_id").select("chunk_id", "name", pad("t").contains(pad("name")).alias("bounded"))


@_c.query(f"WITH {_MN} SELECT chunk_id, array_to_string(list_sort(list(DISTINCT entity_id))[1:50], ',') AS entities FROM mn WHERE entity_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1")
def j17_refs_per_chunk(spark, d):
    rows = mentions(spark, d).where("entity_id is not null and chunk_id is not null")
    return L.few_of_each(rows, ["chunk_id"], "entity_id", 50, "ids").select("chunk_id", F.array_join("ids", ",").alias("entities"))


@_c.query(f"WITH {_V}, {_CH} SELECT chapter_id FROM ch WHERE version_id IN (SELECT id FROM v WHERE version_number <= 2)")
def j20_in_subquery(spark, d):
    old = versions(spark, d).where("version_number <= 2").select(F.col("id").alias("version_id"))
    return chapters(spark, d).join(old, "version_id", "left_semi").select("chapter_id")


@_c.query(f"WITH {_MN}, e AS (SELECT id, arg_max(coalesce(canonical_name, '?'), updated_at) AS name FROM entities GROUP BY id) SELECT scene_id, array_to_string(list_sort(list(DISTINCT name)), '; ') AS names FROM mn JOIN e ON e.id = mn.entity_id WHERE scene_id IS NOT NULL GROUP BY 1")
def j22_names_per_scene(spark, d):
    e = table(spark, d, "entities").groupBy(F.col("id").alias("entity_id")).agg(F.max_by(F.coalesce("canonical_name", F.lit("?")), "updated_at").alias("name"))
    return mentions(spark, d).where("scene_id is not null").join(e, "entity_id").groupBy("scene_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("names"))


# --- A -----------------------------------------------------------------------------------------------------------


@_c.query(f"WITH {_CH} SELECT version_id, count(DISTINCT s.id)::BIGINT AS n FROM scenes s JOIN ch ON ch.chapter_id = {ref_sql('s.chapter_id')} GROUP BY 1")
def a1_counts(spark, d):
    scenes = table(spark, d, "scenes").select("id", normal_ref("chapter_id").alias("chapter_id"))
    return scenes.join(chapters(spark, d).select("chapter_id", "version_id"), "chapter_id").groupBy("version_id").agg(F.countDistinct("id").alias("n"))


@_c.query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS finished, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS open FROM orders GROUP BY 1")
def a2_count_filter(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))


@_c.query(f"WITH {_V} SELECT project_id, coalesce(max(version_number) FILTER (status = 'failed'), 0) + 1 AS next_number FROM v GROUP BY 1")
def a3_next_number(spark, d):
    failed = F.max(F.when(F.col("status") == "failed", F.col("version_number")))
    return versions(spark, d).groupBy("project_id").agg((F.coalesce(failed, F.lit(0)) + 1).alias("next_number"))


@_c.query("SELECT event_type, round(median(value), 6) AS median, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def a6a_percentile(spark, d):
    exact = lambda p: F.round(F.percentile("value", p), 6)
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"), exact(0.5).alias("p50"), exact(0.95).alias("p95"))


@_c.query("SELECT event_type, round(list_sort(list(value))[round_even((count(*) - 1) * 0.95, 0)::INTEGER + 1], 6) AS p95 FROM events GROUP BY 1")
def a6b_nearest_rank(spark, d):
    return L.nearest_rank(table(spark, d, "events"), "event_type", "value", 0.95).select("event_type", F.round("value", 6).alias("p95"))


#: What calls report: some a count that is none, some a second count.
_USAGE = """CASE WHEN event_id % 97 = 0 THEN '{"prompt": -3, "completion": true}' WHEN event_type = 'error' AND event_id % 5 = 0 THEN '{"prompt": ' || (props->>'k') || '}'
  ELSE '{"prompt": ' || (props->>'k') || ', "completion": ' || (event_id % 50) || '}' END"""


def _calls(spark, d):
    k, e = F.get_json_object("props", "$.k"), F.col("event_id")
    whole = F.concat(F.lit('{"prompt": '), k, F.lit(', "completion": '), (e % 50).cast("string"), F.lit("}"))
    usage = F.when(e % 97 == 0, '{"prompt": -3, "completion": true}').when((F.col("event_type") == "error") & (e % 5 == 0), F.concat(F.lit('{"prompt": '), k, F.lit("}"))).otherwise(whole)
    return table(spark, d, "events").select("event_type", e.alias("call"), "user_id", usage.alias("usage"))


@_c.query(f"""WITH u AS (SELECT event_type, event_id, {_USAGE} AS j FROM events), v AS (SELECT event_type, unnest(['prompt', 'completion']) AS key, unnest([j->>'prompt', j->>'completion']) AS said FROM u)
SELECT event_type, key, sum(said::BIGINT)::BIGINT AS total FROM v WHERE regexp_full_match(said, '[0-9]+') GROUP BY 1, 2""")
def a11_usage_sums(spark, d):
    return V.usage_sums(_calls(spark, d), "usage", "event_type")


@_c.query(f"""WITH u AS (SELECT user_id, event_id, {_USAGE} AS j FROM events), c AS (SELECT user_id, event_id, CASE WHEN regexp_full_match(j->>'prompt', '[0-9]+') THEN (j->>'prompt')::BIGINT END AS p, CASE WHEN regexp_full_match(j->>'completion', '[0-9]+') THEN (j->>'completion')::BIGINT END AS q FROM u)
SELECT user_id, count(*)::BIGINT AS calls, CASE WHEN bool_and(p IS NOT NULL AND q IS NOT NULL) THEN round(sum(p * 250.0::DOUBLE / 1e6 + q * 1000.0::DOUBLE / 1e6), 6) END AS cost FROM c GROUP BY 1""")
def a11_token_costs(spark, d):
    return V.token_costs(_calls(spark, d), "usage", {"prompt": 250.0, "completion": 1000.0}, "user_id")


@_c.query("SELECT id, n::BIGINT AS n FROM (SELECT id, count(*) AS n FROM chapters GROUP BY id) WHERE n > 1")
def a14_duplicate_keys(spark, d):
    return table(spark, d, "chapters").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@_c.query("SELECT entity_id, array_to_string(list_sort(list(DISTINCT alias))[1:50], '|') AS aliases FROM entity_aliases WHERE alias IS NOT NULL GROUP BY 1")
def a15_grouped_sets(spark, d):
    rows = table(spark, d, "entity_aliases").where("alias is not null")
    return L.few_of_each(rows, ["entity_id"], "alias", 50, "names").select("entity_id", F.array_join("names", "|").alias("aliases"))


@_c.query(f"WITH {_MN}, {_CH} SELECT entity_id, mn.id, row_number() OVER (PARTITION BY entity_id ORDER BY ordinal, start_offset, mn.id) - 1 AS position FROM mn JOIN ch USING (chapter_id) WHERE entity_id IS NOT NULL")
def a16_ordered_evidence(spark, d):
    rows = mentions(spark, d).where("entity_id is not null").join(chapters(spark, d).select("chapter_id", "ordinal"), "chapter_id")
    found = L.numbered_within(rows.select("entity_id", "ordinal", "start_offset", "id"), ["entity_id"], ["ordinal", "start_offset", "id"], name="position")
    return found.select("entity_id", "id", "position")


@_c.query(f"""WITH {_MN} SELECT version_id, entity_type, lower(surface_text) AS key, id AS first_id FROM mn
QUALIFY row_number() OVER (PARTITION BY version_id, entity_type, lower(surface_text) ORDER BY chapter_id, start_offset, id) = 1""")
def a17_first_wins(spark, d):
    rows = mentions(spark, d).select("version_id", "entity_type", F.lower("surface_text").alias("key"), F.col("id").alias("first_id"), "chapter_id", "start_offset")
    return L.latest(rows, ["version_id", "entity_type", "key"], "chapter_id", "start_offset", "first_id").drop("chapter_id", "start_offset")


@_c.query("SELECT 'file_kind' AS facet, array_to_string(list_sort(list(DISTINCT file_kind)), ',') AS names FROM documents")
def a18_sorted_distinct(spark, d):
    return table(spark, d, "documents").agg(F.array_join(F.array_sort(F.collect_set("file_kind")), ",").alias("names")).select(F.lit("file_kind").alias("facet"), "names")


@_c.query("SELECT user_id, string_agg(event_type || '=' || ms, ',' ORDER BY event_type) AS stages FROM (SELECT user_id, event_type, sum((value * 100)::BIGINT)::BIGINT AS ms FROM events GROUP BY 1, 2) GROUP BY 1")
def a19_stage_durations(spark, d):
    ms = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum(F.rint(F.col("value") * 100).cast("long")).alias("ms"))
    stages = F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "ms"))))
    whole = ms.groupBy("user_id").agg(stages.alias("m"))
    return whole.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("stages"))


@_c.query("""SELECT v AS version_id, left(sha256(count(*) || '|' || sum(('0x' || substr(h, 1, 8))::BIGINT) || '|' || sum(('0x' || substr(h, 9, 8))::BIGINT)), 16) AS state
FROM (SELECT DISTINCT manuscript_version_id AS v, sha256(id || ':' || entity_type) AS h FROM entities) GROUP BY v""")
def a20_state_hash(spark, d):
    rows = table(spark, d, "entities").select(F.col("manuscript_version_id").alias("version_id"), F.sha2(F.concat_ws(":", "id", "entity_type"), 256).alias("h")).distinct()
    part = lambda a: F.sum(F.conv(F.substring("h", a, 8), 16, 10).cast("long")).cast("string")
    joined = F.concat_ws("|", F.count(F.lit(1)).cast("string"), part(1), part(9))
    return rows.groupBy("version_id").agg(F.substring(F.sha2(joined, 256), 1, 16).alias("state"))


@_c.query(f"WITH {_QRELS} SELECT (SELECT count(*) FROM k)::BIGINT AS chunks, (SELECT count(*) FROM hit)::BIGINT AS qrels, (SELECT count(*) FROM (SELECT 1 FROM hit GROUP BY chapter_id, surface_text HAVING count(*) > 1))::BIGINT AS several")
def a21_corpus_stats(spark, d):
    _, hit = _qrels(spark, d)
    chunks = table(spark, d, "chunks").where("text is not null").select("id", "chapter_id", "text").distinct().agg(F.count(F.lit(1)).alias("chunks"))
    per = hit.groupBy("chapter_id", "surface_text").agg(F.count(F.lit(1)).alias("n"))
    sums = per.agg(F.sum("n").alias("qrels"), F.count_if(F.col("n") > 1).alias("several"))
    return chunks.join(sums, F.lit(True))  # one row each


@_c.query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts DESC, event_id DESC) = 1")
def a23_best_run(spark, d):
    return L.latest(table(spark, d, "events").select("user_id", "event_id", "value", "ts"), ["user_id"], F.col("value").desc(), F.col("ts").desc(), F.col("event_id").desc()).drop("ts")


@_c.query("SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem))::BIGINT AS uncovered")
def a24_subset(spark, d):
    prior, now = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    return prior.join(now, "k", "left_anti").agg(F.countDistinct("k").alias("uncovered"))


@_c.query("SELECT count(*)::BIGINT AS rows, count(DISTINCT id)::BIGINT AS ids, count(*) = count(DISTINCT id) AS is_unique FROM entity_resolution_v1")
def a25_uniqueness(spark, d):
    rows = table(spark, d, "entity_resolution_v1").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"))
    return rows.withColumn("is_unique", F.col("rows") == F.col("ids"))


# --- T -----------------------------------------------------------------------------------------------------------


@_c.query(f"WITH {_V} SELECT id, created_at FROM v ORDER BY created_at DESC, id DESC LIMIT 50")
def t5_newest_first(spark, d):
    return versions(spark, d).select("id", "created_at").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(50)


@_c.query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'view' THEN NULL ELSE event_type END ASC NULLS LAST, event_id)::INTEGER AS place FROM events")
def t6_nulls_last(spark, d):
    stated = F.when(F.col("event_type") != "view", F.col("event_type"))
    order = Window.partitionBy("user_id").orderBy(stated.asc_nulls_last(), "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(order).alias("place"))


@_c.query(f"""WITH {_MN}, {_CH} SELECT mn.version_id, mn.id, row_number() OVER (PARTITION BY mn.version_id
  ORDER BY ordinal NULLS LAST, CASE WHEN scene_id IS NOT NULL THEN start_offset END NULLS LAST, mn.id)::INTEGER AS place FROM mn LEFT JOIN ch USING (chapter_id)""")
def t7_narrative_order(spark, d):
    rows = mentions(spark, d).join(chapters(spark, d).select("chapter_id", "ordinal"), "chapter_id", "left")
    place = rows.select("version_id", "id", "ordinal", F.when(F.col("scene_id").isNotNull(), F.col("start_offset")).alias("at"))
    found = L.numbered_within(place, ["version_id"], [F.col("ordinal").asc_nulls_last(), F.col("at").asc_nulls_last(), "id"], name="place")
    return found.select("version_id", "id", (F.col("place") + 1).cast("int").alias("place"))


@_c.query("WITH e AS (SELECT id, max(manuscript_version_id) AS v, max(canonical_name) AS name FROM entities GROUP BY id) SELECT v AS version_id, id, row_number() OVER (PARTITION BY v ORDER BY lower(name) NULLS FIRST, id)::INTEGER AS place FROM e")
def t8_entity_list(spark, d):
    rows = table(spark, d, "entities").groupBy("id").agg(F.max("manuscript_version_id").alias("version_id"), F.max("canonical_name").alias("name"))
    found = L.numbered_within(rows.withColumn("key", F.lower("name")), ["version_id"], [F.col("key").asc_nulls_first(), "id"], name="place")
    return found.select("version_id", "id", (F.col("place") + 1).cast("int").alias("place"))


@_c.query(f"WITH {_MN} SELECT entity_id, id FROM mn WHERE entity_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY chapter_id, start_offset, id) <= 20")
def t9_capped_evidence(spark, d):
    order = Window.partitionBy("entity_id").orderBy("chapter_id", "start_offset", "id")
    return mentions(spark, d).where("entity_id is not null").withColumn("n", F.row_number().over(order)).where("n <= 20").select("entity_id", "id")


@_c.query(f"WITH {_CA} SELECT DISTINCT id, error_code FROM ca WHERE error_code IS NOT NULL ORDER BY id LIMIT 10")
def t11_examples(spark, d):
    return candidates(spark, d).where("error_code is not null").select("id", "error_code").distinct().orderBy("id").limit(10)


# --- U -----------------------------------------------------------------------------------------------------------

_LINES_OF = "SELECT DISTINCT chapter_id, start_offset FROM scenes"


@_c.query(f"""WITH p AS (SELECT DISTINCT chapter_id, start_offset FROM chunks), e AS ({_LINES_OF}), t AS (SELECT * FROM p INTERSECT SELECT * FROM e), fp AS (SELECT * FROM p EXCEPT SELECT * FROM e), fn AS (SELECT * FROM e EXCEPT SELECT * FROM p)
SELECT (SELECT count(*) FROM t)::BIGINT AS tp, (SELECT count(*) FROM fp)::BIGINT AS fp, (SELECT count(*) FROM fn)::BIGINT AS fn""")
def u2_tp_fp_fn(spark, d):
    p = table(spark, d, "chunks").select("chapter_id", "start_offset").distinct().withColumn("p", F.lit(1))
    e = table(spark, d, "scenes").select("chapter_id", "start_offset").distinct().withColumn("e", F.lit(1))
    both = p.join(e, ["chapter_id", "start_offset"], "full_outer")
    return both.agg(F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


@_c.query("WITH a AS (SELECT DISTINCT chunk_id FROM entity_mentions WHERE chunk_id IS NOT NULL), b AS (SELECT DISTINCT id FROM chunks) SELECT (SELECT count(*) FROM a WHERE chunk_id NOT IN (FROM b))::BIGINT AS unknown, (SELECT count(*) FROM b WHERE id NOT IN (FROM a))::BIGINT AS unused")
def u5_id_sets(spark, d):
    a = table(spark, d, "entity_mentions").where("chunk_id is not null").select(F.col("chunk_id").alias("id")).distinct().withColumn("a", F.lit(1))
    b = table(spark, d, "chunks").select("id").distinct().withColumn("b", F.lit(1))
    return a.join(b, "id", "full_outer").agg(F.count_if(F.col("b").isNull()).alias("unknown"), F.count_if(F.col("a").isNull()).alias("unused"))


@_c.query("SELECT DISTINCT entity_type, prompt_version FROM entity_mentions")
def u6_facets(spark, d):
    return table(spark, d, "entity_mentions").select("entity_type", "prompt_version").distinct()
