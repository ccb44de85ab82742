"""K and Q7-Q10: structured memory over the test tables.

No model runs here.  A stand-in proposes a fact, an event and a relationship for every two mentions that follow each
other in a chunk, some of them with errors on purpose, so that every rule of the validation has something to refuse.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import memory as K
from foliant.operators import relational as L
from foliant.plans.registry import Catalogue
from foliant.plans.changes_and_trees import _WALK
from foliant.plans.resolution import _CH, _MN, _ROOTS, _roots, chapters, mentions
from foliant.refs import normal_ref
from foliant.tables import table

_c = Catalogue()
queries, oracle_sql = _c.queries, _c.oracle_sql

_PAIRS = f"""{_MN}, pr AS (SELECT * FROM (SELECT version_id, chunk_id, id, surface_text AS s1, entity_type AS t1, entity_id AS e1, start_offset AS o, lead(surface_text) OVER w AS s2, lead(entity_id) OVER w AS e2,
  row_number() OVER w AS n FROM mn WHERE chunk_id IS NOT NULL WINDOW w AS (PARTITION BY chunk_id ORDER BY start_offset, id)) WHERE s2 IS NOT NULL),
fact AS (SELECT version_id, chunk_id, n::INTEGER AS position, s1 AS subject, CASE WHEN o % 5 = 0 THEN 'has_seen' ELSE 'stands_near' END AS predicate, s2 AS object,
  CASE o % 4 WHEN 0 THEN 'location' WHEN 1 THEN 'attribute' WHEN 2 THEN 'colour' ELSE 'state' END AS fact_type, o % 9 = 0 AS miscited, o FROM pr),
checked AS (SELECT *, CASE WHEN miscited THEN 'invalid_evidence_id' WHEN fact_type = 'colour' OR predicate = 'has_seen' THEN 'invalid_fact_taxonomy' END AS reason FROM fact),
place AS (SELECT DISTINCT id AS chunk_id, chapter_id, ordinal AS chunk_ordinal FROM chunks)"""


def pairs(spark, d):
    w = Window.partitionBy("chunk_id").orderBy("start_offset", "id")
    rows = mentions(spark, d).where("chunk_id is not null").select(
        "version_id", "chunk_id", "id", F.col("surface_text").alias("s1"), F.col("entity_type").alias("t1"), F.col("entity_id").alias("e1"), F.col("start_offset").alias("o"),
        F.lead("surface_text").over(w).alias("s2"), F.lead("entity_id").over(w).alias("e2"), F.row_number().over(w).alias("n"),
    )
    return rows.where("s2 is not null")


def facts(spark, d):
    o = F.col("o")
    kind = F.when(o % 4 == 0, "location").when(o % 4 == 1, "attribute").when(o % 4 == 2, "colour").otherwise("state")
    return pairs(spark, d).select(
        "version_id", "chunk_id", F.col("n").alias("position"), F.col("s1").alias("subject"), F.when(o % 5 == 0, "has_seen").otherwise("stands_near").alias("predicate"), F.col("s2").alias("object"),
        kind.alias("fact_type"), (o % 9 == 0).alias("miscited"), "o",
    )


def checked(spark, d):
    bad = (~F.col("fact_type").isin(*sorted(K.FACT_TYPES))) | F.col("predicate").rlike("^(has_|is_|was_|became_)")
    reason = F.when(F.col("miscited"), "invalid_evidence_id").when(bad, "invalid_fact_taxonomy")
    return facts(spark, d).withColumn("reason", reason)


def places(spark, d):
    return table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "chapter_id", F.col("ordinal").alias("chunk_ordinal")).distinct()


def _inputs(spark, d):
    k = table(spark, d, "chunks").where("text is not null").select(F.col("id").alias("chunk_id"), normal_ref("manuscript_version_id").alias("version_id"), "chapter_id", "start_offset", "text").distinct()
    m = mentions(spark, d).where("entity_id is not null and chunk_id is not null").select("chunk_id", "entity_id", "surface_text")
    e = table(spark, d, "entities").groupBy(F.col("id").alias("entity_id")).agg(F.max_by("canonical_name", "updated_at").alias("name"), F.max_by("entity_type", "updated_at").alias("type"))
    return K.chunk_inputs(k, m, _roots(spark, d), e)


def _proposed(spark, d):
    """JSON of the stand-in's proposals per chunk."""
    o = F.col("o")
    inputs = _inputs(spark, d)
    p = pairs(spark, d).join(inputs.select("chunk_id", "evidence_id"), "chunk_id")
    cited = F.when(o % 9 == 0, F.array(F.lit("unknown"))).otherwise(F.array("evidence_id"))
    started = F.when(o % 3 == 0, "started").when(o % 3 == 1, "ended").otherwise("asserted")
    none = F.array().cast("array<string>")
    fact = F.struct("n", F.col("s1").alias("subject_text"), F.when(o % 5 == 0, "has_seen").otherwise("stands_near").alias("predicate"), F.col("s2").alias("object_text"),
                    F.when(o % 4 == 2, "colour").otherwise("state").alias("fact_type"), cited.alias("evidence_ids"))
    kind = F.when(o % 6 == 0, "movement").when(o % 6 == 1, "communication").when(started != "asserted", F.concat(F.lit("relationship_"), started)).otherwise("other_major")
    place = F.when(F.col("t1").isin("location", "gpe", "facility"), F.array("s1")).otherwise(none)
    actor = F.when(F.col("t1").isin("location", "gpe"), F.array("s2")).otherwise(F.array("s1", "s2"))
    event = F.struct("n", F.concat(F.lit("e"), F.col("n").cast("string")).alias("local_id"), kind.alias("event_type"), F.concat_ws(" ", "s1", F.lit("met"), "s2").alias("description"),
                     actor.alias("participant_texts"), place.alias("location_texts"), none.alias("participant_entity_ids"), none.alias("location_entity_ids"), cited.alias("evidence_ids"))
    rel = F.struct("n", F.col("s1").alias("source_text"), F.when(o % 2 == 0, "friend_of").otherwise("works_for").alias("relation_type"), F.col("s2").alias("target_text"), started.alias("change"),
                   F.when(started != "asserted", F.concat(F.lit("e"), F.col("n").cast("string"))).alias("event_local_id"), cited.alias("evidence_ids"))
    lists = p.groupBy("chunk_id").agg(*(F.array_sort(F.collect_list(s)).alias(n) for s, n in ((fact, "facts"), (event, "events"), (rel, "relationships"))))
    return inputs.join(lists.select("chunk_id", F.to_json(F.struct("facts", "events", "relationships")).alias("proposed")), "chunk_id")


@_c.query(f"""WITH k AS (SELECT DISTINCT id, manuscript_version_id AS v, chapter_id, start_offset, text FROM chunks WHERE text IS NOT NULL),
h AS (SELECT id, sha1(from_hex(replace(v, '-', '')) || encode('memory:' || chapter_id || ':' || id || ':' || start_offset || ':' || sha256(text))) AS h FROM k)
SELECT id AS chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS evidence_id FROM h""")
def k8_evidence_id(spark, d):
    k = table(spark, d, "chunks").where("text is not null").select(F.col("id").alias("chunk_id"), F.col("manuscript_version_id").alias("version_id"), "chapter_id", "start_offset", "text").distinct()
    return k.select("chunk_id", K.evidence_id().alias("evidence_id"))


@_c.query(f"""WITH RECURSIVE {_WALK}, {_ROOTS}, {_MN}, placed AS (SELECT chunk_id, root_id, surface_text FROM mn JOIN roots ON roots.entity_id = mn.entity_id WHERE chunk_id IS NOT NULL),
said AS (SELECT root_id, list_sort(list(DISTINCT surface_text))[1:{K.MOST_ALIASES + 1}] AS said FROM placed GROUP BY 1),
ent AS (SELECT id AS root_id, nullif(arg_max(coalesce(canonical_name, ''), updated_at), '') AS name, arg_max(entity_type, updated_at) AS t FROM entities GROUP BY id),
refs AS (SELECT root_id, coalesce(name, said[1]) AS name, t, list_filter(said, lambda x: x <> coalesce(name, ''))[1:{K.MOST_ALIASES}] AS aliases FROM ent JOIN said USING (root_id)),
listed AS (SELECT chunk_id, string_agg(root_id || '=' || name || '/' || t || '/' || array_to_string(aliases, '|'), ';' ORDER BY root_id) AS entities FROM (SELECT DISTINCT chunk_id, root_id FROM placed) JOIN refs USING (root_id) GROUP BY 1)
SELECT k.id AS chunk_id, entities FROM (SELECT DISTINCT id FROM chunks WHERE text IS NOT NULL) k LEFT JOIN listed ON listed.chunk_id = k.id""")
def k1_chunk_inputs(spark, d):
    one = lambda e: F.concat(e["id"], F.lit("="), e["name"], F.lit("/"), e["type"], F.lit("/"), F.array_join(e["aliases"], "|"))
    return _inputs(spark, d).select("chunk_id", F.array_join(F.transform("entities", one), ";").alias("entities"))


@_c.query(f"WITH {_PAIRS} SELECT chunk_id, position, fact_type, reason FROM checked")
def k2_checked_facts(spark, d):
    return checked(spark, d).select("chunk_id", "position", "fact_type", "reason")


@_c.query()
def k3_validated(spark, d):
    return K.validated(_proposed(spark, d))


@_c.query()
def k4_inferred_roles(spark, d):
    rows = K.validated(_proposed(spark, d)).where("kind = 'event' and item is not null")
    role = lambda n: F.array_join(F.from_json(F.get_json_object("item", f"$.{n}"), "array<string>"), ",").alias(n)
    return rows.where(F.get_json_object("item", "$.event_type").isin("movement", "accident")).select("chunk_id", "position", role("participant_entity_ids"), role("location_entity_ids"))


@_c.query()
def k5_rejections(spark, d):
    return K.validated(_proposed(spark, d)).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@_c.query(f"""WITH {_PAIRS} SELECT version_id, lower(subject) AS subject, predicate, lower(object) AS object, fact_type, chunk_id FROM checked JOIN place USING (chunk_id) WHERE reason IS NULL
QUALIFY row_number() OVER (PARTITION BY version_id, lower(subject), predicate, lower(object), fact_type ORDER BY chunk_ordinal, chunk_id, position) = 1""")
def k6_joined_facts(spark, d):
    rows = checked(spark, d).where("reason is null").join(places(spark, d), "chunk_id").withColumn("subject", F.lower("subject")).withColumn("object", F.lower("object"))
    keys = ["version_id", "subject", "predicate", "object", "fact_type"]
    return L.latest(rows, keys, "chunk_ordinal", "chunk_id", "position").select(*keys, "chunk_id")


def changes(spark, d):
    o = F.col("o")
    change = F.when(o % 3 == 0, "started").when(o % 3 == 1, "ended").otherwise("asserted")
    rows = pairs(spark, d).where("e1 is not null and e2 is not null and e1 <> e2").join(places(spark, d), "chunk_id")
    return rows.select("version_id", F.col("e1").alias("source_id"), F.lit("works_for").alias("relation_type"), F.col("e2").alias("target_id"), "chunk_ordinal", F.col("n").alias("position"), change.alias("change"),
                       F.when(change != "asserted", F.concat_ws(":", "chunk_id", F.col("n").cast("string"))).alias("event_id"))


@_c.query(f"""WITH {_PAIRS}, c AS (SELECT version_id, e1 AS source_id, 'works_for' AS relation_type, e2 AS target_id, chunk_ordinal, n, CASE o % 3 WHEN 0 THEN 'started' WHEN 1 THEN 'ended' ELSE 'asserted' END AS change,
  CASE WHEN o % 3 < 2 THEN pr.chunk_id || ':' || n END AS event_id FROM pr JOIN place USING (chunk_id) WHERE e1 <> e2),
f AS (SELECT *, row_number() OVER w AS i, lag(change) OVER w AS pc, lag(event_id) OVER w AS pe FROM c WINDOW w AS (PARTITION BY version_id, source_id, target_id ORDER BY chunk_ordinal, n, event_id NULLS FIRST)),
s AS (SELECT *, sum(CASE WHEN pc IS NULL OR (pc = 'ended' AND NOT (change = 'ended' AND event_id IS NOT DISTINCT FROM pe)) THEN 1 ELSE 0 END) OVER (PARTITION BY version_id, source_id, target_id ORDER BY i) AS state_no FROM f)
SELECT version_id, source_id, relation_type, target_id, state_no::INTEGER AS state_no, CASE WHEN bool_or(change = 'ended') THEN 'ended' ELSE 'active' END AS status, arg_min(event_id, i) FILTER (change = 'started') AS start_event_id,
arg_max(event_id, i) FILTER (change = 'ended') AS end_event_id FROM s GROUP BY ALL""")
def k7_lifecycle(spark, d):
    return K.lifecycle(changes(spark, d))


@_c.query("SELECT version_id, chunk_id FROM (SELECT DISTINCT manuscript_version_id AS version_id, id AS chunk_id FROM chunks) ANTI JOIN (SELECT DISTINCT manuscript_version_id AS version_id, chunk_id FROM entity_mentions) USING (version_id, chunk_id)")
def k9_lost_coverage(spark, d):
    prior = table(spark, d, "chunks").select(F.col("manuscript_version_id").alias("version_id"), F.col("id").alias("chunk_id")).distinct()
    return K.lost_coverage(prior, table(spark, d, "entity_mentions").select(F.col("manuscript_version_id").alias("version_id"), "chunk_id").distinct())


@_c.query(f"""WITH {_PAIRS}, done AS (SELECT DISTINCT manuscript_version_id AS version_id, id, text IS NOT NULL AS ok FROM chunks)
SELECT version_id, count(*) FILTER (ok)::BIGINT AS completed, count(*) FILTER (NOT ok)::BIGINT AS failed, coalesce(any_value(facts), 0)::BIGINT AS facts
FROM done LEFT JOIN (SELECT version_id, count(*) AS facts FROM checked WHERE reason IS NULL GROUP BY 1) USING (version_id) GROUP BY version_id""")
def q7_memory_status(spark, d):
    done = table(spark, d, "chunks").select(F.col("manuscript_version_id").alias("version_id"), "id", F.col("text").isNotNull().alias("ok")).distinct()
    counts = done.groupBy("version_id").agg(F.count_if("ok").alias("completed"), F.count_if(~F.col("ok")).alias("failed"))
    n = checked(spark, d).where("reason is null").groupBy("version_id").agg(F.count(F.lit(1)).alias("facts"))
    return counts.join(n, "version_id", "left").withColumn("facts", F.coalesce("facts", F.lit(0)))


@_c.query(f"""WITH {_PAIRS}, {_CH} SELECT version_id, subject, predicate, object, fact_type, n::BIGINT AS evidence, coalesce(nullif(title, ''), 'Chapter ' || ordinal) AS source FROM (
  SELECT c.version_id, subject, predicate, object, fact_type, count(*) AS n, arg_min(p.chapter_id, struct_pack(a := chunk_ordinal, b := c.chunk_id, c := position)) AS chapter_id
  FROM checked c JOIN place p USING (chunk_id) WHERE reason IS NULL GROUP BY 1, 2, 3, 4, 5) JOIN (SELECT chapter_id, title, ordinal FROM ch) USING (chapter_id)""")
def q8_facts(spark, d):
    rows = checked(spark, d).where("reason is null").join(places(spark, d), "chunk_id")
    first = F.min_by("chapter_id", F.struct("chunk_ordinal", "chunk_id", "position"))
    whole = rows.groupBy("version_id", "subject", "predicate", "object", "fact_type").agg(F.count(F.lit(1)).alias("evidence"), first.alias("chapter_id"))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Chapter "), F.col("ordinal").cast("string")))
    return whole.join(chapters(spark, d).select("chapter_id", title.alias("source")), "chapter_id").drop("chapter_id")


@_c.query(f"""WITH {_PAIRS}, {_CH} SELECT pr.version_id, pr.id AS event_id, array_to_string(list_sort([s1, s2]), ', ') AS participants, CASE WHEN t1 IN ('location', 'gpe', 'facility') THEN s1 END AS location, 'Chapter ' || ordinal AS chapter,
  row_number() OVER (PARTITION BY pr.version_id ORDER BY ordinal NULLS LAST, o NULLS LAST, pr.id)::INTEGER AS place FROM pr JOIN place p USING (chunk_id) JOIN ch ON ch.chapter_id = p.chapter_id""")
def q9_events(spark, d):
    rows = pairs(spark, d).join(places(spark, d), "chunk_id").join(chapters(spark, d).select("chapter_id", "ordinal"), "chapter_id")
    found = L.numbered_within(rows, ["version_id"], [F.col("ordinal").asc_nulls_last(), F.col("o").asc_nulls_last(), "id"], name="place")
    return found.select("version_id", F.col("id").alias("event_id"), F.array_join(F.array_sort(F.array("s1", "s2")), ", ").alias("participants"),
                        F.when(F.col("t1").isin("location", "gpe", "facility"), F.col("s1")).alias("location"), F.concat(F.lit("Chapter "), F.col("ordinal").cast("string")).alias("chapter"),
                        (F.col("place") + 1).cast("int").alias("place"))


_EVENTS = f"""{_PAIRS}, {_CH}, ev AS (SELECT pr.version_id, pr.id AS event_id, [s1, s2] AS participants, CASE WHEN t1 IN ('location', 'gpe', 'facility') THEN [s1] ELSE [] END AS locations, CASE WHEN o % 6 = 0 THEN 'movement' ELSE 'other_major' END AS event_type, ordinal, o
  FROM pr JOIN place p USING (chunk_id) JOIN ch ON ch.chapter_id = p.chapter_id),
wanted AS (SELECT version_id, min(s2) AS who, min(s1) FILTER (t1 IN ('location', 'gpe', 'facility')) AS spot FROM pr GROUP BY 1)"""


def _events(spark, d):
    """Events with the participant and the place that their version's reader asks for."""
    place = F.col("t1").isin("location", "gpe", "facility")
    p = pairs(spark, d)
    wanted = p.groupBy("version_id").agg(F.min("s2").alias("who"), F.min(F.when(place, F.col("s1"))).alias("spot"))
    rows = p.join(places(spark, d), "chunk_id").join(chapters(spark, d).select("chapter_id", "ordinal"), "chapter_id").join(wanted, "version_id")
    locations = F.when(place, F.array("s1")).otherwise(F.array().cast("array<string>"))
    kind = F.when(F.col("o") % 6 == 0, "movement").otherwise("other_major")
    return rows.select("version_id", F.col("id").alias("event_id"), F.array("s1", "s2").alias("participants"), locations.alias("locations"), kind.alias("event_type"), "ordinal", "o", "who", "spot")


@_c.query(f"WITH {_EVENTS} SELECT version_id, event_id FROM ev JOIN wanted USING (version_id) WHERE list_contains(participants, who)")
def f13_array_membership(spark, d):
    return L.timeline(_events(spark, d), participant=F.col("who")).select("version_id", "event_id")


@_c.query(f"""WITH {_EVENTS} SELECT version_id, event_id, row_number() OVER (PARTITION BY version_id ORDER BY ordinal NULLS LAST, o NULLS LAST, event_id)::INTEGER AS place
FROM ev JOIN wanted USING (version_id) WHERE list_contains(locations, spot) AND event_type = 'other_major'""")
def q12_timeline(spark, d):
    found = L.timeline(_events(spark, d), location=F.col("spot"), kind=F.lit("other_major")).select("version_id", "event_id", "ordinal", "o")
    placed = L.numbered_within(found, ["version_id"], [F.col("ordinal").asc_nulls_last(), F.col("o").asc_nulls_last(), "event_id"], name="place")
    return placed.select("version_id", "event_id", (F.col("place") + 1).cast("int").alias("place"))


@_c.query(f"""WITH {_PAIRS}, e AS (SELECT id, arg_max(coalesce(canonical_name, 'Unknown entity'), updated_at) AS name FROM entities GROUP BY id)
SELECT pr.id, a.name || ' — works for — ' || b.name AS name FROM pr JOIN e a ON a.id = e1 JOIN e b ON b.id = e2 WHERE e1 <> e2""")
def q10_relationships(spark, d):
    e = table(spark, d, "entities").groupBy("id").agg(F.max_by(F.coalesce("canonical_name", F.lit("Unknown entity")), "updated_at").alias("name"))
    rows = pairs(spark, d).where("e1 <> e2").join(e.toDF("e1", "a"), "e1").join(e.toDF("e2", "b"), "e2")
    return rows.select("id", F.concat_ws(" — ", "a", F.replace(F.lit("works_for"), F.lit("_"), F.lit(" ")), "b").alias("name"))
