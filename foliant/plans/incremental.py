"""I and V2-V6: incremental semantics, and experiments in shards, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import experiments as P
from foliant.operators import relational as L
from foliant.operators import retrieval as R
from foliant.operators.models import Letters, embed_column
from foliant.operators.publish import current_coverage, newest_run, publish_rebuild, published_facts
from foliant.plans.registry import Catalogue
from foliant.plans.retrieval import _WHOLE, _documents, _queries
from foliant.shared import Workspace
from foliant.sources.sinks import fingerprint
from foliant.streaming.incremental import accepted, ingest, new_rows, of_current_attempt
from foliant.tables import table

_c = Catalogue()
queries, oracle_sql = _c.queries, _c.oracle_sql


@_c.query("SELECT event_id, user_id, event_type FROM events")
def i1_bounded_slices(spark, d):
    root = Workspace(spark, "i1").root
    schema = table(spark, d, "events").schema
    ingest(spark, d, schema, f"{root}/target", f"{root}/progress", ["event_id"], 1, lambda df: df.select("event_id", "user_id", "event_type"), "events.parquet")
    return spark.read.parquet(f"{root}/target").select("event_id", "user_id", "event_type")


@_c.query("SELECT id, count(*) > 1 AS redelivered FROM entity_mentions WHERE id NOT IN (SELECT left_mention_id FROM entity_resolution_candidates WHERE left_mention_id IS NOT NULL) GROUP BY id")
def i2_redelivery(spark, d):
    rows = table(spark, d, "entity_mentions").select("id")
    stored = table(spark, d, "entity_resolution_candidates").where("left_mention_id is not null").select(F.col("left_mention_id").alias("id"))
    times = rows.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("redelivered"))
    return new_rows(rows, stored, ["id"]).join(times, "id")


@_c.query("""WITH n AS (SELECT project_id, max(version_number) AS v FROM manuscript_versions WHERE status IN ('ready', 'archived') GROUP BY 1), p AS (SELECT project_id, max(version_number) AS now FROM manuscript_versions WHERE status = 'archived' GROUP BY 1)
SELECT project_id, v AS version_number FROM n LEFT JOIN p USING (project_id) WHERE now IS NULL OR v > now""")
def i3_supersession(spark, d):
    rows = table(spark, d, "manuscript_versions").where(F.col("status").isin("ready", "archived")).select("project_id", "version_number")
    published = table(spark, d, "manuscript_versions").where("status = 'archived'").groupBy("project_id").agg(F.max("version_number").alias("version_number"))
    return accepted(rows, published, "project_id", "version_number")


@_c.query("WITH j AS (SELECT user_id, max(event_id % 3) AS attempt FROM events GROUP BY 1) SELECT event_id FROM events JOIN j ON j.user_id = events.user_id AND event_id % 3 = attempt")
def i4_current_attempt(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("job_id"), (F.col("event_id") % 3).alias("attempt"))
    return of_current_attempt(e, e.groupBy("job_id").agg(F.max("attempt").alias("attempt"))).select("event_id")



#: Two runs of a rebuild: the first covers every chunk, the second only those with a text; where a version has a merged vehicle its state is no longer what it was.
_RUNS = """
chunk AS (SELECT DISTINCT manuscript_version_id AS version_id, id AS chunk_id FROM chunks),
named AS (SELECT DISTINCT manuscript_version_id AS version_id, id AS chunk_id FROM chunks WHERE text IS NOT NULL),
began AS (SELECT version_id, count(DISTINCT e.id) AS state FROM (SELECT DISTINCT version_id FROM chunk) LEFT JOIN entities e ON e.manuscript_version_id = version_id AND NOT (e.status = 'merged' AND e.entity_type = 'vehicle') GROUP BY 1),
now AS (SELECT manuscript_version_id AS version_id, count(DISTINCT id) AS state FROM entities GROUP BY 1),
lost AS (SELECT DISTINCT version_id FROM (SELECT * FROM chunk EXCEPT SELECT * FROM named)),
outcome AS (SELECT b.version_id, CASE WHEN b.state IS DISTINCT FROM n.state THEN 'stale' WHEN b.version_id IN (FROM lost) THEN 'lost_coverage' ELSE 'publish' END AS outcome FROM began b LEFT JOIN now n USING (version_id))
"""


def _rebuilt(spark, d):
    """The folder after both runs, and what was said about the second."""
    folder = Workspace(spark, "rebuild").root
    chunk = table(spark, d, "chunks").select(F.col("manuscript_version_id").alias("version_id"), F.col("id").alias("chunk_id")).distinct()
    named = table(spark, d, "chunks").where("text is not null").select(F.col("manuscript_version_id").alias("version_id"), F.col("id").alias("chunk_id")).distinct()
    e = table(spark, d, "entities").select(F.col("manuscript_version_id").alias("version_id"), "id", "status", "entity_type")
    state = lambda rows: rows.groupBy("version_id").agg(F.countDistinct("id").alias("state"))
    began = chunk.select("version_id").distinct().join(state(e.where("not (status = 'merged' and entity_type = 'vehicle')")), "version_id", "left").withColumn("state", F.coalesce("state", F.lit(0)))
    fact = lambda c: c.select("version_id", F.concat(F.lit("about "), "chunk_id").alias("fact"))
    publish_rebuild(folder, 1, fact(chunk), chunk, began, began)
    return folder, publish_rebuild(folder, 2, fact(named), named, began, state(e))


@_c.query(f"WITH {_RUNS} SELECT version_id, outcome FROM outcome")
def i5_state(spark, d):
    return _rebuilt(spark, d)[1]


@_c.query(f"WITH {_RUNS}, last AS (SELECT version_id, CASE WHEN outcome = 'publish' THEN 2 ELSE 1 END AS run_id FROM outcome) SELECT version_id, run_id::INTEGER AS run_id, count(chunk_id)::BIGINT AS covered FROM last JOIN (SELECT 1 AS run_id, * FROM chunk UNION ALL SELECT 2, * FROM named) USING (version_id, run_id) GROUP BY 1, 2")
def i6_coverage(spark, d):
    folder, _ = _rebuilt(spark, d)
    return current_coverage(spark, folder).groupBy("version_id").agg(F.count("chunk_id").alias("covered")).join(newest_run(spark, folder), "version_id")


@_c.query(f"""WITH {_RUNS}, fact AS (SELECT version_id, 1 AS run_id FROM chunk UNION ALL SELECT version_id, 2 FROM named JOIN outcome USING (version_id) WHERE outcome = 'publish')
SELECT version_id, run_id::INTEGER AS run_id, CASE WHEN run_id = max(run_id) OVER (PARTITION BY version_id) THEN 'active' ELSE 'superseded' END AS status, count(*)::BIGINT AS n FROM fact GROUP BY version_id, run_id""")
def k9_published(spark, d):
    return published_facts(spark, _rebuilt(spark, d)[0]).groupBy("version_id", "run_id", "status").agg(F.count(F.lit(1)).alias("n"))


# --- experiments: every twentieth document's title asks for the documents of the same title -------------------------

_REL = "rel AS (SELECT q.doc_id AS query_id, v.doc_id AS id FROM documents q JOIN documents v ON v.title = q.title WHERE q.doc_id % 20 = 0 AND q.title IS NOT NULL), asked_ids AS (SELECT doc_id AS query_id FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL)"
_SPLIT = "CASE WHEN query_id % 40 = 0 THEN 'dev' ELSE 'test' END"
_ALL = f"{_WHOLE}, {_REL}, every AS (SELECT 'bm25' AS strategy, query_id, id, rank FROM one UNION ALL SELECT 'vector', query_id, id, rank FROM two UNION ALL SELECT 'hybrid', query_id, id, rank FROM hybrid UNION ALL SELECT 'hybrid_reranked', query_id, id, rank FROM reranked30)".replace(
    "reranked AS (", "reranked30 AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM share),\nreranked AS ("
)


def _asked(spark, d):
    return _queries(spark, d).select("query_id")


def _own_relevant(spark, d):
    named = table(spark, d, "documents").where("title is not null").select(F.col("doc_id").alias("id"), "title")
    return _queries(spark, d).join(named, F.col("query") == F.col("title")).select("query_id", "id")


def _strategies(spark, d):
    docs, asked = _documents(spark, d), _queries(spark, d)
    space = Workspace(spark, "strategies")
    first, second = space.keep(R.bm25(docs, asked)), space.keep(_letter_knn(spark, d))
    fused = space.keep(R.fuse([first, second]))
    return {"bm25": first, "vector": second, "hybrid": fused, "hybrid_reranked": space.keep(R.reranked(fused, docs, asked, 30))}


def _letter_knn(spark, d):
    vector = lambda df, key, text: df.select(F.col(key).alias("id"), embed_column(F.col(text), Letters).alias("vector"))
    return R.nearest(vector(_documents(spark, d), "id", "text"), vector(_queries(spark, d), "query_id", "query"), dimensions=26)


@_c.query(f"WITH {_ALL} SELECT a.query_id, min(rank) FILTER (rel.id IS NOT NULL) AS rank, count(rel.id)::BIGINT AS found FROM asked_ids a LEFT JOIN one USING (query_id) LEFT JOIN rel ON rel.query_id = a.query_id AND rel.id = one.id GROUP BY 1")
def v2_evaluated(spark, d):
    return P.evaluated(R.bm25(_documents(spark, d), _queries(spark, d)), _own_relevant(spark, d), _asked(spark, d))


_PER = f"""sizes AS (SELECT query_id, {_SPLIT} AS split, count(*) AS n FROM rel GROUP BY 1, 2), named AS (SELECT DISTINCT strategy FROM every),
hit AS (SELECT strategy, query_id, rank FROM every SEMI JOIN rel USING (query_id, id)),
per AS (SELECT strategy, split, query_id, n, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, count(*) FILTER (rank <= 20) AS h20, count(rank) AS h30, min(rank) AS r
  FROM sizes CROSS JOIN named LEFT JOIN hit USING (strategy, query_id) GROUP BY ALL)"""
_REPORT = """SELECT strategy, split, count(*) AS query_count, round(avg(h1 / n), 6) AS recall_at_1, round(avg(h5 / n), 6) AS recall_at_5, round(avg(h10 / n), 6) AS recall_at_10, round(avg(h20 / n), 6) AS recall_at_20,
round(avg(h30 / n), 6) AS recall_at_30, round(avg(CASE WHEN r <= 10 THEN 1.0 / r ELSE 0 END), 6) AS mrr_at_10 FROM per"""


def _splits(spark, d):
    return _asked(spark, d).select("query_id", F.when(F.col("query_id") % 40 == 0, "dev").otherwise("test").alias("split"))


@_c.query(f"WITH {_ALL}, {_PER} {_REPORT} WHERE strategy = 'bm25' GROUP BY strategy, split")
def v3_report_per_split(spark, d):
    return P.strategy_report({"bm25": R.bm25(_documents(spark, d), _queries(spark, d))}, _own_relevant(spark, d), _splits(spark, d))


@_c.query(f"WITH {_ALL}, {_PER} {_REPORT} GROUP BY strategy, split")
def v6_strategies(spark, d):
    return P.strategy_report(_strategies(spark, d), _own_relevant(spark, d), _splits(spark, d))


_SHARDED = f"{_WHOLE}, {_REL}, s AS (SELECT query_id, (row_number() OVER (ORDER BY query_id) - 1) % 3 AS shard FROM asked_ids)"


def _sharded(spark, d, folder):
    docs, asked = _documents(spark, d), _queries(spark, d)
    rank = lambda mine: R.reranked(R.hybrid(docs, mine, make=Letters, dimensions=26), docs, mine, 10)
    return P.in_shards(asked, rank, folder, {"documents": fingerprint(docs, "id", "text"), "strategy": "hybrid_reranked", "window": R.RANK_WINDOW, "constant": R.RANK_CONSTANT}, 3)


@_c.query(f"WITH {_SHARDED} SELECT shard::INTEGER AS shard, query_id, id, rank FROM reranked JOIN s USING (query_id)")
def v4_shards(spark, d):
    """The second pass finds all shards complete and reads them."""
    folder = Workspace(spark, "v4").root
    _sharded(spark, d, folder)
    return _sharded(spark, d, folder).select("shard", "query_id", "id", "rank")


@_c.query("SELECT count(*)::BIGINT AS expected, count(*)::BIGINT AS covered, 0::BIGINT AS missing, 0::BIGINT AS unexpected, 0::BIGINT AS repeated FROM entity_resolution_v1")
def u7_shard_coverage(spark, d):
    every = table(spark, d, "entity_resolution_v1").select(F.col("id").alias("query_id"))
    shards = [L.shard(every, 4, i, "query_id").select("query_id", F.lit(i).alias("shard")) for i in range(4)]
    return P.shard_coverage(every, shards[0].unionByName(shards[1]).unionByName(shards[2]).unionByName(shards[3]))


_PAIRED = f"""{_ALL}, ranks AS (SELECT a.query_id, min(h.rank) AS before_rank, min(r.rank) AS after_rank FROM asked_ids a LEFT JOIN (SELECT hybrid.* FROM hybrid SEMI JOIN rel USING (query_id, id)) h USING (query_id)
  LEFT JOIN (SELECT reranked30.* FROM reranked30 SEMI JOIN rel USING (query_id, id)) r USING (query_id) GROUP BY 1),
pair AS (SELECT *, coalesce(before_rank, 31) - coalesce(after_rank, 31) AS gain FROM ranks),
judged AS (SELECT *, CASE WHEN gain > 0 THEN 'improved' WHEN gain < 0 THEN 'regressed' ELSE 'same' END AS outcome FROM pair)"""


@_c.query(f"""WITH {_PAIRED} SELECT outcome, count(*)::BIGINT AS n, count(*) FILTER (before_rank IS NULL)::BIGINT AS pool_misses, 0::BIGINT AS invalid, array_to_string(list_sort(list(query_id))[1:3], ',') AS examples FROM judged GROUP BY 1""")
def v5_paired_comparison(spark, d):
    s = _strategies(spark, d)
    pairs = P.paired(s["hybrid"], s["hybrid_reranked"], _own_relevant(spark, d), _asked(spark, d))
    return P.paired_report(pairs).withColumn("examples", F.array_join("examples", ","))


# --- registries and manifests ----------------------------------------------------------------------------------------

MODELS = P.Registry("model", {"letters": {"dimensions": 26, "make": "Letters"}, "hashed_words": {"dimensions": 64, "make": "HashedWords"}})
SUITES = P.Registry("suite", {"resolution": {"table": "entity_resolution_v1", "shards": 4}, "extraction": {"table": "entity_extraction_model_eval_v3", "shards": 2}})


@_c.query("""SELECT * FROM (VALUES ('model', 'letters', '{"dimensions":26,"make":"Letters"}'), ('model', 'hashed_words', '{"dimensions":64,"make":"HashedWords"}'),
('suite', 'resolution', '{"shards":4,"table":"entity_resolution_v1"}'), ('suite', 'extraction', '{"shards":2,"table":"entity_extraction_model_eval_v3"}')) v(kind, name, settings)""")
def s17_registries(spark, d):
    return MODELS.table(spark).unionByName(SUITES.table(spark))


@_c.query("""SELECT * FROM (VALUES ('documents', 'same', (SELECT count(*) FROM documents), (SELECT count(*) FROM documents)), ('entity_resolution_v1', 'changed', (SELECT count(*) FROM entity_resolution_v1), (SELECT count(*) FROM entity_resolution_v1)),
('events', 'added', NULL, (SELECT count(*) FROM events)), ('orders', 'removed', (SELECT count(*) FROM orders), NULL)) v(dataset, state, rows_recorded, rows_now)""")
def v12_manifest_drift(spark, d):
    """One table is as recorded though its rows come in another order, one has a letter changed, one is new and one gone."""
    t = lambda n: table(spark, d, n)
    was, now = t("entity_resolution_v1"), t("entity_resolution_v1").withColumn("text", F.when(F.col("id") == t("entity_resolution_v1").agg(F.min("id")).first()[0], F.concat("text", F.lit("."))).otherwise(F.col("text")))
    recorded = P.dataset_manifest({"documents": (t("documents"), ["doc_id", "text"]), "entity_resolution_v1": (was, ["id", "split", "text"]), "orders": (t("orders"), ["o_orderkey"])})
    seen = P.dataset_manifest({"documents": (t("documents").repartition(3), ["doc_id", "text"]), "entity_resolution_v1": (now, ["id", "split", "text"]), "events": (t("events"), ["event_id"])})
    return P.manifest_drift(spark, recorded, seen)


@_c.query("""WITH picked AS (SELECT * FROM entity_resolution_v1 WHERE split = 'dev' AND expected IS NOT NULL),
n AS (SELECT id, entity_type, expected, row_number() OVER (PARTITION BY entity_type, expected ORDER BY id) AS k FROM picked) SELECT id, entity_type, expected, (count(*) OVER (PARTITION BY entity_type, expected))::BIGINT AS of FROM n QUALIFY k <= 3""")
def v12_bootstrapped(spark, d):
    """A small suite from a labelled table: the first three of every type and label, with how many there are."""
    from pyspark.sql import Window

    rows = table(spark, d, "entity_resolution_v1").where("split = 'dev' and expected is not null").select("id", "entity_type", "expected")
    group = Window.partitionBy("entity_type", "expected")
    return rows.withColumn("of", F.count(F.lit(1)).over(group)).withColumn("k", F.row_number().over(group.orderBy("id"))).where("k <= 3").drop("k")
