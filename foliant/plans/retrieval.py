"""R, T1-T2, U1, U3-U4, J21, A5, A13: retrieval over the test tables.

The queries of a search are the titles of all documents whose id is divisible by 20, against all documents; those of
a vector search all vectors whose id is divisible by 20, against all vectors.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import retrieval as R
from foliant.operators.models import Letters
from foliant.plans.registry import Catalogue
from foliant.refs import normal_word
from foliant.tables import table

_c = Catalogue()
queries, oracle_sql = _c.queries, _c.oracle_sql

_BM25 = r"""
wanted AS (SELECT DISTINCT title AS query, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')) AS term FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL),
tokens AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
totals AS (SELECT count(*) AS n, avg(coalesce(len(w), 0)) AS avgdl FROM tokens),
postings AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tokens) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (SELECT query, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM postings JOIN freq USING (term) JOIN wanted USING (term), totals GROUP BY query, doc_id),
best AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored QUALIFY rank <= 30),
bm25 AS (SELECT d.doc_id AS query_id, b.doc_id AS id, score, rank FROM documents d JOIN best b ON b.query = d.title WHERE d.doc_id % 20 = 0)
"""
_OVERLAP = r"""
asked AS (SELECT DISTINCT title AS query, list_distinct(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')) AS w FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL),
terms AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS term FROM documents),
shared AS (SELECT query, doc_id, count(*)::DOUBLE AS score FROM (SELECT query, unnest(w) AS term FROM asked) JOIN terms USING (term) GROUP BY ALL),
by_overlap AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INTEGER AS rank FROM shared QUALIFY rank <= 30),
overlap AS (SELECT d.doc_id AS query_id, b.doc_id AS id, score, rank FROM documents d JOIN by_overlap b ON b.query = d.title WHERE d.doc_id % 20 = 0)
"""
_KNN = """
near AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 5) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM near QUALIFY rank <= 30)
"""
_RELEVANT = "rel AS (SELECT q.vec_id AS query_id, v.vec_id AS id FROM embeddings q JOIN embeddings v ON v.label = q.label AND v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)"
_FUSED = """
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM bm25 UNION ALL SELECT query_id, id, rank FROM overlap) GROUP BY ALL),
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM fused QUALIFY rank <= 30)
"""


def _documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _queries(spark, d):
    return table(spark, d, "documents").where("doc_id % 20 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


def _bm25(spark, d):
    return R.bm25(_documents(spark, d), _queries(spark, d))


def _overlap(spark, d):
    asked = _queries(spark, d).select("query").distinct().select("query", F.explode(F.array_distinct(R.words("query"))).alias("term"))
    terms = _documents(spark, d).select("id", F.explode(F.array_distinct(R.words("text"))).alias("term"))
    shared = terms.join(asked, "term").groupBy("query", "id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    best = R.ranked(shared, 30, ("query",))
    return _queries(spark, d).join(best, "query").select("query_id", "id", "score", "rank")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _knn(spark, d):
    v = _vectors(spark, d)
    return R.nearest(v, v.where("id % 20 = 0"))


def _relevant(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return q.join(e.withColumnRenamed("vec_id", "id"), "label").where("id <> query_id").select("query_id", "id")


@_c.query(f"WITH {_BM25} SELECT query_id, id, score, rank FROM bm25 WHERE rank <= 10")
def r1_bm25_topk(spark, d):
    return R.bm25(_documents(spark, d), _queries(spark, d), 10)


@_c.query(f"""WITH {_BM25.replace("FROM documents", "FROM docs").replace("documents d", "docs d")} SELECT query_id, id, score, rank FROM bm25""".replace(
    "WITH", "WITH docs AS (SELECT * FROM documents WHERE lower(trim(source)) = 'lanternbox_drafts'),", 1))
def f1_scoped_bm25(spark, d):
    scope = table(spark, d, "documents").where(normal_word("source") == "lanternbox_drafts")
    asked = scope.where("doc_id % 20 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))
    return R.bm25(scope.select(F.col("doc_id").alias("id"), "text"), asked)


@_c.query(f"WITH {_KNN} SELECT query_id, id, score, rank FROM knn")
def r2_knn_topk(spark, d):
    return _knn(spark, d)


@_c.query(f"WITH {_BM25}, {_OVERLAP}, {_FUSED} SELECT query_id, id, score, rank FROM rrf")
def r3_rrf(spark, d):
    return R.fuse([_bm25(spark, d), _overlap(spark, d)])


def _hybrid_sql(docs: str, asked: str) -> str:
    """Both rankings of ``docs`` (doc_id, text, scope) for ``asked`` (query_id, query, scope), fused and reranked."""
    letters = lambda c: "[" + ", ".join(f"length({c}) - length(replace({c}, '{chr(97 + i)}', ''))" for i in range(26)) + "]"
    unit = "list_transform(x, lambda y: (y / sqrt(list_sum(list_transform(x, lambda z: z * z))))::FLOAT::DOUBLE)"
    return rf"""
asked AS ({asked}), docs AS ({docs}),
wanted AS (SELECT DISTINCT query, scope, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+')) AS term FROM asked),
tokens AS (SELECT doc_id, scope, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM docs),
totals AS (SELECT count(*) AS n, avg(coalesce(len(w), 0)) AS avgdl FROM tokens),
postings AS (SELECT term, doc_id, scope, dl, count(*) AS tf FROM (SELECT doc_id, scope, len(w) AS dl, unnest(w) AS term FROM tokens) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (SELECT query, scope, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM postings JOIN freq USING (term) JOIN wanted USING (term, scope), totals GROUP BY query, scope, doc_id),
best AS (SELECT query, scope, doc_id, row_number() OVER (PARTITION BY query, scope ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 30),
one AS (SELECT query_id, doc_id AS id, rank FROM asked JOIN best USING (query, scope)),
dv AS (SELECT doc_id, scope, {unit} AS v FROM (SELECT doc_id, scope, {letters('text')} AS x FROM docs WHERE text IS NOT NULL) WHERE list_sum(x) > 0),
qv AS (SELECT query_id, scope, {unit} AS v FROM (SELECT query_id, scope, {letters('query')} AS x FROM asked) WHERE list_sum(x) > 0),
two AS (SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(qv.v, dv.v), 5) DESC, doc_id) AS rank FROM qv JOIN dv USING (scope) QUALIFY rank <= 30),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (FROM one UNION ALL FROM two) GROUP BY ALL),
hybrid AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM fused QUALIFY rank <= 30),
share AS (SELECT query_id, id, CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END AS score FROM (SELECT query_id, id, list_distinct(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]+')) AS q,
  list_distinct(coalesce(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), [])) AS t FROM hybrid JOIN asked USING (query_id) JOIN docs ON doc_id = id)),
reranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM share QUALIFY rank <= 10)
"""


_WHOLE = _hybrid_sql("SELECT doc_id, text, '' AS scope FROM documents", "SELECT doc_id AS query_id, title AS query, '' AS scope FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL")
_OF_PROJECTS = _hybrid_sql(
    "SELECT doc_id, text, lower(trim(source)) AS scope FROM documents WHERE lower(trim(source)) <> 'thimble_club' AND lower(trim(source)) IN (SELECT scope FROM asked)",
    "SELECT doc_id AS query_id, trim(title) AS query, lower(trim(source)) AS scope FROM documents WHERE doc_id % 20 = 0 AND length(trim(title)) BETWEEN 1 AND 500 AND lower(trim(source)) NOT IN ('thimble_club', '')",
)


def _hybrid(spark, d):
    return R.hybrid(_documents(spark, d), _queries(spark, d), make=Letters, dimensions=26)


@_c.query(f"WITH {_WHOLE} SELECT query_id, id, score, rank FROM hybrid")
def r4_hybrid(spark, d):
    return _hybrid(spark, d)


@_c.query(f"WITH {_WHOLE} SELECT query_id, id, score, rank FROM reranked")
def r5_reranked(spark, d):
    return R.reranked(_hybrid(spark, d), _documents(spark, d), _queries(spark, d), 10)


def _search(spark, d, rerank):
    docs = table(spark, d, "documents").withColumn("project_id", normal_word("source")).withColumn("version_id", F.col("project_id"))
    chunks = docs.select(F.col("doc_id").alias("id"), "project_id", "version_id", "text")
    projects = docs.select("project_id", "version_id", F.when(F.col("project_id") == "thimble_club", "processing").otherwise("ready").alias("status")).where("project_id is not null").distinct()
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "project_id", F.col("title").alias("query"))
    return R.search(chunks, projects, asked, rerank=rerank, make=Letters, dimensions=26)


@_c.query(f"WITH {_OF_PROJECTS} SELECT query_id, id, score, rank FROM reranked")
def r6_search(spark, d):
    return _search(spark, d, True)


@_c.query(f"WITH {_OF_PROJECTS} SELECT query_id, id, score, rank FROM hybrid WHERE rank <= 10")
def r6_search_unreranked(spark, d):
    return _search(spark, d, False)


def _labelled_knn(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return R.nearest(e, e.where("id % 20 = 0"), scope="label")


@_c.query("""SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 5) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id)::INTEGER AS rank FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 20 = 0 QUALIFY rank <= 30""")
def r2_scoped_knn(spark, d):
    return _labelled_knn(spark, d)


@_c.query(f"WITH {_KNN}, {_RELEVANT} SELECT query_id, min(CASE WHEN r.id IS NOT NULL THEN rank END) AS rank FROM (SELECT DISTINCT query_id FROM rel) LEFT JOIN knn USING (query_id) LEFT JOIN rel r USING (query_id, id) GROUP BY query_id")
def j21_first_relevant(spark, d):
    rel = _relevant(spark, d)
    return R.first_relevant_rank(_knn(spark, d), rel, rel.select("query_id").distinct())


@_c.query(f"""WITH {_KNN}, {_RELEVANT}, sizes AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
per AS (SELECT s.query_id, n, coalesce(count(k.id) FILTER (rank <= 1), 0) AS h1, coalesce(count(k.id) FILTER (rank <= 5), 0) AS h5, coalesce(count(k.id) FILTER (rank <= 10), 0) AS h10,
  coalesce(count(k.id) FILTER (rank <= 20), 0) AS h20, count(k.id) AS h30, min(rank) AS r
  FROM sizes s LEFT JOIN (SELECT knn.* FROM knn SEMI JOIN rel USING (query_id, id)) k USING (query_id) GROUP BY ALL)
SELECT count(*) AS query_count, round(avg(h1 / n), 6) AS recall_at_1, round(avg(h5 / n), 6) AS recall_at_5, round(avg(h10 / n), 6) AS recall_at_10, round(avg(h20 / n), 6) AS recall_at_20,
  round(avg(h30 / n), 6) AS recall_at_30, round(avg(CASE WHEN r <= 10 THEN 1.0 / r ELSE 0 END), 6) AS mrr_at_10 FROM per""")
def a5_recall_mrr(spark, d):
    return R.retrieval_metrics(_knn(spark, d), _relevant(spark, d))


@_c.query(f"""WITH {_BM25}, {_OVERLAP},
one AS (SELECT query_id, min(rank) FILTER (id = query_id) AS rank FROM bm25 GROUP BY 1), two AS (SELECT query_id, min(rank) FILTER (id = query_id) AS rank FROM overlap GROUP BY 1)
SELECT query_id, one.rank AS before_rank, two.rank AS after_rank, (coalesce(one.rank, 31) - coalesce(two.rank, 31))::INTEGER AS gain,
  CASE WHEN coalesce(one.rank, 31) > coalesce(two.rank, 31) THEN 'improved' WHEN coalesce(one.rank, 31) < coalesce(two.rank, 31) THEN 'regressed' ELSE 'same' END AS outcome
FROM one FULL JOIN two USING (query_id)""")
def a13_rank_changes(spark, d):
    own = lambda r: r.groupBy("query_id").agg(F.min(F.when(F.col("id") == F.col("query_id"), F.col("rank"))).alias("rank"))
    return R.rank_changes(own(_bm25(spark, d)), own(_overlap(spark, d)))


@_c.query(f"WITH {_BM25}, {_OVERLAP} SELECT query_id, count(*)::BIGINT AS shared FROM bm25 JOIN overlap USING (query_id, id) WHERE bm25.rank <= 10 AND overlap.rank <= 10 GROUP BY 1")
def u1_overlap(spark, d):
    lists = lambda r: r.where("rank <= 10").groupBy("query_id").agg(F.collect_set("id").alias("ids"))
    both = lists(_bm25(spark, d)).join(lists(_overlap(spark, d)).withColumnRenamed("ids", "other"), "query_id")
    return both.select("query_id", F.size(F.array_intersect("ids", "other")).cast("long").alias("shared")).where("shared > 0")


@_c.query(f"WITH {_BM25}, {_OVERLAP} SELECT DISTINCT query_id, id FROM (SELECT query_id, id FROM bm25 UNION SELECT query_id, id FROM overlap)")
def u3_union_of_rankings(spark, d):
    return _bm25(spark, d).select("query_id", "id").unionByName(_overlap(spark, d).select("query_id", "id")).distinct()


@_c.query(f"""WITH {_BM25}, {_OVERLAP}, a AS (SELECT query_id, list_sort(list(id)) AS ids FROM bm25 GROUP BY 1), b AS (SELECT query_id, list_sort(list(id)) AS ids FROM overlap GROUP BY 1)
SELECT query_id, coalesce(a.ids = b.ids, false) AS same_members FROM a FULL JOIN b USING (query_id)""")
def u4_same_members(spark, d):
    lists = lambda r: r.groupBy("query_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    both = lists(_bm25(spark, d)).join(lists(_overlap(spark, d)).withColumnRenamed("ids", "other"), "query_id", "full_outer")
    return both.select("query_id", F.coalesce(F.col("ids") == F.col("other"), F.lit(False)).alias("same_members"))


@_c.query("SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INTEGER AS rank FROM embeddings")
def w1_rank(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("id")))


@_c.query("SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def t1_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("score"))
    return e.orderBy(F.col("score").desc(), "vec_id").limit(10)


@_c.query(f"WITH {_BM25}, {_OVERLAP}, {_FUSED} SELECT query_id, id, score, rank FROM rrf WHERE rank <= 10")
def t2_fused_topk(spark, d):
    return R.fuse([_bm25(spark, d), _overlap(spark, d)], 10)


@_c.query("SELECT vec_id, label FROM embeddings WHERE label = 3")
def f9_pruned_scan(spark, d):
    return table(spark, d, "embeddings").drop("embedding").where("label = 3")
