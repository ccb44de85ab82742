"""Ranking documents for batches of queries: BM25, exact nearest vectors, rank fusion and reranking.

Queries come as a table, so one plan ranks them all.  Rankings are rows ``(query_id, id, score, rank)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.models import Embedder, HashedWords, Scorer, WordOverlap, embed_column, score_column
from foliant.shared import Workspace, spread

K1, B = 1.2, 0.75
RANK_CONSTANT, RANK_WINDOW = 60, 30
MOST_RESULTS = 100
BLOCK_ROWS = 2048
SENT_VALUES = 1 << 23  # numbers of query vectors that go to every task: 32 MB

WORD = r"[\p{L}\p{N}_]+"


def check_top_k(k: int, most: int = MOST_RESULTS) -> int:
    if not 1 <= k <= most:
        raise ValueError(f"the number of results must be between 1 and {most}")
    return k


def words(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def ranked(scored: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first ``k`` rows per query by falling score, then id; the rank counts from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(documents: DataFrame, queries: DataFrame, k: int = RANK_WINDOW, k1: float = K1, b: float = B, digits: int = 6, scope: str | None = None) -> DataFrame:
    """``(query_id, id, score, rank)``: the best ``k`` documents ``(id, text)`` for each query ``(query_id, query)``.

    With ``scope``, a column of both tables, a query only meets documents of its own scope.

    Any word of the query may match; statistics are those of all documents given (filter before the call for
    statistics of a scope).  idf is ln(1 + (N - df + 0.5) / (df + 0.5)).  Texts are read and cut into words once; only
    words that some query has are counted per document; equal queries are ranked once.  Null and empty texts and queries
    match nothing.
    """
    check_top_k(k)
    space = Workspace(documents.sparkSession, "bm25")
    within = [scope] if scope else []
    distinct = queries.where("query is not null").select("query", *within, words("query").alias("w")).distinct()
    wanted = distinct.select("query", *within, F.explode(F.array_distinct("w")).alias("term"))
    vocabulary = wanted.select("term").unionByName(queries.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    # a word is never empty, so the empty term stands once for every document and carries its length into the totals
    cut = spread(documents.select("id", *within, "text")).select("id", *within, F.coalesce(words("text"), F.array().cast("array<string>")).alias("w"))
    terms = cut.select("id", *within, F.size("w").alias("dl"), F.explode(F.array_append("w", F.lit(""))).alias("term"))
    postings = space.keep(terms.join(vocabulary, "term", "left_semi").groupBy("term", "id", *within, "dl").agg(F.count(F.lit(1)).alias("tf")))
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.avg("dl").alias("mean"))
    totals = frequency.where("term = ''").select(F.col("df").alias("n"), F.col("mean").alias("avgdl"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = frequency.where("term <> ''").join(F.broadcast(totals), F.lit(True)).select("term", idf.alias("idf"), "avgdl")  # one row of totals
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = postings.join(weight, "term").select("term", "id", *within, part.alias("part")).join(wanted, ["term", *within])
    scored = scores.groupBy("query", *within, "id").agg(F.round(F.sum("part"), digits).alias("score"))
    best = ranked(scored, k, ("query", *within))
    return queries.join(best, ["query", *within]).select("query_id", "id", "score", "rank")


class _Vectors:
    """Vectors of one block: ids, the scopes they belong to, and unit rows."""

    def __init__(self, ids: np.ndarray, scopes: np.ndarray, values: np.ndarray):
        self.ids, self.scopes = ids, scopes
        self.unit = values / np.linalg.norm(values, axis=1, keepdims=True)

    @staticmethod
    def of(batch: pa.RecordBatch, dimensions: int) -> _Vectors:
        flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return _Vectors(batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(1).to_pylist(), object), flat.reshape(-1, dimensions))


class _Best:
    """The ``k`` best ids per query of all blocks that were seen, ties by id."""

    def __init__(self, k: int, digits: int):
        self.k, self.digits = k, digits
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.room = 0

    def meet(self, base: _Vectors, asked: _Vectors) -> None:
        found = [(self.query, self.id, self.score)]
        for scope in set(base.scopes.tolist()) & set(asked.scopes.tolist()):
            b, q = np.flatnonzero(base.scopes == scope), np.flatnonzero(asked.scopes == scope)
            scores = np.round(asked.unit[q] @ base.unit[b].T, self.digits)
            if len(b) > self.k:
                least = np.partition(scores, len(b) - self.k, axis=1)[:, len(b) - self.k]
                row, col = np.nonzero(scores >= least[:, None])
            else:
                row, col = (x.ravel() for x in np.indices(scores.shape))
            found.append((asked.ids[q[row]], base.ids[b[col]], scores[row, col]))
        self.query, self.id, self.score = (np.concatenate(x) for x in zip(*found))
        if len(self.query) > self.room:
            self.trim()
            self.room = 2 * len(self.query) + 100_000

    def trim(self) -> None:
        order = np.lexsort((self.id, -self.score, self.query))
        query = self.query[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(query)) + 1]).astype(np.int64) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        kept = order[rank < self.k]
        self.query, self.id, self.score = self.query[kept], self.id[kept], self.score[kept]

    def batch(self) -> pa.RecordBatch:
        self.trim()
        return pa.RecordBatch.from_arrays([pa.array(self.query, pa.int64()), pa.array(self.id, pa.int64()), pa.array(self.score, pa.float64())], names=["query_id", "id", "score"])


_FOUND = "query_id bigint, id bigint, score double"


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = RANK_WINDOW, dimensions: int = 64, digits: int = 5, rows: int = BLOCK_ROWS, scope: str | None = None, sent: int = SENT_VALUES,
) -> DataFrame:
    """``(query_id, id, score, rank)``: exact nearest neighbours by cosine of ``queries`` among ``vectors``.

    Both are ``(id BIGINT, vector)``; with ``scope``, a column of both, a query only meets vectors of its own scope.
    Vectors that are null, of another length, not finite or all zero are left out.

    Queries of up to ``sent`` numbers in all go to every task, which passes over its vectors once and keeps ``k`` of them
    per query.  More are cut into tiles: every tile of queries meets every tile of vectors in one task of its own.
    """
    check_top_k(k)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = (F.size("vector") == dimensions) & finite & F.exists("vector", lambda x: x != 0)
    own = (F.col(scope).cast("string") if scope else F.lit("")).alias("scope")
    clean = lambda df: df.select("id", own, F.col("vector").cast("array<float>").alias("vector")).where(usable)
    base, asked = clean(vectors), clean(queries)
    most = max(sent // dimensions, 1)
    few = asked.limit(most + 1).toArrow()
    if few.num_rows <= most:
        shared = vectors.sparkSession.sparkContext.broadcast(_packed(few))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked_for = [_Vectors.of(b, dimensions) for b in _unpacked(shared.value)]
            best = _Best(k, digits)
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    block = _Vectors.of(batch.slice(at, rows), dimensions)
                    for q in asked_for:
                        best.meet(block, q)
            yield best.batch()

        return ranked(spread(base).mapInArrow(scan, _FOUND), k)

    base_tiles = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * dimensions / sent)).alias("n")
    sides = base.agg(base_tiles).join(asked.agg(base_tiles).toDF("m"), F.lit(True)).first()  # two numbers
    tile = lambda df, n: df.withColumn("__tile", F.pmod(F.xxhash64("id"), F.lit(n)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("other")
    left = tile(base, sides.n).select("*", F.lit(True).alias("held"), every(sides.m)).select("__tile", "other", "held", "id", "scope", "vector")
    right = tile(asked, sides.m).select("*", F.lit(False).alias("held"), every(sides.n)).select(F.col("other").alias("__tile"), F.col("__tile").alias("other"), "held", "id", "scope", "vector")
    both = left.unionByName(right).repartition(int(sides.n * sides.m), "__tile", "other").sortWithinPartitions("__tile", "other", "held")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, queries_ = None, _Best(k, digits), []
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            for key, at, size in _runs(keys):
                if key[:2] != now:
                    yield best.batch()
                    now, best, queries_ = key[:2], _Best(k, digits), []
                part = batch.slice(at, size).select(["id", "scope", "vector"])
                for start in range(0, size, rows):
                    block = _Vectors.of(part.slice(start, rows), dimensions)
                    if not key[2]:
                        queries_.append(block)
                    else:
                        for q in queries_:
                            best.meet(block, q)
        yield best.batch()

    return ranked(both.mapInArrow(multiply, _FOUND), k)


def _runs(keys: list) -> Iterator[tuple]:
    """(key, first position, length) of every run of equal keys."""
    at = 0
    for key, group in groupby(keys):
        size = sum(1 for _ in group)
        yield key, at, size
        at += size


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows, max_chunksize=BLOCK_ROWS)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> list[pa.RecordBatch]:
    return [b for b in pa.ipc.open_stream(data) if b.num_rows]


def fuse(rankings: list[DataFrame], k: int = RANK_WINDOW, constant: int = RANK_CONSTANT, digits: int = 9) -> DataFrame:
    """Reciprocal-rank fusion of rankings ``(query_id, id, rank)``: the sum of 1 / (constant + rank) over the lists that hold an id."""
    check_top_k(k)
    if constant < 0:
        raise ValueError("the rank constant must not be negative")
    every = None
    for r in rankings:
        part = r.select("query_id", "id", (F.lit(1.0) / (constant + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    return ranked(every.groupBy("query_id", "id").agg(F.round(F.sum("part"), digits).alias("score")), k)


def hybrid(
    documents: DataFrame, queries: DataFrame, k: int = RANK_WINDOW, window: int = RANK_WINDOW, constant: int = RANK_CONSTANT,
    make: Callable[[], Embedder] = HashedWords, dimensions: int = 64, scope: str | None = None, vectors: DataFrame | None = None,
) -> DataFrame:
    """BM25 and nearest vectors fused by rank.  ``documents``: ``(id BIGINT, text)``, ``queries``: ``(query_id BIGINT, query)``.

    With ``scope``, a column of all tables, both rankings stay within it.  ``vectors``, ``(id, vector)``, are those stored
    for the documents by the same model; without them the texts are embedded here.
    """
    check_top_k(window)
    check_top_k(k, window)
    within = [scope] if scope else []
    stored = vectors if vectors is not None else spread(documents.select("id", *within, "text")).select("id", *within, embed_column(F.col("text"), make).alias("vector"))
    asked = queries.select(F.col("query_id").alias("id"), *within, embed_column(F.col("query"), make).alias("vector"))
    return fuse([bm25(documents, queries, window, scope=scope), nearest(stored, asked, window, dimensions, scope=scope)], k, constant)


def reranked(candidates: DataFrame, documents: DataFrame, queries: DataFrame, k: int = RANK_WINDOW, make: Callable[[], Scorer] = WordOverlap) -> DataFrame:
    """The candidates ordered anew by a scorer of (query, text); it only sees candidates, never the corpus."""
    check_top_k(k)
    texts = candidates.select("query_id", "id").join(documents.select("id", "text"), "id").join(queries.select("query_id", "query"), "query_id")
    return ranked(texts.select("query_id", "id", score_column(F.col("query"), F.col("text"), make).alias("score")), k)


def search(
    chunks: DataFrame, projects: DataFrame, queries: DataFrame, k: int = 10, rerank: bool = True, make: Callable[[], Embedder] = HashedWords, dimensions: int = 64,
    scorer: Callable[[], Scorer] = WordOverlap, embedding_version: str | None = None,
) -> DataFrame:
    """``(query_id, id, score, rank)`` within each query's project, at its current ready version only.

    Ranks by words and vectors together (``hybrid``); with ``rerank`` a scorer orders the best ``RANK_WINDOW`` of those
    anew.  ``queries``: ``(query_id BIGINT, project_id, query)``; blank queries and those over 500 code points are refused
    and give no rows, as do projects without a ready version.  ``chunks``: ``(id BIGINT, project_id, version_id,
    text)``, and with an ``embedding_version`` also ``(embedding, embedding_version)``: then the stored vectors of that
    version are searched, and chunks without one can only be found by their words.  ``projects``: ``(project_id,
    version_id, status)``.  Corpus statistics are those of all projects asked.
    """
    check_top_k(k, RANK_WINDOW)
    current = projects.where("status = 'ready'").select("project_id", "version_id")
    scope = chunks.join(current, ["project_id", "version_id"], "left_semi")
    valid = queries.select("query_id", "project_id", F.trim("query").alias("query")).where(F.length("query").between(1, 500)).join(current.select("project_id").distinct(), "project_id", "left_semi")
    asked = scope.join(valid.select("project_id").distinct(), "project_id", "left_semi")
    stored = None
    if embedding_version is not None:
        stored = asked.where(F.col("embedding_version") == embedding_version).select("id", "project_id", F.col("embedding").alias("vector"))
    texts = asked.select("id", "project_id", "text")
    first = hybrid(texts, valid, RANK_WINDOW if rerank else k, make=make, dimensions=dimensions, scope="project_id", vectors=stored)
    return reranked(first, texts, valid, k, scorer) if rerank else first


def first_relevant_rank(rankings: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, rank)``: the best rank of a relevant id per query, null if none was found."""
    hit = rankings.join(relevant, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return queries.select("query_id").join(hit, "query_id", "left")


def retrieval_metrics(rankings: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = (1, 5, 10, 20, 30), mrr_at: int = 10, digits: int = 6, by: list[str] | None = None) -> DataFrame:
    """The number of queries with relevant ids, mean recall at every cut and mean reciprocal rank, in one row or one per ``by``.

    ``by`` are columns of ``relevant`` that a query has one value of.
    """
    by = by or []
    known = relevant.select("query_id", "id", *by).distinct()
    sizes = known.groupBy("query_id", *by).agg(F.count(F.lit(1)).alias("n"))
    hits = rankings.join(known, ["query_id", "id"], "left_semi").groupBy("query_id").agg(
        *(F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in cuts), F.min("rank").alias("rank")
    )
    per = sizes.join(hits, "query_id", "left")
    recall = [F.round(F.avg(F.coalesce(F.col(f"hit_{k}"), F.lit(0)) / F.col("n")), digits).alias(f"recall_at_{k}") for k in cuts]
    reciprocal = F.when(F.col("rank") <= mrr_at, F.lit(1.0) / F.col("rank")).otherwise(0.0)
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("query_count"), *recall, F.round(F.avg(reciprocal), digits).alias(f"mrr_at_{mrr_at}"))


def rank_changes(before: DataFrame, after: DataFrame, missing: int = RANK_WINDOW + 1) -> DataFrame:
    """``(query_id, before_rank, after_rank, gain, outcome)`` of two tables ``(query_id, rank)``; no rank counts as ``missing``."""
    pair = before.select("query_id", F.col("rank").alias("before_rank")).join(after.select("query_id", F.col("rank").alias("after_rank")), "query_id", "full_outer")
    gain = F.coalesce("before_rank", F.lit(missing)) - F.coalesce("after_rank", F.lit(missing))
    same = F.col("before_rank").eqNullSafe(F.col("after_rank"))
    outcome = F.when(same, "same").when(gain > 0, "improved").when(gain < 0, "regressed").otherwise("same")
    return pair.select("query_id", "before_rank", "after_rank", gain.cast("int").alias("gain"), outcome.alias("outcome"))
