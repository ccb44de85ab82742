import math

import pytest
from pyspark.sql import functions as F

from foliant.operators import models as M
from foliant.operators import retrieval as R
from tests.helpers import frame, rows

DOC = "id long, text string, dl int"


def test_bm25_by_hand(spark):
    docs = frame(spark, DOC, [(1, "red fox", 0), (2, "red red bird sings", 0), (3, "blue", 0), (4, None, 0), (5, "", 0)])
    queries = frame(spark, "query_id long, query string, w string", [(10, "Red!", ""), (11, "fox red", ""), (12, "nothing", ""), (13, None, ""), (14, "Red!", "")])
    found = {(r.query_id, r.id): (r.score, r.rank) for r in R.bm25(docs, queries).collect()}
    idf = math.log(1 + (5 - 2 + 0.5) / 2.5)
    part = lambda tf, dl: round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 1.4)), 6)
    assert found[(10, 2)] == (part(2, 4), 1 if part(2, 4) > part(1, 2) else 2) and found[(10, 1)][0] == part(1, 2)
    assert found[(14, 1)] == found[(10, 1)] and {q for q, _ in found} == {10, 11, 14}
    assert found[(11, 1)][1] == 1


def test_ties_go_by_id_and_k_is_checked(spark):
    docs = frame(spark, DOC, [(i, "same text", 0) for i in (5, 3, 9)])
    queries = frame(spark, "query_id long, query string", [(1, "text")])
    assert [(r.id, r.rank) for r in R.bm25(docs, queries, 2).orderBy("rank").collect()] == [(3, 1), (5, 2)]
    with pytest.raises(ValueError):
        R.bm25(docs, queries, 0)


@pytest.mark.parametrize("sent", [R.SENT_VALUES, 24])
def test_nearest_against_brute_force(spark, sent):
    """The second way cuts queries of more than 3 vectors and the vectors into tiles of 3."""
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype("float32")
    data = [(i, x.tolist(), "") for i, x in enumerate(v)] + [(900, None, ""), (901, [1.0], ""), (902, [0.0] * 8, ""), (903, [float("nan")] * 8, "")]
    df = frame(spark, "id long, vector array<float>, block string", data)
    found = R.nearest(df, df.where("id % 50 = 0"), 7, 8, rows=32, sent=sent)
    unit = v.astype("float64") / np.linalg.norm(v.astype("float64"), axis=1, keepdims=True)
    for q in range(0, 300, 50):
        s = np.round(unit @ unit[q], 5)
        best = sorted(range(300), key=lambda i: (-s[i], i))[:7]
        assert [r.id for r in found.where(F.col("query_id") == q).orderBy("rank").collect()] == best
    assert R.nearest(df.limit(0), df, 3, 8, sent=sent).count() == 0 == R.nearest(df, df.limit(0), 3, 8, sent=sent).count()
    scoped = R.nearest(df.withColumn("s", F.col("id") % 3), df.where("id % 50 = 0").withColumn("s", F.col("id") % 3), 7, 8, rows=32, scope="s", sent=sent)
    for q in range(0, 300, 50):
        s = np.round(unit @ unit[q], 5)
        best = sorted((i for i in range(300) if i % 3 == q % 3), key=lambda i: (-s[i], i))[:7]
        assert [r.id for r in scoped.where(F.col("query_id") == q).orderBy("rank").collect()] == best


def test_nearest_ties_go_by_id(spark):
    df = frame(spark, "id long, vector array<float>", [(i, [1.0, 0.0]) for i in range(50)] + [(90, [1.0, 1.0])])
    for sent in (R.SENT_VALUES, 4):
        assert [(r.id, r.rank) for r in R.nearest(df, df.where("id = 90 or id = 7"), 3, 2, rows=8, sent=sent).where("query_id = 7").orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3)]


def test_fusion(spark):
    a = frame(spark, "query_id long, id long, rank int", [(1, 10, 1), (1, 20, 2)])
    b = frame(spark, "query_id long, id long, rank int", [(1, 20, 1), (1, 30, 2)])
    found = {r.id: (r.score, r.rank) for r in R.fuse([a, b]).collect()}
    assert found[20] == (round(1 / 61 + 1 / 62, 9), 1) and found[10][1] == 2 and found[30][1] == 3
    with pytest.raises(ValueError):
        R.fuse([a, b], 5, -1)


def test_hybrid_and_reranking(spark):
    docs = frame(spark, DOC, [(1, "the red fox", 0), (2, "a blue bird", 0), (3, None, 0)])
    queries = frame(spark, "query_id long, query string", [(7, "blue bird")])
    both = R.hybrid(docs, queries, 5)
    assert both.orderBy("rank").first().id == 2
    assert rows(R.reranked(both, docs, queries, 1)) == [(7, 2, 1.0, 1)]


class Broken:
    def score(self, queries, texts):
        return [float("nan")] * len(texts)


def test_scores_must_be_finite(spark):
    df = frame(spark, "q string, t string", [("a", "b")])
    with pytest.raises(Exception, match="finite"):
        df.select(M.score_column(F.col("q"), F.col("t"), Broken)).collect()


def test_search_stays_in_scope(spark):
    chunks = frame(spark, "id long, project_id string, version_id string, text string", [(1, "p", "v1", "old fox"), (2, "p", "v2", "new fox"), (3, "q", "w", "other fox")])
    projects = frame(spark, "project_id string, version_id string, status string", [("p", "v1", "archived"), ("p", "v2", "ready"), ("q", "w", "processing")])
    asked = frame(spark, "query_id long, project_id string, query string", [(1, "p", " fox "), (2, "q", "fox"), (3, "p", "  "), (4, "p", "x" * 501), (5, None, "fox")])
    assert [(r.query_id, r.id) for r in R.search(chunks, projects, asked).collect()] == [(1, 2)]
    assert [(r.query_id, r.id) for r in R.search(chunks, projects, asked, rerank=False).collect()] == [(1, 2)]


def test_search_ranks_by_words_and_stored_vectors(spark):
    """Without a shared word a chunk is found by its vector of the asked version only."""
    unit = lambda at: [1.0 if i == at else 0.0 for i in range(26)]
    chunks = frame(spark, "id long, project_id string, version_id string, text string, embedding array<float>, embedding_version string", [
        (1, "p", "v", "zzz", unit(0), "m1"), (2, "p", "v", "aaa word", unit(25), "m1"), (3, "p", "v", "yyy", unit(0), "m2"), (4, "p", "v", None, None, None),
    ])
    projects = frame(spark, "project_id string, version_id string, status string", [("p", "v", "ready")])
    asked = frame(spark, "query_id long, project_id string, query string, text string", [(1, "p", "aaa", "clash")])
    found = lambda version: [r.id for r in R.search(chunks, projects, asked, rerank=False, make=M.Letters, dimensions=26, embedding_version=version).orderBy("rank").collect()]
    assert found("m1") == [2, 1] and found("m2") == [2, 3] and found("m3") == [2]
    assert [r.id for r in R.search(chunks, projects, asked, make=M.Letters, dimensions=26).orderBy("rank").collect()][0] == 2


def test_metrics(spark):
    ranking = frame(spark, "query_id long, id long, rank int", [(1, 5, 1), (1, 6, 2), (2, 7, 2)])
    relevant = frame(spark, "query_id long, id long", [(1, 5), (2, 7), (2, 8), (1, 5)])
    m = R.retrieval_metrics(ranking, relevant, (1, 5)).first()
    assert (m.query_count, m.recall_at_1, m.recall_at_5, m.mrr_at_10) == (2, 0.5, 0.75, 0.75)
    first = R.first_relevant_rank(ranking, relevant, frame(spark, "query_id long", [(1,), (2,), (3,)]))
    assert rows(first) == [(1, 1), (2, 2), (3, None)]
    changes = R.rank_changes(frame(spark, "query_id long, rank int", [(1, 5), (2, None), (3, 1), (4, None)]), frame(spark, "query_id long, rank int", [(1, 2), (2, 30), (3, None), (4, None)]))
    assert {r.query_id: (r.gain, r.outcome) for r in changes.collect()} == {1: (3, "improved"), 2: (1, "improved"), 3: (-30, "regressed"), 4: (0, "same")}


class Echo:
    def complete(self, prompt):
        return "good" if "refused" in prompt or prompt == "a" else "bad"


def test_one_repair(spark):
    prompts = frame(spark, "id string, prompt string", [("1", "a"), ("2", "b")])
    done = M.complete_rows(prompts, Echo, lambda x: x if x == "good" else None)
    assert rows(done) == [("1", "good", 0, None), ("2", "good", 1, None)]
    assert rows(M.complete_rows(prompts, Echo, lambda x: None)) == [("1", None, 1, "INVALID_OUTPUT"), ("2", None, 1, "INVALID_OUTPUT")]
