import json

import pytest
from pyspark.sql import functions as F

from foliant.operators import evaluation as V
from foliant.operators import experiments as P
from foliant.operators import publish as B
from foliant.operators import relational as L
from tests.helpers import frame, rows


def test_registries(spark, tmp_path):
    path = tmp_path / "models.json"
    path.write_text(json.dumps({"registry_version": 1, "entries": {"a": {"z": 1, "b": 2}}}))
    held = P.Registry.read("model", str(path))
    assert held["a"] == {"z": 1, "b": 2} and rows(held.table(spark)) == [("model", "a", '{"b":2,"z":1}')]
    with pytest.raises(KeyError, match="known: a"):
        held["other"]
    path.write_text('{"registry_version": 2}')
    with pytest.raises(ValueError):
        P.Registry.read("model", str(path))


def test_manifests(spark):
    df = frame(spark, "k int, v string", [(1, "a"), (2, None)])
    one = P.dataset_manifest({"same": (df, ["k", "v"]), "changed": (df, ["v"]), "gone": (df, ["k"])})
    two = P.dataset_manifest({"same": (df.orderBy(F.desc("k")), ["v", "k"]), "changed": (df.fillna("b"), ["v"]), "new": (df.limit(0), ["k"])})
    assert rows(P.manifest_drift(spark, one, two)) == [("changed", "changed", 2, 2), ("gone", "removed", 2, None), ("new", "added", None, 0), ("same", "same", 2, 2)]


def test_shards_are_reused_only_under_their_manifest(spark, tmp_path):
    asked = frame(spark, "query_id long, text string", [(i, "x") for i in range(10)])
    calls = []

    def rank(mine):
        calls.append(1)
        return mine.select("query_id", F.lit(7).alias("id"))

    run = lambda df, manifest: P.in_shards(df, rank, str(tmp_path), manifest, 3)
    first = run(asked, {"model": "a"})
    assert len(calls) == 3 and sorted((r.query_id, r.shard) for r in first.collect()) == [(i, i % 3) for i in range(10)]
    assert rows(run(asked, {"model": "a"})) == rows(first) and len(calls) == 3
    run(asked, {"model": "b"})
    run(asked.where("query_id < 9"), {"model": "a"})
    assert len(calls) == 9
    assert rows(P.shard_coverage(asked, first)) == [(10, 10, 0, 0, 0)]
    broken = first.where("query_id > 1").unionByName(frame(spark, "query_id long, id int, shard int", [(5, 7, 0), (99, 7, 0)]))
    assert rows(P.shard_coverage(asked, broken)) == [(10, 8, 2, 1, 1)]
    assert rows(P.shard_coverage(asked.limit(0), first.limit(0))) == [(0, 0, 0, 0, 0)]
    with pytest.raises(ValueError):
        P.in_shards(asked, rank, str(tmp_path), {}, 0)


def test_reports(spark):
    r = "query_id long, id long, rank int"
    before, after = frame(spark, r, [(1, 5, 1), (1, 6, 2), (2, 7, 1), (3, 8, 1)]), frame(spark, r, [(1, 6, 1), (1, 5, 2), (2, 7, 1), (3, 9, 1)])
    relevant, asked = frame(spark, "query_id long, id long", [(1, 6), (2, 1), (3, 8)]), frame(spark, "query_id long", [(1,), (2,), (3,), (4,)])
    assert rows(P.evaluated(before, relevant, asked)) == [(1, 2, 1), (2, None, 0), (3, 1, 1), (4, None, 0)]
    pairs = P.paired(before, after, relevant, asked)
    assert rows(pairs) == [(1, 2, 1, 1, "improved", True, False), (2, None, None, 0, "same", True, True), (3, 1, None, -30, "regressed", False, False), (4, None, None, 0, "same", True, True)]
    assert {x.outcome: (x.n, x.pool_misses, x.invalid, x.examples) for x in P.paired_report(pairs).collect()} == {"improved": (1, 0, 0, [1]), "same": (2, 2, 0, [2, 4]), "regressed": (1, 0, 1, [3])}
    splits = frame(spark, "query_id long, split string", [(1, "dev"), (2, "dev"), (3, "test")])
    report = {(x.strategy, x.split): (x.query_count, x.recall_at_1, x.mrr_at_10) for x in P.strategy_report({"b": before, "a": after}, relevant, splits, (1,)).collect()}
    assert report == {("b", "dev"): (2, 0.0, 0.25), ("b", "test"): (1, 1.0, 1.0), ("a", "dev"): (2, 0.5, 0.5), ("a", "test"): (1, 0.0, 0.0)}


def test_publishing(spark, tmp_path):
    folder = str(tmp_path)
    fact = lambda *r: frame(spark, "version_id string, fact string", list(r))
    chunk = lambda *r: frame(spark, "version_id string, chunk_id string", list(r))
    state = lambda *r: frame(spark, "version_id string, state int", list(r))
    began = state(("a", 1), ("b", 1), ("c", 1), ("d", None))
    covered = chunk(("a", "1"), ("a", "2"), ("b", "1"), ("c", "1"))
    said = B.publish_rebuild(folder, 1, fact(("a", "old"), ("b", "old"), ("c", "old")), covered, began, state(("a", 1), ("b", 1), ("c", 1)))
    assert rows(said) == [("a", "publish"), ("b", "publish"), ("c", "publish"), ("d", "stale")]
    second = lambda: B.publish_rebuild(folder, 2, fact(("a", "new"), ("b", "new"), ("c", "new")), chunk(("a", "1"), ("b", "1"), ("b", "2"), ("c", "1")), began, state(("a", 1), ("b", 1), ("c", 2)))
    for _ in range(2):  # a publish that is repeated replaces itself
        assert rows(second()) == [("a", "lost_coverage"), ("b", "publish"), ("c", "stale"), ("d", "stale")]
    assert rows(B.published_facts(spark, folder).select("version_id", "fact", "status")) == [("a", "old", "active"), ("b", "new", "active"), ("b", "old", "superseded"), ("c", "old", "active")]
    assert rows(B.current_coverage(spark, folder)) == [("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("c", "1")]


def test_usage_and_costs(spark):
    calls = frame(spark, "g string, call int, usage string", [("a", 1, '{"p": 2, "q": 1}'), ("a", 2, '{"p": 3, "q": 0}'), ("b", 3, '{"p": 5}'), ("b", 4, '{"p": true, "q": -1}'), ("c", 5, None), ("c", 6, "broken")])
    assert rows(V.usage_sums(calls, "usage", "g")) == [("a", "p", 5), ("a", "q", 1), ("b", "p", 5)]
    assert rows(V.token_costs(calls, "usage", {"p": 1e6, "q": 2e6}, "g")) == [("a", 2, 7.0), ("b", 2, None), ("c", 2, None)]


def test_rates_and_arms(spark):
    calls = frame(spark, "g int, repairs int, error string, decision string, fallback boolean", [(1, 0, None, "merge", True), (1, 1, "X", None, False), (2, 0, None, "needs_review", None)])
    assert rows(V.call_rates(calls, "g")) == [(1, 2, 0.5, 0.5, 0.5, 0.0, 0.5), (2, 1, 0.0, 1.0, 0.0, 1.0, None)]
    arms = frame(spark, "expected string, baseline string, candidate string", [("m", "m", "k"), ("m", None, "m"), (None, "m", "m"), ("k", "k", "k")])
    assert rows(V.arm_comparison(arms)) == [(4, 0.5, 0.5, 0.0, 1, 1)]
    p = "left_id string, right_id string, x int"
    assert rows(V.candidate_recall(frame(spark, p, [("a", "b", 1)]), frame(spark, p, [("a", "b", 1), ("a", "b", 2), ("c", "d", 1)]))) == [(2, 1, 0.5)]


def test_timeline(spark):
    events = frame(spark, "id int, participants array<string>, locations array<string>, event_type string", [(1, ["a", "b"], ["x"], "m"), (2, ["b"], None, "m"), (3, None, ["x"], "n")])
    ids = lambda **kw: [r.id for r in L.timeline(events, **kw).orderBy("id").collect()]
    assert ids() == [1, 2, 3] and ids(participant=F.lit("b")) == [1, 2] and ids(location=F.lit("x")) == [1, 3] and ids(participant=F.lit("b"), kind=F.lit("m"), location=F.lit("x")) == [1]
