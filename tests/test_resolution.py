import uuid

from pyspark.sql import functions as F

from foliant.operators import mentions as M
from foliant.operators import resolution as E
from foliant.operators.graph import star_components
from foliant.shared import Workspace
from tests.helpers import frame, rows

V = str(uuid.UUID(int=5))
MENTION = "id string, version_id string, chapter_id string, chapter_ordinal int, entity_type string, surface_text string, start_offset int, end_offset int"


def test_expanded_surfaces(spark):
    named = frame(spark, "chunk_id string, text string, surface_text string, entity_type string, found int", [
        ("k", "Anna met Anna. ananana", "Anna", "character", 0), ("k", "Anna met Anna. ananana", "ana", "gpe", 0), ("k", "Anna met Anna. ananana", "Bob", "gpe", 0), ("k", "Anna met Anna. ananana", "Anna", "character", 0),
        ("l", None, "x", "gpe", 0), ("l", "x", None, "gpe", 0), ("l", "😀a.b", "a.b", "gpe", 0), ("l", "y", "", "gpe", 0),
    ])
    found = M.expand_surfaces(named)
    spans = {(r.chunk_id, r.surface_text, r.start_offset, r.end_offset) for r in found.where("found").collect()}
    assert spans == {("k", "Anna", 0, 4), ("k", "Anna", 9, 13), ("k", "ana", 15, 18), ("k", "ana", 19, 22), ("l", "a.b", 1, 4)}
    assert {(r.chunk_id, r.surface_text) for r in found.where("not found").collect()} == {("k", "Bob"), ("l", "x"), ("l", None), ("l", "")}
    assert found.count() == 9 and M.expand_surfaces(named.limit(0)).count() == 0


def test_rebase_dedupe_verify(spark):
    spans = frame(spark, "chapter_id string, surface_text string, start_offset int, end_offset int, chunk_start int, chunk_ordinal int", [("c", "bc", 1, 3, 0, 1), ("c", "bc", 0, 2, 1, 2), ("c", "zz", 0, 2, 3, 2), ("d", "bc", 0, 2, 0, 1)])
    first = M.first_of_each_span(M.rebase(spans), ["chapter_id", "start_offset", "end_offset"], ["chunk_ordinal"])
    assert {(r.chapter_id, r.start_offset, r.chunk_ordinal) for r in first.collect()} == {("c", 1, 1), ("c", 3, 2), ("d", 0, 1)}
    good, bad = M.verified(first, frame(spark, "chapter_id string, chapter_text string", [("c", "abcde")]))
    assert [r.start_offset for r in good.collect()] == [1] and bad.count() == 2


def test_mentions_are_only_replaced_while_chunks_stay(spark):
    t = "version_id string, id string"
    c = "version_id string, chunk_id string"
    stored, fresh = frame(spark, t, [("v", "old"), ("w", "old")]), frame(spark, t, [("v", "new"), ("w", "new")])
    then, now = frame(spark, c, [("v", "1"), ("w", "1")]), frame(spark, c, [("v", "1"), ("w", "2")])
    assert rows(M.replaced_mentions(stored, fresh, then, now)) == [("v", "new"), ("w", "old")]


def mention(i, name, at=0, chapter="c1", ordinal=1, kind="character", version=V):
    return (i, version, chapter, ordinal, kind, name, at, at + len(name))


def pairs(spark, given, **kw):
    return {(r.left_id, r.right_id) for r in E.candidate_pairs(frame(spark, MENTION, given), **kw).collect()}


def test_blocking(spark):
    far = [mention("a", "Mr Anna Bell", 0), mention("b", "Bob Stone", 5000), mention("c", "Anna Fox", 9000, "c2", 2), mention("d", "Mr Cole", 9000, "c3", 3)]
    assert pairs(spark, far) == {("a", "c")}
    near = [mention("a", "X", 0), mention("b", "Y", 400), mention("c", "Z", 1300), mention("d", "W", 1400, kind="gpe")]
    assert pairs(spark, near) == {("a", "b")}
    same = [mention(f"m{i}", "Anna", i * 5000) for i in range(6)]
    assert pairs(spark, same) == {(f"m{j}", f"m{i}") for i in range(6) for j in range(max(0, i - 3), i)}
    assert pairs(spark, same, per_mention=1) == {(f"m{max(0, i - 3)}", f"m{i}") for i in range(1, 6)}
    assert len(pairs(spark, same, per_version=4)) == 4
    assert pairs(spark, []) == set() and pairs(spark, [mention("a", "", 0), mention("b", "…", 9000)]) == set()


def test_evidence_id_is_the_standard_one(spark):
    text = "x" * 600 + "Anna" + "y" * 600
    m = frame(spark, "id string, version_id string, chapter_id string, start_offset int, end_offset int", [("m", V, "c", 600, 604)])
    chapters = frame(spark, "chapter_id string, version_id string, ordinal int, title string, chapter_text string", [("c", V, 4, "", text)])
    r = E.with_evidence(m, chapters).first()
    import hashlib

    digest = hashlib.sha256(text[100:1104].encode()).hexdigest()
    assert r.evidence_id == str(uuid.uuid5(uuid.UUID(V), f"resolution:c:100:1104:{digest}")) and r.chapter == "Chapter 4" and r.evidence_text == text[100:1104]


def test_pairs_and_their_conflicts(spark):
    sources = frame(spark, "mention_id string, version_id string, entity_type string, evidence_id string", [("a", "v", "x", "e1"), ("b", "v", "x", "e1"), ("c", "v", "y", "e2"), ("d", "w", "x", "e3")])
    good, bad = E.assembled_pairs(frame(spark, "id string, version_id string, left_id string, right_id string", [("1", "v", "a", "b"), ("2", "v", "a", "c"), ("3", "v", "a", "d"), ("4", "v", "a", None)]), sources)
    assert [(r.id, r.evidence_ids) for r in good.collect()] == [("1", ["e1"])] and {r.id for r in bad.collect()} == {"2", "3", "4"}


def test_counts_and_pending(spark):
    c = frame(spark, "id string, llm_decision string, applied_decision string, error_code string", [
        ("1", None, None, None), ("2", None, None, "MODEL_TIMEOUT"), ("3", "merge", None, None), ("4", "merge", None, E.CONFLICT), ("5", None, None, "OTHER"), ("6", "merge", "merge", None), ("7", "merge", "keep_separate", None),
    ])
    assert tuple(E.outcome_counts(c).first()) == (2, 2, 2, 3, 2, 1)
    assert {r.id for r in c.where(E.needs_evaluation(F.lit(2))).collect()} == {"1"}


def test_valid_decisions(spark):
    d = frame(spark, "decision string, cited array<string>, left_evidence string, right_evidence string", [
        ("merge", ["a", "b"], "a", "b"), ("merge", ["a"], "a", "b"), ("merge", ["a"], "a", "a"), ("needs_review", [], "a", "b"), ("needs_review", ["z"], "a", "b"), ("keep_separate", ["a", "b", "b"], "a", "b"), ("merge", None, "a", "b"),
    ])
    assert [r.v for r in d.select(E.valid_decision().alias("v")).collect()] == [True, False, True, True, False, False, False]


def test_same_cluster(spark):
    pairs = frame(spark, "pair_id string, chapter_id string, left_span string, right_span string", [("1", "c", "a", "b"), ("2", "c", "a", "d"), ("3", "c", "a", "z"), ("4", "c", "e", "a")])
    members = frame(spark, "chapter_id string, span string, cluster string", [("c", "a", "w1:1"), ("c", "b", "w1:1"), ("c", "d", "w1:2"), ("c", "e", "w1:1"), ("c", "e", "w2:1"), ("c", "a", "w1:1")])
    assert rows(E.same_cluster(pairs, members)) == [("1", True), ("2", False), ("3", False), ("4", False)]


def test_component_veto(spark):
    roots = frame(spark, "entity_id string, root_id string", [(x, x) for x in "abcdefg"] + [("a2", "a")])
    c = frame(spark, "candidate_id string, left_entity_id string, right_entity_id string, llm_decision string, applied_decision string, error_code string", [
        ("1", "a", "b", "merge", None, None), ("2", "b", "c", "merge", None, None), ("3", "a2", "c", "keep_separate", None, None), ("4", "d", "e", "merge", None, None), ("5", "f", "g", "keep_separate", None, None),
        ("6", "a", "a2", "keep_separate", None, None), ("7", "d", "f", "merge", None, "OTHER"), ("8", "e", "f", "merge", "merge", None), ("9", "f", "g", "needs_review", None, None),
    ])
    assert dict(rows(E.automatic_application(c, roots))) == {"1": "conflict", "2": "conflict", "3": "apply", "4": "apply", "5": "apply", "6": "conflict"}


def test_decisions_in_order(spark):
    entities = frame(spark, "version_id string, entity_id string, canonical_name string, merged_into_id string", [("v", "a", "Anna", None), ("v", "b", "Anna Bell", None), ("v", "c", "Anna", None), ("v", "d", None, "gone")])
    said = frame(spark, "version_id string, position long, candidate_id string, decision string, left_entity_id string, right_entity_id string", [
        ("v", 1, "1", "keep_separate", "a", "c"), ("v", 2, "2", "merge", "a", "b"), ("v", 3, "3", "merge", "b", "c"), ("v", 4, "4", "merge", "a", "b"), ("v", 5, "5", "keep_separate", "a", "b"), ("v", 6, "6", "merge", "a", "d"),
    ])
    found = {r.candidate_id: (r.outcome, r.survivor_id, r.retired_id) for r in E.applied_in_order(said, entities).collect()}
    assert found == {"1": ("separated", None, None), "2": ("merged", "b", "a"), "3": ("conflict", None, None), "4": ("linked", "b", None), "5": ("conflict", None, None), "6": ("conflict", None, None)}


def test_star_components(spark):
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "x")]
    found = {r.node: r.component for r in star_components(frame(spark, "src string, dst string", edges), Workspace(spark, "t")).collect()}
    assert found == {f"n{i:02d}": "n00" for i in range(41)} | {"x": "x", "y": "x"}
    assert star_components(frame(spark, "src string, dst string", []), Workspace(spark, "t")).count() == 0
