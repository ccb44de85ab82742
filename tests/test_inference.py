import json

import pytest

from foliant.operators import inference as N
from tests.helpers import frame, rows


class Says:
    def __init__(self, *answers):
        self.answers = list(answers)

    def complete(self, prompt):
        return self.answers[min(prompt.count("refused"), len(self.answers) - 1)]


GOOD = json.dumps({"mentions": [{"surface_text": "Anna", "entity_type": "character"}, {"surface_text": "Nobody", "entity_type": "gpe"}]})
BAD = json.dumps({"mentions": [{"surface_text": "Anna", "entity_type": "ghost"}]})


@pytest.mark.parametrize("answers,n", [((GOOD,), 3), ((BAD, GOOD), 3), (("no json", BAD), 0), (("[]", "{}"), 0)])
def test_extraction_asks_once_more(spark, answers, n):
    chunks = frame(spark, "chunk_id string, text string, prompt string", [("k", "Anna and Anna", ""), ("l", None, "")])
    found = N.extracted_mentions(chunks, lambda: Says(*answers))
    assert found.count() == n and found.where("found").count() == (2 if n else 0)


class Spans:
    def spans(self, text):
        return [("Anna", "character", 0, 4), ("Anna", "character", 0, 4), ("Anna", "ghost", 0, 4), ("nna", "gpe", 0, 4), ("x", "gpe", 3, 99)]


def test_spans_are_checked(spark):
    found = N.model_spans(frame(spark, "chunk_id string, text string", [("k", "Anna"), ("l", None)]), Spans)
    assert [r.valid for r in found.orderBy("end_offset", "entity_type").collect()] == [True, False, False, False]


@pytest.mark.parametrize("said,ok", [
    ({"decision": "merge", "evidence_ids": ["a", "b"]}, True), ({"decision": "merge", "evidence_ids": ["a"]}, False), ({"decision": "needs_review", "evidence_ids": []}, True),
    ({"decision": "merge", "evidence_ids": ["a", "b", "c"]}, False), ({"decision": "keep_separate", "evidence_ids": ["a", "a", "b"]}, False), ({"decision": "perhaps", "evidence_ids": ["a", "b"]}, False), ({"decision": "merge"}, False),
])
def test_decisions_are_checked(spark, said, ok):
    assert (N.accepted_decision("a", "b")(json.dumps(said)) is not None) is ok
    pairs = frame(spark, "id string, left_evidence string, right_evidence string, prompt string", [("1", "a", "b", "x")])
    r = N.decided_pairs(pairs, lambda: Says("junk", json.dumps(said))).first()
    assert (r.error is None, r.repairs) == (ok, 1)


def test_coreference_windows(spark):
    text = "Anna saw Bob. Anna left. 😀 Bob met Bob."
    found = N.coreference_memberships(frame(spark, "chapter_id string, chapter_text string", [("c", text), ("d", None), ("e", "")]), N.CapitalWords, 7)
    assert {(text[r.start_offset : r.end_offset], r.cluster) for r in found.collect()} == {("Anna", "0:0"), ("Bob", "1:0")}
    assert found.count() == 4


class Outside:
    def clusters(self, tokens):
        return [[(0, len(tokens))]]


def test_clusters_stay_inside(spark):
    with pytest.raises(Exception, match="outside"):
        N.coreference_memberships(frame(spark, "chapter_id string, chapter_text string", [("c", "a b")]), Outside).collect()
    assert rows(N.coreference_memberships(frame(spark, "chapter_id string, chapter_text string", []), Outside)) == []
