import json

import pytest

from foliant.operators import memory as K
from tests.helpers import frame, rows

ENTITIES = [
    {"id": "1", "name": "Anna Bell", "type": "character", "aliases": ["Anna"]},
    {"id": "2", "name": "Bob Stone", "type": "character", "aliases": ["Bob", "Sam"]},
    {"id": "3", "name": "Millford", "type": "gpe", "aliases": []},
    {"id": "4", "name": "The Mill", "type": "facility", "aliases": ["Sam"]},
    {"id": "5", "name": "Red Cart", "type": "vehicle", "aliases": None},
]
TEXT = "Anna drove the Red Cart to Millford. Bob waited at The Mill."
EVIDENCE = {"ev": TEXT}


def fact(**kw):
    return {"subject_text": "Anna", "predicate": "eye_color", "object_text": "green", "fact_type": "attribute", "evidence_ids": ["ev"]} | kw


def event(**kw):
    return {"local_id": "e1", "event_type": "other_major", "description": "They met", "participant_texts": ["Anna", "Bob"], "location_texts": [], "participant_entity_ids": [], "location_entity_ids": [], "evidence_ids": ["ev"]} | kw


def rel(**kw):
    return {"source_text": "Bob", "relation_type": "friend_of", "target_text": "Anna", "change": "asserted", "event_local_id": None, "evidence_ids": ["ev"]} | kw


def reasons(**proposed):
    return K.validate(proposed, ENTITIES, EVIDENCE)[1]


@pytest.mark.parametrize("given,reason", [
    ({}, None), ({"evidence_ids": ["zz"]}, "invalid_evidence_id"), ({"evidence_ids": ["ev", "ev"]}, "invalid_evidence_id"), ({"fact_type": "colour"}, "invalid_fact_taxonomy"), ({"predicate": "has_eyes"}, "invalid_fact_taxonomy"),
    ({"subject_entity_id": "9"}, "unknown_entity_id"), ({"subject_entity_id": "2"}, "entity_text_mismatch"), ({"object_text": "Sam", "object_entity_id": "2"}, "entity_text_mismatch"),
])
def test_facts(given, reason):
    assert reasons(facts=[fact(**given)]) == ([f"fact:{reason}"] if reason else [])


def test_linked_facts():
    (good,) = K.validate({"facts": [fact(object_text="bob  STONE")]}, ENTITIES, EVIDENCE)[0]["facts"]
    assert (good["subject_entity_id"], good["object_entity_id"]) == ("1", "2")
    (good,) = K.validate({"facts": [fact(subject_text="Sam")]}, ENTITIES, EVIDENCE)[0]["facts"]
    assert good["subject_entity_id"] is None


@pytest.mark.parametrize("given,reason", [
    ({}, None), ({"event_type": "party"}, "invalid_event_taxonomy"), ({"evidence_ids": ["zz"]}, "invalid_evidence_id"), ({"participant_entity_ids": ["9"]}, "unknown_entity_id"), ({"location_texts": ["Bob"]}, "invalid_location_type"),
    ({"event_type": "communication", "participant_texts": ["Anna"]}, "insufficient_communication_participants"), ({"event_type": "communication"}, None),
    ({"event_type": "movement", "participant_texts": ["The Mill"], "location_texts": ["The Mill"]}, "ambiguous_event_role"),
])
def test_events(given, reason):
    assert reasons(events=[event(**given)]) == ([f"event:{reason}"] if reason else [])


def test_event_ids_are_unique_among_the_accepted():
    assert reasons(events=[event(), event()]) == ["event:duplicate_event_id"]
    assert reasons(events=[event(event_type="party"), event()]) == ["event:invalid_event_taxonomy"]


def test_roles_from_the_description():
    given = event(event_type="movement", description="Anna went by Red Cart to Millford past Bob", participant_texts=["Millford", "a crowd"], location_texts=["The Mill"])
    (good,) = K.validate({"events": [given]}, ENTITIES, EVIDENCE)[0]["events"]
    assert good["participant_entity_ids"] == ["1", "2", "5"] and good["location_entity_ids"] == ["3", "4"]
    assert good["participant_texts"] == ["a crowd", "Anna Bell", "Bob Stone", "Red Cart"] and good["location_texts"] == ["The Mill", "Millford"]


@pytest.mark.parametrize("given,reason", [
    ({}, None), ({"relation_type": "near"}, "invalid_relationship_taxonomy"), ({"target_text": "nobody"}, "unresolved_relationship_endpoint"), ({"target_text": "Bob Stone"}, "self_relationship"),
    ({"event_local_id": "e9"}, "unknown_event_id"), ({"event_local_id": "e1"}, "relationship_event_mismatch"), ({"event_local_id": "e2", "change": "started"}, None),
    ({"event_local_id": "e2", "change": "started", "target_text": "Red Cart", "relation_type": "owns"}, "relationship_event_entities_mismatch"),
    ({"event_local_id": "e3", "change": "ended"}, "relationship_event_evidence_mismatch"), ({"source_entity_id": "9"}, "unknown_entity_id"),
])
def test_relationships(given, reason):
    events = [event(), event(local_id="e2", event_type="relationship_started"), event(local_id="e3", event_type="relationship_ended", evidence_ids=[])]
    assert reasons(events=events, relationships=[rel(**given)]) == ([f"relationship:{reason}"] if reason else [])


def test_symmetric_relations_are_ordered():
    (good,) = K.validate({"relationships": [rel()]}, ENTITIES, EVIDENCE)[0]["relationships"]
    assert (good["source_entity_id"], good["source_text"], good["target_text"]) == ("1", "Anna", "Bob")
    (good,) = K.validate({"relationships": [rel(relation_type="works_for")]}, ENTITIES, EVIDENCE)[0]["relationships"]
    assert good["source_entity_id"] == "2"


def test_validated_table(spark):
    schema = "chunk_id string, evidence_id string, text string, entities array<struct<id:string,name:string,type:string,aliases:array<string>>>, proposed string, kind string"
    entities = [tuple(e.values()) for e in ENTITIES]
    proposed = json.dumps({"facts": [fact(), fact(fact_type="x")], "events": [event()]})
    df = frame(spark, schema, [("k", "ev", TEXT, entities, proposed, ""), ("l", "ev", None, None, None, ""), ("m", "ev", "", [], "{}", "")])
    found = K.validated(df)
    assert rows(found.select("chunk_id", "position", "kind", "reason")) == [("k", 0, "event", None), ("k", 0, "fact", None), ("k", 0, "fact", "fact:invalid_fact_taxonomy")]
    assert K.validated(df.limit(0)).count() == 0


CHANGE = "version_id string, source_id string, relation_type string, target_id string, chunk_ordinal int, position int, change string, event_id string, state_no string"


def states(spark, changes):
    df = frame(spark, CHANGE, [("v", "a", "owns", "b", i, 0, c, e, "") for i, (c, e) in enumerate(changes)])
    return [tuple(r)[4:] for r in rows(K.lifecycle(df))]


def test_lifecycle(spark):
    assert states(spark, [("asserted", None), ("started", "e1"), ("started", "e2")]) == [(1, "active", "e1", None)]
    assert states(spark, [("started", "e1"), ("ended", "e2"), ("ended", "e2"), ("asserted", None)]) == [(1, "ended", "e1", "e2"), (2, "active", None, None)]
    assert states(spark, [("ended", "e1"), ("ended", "e2")]) == [(1, "ended", None, "e1"), (2, "ended", None, "e2")]
    assert states(spark, []) == []


def test_coverage_and_supersession(spark):
    c = "version_id string, chunk_id string"
    assert rows(K.lost_coverage(frame(spark, c, [("v", "1"), ("v", "2")]), frame(spark, c, [("v", "1"), ("w", "2")]))) == [("v", "2")]
    facts = frame(spark, "version_id string, run_id string, status string", [("v", "r1", "active"), ("v", "r2", "active")])
    assert rows(K.superseded(facts, frame(spark, "version_id string, run_id string", [("v", "r2")]))) == [("v", "r1", "superseded"), ("v", "r2", "active")]


def test_several_evidence_blocks(spark):
    chunk = "chunk_id string, entities array<struct<id:string,name:string,type:string,aliases:array<string>>>, proposed string, evidence array<struct<id:string,text:string>>"
    fact = '{"facts": [{"subject_text": "a", "predicate": "stands_near", "object_text": "b", "fact_type": "state", "evidence_ids": %s}]}'
    rows_ = [("k", [], fact % '["x", "y"]', [("x", "one"), ("y", None)]), ("l", None, fact % '["z"]', [("x", "one")])]
    found = {r.chunk_id: r.reason for r in K.validated(frame(spark, chunk, rows_)).collect()}
    assert found == {"k": None, "l": "fact:invalid_evidence_id"}
    for bad in ([("x", "1"), ("x", "2")], [(str(i), "t") for i in range(9)]):
        with pytest.raises(Exception, match="evidence"):
            K.validated(frame(spark, chunk, [("k", [], "{}", bad)])).collect()
