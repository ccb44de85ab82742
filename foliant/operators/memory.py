"""Structured story memory: what a model proposes about a chunk is validated, joined across chunks and published.

Validation looks at one chunk at a time and runs where the row is; nothing is shuffled before facts, events and
relationships are joined by their keys in narrative order.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import uuid5
from foliant.operators.relational import few_of_each, latest

# The controlled vocabulary.
FACT_TYPES = {"attribute", "state", "possession", "location", "role", "affiliation", "world_rule"}
EVENT_TYPES = {
    "relationship_started", "relationship_ended", "movement", "death", "injury", "possession_changed", "discovery", "communication", "conflict", "accident", "other_major",
}
RELATION_TYPES = {"spouse_of", "sibling_of", "parent_of", "child_of", "friend_of", "enemy_of", "member_of", "works_for", "leads", "owns", "lives_in", "located_in"}
SYMMETRIC = {"spouse_of", "sibling_of", "friend_of", "enemy_of"}
VERB_PREFIXES = ("has_", "is_", "was_", "became_")
ACTORS, PLACES, EITHER = {"character", "organization", "vehicle"}, {"gpe", "location"}, "facility"
ROLES_FROM_TEXT = {"movement", "accident"}
MOST_EVIDENCE = 8
MOST_ALIASES = 50

_words = re.compile(r"[^\W_]+").findall


def plain_name(text: str | None) -> str:
    return " ".join(_words(unicodedata.normalize("NFKC", text or "").casefold()))


class Cast:
    """The entities a chunk may speak of, by id and by names that only one of them has."""

    def __init__(self, entities: list[dict]):
        self.kind = {e["id"]: e["type"] for e in entities}
        self.name = {e["id"]: e["name"] for e in entities}
        bearers: dict[str, set[str]] = defaultdict(set)
        for e in entities:
            for n in (e["name"], *(e.get("aliases") or ())):
                if plain_name(n):
                    bearers[plain_name(n)].add(e["id"])
        self.only = {n: next(iter(ids)) for n, ids in bearers.items() if len(ids) == 1}

    def find(self, text: str | None) -> str | None:
        return self.only.get(plain_name(text))

    def named_in(self, *texts: str) -> set[str]:
        """Entities of which one unambiguous name stands, as whole words, in every text."""
        padded = [f" {plain_name(t)} " for t in texts]
        return {e for n, e in self.only.items() if all(f" {n} " in t for t in padded)}


def first_reason(rules: list[tuple[str, Callable[[], bool]]]) -> str | None:
    """The name of the first rule that is broken."""
    return next((reason for reason, broken in rules if broken()), None)


def _miscited(item: dict, evidence: dict[str, str]) -> bool:
    ids = item["evidence_ids"]
    return len(set(ids)) < len(ids) or not set(ids) <= evidence.keys()


def _link_rules(cast: Cast, text: str | None, given: str | None) -> list[tuple[str, Callable[[], bool]]]:
    return [("unknown_entity_id", lambda: given is not None and given not in cast.kind), ("entity_text_mismatch", lambda: given is not None and given != cast.find(text))]


def check_fact(fact: dict, cast: Cast, evidence: dict[str, str]) -> tuple[dict | None, str | None]:
    reason = first_reason(
        [
            ("invalid_evidence_id", lambda: _miscited(fact, evidence)),
            ("invalid_fact_taxonomy", lambda: fact["fact_type"] not in FACT_TYPES or fact["predicate"].startswith(VERB_PREFIXES)),
            *_link_rules(cast, fact["subject_text"], fact.get("subject_entity_id")),
            *_link_rules(cast, fact["object_text"], fact.get("object_entity_id")),
        ]
    )
    if reason:
        return None, reason
    return fact | {"subject_entity_id": fact.get("subject_entity_id") or cast.find(fact["subject_text"]), "object_entity_id": fact.get("object_entity_id") or cast.find(fact["object_text"])}, None


def _with_names(texts: list[str], roles: set[str], cast: Cast) -> list[str]:
    """The texts of a role: unresolved ones stay, those of other roles go, entities without a text get their name."""
    kept = [t for t in texts if cast.find(t) is None or cast.find(t) in roles]
    return kept + [cast.name[e] for e in sorted(roles - {cast.find(t) for t in kept})]


def check_event(event: dict, seen: set[str], cast: Cast, evidence: dict[str, str]) -> tuple[dict | None, str | None]:
    by_actor_text = {e for e in map(cast.find, event["participant_texts"]) if e}
    by_place_text = {e for e in map(cast.find, event["location_texts"]) if e}
    given = {*event.get("participant_entity_ids", ()), *event.get("location_entity_ids", ())}
    actors, places = by_actor_text, by_place_text
    actor_texts, place_texts = event["participant_texts"], event["location_texts"]
    facilities: set[str] = set()
    if event["event_type"] in ROLES_FROM_TEXT:
        source = " ".join(text for key, text in evidence.items() if key in event["evidence_ids"])
        mentioned = by_actor_text | by_place_text | cast.named_in(event["description"], source)
        facilities = {e for e in mentioned if cast.kind[e] == EITHER}
        actors = {e for e in mentioned if cast.kind[e] in ACTORS} | facilities & by_actor_text
        places = {e for e in mentioned if cast.kind[e] in PLACES} | facilities & by_place_text
        actor_texts, place_texts = _with_names(actor_texts, actors, cast), _with_names(place_texts, places, cast)
    speakers = {e for e in by_actor_text if cast.kind[e] in ACTORS}
    reason = first_reason(
        [
            ("duplicate_event_id", lambda: event["local_id"] in seen),
            ("invalid_evidence_id", lambda: _miscited(event, evidence)),
            ("invalid_event_taxonomy", lambda: event["event_type"] not in EVENT_TYPES),
            ("unknown_entity_id", lambda: not given <= cast.kind.keys()),
            ("ambiguous_event_role", lambda: bool(facilities & by_actor_text & by_place_text)),
            ("invalid_location_type", lambda: any(cast.kind[e] not in PLACES | {EITHER} for e in places)),
            ("insufficient_communication_participants", lambda: event["event_type"] == "communication" and len(speakers) < 2),
        ]
    )
    if reason:
        return None, reason
    return event | {"participant_texts": actor_texts, "location_texts": place_texts, "participant_entity_ids": sorted(actors), "location_entity_ids": sorted(places)}, None


def check_relationship(rel: dict, events: dict[str, dict], cast: Cast, evidence: dict[str, str]) -> tuple[dict | None, str | None]:
    source = rel.get("source_entity_id") or cast.find(rel["source_text"])
    target = rel.get("target_entity_id") or cast.find(rel["target_text"])
    named = rel.get("event_local_id")
    event = events.get(named, {}) if named else {}
    reason = first_reason(
        [
            ("invalid_evidence_id", lambda: _miscited(rel, evidence)),
            ("invalid_relationship_taxonomy", lambda: rel["relation_type"] not in RELATION_TYPES),
            *_link_rules(cast, rel["source_text"], rel.get("source_entity_id")),
            ("unresolved_relationship_endpoint", lambda: source is None),
            *_link_rules(cast, rel["target_text"], rel.get("target_entity_id")),
            ("unresolved_relationship_endpoint", lambda: target is None),
            ("self_relationship", lambda: source == target),
            ("unknown_event_id", lambda: bool(named) and not event),
            ("relationship_event_mismatch", lambda: bool(named) and event["event_type"] != f"relationship_{rel['change']}"),
            ("relationship_event_entities_mismatch", lambda: bool(named) and not {source, target} <= {*event["participant_entity_ids"], *event["location_entity_ids"]}),
            ("relationship_event_evidence_mismatch", lambda: bool(named) and not set(rel["evidence_ids"]) & set(event["evidence_ids"])),
        ]
    )
    if reason:
        return None, reason
    ends = [(source, rel["source_text"]), (target, rel["target_text"])]
    if rel["relation_type"] in SYMMETRIC:
        ends.sort()
    (source, source_text), (target, target_text) = ends
    return rel | {"source_entity_id": source, "target_entity_id": target, "source_text": source_text, "target_text": target_text}, None


def validate(proposed: dict, entities: list[dict], evidence: dict[str, str]) -> tuple[dict[str, list[dict]], list[str]]:
    """Accepted facts, events and relationships of one chunk, and a reason ``kind:rule`` for every refused one."""
    cast = Cast(entities)
    out: dict[str, list[dict]] = {"facts": [], "events": [], "relationships": []}
    reasons = []
    events: dict[str, dict] = {}
    checks = (
        ("facts", "fact", lambda x: check_fact(x, cast, evidence)),
        ("events", "event", lambda x: check_event(x, set(events), cast, evidence)),
        ("relationships", "relationship", lambda x: check_relationship(x, events, cast, evidence)),
    )
    for plural, kind, check in checks:
        for item in proposed.get(plural) or ():
            good, reason = check(item)
            if reason:
                reasons.append(f"{kind}:{reason}")
            else:
                out[plural].append(good)
                if kind == "event":
                    events[item["local_id"]] = good
    return out, reasons


def validated(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, position, kind, item, reason)`` for rows ``(chunk_id, evidence_id, text, entities, proposed)``.

    ``entities``: array of structs ``(id, name, type, aliases)``; ``proposed``: JSON of the three lists.  Accepted
    items come as JSON with their position within the chunk, refused ones as rows with a reason and no item.

    With a column ``evidence``, an array of structs ``(id, text)``, that is what may be cited, in place of the chunk's one
    text; more than ``MOST_EVIDENCE`` blocks or an id that comes twice fail the call.
    """
    several = "evidence" in chunks.columns
    blocks = F.col("evidence") if several else F.array(F.struct(F.col("evidence_id").alias("id"), F.col("text").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for chunk, given, entities, proposed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                evidence = {e["id"]: e["text"] or "" for e in given or ()}
                if len(evidence) < len(given or ()) or len(evidence) > MOST_EVIDENCE:
                    raise ValueError(f"chunk {chunk} has evidence twice or more than {MOST_EVIDENCE} blocks of it")
                good, reasons = validate(json.loads(proposed or "{}"), entities or [], evidence)
                for plural, items in good.items():
                    rows += [(chunk, i, plural[:-1], json.dumps(x, sort_keys=True, ensure_ascii=False), None) for i, x in enumerate(items)]
                rows += [(chunk, i, r.split(":")[0], None, r) for i, r in enumerate(reasons)]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk_id", "position", "kind", "item", "reason"])

    return chunks.select("chunk_id", blocks.alias("evidence"), "entities", "proposed").mapInArrow(run, "chunk_id string, position int, kind string, item string, reason string")


def evidence_id(version: str = "version_id", chapter: str = "chapter_id", chunk: str = "chunk_id", start: str = "start_offset", text: str = "text") -> Column:
    """The id of a chunk as evidence: it follows from where the chunk stands and what it says."""
    return uuid5(version, F.concat_ws(":", F.lit("memory"), chapter, chunk, F.col(start).cast("string"), F.sha2(text, 256)))


def chunk_inputs(chunks: DataFrame, mentions: DataFrame, roots: DataFrame, entities: DataFrame) -> DataFrame:
    """``(chunk_id, evidence_id, text, entities)``: each chunk's evidence and the root entities mentioned in it.

    ``chunks``: ``(chunk_id, version_id, chapter_id, start_offset, text)``; ``mentions``: ``(chunk_id, entity_id,
    surface_text)``; ``roots``: ``(entity_id, root_id)``; ``entities``: ``(entity_id, name, type)``.  Aliases are the
    surfaces of all mentions under a root other than its name, sorted, at most ``MOST_ALIASES``.
    """
    placed = mentions.join(roots, "entity_id").select("chunk_id", "root_id", "surface_text")
    said = few_of_each(placed, ["root_id"], "surface_text", MOST_ALIASES + 1, "said")  # one may be the name itself
    heads = entities.select(F.col("entity_id").alias("root_id"), "name", "type").join(said, "root_id")
    other = F.slice(F.array_remove("said", F.coalesce("name", F.lit(""))), 1, MOST_ALIASES)
    refs = heads.select("root_id", F.struct(F.col("root_id").alias("id"), F.coalesce("name", F.element_at("said", 1)).alias("name"), "type", other.alias("aliases")).alias("ref"))
    listed = placed.select("chunk_id", "root_id").distinct().join(refs, "root_id").groupBy("chunk_id").agg(F.array_sort(F.collect_list("ref")).alias("entities"))
    return chunks.select("chunk_id", evidence_id().alias("evidence_id"), "text").join(listed, "chunk_id", "left")


def joined_facts(facts: DataFrame) -> DataFrame:
    """The first of equal facts in narrative order.  ``facts``: ``(version_id, chunk_ordinal, position, subject, predicate, object, fact_type, …)``."""
    return latest(facts, ["version_id", "subject", "predicate", "object", "fact_type"], "chunk_ordinal", "position")


def evidence_links(owners: DataFrame, owner: str) -> DataFrame:
    return owners.select(owner, "evidence_id").distinct()


def lifecycle(changes: DataFrame) -> DataFrame:
    """Relationship states from changes in narrative order.

    ``changes``: ``(version_id, source_id, relation_type, target_id, chunk_ordinal, position, change, event_id)``, in one
    place the smaller event first.  Gives ``(version_id, source_id, relation_type, target_id, state_no, status,
    start_event_id, end_event_id)``: a relationship that has ended is opened anew as the next state unless the same event
    ends it again; the first start event stays.
    """
    keys = ["version_id", "source_id", "relation_type", "target_id"]
    order = Window.partitionBy(*keys).orderBy("chunk_ordinal", "position", "event_id")
    before, last = F.lag("change").over(order), F.lag("event_id").over(order)
    again = (F.col("change") == "ended") & F.col("event_id").eqNullSafe(last)
    opens = before.isNull() | ((before == "ended") & ~again)
    states = changes.withColumn("__opens", F.coalesce(opens, F.lit(False)).cast("int")).withColumn("state_no", F.sum("__opens").over(order).cast("int"))
    place = F.struct("chunk_ordinal", "position", "event_id")
    at = lambda change: F.when((F.col("change") == change) & F.col("event_id").isNotNull(), place)
    ended = F.bool_or(F.coalesce(F.col("change") == "ended", F.lit(False)))
    return states.groupBy(*keys, "state_no").agg(
        F.when(ended, "ended").otherwise("active").alias("status"), F.min(at("started")).getField("event_id").alias("start_event_id"), F.max(at("ended")).getField("event_id").alias("end_event_id")
    )


def lost_coverage(prior: DataFrame, current: DataFrame) -> DataFrame:
    """Chunks ``(version_id, chunk_id)`` that an earlier run covered and this one does not; a rebuild may only publish without any."""
    return prior.join(current, ["version_id", "chunk_id"], "left_anti")


def superseded(facts: DataFrame, newest: DataFrame) -> DataFrame:
    """``facts`` with ``status`` superseded for every run but the newest of its version."""
    last = newest.select("version_id", F.col("run_id").alias("__run"))
    return facts.join(last, "version_id", "left").withColumn("status", F.when(F.col("run_id") == F.col("__run"), "active").otherwise("superseded")).drop("__run")
