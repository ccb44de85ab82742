"""Calls to generative and span models as table operators: propose, check, ask once more.

A client turns a prompt into JSON text and may be any picklable factory; what it returns is checked here, so only
well-formed answers leave these operators.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.mentions import expand_surfaces
from foliant.operators.models import Client, complete_rows
from foliant.operators.structure import TOKEN

#: Entity types and decisions.
ENTITY_TYPES = ("character", "facility", "gpe", "location", "organization", "vehicle")
DECISIONS = ("merge", "keep_separate", "needs_review")
WINDOW_TOKENS = 800


class SpanModel(Protocol):
    """A span extractor: for a text, (surface, type, start, end) of what it found."""

    def spans(self, text: str) -> list[tuple[str, str, int, int]]: ...


class Clusterer(Protocol):
    """A coreference model: for a window's tokens, clusters of (first, last) token positions."""

    def clusters(self, tokens: list[str]) -> list[list[tuple[int, int]]]: ...


def _parsed(raw: str) -> dict:
    try:
        found = json.loads(raw)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def accepted_mentions(raw: str) -> str | None:
    """The answer if its ``mentions`` are a list of objects with a surface and a known type, else null."""
    listed = _parsed(raw).get("mentions")
    if not isinstance(listed, list):
        return None
    good = all(isinstance(m, dict) and isinstance(m.get("surface_text"), str) and m["surface_text"] and m.get("entity_type") in ENTITY_TYPES for m in listed)
    return raw if good else None


def extracted_mentions(chunks: DataFrame, make: Callable[[], Client], prompt: str = "List the entities of this passage as JSON.") -> DataFrame:
    """``(chunk_id, surface_text, entity_type, start_offset, end_offset, found)`` for chunks ``(chunk_id, text)``.

    A badly formed answer is asked for once more; a chunk that still has none gives no rows.
    """
    asked = chunks.where("text is not null").select(F.col("chunk_id").alias("id"), F.concat_ws("\n", F.lit(prompt), "text").alias("prompt"))
    answers = complete_rows(asked, make, accepted_mentions).where("answer is not null")
    listed = F.explode(F.from_json(F.get_json_object("answer", "$.mentions"), "array<struct<surface_text:string,entity_type:string>>")).alias("m")
    named = answers.select(F.col("id").alias("chunk_id"), listed).select("chunk_id", "m.surface_text", "m.entity_type")
    return expand_surfaces(named.join(chunks.select("chunk_id", "text"), "chunk_id"))


def model_spans(chunks: DataFrame, make: Callable[[], SpanModel]) -> DataFrame:
    """``(chunk_id, surface_text, entity_type, start_offset, end_offset, valid)`` of a span model; ``valid`` says whether the
    span is inside the text, holds its surface and has a known type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            rows = []
            for chunk, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                for surface, kind, a, b in dict.fromkeys(model.spans(text)):
                    rows.append((chunk, surface, kind, a, b, kind in ENTITY_TYPES and 0 <= a < b <= len(text) and text[a:b] == surface))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk_id", "surface_text", "entity_type", "start_offset", "end_offset", "valid"])

    return chunks.where("text is not null").select("chunk_id", "text").mapInArrow(run, "chunk_id string, surface_text string, entity_type string, start_offset int, end_offset int, valid boolean")


def accepted_decision(left: str, right: str) -> Callable[[str], str | None]:
    """The check of one pair's answer: a known decision, cited ids of the pair only and once, both for a decision."""

    def accept(raw: str) -> str | None:
        said = _parsed(raw)
        cited = said.get("evidence_ids")
        if said.get("decision") not in DECISIONS or not isinstance(cited, list) or len(set(map(str, cited))) != len(cited) or not set(cited) <= {left, right}:
            return None
        return raw if said["decision"] == "needs_review" or {left, right} <= set(cited) else None

    return accept


def decided_pairs(pairs: DataFrame, make: Callable[[], Client], attempts: int = 2) -> DataFrame:
    """``(id, decision, evidence_ids, repairs, error)`` for pairs ``(id, left_evidence, right_evidence, prompt)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        for batch in batches:
            rows = []
            for key, left, right, prompt in zip(*(batch.column(i).to_pylist() for i in range(4))):
                accept, said, tries, good = accepted_decision(left, right), prompt or "", 0, None
                while good is None and tries < attempts:
                    raw = client.complete(said)
                    good, tries = accept(raw), tries + 1
                    said = f"{prompt}\nThis answer was refused:\n{raw}"
                answer = _parsed(good) if good else {}
                rows.append((key, answer.get("decision"), answer.get("evidence_ids", []), tries - 1, None if good else "INVALID_OUTPUT"))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "decision", "evidence_ids", "repairs", "error"])

    return pairs.select("id", "left_evidence", "right_evidence", "prompt").mapInArrow(run, "id string, decision string, evidence_ids array<string>, repairs int, error string")


def coreference_memberships(chapters: DataFrame, make: Callable[[], Clusterer], window: int = WINDOW_TOKENS) -> DataFrame:
    """``(chapter_id, span, start_offset, end_offset, cluster)`` for chapters ``(chapter_id, chapter_text)``.

    The model sees ``window`` tokens at a time; clusters are named by window and spans by their code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            rows = []
            for chapter, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                places = [m.span() for m in TOKEN.finditer(text)]
                for w, first in enumerate(range(0, len(places), window)):
                    part = places[first : first + window]
                    for c, cluster in enumerate(model.clusters([text[a:b] for a, b in part])):
                        for i, j in cluster:
                            if not 0 <= i <= j < len(part):
                                raise ValueError("a cluster's span is outside its window")
                            a, b = part[i][0], part[j][1]
                            rows.append((chapter, f"{a}-{b}", a, b, f"{w}:{c}"))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chapter_id", "span", "start_offset", "end_offset", "cluster"])

    return chapters.where("chapter_text is not null").select("chapter_id", "chapter_text").mapInArrow(run, "chapter_id string, span string, start_offset int, end_offset int, cluster string")


_capital = re.compile(r"[^\W\d_]+")


class CapitalWords:
    """Stand-in for the three kinds of model: capital words that do not begin a sentence are characters."""

    def _found(self, text: str) -> list[tuple[str, int, int]]:
        words = ((m.group(), *m.span()) for m in _capital.finditer(text))
        return [(w, a, b) for w, a, b in words if w[0].isupper() and a > 1 and text[a - 1] == " " and text[a - 2] not in ".!?”\"’'"]

    def complete(self, prompt: str) -> str:
        text = prompt.partition("\n")[2]
        return json.dumps({"mentions": [{"surface_text": w, "entity_type": "character"} for w in dict.fromkeys(w for w, _, _ in self._found(text))]})

    def spans(self, text: str) -> list[tuple[str, str, int, int]]:
        return [(w, "character", a, b) for w, a, b in self._found(text)]

    def clusters(self, tokens: list[str]) -> list[list[tuple[int, int]]]:
        at: dict[str, list[tuple[int, int]]] = {}
        for i, t in enumerate(tokens):
            if t[0].isupper():
                at.setdefault(t, []).append((i, i))
        return [spans for spans in at.values() if len(spans) > 1]


class EqualNames:
    """Stand-in for the decision on a pair: the prompt's two names, equal or not."""

    def complete(self, prompt: str) -> str:
        left, right, a, b = (*prompt.split("\n"), "", "", "")[:4]
        return json.dumps({"decision": "merge" if left.casefold() == right.casefold() else "needs_review", "evidence_ids": list(dict.fromkeys((a, b)))})
