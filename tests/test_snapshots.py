import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import snapshots as S
from foliant.shared import Workspace
from tests.helpers import at, frame, rows

CHAPTER = "id string, manuscript_version_id string, ordinal int, title string, text string, content_hash string, loaded_at timestamp, pair string, bucket int"
VERSION = "id string, project_id string, version_number int, status string, snapshot string"


def digest(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_python_hash_is_sparks(spark):
    values = [0, 1, -1, 7, 2**62, -(2**63), 2**63 - 1]
    df = frame(spark, "a long, b long", [(a, b) for a in values for b in values])
    for a, b, h in df.select("a", "b", F.xxhash64("a", "b")).collect():
        assert S.xxhash64_longs(a, b) == h


def test_changes_of_a_project(spark):
    versions = frame(spark, VERSION, [
        ("v1", "p", 1, "archived", "x"), ("v2", "p", 2, "failed", "x"), ("v4", "p", 4, "ready", "x"), ("v4", "p", 4, "ready", "x"), ("w", "q", 3, "ready", "x"), (None, None, None, None, None),
    ])
    chapters = frame(spark, CHAPTER, [
        ("a", "v1", 1, None, "same", None, at(0), "p", 1), ("b", "v1", 2, None, "old", None, at(0), "p", 1), ("c", "v1", 3, None, "gone", None, at(0), "p", 1),
        ("d", " {V4} ", 1, "new title", None, "SHA256:" + digest("same").upper(), at(0), "p", 1),
        ("e", "v4", 2, None, "old", None, at(0), "p", 1), ("e", "v4", 2, None, "new", None, at(1), "p", 1), ("e", "v4", 2, None, "new", None, at(1), "p", 1),
        ("f", "v4", 9, None, "", None, None, "p", 1),
        ("g", "v2", 1, None, "unfinished", None, at(0), "p", 1), ("h", "w", 1, None, "first", None, at(0), "p", 1),
        ("i", "v4", None, None, "no ordinal", None, at(0), "p", 1), ("j", "v4", 11, None, None, None, at(0), "p", 1), ("k", None, 1, None, "lost", None, at(0), "p", 1),
    ])
    found = S.chapter_changes(chapters, versions)
    assert found.columns == ["project_id", "version_number", "ordinal", "change_kind"]
    assert rows(found) == [("p", 4, 2, "changed"), ("p", 4, 3, "removed"), ("p", 4, 9, "added")]


def test_empty_tables(spark):
    assert rows(S.chapter_changes(frame(spark, CHAPTER, []), frame(spark, VERSION, []))) == []
    versions = frame(spark, VERSION, [("v1", "p", 1, "ready", None), ("v2", "p", 2, "ready", None)])
    assert rows(S.chapter_changes(frame(spark, CHAPTER, []), versions)) == []


@pytest.mark.parametrize("size,changes", [(50, 3), (3000, 40), (3000, 2900)])
def test_against_plain_difference(spark, size, changes):
    """Small and large differences, the last beyond what the first tables hold, so that buckets grow."""
    rng = random.Random(size + changes)
    old = {k: rng.getrandbits(63) for k in range(size)}
    new = dict(old)
    for k in rng.sample(range(size), changes):
        kind = rng.choice("arc")
        if kind == "a":
            new[k + 10**6] = rng.getrandbits(63)
        elif kind == "r":
            del new[k]
        else:
            new[k] = rng.getrandbits(63)
    records = frame(spark, "snapshot string, key long, value long", [("old", *x) for x in old.items()] + [("new", *x) for x in new.items()])
    pairs = frame(spark, "pair string, earlier string, later string", [("x", "old", "new")])
    expected = {k: "added" if k not in old else "removed" if k not in new else "changed" for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
    found = S.snapshot_changes(records, pairs, Workspace(spark, "t"))
    assert {r.key: r.change_kind for r in found.collect()} == expected
    assert found.count() == len(expected)


def test_a_table_that_cannot_be_peeled_is_refused():
    assert S.peel({0: [2, 5, 7, 9]}, 0, 4, 0) is None
    assert S.peel({}, 3, 4, 0) is None
    assert S.peel({}, 0, 4, 0) == []


def test_a_record_twice_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_TURNS", 1)
    records = frame(spark, "snapshot string, key long, value long", [("new", 1, 5), ("new", 1, 5), ("new", 2, 6), ("old", 2, 6)])
    with pytest.raises(ValueError, match="twice"):
        S.snapshot_changes(records, frame(spark, "pair string, earlier string, later string", [("x", "old", "new")]), Workspace(spark, "t"))
