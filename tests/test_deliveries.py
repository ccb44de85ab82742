import hashlib

from foliant.operators import deliveries as D
from foliant.operators import relational as L
from tests.helpers import at, frame, rows

CHAPTER = "id string, manuscript_version_id string, ordinal int, title string, text string, content_hash string, loaded_at timestamp, chapter_text string, version_id int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_latest_chapters(spark):
    given = [
        ("a", "v", 1, "zz", "zz old", None, at(1), "", 0), ("a", "{V}", 2, "aa", "aa new", None, at(2), "", 0), ("a", "{V}", 2, "aa", "aa new", None, at(2), "", 0),  # the later holds whole, though its values are smaller
        ("b", "v", 1, None, "text", None, at(1), "", 0), ("b", "v", 1, None, None, " SHA256:" + digest("text").upper(), at(3), "", 0),  # an earlier text for a later digest
        ("c", "v", 1, "t", None, digest("lost"), at(1), "", 0),  # nobody has the text
        ("d", None, None, None, None, None, None, "", 0),
    ]
    expected = [("a", "v", 2, "aa", "aa new"), ("b", "v", 1, None, "text"), ("c", "v", 1, "t", None), ("d", None, None, None, None)]
    assert rows(D.latest_chapters(frame(spark, CHAPTER, given))) == expected
    assert D.latest_chapters(frame(spark, CHAPTER, [])).count() == 0


def test_newest_rows_are_whole(spark):
    df = frame(spark, "id string, at int, a string, b string", [("x", 1, "z", "z"), ("x", 2, "a", None), ("y", None, None, None)])
    assert rows(D.newest_rows(df, "id", "at", "a", "b")) == [("x", 2, "a", None), ("y", None, None, None)]


def test_recent_rows_cross_cells(spark):
    df = frame(spark, "g string, k int, x int", [("a" if i < 40 else "b" if i < 45 else None, i, 0) for i in range(60)]).repartition(5)
    from pyspark.sql import functions as F

    found = {r.k: (r.g, r.last) for r in L.recent(df, ["g"], ["k"], 3, F.col("k"), "last", cell=7).collect()}
    start = {"a": 0, "b": 40, None: 45}
    assert len(found) == 60 and all(last == list(range(max(start[g], k - 3), k)) for k, (g, last) in found.items())
    assert L.recent(df.limit(0), ["g"], ["k"], 3, F.col("k"), "last").count() == 0
