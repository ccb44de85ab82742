import pytest
from pyspark.sql import functions as F

from foliant.operators import checks as C
from foliant.operators import evaluation as V
from foliant.operators import relational as L
from tests.helpers import frame, rows


def test_numbering_and_shards(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    assert all(r.k == r.ordinal for r in L.numbered(df, "k").collect())
    assert sorted(r.k for r in L.shard(df, 4, 1, "k").collect()) == list(range(1, 1000, 4))
    assert L.numbered(df.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        L.shard(df, 4, 4, "k")


def test_picked(spark):
    df = frame(spark, "k int, v string", [(1, "a"), (2, "b"), (3, "c"), (3, "d")])
    assert [(r.position, r.v) for r in L.picked(df, "k", [2, 1]).orderBy("position").collect()] == [(0, "b"), (1, "a")]
    for wanted in ([9], [3]):
        with pytest.raises(Exception):
            L.picked(df, "k", wanted).collect()
    with pytest.raises(ValueError):
        L.picked(df, "k", [1, 1])


def test_lookups(spark):
    df = frame(spark, "s string, name string, id string", [("x", "anna", "1"), ("x", "anna", "1"), ("x", "bob", "2"), ("x", "bob", "3"), ("y", "bob", "4"), ("y", None, "5")])
    assert rows(L.unique_lookup(df, "name", "id", "s")) == [("x", "anna", "1"), ("y", "bob", "4")]
    spans = "k string, start_offset int, end_offset int"
    probes, held = frame(spark, spans, [("a", 2, 4), ("a", 2, 9), ("b", 2, 4), (None, 1, 2)]), frame(spark, spans, [("a", 0, 5), ("a", 1, 4), ("c", 0, 9)])
    assert rows(L.covered(probes, held, ["k"])) == [("a", 2, 4)]


def test_nearest_rank(spark):
    df = frame(spark, "g int, v double", [(1, float(i)) for i in range(10)] + [(2, 5.0), (2, None)] + [(3, float(i)) for i in range(6)] + [(None, 7.0)])
    assert rows(L.nearest_rank(df, "g", "v", 0.5)) == [(None, 7.0), (1, 4.0), (2, 5.0), (3, 2.0)]


def test_positions_within_groups(spark):
    df = frame(spark, "g string, k int", [("a", i) for i in range(50)] + [(None, 3), (None, 1), ("b", 9)]).repartition(5)
    found = {(r.g, r.k): r.ordinal for r in L.numbered_within(df, ["g"], ["k"]).collect()}
    assert found == {("a", i): i for i in range(50)} | {(None, 1): 0, (None, 3): 1, ("b", 9): 0}
    assert L.numbered_within(df.limit(0), ["g"], ["k"]).count() == 0


def test_few_of_each(spark):
    df = frame(spark, "g string, v string", [("a", x) for x in "dcbaab"] + [("b", "z")])
    assert [(r.g, r.vs) for r in L.few_of_each(df, ["g"], "v", 3, "vs").orderBy("g").collect()] == [("a", ["a", "b", "c"]), ("b", ["z"])]


@pytest.mark.parametrize("empty,expected", [("agree", (1.0, 1.0, 1.0)), ("zero", (0.0, 0.0, 0.0)), ("null", (None, None, 0.0))])
def test_empty_conventions(spark, empty, expected):
    row = spark.range(1).select(*L.precision_recall(F.lit(0), F.lit(0), F.lit(0), empty)).first()
    assert tuple(row) == expected
    assert tuple(spark.range(1).select(*L.precision_recall(F.lit(1), F.lit(2), F.lit(4), empty)).first()) == (0.5, 0.25, 0.333333)


def test_extraction_scores(spark):
    s = "id string, start_offset int, end_offset int, entity_type string"
    compared = V.compared_spans(frame(spark, s, [("a", 0, 4, "x"), ("a", 5, 9, "y"), ("b", 0, 1, "x")]), frame(spark, s, [("a", 0, 4, "x"), ("a", 5, 9, "x"), ("b", 2, 3, "x"), ("a", 0, 4, "x")]))
    assert rows(V.confusion(compared)) == [("__none__", "x", 1), ("x", "__missing__", 1), ("x", "x", 1), ("y", "x", 1)]
    r = V.extraction_scores(compared, "zero").first()
    assert (r.tp, r.predicted, r.expected, r.precision, r.recall, r.type_accuracy) == (1, 3, 3, 0.333333, 0.333333, 0.5)
    assert rows(V.recall_by_type(compared)) == [("x", 2, 0.5), ("y", 1, 0.0)]


def test_resolution_and_set_scores(spark):
    r = V.resolution_scores(frame(spark, "expected string, candidate string, error string", [("merge", "merge", None), ("merge", "keep_separate", None), ("keep_separate", "merge", None), ("merge", "merge", "E"), (None, "needs_review", None)])).first()
    assert (r.precision, r.recall, r.incorrect_merges, r.decision_accuracy, r.review_rate, r.error_rate) == (0.5, 0.333333, 1, 0.2, 0.2, 0.2)
    k = "kind string, k string"
    found = V.set_scores(frame(spark, k, [("f", "1"), ("f", "2"), ("e", "1")]), frame(spark, k, [("f", "1"), ("g", "1")]), "kind", "k")
    assert rows(found) == [("e", 0.0, 0.0, 0.0), ("f", 0.5, 1.0, 0.666667), ("g", 0.0, 0.0, 0.0)]
    assert V.macro_f1(found).first().macro_f1 == 0.222222
    assert tuple(V.link_scores(frame(spark, k, []), frame(spark, k, []), ["kind", "k"]).first()) == (1.0, 0.0)
    assert tuple(V.boundary_scores(frame(spark, k, [("a", "1")]), frame(spark, k, []), ["kind", "k"]).first()) == (0, 1, 0, 0.0, None, 0.0)


def test_located_references(spark):
    df = frame(spark, "text string, ref struct<text:string,occurrence:int>", [("Anna, Annabel and Anna.", ("Anna", 1)), ("Anna, Annabel and Anna.", ("Anna", 2)), ("Anna", ("Anna", None)), ("a.b", ("a.b", 0)), (None, ("x", 0))])
    assert [r.v for r in df.select(V.located(df, "ref").alias("v")).collect()] == [18, None, 0, 0, None]


def test_checks(spark):
    df = frame(spark, "id int, text string, start_offset int, end_offset int, parent int", [(1, "abc", 0, 3, 1), (1, "abc", 2, 9, 2), (2, None, -1, None, None), (3, "x", 4, 4, 7)])
    assert dict(rows(C.violations(df, C.span_rules()))) == {"start_not_negative": 1, "end_after_start": 1, "length_is_span": 2, "text_present": 1}
    assert rows(C.repeated(df, ["id"])) == [(1, 2)]
    assert [r.id for r in C.orphans(df, frame(spark, "pid int", [(1,), (2,)]), "parent", "pid").collect()] == [3]
