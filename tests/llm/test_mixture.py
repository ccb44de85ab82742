import pytest

from foliant.llm import mixture as M
from foliant.shared import Workspace
from tests.helpers import frame


def test_rates():
    rates = {r[0]: r[5] for r in M.repetition_rates([("a", 0.5, 2, 10, 100), ("b", 0.5, 1, 10, 100), ("c", 0.0, 5, 1, 10), ("d", 0.2, 5, 0, 0)], 200)}
    assert rates == {"a": 1.0, "b": 1.0, "c": 0.0, "d": 0.0}
    rates = {r[0]: r[5] for r in M.repetition_rates([("a", 0.5, 3, 1, 10), ("b", 0.25, 9, 1, 100), ("c", 0.25, 9, 1, 50)], 400)}
    assert rates["a"] == 3.0 and rates["b"] * 100 == pytest.approx(185) and rates["c"] * 50 == pytest.approx(185)
    assert all(r[5] == r[2] for r in M.repetition_rates([("a", 1.0, 2, 1, 10)], 1000))
    assert M.repetition_rates([], 100) == []


def mixed(spark, docs, targets):
    counted = M.counted_documents(frame(spark, "doc_id long, source string, text string, rate double, n_tokens int", [(*d, 9.0, 1) for d in docs]), Workspace(spark, "t"))
    rates = M.source_rates(counted, frame(spark, "source string, target_share double, max_repeats int, extra string", [(*t, "x") for t in targets]))
    mix = M.mixture(counted, rates)
    return mix.collect(), {r.source: r for r in M.mixture_report(mix, rates).collect()}


def test_shares_are_reached(spark):
    docs = [(i, ("Alpha ", "ALPHA", "beta")[i % 3], f"one two three four {i % 10}") for i in range(3000)]
    docs += [(9001, None, "x"), (9002, "unlisted", "x"), (9003, "beta", None), (9004, "beta", "")]
    uses, report = mixed(spark, docs, [("alpha", 0.3, 4), ("beta", 0.6, 4), ("gone", 0.1, 3)])
    assert report["beta"].reached_share == pytest.approx(2 / 3, abs=0.02) and report["alpha"].reached_share == pytest.approx(1 / 3, abs=0.02)
    assert report["gone"].rate == 0 and report["gone"].used_docs == 0
    total = sum(r.n_tokens for r in report.values())
    assert sum(u.n_tokens for u in uses) == pytest.approx(total, rel=0.03)
    per = {}
    for u in uses:
        per.setdefault(u.doc_id, []).append(u.copy_no)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in per.values())
    assert {len(c) for d, c in per.items() if d % 3 == 2} <= {2, 3} and 9001 not in per and 9002 not in per
    again, _ = mixed(spark, docs[::-1], [("beta", 0.6, 4), ("gone", 0.1, 3), ("alpha", 0.3, 4)])
    assert sorted(uses) == sorted(again)


def test_documents_without_an_id_draw_apart(spark):
    uses, report = mixed(spark, [(None, "a", f"one two {i}") for i in range(400)] + [(i, "b", f"one two {i}") for i in range(400)], [("a", 0.75, 4), ("b", 0.25, 4)])
    assert report["a"].reached_share == pytest.approx(0.75, abs=0.03)


def test_caps_and_dirt(spark):
    uses, report = mixed(spark, [(1, "a", "x y z"), (2, "b", "x y z " * 50), (2, "b", "x y z " * 50)], [("a", 0.9, 2), ("b", 0.1, 5), ("c", None, None), (None, 1.0, 1), ("a", -1.0, None)])
    assert report["a"].most_uses == 2 and sum(u.doc_id == 1 for u in uses) == 2 and report["c"].rate == 0


def test_empty(spark):
    uses, report = mixed(spark, [], [("a", 1.0, 2)])
    assert uses == [] and report["a"].reached_share == 0
    assert mixed(spark, [(1, "a", "x")], []) == ([], {})
