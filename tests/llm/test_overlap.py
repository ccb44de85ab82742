import random

import numpy as np
import pytest

from foliant.llm import overlap as O
from tests.helpers import frame, rows

RECORD = "id string, split string, source string, text string, key int, words int, gram string"


def records(spark, given):
    return frame(spark, RECORD, [(*r, 1, 2, "x") for r in given])


def found(spark, given):
    return {(r.eval_id, r.train_id, r.exact) for r in O.split_overlaps(records(spark, given)).collect()}


def test_word_distance_against_dynamic_programme():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 80))] for _ in range(2))
        assert O.word_distance(a, b) == plain(a, b)


def test_needed_grams_are_enough():
    """No edits that a partner may have destroy as many grams as a text shows."""
    rng = random.Random(2)
    for n in [*range(1, 120), 300]:
        low, high = O.reach_of(n)
        for m in range(max(low, 1), high + 1):
            d = O.allowed(n, m)
            if abs(m - n) > d or d == 0:
                continue
            assert 0 < O.needed(n) <= n - O.GRAM + 1
            for _ in range(5):
                words = list(range(n))  # all grams differ
                changed = set(rng.sample(range(n), max(d - abs(m - n), 0)))
                kept = [(-1, i)[i not in changed] for i in words]
                for _ in range(abs(m - n)):
                    at = rng.randrange(len(kept) + (m > n))
                    kept[at : at + (m < n)] = [-2] if m > n else []
                shared = {tuple(kept[i : i + O.GRAM]) for i in range(len(kept))} & {tuple(words[i : i + O.GRAM]) for i in range(n - O.GRAM + 1)}
                assert n - O.GRAM + 1 - len(shared) < O.needed(n)


def test_frequent_grams_meet_in_a_cell():
    """A gram of an evaluation text has the cell of every partner that may have it, and no cell twice."""
    assert all(O._stretch(np.array([m]))[0] >= k > O._stretch(np.array([m - 1]))[0] for k, m in enumerate(O._FIRST.tolist()) if k)
    gram = np.array([77], np.uint64)
    for n in [6, 7, 13, 50, 51, 400]:
        low, high = O.reach_of(n)
        for at in {0, 1, n // 2, n - 2}:
            keys = O._cells(gram, np.array([at]), np.array([n]), "eval")[0].tolist()
            assert len(keys) == len(set(keys))
            for m in range(low, high + 1):
                d = O.allowed(n, m)
                for there in range(max(at - d, 0), min(at + d, m - 2) + 1):
                    if abs(n - m) <= d:
                        assert O._cells(gram, np.array([there]), np.array([m]), "train")[0][0] in keys


def test_states(spark):
    base = " ".join(f"word{i}" for i in range(14))
    given = [
        ("t1", "train", "a", base), ("t1", "train", "a", base), ("t2", "Train ", "b", base.upper().replace(" ", "  ") + "!"), ("e1", "test", "a", base + "."),
        ("e2", "dev", "b", base.replace("word3", "other").replace("word9", "changed")), ("e3", "dev", "b", base.replace("word3", "x").replace("word9", "y").replace("word1 ", "z ")),
        ("e4", "test", "a", None), ("e5", "test", "a", ""), ("e6", "test", "a", "…"), ("t3", "train", "a", None), ("t4", "train", "a", ""), ("n", None, "a", base),
        ("e7", "test", "a", "short text"), ("t5", "train", "b", "Short, text"), ("e8", "test", "a", "tiny one"),
    ]
    assert found(spark, given) == {("e1", "t1", True), ("e1", "t2", True), ("e2", "t1", False), ("e2", "t2", False), ("e7", "t5", True)}
    report = {(r.eval_split, r.eval_source, r.train_source): (r.overlapping_records, r.pairs, r.exact_pairs, r.eval_records) for r in O.overlap_report(records(spark, given)).collect()}
    assert report[("test", "a", "b")] == (2, 2, 2, 3) and report[("dev", "b", "a")] == (1, 1, 0, 2)


def test_empty(spark):
    assert found(spark, []) == set()
    assert found(spark, [("t", "train", "a", "some text")]) == set()


@pytest.mark.parametrize("frequent", [O.FREQUENT, 3])
def test_no_link_is_lost(spark, monkeypatch, frequent):
    """All pairs by brute force, over texts of few words that share much, with edits of all kinds; one text is very long."""
    monkeypatch.setattr(O, "FREQUENT", frequent)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    given = [(f"t{i}", "train", "a", " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(80)]
    given.append(("t-long", "train", "a", " ".join(rng.choices(vocabulary, k=5000))))
    for i in range(160):
        words = rng.choice(given[:81])[3].split()
        for _ in range(rng.randint(0, len(words) // 6 + 1)):
            at = rng.randrange(len(words))
            kind = rng.random()
            if kind < 0.4:
                words[at] = rng.choice(vocabulary)
            elif kind < 0.7 and len(words) > 1:
                del words[at]
            else:
                words.insert(at, rng.choice(vocabulary))
        given.append((f"e{i}", "test", "b", " ".join(words)))
    texts = {r[0]: r[3].split() for r in given}
    expected = set()
    for e in (k for k in texts if k[0] == "e"):
        for t in (k for k in texts if k[0] == "t"):
            if abs(len(texts[e]) - len(texts[t])) <= O.allowed(len(texts[e]), len(texts[t])) and O.word_distance(texts[e], texts[t]) <= O.allowed(len(texts[e]), len(texts[t])):
                expected.add((e, t, texts[e] == texts[t]))
    assert len(expected) > 50 and found(spark, given) == expected
