import random

from foliant.llm.components import connected_components, merged_groups
from foliant.shared import Workspace
from tests.helpers import at, frame, rows

ANSWER = "id string, left_mention_id string, right_mention_id string, applied_decision string, created_at timestamp, src string, node int"
MENTION = "id string, component string"


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {x: find(x) for x in parent}


def components(spark, edges):
    df = frame(spark, "src string, dst string, lo string", [(a, b, "x") for a, b in edges])
    return {r.node: r.component for r in connected_components(df, Workspace(spark, "t")).collect()}


def test_empty_and_loops(spark):
    assert components(spark, []) == {}
    assert components(spark, [("a", "a"), (None, "b"), ("b", None)]) == {}


def test_chain_hub_and_repeats(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)]
    random.Random(1).shuffle(chain)
    hub = [("hub", f"leaf{i}") for i in range(300)]
    edges = chain + hub + [("b", "a"), ("a", "b"), ("a", "b")]
    assert components(spark, edges) == brute(edges)


def test_random_graphs(spark):
    rng = random.Random(7)
    edges = [(f"v{rng.randint(0, 400)}", f"v{rng.randint(0, 400)}") for _ in range(330)]
    assert components(spark, edges) == brute(edges)


def test_answers(spark):
    mentions = frame(spark, MENTION, [(m, "x") for m in "abcdefg"] + [("a", "x"), (None, None)])
    answers = frame(spark, ANSWER, [
        ("1", "b", " {A} ", " Merge ", at(0), "", 0), ("1", "b", " {A} ", " Merge ", at(0), "", 0), ("2", "b", "c", "merge", at(0), "", 0), ("3", "c", "b", "keep_separate", at(1), "", 0),
        ("4", "d", "e", None, at(0), "", 0), ("5", "E", "d", "MERGE", at(1), "", 0), ("6", "f", "unknown", "merge", at(0), "", 0), ("7", "g", None, "merge", at(0), "", 0),
        ("8", "g", "g", "merge", at(0), "", 0), ("9", "f", "g", "merge", None, "", 0), ("10", "g", "f", "keep_separate", None, "", 0), ("11", "a", "", "merge", at(0), "", 0),
    ])
    assert rows(merged_groups(answers, mentions)) == [("a", "a"), ("b", "a"), ("d", "d"), ("e", "d"), ("f", "f"), ("g", "f")]
    assert rows(merged_groups(answers.limit(0), mentions)) == [] == rows(merged_groups(answers, mentions.limit(0)))
