import itertools
import random

import pytest

from foliant.llm import names as N
from foliant.shared import Workspace
from tests.helpers import at, frame, rows

FORMS = [("William", "Bill"), ("Elizabeth", "Beth"), ("Richard", "Dick"), ("Richard", "Rick")]
NAME = "entity_id string, block string, kind string, name string, node long, canon int"


def named(spark, given, kind="character"):
    return frame(spark, NAME, [(e, b, kind, n, 0, 0) for e, b, names in given for n in (names or [None])])


def clusters(spark, given, kind="character"):
    found = {}
    for r in N.linked_entities(named(spark, given, kind), FORMS).collect():
        found.setdefault((r.block, r.cluster_id), set()).add(r.entity_id)
    return sorted(sorted(s) for s in found.values())


def test_tokens():
    assert N.name_tokens("Dr. Élizabeth O'Neil") == ("elizabeth", "oneil")
    assert N.name_tokens("Neil, Elizabeth R.") == N.name_tokens("Elizabeth R. Neil") == ("elizabeth", "neil")
    assert N.name_tokens("R. Neil") == ("neil", "r")
    assert N.name_tokens("A. Neil") == ("a", "neil")
    assert N.name_tokens("Doctor") == ("doctor",)
    assert N.name_tokens("…") == () == N.name_tokens(None)


@pytest.mark.parametrize("a,b,most,d", [("abc", "abc", 1, 0), ("abc", "acb", 1, 1), ("abcd", "abd", 2, 1), ("abcd", "xxxx", 2, 3), ("", "ab", 2, 2)])
def test_edits(a, b, most, d):
    assert N.edits(a, b, most) == N.edits(b, a, most) == d


def test_people(spark):
    given = [
        ("1", "v", ["William Thornbridge", "william thornbridge"]), ("2", "v", ["Bill Thornbridge"]), ("3", "v", ["Thornbrigde, William"]), ("4", "v", ["W. Thornbridge"]), ("5", "v", ["Judge Thornbridge"]),
        ("6", "v", ["Margaret Fallowmere"]), ("7", "v", ["Fallowmere Margaret", None]), ("8", "v", ["Margaret Stonecastle"]), ("9", "v", ["Thomas Fallowmere"]), ("10", "v", []), ("11", "v", ["", "  "]),
        ("12", "w", ["William Thornbridge"]), ("6", "v", ["Margaret Fallowmere"]),
    ]
    assert clusters(spark, given) == [["1", "2", "3", "4", "5"], ["12"], ["6", "7"], ["8"], ["9"]]


def test_organizations(spark):
    given = [
        ("1", "v", ["Harrow Millbank Trading Company"]), ("2", "v", ["the Harrow-Millbank Trading Co."]), ("3", "v", ["Trading Company of Harrow Millbank"]), ("4", "v", ["H. Millbank Trading Company"]),
        ("5", "v", ["HARROW & MILLBANK TRADING"]), ("6", "v", ["Harrow Eastgate Trading Company"]), ("7", "v", ["Harrow Millbank Savings Bank"]),
    ]
    assert clusters(spark, given, "organization") == [["1", "2", "3", "4", "5"], ["6"], ["7"]]


def test_empty_long_and_equal(spark):
    assert clusters(spark, []) == []
    long = "x" * 20_000
    many = [(str(i), "v", ["Anna Bellweather"]) for i in range(60)]
    found = clusters(spark, many + [("a", "v", [long]), ("b", "v", [long]), ("c", "v", ["名前 太郎"]), ("d", "v", ["名前 太郎"])])
    assert sorted(map(len, found)) == [2, 2, 60]


def test_large_components_lose_no_link(spark, monkeypatch):
    given = [("1", "v", ["William Thornbridge"]), ("2", "v", ["William Thornbrige", "Will Thornbridge"]), ("3", "v", ["W. Thornbridge"]), ("4", "v", ["Bill Thornbridge", "B. T."]), ("5", "v", ["Anna Bellweather"]), ("6", "v", ["Thornbridge William"]), ("7", "v", ["Wiliam Thornbridge"])]
    monkeypatch.setattr(N, "LARGEST_COMPONENT", 3)
    assert clusters(spark, given) == [["1", "2", "3", "4", "6", "7"], ["5"]]


def test_a_form_of_two_bearers_does_not_join_them(spark):
    """An initial, a family name alone and a short form of two given names stand between two bearers, who stay apart."""
    forms = [("Christopher", "Chris"), ("Christina", "Chris")]
    for between in ("C. Thornbridge", "Thornbridge", "Chris Thornbridge"):
        given = [("1", "v", ["Christopher Thornbridge"]), ("2", "v", [between]), ("3", "v", ["Christina Thornbridge"])]
        found = {r.entity_id: r.cluster_id for r in N.linked_entities(named(spark, given), forms).collect()}
        assert found["1"] != found["3"] and found["2"] in (found["1"], found["3"]), between


def test_cosine_join_against_all_pairs(spark):
    """Brute force over all pairs of a block: every pair at the threshold whose tokens agree comes out, once."""
    rng = random.Random(3)
    parts = ["thorn", "bridge", "fallow", "mere", "stone", "castle", "mill", "bank", "ham", "ton"]
    names = sorted({f"{rng.choice(('anna', 'anne', 'a'))} {rng.choice(parts)}{rng.choice(parts)}" for _ in range(150)})
    counted = frame(spark, "name_id long, block string, kind string, canon string", [(i, "v", "character", n) for i, n in enumerate(names)] + [(1000 + i, "w", "character", n) for i, n in enumerate(names[:5])])
    common = N.common_tokens(counted, {})
    assert {"anna", "anne", "a"} <= common
    idf = N._document_frequencies(counted, {}, common)
    vectors = [dict(zip(*(x.tolist() for x in N.weighted(N.gram_buckets(tuple(n.split()), {}, common), idf)))) for n in names]
    for least in (0.1, 0.5):
        expected = set()
        for i, j in itertools.combinations(range(len(names)), 2):
            value = sum(v * vectors[j].get(k, 0.0) for k, v in vectors[i].items())
            assert abs(value - least) > 1e-6
            if value >= least and N.likeness(tuple(names[i].split()), tuple(names[j].split()), {}, False) > 0:
                expected.add((i, j))
        found = [(r.a, r.b) for r in N.similar_names(counted, {}, Workspace(spark, "t"), least).collect()]
        assert len(found) == len(set(found)) and {p for p in found if p[0] < 1000} == expected and all((a < 1000) == (b < 1000) for a, b in found)


def test_cosine_join_with_uncut_vectors(spark):
    """Pairs whose cosine comes in part from the commonest n-grams are found too."""
    rng = random.Random(5)
    parts = ["thorn", "bridge", "fallow", "mere", "stone", "castle", "mill", "bank"]
    names = sorted({f"{rng.choice(('sarah', 'anna'))} {rng.choice(parts)}{rng.choice(parts)}" for _ in range(60)} | {"k sarah", "a anna"})
    counted = frame(spark, "name_id long, block string, kind string, canon string", [(i, "v", "character", n) for i, n in enumerate(names)])
    forms = {"sarah": frozenset({"sarah"}), "anna": frozenset({"anna"})}
    common = N.common_tokens(counted, forms)
    idf = N._document_frequencies(counted, forms, common)
    vectors = []
    for n in names:
        counts = N.gram_buckets(tuple(n.split()), forms, common)
        raw = {g: c * idf[g] * (1.0 if g < N.BUCKETS else N.COMMON_WEIGHT) for g, c in counts.items()}
        norm = sum(v * v for v in raw.values()) ** 0.5
        vectors.append({g: v / norm for g, v in raw.items()})
    expected = set()
    for i, j in itertools.combinations(range(len(names)), 2):
        value = sum(v * vectors[j].get(g, 0.0) for g, v in vectors[i].items())
        if value >= N.MIN_COSINE and N.likeness(tuple(names[i].split()), tuple(names[j].split()), forms, False) > 0:
            expected.add((i, j))
    assert {(r.a, r.b) for r in N.similar_names(counted, forms, Workspace(spark, "t")).collect()} == expected


def test_average_linkage():
    assert N.average_linkage({1: 1, 2: 1, 3: 1}, {(1, 2): 0.9, (2, 3): 0.8}, 0.5) == {1: 1, 2: 1, 3: 3}
    assert N.average_linkage({1: 1, 2: 1, 3: 1}, {(1, 2): 0.9, (2, 3): 0.8, (1, 3): 0.4}, 0.5) == {1: 1, 2: 1, 3: 1}
    assert N.average_linkage({1: 5, 2: 1, 3: 1}, {(1, 2): 0.9, (2, 3): 0.95}, 0.5) == {1: 1, 2: 2, 3: 2}
    assert N.average_linkage({1: 1}, {}, 0.5) == {1: 1}


@pytest.mark.parametrize("seed,values", [(1, None), (3, (0.4, 0.54, 0.6, 0.825, 0.875, 0.9, 1.0))])
def test_large_components_are_clustered_like_small_ones(spark, monkeypatch, seed, values):
    """The plain average linkage over all nodes at once; the components are larger than what a task takes."""
    monkeypatch.setattr(N, "LARGEST_COMPONENT", 10)
    rng = random.Random(seed)
    weights = {i * 7 % 30 - 10: rng.choice((1, 1, 2, 5)) for i in range(30)}
    groups = {n: rng.randrange(2) for n in weights}
    sims = {(a, b): rng.choice(values) if values else rng.random() for a, b in itertools.combinations(sorted(weights), 2) if rng.random() < (0.5 if groups[a] == groups[b] else 0.05)}
    nodes = frame(spark, "node long, weight long", list(weights.items()))
    edges = frame(spark, "src long, dst long, sim double", [(b, a, s) if rng.random() < 0.5 else (a, b, s) for (a, b), s in sims.items()])
    found = {n: n for n in weights} | {r.node: r.cluster for r in N._clusters(nodes, edges, Workspace(spark, "t"), 0.5).collect()}
    assert found == N.average_linkage(weights, sims, 0.5)


def test_only_entities_under_review(spark):
    entities = frame(spark, "id string, manuscript_version_id string, entity_type string, canonical_name string, status string, updated_at timestamp, name string", [
        ("a", "v", "character", "William Thornbridge", "active", at(0), ""), ("a", "v", "character", None, "needs_review", at(1), ""), ("b", "V ", "character", "Bill Thornbridge", "needs_review", at(0), ""),
        ("c", "v", "location", "William Thornbridge", "needs_review", at(0), ""), ("d", "v", "character", "William Thornbridge", "merged", at(0), ""), ("e", "w", "character", "William Thornbridge", "needs_review", at(0), ""),
    ])
    aliases = frame(spark, "id string, entity_id string, alias string, normalized_alias string", [("1", "A", "Thornbridge, William", None), ("2", None, "x", "y")])
    mentions = frame(spark, "id string, entity_id string, surface_text string, block string", [("m", "b", "Mr Bill Thornbridge", ""), ("n", None, "Anna", ""), ("o", "b", None, "")])
    pairs = N.linked_pairs(N.linked_entities(N.review_names(entities, aliases, mentions), FORMS))
    assert pairs.columns == ["left_entity_id", "right_entity_id"]
    assert rows(pairs) == [("a", "b")]
