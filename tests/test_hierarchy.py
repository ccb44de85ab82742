import random

import pytest

from foliant.operators import hierarchy as H
from tests.helpers import at, frame, rows

ENTITY = "id string, manuscript_version_id string, merged_into_id string, updated_at timestamp, root string, place string"


def entities(spark, links):
    return frame(spark, ENTITY, [(n, "v", p, at(0), "clash", "clash") for n, p in links])


def brute(links):
    parent = dict(links)
    found = {}
    for n, p in parent.items():
        if not p:
            continue
        seen, x, depth = {n}, n, 0
        while parent.get(x):
            x, depth = parent[x], depth + 1
            if x in seen:
                found[n] = ("cycle", -1)
                break
            seen.add(x)
        else:
            found[n] = (x, depth) if x in parent else ("missing", -1)
    return found


def test_states_of_links(spark):
    df = frame(spark, ENTITY, [
        ("a", "v", None, at(0), "", ""), ("b", "v", " {A} ", at(0), "", ""), ("c", "w", "B", at(0), "", ""), ("c", "w", "B", at(0), "", ""),
        ("d", "v", "", at(0), "", ""), ("e", "v", "e", at(0), "", ""), ("f", "v", "g", at(0), "", ""), ("g", "v", "h", at(0), "", ""), ("h", "v", "g", at(0), "", ""),
        ("i", "v", "nobody", at(0), "", ""), ("j", "v", "i", at(0), "", ""), ("k", "v", "a", at(0), "", ""), ("k", "v", "  ", at(1), "", ""),
        ("l", None, "a", None, None, None), (None, "v", "a", at(0), "", ""),
    ])
    found = {r[0]: tuple(r)[1:] for r in rows(H.entity_roots(df))}
    assert found == {
        "b": ("a", 1), "c": ("a", 2), "e": ("cycle", -1), "f": ("cycle", -1), "g": ("cycle", -1), "h": ("cycle", -1), "i": ("missing", -1), "j": ("missing", -1), "l": ("a", 1),
    }


def test_empty(spark):
    assert rows(H.entity_roots(entities(spark, []))) == []
    assert rows(H.entity_paths(entities(spark, []))) == []


@pytest.mark.parametrize("held", [3, 50, 10**6])
def test_random_forests_in_small_shares(spark, monkeypatch, held):
    """Tasks that hold only a few links force several levels and, with circles, the joins that double."""
    monkeypatch.setattr(H, "FOREST_LINKS", held)
    rng = random.Random(held)
    names = [f"n{i:03d}" for i in range(300)]
    links = []
    for i, n in enumerate(names):
        kind = rng.random()
        links.append((n, None if kind < 0.05 else names[max(i - rng.randint(1, 4), 0)] if kind < 0.9 and i else rng.choice(names) if kind < 0.97 else "nowhere"))
    assert {r.entity_id: (r.root_id, r.depth) for r in H.entity_roots(entities(spark, links)).collect()} == brute(links)


@pytest.mark.parametrize("tree,ids", [(2, 10**6), (10**6, 100), (10**6, 10**6)])
def test_paths_and_descendants(spark, monkeypatch, tree, ids):
    monkeypatch.setattr(H, "TREE_NODES", tree)
    monkeypatch.setattr(H, "PATH_IDS", ids)
    chain = [("n00", None)] + [(f"n{i:02d}", f"n{i - 1:02d}") for i in range(1, 40)] + [("x", "nowhere"), ("y", "y"), ("z", None)]
    paths = H.entity_paths(entities(spark, chain)).collect()
    found = {r.entity_id: r.path for r in paths}
    assert found["n39"] == [f"n{i:02d}" for i in range(40)] and found["z"] == ["z"] and "x" not in found and "y" not in found
    assert all(r.path[0] == r.root_id and len(r.path) == r.depth + 1 for r in paths)
    below = H.entity_descendants(H.entity_paths(entities(spark, chain)))
    assert below.count() == 39 * 40 // 2
    assert below.where("ancestor_id = 'n00' and descendant_id = 'n39'").first().distance == 39


def test_mentions_follow_their_entity(spark):
    roots = H.entity_roots(entities(spark, [("a", None), ("b", "a")]))
    mentions = frame(spark, "id string, entity_id string, loaded_at timestamp", [("m", "B ", at(0)), ("m", "a", at(-1)), ("n", None, at(0)), ("o", "other", at(0))])
    assert rows(H.mention_roots(mentions, roots)) == [("m", "b", "a", 1), ("o", "other", "other", 0)]
