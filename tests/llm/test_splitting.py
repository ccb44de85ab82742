import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import splitting as S
from tests.helpers import at, frame, rows

SCENE = "id string, chapter_id string, ordinal int, text string, start_offset int, end_offset int, scene_id string, piece_no int"
CHAPTER = "id string, text string, content_hash string, loaded_at timestamp, chapter_text string"


def check(text, limit, overlap):
    pieces = S.cuts(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 <= e - s <= limit for s, e, _ in pieces)
    assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(pieces, pieces[1:]))
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n\r’é😀", max_size=600), st.sampled_from([(20, 0), (40, 10), (100, 24), (50, 49)]))
def test_pieces_cover_and_overlap(text, rule):
    check(text, *rule)


def test_cuts_lie_at_natural_ends():
    paragraph = "One two three. Four five six seven.\n\n"
    pieces = check(paragraph * 40, 300, 40)
    assert {k for *_, k in pieces[:-1]} == {"paragraph"}
    sentences = "One two three, four five. " * 60
    assert {k for *_, k in check(sentences, 300, 40)[:-1]} == {"sentence"}
    assert {k for *_, k in check("word " * 300, 300, 40)[:-1]} == {"word"}
    assert {k for *_, k in check("w" * 1500, 300, 40)[:-1]} == {"plain"}


def test_cost_is_least():
    """Brute force over all ways to cut a small text at its boundaries."""
    text = "Aa bb. Cc dd ee! Ff gg hh ii. Jj kk. Ll mm nn oo pp qq. Rr."
    limit, overlap = 24, 4
    marks = S.boundaries(text, limit)
    n = len(text)
    pieces = -(-(n - overlap) // (limit - overlap))
    even = (n + overlap * (pieces - 1)) / pieces

    def cost(ends):
        total, start = 0.0, 0
        for p, k in ends:
            total += S.PENALTY[k] + S.PIECE_COST + S.BALANCE * ((p - start - even) / limit) ** 2
            start = p - overlap
        return total

    def ways(start, last):
        for p, k in marks:
            if p > last and p - start <= limit:
                if p == n:
                    yield [(p, k)]
                elif p > overlap:
                    yield from ([(p, k), *rest] for rest in ways(p - overlap, p))

    best = min(map(cost, ways(0, 0)))
    assert cost([(e, k) for _, e, k in S.cuts(text, limit, overlap)]) == pytest.approx(best)


def test_scenes(spark):
    long = "Sentence number one. " * 200
    scenes = frame(spark, SCENE, [
        ("a", "c", 1, long, 5, None, "x", 1), ("a", "c", 1, long, 5, None, "x", 1), ("b", "C ", 2, None, 100, 2600, "x", 1), ("c", "c", 3, None, 0, 2400, "x", 1),
        ("d", "c", 4, "", 0, 0, "x", 1), ("e", None, 5, long, None, None, "x", 1), ("f", "nowhere", 6, None, 0, 9000, "x", 1), ("g", "t", 7, None, None, None, "x", 1), ("h", "c", 8, "x" * 2400, 0, 2400, "x", 1),
    ])
    chapters = frame(spark, CHAPTER, [("c", "old", None, at(0), ""), ("c", long, None, at(1), ""), ("t", None, S_HASH(long), at(1), ""), ("t", long, None, at(0), ""), ("u", None, "x", at(0), "")])
    found = S.split_texts(S.oversized_scenes(scenes, chapters), "scene_id", "text", "start_offset").collect()
    texts = {"a": (5, long), "b": (100, long[100:2600]), "e": (0, long), "g": (0, long)}
    assert {r.scene_id for r in found} == set(texts)
    for r in found:
        base, text = texts[r.scene_id]
        assert r.text == text[r.start_offset - base : r.end_offset - base] and len(r.text) <= 2400
    assert sorted(r.piece_no for r in found if r.scene_id == "a") == [1, 2]
    assert rows(S.oversized_scenes(scenes.limit(0), chapters)) == []
    assert {r[0] for r in rows(S.oversized_scenes(scenes, chapters.limit(0)))} == {"a", "e"}


def S_HASH(text):
    import hashlib

    return " SHA256:" + hashlib.sha256(text.encode()).hexdigest().upper()


def test_rules_are_checked(spark):
    with pytest.raises(ValueError):
        S.split_texts(frame(spark, SCENE, []), "id", "text", "start_offset", 100, 100)
