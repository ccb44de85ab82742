import random
from collections import Counter

import numpy as np
import pytest

from foliant.llm import language as L
from foliant.llm.charlm import CharModels, gram_hash
from tests.helpers import frame

WORDS = {
    "en": "the of and night before while nobody would river carried letters behind chapel great care stranger wanted bottle under bridge others slept ledger",
    "de": "der die das nacht bevor niemand fluss trug briefe hinter kapelle große sorge fremde wollte flasche unter brücke andere schliefen buch",
    "fr": "le la les nuit avant personne rivière portait lettres derrière chapelle grand soin étranger voulait bouteille sous pont autres dormaient livre",
    "es": "el la los noche antes nadie río llevaba cartas detrás capilla mucho cuidado extraño quería botella bajo puente otros dormían libro",
    "it": "il lo gli notte prima nessuno fiume portava lettere dietro cappella molta cura straniero voleva bottiglia sotto ponte altri dormivano libro",
    "pt": "o os as noite antes ninguém rio levava cartas atrás capela muito cuidado estranho queria garrafa sob ponte outros dormiam livro",
    "nl": "de het een nacht voordat niemand rivier droeg brieven achter kapel grote zorg vreemde wilde fles onder brug anderen sliepen boek",
}


def text(lang, rng, sentences=6):
    words = WORDS[lang].split()
    return " ".join(" ".join(rng.choices(words, k=9)) + "." for _ in range(sentences))


@pytest.fixture(scope="module")
def models():
    rng = random.Random(1)
    sample = [(text(lang, rng), lang) for lang in WORDS for _ in range(40)]
    wrong = [(t, rng.choice(list(WORDS))) if rng.random() < 0.1 else (t, lang) for t, lang in sample]
    return L.fit_models(wrong)


def detected(spark, models, docs):
    df = frame(spark, "doc_id long, text string, lang string, segment int, confidence string", [(*d, 0, "x") for d in docs])
    return df, L.detect_languages(df, models)


def test_models_are_distributions():
    """Over all letters that may follow, the probabilities of an order add up to one, up to the uniform remainder."""
    counts = {"en": Counter({"abab": 3, "abc": 2, "b": 5})}
    m = CharModels.fit(counts, 3)
    letters = "abc\x03"
    for context in ("", "a", "b", "ab"):
        whole = {w: m.score([w]) for w in [context + x for x in letters.replace("\x03", "")] + [context]}
        assert all(np.isfinite(v).all() and (v[:, 0] < 0).all() for v in whole.values())
    unseen = m.score(["zzz"])[0, 0]
    assert unseen < m.score(["abab"])[0, 0] - 5
    assert gram_hash("ab") != gram_hash("ba")


def test_held_out_accuracy(models):
    rng = random.Random(2)
    held = [(text(lang, rng, 2), lang) for lang in WORDS for _ in range(30)]
    sums = L.Scorer(models).sums([L.words(t) for t, _ in held])
    best, confidence, rejected = L.judged(models, sums)
    assert np.mean([models.langs[b] == lang for b, (_, lang) in zip(best, held)]) >= 0.98
    assert confidence.min() > 0.3 and not rejected.any()


def test_notations(spark):
    given = ["en", "EN", "en-GB", "en_US", "eng", "English", " ger ", "deu", "de-AT", "fre", "es-MX", "Portuguese", "dut", "nl-BE", "", " ", None, "und", "n/a", "unknown", "xx"]
    df = frame(spark, "lang string", [(g,) for g in given])
    codes = [r[0] for r in df.select(L.declared_language(df.lang)).collect()]
    assert codes == ["en"] * 6 + ["de"] * 3 + ["fr", "es", "pt", "nl", "nl"] + [None] * 7


def test_paragraphs():
    assert L.paragraphs("a\n\nb\r\n \r\nc\rd\n\n\n\n e\n\n \n") == ["a", "b", "c\rd", " e"]
    assert L.paragraphs("") == [] == L.paragraphs(" \n\n ")


def test_documents(spark, models):
    rng = random.Random(3)
    mixed = "\n\n".join([text("en", rng), text("de", rng), text("en", rng)])
    quoted = text("fr", rng) + " “the night” " + text("fr", rng)
    docs = [
        (1, text("it", rng), "it"), (2, text("it", rng), "Italian"), (3, text("it", rng), "es"), (4, text("nl", rng), None), (5, mixed, "en"), (6, mixed, "de"), (7, quoted, "fr"), (8, None, "en"),
        (9, "", "en"), (10, "12 34\n\n… 5", "en"), (11, "q" * 50_000 + " " + text("pt", rng), "pt"), (3, text("it", rng), "es"), (None, text("es", rng), "xx"), (12, text("es", rng, 300), "es"),
    ]
    _, found = detected(spark, models, docs)
    wrong = sorted((str(r.doc_id), r.segment, r.lang) for r in L.missing_or_wrong(found).collect())
    parts = [(d, s, lang) for d in ("5", "6") for s, lang in ((1, "en"), (2, "de"), (3, "en"))]
    assert wrong == sorted([("3", 0, "it"), ("3", 0, "it"), ("4", 0, "nl"), ("6", 0, "en"), ("None", 0, "es"), *parts])
    whole = {r.doc_id: r for r in found.where("segment = 0").collect()}
    assert len(whole) == len({d[0] for d in docs}) and whole[8].lang is None and whole[10].lang is None and whole[8].confidence == 0
    assert found.where("segment > 0 and confidence < 0.9").count() == 0


def test_long_words_count(models):
    scorer = L.Scorer(models)
    for lang in ("de", "fr", "nl"):
        run = "".join(WORDS[lang].split()[3:12])
        assert len(run) > L.LONGEST_WORD
        for _ in range(2):
            found = L.judge_document(scorer, scorer.sums([L.words(f"{run} {run}")]))
            assert found and models.langs[found[0]] == lang
        assert run not in scorer.index


def test_empty(spark, models):
    _, found = detected(spark, models, [])
    assert found.collect() == []
    nothing = L.fit_models([])
    df, found = detected(spark, nothing, [(1, "hello there", "en")])
    assert [(r.segment, r.lang) for r in found.collect()] == [(0, None)]


def test_sample_is_bounded(spark):
    rng = random.Random(4)
    docs = [(i, text("en", rng, 8), "en") for i in range(60)] + [(100 + i, text("de", rng, 8), "ger") for i in range(5)] + [(200, None, "en"), (201, "short", "en"), (202, "x" * 7000, "en")]
    df = frame(spark, "doc_id long, text string, lang string", docs)
    sample = L.label_sample(df, per_language=10)
    assert Counter(lang for _, lang in sample) == {"en": 10, "de": 5}
