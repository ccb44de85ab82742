"""Languages of documents and of the paragraphs of mixed documents.

The character models of ``charlm`` are fitted on a bounded sample of labelled documents, cleaned of wrong labels and
foreign paragraphs by a first fit, and calibrated on the part of the sample held out.  Every document is then scored
whole: words once per worker, paragraphs and documents as sums over their words.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.charlm import CharModels

#: The languages and the notations of each (ISO 639-1, 639-2 T and B, names).
NOTATIONS = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano castilian",
    "it": "it ita italian italiano",
    "pt": "pt por portuguese português portugues",
    "nl": "nl nld dut dutch nederlands flemish",
}

#: Bound of the sample that the models are fitted on: documents per language, and code points of one document.
SAMPLE_DOCS = 240
SAMPLE_CHARS = (300, 6000)

LONGEST_WORD = 30  # longer runs of letters are scored whole and weigh like so many letters; they are neither memoised nor fitted
MEMO_WORDS = 200_000
#: A paragraph in another language than the document: words it must have, and nats of evidence per fitted temperature.
FOREIGN_WORDS = 5
FOREIGN_NATS = 8.0

_words = re.compile(r"[^\W\d_]+").findall
_blank_lines = re.compile(r"(?:\r\n|\n|\r)(?:[^\S\r\n]*(?:\r\n|\n|\r))+")


def declared_language(c: Column) -> Column:
    """The language code that a label names in whatever notation; null if it names none of ``NOTATIONS``."""
    base = F.regexp_extract(F.lower(F.trim(c)), r"^([\p{L}]+)", 1)
    code = F.lit(None).cast("string")
    for lang, names in NOTATIONS.items():
        code = F.when(base.isin(names.split()), lang).otherwise(code)
    return code


def paragraphs(text: str) -> list[str]:
    """Parts between blank lines that are not blank themselves."""
    return [p for p in _blank_lines.split(text) if p and not p.isspace()]


def words(text: str) -> list[str]:
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return _words(text.lower())


class Scorer:
    """Scores of words, kept per worker, and their sums over paragraphs."""

    def __init__(self, models: CharModels):
        self.models = models
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(models.langs) + 1), np.float32)

    def sums(self, parts: list[list[str]]) -> np.ndarray:
        """Per part: summed log-probabilities, letters, and as last column the number of words that count."""
        if len(self.scores) > MEMO_WORDS:
            self.index, self.scores = {}, self.scores[:0]
        index = self.index
        flat = [w for part in parts for w in part]
        at = list(map(index.get, flat))
        if None in at:
            new = list(dict.fromkeys(w for w, i in zip(flat, at) if i is None))
            index.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            fresh = self.models.score(new)
            for i, w in enumerate(new):
                if len(w) > LONGEST_WORD:  # a mean over all its letters; while models are fitted it does not count
                    fresh[i] *= LONGEST_WORD / len(w) if self.models.ceiling is not None else 0
            self.scores = np.concatenate([self.scores, fresh])
            at = list(map(index.get, flat))
            for w in new:
                if len(w) > LONGEST_WORD:
                    del index[w]
        out = np.zeros((len(parts), self.scores.shape[1] + 1))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        full = np.flatnonzero(sizes)
        if len(full):
            rows = self.scores[np.array(at)]
            starts = (np.cumsum(sizes) - sizes)[full]
            out[full, :-1] = np.add.reduceat(rows, starts, axis=0)
            out[full, -1] = np.add.reduceat((rows[:, -1] > 0).astype(np.int64), starts)
        return out


def judged(models: CharModels, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language index, confidence and rejection of each row of sums.

    The lowest length-normalised cross-entropy wins.  Confidence is the posterior under equal priors at the fitted
    temperature.  A row is rejected if it has no words or its cross-entropy is above what the language's own
    paragraphs reached in calibration.
    """
    logs, letters = sums[:, :-2], np.maximum(sums[:, -2], 1)
    best = np.argmax(logs, axis=1)
    posterior = np.exp((logs - logs.max(axis=1, keepdims=True)) / models.temperature)
    confidence = 1 / posterior.sum(axis=1)
    entropy = -logs[np.arange(len(best)), best] / letters
    rejected = sums[:, -1] == 0
    if models.ceiling is not None:
        rejected |= entropy > models.ceiling[best]
    return best, confidence, rejected


def fit_models(labelled: list[tuple[str, str]], order: int = 5) -> CharModels:
    """Models from (text, language) pairs whose labels may be wrong for some and whose texts may be mixed.

    Without any pair with words the models reject every text.
    """
    parts = [(words(p), lang) for text, lang in labelled for p in paragraphs(text)]
    parts = [(w, lang) for w, lang in parts if w]

    def counts(chosen: list[tuple[list[str], str]]) -> dict[str, Counter[str]]:
        found: dict[str, Counter[str]] = {lang: Counter() for lang in NOTATIONS}
        for w, lang in chosen:
            found[lang].update(x for x in w if len(x) <= LONGEST_WORD)
        return {lang: c or Counter([lang]) for lang, c in found.items()}

    models = CharModels.fit(counts(parts), order)
    if not parts:
        models.ceiling = np.zeros(len(models.langs))
        return models
    for _ in range(2):  # drop paragraphs whose text speaks against their label
        best, _, _ = judged(models, Scorer(models).sums([w for w, _ in parts]))
        kept = [p for p, b in zip(parts, best) if models.langs[b] == p[1]] or parts
        models = CharModels.fit(counts(kept), order)
    held = kept[::5]
    trial = CharModels.fit(counts([p for i, p in enumerate(kept) if i % 5]), order)
    sums = Scorer(trial).sums([w for w, _ in held])
    truth = np.array([trial.langs.index(lang) for _, lang in held])
    logs = sums[:, :-2] - sums[:, :-2].max(axis=1, keepdims=True)

    def loss(t: float) -> float:
        scaled = logs / t
        return float(np.mean(np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(truth)), truth]))

    models.temperature = min((1.0, 1.5, 2.0, 3.0, 4.0, 6.0), key=loss)
    entropy = -sums[np.arange(len(truth)), truth] / np.maximum(sums[:, -2], 1)
    ceiling = np.full(len(models.langs), 12.0)
    for at in range(len(models.langs)):
        own = entropy[(truth == at) & (sums[:, -1] >= FOREIGN_WORDS)]
        if len(own) >= 20:
            ceiling[at] = 2.0 * own.max() + 1.0
    models.ceiling = ceiling
    return models


def label_sample(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """At most ``per_language`` labelled texts of each language, of ``SAMPLE_CHARS`` code points each, by hash of the key."""
    rows = docs.select(F.col(key).alias("__k"), declared_language(F.col(label)).alias("__l"), F.length(text).alias("__n"))
    first = Window.partitionBy("__l").orderBy(F.xxhash64("__k"), "__k")
    chosen = (
        rows.where(F.col("__l").isNotNull() & F.col("__n").between(*SAMPLE_CHARS))
        .withColumn("__r", F.row_number().over(first))
        .where(F.col("__r") <= per_language)
        .select("__k", "__l")
    )
    ids = [r["__k"] for r in chosen.select("__k").collect()]  # at most per_language times the number of languages
    texts = docs.where(F.col(key).isin(ids)).select(F.col(text).alias("t"), declared_language(F.col(label)).alias("l"))
    return [(r["t"], r["l"]) for r in texts.collect() if r["t"] and r["l"]]


def judge_document(scorer: Scorer, sums: np.ndarray) -> tuple[int, float, list[tuple[int, float]]] | None:
    """Main language and confidence of a document from its paragraphs' sums; paragraphs' own only if it is mixed."""
    models = scorer.models
    if not (sums[:, -1] > 0).any():
        return None
    total = sums.sum(axis=0, keepdims=True)
    best, confidence, rejected = judged(models, total)
    if len(sums) == 1:
        return None if rejected[0] else (int(best[0]), float(confidence[0]), [])
    logs = sums[:, :-2]
    own, own_confidence, own_rejected = judged(models, sums)
    lead = (logs.max(axis=1)[:, None] - logs) / models.temperature
    sure = (sums[:, -1] >= FOREIGN_WORDS) & ~own_rejected
    second = np.partition(lead, 1, axis=1)[:, 1]
    sure &= second >= FOREIGN_NATS
    kinds = set(own[sure].tolist())
    if len(kinds) < 2:
        return None if rejected[0] else (int(best[0]), float(confidence[0]), [])
    mass = np.zeros(len(models.langs))
    for k in kinds:
        mass[k] = sums[sure & (own == k), -2].sum()
    main = int(np.argmax(mass))
    each = []
    for i in range(len(sums)):  # weak paragraphs choose among the document's languages
        if sure[i]:
            each.append((int(own[i]), float(own_confidence[i])))
        else:
            among = sorted(kinds)
            pick = among[int(np.argmax(logs[i, among]))] if sums[i, -1] else main
            weight = np.exp((logs[i, among] - logs[i, among].max()) / models.temperature)
            each.append((pick, float(1 / weight.sum())))
    return main, float(mass[main] / mass.sum()), each


_worker: dict[str, Scorer] = {}


def detect_languages(docs: DataFrame, models: CharModels, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Rows ``(key, segment, lang, confidence, declared)``.

    Segment 0 is the document, one row for every input row: ``lang`` is null, with confidence 0, for null, empty and
    wordless texts and for texts like none of the languages.  Segments 1, 2, … are the paragraphs of documents that
    hold whole paragraphs in more than one language.  ``declared`` is the label as a code, null if it names none.
    """
    stored = docs.sparkSession.sparkContext.broadcast(pickle.dumps(models))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _worker:
            _worker.clear()
            _worker[name] = Scorer(pickle.loads(stored.value))
        scorer = _worker[name]
        langs = scorer.models.langs
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [paragraphs(t) if t else [] for t in batch.column(1).to_pylist()]
                sums = scorer.sums([words(p) for ps in texts for p in ps])
                at, row, segment, lang, conf = 0, [], [], [], []
                for i, ps in enumerate(texts):
                    found = judge_document(scorer, sums[at : at + len(ps)]) if ps else None
                    at += len(ps)
                    row.append(i)
                    segment.append(0)
                    lang.append(langs[found[0]] if found else None)
                    conf.append(found[1] if found else 0.0)
                    for n, (k, c) in enumerate(found[2] if found else (), 1):
                        row.append(i)
                        segment.append(n)
                        lang.append(langs[k])
                        conf.append(c)
                take = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), pa.array(segment, pa.int64()), pa.array(lang, pa.string()), pa.array(conf, pa.float64()), batch.column(2).take(take)],
                    names=[key, "segment", "lang", "confidence", "declared"],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("__t"), declared_language(F.col(label)).alias("__l"))
    return rows.mapInArrow(run, f"`{key}` {kind}, segment bigint, lang string, confidence double, declared string")


def missing_or_wrong(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose label does not name their language, and all paragraphs of mixed documents."""
    wrong = (F.col("segment") > 0) | F.col("declared").isNull() | (F.col("declared") != F.col("lang"))
    return found.where(F.col("lang").isNotNull() & wrong).select(key, "segment", "lang")
