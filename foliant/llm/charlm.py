"""Interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A word is read as its letters between a start and an end mark; a letter's probability given up to ``order - 1``
letters before it is the discounted share of its n-gram plus the context's left-over weight times the next shorter
order.  For each order one sorted array of 64-bit n-gram hashes stands beside a matrix with a column per language
(discounted shares), and likewise for contexts (left-over weights), so a batch of words is scored for all languages
with binary searches and no Python loop over letters.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np

START, END = "\x02", "\x03"
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_MIX = 0xD1B54A32D192ED03
ALPHABET = 512  # for the uniform distribution below the unigrams


def gram_hash(gram: str) -> int:
    h = 0
    for ch in gram:
        h = (h * _BASE + (ord(ch) + 1) * _MIX) & _MASK
    return h


def _counts(words: Counter[str], order: int) -> list[dict[str, float]]:
    """Counts per order: as seen for the longest, else the number of different letters before the n-gram.

    N-grams that begin with the start mark have none before them and keep the counts as seen.
    """
    seen: list[dict[str, float]] = [defaultdict(float) for _ in range(order + 1)]
    for word, n in words.items():
        s = START + word + END
        for i in range(1, len(s)):
            for k in range(1, min(order, i + 1) + 1):
                seen[k][s[i - k + 1 : i + 1]] += n
    kept = [dict() for _ in range(order + 1)]
    kept[order] = dict(seen[order])
    for k in range(order - 1, 0, -1):
        before: dict[str, float] = defaultdict(float)
        for gram in seen[k + 1]:
            before[gram[1:]] += 1
        for gram, n in seen[k].items():
            kept[k][gram] = n if gram[0] == START else max(before.get(gram, 0.0), 1.0)
    return kept


@dataclass
class CharModels:
    """The models of all languages; ``grams[k]`` and ``contexts[k]`` belong to order ``k``."""

    langs: list[str]
    order: int
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    #: Set by calibration: nats of evidence that count as one, and the highest plausible cross-entropy per language.
    temperature: float = 1.0
    ceiling: np.ndarray | None = None

    @classmethod
    def fit(cls, words: dict[str, Counter[str]], order: int = 5) -> CharModels:
        langs = sorted(words)
        grams: list[dict[str, np.ndarray]] = [{} for _ in range(order + 1)]
        rest: list[dict[str, np.ndarray]] = [{} for _ in range(order + 1)]
        for at, lang in enumerate(langs):
            counts = _counts(words[lang], order)
            for k in range(1, order + 1):
                once = sum(1 for n in counts[k].values() if n == 1)
                twice = sum(1 for n in counts[k].values() if n == 2)
                discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.95)
                total: dict[str, float] = defaultdict(float)
                kinds: dict[str, int] = defaultdict(int)
                for gram, n in counts[k].items():
                    total[gram[:-1]] += n
                    kinds[gram[:-1]] += 1
                for gram, n in counts[k].items():
                    grams[k].setdefault(gram, np.zeros(len(langs), np.float32))[at] = max(n - discount, 0) / total[gram[:-1]]
                for context, t in total.items():
                    rest[k].setdefault(context, np.ones(len(langs), np.float32))[at] = discount * kinds[context] / t
        model = cls(langs, order)
        model.grams = [_sorted(g, len(langs)) for g in grams]
        model.contexts = [_sorted(r, len(langs)) for r in rest]
        return model

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log-probability of each word under each language, and its length with the end mark as last column."""
        texts = [START + w + END for w in words]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        first = np.cumsum(sizes) - sizes
        at = np.arange(len(points)) - np.repeat(first, sizes)
        codes = (points + np.uint64(1)) * np.uint64(_MIX)
        hashes = codes.copy()  # of the n-gram that ends here, for the present order
        p = _lookup(self.grams[1], hashes, 0.0) + self.contexts[1][1][0] / ALPHABET
        for k in range(2, self.order + 1):
            shorter = np.concatenate([np.zeros(1, np.uint64), hashes[:-1]])
            hashes = shorter * np.uint64(_BASE) + codes
            reach = np.flatnonzero(at >= k - 1)
            p[reach] = _lookup(self.grams[k], hashes[reach], 0.0) + _lookup(self.contexts[k], shorter[reach], 1.0) * p[reach]
        logs = np.log(p)
        logs[at == 0] = 0  # the start mark is given
        out = np.empty((len(words), len(self.langs) + 1), np.float32)
        out[:, :-1] = np.add.reduceat(logs, first, axis=0)
        out[:, -1] = sizes - 1
        return out


def _sorted(found: dict[str, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.uint64), np.zeros((0, width), np.float32)
    keys = np.fromiter(map(gram_hash, found), np.uint64, len(found))
    order = np.argsort(keys, kind="stable")
    return keys[order], np.stack(list(found.values()))[order]


def _lookup(stored: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, missing: float) -> np.ndarray:
    keys, values = stored
    out = np.full((len(hashes), values.shape[1]), missing, np.float32)
    if len(keys):
        at = np.searchsorted(keys, hashes)
        at[at == len(keys)] = 0
        hit = np.flatnonzero(keys[at] == hashes)
        out[hit] = values[at[hit]]
    return out
