"""Where pretrained models plug in, and deterministic stand-ins for tests.

A model is a picklable object whose method takes plain lists.  It is built once per Python worker and fed Arrow
batches.  Results of the stand-ins say nothing about the quality of a real model.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_words = re.compile(r"[^\W_]+").findall


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def score(self, queries: list[str], texts: list[str]) -> list[float]: ...


class Client(Protocol):
    """A generative model: a prompt in, a JSON text out."""

    def complete(self, prompt: str) -> str: ...


class HashedWords:
    """Stand-in embedder: words hashed to signed dimensions, unit length."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for i, text in enumerate(texts):
            for w in _words(text.casefold()):
                h = zlib.crc32(w.encode())
                out[i, h % self.dimensions] += 1.0 if h >> 31 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1.0, length)


class Letters:
    """Stand-in embedder that SQL can state too: how often each of the 26 small letters stands in a text, unit length."""

    dimensions = 26

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.array([[text.count(chr(97 + i)) for i in range(26)] for text in texts], dtype=np.float64).reshape(-1, 26)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1.0, length)


class WordOverlap:
    """Stand-in reranker: share of the query's distinct words that the text has."""

    def score(self, queries: list[str], texts: list[str]) -> list[float]:
        found = []
        for q, t in zip(queries, texts):
            wanted = set(_words(q.casefold()))
            found.append(len(wanted & set(_words(t.casefold()))) / len(wanted) if wanted else 0.0)
        return found


def embed_column(text: Column, make: Callable[[], Embedder] = HashedWords, batch: int = 8) -> Column:
    """A vector per text, null for null; the model is made once per worker and called on ``batch`` texts."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            out: list = [None] * len(texts)
            known = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(known), batch):
                part = known[at : at + batch]
                vectors = np.asarray(model.embed([texts.iloc[i] for i in part]), dtype=np.float32)
                if not np.isfinite(vectors).all():
                    raise ValueError("an embedding is not finite")
                for i, v in zip(part, vectors):
                    out[i] = v.tolist()
            yield pd.Series(out)

    return run(text)


def score_column(query: Column, text: Column, make: Callable[[], Scorer] = WordOverlap, batch: int = 30) -> Column:
    """One finite score per pair; a null text scores as an empty one."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in batches:
            q, t = q.fillna("").tolist(), t.fillna("").tolist()
            scores: list[float] = []
            for at in range(0, len(q), batch):
                scores += [float(x) for x in model.score(q[at : at + batch], t[at : at + batch])]
            if len(scores) != len(q) or not np.isfinite(scores).all():
                raise ValueError("a reranker must give one finite score per candidate")
            yield pd.Series(scores)

    return run(query, text)


def complete_rows(prompts: DataFrame, make: Callable[[], Client], accept: Callable[[str], str | None], attempts: int = 2) -> DataFrame:
    """Rows ``(id, answer, repairs, error)`` for rows ``(id, prompt)``: an answer that ``accept`` returns null for is asked again.

    The repeated prompt shows the refused answer.  ``repairs`` counts the repeats; ``error`` is set when none was accepted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for pdf in batches:
            rows = []
            for key, prompt in zip(pdf["id"], pdf["prompt"]):
                answer, tries, said = None, 0, prompt
                while answer is None and tries < attempts:
                    raw = client.complete(said)
                    answer = accept(raw)
                    said = f"{prompt}\nThis answer was refused:\n{raw}"
                    tries += 1
                rows.append((key, answer, tries - 1, None if answer is not None else "INVALID_OUTPUT"))
            yield pd.DataFrame(rows, columns=["id", "answer", "repairs", "error"])

    return prompts.select("id", "prompt").mapInPandas(run, "id string, answer string, repairs int, error string")
