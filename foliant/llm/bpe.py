"""Byte-level byte-pair encoding of a whole corpus.

The merges of one pre-token run over a segment tree: leaf ``i`` holds the rank of the pair that begins at byte
position ``i``, every inner node the leftmost minimum below it.  A merge takes the root's pair, joins it with its
right neighbour in a linked list of live positions and updates the three leaves whose pair changed, each in
logarithmic time, so a run of n bytes without a break costs O(n log n).

Texts are cut where a pre-token boundary is certain whatever follows (in front of white space that follows
something else), and each distinct piece is encoded once per worker; a bounded memo keeps the ids as packed bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed values of the public tokenizer: the pre-token pattern of its rank file.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

MEMO_ENTRIES = 200_000
MEMO_CHARS = 48


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class SegmentTree:
    """Leftmost minimum over an array of pair ranks, with point updates."""

    __slots__ = ("size", "low")

    def __init__(self, ranks: list[int]):
        size = 1
        while size < len(ranks):
            size *= 2
        low = [_NONE] * (2 * size)
        low[size : size + len(ranks)] = ranks
        for i in range(size - 1, 0, -1):
            a, b = low[2 * i], low[2 * i + 1]
            low[i] = a if a <= b else b
        self.size, self.low = size, low

    def set(self, i: int, rank: int) -> None:
        low = self.low
        i += self.size
        low[i] = rank
        i >>= 1
        while i:
            a, b = low[2 * i], low[2 * i + 1]
            m = a if a <= b else b
            if low[i] == m:
                break
            low[i] = m
            i >>= 1

    def leftmost(self) -> tuple[int, int]:
        """The smallest rank and the first position that holds it."""
        low, i, m = self.low, 1, self.low[1]
        while i < self.size:
            i = 2 * i if low[2 * i] == m else 2 * i + 1
        return m, i - self.size


_NONE = 1 << 60


class Encoder:
    """Encodes texts with the merges of a rank file (``base64 rank`` per line)."""

    def __init__(self, rank_file: bytes, pattern: str = PRETOKEN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.split = regex.compile(pattern)
        self.pieces = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        #: Two white-space characters in a row of which the second is a blank: only then may cutting at each blank differ.
        self.doubled = [w + " " for w in WHITE]
        self.memo: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        tree = SegmentTree([ranks.get(data[i : i + 2], _NONE) for i in range(n - 1)])
        while True:
            rank, i = tree.leftmost()
            if rank == _NONE:
                break
            j = after[i]
            parts[i] += parts[j]
            parts[j] = None
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                tree.set(i, ranks.get(parts[i] + parts[k], _NONE))
            else:
                tree.set(i, _NONE)
            if j < n - 1:
                tree.set(j, _NONE)
            h = before[i]
            if h >= 0:
                tree.set(h, ranks.get(parts[h] + parts[i], _NONE))
        return [ranks[p] for p in parts if p is not None]

    def _piece(self, piece: str) -> bytes:
        ids: list[int] = []
        for pre in self.split.findall(piece):
            ids += self.merge(pre.encode("utf-8", "replace"))
        packed = np.array(ids, dtype="<i4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[piece] = packed
        return packed

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit integers; empty for null."""
        if not text:
            return b""
        if any(map(text.__contains__, self.doubled)):
            pieces = self.pieces(text)
        else:
            head, *rest = text.split(" ")
            pieces = [head, *(" " + x for x in rest)] if head else [" " + x for x in rest]
        get = self.memo.get
        found = [get(p) for p in pieces]
        if None in found:
            found = [get(p) or self._piece(p) if x is None else x for p, x in zip(pieces, found)]
        return b"".join(found)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<i4").tolist()


_worker: dict[tuple[int, int], Encoder] = {}


def encoder_of(rank_file: bytes) -> Encoder:
    """One encoder per Python worker, kept between tasks."""
    key = (len(rank_file), hash(rank_file))
    if key not in _worker:
        _worker.clear()
        _worker[key] = Encoder(rank_file)
    return _worker[key]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Rows ``(key, ids)``: the token ids of every row's text, without special tokens.

    One row per input row, repeated rows and null keys included.  An empty and a null text both give an empty
    list; strings that look like special tokens are ordinary text; other columns are not read.  The rank file
    (under 1 MB, fixed) is read once in the driver and broadcast.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(ranks.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                packed = [enc.packed(t) for t in part.column(1).to_pylist()]
                ends = np.zeros(len(packed) + 1, dtype=np.int32)
                np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
                ids = np.frombuffer(b"".join(packed), dtype="<i4")
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def token_counts(df: DataFrame, keep: list[str], text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` BIGINT, one row per input row; 0 for null and empty texts."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(ranks.value)
        for batch in batches:
            last = batch.num_columns - 1
            sizes = [len(enc.packed(t)) // 4 for t in batch.column(last).to_pylist()]
            cols = [batch.column(i) for i in range(last)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, type=pa.int64())], names=[*keep, "n_tokens"])

    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField("n_tokens", T.LongType())])
    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
