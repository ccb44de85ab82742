"""Splitting oversized items at natural boundaries.

Cuts lie on a list of positions: ends of paragraphs and sentences, ends of words where the next sentence end is far,
and plain positions where there are no words either.  A dynamic programme over these positions picks the cuts with
the least sum of cut penalties and size imbalance; every piece has at most ``limit`` code points and begins ``overlap``
code points before the end of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.refs import normal_digest, normal_ref
from foliant.shared import Workspace

LIMIT, OVERLAP = 2400, 240
#: Penalty of a cut by its kind; a word end or plain position only stands for a missing sentence end.
KINDS = ("end", "paragraph", "sentence", "word", "plain")
PENALTY = {"end": 0.0, "paragraph": 0.0, "sentence": 1.0, "word": 6.0, "plain": 40.0}
PIECE_COST = 1.5  # of each piece, so that no more come out than help
BALANCE = 8.0  # of a piece that differs from the even size by the whole limit, squared
GAP_SHARE = 0.2  # a stretch without sentence ends over this share of the limit gets word ends as positions
BROADCAST_ROWS = 100_000  # rows of one key that may be broadcast: about 6 MB

_paragraph = re.compile(r"(?=[^\S\r\n]*(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r))")
_sentence = re.compile(r"""[.!?…。！？]+["'”’»“)\]]*(?=\s|$)""")
_word = re.compile(r"\S(?=\s)")


def boundaries(text: str, limit: int = LIMIT) -> list[tuple[int, str]]:
    """Cut positions in order with their kinds, the text's end last.  A cut at ``p`` ends a piece before ``text[p]``."""
    n = len(text)
    kinds: dict[int, str] = {m.end(): "sentence" for m in _sentence.finditer(text)}
    for m in _paragraph.finditer(text):
        if m.start() and not text[m.start() - 1].isspace():
            kinds[m.start()] = "paragraph"
    kinds.pop(n, None)
    kinds.pop(0, None)
    gap = max(int(limit * GAP_SHARE), 2)
    for kind, step in (("word", None), ("plain", max(limit // 24, 1))):
        known = [0, *sorted(kinds), n]
        for a, b in zip(known, known[1:]):
            if b - a > gap:
                found = range(a + step, b, step) if step else (m.end() for m in _word.finditer(text, a, b))
                for p in found:
                    kinds.setdefault(p, kind)
        kinds.pop(n, None)
        kinds.pop(0, None)
    return [*sorted(kinds.items()), (n, "end")]


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Pieces of a text as (start, end, kind of cut); one piece if it is not over the limit."""
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    marks = boundaries(text, limit)
    at = np.array([p for p, _ in marks])
    price = np.array([PENALTY[k] for _, k in marks]) + PIECE_COST
    stride = limit - overlap
    pieces = -(-(n - overlap) // stride)
    even = (n + overlap * (pieces - 1)) / pieces
    m = len(at)
    cost = np.full(m, np.inf)
    back = np.full(m, -1)
    first = np.flatnonzero(at <= limit)
    cost[first] = price[first] + BALANCE * ((at[first] - even) / limit) ** 2
    low = np.searchsorted(at, at - stride, side="left")  # a piece after a cut at q ends at q + stride at most
    high = np.searchsorted(at, at, side="left")  # and beyond q
    inside = np.searchsorted(at, overlap, side="left")  # the piece before must be longer than the overlap
    for i in range(m):
        a, b = max(low[i], inside), high[i]
        if a < b:
            size = at[i] - at[a:b] + overlap
            trial = cost[a:b] + BALANCE * ((size - even) / limit) ** 2
            k = int(np.argmin(trial))
            if trial[k] + price[i] < cost[i]:
                cost[i], back[i] = trial[k] + price[i], a + k
    ends = []
    i = m - 1
    while i >= 0:
        ends.append(i)
        i = back[i]
    ends.reverse()
    starts = [0, *(int(at[i]) - overlap for i in ends[:-1])]
    return [(s, int(at[i]), marks[i][1]) for s, i in zip(starts, ends)]


def split_texts(df: DataFrame, key: str, text: str, base: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Rows ``(key, piece_no, start_offset, end_offset, cut_kind, text)`` for rows whose text is over the limit.

    Offsets are code points, half open, counted from the row's ``base`` (null counts as 0); pieces count from 1.
    Rows with a null, empty or short text give none; repeated rows give their pieces again.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and below the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                row, no, start, end, kind, piece = [], [], [], [], [], []
                for i, (t, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    for n, (s, e, k) in enumerate(cuts(t, limit, overlap), 1):
                        row.append(i)
                        no.append(n)
                        start.append(b + s)
                        end.append(b + e)
                        kind.append(k)
                        piece.append(t[s:e])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int32())), pa.array(no, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(kind, pa.string()), pa.array(piece, pa.string())],
                    names=[key, "piece_no", "start_offset", "end_offset", "cut_kind", "text"],
                )

    long = df.where(F.length(text) > limit).select(F.col(key), F.col(text).alias("__t"), F.coalesce(F.col(base).cast("long"), F.lit(0)).alias("__b"))
    kind = df.schema[key].dataType.simpleString()
    return long.mapInArrow(run, f"`{key}` {kind}, piece_no bigint, start_offset bigint, end_offset bigint, cut_kind string, text string")


def valid_texts(chapters: DataFrame) -> DataFrame:
    """``(chapter_id, chapter_text)``: the content of the latest delivery, also where another delivery holds its text."""
    rows = chapters.select(
        F.col("id").alias("chapter_id"), "text", F.coalesce(F.sha2("text", 256), normal_digest("content_hash")).alias("__h"), "loaded_at"
    )
    latest = Window.partitionBy("chapter_id").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("__h").desc_nulls_last())
    held = rows.withColumn("__now", F.first("__h").over(latest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return held.where(F.col("__h") == F.col("__now")).groupBy("chapter_id").agg(F.max("text").alias("chapter_text"))


def oversized_scenes(scenes: DataFrame, chapters: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(scene_id, start_offset, text)`` of every scene over the limit, once, with the text whole.

    Where a scene has no text, the chapter's valid text between its offsets stands for it (an absent start counts as
    0, an absent end as the chapter's end).  Short scenes are dropped before any shuffle.  Chapters are only needed
    for textless scenes; their keys are broadcast while they are few and joined by shuffle beyond that.
    """
    space = Workspace(scenes.sparkSession, "oversized")
    rows = scenes.select(
        F.col("id").alias("scene_id"), normal_ref("chapter_id").alias("chapter_id"), "text",
        F.coalesce(F.col("start_offset").cast("long"), F.lit(0)).alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset"),
    )
    told = rows.where(F.length("text") > limit).select("scene_id", "start_offset", "text")
    without = rows.where("text is null").where(F.col("end_offset").isNull() | (F.col("end_offset") - F.col("start_offset") > limit))
    untold = space.keep(without.drop("text").dropDuplicates())
    keys = untold.select("chapter_id").distinct()
    few = untold.count() <= BROADCAST_ROWS
    needed = chapters.select(normal_ref("id").alias("id"), "text", "content_hash", "loaded_at").join(
        (F.broadcast(keys) if few else keys).withColumnRenamed("chapter_id", "id"), "id", "left_semi"
    )
    cut = F.substring(
        F.col("chapter_text"), (F.col("start_offset") + 1).cast("int"), (F.coalesce("end_offset", F.length("chapter_text")) - F.col("start_offset")).cast("int")
    )
    looked_up = untold.join(valid_texts(needed), "chapter_id").select("scene_id", "start_offset", cut.alias("text"))
    every = told.unionByName(looked_up.where(F.length("text") > limit))
    return every.groupBy("scene_id").agg(F.max(F.struct("text", "start_offset")).alias("s")).select("scene_id", "s.start_offset", "s.text")
