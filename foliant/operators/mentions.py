"""Mentions: from surfaces that a model names to verified spans of a chapter."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import span_matches

_SPANS = "surface_text string, entity_type string, start_offset int, end_offset int, found boolean"


def expand_surfaces(named: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``(key, surface_text, entity_type, start_offset, end_offset, found)`` for rows ``(key, text, surface_text, entity_type)``.

    Every non-overlapping exact occurrence of a surface is a span; a surface that does not occur (or is null or
    empty) gives one row with ``found`` false and no offsets.  Equal spans of one key and type come out once.
    """
    key_type = named.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, end, found = [], [], [], []
            for i, (text, surface) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                spans = [m.span() for m in re.finditer(re.escape(surface), text)] if text and surface else []
                for a, b in spans or [(None, None)]:
                    row.append(i)
                    start.append(a)
                    end.append(b)
                    found.append(a is not None)
            take = pa.array(row, pa.int32())
            arrays = [batch.column(0).take(take), batch.column(2).take(take), batch.column(3).take(take)]
            arrays += [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(found, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "surface_text", "entity_type", "start_offset", "end_offset", "found"])

    return named.select(key, "text", "surface_text", "entity_type").mapInArrow(run, f"`{key}` {key_type}, {_SPANS}").distinct()


def rebase(spans: DataFrame, base: str = "chunk_start") -> DataFrame:
    """Offsets counted from the chapter instead of the chunk."""
    return spans.withColumn("start_offset", F.col("start_offset") + F.col(base)).withColumn("end_offset", F.col("end_offset") + F.col(base)).drop(base)


def first_of_each_span(spans: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per ``keys``: the earliest by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return spans.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def verified(mentions: DataFrame, chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions whose span holds their surface in ``(chapter_id, chapter_text)``, and the others (unknown chapters too)."""
    met = mentions.join(chapters, "chapter_id", "left")
    ok = span_matches("chapter_text", "start_offset", "end_offset", "surface_text")
    return met.where(ok).drop("chapter_text"), met.where(~ok).drop("chapter_text")


def replaced_mentions(stored: DataFrame, fresh: DataFrame, chunks_then: DataFrame, chunks_now: DataFrame) -> DataFrame:
    """``stored`` with every version's mentions replaced by ``fresh`` where the version's chunk ids are still the same.

    All tables carry ``version_id``; a version whose chunks changed meanwhile keeps what was stored.
    """
    ids = lambda c, n: c.select("version_id", "chunk_id").distinct().withColumn(n, F.lit(1))
    both = ids(chunks_then, "a").join(ids(chunks_now, "b"), ["version_id", "chunk_id"], "full_outer")
    stable = both.groupBy("version_id").agg(F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("same")).where("same").select("version_id")
    return stored.join(stable, "version_id", "left_anti").unionByName(fresh.join(stable, "version_id", "left_semi"))
