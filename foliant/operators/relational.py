"""Relational shapes that recur: numbering without one big sort task, lookups that must be unique, covered intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.shared import Workspace

CELL_ROWS = 1 << 17
_PART_BITS = 33  # monotonically_increasing_id puts the partition above these bits


def numbered(df: DataFrame, *order, space: Workspace | None = None, name: str = "ordinal") -> DataFrame:
    """``df`` with a dense position from 0 in the given total order.

    The rows are range-sorted and written once; each partition's first position is the sum of the sizes before it,
    so no task sees all rows.
    """
    space = space or Workspace(df.sparkSession, "numbered")
    placed = space.keep(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", _PART_BITS)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # one row per partition
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    at = F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(name, at).drop("__part", "__id", "__start")


def numbered_within(df: DataFrame, groups: list[str], order: list, space: Workspace | None = None, name: str = "ordinal") -> DataFrame:
    """``df`` with a position from 0 inside each group; a group of any size spreads over many tasks.

    Null is a group of its own.
    """
    space = space or Workspace(df.sparkSession, "numbered")
    whole = space.keep(numbered(df, *groups, *order, space=space, name="__at"))
    starts = whole.groupBy(*(F.col(g).alias(f"__{g}") for g in groups)).agg(F.min("__at").alias("__first"))
    same = None
    for g in groups:
        part = F.col(g).eqNullSafe(F.col(f"__{g}"))
        same = part if same is None else same & part
    joined = whole.join(starts, same)
    return joined.withColumn(name, F.col("__at") - F.col("__first")).drop("__at", "__first", *(f"__{g}" for g in groups))


def recent(df: DataFrame, groups: list[str], order: list, count: int, what: Column, name: str, space: Workspace | None = None, cell: int = CELL_ROWS) -> DataFrame:
    """``df`` with ``name``, an array of ``what`` of the ``count`` rows before each in its group, in order.

    The rows are numbered in order of groups and cut into cells of ``cell`` rows; each cell also sees the last ``count``
    rows before it, so that a group of any size spreads over many tasks.
    """
    rows = numbered(df, *groups, *order, space=space, name="__at").withColumn("__cell", F.floor(F.col("__at") / cell))
    late = rows.where(F.col("__at") % cell >= cell - count).withColumn("__cell", F.col("__cell") + 1)
    both = rows.withColumn("__own", F.lit(True)).unionByName(late.withColumn("__own", F.lit(False)))
    frame = Window.partitionBy("__cell", *groups).orderBy("__at").rowsBetween(-count, -1)
    return both.withColumn(name, F.collect_list(what).over(frame)).where("__own").drop("__own", "__cell", "__at")


def shard(df: DataFrame, count: int, index: int, *order) -> DataFrame:
    """Every ``count``-th row in order, from ``index`` on."""
    if not 0 <= index < count:
        raise ValueError("a shard's index must be from 0 to below the number of shards")
    return numbered(df, *order).where(F.pmod("ordinal", F.lit(count)) == index)


def picked(df: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows with the wanted keys and their position in the list; repeated, missing or ambiguous keys are errors."""
    if len(set(wanted)) != len(wanted):
        raise ValueError("a key is asked for twice")
    places = F.posexplode(F.array(*(F.lit(w) for w in wanted))).alias("position", "__key")
    asked = df.sparkSession.range(1).select(places)
    found = asked.join(df.where(F.col(key).isin(wanted)), F.col("__key") == F.col(key), "left")
    times = F.count(key).over(Window.partitionBy("__key"))
    checked = F.when(times == 1, F.col("__key")).otherwise(F.raise_error(F.concat(F.lit("not exactly one row for "), F.col("__key").cast("string"))))
    return found.withColumn("__key", checked).where(F.col("__key").isNotNull()).drop("__key")


def unique_lookup(pairs: DataFrame, key: str, value: str, *scope: str) -> DataFrame:
    """``(scope…, key, value)`` for keys that lead to exactly one distinct value."""
    sets = pairs.where(F.col(key).isNotNull()).groupBy(*scope, key).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return sets.where(F.col("__lo") == F.col("__hi")).select(*scope, key, F.col("__lo").alias(value))


def covered(probes: DataFrame, intervals: DataFrame, keys: list[str], start: str = "start_offset", end: str = "end_offset") -> DataFrame:
    """Probes that some interval with equal keys holds from start to end."""
    other = intervals.select(*keys, F.col(start).alias("__a"), F.col(end).alias("__b"))
    inside = (F.col("__a") <= F.col(start)) & (F.col("__b") >= F.col(end))
    on = inside
    for k in keys:
        other = other.withColumnRenamed(k, f"__{k}")
        on = (F.col(f"__{k}") == F.col(k)) & on
    return probes.join(other, on, "left_semi")


def latest(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row per key: the first by the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def timeline(events: DataFrame, participant: Column | None = None, location: Column | None = None, kind: Column | None = None) -> DataFrame:
    """Events ``(participants, locations, event_type, …)`` that agree with every filter given; an event without a list has no member of it."""
    for value, keep in ((participant, lambda v: F.array_contains("participants", v)), (location, lambda v: F.array_contains("locations", v)), (kind, lambda v: F.col("event_type") == v)):
        if value is not None:
            events = events.where(F.coalesce(keep(value), F.lit(False)))
    return events


def nearest_rank(df: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """``(group, value)``: per group the value at index ``(n - 1) * share`` rounded half to even, nulls left out."""
    rows = numbered_within(df.where(F.col(value).isNotNull()).select(group, value), [group], [value])
    sizes = rows.groupBy(F.col(group).alias("__g")).agg(F.rint((F.count(F.lit(1)) - 1) * F.lit(share)).cast("long").alias("__at"))
    return rows.join(sizes, F.col(group).eqNullSafe(F.col("__g")) & (F.col("ordinal") == F.col("__at"))).select(group, value)


def few_of_each(df: DataFrame, groups: list[str], value: str, most: int, joined: str) -> DataFrame:
    """``(groups…, joined)``: the first ``most`` distinct values of each group in order, as an array.

    Values beyond are dropped before they are collected.
    """
    w = Window.partitionBy(*groups).orderBy(value)
    kept = df.select(*groups, value).distinct().withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    return kept.groupBy(*groups).agg(F.array_sort(F.collect_list(value)).alias(joined))


def precision_recall(tp: Column, predicted: Column, expected: Column, empty: str) -> list[Column]:
    """``precision``, ``recall`` and ``f1``; ``empty`` says what nothing predicted or expected gives.

    'agree': 1 if both are empty, else 0; 'zero': 0; 'null': null for the side (and f1 0).
    """
    both = (predicted == 0) & (expected == 0)
    fallback = {"agree": F.when(both, 1.0).otherwise(0.0), "zero": F.lit(0.0), "null": F.lit(None).cast("double")}[empty]
    p = F.when(predicted > 0, tp / predicted).otherwise(fallback)
    r = F.when(expected > 0, tp / expected).otherwise(fallback)
    f1 = F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1")]
