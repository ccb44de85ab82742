"""Constraints as queries: each gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, n)`` for every rule: how many rows it does not hold for (null counts as not held)."""
    counts = df.agg(*(F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules))).alias("r")
    return counts.select(pairs).select("r.rule", "r.n")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key is not null and no parent's."""
    known = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(known, child_key, "left_anti")


def span_rules(start: str = "start_offset", end: str = "end_offset", text: str = "text") -> dict[str, Column]:
    """Rules of a span that holds its text; an absent end or text breaks only its own rule."""
    known = F.col(end).isNull() | F.col(text).isNull()
    return {
        "start_not_negative": F.col(start) >= 0,
        "end_after_start": F.col(end).isNull() | (F.col(end) > F.col(start)),
        "length_is_span": known | (F.length(text) == F.col(end) - F.col(start)),
        "text_present": F.col(text).isNotNull(),
    }
