"""Small frames from plain rows."""

from __future__ import annotations

import datetime as dt


def at(day: int) -> dt.datetime:
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=day)


def frame(spark, schema: str, rows: list[tuple]):
    return spark.createDataFrame(rows, schema)


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
