import re

import pytest

import __spark_entry__ as entry
from foliant.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def test_sql_belongs_to_queries():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert {"p1_found", "p3_found"} <= set(names)
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in names)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "id", "score", "rank"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_every_query_runs(spark, name):
    df = entry.queries()[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()
