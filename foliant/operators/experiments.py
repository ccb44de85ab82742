"""Experiments: registries, manifests, work in shards that is kept and reused, and reports over strategies.

Shards are Parquet folders under the digest of their manifest, so results of other settings are never mixed up with
them; a shard that is complete is not computed again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.relational import numbered
from foliant.operators.retrieval import RANK_WINDOW, first_relevant_rank, rank_changes, retrieval_metrics
from foliant.shared import Workspace
from foliant.sources.sinks import fingerprint, kept_result

EXAMPLES = 3


class Registry:
    """Named settings of models, data sets or suites; an unknown name is an error that lists the known ones."""

    def __init__(self, kind: str, entries: dict[str, dict]):
        self.kind, self.entries = kind, dict(entries)

    def __getitem__(self, name: str) -> dict:
        if name not in self.entries:
            raise KeyError(f"no {self.kind} named {name!r}; known: {', '.join(sorted(self.entries))}")
        return dict(self.entries[name])

    @classmethod
    def read(cls, kind: str, path: str) -> Registry:
        """From a JSON file ``{"registry_version": 1, "entries": {name: settings}}``."""
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        if not isinstance(held, dict) or held.get("registry_version") != 1 or not isinstance(held.get("entries"), dict):
            raise ValueError(f"{path} is no registry of version 1")
        return cls(kind, held["entries"])

    def table(self, spark: SparkSession) -> DataFrame:
        """``(kind, name, settings)`` with the settings as JSON, keys in order."""
        rows = [(self.kind, name, canonical(entry)) for name, entry in self.entries.items()]
        return spark.createDataFrame(rows, "kind string, name string, settings string")


def canonical(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def manifest_digest(manifest: dict) -> str:
    return hashlib.sha256(canonical(manifest).encode()).hexdigest()


def dataset_manifest(tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, dict]:
    """Rows and digest of every table's named columns; neither depends on the order of the rows."""
    return {name: {"rows": df.count(), "digest": fingerprint(df, *columns)} for name, (df, columns) in tables.items()}


def manifest_drift(spark: SparkSession, recorded: dict[str, dict], now: dict[str, dict]) -> DataFrame:
    """``(dataset, state, rows_recorded, rows_now)``: added, removed, changed or same since the manifest was recorded."""
    rows = []
    for name in sorted(recorded.keys() | now.keys()):
        a, b = recorded.get(name), now.get(name)
        state = "added" if a is None else "removed" if b is None else "same" if a == b else "changed"
        rows.append((name, state, a and a["rows"], b and b["rows"]))
    return spark.createDataFrame(rows, "dataset string, state string, rows_recorded bigint, rows_now bigint")


def in_shards(queries: DataFrame, rank: Callable[[DataFrame], DataFrame], folder: str, manifest: dict, shards: int, key: str = "query_id") -> DataFrame:
    """``rank`` of all queries, one shard of every ``shards``-th query at a time, each kept under the manifest's digest.

    Adds ``shard``.  Shards that are there already are read and not ranked again; the manifest must hold everything that
    the result depends on besides the queries, whose keys are added to it.
    """
    if shards < 1:
        raise ValueError("there must be one shard at least")
    space = Workspace(queries.sparkSession, "shards")
    places = space.keep(numbered(queries, key, space=space, name="__place"))
    digest = manifest_digest(manifest | {"shards": shards, "keys": fingerprint(queries, key)})

    def one(index: int) -> DataFrame:
        mine = places.where(F.pmod("__place", F.lit(shards)) == index).drop("__place")
        return kept_result(queries.sparkSession, f"{folder}/{digest}", f"shard-{index}", lambda: rank(mine)).withColumn("shard", F.lit(index))

    return reduce(lambda a, b: a.unionByName(b), map(one, range(shards)))


def shard_coverage(expected: DataFrame, rows: DataFrame, key: str = "query_id", shard: str = "shard") -> DataFrame:
    """One row ``(expected, covered, missing, unexpected, repeated)``: whether shards hold every expected key, and each in one shard only."""
    held = rows.select(key, shard).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("shards"))
    both = expected.select(key).distinct().withColumn("wanted", F.lit(True)).join(held, key, "full_outer")
    wanted, found = F.col("wanted").isNotNull(), F.col("shards").isNotNull()
    return both.agg(
        F.count_if(wanted).alias("expected"), F.count_if(wanted & found).alias("covered"), F.count_if(wanted & ~found).alias("missing"),
        F.count_if(~wanted).alias("unexpected"), F.count_if(F.col("shards") > 1).alias("repeated"),
    )


def evaluated(rankings: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, rank, found)`` of every query: the first relevant rank, null if there is none, and how many relevant ids were found."""
    first = first_relevant_rank(rankings, relevant, queries)
    hits = rankings.join(relevant.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    return first.join(hits, "query_id", "left").select("query_id", "rank", F.coalesce("found", F.lit(0)).alias("found"))


def strategy_report(strategies: dict[str, DataFrame], relevant: DataFrame, splits: DataFrame, cuts: tuple[int, ...] = (1, 5, 10, 20, 30)) -> DataFrame:
    """``(strategy, split, query_count, recall_at_…, mrr_at_10)``; ``splits``: ``(query_id, split)``.

    Queries count with recall 0 where a strategy found nothing relevant; those without relevant ids do not count.
    """
    known = relevant.join(splits, "query_id")

    def one(name: str, rankings: DataFrame) -> DataFrame:
        per = retrieval_metrics(rankings, known, cuts, by=["split"])
        return per.select(F.lit(name).alias("strategy"), "*")

    return reduce(lambda a, b: a.unionByName(b), (one(n, r) for n, r in strategies.items()))


def paired(before: DataFrame, after: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, before_rank, after_rank, gain, outcome, same_candidates, pool_miss)``: a ranking and its reordering, per query.

    A reordering must hold the same ids as what it orders; ``pool_miss``: no relevant id was among them.
    """
    ranks = rank_changes(first_relevant_rank(before, relevant, queries), first_relevant_rank(after, relevant, queries), RANK_WINDOW + 1)
    side = lambda df, n: df.select("query_id", "id").distinct().withColumn(n, F.lit(1))
    both = side(before, "a").join(side(after, "b"), ["query_id", "id"], "full_outer").groupBy("query_id").agg(F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("same"))
    met = ranks.join(both, "query_id", "left")
    return met.select("query_id", "before_rank", "after_rank", "gain", "outcome", F.coalesce("same", F.lit(True)).alias("same_candidates"), F.col("before_rank").isNull().alias("pool_miss"))


def paired_report(pairs: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """``(outcome, n, pool_misses, invalid, examples)`` of ``paired``: counts, and the first query ids of every outcome."""
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("__n") <= examples, F.col("query_id")))), 1, examples)
    from pyspark.sql import Window

    placed = pairs.withColumn("__n", F.row_number().over(Window.partitionBy("outcome").orderBy("query_id")))
    return placed.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("pool_miss").alias("pool_misses"), F.count_if(~F.col("same_candidates")).alias("invalid"), first.alias("examples"))


def newest_runs(runs: DataFrame, registry: Iterable[str], most: int = 50) -> DataFrame:
    """The newest ``most`` runs of registered suites.  ``runs``: ``(run_id, suite, created_at, …)``; later first, then greater ids."""
    known = runs.where(F.col("suite").isin(*registry))
    return known.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(most)


def failures(rows: DataFrame, run: str, key: str, error: Column, most: int = 20) -> DataFrame:
    """``(run, key, error)``: the first failing rows of every run, at most ``most`` of each."""
    from pyspark.sql import Window

    bad = rows.select(run, key, error.alias("error")).where("error is not null").distinct()
    return bad.withColumn("__n", F.row_number().over(Window.partitionBy(run).orderBy(key, "error"))).where(F.col("__n") <= most).drop("__n")
