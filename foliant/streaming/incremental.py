"""Incremental ingestion: bounded slices, redelivery, supersession and fences.

A stream reads what has arrived, a bounded number of files at a time, and stops; each micro-batch writes its own
folders, so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.operators.relational import latest
from foliant.shared import Workspace
from foliant.sources.sinks import exists


def new_rows(batch: DataFrame, stored: DataFrame | None, keys: list[str]) -> DataFrame:
    """One row per key of a batch that is not stored yet."""
    fresh = batch.dropDuplicates(keys)
    return fresh if stored is None else fresh.join(stored.select(*keys), keys, "left_anti")


def ingest(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, keys: list[str], files_per_slice: int = 20,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df, name_filter: str = "*", buckets: int = 64,
) -> None:
    """Takes in all files of ``source`` that were not read before and returns.

    ``target`` holds one folder per bucket of keys and slice, ``bucket=<b>/slice=<batch>``; rows whose keys an earlier slice
    has are left out.  A slice only reads the key columns of the buckets that it has rows for, so keep slices small beside
    ``buckets`` where the target is large.  ``name_filter`` is a glob of file names.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_slice).option("pathGlobFilter", name_filter).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        space = Workspace(spark, "slice")
        rows = space.keep(transform(batch).dropDuplicates(keys).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("slice", F.lit(number)))
        stored = None
        if exists(spark, target):
            touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            stored = spark.read.schema(rows.schema).parquet(target).where(F.col("bucket").isin(*touched) & (F.col("slice") != number))
        fresh = new_rows(rows, stored, keys)
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "slice").parquet(target)
        space.drop(rows)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def accepted(results: DataFrame, published: DataFrame, owner: str, version: str) -> DataFrame:
    """The newest result per owner, unless a newer version is published already."""
    newest = latest(results, [owner], F.col(version).desc())
    return newest.join(published.select(owner, F.col(version).alias("__now")), owner, "left").where(F.col("__now").isNull() | (F.col(version) > F.col("__now"))).drop("__now")


def of_current_attempt(results: DataFrame, jobs: DataFrame, job: str = "job_id", attempt: str = "attempt") -> DataFrame:
    """Results of each job's present attempt; those of earlier attempts are stale."""
    return results.join(jobs.select(job, attempt), [job, attempt], "left_semi")


def publish_if_unchanged(write: Callable[[], None], expected: str, state: Callable[[], str]) -> bool:
    """Writes only while the state still has the fingerprint that the work began with; whether it did."""
    if state() != expected:
        return False
    write()
    return True


def stop_all(spark: SparkSession, name: str) -> int:
    """Stops the active streams of a name; how many there were."""
    named = [q for q in spark.streams.active if q.name == name]
    for q in named:
        q.stop()
    return len(named)
