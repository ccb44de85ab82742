"""Publishing rebuilt memory: behind a fence of states, without losing coverage, superseding what stood before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.memory import lost_coverage, superseded
from foliant.shared import is_empty
from foliant.sources.sinks import exists

TABLES = ("facts", "coverage", "runs")


def _stored(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    return spark.read.parquet(f"{folder}/{name}") if exists(spark, f"{folder}/{name}") else None


def judged(began: DataFrame, now: DataFrame, coverage: DataFrame, prior: DataFrame | None) -> DataFrame:
    """``(version_id, outcome)`` of every version of ``began``: ``publish``, ``stale`` or ``lost_coverage``.

    ``began`` and ``now``: ``(version_id, state)`` when the work began and at publishing; a version whose state differs or
    is gone is stale.  ``coverage`` and ``prior``: ``(version_id, chunk_id)`` that this rebuild and the published one cover.
    """
    states = began.join(now.withColumnRenamed("state", "__now"), "version_id", "left").withColumn("same", F.col("state").eqNullSafe(F.col("__now")) & F.col("__now").isNotNull())
    if prior is None:
        return states.select("version_id", F.when(F.col("same"), "publish").otherwise("stale").alias("outcome"))
    lost = lost_coverage(prior, coverage).select("version_id").distinct().withColumn("lost", F.lit(True))
    met = states.join(lost, "version_id", "left")
    return met.select("version_id", F.when(~F.col("same"), "stale").when(F.col("lost"), "lost_coverage").otherwise("publish").alias("outcome"))


def publish_rebuild(folder: str, run_id: int, facts: DataFrame, coverage: DataFrame, began: DataFrame, now: DataFrame) -> DataFrame:
    """Publishes a rebuild version by version and returns what ``judged`` said.

    Facts and coverage are added under ``run_id``, and last the row of ``runs`` that makes them count: until it is written
    readers see the old run, so a failed publish changes nothing, and one that is repeated replaces itself.
    """
    spark = facts.sparkSession
    runs = _stored(spark, folder, "runs")
    held = current_coverage(spark, folder) if runs is not None else None
    outcome = judged(began, now, coverage.select("version_id", "chunk_id"), held)
    outcome.write.mode("overwrite").parquet(f"{folder}/outcomes/run_id={run_id}")
    outcome = spark.read.parquet(f"{folder}/outcomes/run_id={run_id}")
    good = outcome.where("outcome = 'publish'").select("version_id")
    if not is_empty(good):
        for name, rows in (("facts", facts), ("coverage", coverage), ("runs", good)):
            rows.join(good, "version_id", "left_semi").write.mode("overwrite").parquet(f"{folder}/{name}/run_id={run_id}")
    return outcome


def newest_run(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/runs").groupBy("version_id").agg(F.max("run_id").alias("run_id"))


def current_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/coverage").join(newest_run(spark, folder), ["version_id", "run_id"], "left_semi").select("version_id", "chunk_id")


def published_facts(spark: SparkSession, folder: str) -> DataFrame:
    """All facts of all runs with their ``status``: active for the newest published run of a version, superseded before."""
    known = spark.read.parquet(f"{folder}/facts").join(spark.read.parquet(f"{folder}/runs"), ["version_id", "run_id"], "left_semi")
    return superseded(known, newest_run(spark, folder))
