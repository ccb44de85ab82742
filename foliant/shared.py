"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder.  Iterative operators write each round there as Parquet and read it
back: the plan stays short and a lost executor costs only its running tasks.  Where the setting is missing and all of
Spark runs in this process (unit tests, a laptop) one temporary folder per session stands in; anywhere else its
absence is an error, since executors would write to disks of their own.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_LOCAL_STANDIN = "spark.foliant.standin.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one where none is configured and Spark runs in one process."""
    configured = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not _one_process(master):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors share: master {master} has several disks")
    standin = spark.conf.get(_LOCAL_STANDIN, None)
    if not standin:
        folder = tempfile.mkdtemp(prefix="foliant-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        standin = f"file://{folder}"
        spark.conf.set(_LOCAL_STANDIN, standin)
    return standin


def _one_process(master: str) -> bool:
    return re.fullmatch(r"local(\[[^\]]*\])?", master) is not None


def _delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder if the session still runs."""
    context = spark.sparkContext
    try:
        if context._jsc is not None:
            hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session is ending; what stays is only space
        return


class Workspace:
    """Written intermediate tables of one operator call.

    ``keep`` writes a frame and returns the frame that reads it.  ``drop`` removes a table that no later plan
    reads; loops call it for the round before last, so at most two rounds are on disk.  What is left goes when the
    driver's process ends, since frames that were returned read it until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(_delete, spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._count}"
        self._count += 1
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._foliant_path = path
        return kept

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_foliant_path", None)
        if path:
            _delete(self.spark, path)


SMALL_TASK = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, read from files, over all cores if it is too small to fill them.

    A file with one row group is one task however much work its rows are.  Only inputs of less than ``SMALL_TASK``
    bytes a core are moved; larger ones come in tasks enough.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_TASK else df


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
