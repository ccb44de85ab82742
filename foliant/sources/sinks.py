"""Writers: JSON rows, the chunk index, object paths and results kept by fingerprint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import all_finite
from foliant.shared import Workspace

#: The fields of the chunk index.
INDEX_SCHEMA = T.StructType(
    [
        T.StructField("project_id", T.StringType(), False),
        T.StructField("version_id", T.StringType(), False),
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("chapter_id", T.StringType()),
        T.StructField("scene_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("start_offset", T.LongType()),
        T.StructField("end_offset", T.LongType()),
        T.StructField("embedding_version", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
SCOPE = ("project_id", "version_id")


def _files(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def object_path(root: str, project_id: Column, version: Column, name: Column) -> Column:
    """Where an uploaded file is kept: it follows from project, version number and name."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), project_id, version.cast("string"), F.element_at(F.split(name, r"[/\\]"), -1))


def delete_object(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.delete(p, True)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; readers see the old rows or all of the new, by the commit protocol of the job."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def create_index(spark: SparkSession, path: str) -> bool:
    """An empty index with the fixed schema unless there is one; whether it was made."""
    if exists(spark, path):
        return False
    spark.createDataFrame([], INDEX_SCHEMA).write.partitionBy(*SCOPE).parquet(path)
    return True


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


def replace_in_index(chunks: DataFrame, path: str, embedding_version: str, dimensions: int) -> None:
    """Replaces the index's rows of every (project, version) in ``chunks``.

    Rows with other fields, a missing scope or id, another embedding version, or a vector of another length or that
    is not finite fail the whole write before anything is replaced.
    """
    extra = set(chunks.columns) ^ set(INDEX_SCHEMA.names)
    if extra:
        raise ValueError(f"fields that the index does not have, or lacks: {sorted(extra)}")
    bad = F.col("project_id").isNull() | F.col("version_id").isNull() | F.col("chunk_id").isNull()
    bad = bad | ~F.coalesce(F.col("embedding_version") == embedding_version, F.lit(False))
    bad = bad | ~F.coalesce(F.size("embedding") == dimensions, F.lit(False)) | ~all_finite("embedding")
    space = Workspace(chunks.sparkSession, "index")  # the rows are made once, whatever model makes their vectors
    staged = space.keep(chunks.withColumn("__bad", bad))
    refused = staged.where("__bad").count()
    if refused:
        space.drop(staged)
        raise ValueError(f"{refused} rows do not fit the index")
    rows = staged.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in INDEX_SCHEMA))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SCOPE).parquet(path)


def fingerprint(df: DataFrame, *columns: str) -> str:
    """A digest of the rows' named columns that does not depend on their order."""
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    half = lambda a: F.conv(F.substring(row, a, 8), 16, 10).cast("long")
    sums = df.agg(F.count(F.lit(1)).alias("n"), *(F.sum(half(a)).cast("string").alias(f"s{a}") for a in (1, 9, 17, 25)))
    return sums.select(F.sha2(F.concat_ws("|", F.col("n").cast("string"), *(F.coalesce(f"s{a}", F.lit("")) for a in (1, 9, 17, 25))), 256)).first()[0]


def kept_result(spark: SparkSession, folder: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The result stored under ``key``; built and written first if there is none complete."""
    path = f"{folder}/{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
