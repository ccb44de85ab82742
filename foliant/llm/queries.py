"""The queries of this folder's operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.bpe import encode_corpus, token_counts
from foliant.llm.components import merged_groups
from foliant.llm.language import detect_languages, fit_models, label_sample, missing_or_wrong
from foliant.llm.mixture import counted_documents, mixture, mixture_report, source_rates
from foliant.llm.names import linked_entities, linked_pairs, review_names
from foliant.llm.overlap import overlap_report, split_overlaps
from foliant.llm.splitting import oversized_scenes, split_texts
from foliant.llm.sql import SQL
from foliant.shared import Workspace
from foliant.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return merged_groups(table(spark, d, "entity_resolution_candidates"), table(spark, d, "entity_mentions"))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    names = review_names(table(spark, d, "entities"), table(spark, d, "entity_aliases"), table(spark, d, "entity_mentions"))
    forms = [tuple(r) for r in table(spark, d, "name_forms").select("given_name", "short_form").collect()]  # fixed table
    return linked_entities(names, forms)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_pairs(p4_clusters(spark, d))


def _evaluation_records(spark: SparkSession, d: str) -> DataFrame:
    names = ("entity_resolution_v1", "entity_extraction_model_eval_v3")
    first, second = (table(spark, d, n).select("id", "split", F.lit(n).alias("source"), "text") for n in names)
    return first.unionByName(second)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = split_overlaps(_evaluation_records(spark, d))
    return pairs.select(F.least("eval_id", "train_id").alias("left_id"), F.greatest("eval_id", "train_id").alias("right_id"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(_evaluation_records(spark, d))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    scenes = oversized_scenes(table(spark, d, "scenes"), table(spark, d, "chapters"))
    return split_texts(scenes, "scene_id", "text", "start_offset")


def p6_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every scene put together again from its pieces, and how many of them are too long or overlap by another length."""
    pieces = p6_pieces(spark, d)
    before = F.lag("end_offset").over(Window.partitionBy("scene_id").orderBy("piece_no"))
    part = F.substring("text", (F.coalesce(F.col("before") - F.col("start_offset"), F.lit(0)) + 1).cast("int"), F.length("text"))
    rows = pieces.withColumn("before", before).withColumn("part", part)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "part"))), lambda p: p["part"]), "")
    return rows.groupBy("scene_id").agg(
        F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"), F.sha2(whole, 256).alias("digest"), F.count_if(F.length("text") > 2400).alias("too_long"),
        F.count_if(F.col("before") - F.col("start_offset") != 240).alias("wrong_overlaps"),
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).where("piece_no = 1").select("scene_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p7_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts(table(spark, d, "documents"), ["doc_id", "source"])


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counted = counted_documents(table(spark, d, "documents"), Workspace(spark, "p8"))
    rates = source_rates(counted, table(spark, d, "mixture_targets"))
    return mixture(counted, rates), rates


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture_report(*_mixture(spark, d))


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return detect_languages(docs, fit_models(label_sample(docs)))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return missing_or_wrong(p9_languages(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p4_found, p4_clusters, p5_found, p5_report, p6_pieces, p6_whole, p6_found, p7_ids, p7_token_counts, p8_mixture, p8_shares, p9_languages, p9_found)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
