"""What holds where the same chapter, version or mention was delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.refs import normal_digest, normal_ref


def latest_chapters(chapters: DataFrame) -> DataFrame:
    """``(chapter_id, version_id, ordinal, title, chapter_text)``: every chapter as its latest delivery has it.

    Deliveries of one moment go by the greater digest of their content, then title and ordinal.  Where the latest has a
    digest and no text, the text of another delivery with that digest stands for it, else the text is null.
    """
    rows = chapters.select(
        normal_ref("id").alias("chapter_id"), "loaded_at", F.coalesce(F.sha2("text", 256), normal_digest("content_hash")).alias("digest"),
        "title", "ordinal", normal_ref("manuscript_version_id").alias("version_id"), "text",
    )
    row = F.struct("loaded_at", "digest", "title", "ordinal", "version_id")
    contents = rows.groupBy("chapter_id", "digest").agg(F.max(row).alias("row"), F.max("text").alias("text"))
    held = contents.groupBy("chapter_id").agg(F.max(F.struct("row", "text")).alias("h"))
    return held.select("chapter_id", "h.row.version_id", "h.row.ordinal", "h.row.title", F.col("h.text").alias("chapter_text"))


def newest_rows(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """``(key, columns…)``: one whole row per key, the greatest in the order of the columns."""
    return df.groupBy(key).agg(F.max(F.struct(*columns)).alias("__row")).select(key, "__row.*")
