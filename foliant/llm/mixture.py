"""Mixing sources to target weights.

Tokens are summed per source, a repetition rate follows for each source, and every document of the source comes
out ``floor(rate)`` times plus once more with a probability equal to the fraction, decided by a seeded hash of its
key, so the mixture is the same in every run and on every cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.bpe import DEFAULT_TOKENIZER, token_counts
from foliant.refs import normal_word
from foliant.shared import Workspace

RATES = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("target_share", T.DoubleType()),
        T.StructField("max_repeats", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("rate", T.DoubleType()),
    ]
)


def repetition_rates(targets: list[tuple[str, float, int, int, int]], total: float) -> list[tuple]:
    """Rates for (source, share, cap, documents, tokens) so that the mixture has ``total`` tokens.

    A source whose share would need more than ``cap`` uses of each document gets the cap; what it leaves open
    goes to the others in proportion to their shares, which keeps their weights among each other.  If all sources
    are at their caps the mixture stays smaller.
    """
    open_ = {s: share for s, share, cap, _, tokens in targets if share > 0 and cap > 0 and tokens > 0}
    rates = {s: 0.0 for s, *_ in targets}
    left = float(total)
    while open_:
        weight = sum(open_.values())
        wanted = {s: left * open_[s] / weight / tokens for s, _, _, _, tokens in targets if s in open_}
        full = [(s, cap, tokens) for s, _, cap, _, tokens in targets if s in open_ and wanted[s] >= cap]
        if not full:
            rates |= wanted
            break
        for s, cap, tokens in full:
            rates[s] = float(cap)
            left -= cap * tokens
            del open_[s]
    return [(s, share, cap, docs, tokens, rates[s]) for s, share, cap, docs, tokens in targets]


def counted_documents(docs: DataFrame, space: Workspace, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """A written table ``(doc_id, source, lot, n_tokens)``; sources in lower case without blanks, ``lot`` a hash of id and text."""
    rows = docs.select("doc_id", normal_word("source").alias("source"), F.xxhash64("doc_id", "text").alias("lot"), "text")
    return space.keep(token_counts(rows, ["doc_id", "source", "lot"], "text", tokenizer))


def source_rates(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source with its rate.

    ``targets`` is a table of sources, one row each by contract: its size does not follow the corpus, and neither
    does the per-source aggregate after the join with it, so both come to the driver.  Targets that are null or
    negative count as zero, a null cap as one, repeated sources add up with the largest cap.
    """
    wanted = (
        targets.select(
            normal_word("source").alias("source"),
            F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("target_share"),
            F.greatest(F.coalesce(F.col("max_repeats").cast("long"), F.lit(1)), F.lit(0)).alias("max_repeats"),
        )
        .where("source is not null")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    totals = counted.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    rows = wanted.join(totals, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)), F.coalesce("n_tokens", F.lit(0))
    )
    corpus = counted.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    rates = repetition_rates(sorted(map(tuple, rows.collect())), corpus)
    return counted.sparkSession.createDataFrame(rates, RATES)


def mixture(counted: DataFrame, rates: DataFrame, seed: int = 8) -> DataFrame:
    """Rows ``(doc_id, source, n_tokens, copy_no)``: every use of a document in the mixture, copies from 1.

    A document with a null or unlisted source has no use.  Rows that repeat a document are separate documents.  The draw
    follows from id and text, so documents without an id have draws of their own; only equal rows share one.
    """
    draw = F.pmod(F.xxhash64("lot", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor("rate")
    copies = whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)
    used = counted.join(F.broadcast(rates.select("source", "rate")), "source").withColumn("__n", copies.cast("long"))
    return used.where("__n > 0").select(
        "doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("copy_no")
    )


def mixture_report(mixed: DataFrame, rates: DataFrame) -> DataFrame:
    """Per target source: what it had, its rate, the tokens used and the share reached of the whole mixture."""
    used = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("used_docs"), F.sum("n_tokens").alias("used_tokens"), F.max("copy_no").alias("most_uses")
    )
    return (
        rates.join(used, "source", "left")
        .withColumn("__all", F.sum("used_tokens").over(Window.partitionBy()))  # one row per target source
        .select(
            "source",
            "target_share",
            "max_repeats",
            "n_docs",
            "n_tokens",
            "rate",
            F.coalesce("used_docs", F.lit(0)).alias("used_docs"),
            F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
            F.coalesce(F.try_divide(F.coalesce("used_tokens", F.lit(0)), F.col("__all")), F.lit(0.0)).alias("reached_share"),
        )
    )
