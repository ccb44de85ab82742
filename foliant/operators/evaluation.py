"""Scores of extraction, resolution, memory and structure against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.relational import precision_recall

NONE, MISSING = "__none__", "__missing__"


def compared_spans(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """``(id, start_offset, end_offset, expected_type, predicted_type)``: both sides' spans matched by boundary.

    A boundary that only one side has gets ``__none__`` or ``__missing__`` on the other.  Of several types at one
    boundary of one side the greatest counts.
    """
    at = ["id", "start_offset", "end_offset"]
    one = lambda df, n: df.groupBy(*at).agg(F.max("entity_type").alias(n))
    both = one(expected, "e").join(one(predicted, "p"), at, "full_outer")
    return both.select(*at, F.coalesce("e", F.lit(NONE)).alias("expected_type"), F.coalesce("p", F.lit(MISSING)).alias("predicted_type"))


def confusion(compared: DataFrame, *by: str) -> DataFrame:
    return compared.groupBy(*by, "expected_type", "predicted_type").agg(F.count(F.lit(1)).alias("n"))


def _is_expected() -> Column:
    return F.col("expected_type") != NONE


def _is_predicted() -> Column:
    return F.col("predicted_type") != MISSING


def extraction_scores(compared: DataFrame, empty: str, *by: str) -> DataFrame:
    """Counts, precision, recall and F1 of exact spans with types, and type accuracy where boundaries match."""
    sums = compared.groupBy(*by).agg(
        F.count_if(F.col("expected_type") == F.col("predicted_type")).alias("tp"),
        F.count_if(_is_predicted()).alias("predicted"),
        F.count_if(_is_expected()).alias("expected"),
        F.count_if(_is_expected() & _is_predicted()).alias("boundaries"),
    )
    scores = precision_recall(F.col("tp"), F.col("predicted"), F.col("expected"), empty)
    accuracy = F.round(F.coalesce(F.try_divide("tp", "boundaries"), F.lit(0.0)), 6).alias("type_accuracy")
    return sums.select(*by, "tp", "predicted", "expected", *scores, accuracy)


def recall_by_type(compared: DataFrame) -> DataFrame:
    """``(entity_type, expected, recall)`` over types that occur in the labels."""
    rows = compared.where(_is_expected()).groupBy(F.col("expected_type").alias("entity_type"))
    return rows.agg(F.count(F.lit(1)).alias("expected"), F.round(F.avg((F.col("expected_type") == F.col("predicted_type")).cast("double")), 6).alias("recall"))


def resolution_scores(rows: DataFrame, *by: str) -> DataFrame:
    """Scores of decisions ``(expected, candidate, error)``: an errored row predicts nothing; empty sides give null."""
    good = F.col("error").isNull()
    merge = lambda c: F.coalesce(F.col(c) == "merge", F.lit(False))
    same = F.coalesce(F.col("candidate") == F.col("expected"), F.lit(False))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(merge("candidate") & good).alias("predicted"), F.count_if(merge("expected")).alias("expected"),
        F.count_if(merge("candidate") & merge("expected") & good).alias("tp"), share(same & good).alias("decision_accuracy"),
        share(F.coalesce(F.col("candidate") == "needs_review", F.lit(False)) & good).alias("review_rate"), share(~good).alias("error_rate"),
    )
    p, r, _ = precision_recall(F.col("tp"), F.col("predicted"), F.col("expected"), "null")
    f1 = F.round(F.try_divide(2 * F.col("tp"), F.col("predicted") + F.col("expected")), 6).alias("f1")
    wrong = (F.col("predicted") - F.col("tp")).alias("incorrect_merges")
    return sums.select(*by, "n", p, r, f1, wrong, "decision_accuracy", "review_rate", "error_rate")


def set_scores(predicted: DataFrame, expected: DataFrame, kind: str, key: str) -> DataFrame:
    """``(kind, precision, recall, f1)`` of two sets of keys per kind; two empty sets agree."""
    a = predicted.select(kind, key).distinct().withColumn("p", F.lit(1))
    b = expected.select(kind, key).distinct().withColumn("e", F.lit(1))
    both = a.join(b, [kind, key], "full_outer").groupBy(kind).agg(
        F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("tp"), F.count("p").alias("predicted"), F.count("e").alias("expected")
    )
    return both.select(kind, *precision_recall(F.col("tp"), F.col("predicted"), F.col("expected"), "agree"))


def macro_f1(scores: DataFrame) -> DataFrame:
    return scores.agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


def link_scores(predicted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the share of expected links that were predicted, and of predicted links that were expected."""
    a = predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    b = expected.select(*keys).distinct().withColumn("e", F.lit(1))
    n = a.join(b, keys, "full_outer").agg(F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("tp"), F.count("p").alias("p"), F.count("e").alias("e"))
    return n.select(F.round(F.coalesce(F.try_divide("tp", "e"), F.lit(1.0)), 6).alias("accuracy"), F.round(F.coalesce(F.try_divide("tp", "p"), F.lit(0.0)), 6).alias("precision"))


def boundary_scores(predicted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """One row with tp, fp, fn and the scores of two sets of boundaries; an empty side gives null."""
    a = predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    b = expected.select(*keys).distinct().withColumn("e", F.lit(1))
    n = a.join(b, keys, "full_outer").agg(
        F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")
    )
    p, r, f1 = precision_recall(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"), "null")
    return n.select("tp", "fp", "fn", p, r, F.coalesce(f1, F.lit(0.0)).alias("f1"))


def usage_counts(calls: DataFrame, usage: str, *by: str) -> DataFrame:
    """``(by…, call, key, tokens)``: the counts that a call's usage map states; only whole numbers from 0 on are counts.

    ``usage``: a column of JSON objects, ``call`` a column that tells the calls apart.
    """
    stated = calls.select(*by, "call", F.explode(F.from_json(usage, "map<string,string>")).alias("key", "said"))
    return stated.where(F.col("said").rlike("^[0-9]{1,18}$")).select(*by, "call", "key", F.col("said").cast("long").alias("tokens"))


def usage_sums(calls: DataFrame, usage: str, *by: str) -> DataFrame:
    """``(by…, key, total)``: tokens by key over all calls; true, false, negative and broken numbers do not count."""
    return usage_counts(calls, usage, *by).groupBy(*by, "key").agg(F.sum("tokens").alias("total"))


def token_costs(calls: DataFrame, usage: str, prices: dict[str, float], *by: str) -> DataFrame:
    """``(by…, calls, cost)``: tokens times their price a million, null if any call of the group lacks a priced count."""
    counts = usage_counts(calls, usage, *by).where(F.col("key").isin(*prices))
    price = F.create_map(*(F.lit(x) for pair in prices.items() for x in pair))
    per = counts.groupBy(*by, "call").agg(F.count_distinct("key").alias("stated"), F.sum(F.col("tokens") * F.element_at(price, F.col("key")) / 1e6).alias("cost"))
    every = calls.select(*by, "call").distinct().join(per, [*by, "call"], "left")
    complete = F.bool_and(F.coalesce(F.col("stated") == len(prices), F.lit(False)))
    return every.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.when(complete, F.round(F.sum("cost"), 6)).alias("cost"))


def call_rates(calls: DataFrame, *by: str) -> DataFrame:
    """Rates of calls ``(repairs, error, decision, fallback)``: repaired, accepted at once, failed, left to review, fallen back.

    ``fallback`` says whether another model answered; its rate is null unless it is known of every call.
    """
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    good = F.col("error").isNull()
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), share(F.col("repairs") > 0).alias("repair_rate"), share(good & (F.col("repairs") == 0)).alias("first_pass_rate"),
        share(~good).alias("error_rate"), share(F.coalesce(F.col("decision") == "needs_review", F.lit(False))).alias("review_rate"),
        F.when(F.bool_and(F.col("fallback").isNotNull()), share(F.col("fallback"))).alias("fallback_rate"),
    )


def candidate_recall(pairs: DataFrame, positives: DataFrame, *by: str) -> DataFrame:
    """``(by…, positives, generated, recall)``: how many of the true pairs ``(by…, left_id, right_id)`` are among the generated ones."""
    keys = [*by, "left_id", "right_id"]
    met = positives.select(*keys).distinct().join(pairs.select(*keys).distinct().withColumn("__made", F.lit(1)), keys, "left")
    sums = met.groupBy(*by).agg(F.count(F.lit(1)).alias("positives"), F.count("__made").alias("generated"))
    return sums.withColumn("recall", F.round(F.try_divide("generated", "positives"), 6))


def arm_comparison(rows: DataFrame, *by: str) -> DataFrame:
    """``(by…, n, baseline_accuracy, candidate_accuracy, gain, fixed, broken)`` of rows ``(expected, baseline, candidate)``; no answer is a wrong one."""
    right = lambda c: F.coalesce(F.col(c) == F.col("expected"), F.lit(False))
    a, b = right("baseline"), right("candidate")
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count_if(b & ~a).alias("fixed"), F.count_if(a & ~b).alias("broken"))
    share = lambda c, n: F.round(c / F.col("n"), 6).alias(n)
    return sums.select(*by, "n", share(F.col("a"), "baseline_accuracy"), share(F.col("b"), "candidate_accuracy"), share(F.col("b") - F.col("a"), "gain"), "fixed", "broken")


def located(rows: DataFrame, ref: str) -> Column:
    """Start of a reference ``{text, occurrence}`` in ``text``, counted in whole words from 0; null if it is not there."""
    word = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.col(f"{ref}.text"), F.lit(r"\E(?![\p{L}\p{N}_])"))
    parts = F.split(F.col("text"), word, -1)
    n = F.coalesce(F.col(f"{ref}.occurrence"), F.lit(0))
    before = F.aggregate(F.slice(parts, 1, n + 1), F.lit(0), lambda s, p: s + F.length(p)) + n * F.length(F.col(f"{ref}.text"))
    return F.when(F.size(parts) > n + 1, before)
