"""Groups of records that pairwise matches tie together, directly or through others.

Deterministic Borůvka hooking: edges have a total order, every component takes its smallest edge, which makes trees
whose only cycles are pairs of components that took the same edge; the smaller of such a pair becomes the root.
Pointer doubling collapses the trees, edges are relabelled by their roots, loops and repeats go, and the rounds end
when no edge remains.  Every round at least halves the components that still have edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.refs import normal_ref, normal_word
from foliant.shared import Workspace, is_empty


def connected_components(edges: DataFrame, space: Workspace) -> DataFrame:
    """``(node, component)`` for every node of an edge list ``(src, dst)``; ``component`` is the smallest node of it.

    Edges with a null end and loops are left out, repeated edges in either direction count once.  Hubs are
    aggregated before they are shuffled; joins on them are left to adaptive skew handling.
    """
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    left = space.keep(edges.where("src is not null and dst is not null and src <> dst").select(lo.alias("lo"), hi.alias("hi")).distinct())
    rounds: list[DataFrame] = []
    while not is_empty(left):
        labels = _collapse(_hook(left), space)
        rounds.append(labels)
        a, b = labels.toDF("lo", "a"), labels.toDF("hi", "b")
        moved = left.join(a, "lo").join(b, "hi").where(F.col("a") != F.col("b"))
        following = space.keep(moved.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
        space.drop(left)
        left = following
    if not rounds:
        return left.select(F.col("lo").alias("node"), F.col("hi").alias("component"))
    whole = rounds.pop()
    while rounds:  # from the smallest round back, so that every join has the size of its round
        whole = rounds.pop().join(whole.toDF("root", "later"), "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    whole = space.keep(whole)
    least = whole.groupBy("root").agg(F.min("node").alias("component"))
    return whole.join(least, "root").select("node", "component")


def _hook(edges: DataFrame) -> DataFrame:
    """``(node, parent)``: the other end of every node's smallest edge; the smaller end of a mutual choice is a root."""
    ends = edges.select(F.col("lo").alias("node"), "lo", "hi").unionByName(edges.select(F.col("hi").alias("node"), "lo", "hi"))
    choice = ends.groupBy("node").agg(F.min(F.struct("lo", "hi")).alias("e"))
    chosen = choice.select("node", F.when(F.col("e.lo") == F.col("node"), F.col("e.hi")).otherwise(F.col("e.lo")).alias("parent"))
    above = chosen.toDF("parent", "grand")
    mutual = F.col("grand") == F.col("node")
    return chosen.join(above, "parent").select("node", F.when(mutual, F.least("node", "parent")).otherwise(F.col("parent")).alias("parent"))


def _collapse(trees: DataFrame, space: Workspace) -> DataFrame:
    """``(node, root)`` by pointer doubling: each step halves the depth."""
    now = space.keep(trees)
    while True:
        step = now.join(now.toDF("parent", "grand"), "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved"))
        step = space.keep(step)
        space.drop(now)
        if is_empty(step.where("moved")):
            return step.select("node", F.col("parent").alias("root"))
        now = _forget(step, space)


def _forget(step: DataFrame, space: Workspace) -> DataFrame:
    bare = step.select("node", "parent")
    bare._foliant_path = step._foliant_path
    return bare


def merge_ties(answers: DataFrame, mentions: DataFrame) -> DataFrame:
    """``(src, dst)``: pairs of known mentions whose latest answer is to merge.

    Answers on a pair count in either order; the latest ``created_at`` holds (null counts as earliest; a tie goes to
    the greatest decision, then id).  Sides that are null, equal or no mention's id do not tie.
    """
    a, b = normal_ref("left_mention_id"), normal_ref("right_mention_id")
    rows = answers.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), a.isNotNull().alias("__a"), b.isNotNull().alias("__b"),
                          "created_at", normal_word("applied_decision").alias("decision"), "id")
    paired = rows.where("__a and __b and src <> dst")
    last = paired.groupBy("src", "dst").agg(F.max(F.struct("created_at", "decision", "id")).alias("last")).where("last.decision = 'merge'")
    known = mentions.select(F.lower("id").alias("id")).distinct()
    ties = last.select("src", "dst").join(known.toDF("src"), "src", "left_semi")
    return ties.join(known.toDF("dst"), "dst", "left_semi").select("src", "dst")


def merged_groups(answers: DataFrame, mentions: DataFrame) -> DataFrame:
    """``(mention_id, group_id)``: every mention of a group of two or more with the group's smallest mention id."""
    space = Workspace(answers.sparkSession, "groups")
    return connected_components(merge_ties(answers, mentions), space).toDF("mention_id", "group_id")
