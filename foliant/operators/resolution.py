"""Entity resolution: candidate pairs, evidence, decisions and their application to the forest of entities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import excerpt, name_words, normalized_name, uuid5
from foliant.operators.graph import star_components
from foliant.operators.relational import recent
from foliant.shared import Workspace

RECENT, PER_MENTION, PER_VERSION, RADIUS = 3, 6, 2000, 500
# Errors after which a call may be repeated.
RETRYABLE = ("MODEL_UNAVAILABLE", "MODEL_TIMEOUT", "MODEL_CONNECTION_ERROR", "MODEL_RATE_LIMITED", "MODEL_SERVER_ERROR")
CONFLICT = "CLUSTER_CONFLICT"


def candidate_pairs(mentions: DataFrame, per_mention: int = PER_MENTION, per_version: int = PER_VERSION) -> DataFrame:
    """``(version_id, left_id, right_id)``: pairs of mentions of one type worth a decision, left smaller.

    ``mentions``: ``(id, version_id, chapter_id, chapter_ordinal, entity_type, surface_text, start_offset,
    end_offset)``.  In narrative order a mention meets the last three that share a word of its name, and of the last
    three of its type those of the same chapter at most ``RADIUS`` before; equal names first, then ids, it keeps
    ``per_mention`` of them, and a version its first ``per_version``, both limits being part of the operator.
    """
    space = Workspace(mentions.sparkSession, "blocking")
    place = F.struct("chapter_ordinal", "start_offset", "id").alias("place")
    rows = space.keep(mentions.select("id", "version_id", "chapter_id", "entity_type", "start_offset", "end_offset", normalized_name("surface_text").alias("name"), name_words("surface_text").alias("words"), place))
    earlier = F.struct("id", "name", "chapter_id", "end_offset")
    # one pass finds the last of the type (without a word) and the last with each word
    groups = rows.withColumn("word", F.explode(F.concat(F.array(F.lit(None).cast("string")), "words"))).drop("words")
    met = recent(groups, ["version_id", "entity_type", "word"], ["place"], RECENT, earlier, "last", space).withColumn("seen", F.explode("last"))
    close = (F.col("seen.chapter_id") == F.col("chapter_id")) & (F.col("start_offset") - F.col("seen.end_offset") <= RADIUS)
    columns = ("version_id", "place", "id", "name", F.col("seen.id").alias("other"), F.col("seen.name").alias("other_name"))
    every = met.where(F.col("word").isNotNull() | close).select(*columns).distinct()
    choice = Window.partitionBy("version_id", "id").orderBy(F.col("name") != F.col("other_name"), "other")
    kept = every.withColumn("k", F.row_number().over(choice)).where(F.col("k") <= per_mention)
    first = Window.partitionBy("version_id").orderBy("place", "k")
    capped = kept.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_version)
    return capped.select("version_id", F.least("id", "other").alias("left_id"), F.greatest("id", "other").alias("right_id"))


def with_evidence(mentions: DataFrame, chapters: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Mentions with the excerpt around them and its id, which follows from its content.

    Adds ``(evidence_id, evidence_start, evidence_end, evidence_text, chapter)``; ``chapters``: ``(chapter_id,
    version_id, ordinal, title, chapter_text)``.
    """
    met = mentions.join(chapters, ["chapter_id", "version_id"])
    start = F.greatest(F.lit(0), F.col("start_offset") - radius)
    end = F.least(F.length("chapter_text"), F.col("end_offset") + radius)
    cut = excerpt("chapter_text", "start_offset", "end_offset", radius)
    out = met.withColumn("evidence_start", start).withColumn("evidence_end", end).withColumn("evidence_text", cut)
    name = F.concat_ws(":", F.lit("resolution"), "chapter_id", F.col("evidence_start").cast("string"), F.col("evidence_end").cast("string"), F.sha2("evidence_text", 256))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Chapter "), F.col("ordinal").cast("string")))
    return out.withColumn("evidence_id", uuid5("version_id", name)).withColumn("chapter", title).drop("chapter_text")


def assembled_pairs(pairs: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(id, version_id, left_id, right_id)`` with both sides' evidence ids, and those that conflict with their sources.

    ``sources``: ``(mention_id, version_id, entity_type, evidence_id)``.  A pair conflicts if a side is unknown or of
    another version, or the types differ.
    """
    side = lambda p: sources.select(F.col("mention_id").alias(f"{p}_id"), F.col("version_id").alias(f"{p}_version"), F.col("entity_type").alias(f"{p}_type"), F.col("evidence_id").alias(f"{p}_evidence"))
    met = pairs.join(side("left"), "left_id", "left").join(side("right"), "right_id", "left")
    same = (F.col("left_version") == F.col("version_id")) & (F.col("right_version") == F.col("version_id")) & (F.col("left_type") == F.col("right_type"))
    ok = F.coalesce(same, F.lit(False))
    evidence = F.array_distinct(F.array("left_evidence", "right_evidence"))
    return met.where(ok).select("id", "version_id", "left_id", "right_id", evidence.alias("evidence_ids")), met.where(~ok).select("id", "version_id")


def seeded(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and aliases for mentions without an entity; an entity takes its mention's id."""
    new = mentions.where("entity_id is null")
    entities = new.select("id", "version_id", "entity_type", F.col("surface_text").alias("canonical_name"), F.lit("needs_review").alias("status"), F.lit(None).cast("string").alias("merged_into_id"))
    aliases = new.select(F.col("id").alias("entity_id"), F.col("surface_text").alias("alias"), normalized_name("surface_text").alias("normalized_alias"))
    return entities, aliases


def new_pairs(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    return pairs.join(stored, ["version_id", "left_id", "right_id"], "left_anti")


def needs_evaluation(attempt: Column | None = None) -> Column:
    """Without an applied decision and either never answered or failed in a way that allows one more attempt."""
    tries = F.lit(0) if attempt is None else F.coalesce(attempt, F.lit(0))
    retry = F.coalesce(F.col("error_code").isin(*RETRYABLE), F.lit(False)) & (tries < 2)
    untouched = F.col("llm_decision").isNull() & F.col("error_code").isNull()
    return F.col("applied_decision").isNull() & (retry | untouched)


def outcome_counts(candidates: DataFrame, *by: str) -> DataFrame:
    """Per group: remaining, review, error, successful and applied candidates and applied merges."""
    applied = F.col("applied_decision").isNotNull()
    answered = F.col("llm_decision").isNotNull()
    other_error = F.col("error_code").isNotNull() & (F.col("error_code") != CONFLICT)
    return candidates.groupBy(*by).agg(
        F.count_if(needs_evaluation()).alias("remaining"),
        F.count_if(~applied & answered & ~other_error).alias("review_count"),
        F.count_if(~applied & other_error).alias("error_count"),
        F.count_if(applied | (answered & F.col("error_code").isNull())).alias("successful_count"),
        F.count_if(applied).alias("applied_count"),
        F.count_if(F.col("applied_decision") == "merge").alias("merge_count"),
    )


def valid_decision(decision: str = "decision", cited: str = "cited", left: str = "left_evidence", right: str = "right_evidence") -> Column:
    """Whether cited evidence is allowed, not repeated, and on both sides for a merge or separation."""
    allowed = F.array(left, right)
    known = (F.size(F.array_except(cited, allowed)) == 0) & (F.size(F.array_distinct(cited)) == F.size(cited))
    sides = F.array_contains(cited, F.col(left)) & F.array_contains(cited, F.col(right))
    return F.coalesce(known & (~F.col(decision).isin("merge", "keep_separate") | sides), F.lit(False))


def same_cluster(pairs: DataFrame, memberships: DataFrame) -> DataFrame:
    """``(pair_id, same)`` for pairs ``(pair_id, chapter_id, left_span, right_span)``: both spans are in one and the same cluster only.

    ``memberships``: ``(chapter_id, span, cluster)`` with clusters named by window.
    """
    sets = memberships.groupBy("chapter_id", "span").agg(F.collect_set("cluster").alias("c"))
    left, right = sets.toDF("chapter_id", "left_span", "a"), sets.toDF("chapter_id", "right_span", "b")
    met = pairs.join(left, ["chapter_id", "left_span"], "left").join(right, ["chapter_id", "right_span"], "left")
    one = (F.size("a") == 1) & (F.size("b") == 1) & (F.element_at("a", 1) == F.element_at("b", 1))
    return met.select("pair_id", F.coalesce(one, F.lit(False)).alias("same"))


def automatic_application(candidates: DataFrame, roots: DataFrame, space: Workspace | None = None) -> DataFrame:
    """``(candidate_id, outcome)`` of pending answers: ``apply``, or ``conflict`` for merges of a component that holds apart.

    ``candidates``: ``(candidate_id, left_entity_id, right_entity_id, llm_decision, applied_decision, error_code)``;
    ``roots``: ``(entity_id, root_id)``.  Proposed merges join the present roots to components; an answer or applied
    decision to keep two members of one component apart blocks every pending merge in it.  An answer to keep apart
    what is one entity already conflicts as well.
    """
    space = space or Workspace(candidates.sparkSession, "apply")
    a, b = roots.toDF("left_entity_id", "src"), roots.toDF("right_entity_id", "dst")
    ends = space.keep(candidates.join(a, "left_entity_id").join(b, "right_entity_id"))
    pending = F.col("applied_decision").isNull() & F.col("error_code").isNull()
    labels = space.keep(star_components(ends.where((F.col("llm_decision") == "merge") & pending).select("src", "dst"), space))
    one, two = labels.toDF("src", "c1"), labels.toDF("dst", "c2")
    named = ends.join(one, "src", "left").join(two, "dst", "left").withColumn("c1", F.coalesce("c1", "src")).withColumn("c2", F.coalesce("c2", "dst"))
    apart = (F.col("applied_decision") == "keep_separate") | ((F.col("llm_decision") == "keep_separate") & pending)
    blocked = named.where(apart & (F.col("c1") == F.col("c2"))).select("c1").distinct().withColumn("blocked", F.lit(True))
    answers = named.where(pending & F.col("llm_decision").isin("merge", "keep_separate")).join(blocked, "c1", "left")
    one_already = F.col("src") == F.col("dst")
    conflict = F.when(F.col("llm_decision") == "merge", F.coalesce("blocked", F.lit(False))).otherwise(one_already)
    return answers.select("candidate_id", F.when(conflict, "conflict").otherwise("apply").alias("outcome"))


def applied_in_order(decisions: DataFrame, entities: DataFrame) -> DataFrame:
    """The audit of decisions applied one after another within each version.

    ``decisions``: ``(version_id, position, candidate_id, decision, left_entity_id, right_entity_id)``; ``entities``:
    ``(version_id, entity_id, canonical_name, merged_into_id)``.  Gives ``(version_id, candidate_id, position,
    outcome, survivor_id, retired_id)`` with outcome merged, linked (already one), separated or conflict.  The longer
    name survives, then the smaller id.  The order of decisions is the meaning of this operator, but only among those
    that concern the same entities: decisions and links are parted into components, and each component is one group.
    """
    space = Workspace(decisions.sparkSession, "order")
    links = decisions.select(F.col("left_entity_id").alias("src"), F.col("right_entity_id").alias("dst")).unionByName(entities.select(F.col("entity_id").alias("src"), F.col("merged_into_id").alias("dst")))
    labels = space.keep(star_components(links, space))
    out = "version_id string, candidate_id string, position bigint, outcome string, survivor_id string, retired_id string"

    def apply(said: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        parent = {e: (p if isinstance(p, str) else None) for e, p in zip(known["entity_id"], known["merged_into_id"])}
        names = {e: n or "" for e, n in zip(known["entity_id"], known["canonical_name"])}

        def root(e: str) -> str | None:
            seen = set()
            while e in parent and e not in seen:
                if parent[e] is None:
                    return e
                seen.add(e)
                e = parent[e]
            return None

        apart: list[tuple[str, str]] = []
        rows = []
        for r in said.sort_values(["position", "candidate_id"]).itertuples():
            a, b = root(r.left_entity_id), root(r.right_entity_id)
            outcome, survivor, retired = "conflict", None, None
            if a is not None and b is not None:
                if r.decision == "keep_separate":
                    if a != b:
                        outcome = "separated"
                        apart.append((r.left_entity_id, r.right_entity_id))
                elif r.decision == "merge":
                    if a == b:
                        outcome, survivor = "linked", a
                    elif not any({root(x), root(y)} == {a, b} for x, y in apart):
                        survivor, retired = sorted((a, b), key=lambda e: (-len(names[e]), e))
                        parent[retired] = survivor
                        outcome = "merged"
            rows.append((r.version_id, r.candidate_id, r.position, outcome, survivor, retired))
        return pd.DataFrame(rows, columns=["version_id", "candidate_id", "position", "outcome", "survivor_id", "retired_id"])

    own = lambda df, key: df.join(labels.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", key))
    asked = own(decisions, "left_entity_id").groupBy("version_id", "component")
    known = own(entities, "entity_id").groupBy("version_id", "component")
    return asked.cogroup(known).applyInPandas(apply, out)


def state_of(entities: DataFrame, *ids: str) -> Column:
    """A struct of an entity row's link and status, for the snapshots before and after a decision."""
    return F.struct("entity_id", "merged_into_id", "status", *ids)


def snapshots(audit: DataFrame, entities: DataFrame) -> DataFrame:
    """``(candidate_id, before, after)``: what each merge of ``applied_in_order`` did to the entity that it retired.

    ``entities``: ``(entity_id, merged_into_id, status)`` as they stood before; both columns are structs of those fields.
    """
    merged = audit.where("outcome = 'merged'").select("candidate_id", F.col("retired_id").alias("entity_id"), "survivor_id")
    was = merged.join(entities, "entity_id").withColumn("before", state_of(entities))
    after = was.withColumn("merged_into_id", F.col("survivor_id")).withColumn("status", F.lit("merged"))
    return after.select("candidate_id", "before", state_of(entities).alias("after"))
