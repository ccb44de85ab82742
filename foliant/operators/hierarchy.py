"""Parent-child links of unknown depth: roots, depths, paths, descendants and circles.

Each task joins the links it holds in a weighted disjoint-set forest: a node points to a node above it, with the
number of links between them.  What remains open are nodes at the edge of a task's share, whose own link another task
holds; only they go to the next level, in fewer and wider ranges, until none remains.  Depths then come back down by
one join per level, and paths by walking an index of parents inside each tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.refs import normal_ref
from foliant.shared import Workspace, is_empty

FOREST_LINKS = 400_000  # links that one task holds at a time
TREE_NODES = 200_000  # nodes of a tree whose paths one task walks; larger trees take doubling joins
PATH_IDS = 1_000_000  # ids in the paths of one tree that one task writes
CYCLE, MISSING = "cycle", "missing"


class WeightedForest:
    """Disjoint sets of nodes with offsets to the node above them; path compression keeps walks short."""

    def __init__(self, links: dict[str, tuple[str, int]]):
        self.links = links
        self.found: dict[str, tuple[str, int, bool]] = {}

    def find(self, node: str) -> tuple[str, int, bool]:
        """Topmost node reachable here, number of links to it, and whether the way runs into a circle."""
        walk: list[str] = []
        on_walk: set[str] = set()
        links, found = self.links, self.found
        at = node
        while at in links and at not in found and at not in on_walk:
            walk.append(at)
            on_walk.add(at)
            at = links[at][0]
        if at in on_walk:
            for n in walk:
                found[n] = (at, -1, True)
            return found[node]
        top, offset, circle = found.get(at, (at, 0, False))
        for n in reversed(walk):
            offset += links[n][1]
            found[n] = (top, -1 if circle else offset, circle)
        return found.get(node, (top, 0, circle))


def _contract(links: DataFrame) -> DataFrame:
    """``(place, node, top, off, circle)`` of links ``(place, node, parent, w)``, as far as each task's share reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            place, node, parent, w = (table.column(i).to_pylist() for i in range(4))
            forest = WeightedForest({n: (p, k) for n, p, k in zip(node, parent, w)})
            tops = [forest.find(n) for n in node]
            out = pa.table(
                {
                    "place": pa.array(place, pa.string()), "node": pa.array(node, pa.string()), "top": pa.array([t[0] for t in tops], pa.string()),
                    "off": pa.array([t[1] for t in tops], pa.int64()), "circle": pa.array([t[2] for t in tops], pa.bool_()),
                }
            )
            yield from out.to_batches(max_chunksize=10_000)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= FOREST_LINKS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return links.select("place", "node", "parent", "w").mapInArrow(run, "place string, node string, top string, off bigint, circle boolean")


def _doubled(level: DataFrame) -> DataFrame:
    """One step of pointer doubling on ``(place, node, top, off, circle)``: every open node jumps over its top."""
    above = level.select(F.col("node").alias("top"), F.col("top").alias("t2"), F.col("off").alias("o2"), F.col("circle").alias("c2"))
    return level.join(above, "top", "left").select(
        "place", "node", F.coalesce("t2", "top").alias("top"), (F.col("off") + F.coalesce("o2", F.lit(0))).alias("off"), (F.col("circle") | F.coalesce("c2", F.lit(False))).alias("circle")
    )


def _open(level: DataFrame) -> DataFrame:
    """The rows of a level whose node is the top of another row that is not settled."""
    tops = level.where("not circle").select(F.col("top").alias("node")).distinct()
    return level.join(tops, "node", "left_semi").select("place", "node", "top", "off", "circle")


def roots_of(links: DataFrame, space: Workspace) -> DataFrame:
    """``(node, root, depth, circle)`` for every row of ``links`` ``(place, node, parent)``, one row per node.

    ``place`` is any column that most links stay within; it only serves locality.  ``root`` is a node without a link,
    ``depth`` the number of links to it; nodes on or leading into a circle have ``circle`` true.
    """
    level = space.keep(_contract(links.withColumn("w", F.lit(1).cast("long")).repartitionByRange("place", "node")))
    levels, before = [level], None
    while True:
        edge = space.keep(_open(levels[-1]))
        rows = edge.count()
        if rows == 0:
            break
        settled = edge.where("circle")  # what leads into a circle below is told by these rows themselves
        unsettled = edge.where("not circle").select("place", "node", F.col("top").alias("parent"), F.col("off").alias("w"))
        if before is not None and rows > 0.7 * before and rows > FOREST_LINKS:
            step = space.keep(_walk_up(edge, space, rows))
            levels.append(step)
            break
        parts = -(-rows // FOREST_LINKS)
        wide = unsettled.coalesce(1) if parts == 1 else unsettled.repartitionByRange(parts, "place", "node")
        merged = _contract(wide).unionByName(settled)
        levels.append(space.keep(merged))
        before = rows
    known = levels.pop()
    while levels:
        above = known.select(F.col("node").alias("top"), F.col("top").alias("t2"), F.col("off").alias("o2"), F.col("circle").alias("c2"))
        below = levels.pop()
        known = below.join(above, "top", "left").select(
            "place", "node", F.coalesce("t2", "top").alias("top"), (F.col("off") + F.coalesce("o2", F.lit(0))).alias("off"), (F.col("circle") | F.coalesce("c2", F.lit(False))).alias("circle")
        )
    return known.select("node", F.col("top").alias("root"), F.col("off").alias("depth"), "circle")


def _walk_up(edge: DataFrame, space: Workspace, rows: int) -> DataFrame:
    """Doubling to the end, for links that no ranges keep together.  What is still open after 2^k >= rows links is a circle."""
    now = edge
    for _ in range(max(rows.bit_length(), 1) + 1):
        if is_empty(_open(now).where("not circle")):
            return now
        now = space.keep(_doubled(now))
    open_tops = now.select(F.col("node").alias("top")).withColumn("c2", F.lit(True))
    return now.join(open_tops, "top", "left").select("place", "node", "top", "off", (F.col("circle") | F.coalesce("c2", F.lit(False))).alias("circle"))


def valid_entities(entities: DataFrame) -> DataFrame:
    """``(entity_id, place, parent)``: the latest state of every id by ``updated_at`` (null counts as earliest)."""
    newest = F.max(F.struct("updated_at", normal_ref("merged_into_id").alias("parent"), normal_ref("manuscript_version_id").alias("place"))).alias("e")
    rows = entities.where("id is not null").groupBy(normal_ref("id").alias("entity_id")).agg(newest)
    return rows.select("entity_id", F.coalesce("e.place", F.lit("")).alias("place"), "e.parent")


def entity_roots(entities: DataFrame, space: Workspace | None = None) -> DataFrame:
    """``(entity_id, root_id, depth)`` for every entity whose valid row has a link.

    ``root_id`` is ``'cycle'`` with depth -1 for an entity on a circle (a link to itself is one) or leading into one,
    and ``'missing'`` with depth -1 where the links end at an id that is no entity.
    """
    space = space or Workspace(entities.sparkSession, "roots")
    valid = space.keep(valid_entities(entities))
    links = valid.where("parent is not null").select("place", F.col("entity_id").alias("node"), "parent")
    found = space.keep(roots_of(links, space))
    ends = found.where("not circle").select("root").distinct()
    real = ends.join(valid.select(F.col("entity_id").alias("root")), "root", "left_semi").withColumn("real", F.lit(True))
    told = found.join(real, "root", "left")
    state = F.when(F.col("circle"), CYCLE).when(F.col("real"), F.col("root")).otherwise(MISSING)
    return told.select(F.col("node").alias("entity_id"), state.alias("root_id"), F.when(state.isin(CYCLE, MISSING), F.lit(-1)).otherwise(F.col("depth")).cast("long").alias("depth"))


def entity_paths(entities: DataFrame) -> DataFrame:
    """``(entity_id, root_id, depth, path)`` of every entity of a tree, roots with depth 0 included.

    ``path`` is an array of ids from the root down to the entity.  Entities of circles or with a missing end have no
    path and no row.  A tree of up to ``TREE_NODES`` nodes whose paths have up to ``PATH_IDS`` ids in all is walked in one
    task; larger and deeper ones take joins that double the length of every path until it reaches the root.
    """
    space = Workspace(entities.sparkSession, "paths")
    valid = space.keep(valid_entities(entities))
    linked = entity_roots(entities, space).where("depth >= 0")
    below = linked.join(valid.select("entity_id", "parent"), "entity_id")
    tops = valid.where("parent is null").select("entity_id", F.col("entity_id").alias("root_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("parent"))
    nodes = space.keep(below.select("entity_id", "root_id", "depth", "parent").unionByName(tops))
    size = nodes.groupBy("root_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("depth") + 1).alias("ids")).where((F.col("n") > TREE_NODES) | (F.col("ids") > PATH_IDS)).select("root_id")
    large = space.keep(size)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(rows: dict[str, tuple[str, str | None, int]]) -> pa.RecordBatch:
            paths: dict[str, list[str]] = {}
            for node in sorted(rows, key=lambda n: rows[n][2]):  # parents before children
                parent = rows[node][1]
                paths[node] = [*(paths[parent] if parent is not None else ()), node]
            ids = list(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array([rows[n][0] for n in ids], pa.string()), pa.array([rows[n][2] for n in ids], pa.int64()), pa.array([paths[n] for n in ids], pa.list_(pa.string()))],
                names=["entity_id", "root_id", "depth", "path"],
            )

        root, rows, ids = None, {}, 0
        for batch in batches:
            for node, r, depth, parent in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if r != root and (len(rows) >= 5_000 or ids >= 100_000):  # whole trees at a time
                    yield tree(rows)
                    rows, ids = {}, 0
                root = r
                ids += depth + 1
                rows[node] = (r, parent, depth)
        if rows:
            yield tree(rows)

    small = nodes.join(large, "root_id", "left_anti").select("entity_id", "root_id", "depth", "parent").repartition("root_id").sortWithinPartitions("root_id")
    walked = small.mapInArrow(walk, "entity_id string, root_id string, depth bigint, path array<string>")
    if is_empty(large):
        return walked
    now = nodes.join(large, "root_id", "left_semi").select("entity_id", "root_id", "depth", F.col("parent").alias("up"), F.array("entity_id").alias("path"))
    now = space.keep(now)
    while not is_empty(now.where("up is not null")):
        above = now.select(F.col("entity_id").alias("up"), F.col("up").alias("u2"), F.col("path").alias("p2"))
        now = space.keep(now.join(above, "up", "left").select("entity_id", "root_id", "depth", F.col("u2").alias("up"), F.when(F.col("p2").isNull(), F.col("path")).otherwise(F.concat("p2", "path")).alias("path")))
    return walked.unionByName(now.select("entity_id", "root_id", "depth", "path"))


def entity_descendants(paths: DataFrame) -> DataFrame:
    """``(ancestor_id, descendant_id, distance)`` of all entities below each entity of a tree."""
    steps = paths.select(F.col("entity_id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "ancestor_id"))
    return steps.where("ancestor_id <> descendant_id").select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))


def mention_roots(mentions: DataFrame, roots: DataFrame) -> DataFrame:
    """``(mention_id, entity_id, root_id, depth)``: every mention with an entity, at the root of its entity's tree.

    The latest delivery of a mention holds.  An entity without a link, or unknown, is its own root with depth 0.
    """
    last = mentions.groupBy(F.col("id").alias("mention_id")).agg(F.max(F.struct("loaded_at", normal_ref("entity_id").alias("entity_id"))).alias("m"))
    rows = last.select("mention_id", "m.entity_id").where("entity_id is not null").join(roots, "entity_id", "left")
    return rows.select("mention_id", "entity_id", F.coalesce("root_id", "entity_id").alias("root_id"), F.coalesce("depth", F.lit(0)).alias("depth"))
