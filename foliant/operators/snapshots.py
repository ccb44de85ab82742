"""What changed between consecutive full snapshots.

Both snapshots of a pair are summed into one invertible Bloom lookup table per hash bucket of the keys, the later one
with sign +1 and the earlier with -1: records that stand in both cancel out, so what is left has the size of the
difference.  Cells that hold one record are peeled until none are left; a bucket whose cells do not peel, or whose
peeled records do not add up to its digest, is summed again with four times the cells.  Recovered records are then
classified by the signs found for their key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.refs import normal_digest, normal_ref, normal_word
from foliant.shared import Workspace, is_empty

BUCKET_RECORDS = 1024  # records of both snapshots in a bucket, on average
FIRST_CELLS = 8  # cells of each of the three parts of a table in the first round
GROWTH = 4
MOST_TURNS = 9  # by then a bucket has hundreds of cells for every record it can hold
FINISHED = ("ready", "archived")

_M = (1 << 64) - 1
#: The primes of the 64-bit xxHash.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_CHECK, _DIGEST = 101, 102  # last arguments of the hashes that guard a cell and a bucket


def _hash_long(value: int, seed: int) -> int:
    h = (seed + _P5 + 8) & _M
    k = (value & _M) * _P2 & _M
    h ^= ((k << 31 | k >> 33) & _M) * _P1 & _M
    h = ((h << 27 | h >> 37) & _M) * _P1 + _P4 & _M
    h = (h ^ h >> 33) * _P2 & _M
    h = (h ^ h >> 29) * _P3 & _M
    return h ^ h >> 32


def xxhash64_longs(*values: int) -> int:
    """What Spark's ``xxhash64`` gives for columns of longs, as a signed long."""
    h = 42
    for v in values:
        h = _hash_long(v, h)
    return h - (1 << 64) if h >> 63 else h


def _cell(part: int, cells: int, turn: int, key: int, value: int) -> int:
    return part * cells + xxhash64_longs(key, value, turn * 8 + part) % cells


def peel(table: dict[int, list[int]], digest: int, cells: int, turn: int) -> list[tuple[int, int, int]] | None:
    """Records (key, value, sign) of a table {cell: [count, keys, values, checks]}; None if it does not come out even."""
    found = []
    ready = [c for c, (n, *_) in table.items() if abs(n) == 1]
    while ready:
        c = ready.pop()
        if c not in table:
            continue
        n, key, value, check = table[c]
        if abs(n) != 1 or xxhash64_longs(key, value, _CHECK) != check:
            continue
        places = [_cell(part, cells, turn, key, value) for part in range(3)]
        if c not in places:
            continue
        found.append((key, value, n))
        digest ^= xxhash64_longs(key, value, _DIGEST)
        for at in places:
            cell = table.setdefault(at, [0, 0, 0, 0])
            cell[0] -= n
            cell[1] ^= key
            cell[2] ^= value
            cell[3] ^= check
            if not any(cell):
                del table[at]
            elif abs(cell[0]) == 1:
                ready.append(at)
    return None if table or digest else found


def _summed(records: DataFrame, cells: int, turn: int) -> DataFrame:
    """``(pair, bucket, cells)``: the cells of each bucket's table that are not empty; cell -1 holds the digest."""
    h = lambda tag: F.xxhash64("key", "value", F.lit(tag).cast("long"))
    parts = [F.struct((F.pmod(h(turn * 8 + p), F.lit(cells).cast("long")) + p * cells).cast("int").alias("cell"), h(_CHECK).alias("guard")) for p in range(3)]
    spread = records.select("pair", "bucket", "sign", "key", "value", F.explode(F.array(*parts, F.struct(F.lit(-1).alias("cell"), h(_DIGEST).alias("guard")))).alias("c"))
    sums = spread.groupBy("pair", "bucket", F.col("c.cell").alias("cell")).agg(
        F.sum("sign").cast("int").alias("n"), F.bit_xor("key").alias("keys"), F.bit_xor("value").alias("values"), F.bit_xor("c.guard").alias("checks")
    )
    full = sums.where("n <> 0 or keys <> 0 or values <> 0 or checks <> 0")
    return full.groupBy("pair", "bucket").agg(F.collect_list(F.struct("cell", "n", "keys", "values", "checks")).alias("cells"))  # at most 3 * cells + 1


def _peeled(tables: DataFrame, cells: int, turn: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, bucket, key, kind = [], [], [], []
            for p, b, rows in zip(*(batch.column(i).to_pylist() for i in range(3))):
                digest, table = 0, {}
                for r in rows:
                    if r["cell"] < 0:
                        digest = r["checks"]
                    else:
                        table[r["cell"]] = [r["n"], r["keys"], r["values"], r["checks"]]
                found = peel(table, digest, cells, turn)
                signs: dict[int, int] = {}
                for k, _, sign in found or ():
                    signs[k] = signs.get(k, 0) | (1 if sign > 0 else 2)
                for k, s in [(None, 0)] if found is None else sorted(signs.items()):
                    pair.append(p)
                    bucket.append(b)
                    key.append(k)
                    kind.append(("failed", "added", "removed", "changed")[s])
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.string()), pa.array(bucket, pa.int64()), pa.array(key, pa.int64()), pa.array(kind, pa.string())], names=["pair", "bucket", "key", "change_kind"])

    return tables.mapInArrow(run, "pair string, bucket bigint, key bigint, change_kind string")


def snapshot_changes(records: DataFrame, pairs: DataFrame, space: Workspace) -> DataFrame:
    """``(pair, key, change_kind)`` for every key that was added, removed or changed within a pair of snapshots.

    ``records``: ``(snapshot, key BIGINT, value BIGINT)``, one row per key of a snapshot, ``value`` a digest of its
    content; ``pairs``: ``(pair, earlier, later)``, snapshots by name, ``earlier`` may lack records.  Null keys are
    left out.  A digest of 64 bits makes two contents equal by chance once in 2^64 comparisons.  A key that stands
    twice in a snapshot with one value would cancel itself out and is an error.
    """
    kept = space.keep(records.where("key is not null and value is not null"))
    sizes = kept.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select("pair", F.col("later").alias("snapshot"), F.lit(1).alias("sign")).unionByName(
        pairs.select("pair", F.col("earlier").alias("snapshot"), F.lit(-1).alias("sign"))
    )
    counted = sides.join(sizes, "snapshot")
    share = F.sum("n").over(Window.partitionBy("pair"))
    sides = counted.select("pair", "snapshot", "sign", F.ceil(share / BUCKET_RECORDS).alias("buckets"))
    signed = kept.join(sides, "snapshot").select("pair", "sign", "key", "value", F.pmod(F.xxhash64("key"), F.col("buckets")).alias("bucket"))
    cells, turn, done, left = FIRST_CELLS, 0, None, signed
    while True:
        found = space.keep(_peeled(_summed(left, cells, turn), cells, turn))
        good = found.where("change_kind <> 'failed'").select("pair", "key", "change_kind")
        done = good if done is None else done.unionByName(good)
        failed = found.where("change_kind = 'failed'").select("pair", "bucket")
        if is_empty(failed):
            return done
        if turn == MOST_TURNS:
            raise ValueError("a snapshot holds a record twice")
        left, cells, turn = signed.join(failed, ["pair", "bucket"], "left_semi"), cells * GROWTH, turn + 1


def finished_snapshots(versions: DataFrame) -> DataFrame:
    """``(snapshot, project_id, version_number, earlier)`` of the finished versions; the first of a project has no earlier one."""
    one = versions.where(normal_word("status").isin(*FINISHED)).groupBy(normal_ref("id").alias("snapshot")).agg(
        F.max(normal_ref("project_id")).alias("project_id"), F.max(F.col("version_number").cast("long")).alias("version_number")
    )
    order = Window.partitionBy("project_id").orderBy("version_number", "snapshot")
    return one.withColumn("earlier", F.lag("snapshot").over(order))


def content_digest(text: str = "text", digest: str = "content_hash") -> Column:
    """A long for the content: of the text's SHA-256, or of the delivered one where there is no text."""
    return F.xxhash64(F.coalesce(F.sha2(text, 256), normal_digest(digest)))


def chapter_changes(chapters: DataFrame, versions: DataFrame) -> DataFrame:
    """``(project_id, version_number, ordinal, change_kind)`` for every finished version after a project's first.

    Of several deliveries of a version's ordinal the latest ``loaded_at`` holds (null counts as earliest; between
    equal times the greater digest).  Rows of unfinished or unknown versions, without ordinal, or with neither text
    nor digest are left out.
    """
    space = Workspace(chapters.sparkSession, "changes")
    rows = chapters.select(
        normal_ref("manuscript_version_id").alias("snapshot"), F.col("ordinal").cast("long").alias("key"), "loaded_at",
        F.when(F.col("text").isNotNull() | normal_digest("content_hash").isNotNull(), content_digest()).alias("value"),
    )
    snapshots = space.keep(finished_snapshots(versions))
    known = rows.where("key is not null and value is not null").join(snapshots.select("snapshot"), "snapshot", "left_semi")
    latest = known.groupBy("snapshot", "key").agg(F.max(F.struct("loaded_at", "value")).alias("r")).select("snapshot", "key", "r.value")
    later = snapshots.where("earlier is not null")
    found = snapshot_changes(latest, later.select(F.col("snapshot").alias("pair"), "earlier", F.col("snapshot").alias("later")), space)
    return found.join(later, found["pair"] == later["snapshot"]).select("project_id", "version_number", F.col("key").alias("ordinal"), "change_kind")
