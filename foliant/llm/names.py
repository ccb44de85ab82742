"""Variant spellings of names typed by people.

Names become sparse vectors of character bigrams and trigrams, weighted by inverse document frequency over all names.
Those of common tokens (given names, kinds of organizations, initials) weigh less.  A join within a block on the n-grams
before a tail too small to reach the threshold finds all pairs that can, and the full vectors' cosine decides.  A check
of the tokens follows (typos, initials, short forms, abbreviations, order) that only says yes or no, and entities are
grouped by average-linkage clustering of the best cosines of their names.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.components import connected_components
from foliant.operators.relational import numbered_within
from foliant.refs import normal_ref, normal_word
from foliant.shared import Workspace, is_empty

#: Forms of address and function words that belong to no name.
TITLES = frozenset(
    "mr mrs ms mx miss master dr doctor prof professor sgt sergeant capt captain judge justice col colonel maj major lt lieutenant "
    "gen general cpl corporal rev reverend fr father sr sister sir dame lady lord madam madame hon esq jr snr phd md".split()
)
SMALL_WORDS = frozenset("the of and for de des der van von".split())

BUCKETS = 1 << 16  # n-grams are hashed to so many: a fixed bound of the weight table
COMMON_SHARE = 0.002  # a token in more of all names than this is common: there are at most a few thousand of them
COMMON_LEAST = 20  # and in at least so many names
COMMON_WEIGHT = 0.4  # of a common token's n-grams beside those of a rare one
MIN_COSINE = 0.12  # of names, for a pair to be checked
MIN_LINK = 0.51  # average similarity of two clusters that still merge: over a half, see ``similarity``
LARGEST_COMPONENT = 4000  # nodes that one task clusters at once; larger components are merged in rounds of groups of so many

_token = re.compile(r"[^\W_]+").findall


def plain(text: str) -> str:
    """Lower case without accents and compatibility forms."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def name_tokens(name: str | None) -> tuple[str, ...]:
    """A name's tokens in sorted order without titles, function words and middle initials."""
    words = _token(re.sub(r"['’`´]", "", plain(name or "")))
    kept = [w for w in words if w not in TITLES and w not in SMALL_WORDS] or words
    if sum(len(w) > 1 for w in kept) >= 2:
        full = [w for w in kept if len(w) > 1]
        if len(full) == 2 or len(kept) > 4:  # an initial beside given and family name says nothing more
            kept = full if len(full) == 2 and _is_middle(kept) else kept
    return tuple(sorted(kept))


def _is_middle(kept: list[str]) -> bool:
    return len(kept) == 3 and len(kept[0]) > 1


def short_forms(forms: list[tuple[str, str]]) -> ShortForms:
    """From every given name and short form to the given names it may stand for."""
    found: dict[str, set[str]] = defaultdict(set)
    for given, short in forms:
        if given and short:
            found[plain(short)].add(plain(given))
            found[plain(given)].add(plain(given))
    return ShortForms({k: frozenset(v) for k, v in found.items()})


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (swaps of neighbours count one), ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    start, end = 0, min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    end -= start
    tail = 0
    while tail < end and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[start : len(a) - tail], b[start : len(b) - tail]  # what both begin and end with needs no edit
    if not a or not b:
        return max(len(a), len(b))
    if len(a) == len(b) == 1:
        return 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


def _subsequence(a: str, b: str) -> bool:
    it = iter(b)
    return all(c in it for c in a)


class ShortForms(dict):
    """The names that a short form or name may stand for; also those that a token one edit off may, kept once found."""

    def __init__(self, found: dict[str, frozenset[str]]):
        super().__init__(found)
        self.by_start: dict[tuple[str, int], list[str]] = defaultdict(list)
        for form in found:
            self.by_start[form[0], len(form)].append(form)
        self.meant: dict[str, frozenset[str]] = {}


def _meant(token: str, forms: ShortForms) -> frozenset[str]:
    known = forms.meant.get(token)
    if known is None:
        near = (s for n in (-1, 0, 1) for s in forms.by_start.get((token[0], len(token) + n), ()) if edits(s, token, 1) <= 1)
        known = frozenset().union(*(forms[s] for s in near))
        if len(forms.meant) > 200_000:
            forms.meant.clear()
        forms.meant[token] = known
    return known


def token_likeness(a: str, b: str, forms: ShortForms, organization: bool) -> float:
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        starts = {b[0], *(g[0] for g in forms.get(b, ()))} if not organization else {b[0]}
        return 0.75 if a in starts else 0.0
    if not organization and forms.get(a, frozenset()) & forms.get(b, frozenset()):
        return 0.95
    n = len(b)
    if n >= 4:
        d = edits(a, b, 2 if n >= 6 else 1)
        if d == 1:
            return 0.9
        if d == 2 and n >= 6:
            return 0.65
    if b.startswith(a):
        return 0.85
    if organization:
        if len(a) <= 5 and len(a) + 2 <= n and a[0] == b[0] and _subsequence(a, b):
            return 0.85
    elif forms:
        if any(g.startswith(x) for x, y in ((a, b), (b, a)) for g in forms.get(y, ())):  # two ways to cut one name
            return 0.85
        for x, y in ((a, b), (b, a)):  # a short form that is misspelt itself, or a cut one of a misspelt name
            if len(x) >= 4 and x not in forms:
                for g in forms.get(y, ()):
                    if edits(x, g, 1) <= 1:
                        return 0.8
                if y in forms and not forms[y].isdisjoint(_meant(x, forms)):
                    return 0.8
    return 0.0


def likeness(a: tuple[str, ...], b: tuple[str, ...], forms: ShortForms, organization: bool, memo: dict | None = None) -> float:
    """How well two names' tokens agree; 0 if a token of the shorter name has no counterpart in the longer.

    ``memo`` keeps what was found for pairs of tokens.
    """
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    memo = {} if memo is None else memo
    forms = forms if isinstance(forms, ShortForms) else ShortForms(forms)
    pairs = []
    for i, x in enumerate(a):
        reached = False
        for j, y in enumerate(b):
            known = memo.get((x, y, organization))
            if known is None:
                known = memo[x, y, organization] = token_likeness(x, y, forms, organization)
            if known > 0:
                reached = True
                pairs.append((known, i, j))
        if not reached:
            return 0.0
    pairs.sort(reverse=True)
    if len(a) == 1:
        pairs = [p for p in pairs if len(b[p[2]]) > 1]
    left, right, total = set(range(len(a))), set(range(len(b))), 0.0
    for value, i, j in pairs:
        if i in left and j in right:
            left.discard(i)
            right.discard(j)
            total += value
    if left:
        return 0.0
    if len(a) == 1:  # a family name alone fits every bearer of it; a given name alone says too little
        alone = a[0]
        return 0.0 if len(alone) == 1 else (0.4 if alone in forms else 0.6) * total if len(b) > 1 else total
    spare = [b[j] for j in right]
    return max(total / len(a) - sum(0.02 if len(w) == 1 else 0.08 for w in spare), 0.0)


def gram_buckets(tokens: tuple[str, ...], forms: ShortForms, common: frozenset[str] = frozenset()) -> dict[int, int]:
    """Counts of hashed bigrams and trigrams of the padded tokens; short forms count as the names they stand for.

    N-grams of common tokens are features of their own, numbered from ``BUCKETS`` on.
    """
    found: dict[int, int] = defaultdict(int)
    for token in tokens:
        for word in sorted(forms.get(token, (token,))):
            padded = f" {word} "
            base = BUCKETS if word in common else 0
            for n in (2, 3):
                for i in range(len(padded) - n + 1):
                    found[base + (zlib.crc32(padded[i : i + n].encode()) & (BUCKETS - 1))] += 1
    return found


def weighted(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A name's vector: features, rare tokens' and rare n-grams first, and their parts of the unit vector."""
    keys = np.fromiter(counts, np.int64, len(counts))
    values = np.fromiter(counts.values(), np.float64, len(counts)) * idf[keys] * np.where(keys < BUCKETS, 1.0, COMMON_WEIGHT)
    order = np.lexsort((keys, -idf[keys], keys >= BUCKETS))
    keys, values = keys[order], values[order]
    return keys, values / (np.sqrt((values**2).sum()) or 1.0)


def leading(values: np.ndarray, least: float) -> tuple[int, float]:
    """How many leading parts of a unit vector leave a tail of a norm below ``least``, and that norm.

    Of two vectors in one order of features, those that are not among the leading parts of both are in the tail of one
    of them: the cosine is at most that of the leading parts and the larger tail's norm, and without a common leading
    feature it is below ``least``.
    """
    tails = np.append(np.sqrt(np.cumsum((values**2)[::-1]))[::-1], 0.0)
    kept = int((tails >= least).sum())
    return kept, float(tails[kept])


def similarity(cosine: float) -> float:
    """Its cube root: names with typos lie near equal ones, and only what the tokens refuse lies far off.

    A form that fits two bearers (an initial, a short form, a family name alone) lies between them, and a cluster of
    it with one is at most a half near to the other.
    """
    return cosine ** (1 / 3)


def cosine(a: dict[int, float], b: dict[int, float]) -> float:
    """Of two unit vectors by their features."""
    return sum(a[k] * b[k] for k in a.keys() & b.keys())


def canonical_names(names: DataFrame) -> DataFrame:
    """``(entity, entity_id, block, kind, canon, name_id)`` distinct: every name as its sorted tokens; names without tokens go.

    ``entity`` and ``name_id`` (of a block and tokens) are 64-bit hashes, so that joins move longs and not strings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for batch in batches:
            if len(memo) > 200_000:
                memo.clear()
            out = []
            for name in batch.column(3).to_pylist():
                if name not in memo:
                    memo[name] = " ".join(name_tokens(name))
                out.append(memo[name])
            done = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.string())], names=["entity_id", "block", "kind", "canon"])
            yield done.filter(pa.array([bool(c) for c in out], pa.bool_()))

    rows = names.where("name is not null and entity_id is not null").select("entity_id", "block", "kind", "name")
    found = rows.mapInArrow(run, "entity_id string, block string, kind string, canon string")
    return found.select(F.xxhash64("entity_id").alias("entity"), "*", F.xxhash64("block", "canon").alias("name_id")).dropDuplicates(["entity", "name_id"])


def common_tokens(canons: DataFrame, forms: dict[str, frozenset[str]]) -> frozenset[str]:
    """Tokens of more than ``COMMON_SHARE`` of all names (at most the tokens of a name over that share), and all given names of the table."""
    total = canons.count()
    each = canons.select(F.explode(F.array_distinct(F.split("canon", " "))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    often = each.where(F.col("n") > max(COMMON_LEAST, total * COMMON_SHARE)).select("token")
    return frozenset(r.token for r in often.collect()) | frozenset(forms)


def _document_frequencies(canons: DataFrame, forms: ShortForms, common: frozenset[str]) -> np.ndarray:
    """Inverse document frequencies of all features over all distinct names of all blocks."""
    last = 2 * BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(last + 1, np.int64)
        for batch in batches:
            for canon in batch.column(0).to_pylist():
                counts[last] += 1
                for g in gram_buckets(tuple(canon.split(" ")), forms, common):
                    counts[g] += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["bucket", "n"])

    table = canons.select("canon").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * BUCKETS + 1 rows
    counts = np.zeros(last + 1)
    counts[table["bucket"].to_numpy(np.int64)] = table["n"]
    return np.log((1.0 + counts[last]) / (1.0 + counts[:last])) + 1.0


def similar_names(distinct: DataFrame, forms: ShortForms, space: Workspace, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``(a, b, sim)`` with ``a < b``: ids of distinct names of one block whose cosine is ``min_cosine`` or more and whose tokens agree.

    There is no cap on partners; ``sim`` is the ``similarity`` of the cosine.

    ``distinct``: ``(name_id, block, kind, canon)``, one row per name of a block.
    """
    sc = distinct.sparkSession.sparkContext
    common = common_tokens(distinct, forms)
    shared = sc.broadcast((_document_frequencies(distinct, forms, common), forms, common))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, forms, common = shared.value
        for batch in batches:
            row, gram, part, tail = [], [], [], []
            for i, canon in enumerate(batch.column(2).to_pylist()):
                keys, values = weighted(gram_buckets(tuple(canon.split(" ")), forms, common), idf)
                kept, rest = leading(values, min_cosine)
                gram.append(keys[:kept])
                part.append(values[:kept])
                row.append(np.full(kept, i, np.int32))
                tail.append(np.full(kept, rest, np.float32))
            take = pa.array(np.concatenate(row) if row else np.zeros(0, np.int32))
            grams = np.concatenate(gram).astype(np.int64) if gram else np.zeros(0, np.int64)
            block = batch.column(1).to_numpy()[take.to_numpy()]
            key = (block * np.int64(BUCKETS * 2 + 1)) ^ grams  # a few blocks may share a key: the block is compared below
            parts = np.concatenate(part).astype(np.float32) if part else np.zeros(0, np.float32)
            tails = np.concatenate(tail) if tail else np.zeros(0, np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(key), pa.array(parts), pa.array(tails)], names=["id", "key", "part", "tail"])

    block = F.xxhash64("block").alias("block")
    rows = distinct.select("name_id", block, "canon").mapInArrow(vectors, "id bigint, key bigint, part float, tail float")
    # Spark takes what comes from Python for as small as what went in, so this join is told to shuffle
    met = rows.toDF("a", "key", "p", "s").hint("merge").join(rows.toDF("b", "key", "q", "t"), "key").where("a < b")
    found = met.groupBy("a", "b").agg(F.sum(F.col("p").cast("double") * F.col("q")).alias("reached"), F.max(F.greatest("s", "t")).alias("tail"))
    pairs = found.where(F.col("reached") + F.col("tail") >= min_cosine - 1e-5).select("a", "b")
    text = distinct.select("name_id", block, "kind", "canon")
    first = pairs.join(text.toDF("a", "block", "kind", "x"), "a")
    both = first.join(text.select(F.col("name_id").alias("b"), F.col("block").alias("other"), F.col("canon").alias("y")), "b").where("block = other")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, forms, common = shared.value
        memo: dict[tuple[str, str, bool], float] = {}
        full: dict[str, dict[int, float]] = {}

        def vector(canon: str) -> dict[int, float]:
            if canon not in full:
                keys, values = weighted(gram_buckets(tuple(canon.split(" ")), forms, common), idf)
                full[canon] = dict(zip(keys.tolist(), values.tolist()))
            return full[canon]

        for batch in batches:
            if len(memo) > 500_000:
                memo.clear()
            if len(full) > 50_000:
                full.clear()
            sims = [likeness(tuple(x.split(" ")), tuple(y.split(" ")), forms, kind == "organization", memo) for kind, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            for i, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                if sims[i] > 0:
                    near = cosine(vector(x), vector(y))
                    sims[i] = similarity(min(near, 1.0)) if near >= min_cosine else 0.0
            done = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])
            yield done.filter(pa.array([s > 0 for s in sims], pa.bool_()))

    return both.select("a", "b", "kind", "x", "y").mapInArrow(check, "a bigint, b bigint, sim double")


def average_linkage(weights: dict[int, int], sims: dict[tuple[int, int], float], least: float, fixed: frozenset[int] = frozenset()) -> dict[int, int]:
    """Clusters of weighted nodes: the two with the highest average similarity merge while it is ``least`` or more.

    Pairs without an entry have similarity 0.  Ties go to the smallest ids, so the result does not depend on order.
    Nodes in ``fixed`` merge elsewhere: they stay as they are, and so does every cluster from when its best partner is one that stays.
    """
    size = dict(weights)
    near: dict[int, dict[int, float]] = {n: {} for n in weights}
    heap = []
    for (a, b), s in sims.items():
        near[a][b] = near[b][a] = s * size[a] * size[b]
        heapq.heappush(heap, (-s, min(a, b), max(a, b)))
    into = {n: n for n in weights}
    stays = set(fixed)
    while heap:
        s, a, b = heapq.heappop(heap)
        if -s < least:
            break
        if into[a] != a or into[b] != b or b not in near[a] or abs(near[a][b] / (size[a] * size[b]) + s) > 1e-12:
            continue
        if a in stays or b in stays:
            stays |= {a, b}
            continue
        into[b] = a
        for c, total in near.pop(b).items():
            near[c].pop(b)
            if c != a:
                near[a][c] = near[c][a] = near[a].get(c, 0.0) + total
        size[a] += size[b]
        for c, total in near[a].items():
            heapq.heappush(heap, (-total / (size[a] * size[c]), min(a, c), max(a, c)))

    def top(n: int) -> int:
        while into[n] != n:
            n = into[n]
        return n

    return {n: top(n) for n in weights}


def _linker(least: float):
    """Clusters every group of rows ``(part, src, dst, value, beside)`` that come sorted by group.

    Rows without ``dst`` are nodes with their weights, the others edges with their similarities and, where ``dst`` may
    be in another group, its weight; such nodes stay fixed.  Edges to other nodes outside the group are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, weights, sims, beside = None, {}, {}, {}
        nodes, clusters = [], []

        def close() -> None:
            ends = beside | weights
            inside = {pair: s for pair, s in sims.items() if pair[0] in ends and pair[1] in ends}
            found = average_linkage(ends, inside, least, frozenset(beside.keys() - weights.keys()))
            nodes.extend(weights)
            clusters.extend(map(found.get, weights))

        for batch in batches:
            for part, src, dst, value, other in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if part != now:
                    close()
                    now, weights, sims, beside = part, {}, {}, {}
                if dst is None:
                    weights[src] = int(value)
                else:
                    sims[min(src, dst), max(src, dst)] = value
                    if other is not None:
                        beside[dst] = other
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(clusters, pa.int64())], names=["node", "cluster"])
            nodes.clear()
            clusters.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(clusters, pa.int64())], names=["node", "cluster"])

    return run


def _linked(nodes: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """``(node, cluster)`` of ``nodes``, ``(part, node, weight)``, by their ``edges``, ``(part, src, dst, sim, beside)``."""
    none = F.lit(None).cast("long")
    body = nodes.select("part", F.col("node").alias("src"), none.alias("dst"), F.col("weight").cast("double").alias("value"), none.alias("beside"))
    body = body.unionByName(edges.select("part", "src", "dst", F.col("sim").alias("value"), "beside"))
    return body.repartition("part").sortWithinPartitions("part").mapInArrow(_linker(least), "node bigint, cluster bigint")


def _clusters(nodes: DataFrame, edges: DataFrame, space: Workspace, least: float) -> DataFrame:
    """``(node, cluster)`` of every node with an edge of ``least`` or more.  ``nodes``: ``(node, weight)``; ``edges``: ``(src, dst, sim)``.

    No average over links below ``least`` reaches it, so components of the other links are clustered apart, each with
    all links between its nodes.  In those too large for one task a round merges what has to merge whatever happens
    elsewhere, and the merged clusters are nodes of the next round.
    """
    parts = space.keep(connected_components(edges.where(F.col("sim") >= least).select("src", "dst"), space))
    sized = parts.join(parts.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "component")
    fit = sized.where(F.col("members") <= LARGEST_COMPONENT).select("node", F.col("component").alias("part"))
    loose = edges.join(fit.withColumnRenamed("node", "src"), "src").withColumn("beside", F.lit(None).cast("long"))
    done = _linked(fit.join(nodes, "node"), loose, least)
    large = sized.where(F.col("members") > LARGEST_COMPONENT).select("node", "component")
    if is_empty(large):
        return done
    large = space.keep(large)
    weights = space.keep(nodes.join(large, "node").select("node", "weight"))
    links = edges.join(large.toDF("src", "component"), "src").join(large.toDF("dst", "other"), "dst").where("component = other").select("src", "dst", "sim")
    links = space.keep(links)
    moved = space.keep(_merged(weights, links, space, least))
    whole = space.keep(moved.join(weights, "node"))
    whole = space.keep(whole.join(whole.groupBy("cluster").agg(F.sum("weight").alias("whole")), "cluster").select("node", "cluster", "weight", "whole"))
    met = links.join(whole.toDF("src", "a", "v", "whole_a"), "src").join(whole.toDF("dst", "b", "w", "whole_b"), "dst").where("a <> b")
    total = F.sum(F.col("sim") * F.col("v") * F.col("w")) / F.first(F.col("whole_a").cast("double") * F.col("whole_b"))
    links = space.keep(met.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(total.alias("sim")))
    later = _clusters(whole.select(F.col("cluster").alias("node"), F.col("whole").alias("weight")).distinct(), links, space, least)
    return done.unionByName(moved.join(later.toDF("cluster", "then"), "cluster", "left").select("node", F.coalesce("then", "cluster").alias("cluster")))


def _merged(weights: DataFrame, links: DataFrame, space: Workspace, least: float) -> DataFrame:
    """``(node, cluster)`` after one round of the merges of the average linkage in large components; every component makes one at least.

    A merged cluster is never nearer to a third than the nearer of its two parts, so two clusters that are each
    other's best merge sooner or later, whatever else merges first.  Nodes come in groups along the links to their best
    partners, best first, and a group merges such pairs until all that are left wait for other groups.
    """
    ends = space.keep(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim")))
    rank = F.struct((-F.col("sim")).alias("s"), F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"))
    best = space.keep(ends.where(F.col("sim") >= least).groupBy(F.col("src").alias("node")).agg(F.min(rank).alias("e")))
    trees = connected_components(best.select(F.col("e.x").alias("src"), F.col("e.y").alias("dst")), space)
    placed = numbered_within(best.join(trees, "node"), ["component"], ["e", "node"], space, "place")
    groups = placed.select("node", F.xxhash64("component", F.floor(F.col("place") / LARGEST_COMPONENT)).alias("part"))
    groups = space.keep(groups.join(weights, "node"))
    beside = ends.join(groups.select(F.col("node").alias("src"), "part"), "src").join(weights.toDF("dst", "beside"), "dst")
    return _linked(groups, beside, least)


def linked_entities(names: DataFrame, forms: list[tuple[str, str]], min_cosine: float = MIN_COSINE, least: float = MIN_LINK) -> DataFrame:
    """``(entity_id, block, cluster_id)``: entities of one block that bear spellings of one name share a cluster.

    ``names``: ``(entity_id, block, kind, name)``, any number per entity, null names ignored, repeats counted once;
    an entity without any name with letters or digits is in no cluster.  Entities of a block with the same set of
    names are one node of the clustering with their number as its weight.  ``forms``: (given name, short form) pairs,
    a fixed public table.
    """
    space = Workspace(names.sparkSession, "names")
    known = short_forms(forms)
    canons = space.keep(canonical_names(names))
    signed = canons.groupBy("entity").agg(
        F.bit_xor("name_id").alias("x"), F.sum(F.shiftright("name_id", 32)).alias("s"), F.min("entity_id").alias("entity_id"), F.min("block").alias("block")
    )
    signed = space.keep(signed)
    nodes = space.keep(signed.join(signed.groupBy("x", "s").agg(F.min("entity").alias("node")), ["x", "s"]).select("entity", "entity_id", "block", "node"))
    weights = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("weight"))
    borne = canons.join(nodes.where("entity = node").select("entity"), "entity").select(F.col("entity").alias("node"), "name_id")
    borne = space.keep(borne)
    distinct = space.keep(canons.select("name_id", "block", "kind", "canon").dropDuplicates(["name_id"]))
    sims = similar_names(distinct, known, space, min_cosine)
    equal = distinct.select(F.col("name_id").alias("a"), F.col("name_id").alias("b"), F.lit(1.0).alias("sim"))
    met = sims.unionByName(equal).join(borne.toDF("src", "a"), "a").join(borne.toDF("dst", "b"), "b").where("src <> dst")
    edges = met.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("sim").alias("sim"))
    clusters = _clusters(weights, space.keep(edges), space, least)
    return nodes.join(clusters, "node", "left").select("entity_id", "block", F.coalesce("cluster", "node").alias("cluster_id"))


def review_names(entities: DataFrame, aliases: DataFrame, mentions: DataFrame) -> DataFrame:
    """``(entity_id, block, kind, name)`` of the characters and organizations whose valid row awaits review."""
    newest = F.max(F.struct("updated_at", "status", "entity_type", "manuscript_version_id", "canonical_name")).alias("e")
    valid = entities.groupBy(F.lower("id").alias("entity_id")).agg(newest).where(normal_word("e.status") == "needs_review")
    kind = normal_word("e.entity_type")
    chosen = valid.where(kind.isin("character", "organization")).select(
        "entity_id", F.concat_ws("|", normal_ref("e.manuscript_version_id"), kind).alias("block"), kind.alias("kind"), F.col("e.canonical_name").alias("name")
    )
    said = mentions.select(normal_ref("entity_id").alias("entity_id"), F.col("surface_text").alias("name")).where("entity_id is not null and name is not null")
    listed = aliases.select(normal_ref("entity_id").alias("entity_id"), F.explode(F.array("alias", "normalized_alias")).alias("name")).where("name is not null")
    heads = chosen.select("entity_id", "block", "kind")
    return chosen.unionByName(heads.join(said.unionByName(listed), "entity_id").distinct())


def linked_pairs(clusters: DataFrame) -> DataFrame:
    """``(left_entity_id, right_entity_id)``: all pairs of entities that share a cluster."""
    a = clusters.select("block", "cluster_id", F.col("entity_id").alias("left_entity_id"))
    b = clusters.select("block", "cluster_id", F.col("entity_id").alias("right_entity_id"))
    return a.join(b, ["block", "cluster_id"]).where("left_entity_id < right_entity_id").select("left_entity_id", "right_entity_id")
