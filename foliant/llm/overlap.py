"""Records of evaluation splits that stand, exactly or nearly, in a training split.

Exact overlaps are an equi-join on the hash of the canonical text.  Near overlaps differ in at most one word in
seven.  They come from the same kind of join, on hashes of two successive words: an edit destroys at most two of those,
so of two texts in reach the rarest ones of either, one more than can be destroyed, must meet in one that stands
unharmed in both.  Which are rare is counted over all texts in a table of fixed size, and any table gives the same pairs.
Those that remain frequent are keyed with the length and the place where a partner can have them.  The join condition
drops pairs whose positions, lengths or word sketches already need more edits, and a word-level edit distance decides
the rest.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.shared import Workspace

ONE_WORD_IN = 7
TRAIN = "train"

_apostrophes = re.compile(r"(?<=\w)['’ʼ`´](?=\w)")
_words = re.compile(r"[^\W_]+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)

GRAM = 2  # words
COUNTERS = 1 << 18  # hashed counts of grams: a fixed size, sent to every task
FREQUENT = 1000  # grams with a greater count are keyed by length and place as well
_SLICE = 1 << 14


def canonical_words(text: str) -> list[str]:
    """Words without case, compatibility forms, punctuation and spacing; apostrophes inside a word join it."""
    return _words(_apostrophes.sub("", unicodedata.normalize("NFKC", text).casefold()))


def allowed(n: int, m: int) -> int:
    """Word edits that two texts of n and m words may differ in."""
    return max(n, m) // ONE_WORD_IN


def reach_of(n: int) -> tuple[int, int]:
    """The shortest and the longest partner of a text of n words."""
    return -(-n * (ONE_WORD_IN - 1) // ONE_WORD_IN), n + n // (ONE_WORD_IN - 1)


@lru_cache(maxsize=100_000)
def needed(n: int) -> int:
    """How many of its rarest grams a text of n words must show so that one of them stands unharmed in any partner; 0 if it has none."""
    low, high = reach_of(n)
    harmed = 0
    for m in {low, high, *(ONE_WORD_IN * k for k in range(-(-max(low, n) // ONE_WORD_IN), high // ONE_WORD_IN + 1)), n}:
        d = allowed(n, m)
        if abs(m - n) <= d:  # a word that only the partner has lies between two words, so it harms one gram fewer
            harmed = max(harmed, GRAM * d - max(m - n, 0))
    return min(harmed + 1, n - GRAM + 1) if harmed else 0


def word_distance(a: list[str], b: list[str]) -> int:
    """Levenshtein distance over words, bit-parallel (Myers) over one text's positions."""
    if not a or not b:
        return len(a) + len(b)
    n = len(a)
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << n) - 1
    top = 1 << (n - 1)
    pv, mv, score = full, 0, n
    for w in b:
        eq = where.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 | 1
        mh <<= 1
        pv = (mh | (~(xv | ph) & full)) & full
        mv = ph & xv & full
    return score


def canonical(records: DataFrame) -> DataFrame:
    """``(id, split, source, key, words)`` of every record with words; ``key`` is a 128-bit hash of the canonical text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = [" ".join(canonical_words(t)) if t else "" for t in batch.column(3).to_pylist()]
            keys = [xxhash.xxh3_128_digest(t) for t in joined]
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(keys, pa.binary()), pa.array(joined, pa.string())],
                names=["id", "split", "source", "key", "words"],
            )
            yield out.filter(pa.array([bool(t) for t in joined], pa.bool_()))

    return records.select("id", "split", "source", "text").where("text is not null and id is not null").mapInArrow(
        run, "id string, split string, source string, key binary, words string"
    )


class Words:
    """The words of many texts in one row: their hashes, and to which text each belongs."""

    def __init__(self, texts: pa.Array, memo: dict[str, int]):
        lists = pc.split_pattern(texts, " ")
        self.sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        if len(memo) > 500_000:
            memo.clear()
        known = np.empty(len(words.dictionary), np.uint64)
        for i, w in enumerate(words.dictionary.to_pylist()):
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh64_intdigest(w)
            known[i] = h
        self.hashes = known[words.indices.to_numpy()]
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(self.text)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``GRAM`` successive words of one text, and where they begin."""
        at = np.flatnonzero(self.place + GRAM <= self.sizes[self.text])
        acc = np.zeros(len(at), np.uint64)
        for k in range(GRAM):
            acc = acc * _BASE + self.hashes[at + k]
        return _mixed(acc), at

    def sketches(self) -> np.ndarray:
        """Two longs a text: the parities of the words that fall on each of 128 bits; one edit changes at most two."""
        bits = self.text * 128 + (self.hashes >> np.uint64(57)).astype(np.int64)
        parity = np.bincount(bits, minlength=len(self.sizes) * 128).astype(np.uint8) & 1
        return np.packbits(parity).view(np.int64).reshape(-1, 2)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _counter(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(COUNTERS - 1)).astype(np.int64)


def gram_counts(classes: DataFrame) -> np.ndarray:
    """How often the grams of every counter stand in all texts; tasks send their counters, and sums come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            counts += np.bincount(_counter(Words(batch.column(0), memo).grams()[0]), minlength=COUNTERS)
        starts = [a for a in range(0, COUNTERS, _SLICE) if counts[a : a + _SLICE].any()]
        sent = [counts[a : a + _SLICE].tobytes() for a in starts]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array(sent, pa.binary())], names=["start", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for start, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[start] = sums.get(start, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["start", "counts"])

    kind = "start int, counts binary"
    found = np.zeros(COUNTERS, np.int64)
    for row in classes.select("words").mapInArrow(count, kind).repartition("start").mapInArrow(add, kind).collect():  # COUNTERS longs in all
        found[row.start : row.start + _SLICE] = np.frombuffer(row.counts, np.int64)
    return found


def _stretch(n: np.ndarray) -> np.ndarray:
    """Lengths fall into stretches of about four tenths."""
    return np.floor(np.log(np.maximum(n, 1)) * 3).astype(np.int64)


_FIRST = np.array([next(m for m in range(max(int(math.exp(k / 3)) - 1, 1), 1 << 40) if math.floor(math.log(m) * 3) >= k) for k in range(66)])


def _cell_keys(gram: np.ndarray, stretch: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Keys of frequent grams: with the stretch of the training text's length, and the cell of the place in it."""
    return _mixed(gram + (stretch * 0x1F123BB5 + cell * 0x9E3779B1 + 1).astype(np.uint64) * _BASE)


def _cells(gram: np.ndarray, at: np.ndarray, n: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of frequent grams at places ``at`` of texts of ``n`` words, and the row of each key.

    A training text has one cell, an evaluation text those where a partner may have the gram.
    """
    if side == "train":
        k = _stretch(n)
        return _cell_keys(gram, k, at // np.maximum(_FIRST[k] // ONE_WORD_IN, 1)), np.arange(len(gram))
    low, high = -(-n * (ONE_WORD_IN - 1) // ONE_WORD_IN), n + n // (ONE_WORD_IN - 1)
    keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    first, last = _stretch(low), _stretch(high)
    for i in range(int((last - first).max(initial=-1)) + 1):
        row = np.flatnonzero(first + i <= last)
        k = first[row] + i
        shift = np.maximum(n[row], np.minimum(_FIRST[k + 1] - 1, high[row])) // ONE_WORD_IN
        width = np.maximum(_FIRST[k] // ONE_WORD_IN, 1)
        begin, end = np.maximum(at[row] - shift, 0) // width, (at[row] + shift) // width
        times = end - begin + 1
        row, k, begin = np.repeat(row, times), np.repeat(k, times), np.repeat(begin, times)
        cell = begin + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        keys.append(_cell_keys(gram[row], k, cell))
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def rare_grams(classes: DataFrame, counts, side: str) -> DataFrame:
    """``(gram, class, place, s0, s1)``: keys of the rarest grams of every text, as many as ``needed``.

    ``counts`` is a broadcast of ``gram_counts``.  Equal grams of one text count as often as they stand there, the first
    first.  ``place`` holds the text's length and the gram's position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        often = counts.value
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                words = Words(batch.column(1), memo)
                gram, at = words.grams()
                text, count = words.text[at], often[_counter(gram)]
                order = np.lexsort((gram, count, text))  # stable: equal grams of a text stay in order
                show = np.fromiter(map(needed, words.sizes.tolist()), np.int64, len(words.sizes))
                grams = np.bincount(text, minlength=len(words.sizes))
                rank = np.arange(len(order)) - np.repeat(np.cumsum(grams) - grams, grams)
                taken = order[rank < show[text[order]]]
                gram, at, text, count = gram[taken], at[taken], text[taken], count[taken]
                place, n = words.place[at], words.sizes[text]
                plain, heavy = np.flatnonzero(count <= FREQUENT), np.flatnonzero(count > FREQUENT)
                keys, rows = _cells(gram[heavy], place[heavy], n[heavy], side)
                key, row = np.concatenate([gram[plain], keys]), np.concatenate([plain, heavy[rows]])
                sketch = words.sketches()[text[row]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), batch.column(0).take(pa.array(text[row])), pa.array(n[row] << 32 | place[row]), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])],
                    names=["gram", "class", "place", "s0", "s1"],
                )

    return classes.select("class", "words").mapInArrow(run, "gram bigint, class bigint, place bigint, s0 bigint, s1 bigint")


def near_classes(classes: DataFrame, space: Workspace) -> DataFrame:
    """``(eval_key, train_key)`` of different canonical texts within reach of each other.

    Spark takes what comes from Python for as small as what went in, so these joins are told to shuffle.
    """
    counts = classes.sparkSession.sparkContext.broadcast(gram_counts(classes))
    e = rare_grams(classes.where("has_eval"), counts, "eval").toDF("gram", "e_class", "e_place", "e0", "e1")
    t = rare_grams(classes.where("has_train"), counts, "train")
    e_n, n = F.shiftright("e_place", 32), F.shiftright("place", 32)
    edits = F.floor(F.greatest(e_n, n) / ONE_WORD_IN)
    shift = F.col("place").bitwiseAND(0xFFFFFFFF) - F.col("e_place").bitwiseAND(0xFFFFFFFF)
    differ = F.bit_count(F.col("e0").bitwiseXOR(F.col("s0"))) + F.bit_count(F.col("e1").bitwiseXOR(F.col("s1")))
    reach = (differ <= 2 * edits) & (F.abs(shift) + F.abs(n - e_n - shift) <= edits) & (F.col("e_class") != F.col("class"))
    met = e.hint("merge").join(t, "gram").where(reach)
    pairs = space.keep(met.select("e_class", "class").distinct())
    text = classes.select("class", "key", "words")
    both = pairs.join(text.toDF("e_class", "eval_key", "eval_words").hint("merge"), "e_class").join(text.toDF("class", "train_key", "train_words").hint("merge"), "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = a.split(" "), b.split(" ")
                keep.append(word_distance(x, y) <= allowed(len(x), len(y)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("eval_key", "train_key", "eval_words", "train_words").mapInArrow(run, "eval_key binary, train_key binary")


def overlapping_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(eval_key, train_key, exact)`` of canonical texts that overlap, and the records ``(id, split, source, key)`` with words.

    ``records``: ``(id, split, source, text)``; the split ``train`` in any case against every other split that is not
    null.  Texts that are null or without words overlap with nothing; repeated rows of a record count once.
    """
    space = Workspace(records.sparkSession, "overlap")
    rows = records.select("id", F.lower(F.trim("split")).alias("split"), "source", "text").where("split is not null")
    read = space.keep(canonical(rows))
    is_train = F.col("split") == TRAIN
    grouped = read.groupBy("key").agg(F.min("words").alias("words"), F.bool_or(~is_train).alias("has_eval"), F.bool_or(is_train).alias("has_train"))
    classes = space.keep(grouped.withColumn("class", F.monotonically_increasing_id()))
    same = classes.where("has_eval and has_train").select(F.col("key").alias("eval_key"), F.col("key").alias("train_key"))
    near = near_classes(classes, space)
    linked = space.keep(same.withColumn("exact", F.lit(True)).unionByName(near.withColumn("exact", F.lit(False))))
    return linked, read.select("id", "split", "source", "key").distinct()


def split_overlaps(records: DataFrame) -> DataFrame:
    """``(eval_id, eval_split, eval_source, train_id, train_source, exact)``: every pair of records whose texts overlap, see ``overlapping_classes``."""
    linked, base = overlapping_classes(records)
    is_train = F.col("split") == TRAIN
    evals = base.where(~is_train).select(F.col("key").alias("eval_key"), F.col("id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    trains = base.where(is_train).select(F.col("key").alias("train_key"), F.col("id").alias("train_id"), F.col("source").alias("train_source"))
    pairs = linked.join(evals, "eval_key").join(trains, "train_key")
    return pairs.select("eval_id", "eval_split", "eval_source", "train_id", "train_source", "exact")


def overlap_report(records: DataFrame) -> DataFrame:
    """``(eval_split, eval_source, train_source, overlapping_records, pairs, exact_pairs, eval_records)``: what overlaps, counted.

    Pairs are multiplied out from the numbers of records of the texts, not listed; evaluation records that overlap count
    once per source of the training records.
    """
    linked, base = overlapping_classes(records)
    is_train = F.col("split") == TRAIN
    one = F.count(F.lit(1))
    evals = base.where(~is_train).select(F.col("key").alias("eval_key"), F.col("id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    totals = evals.groupBy("eval_split", "eval_source").agg(F.countDistinct("eval_id").alias("eval_records"))
    train_sizes = base.where(is_train).groupBy(F.col("key").alias("train_key"), F.col("source").alias("train_source")).agg(one.alias("trains"))
    met = linked.join(train_sizes, "train_key").groupBy("eval_key", "train_source").agg(
        F.sum("trains").alias("trains"), F.sum(F.when(F.col("exact"), F.col("trains")).otherwise(0)).alias("exact_trains")
    )
    found = evals.join(met, "eval_key").groupBy("eval_split", "eval_source", "train_source")
    counted = found.agg(F.countDistinct("eval_id").alias("overlapping_records"), F.sum("trains").alias("pairs"), F.sum("exact_trains").alias("exact_pairs"))
    return counted.join(totals, ["eval_split", "eval_source"])
