"""Importance resampling towards a target distribution.

Features of a text are its runs of 1 to 3 words, hashed to BUCKETS buckets. From the counts of source and target texts each bucket has a gain, the logarithm of how much commoner it is in
the target; a text's weight is the sum over its features. A Gumbel variable drawn from the id is added, so the highest scores are a sample without
replacement by weight. The cutoff is found by bisection: jobs count exactly how many persisted scores lie above; among rows that tie there, bisection goes on over ids. Selected
rows are ranked in range partitions.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import number_rows
from .common import settle, slices

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20  # of a text that can be drawn
SHARE, OF = 5, 100  # drawn: floor(SHARE * N / OF)
SEED = 42
LEVELS = 5  # steps of the bisection that one job counts for: 31 midpoints
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
POLYNOMIAL = 0xEDB88320  # of crc32, reversed


def _steps() -> np.ndarray:
    """The table of crc32: what a byte does to the register."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, POLYNOMIAL ^ (c >> 1), c >> 1).astype(np.uint32)
    return c


class Zeros(dict):
    """length -> tables [4, 256]: what so many zero bytes make of a crc32, by its four bytes. crc(a + b) = zeros(len(b))(crc(a)) ^ crc(b)."""

    STEPS = _steps()

    def __missing__(self, length: int) -> np.ndarray:
        if length > 1:
            half, rest = self[length // 2], self[length - length // 2]
            found = through(rest, half)
        else:
            c = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
            found = self.STEPS[c & 0xFF] ^ (c >> 8) if length else c
        self[length] = found
        return found


def through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 0xFF] ^ tables[1][crc >> 8 & 0xFF] ^ tables[2][crc >> 16 & 0xFF] ^ tables[3][crc >> 24]


class Vocabulary(dict):
    """word -> number, with the length and crc32 of a blank and the word; kept for later texts of the task up to a bound."""

    def __init__(self) -> None:
        self.lengths, self.crcs, self.alone = [], [], []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.lengths)
        self.lengths.append(len(word) + 1)
        self.crcs.append(zlib.crc32(b" " + word))
        self.alone.append(zlib.crc32(word))
        return number


def joined(before: np.ndarray, lengths: np.ndarray, crcs: np.ndarray, zeros: Zeros) -> np.ndarray:
    """The crc32 of what `before` is of with a blank and a word behind; the words have these lengths and crcs."""
    out = np.empty(len(before), np.uint32)
    order = np.argsort(lengths, kind="stable")
    ends = np.flatnonzero(np.diff(lengths[order])) + 1
    for at in np.split(order, ends) if len(order) else []:
        out[at] = through(zeros[int(lengths[at[0]])], before[at])
    return out ^ crcs


def features(texts: list[str], zeros: Zeros, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features, the text of each, words of each text) of whole texts."""
    if len(known) > 1 << 19:
        known.__init__()
        known.clear()
    words, counts = [], []
    for text in texts:
        found = WORD.findall(text.encode("utf-8", "replace").lower())
        words += map(known.__getitem__, found)
        counts.append(len(found))
    number, count = np.array(words, np.int64), np.array(counts, np.int64)
    of = np.repeat(np.arange(len(texts)), count)
    lengths, crcs, alone = (np.array(x, k) for x, k in ((known.lengths, np.int64), (known.crcs, np.uint32), (known.alone, np.uint32)))
    crc, buckets, owners = alone[number], [], []
    for n in range(1, LONGEST + 1):
        if n > 1:
            same = of[n - 1 :] == of[: len(of) - n + 1]
            crc = joined(crc[: len(of) - n + 1], lengths[number[n - 1 :]], crcs[number[n - 1 :]], zeros)
            buckets.append(crc[same] % BUCKETS)
            owners.append(of[n - 1 :][same])
        else:
            buckets.append(crc % BUCKETS)
            owners.append(of)
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), count


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts. Each task sums what it reads, so there are BUCKETS rows a task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, zeros, known = np.zeros(BUCKETS, np.int64), Zeros(), Vocabulary()
        for batch in batches:
            for part in slices(batch, 200):
                seen += np.bincount(features([t or "" for t in part.column(0).to_pylist()], zeros, known)[0], minlength=BUCKETS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])

    counted = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[counted["bucket"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed shares) of each bucket, in doubles."""
    of, to = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * of / ((s + 1.0) * to))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros, known = Zeros(), Vocabulary()
        for batch in batches:
            for part in slices(batch, 200):
                bucket, of, words = features([t or "" for t in part.column(1).to_pylist()], zeros, known)
                total = np.zeros(part.num_rows, np.int64)
                np.add.at(total, of, shared.value[bucket])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(np.bincount(of, minlength=part.num_rows)), pa.array(total)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))) of a uniform number drawn from the id; a null id draws like an empty one."""
    digits = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digits, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(u))).cast("long")


def cutoff(rows: DataFrame, value: str, wanted: int, at_least: bool) -> int:
    """The value v with fewer than `wanted` rows beyond it and at least `wanted` at or beyond it; beyond: above if at_least, else below. wanted: 1 to the rows there are.

    Bisection over whole numbers; each job counts exactly for the midpoints of LEVELS steps at once, so its work doesn't depend on where rows lie.
    """
    sign = 1 if at_least else -1
    column = F.col(value) * sign
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:  # the answer lies in [low, high]: count(>= low) >= wanted, count(> high) < wanted
        step = max(1, -(-(high - low) // (1 << LEVELS)))
        middles = list(range(low + step, high + 1, step))
        counts = rows.agg(*[F.count(F.when(column >= m, 1)) for m in middles]).first()
        enough = [m for m, n in zip(middles, counts) if n >= wanted]
        low, high = max(enough, default=low), min([m - 1 for m, n in zip(middles, counts) if n < wanted], default=high)
    return low * sign


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, of: int = OF, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank: 1, 2, ... for the floor(share * N / of) of the N rows with `least_words` words that score highest, else null.

    Ties go to the smaller doc_id, rows without an id last; rows of one id and score are drawn in any order (repeated rows are equal). Null texts have no words; a text without
    words has weight 0. Empty docs give no rows; an empty target makes the rare features of docs the wanted ones. Other columns don't matter.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = settle(weighed(docs, gain).withColumn("score", F.col("weight") + gumbel(seed)))
    able = rows.filter(F.col("n_words") >= least_words)
    wanted = able.count() * share // of
    columns = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    score = cutoff(able, "score", wanted, True)
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    ties = able.filter(F.col("score") == score).withColumn("place", order)
    rest = wanted - able.filter(F.col("score") > score).count()
    place = cutoff(ties.select("place"), "place", rest, False)
    # rows at the very cutoff, of one score and id, may be more than are still wanted: they rank last, and those beyond the number are given back
    taken = (F.col("n_words") >= least_words) & ((F.col("score") > score) | ((F.col("score") == score) & (order <= place)))
    ranked = number_rows(rows.filter(taken).select(*columns), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.unionAll(rows.filter(~taken).select(*columns, F.lit(None).cast("long").alias("rank")))
