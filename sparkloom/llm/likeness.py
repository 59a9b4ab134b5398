"""Jaccard likeness of texts' shingle sets: sets, whole comparison of proposed pairs, and what a star of proposals has left out.

Texts of one set are one class, so copies cost nothing. Whoever proposes pairs names classes only; sets move once a pair at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, slices, text_key

SKETCH = 192  # bytes of a sketch: one of each of so many minima or maxima
CUT = 0.66  # of a sketch's bytes agree, or the pair isn't looked at: nearly five deviations under a likeness of 0.8
LEAD_PAIRS = 256  # pairs that one copy of a lead's set serves
CROWD = 4096  # members that a task compares with as many
PART_SHINGLES = 1 << 21  # of a part's sets together, about: 16 MB


class WordHashes(dict):
    """Words as bytes to 64 bits; kept for later texts of the task up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 0)
        return found


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, n: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of all runs of n words, of the whole sequence if there are fewer words; none without words. Words are as in `bytes.split`, A-Z lower-cased."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.array([], np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    span = min(n, len(words))
    run = np.full(len(h) - span + 1, span, np.uint64)
    for k in range(span):
        run = mix(run * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - span + 1 + k])
    return np.unique(run)


def permutations(count: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands: x -> factor * x + summand is a permutation of 64 bits."""
    drawn = np.random.default_rng(seed).integers(0, 1 << 64, (2, count), np.uint64, endpoint=False)
    return drawn[0] | np.uint64(1), drawn[1]


def min_max(found: np.ndarray, factors: np.ndarray, summands: np.ndarray) -> np.ndarray:
    """The minima and maxima of a set's hashes under each permutation, in turns: 2 * len(factors) values."""
    low, high = np.full(len(factors), np.iinfo(np.uint64).max), np.zeros(len(factors), np.uint64)
    for at in range(0, len(found), 1024):
        turned = factors[:, None] * found[None, at : at + 1024] + summands[:, None]
        np.minimum(low, turned.min(1), out=low)
        np.maximum(high, turned.max(1), out=high)
    return np.column_stack([low, high]).ravel()


def sketch(values: np.ndarray) -> bytes:
    """A byte of each of the first SKETCH minima and maxima."""
    return (values[:SKETCH] >> np.uint64(28)).astype(np.uint8).tobytes()


def class_of(found: np.ndarray) -> int:
    """A name of the set, signed; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64)) if len(found) else 0


def sets_of(docs: DataFrame, rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """class and set (the sorted hashes as bytes) of the wanted classes, from one text of each; rows: class and text_key of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, n, known).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["class", "set"])

    one = rows.join(wanted, "class", "left_semi").groupBy("class").agg(F.min("text_key").alias("text_key"))
    texts = docs.select(text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["text_key"])
    return settle(texts.join(one, "text_key").select("class", "text").mapInArrow(run, "class long, set binary"))


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, n: int, like: int, of: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets have of * intersection >= like * union.

    Each pair is turned so that the class with more pairs leads. Its set is sent once for LEAD_PAIRS pairs, the other's once a pair, so a class that leads very many
    is not copied for each, and no task holds more than one lead and a batch.
    """
    pairs = settle(pairs.select("a", "b").distinct())
    degrees = settle(pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n")))
    sets = sets_of(docs, rows, degrees.select("class"), n)
    named = lambda c: degrees.select(F.col("class").alias(c), F.struct("n", "class").alias(f"n_{c}"))
    turned = pairs.join(named("a"), "a").join(named("b"), "b").select(F.greatest("n_a", "n_b").alias("lead"), F.least("n_a", "n_b").getField("class").alias("other"))
    block = F.pmod(F.xxhash64("other"), F.ceil(F.col("lead.n") / LEAD_PAIRS))
    turned = settle(turned.select(F.col("lead.class").alias("lead"), "other", block.alias("block")))
    others = turned.join(sets.select(F.col("class").alias("other"), "set"), "other").select("lead", "block", "other", "set")
    leads = turned.select("lead", "block").distinct().join(sets.select(F.col("class").alias("lead"), "set"), "lead").select("lead", "block", F.lit(None).cast("long").alias("other"), "set")
    dealt = others.unionAll(leads).repartition("lead", "block").sortWithinPartitions("lead", "block", F.asc_nulls_first("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.array([], np.uint64)
        for batch in batches:
            for part in slices(batch, 200):
                good = []
                for other, data in zip(part.column(2).to_pylist(), part.column(3)):
                    mine = np.frombuffer(data.as_buffer(), np.uint64)
                    if other is None:
                        held = mine.copy()
                        good.append(False)
                    else:
                        both = len(np.intersect1d(held, mine, assume_unique=True)) if of * min(len(held), len(mine)) >= like * max(len(held), len(mine)) else 0
                        good.append(of * both >= like * (len(held) + len(mine) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return settle(dealt.mapInArrow(run, "a long, b long"))


def agreeing(sketches: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of rows agree in CUT of their sketches' bytes."""
    same = np.zeros(len(i), np.int64)
    for at in range(0, len(i), 1 << 16):
        cut = slice(at, at + (1 << 16))
        same[cut] = (sketches[i[cut]] == sketches[j[cut]]).sum(1)
    return same >= CUT * sketches.shape[1]


def apart(size: np.ndarray, group: np.ndarray, sketches: np.ndarray, first: np.ndarray, second: np.ndarray, like: int, of: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of `first`, row of `second`) of different groups whose sizes and sketches allow the likeness, in blocks by the first."""
    for at in range(0, len(first), 64):
        mine = first[at : at + 64]
        small, large = np.minimum(size[mine][:, None], size[second][None, :]), np.maximum(size[mine][:, None], size[second][None, :])
        x, y = np.nonzero((group[mine][:, None] != group[second][None, :]) & (of * small >= like * large))
        i, j = mine[x], second[y]
        good = agreeing(sketches, i, j)
        yield i[good], j[good]


def join_groups(group: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many of the pairs (i, j) of rows as it takes to join the groups that all of them join; `group` is changed to what they are then. Pairs of one i stand together."""
    firsts, seconds = [], []
    for part in np.split(np.arange(len(i)), np.flatnonzero(i[1:] != i[:-1]) + 1) if len(i) else []:
        mine = group[i[part[0]]]
        others, at = np.unique(group[j[part]], return_index=True)
        if (new := others != mine).any():
            firsts.append(i[part[at[new]]])
            seconds.append(j[part[at[new]]])
            group[np.isin(group, others[new])] = mine
    none = np.empty(0, np.int64)
    return np.concatenate([none, *firsts]), np.concatenate([none, *seconds])


def meetings(placed: DataFrame, data: DataFrame, column: str, parts: Column) -> DataFrame:
    """bucket, x, y, part, class, size, root and `column` of data (by class) for the members of buckets that have several groups, dealt so that every two parts x and y of a bucket meet in a task.

    parts: of a bucket with n members whose sizes add up to `total`.
    """
    buckets = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    held = placed.join(buckets.select("bucket", parts.cast("int").alias("parts")), "bucket").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).join(data, "class")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("x"), F.greatest(k, F.col("part")).alias("y")))
    dealt = held.select("bucket", "class", "size", "root", column, "part", F.inline(meets))
    return dealt.select("bucket", "x", "y", "part", "class", "size", "root", column).repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")


def left_over(placed: DataFrame, sketches: DataFrame, like: int, of: int, crowd: int = CROWD, forest: bool = False) -> DataFrame:
    """Pairs (a, b) of classes that share a bucket but are not yet of one group, and that sizes and sketches don't rule out: all of them, or as many as it takes to join the groups that all of them join.

    placed: bucket, class, size and root (the group so far); sketches: class and sketch. Where a bucket has several groups, each member is held against those of
    other groups by sketch. A bucket of over `crowd` members is cut to parts, every two of which meet in a task, so a task holds 2 * crowd at most. As a forest, a task gives fewer
    pairs than it has groups; all pairs may be as many as the square of its members.
    """
    dealt = meetings(placed, sketches, "sketch", F.ceil(F.col("n") / crowd))
    pairs = dealt.mapInArrow(_met(lambda rows, *sides: _agree(rows, *sides, like, of, forest)), "a long, b long").filter("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(placed: DataFrame, sets: DataFrame, like: int, of: int, crowd: int = CROWD, most: int = PART_SHINGLES) -> DataFrame:
    """Pairs (a, b) of classes that share a bucket and whose whole sets have of * intersection >= like * union: as many as it takes to join the groups that all such pairs join.

    placed: as for `left_over`; sets: class and set. The sets meet in the tasks, so no pair becomes a row before it is known to link, and a task gives fewer links than it has groups.
    Parts have about `crowd` members and sets of `most` shingles together.
    """
    dealt = meetings(placed, sets, "set", F.ceil(F.greatest(F.col("n") / crowd, F.col("total") / most)))
    return dealt.mapInArrow(_met(lambda rows, *sides: _link(rows, *sides, like, of)), "a long, b long")


def _agree(rows: pa.Table, size: np.ndarray, group: np.ndarray, first: np.ndarray, second: np.ndarray, like: int, of: int, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(size), -1)
    for i, j in apart(size, group, sketches, first, second, like, of):  # looks at the groups as they are when it comes to a block
        yield join_groups(group, i, j) if forest else (i, j)


def _link(rows: pa.Table, size: np.ndarray, group: np.ndarray, first: np.ndarray, second: np.ndarray, like: int, of: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sets are held as what they have more or less than the shingles that most of the task's have: near copies differ from these in few."""
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("set")]
    ends = np.cumsum([0, *map(len, sets)])
    every, ids, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    usual = np.flatnonzero(seen * 2 > len(sets))
    odd = [np.setxor1d(ids[low:high], usual, assume_unique=True) for low, high in zip(ends, ends[1:])]
    flat, n = np.concatenate(odd), np.array([len(x) for x in odd])
    begins = np.cumsum(n) - n
    mark = np.zeros(len(every), bool)
    for k in first:
        allowed = (group[second] != group[k]) & (of * np.minimum(size[k], size[second]) >= like * np.maximum(size[k], size[second]))
        meant = second[allowed]
        mark[odd[k]] = True
        for at in range(0, len(meant), 1024):
            j = meant[at : at + 1024]
            stops = np.cumsum(n[j])
            hits = np.concatenate([[0], np.cumsum(mark[flat[np.arange(stops[-1]) + np.repeat(begins[j] - stops + n[j], n[j])]])])
            differ = n[k] + n[j] - 2 * (hits[stops] - hits[stops - n[j]])
            both = (size[k] + size[j] - differ) // 2
            j = j[of * both >= like * (size[k] + size[j] - both)]
            yield join_groups(group, np.full(len(j), k), j)
        mark[odd[k]] = False


def _met(pairs_among: Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches sorted by bucket, x and y that gives the pairs `pairs_among` finds in each meeting: of its rows, sizes, groups, and the rows of either side."""

    def pairs_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        x, y, part, name, size, root = (rows.column(c).to_numpy() for c in ("x", "y", "part", "class", "size", "root"))
        if len(name) < 2:
            return
        _, group, n = np.unique(root, return_inverse=True, return_counts=True)
        if x[0] == y[0]:  # one part: its largest group needn't be held against itself
            first, second = np.flatnonzero(group != n.argmax()), np.arange(len(name))
        else:
            first, second = np.flatnonzero(part == x[0]), np.flatnonzero(part == y[0])
        for i, j in pairs_among(rows, size.astype(np.int64), group, first, second):
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(name[i]), pa.array(name[j])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in range(3)]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            begin = 0
            for end in [*change.tolist(), batch.num_rows]:
                piece = batch.slice(begin, end - begin)
                if waiting and any(waiting[-1].column(c)[0].as_py() != piece.column(c)[0].as_py() for c in range(3)):
                    yield from pairs_of(pa.Table.from_batches(waiting))
                    waiting = []
                waiting.append(piece)
                begin = end
        if waiting:
            yield from pairs_of(pa.Table.from_batches(waiting))

    return run
