"""Phrase collocation mining with Rabin-Karp fingerprints.

Texts become arrays of word hashes once. On each level n a prefix polynomial over a batch of texts gives the fingerprint of every run of n words by two lookups and a product; a
run takes part only if both its runs of n - 1 words occur often enough, as a run is never commoner than its parts. The shuffle adds up fingerprints, with a pointer to one text
that holds the run and the least and greatest check value (a second polynomial): where these differ, two phrases share a fingerprint, and the texts
decide. Only phrases that are common enough are read from their texts at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scans import top_per_group
from .common import settle, slices
from .likeness import WordHashes, mix

LONGEST = 5
LEAST = 100  # occurrences of a phrase
TOP = 2000  # phrases of a language
ENDS = b".,;:!?\n\x0b\x0c\r"  # what ends a piece of text
PIECE_WORDS = 1 << 17  # words that a task hashes and sums at once: each is some 130 bytes meanwhile
LOAD = 32  # runs for each value that fingerprints are cut to when they are counted roughly: half of that to all of it
BITMAP_BITS = 27  # of the broadcast bitmap of common fingerprints, at most: 16 MB; a fuller one lets more runs through, none less
_TO_LINE = bytes.maketrans(ENDS, b"\n" * len(ENDS))
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so that they have inverses


def tokens(text: str) -> list[bytes]:
    """The words, A-Z lower-cased, with an empty one behind each piece."""
    out: list[bytes] = []
    for piece in text.encode("utf-8", "replace").lower().translate(_TO_LINE).split(b"\n"):
        if words := piece.split():
            out += words
            out.append(b"")
    return out


def hashed(words: list[bytes], known: WordHashes) -> np.ndarray:
    """A hash of each word, never 0; 0 for the empty ones."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    h[h == 0] = 1
    h[np.fromiter(map(len, words), np.int64, len(words)) == 0] = 0  # not from `known`, which forgets all it holds once it is full
    return h


@dataclass(frozen=True)
class Printer:
    """Fingerprints of runs of words; bits: how many are kept (fewer than 64 only in tests, to make collisions)."""

    bits: int = 64

    def runs(self, words: np.ndarray, lang: np.ndarray, n: int, check: bool = False) -> np.ndarray:
        """For each place the fingerprint of the n words from there on; what begins within n of the end is left out."""
        base, size = BASES[check], len(words) - n + 1
        if size < 1:
            return np.empty(0, np.uint64)
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words), np.uint64(base))]))
        inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(pow(base, -1, 1 << 64)))]))
        prefix = np.concatenate([[np.uint64(0)], np.add.accumulate(words * power[:-1])])
        value = (prefix[n:] - prefix[:-n]) * inverse
        found = mix(value + lang[:size] * np.uint64(BASES[1 - check]) + np.uint64(n))
        return found if check or self.bits == 64 else found & np.uint64((1 << self.bits) - 1)


def check_values(prints: np.ndarray) -> np.ndarray:
    return (prints >> np.uint64(32)).astype(np.uint32).view(np.int32)


def inside(words: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from each place on are of one piece."""
    ends = np.concatenate([[0], np.add.accumulate(words == 0)])
    return ends[n:] == ends[:-n]


def has(bitmap: np.ndarray, prints: np.ndarray) -> np.ndarray:
    at = prints & np.uint64(len(bitmap) * 64 - 1)
    return bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1


def bitmap_of(prints: DataFrame) -> np.ndarray:
    """The bits of all fingerprints `fp`, as 64-bit words; made by Spark, at most 2**BITMAP_BITS bits whatever the number of fingerprints."""
    bits = min(BITMAP_BITS, max(12, (16 * prints.count()).bit_length()))
    at = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1))
    words = prints.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(fp & 63 as int))")).alias("word")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["at"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64).view(np.uint64)
    return out


def _lang() -> Column:
    return F.coalesce("lang", F.lit("und"))


def _key() -> Column:
    """Names a text in a language: a pointer to any row with it."""
    return F.xxhash64(F.coalesce("text", F.lit("")), _lang())


def word_arrays(docs: DataFrame) -> DataFrame:
    """lang, lang_hash, key, n (words) and words (hashes, 0 behind each piece) of every row, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch, 200):
                found = [hashed(tokens(t or ""), known) for t in part.column(3).to_pylist()]
                words = pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([np.count_nonzero(f) for f in found], pa.int64()), words], ["lang", "lang_hash", "key", "n", "words"])

    rows = docs.select(_lang().alias("lang"), F.xxhash64(_lang()).alias("lang_hash"), _key().alias("key"), "text")
    return settle(rows.mapInArrow(run, "lang string, lang_hash long, key long, n long, words array<bigint>"))


def by_words(batch: pa.RecordBatch, column: int, most: int = PIECE_WORDS) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of `most` words or a single text, so that a task's arrays have a bound."""
    ends = batch.column(column).offsets.to_numpy()
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + most, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def common_runs(arrays: DataFrame, n: int, total: int, shorter: np.ndarray | None, printer: Printer, least: int) -> DataFrame:
    """fp, a (occurrences), key (a text that has it), low and high (check values) of the fingerprints of n words that occur `least` times.

    shorter: the bitmap of the common runs of n - 1 words; total: about how many runs there are. Most runs are rare, so first only fingerprints cut to as many values as let some
    LOAD runs share one are counted: what falls to a value that all of its runs together don't bring to `least` is rare for sure. Only the others are sent with all they
    carry. Each piece of a batch is summed before it leaves its task.
    """
    bits = max(12, (total // LOAD).bit_length())
    shared = arrays.sparkSession.sparkContext.broadcast(shorter)

    def found(piece: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Sorted fingerprints of the runs that take part, their check values and keys."""
        column = piece.column(2)
        words = column.flatten().to_numpy().view(np.uint64)
        ends = column.offsets.to_numpy() - column.offsets[0].as_py()
        lang, key = np.repeat(piece.column(0).to_numpy().view(np.uint64), np.diff(ends)), piece.column(1).to_numpy().view(np.uint64)
        good = inside(words, n) if len(words) >= n else np.zeros(0, bool)
        if shorter is not None and len(good):
            common = has(shared.value, printer.runs(words, lang, n - 1))
            good &= common[:-1] & common[1:]
        at = np.flatnonzero(good)
        fp = printer.runs(words, lang, n)[at]
        if dense is not None:
            some = has(dense.value, cut(fp))
            at, fp = at[some], fp[some]
        order = np.argsort(fp)
        return fp[order], lambda: check_values(printer.runs(words, lang, n, True)[at[order]]), lambda: key[np.searchsorted(ends, at[order], "right") - 1]

    def cut(fp: np.ndarray) -> np.ndarray:
        return fp & np.uint64((1 << bits) - 1)

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in by_words(batch, 2):
                value, counts = np.unique(cut(found(piece)[0]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(counts)], ["fp", "n"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in by_words(batch, 2):
                fp, checks, keys = found(piece)
                if not len(fp):
                    continue
                check = checks()
                first = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])]))
                counts = np.diff(np.concatenate([first, [len(fp)]]))
                yield pa.RecordBatch.from_arrays([pa.array(fp[first].view(np.int64)), pa.array(counts), pa.array(keys()[first].view(np.int64)), pa.array(check[first])], ["fp", "n", "key", "check"])

    rows, dense = arrays.select("lang_hash", "key", "words"), None
    crowded = settle(rows.mapInArrow(coarse, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("a")).filter(F.col("a") >= least).select("fp"))
    dense = arrays.sparkSession.sparkContext.broadcast(bitmap_of(crowded))
    summed = rows.mapInArrow(whole, "fp long, n long, key long, check int").groupBy("fp").agg(F.sum("n").alias("a"), F.min("key").alias("key"), F.min("check").alias("low"), F.max("check").alias("high"))
    level = settle(summed.filter(F.col("a") >= least))
    for bitmap in (shared, dense):  # no later level needs it
        bitmap.destroy()
    return level


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """lang, text and the other columns of `wanted` (one row a key), for one row of docs for each key."""
    rows = docs.select(_lang().alias("lang"), F.coalesce("text", F.lit("")).alias("text"), _key().alias("key"))
    one = rows.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])
    return one.join(wanted, "key")


def read_phrases(docs: DataFrame, runs: DataFrame, printer: Printer) -> DataFrame:
    """lang, phrase, size and a of runs (size, fp, low, a, key) whose fingerprint is of one phrase, read from the texts they point to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch, 200):
                out: list[tuple] = []
                for lang, lang_hash, text, asked in zip(*(c.to_pylist() for c in part.columns)):
                    words = tokens(text)
                    hashes = hashed(words, known)
                    langs = np.full(len(words), np.uint64(lang_hash % (1 << 64)))
                    for n in {x["size"] for x in asked}:
                        counts = {(x["fp"] % (1 << 64), x["low"]): x["a"] for x in asked if x["size"] == n}
                        prints, checks = printer.runs(hashes, langs, n), check_values(printer.runs(hashes, langs, n, True))
                        places = np.flatnonzero(np.isin(prints, np.array([fp for fp, _ in counts], np.uint64)) & inside(hashes, n))
                        for at in places.tolist():  # a run that was left out of the counts may have the fingerprint of one that wasn't
                            if (a := counts.pop((int(prints[at]), int(checks[at])), None)) is not None:
                                out.append((lang, b" ".join(words[at : at + n]).decode("utf-8", "replace"), n, a))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))], ["lang", "phrase", "size", "a"])

    asked = runs.groupBy("key").agg(F.collect_list(F.struct("size", "fp", "low", "a")).alias("asked"))  # no more than the runs of one text
    return texts_of(docs, asked).select("lang", F.xxhash64("lang").alias("lang_hash"), "text", "asked").mapInArrow(run, "lang string, phrase string, size int, a long")


def recounted(docs: DataFrame, mixed: DataFrame, printer: Printer, least: int) -> DataFrame:
    """lang, phrase, size and a of the common phrases among those that share a fingerprint (mixed: size, fp), counted by their own words in all texts."""
    shared = docs.sparkSession.sparkContext.broadcast({n: bitmap_of(mixed.filter(F.col("size") == n)) for n in sorted(r["size"] for r in mixed.select("size").distinct().collect())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch, 100):
                out: dict[tuple, int] = {}
                for lang, lang_hash, text in zip(*(c.to_pylist() for c in part.columns)):
                    words = tokens(text)
                    hashes = hashed(words, known)
                    langs = np.full(len(words), np.uint64(lang_hash % (1 << 64)))
                    for n, bitmap in shared.value.items():
                        prints = printer.runs(hashes, langs, n)
                        for at in np.flatnonzero(has(bitmap, prints) & inside(hashes, n)[: len(prints)] if len(prints) else []).tolist():
                            run_of = (lang, b" ".join(words[at : at + n]).decode("utf-8", "replace"), n, int(prints[at].astype(np.int64)))
                            out[run_of] = out.get(run_of, 0) + 1
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], pa.array(list(out.values()), pa.int64())], ["lang", "phrase", "size", "fp", "n"])

    rows = docs.select(_lang().alias("lang"), F.xxhash64(_lang()).alias("lang_hash"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.mapInArrow(run, "lang string, phrase string, size int, fp long, n long").join(mixed, ["size", "fp"], "left_semi")
    return counted.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)


def common_phrases(docs: DataFrame, arrays: DataFrame, least: int = LEAST, printer: Printer = Printer()) -> DataFrame:
    """lang, phrase, size and a of all phrases of 1 to LONGEST words with a >= least, exact whatever fingerprints collide."""
    shorter, runs, total = None, None, arrays.agg(F.sum("n")).first()[0] or 0
    for n in range(1, LONGEST + 1):
        level = common_runs(arrays, n, total, shorter, printer, least)
        sized = level.withColumn("size", F.lit(n))
        runs = sized if runs is None else runs.unionAll(sized)
        if n < LONGEST:
            shorter = bitmap_of(level.select("fp"))
    one, mixed = runs.filter("low = high"), settle(runs.filter("low <> high").select("size", "fp"))
    found = read_phrases(docs, one, printer)
    if not mixed.isEmpty():
        found = found.unionAll(recounted(docs, mixed, printer, least))
    return settle(found)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, printer: Printer = Printer()) -> DataFrame:
    """Each language's first `top` collocations: lang, rank, phrase, a, l, r, n and score.

    Words: runs without blanks or tabs, A-Z lower-cased, of pieces that ENDS and line breaks part; null texts are empty, a null lang is `und`. Per lang: n counts all words, f a
    phrase's occurrences within pieces. Candidates: phrases of 2 to LONGEST words with a = f(phrase) >= least. Cut after its first k words a candidate has l = f(first part),
    r = f(rest) and score floor(1000 * a * n / (l * r)), in decimals, so exact; the cut with the lowest score counts, of equal ones the smallest k. A candidate
    that a candidate one word longer holds as often (so also one that a still longer one does) goes. Rank: score descending, a descending, phrase ascending by bytes.
    Repeated rows count each time; without words there are no rows; columns beyond lang and text don't matter.
    """
    arrays = word_arrays(docs)
    counts = common_phrases(docs, arrays, least, printer)
    words = arrays.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = F.split("phrase", " ")
    text = lambda start, size: F.array_join(F.slice(F.col("words"), start, size), " ")
    candidates = counts.filter("size > 1").withColumn("words", parts)
    longer = candidates.filter("size > 2").select("lang", "a", F.explode(F.array(text(F.lit(1), F.col("size") - 1), text(F.lit(2), F.col("size") - 1))).alias("phrase"))
    held = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = candidates.join(held, ["lang", "phrase"], "left").filter("most is null or most < a")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "phrase", "a", "k", text(F.lit(1), F.col("k")).alias("first"), text(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    side = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(f))
    cut = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(words, "lang")
    whole = lambda c: f"cast({c} as decimal(18, 0))"
    score = F.expr(f"cast({whole('a')} * {whole('n')} as decimal(34, 0)) * cast(1000 as decimal(4, 0)) div ({whole('l')} * {whole('r')})")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cut.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    first = top_per_group(scored, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
