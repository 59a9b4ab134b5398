"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Each common word (anchor) of a text, and the text's start, gives a signature: the anchor with the
next `CHAIN` content words. A text's fingerprint is its set of signatures; equal sets
give equal strings. Sets are compared by Jaccard likeness. For a search over all pairs, sets are
partitioned by length: sets whose lengths differ by more than the threshold allows can't be
similar, so each set meets its own partition and the next one only, and there only sets that
share one of its rarest signatures.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, slices, text_key

CHAIN = 2
GAP = 16  # content words between two anchors; beyond that each of them is an anchor
SIMILARITY = 0.8
# Common words of English, French, German and Spanish.
ANCHORS = frozenset(
    """a an the and or of to in on for with by at from as is are was were be this that it not which has have
    le la les un une des du de et en dans sur pour par avec est que qui il elle ne pas ce se au aux sont
    der die das ein eine und oder von zu mit auf für im ist sind nicht sich den dem des auch als wie bei
    el los las una y o del al con por para es son no su sus lo como más pero""".split()
)
_WORD = re.compile(r"\w+")


def signatures(text: str, chain: int = CHAIN) -> frozenset[int]:
    """64-bit hashes of the text's signatures.

    The text's start counts as an anchor whose chain may be short. Where more than GAP content words follow each other
    without an anchor (tables, code, other languages), each of them begins a chain, so no such stretch is left out. A text without content words has its own
    hash as only signature; the empty text has none.
    """
    content: list[str] = []
    spots: list[tuple[int, str]] = []
    for w in _WORD.findall(text.lower()):
        if w in ANCHORS:
            spots.append((len(content), w))
        else:
            content.append(w)
    digest = xxhash.xxh64_intdigest
    if not content:
        return frozenset([digest("\x01" + text)]) if text else frozenset()
    last = len(content) - chain
    out = {digest(w + " " + " ".join(content[k : k + chain])) for k, w in spots if k <= last}
    bounds = [0, *(k for k, _ in spots), len(content)]
    for a, b in zip(bounds, bounds[1:]):
        if b - a > GAP or not spots:
            out.update(digest("\x03" + " ".join(content[k : k + chain])) for k in range(a, min(b, last + 1)))
    out.add(digest("\x02" + " ".join(content[:chain])))
    return frozenset(out)


def digest(sigs: frozenset[int]) -> str:
    """The fingerprint as text: the number of signatures, and 128 bits of their sorted list."""
    data = b"".join(s.to_bytes(8, "little") for s in sorted(sigs))
    return f"{len(sigs)}-{xxhash.xxh3_128_hexdigest(data)}"


def likeness(a: frozenset[int], b: frozenset[int]) -> float:
    """Jaccard likeness, 0 to 1; two empty sets are alike."""
    if not a and not b:
        return 1.0
    same = len(a & b)
    return same / (len(a) + len(b) - same)


def edited(text: str, after: str) -> str:
    """The text whose last half is replaced by as many characters of the next text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


FIRST, DONE, LAST = 0, 1, 2  # places of a row in its partition: text only, compared, waiting for the next partition
_ROW = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likeness; see `_ROW` for the columns after doc_id.

    The next document is that with the next smaller doc_id, after the smallest comes the largest; rows without an id
    come after all ids, and rows of one id follow by a hash of the text. A single row is its own next one. Null texts are empty.
    One row per input row; none for none; other columns don't matter.

    Rows are range-partitioned by id, hash and place in the table, so many rows of one id or none are spread, and a row's successor is behind it in the same task. Only a
    partition's last row waits: it and each partition's first row are few and are joined by partition number.
    """
    order = [F.desc_nulls_last("doc_id"), F.asc("text_key"), F.asc("at")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_key().alias("text_key"), F.monotonically_increasing_id().alias("at"))
    ranged = texts.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = f"doc_id long, {_ROW}, partition int, place int, text string"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
    names = [f.split()[0] for f in schema.split(", ")]

    def row(doc_id, text, after, mine, theirs):
        other = edited(text, after)
        sigs = signatures(other)
        return (doc_id, len(text), hashlib.sha256(other.encode("utf-8", "replace")).hexdigest(), digest(mine), digest(sigs), likeness(mine, sigs), likeness(mine, theirs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, before = TaskContext.get().partitionId(), None
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    sigs = signatures(text)
                    if before is None:
                        rows.append((doc_id, *[None] * 6, number, FIRST, text))
                    else:
                        rows.append((*row(before[0], before[1], text, before[2], sigs), number, DONE, None))
                    before = (doc_id, text, sigs)
                if rows:
                    yield packed()
                    rows.clear()
        if before is not None:
            rows.append((before[0], *[None] * 6, number, LAST, before[1]))
            yield packed()

    found = settle(ranged.mapInArrow(run, schema))
    ends = found.filter(F.col("place") != DONE).select("doc_id", "partition", "place", "text")
    # one row a partition and end: the order of partitions needs their numbers only
    firsts = ends.filter(F.col("place") == FIRST).select("partition", F.col("text").alias("after"))
    order = Window.orderBy("partition")
    steps = firsts.select("partition").withColumn("next", F.coalesce(F.lead("partition").over(order), F.first("partition").over(order)))
    waiting = ends.filter(F.col("place") == LAST).join(steps, "partition").join(firsts.withColumnRenamed("partition", "next"), "next").select("doc_id", "text", "after")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [row(i, t, a, signatures(t), signatures(a)) for i, t, a in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names[:7])

    return found.filter(F.col("place") == DONE).select(*names[:7]).unionAll(waiting.mapInArrow(finish, f"doc_id long, {_ROW}"))


def signature_sets(docs: DataFrame) -> DataFrame:
    """doc_id, sigs (sorted array) and size of every row with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [sorted(s - (1 << 64) if s >> 63 else s for s in signatures(t or "")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "sigs"])

    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, sigs array<bigint>").withColumn("size", F.size("sigs"))


def similar_pairs(docs: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, likeness) of classes with Jaccard likeness >= threshold, and each document's class.

    A class is one distinct signature set, named by its smallest doc_id, so copies are not expanded to pairs. Empty sets
    form one class. Sets of length n lie in partition floor(log(n) / -log(threshold)): a partner lies in the same or
    a neighbouring one. Signatures are ordered rarest first; two similar sets share one of their first
    n - ceil(threshold * n) + 1, so only those are joined, and lengths are held against the threshold before any set is compared.
    Rows without an id take no part; repeated rows are members each; null texts are empty; no rows give no pairs and no members.
    """
    sets = settle(signature_sets(docs))
    by_set = settle(sets.groupBy("sigs", "size").agg(F.min("doc_id").alias("class")))
    members = sets.join(by_set, ["sigs", "size"]).select("doc_id", "class")
    tokens = by_set.select("class", "size", F.explode("sigs").alias("sig"))
    rare = tokens.groupBy("sig").agg(F.count("*").alias("n"))
    ranked = tokens.join(rare, "sig").withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy("n", "sig")))
    probes = ranked.filter(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).filter("n > 1").select("class", "size", "sig")
    probes = settle(probes.withColumn("cell", F.floor(F.log(F.col("size").cast("double")) / -math.log(threshold)).cast("int")))
    low = probes.select(F.col("class").alias("a"), F.col("size").alias("size_a"), "sig", "cell")
    high = probes.select(F.col("class").alias("b"), F.col("size").alias("size_b"), "sig", F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("cell"))
    fits = (F.col("size_a") <= F.col("size_b")) & ((F.col("size_a") < F.col("size_b")) | (F.col("a") < F.col("b"))) & (F.col("size_a") >= F.col("size_b") * threshold - 1e-9)
    candidates = low.join(high, ["sig", "cell"]).filter(fits).select("a", "b").distinct()
    left, right = by_set.select(F.col("class").alias("a"), F.col("sigs").alias("sigs_a")), by_set.select(F.col("class").alias("b"), F.col("sigs").alias("sigs_b"))
    same = F.size(F.array_intersect("sigs_a", "sigs_b"))
    pairs = candidates.join(left, "a").join(right, "b").withColumn("likeness", same / (F.size("sigs_a") + F.size("sigs_b") - same))
    return pairs.filter(F.col("likeness") >= threshold - 1e-12).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness"), members
