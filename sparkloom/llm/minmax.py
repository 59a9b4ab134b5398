"""MinHash near-duplicates by min-max hashing.

Each document's set of 2-word shingles is hashed under PERMUTATIONS permutations, and of each both the minimum and the maximum are kept: two values for the price
of one, each agreeing between two sets with the probability of their Jaccard likeness, and together with less variance than two minima of permutations of their own.
Bands of ROWS values are buckets: texts that share a bucket may be alike. Within a bucket all are proposed to the least class, and whole sets decide (`likeness.verified`). Where a bucket has
several groups left, those of which members' values agree are one crowd (`likeness.left_over`), and the whole sets of a crowd meet (`likeness.linked`). Star contraction joins the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, slices, text_key
from .likeness import WordHashes, class_of, left_over, linked, min_max, mix, permutations, sets_of, shingles, sketch, verified
from .simhash import components

SHINGLE = 2
LIKE, OF = 80, 100
PERMUTATIONS = 120  # 240 values
ROWS = 5  # values of a band: 48 bands; at a likeness of 0.8 all of them miss with a probability of 5e-9


def bands(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key for each band, signed; the band's number is part of it. Minima and maxima of one permutation stand in different bands, as they are not independent."""
    apart = np.concatenate([values[::2], values[1::2]])
    grid = apart[: len(apart) // rows * rows].reshape(-1, rows)
    key = np.arange(len(grid), dtype=np.uint64)
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, shingle: int = SHINGLE, count: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, class (a name of the set, 0 if it is empty), size, keys of the bands and a sketch of every row; null texts are empty."""
    factors, summands = permutations(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch):
                names, sizes, keys, sketches = [], [], [], []
                for text in part.column(2).to_pylist():
                    found = shingles(text or "", shingle, known)
                    values = min_max(found, factors, summands)
                    names.append(class_of(found))
                    sizes.append(len(found))
                    keys.append(bands(values, rows) if len(found) else [])
                    sketches.append(sketch(values))
                arrays = [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], ["doc_id", "text_key", "class", "size", "keys", "sketch"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return texts.mapInArrow(run, "doc_id long, text_key long, class long, size long, keys array<bigint>, sketch binary")


def links(docs: DataFrame, rows: DataFrame, classes: DataFrame, shingle: int = SHINGLE, like: int = LIKE, of: int = OF) -> DataFrame:
    """Edges (a, b) between classes, all verified, whose components are those of all links that a bucket shows.

    First each class meets the least class of all its buckets. Where a bucket has several groups left, members of different ones are held against each other by sketch; the groups that agreeing
    members connect, over all buckets, are a crowd. In a crowd all whole sets of different groups meet, inside tasks, so what agrees but isn't alike costs no rows: neither step
    makes more of them than its tasks have groups.
    """
    sizes = classes.select("class", "size")
    placed = settle(classes.select("class", F.explode("keys").alias("bucket")))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("lead")).filter("n > 1").select("bucket", "lead")
    stars = placed.join(shared, "bucket").filter("class <> lead").groupBy("class").agg(F.min("lead").alias("lead"))
    sketches = classes.select("class", "sketch")

    def sized(pairs: DataFrame) -> DataFrame:
        """The pairs (class, lead) whose sizes allow the likeness, as (a, b)."""
        both = pairs.join(sizes, "class").join(sizes.select(F.col("class").alias("lead"), F.col("size").alias("lead_size")), "lead")
        return both.filter(of * F.least("size", "lead_size") >= like * F.greatest("size", "lead_size")).select(F.col("lead").alias("a"), F.col("class").alias("b"))

    found = verified(sized(stars), docs, rows, shingle, like, of)
    roots = components(found)
    grouped = settle(classes.select("class", "size").join(roots, classes["class"] == roots.node, "left").select("class", "size", F.coalesce("root", "class").alias("root")))
    agreed = settle(left_over(placed.join(grouped, "class"), sketches, like, of, forest=True))
    crowds = components(agreed.unionAll(roots.select("root", "node")))
    named = grouped.join(crowds.select(F.col("node").alias("class"), F.col("root").alias("bucket")), "class", "left").withColumn("bucket", F.coalesce("bucket", "class"))
    several = named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    crowded = settle(named.join(several, "bucket"))
    sets = sets_of(docs, rows, crowded.select("class"), shingle)
    return found.unionAll(linked(crowded, sets, like, of))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, like: int = LIKE, of: int = OF) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    A row's set: its distinct runs of `shingle` words; of fewer words the whole sequence as one. Rows link where of * intersection >= like * union; every link is
    verified on whole sets. component_id: the smallest doc_id that links reach, the row's own included; null where no row of the group has an id. Rows without words are empty and linked with nothing:
    their own id. kept: doc_id = component_id, false without an id; repeated rows of the kept id are all kept. Equal sets are one
    node, so copies cost nothing. No rows in, no rows out; other columns don't matter.
    """
    rows = settle(signatures(docs, shingle))
    classes = settle(rows.filter("size > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    slim = rows.select("doc_id", "text_key", "class", "size")
    roots = components(links(docs, slim, classes, shingle, like, of))
    named = classes.join(roots, classes["class"] == roots.node, "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("reached"))
    by_class = settle(named.join(ids, "root").select("class", "reached"))
    found = slim.filter("size > 0").join(by_class, "class").select("doc_id", "size", F.col("reached").alias("component_id"))
    every = found.unionAll(slim.filter("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
