"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text gives the set of its hashed character n-grams (`SIZES`, over lower-cased UTF-8 bytes with a
blank at either end). From labelled rows Spark counts in how many texts of either class each
n-gram occurs; r = log of the ratio of the smoothed shares, drawn to 0 as far as its class counts may be chance. A text's features are r where the
n-gram is present, and logistic regression is trained on them. N-grams whose ratio is drawn to under LEAST have no weight: nine in ten, most of them seen in one or two texts. Scoring is one sum per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, settle, slices, text_key

BITS = 22
SIZES = (3, 4, 5, 6)
TRAIN_ROWS = 20_000  # bound of the labelled sample; all labelled ids while there are no more
# Those from CHANCE to PENALTY were compared by folds among the training rows (see README); held-out rows had no part in it.
CHANCE = 3.0  # deviations from the count expected by chance at which an n-gram's ratio is halved
STEEPNESS = 4  # how fast the ratio goes to 0 below that
LEAST = 0.05  # ratios that are smaller after that are 0
TOXIC_WEIGHT = 2.0  # a missed toxic text costs so many clean ones
PENALTY = 5e-4  # of the squared weights
ROUNDS = 100  # steps of the regression, at most
SMOOTHING = 1.0
THRESHOLD = 0.3
_PRIME, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def hashes(text: str) -> np.ndarray:
    """The buckets of the text's n-grams, with repeats."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    h, found = data, [np.empty(0, np.uint32)]
    for n in range(2, max(SIZES) + 1):
        if len(data) < n:
            break
        h = h[:-1] * _PRIME + data[n - 1 :]
        if n in SIZES:
            found.append(((h + np.uint32(n)) * _MIX) >> np.uint32(32 - BITS))
    return np.concatenate(found)


def ngrams(text: str) -> np.ndarray:
    """Sorted distinct buckets of the text's n-grams."""
    return np.unique(hashes(text))


@dataclass
class Features:
    """What makes a vector of a text: places has for each of the 2**BITS buckets 1 + its place among those whose ratio isn't 0, or 0; ratios are theirs."""

    places: np.ndarray
    ratios: np.ndarray

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the text's vector."""
        seen = np.zeros(len(self.ratios) + 1, bool)
        seen[self.places[hashes(text)]] = True
        at = np.flatnonzero(seen[1:])
        return at, self.ratios[at]


@dataclass
class Model:
    """features, one coefficient for each of them, and the bias. Their size is bounded by BITS and by the n-grams of the labelled sample."""

    features: Features
    coefficients: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        at, values = self.features.of(text)
        return float(1 / (1 + np.exp(-np.clip((self.coefficients[at] * values).sum() + self.bias, -500, 500))))


def training_labels(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most about `rows` labelled ids (doc_id, toxic): those whose id hashes lowest; held-out ids are left out.

    Held out: crc32 of the id as text, mod 4, is 2. Rows with a null id or label take no part; of several labels of an id the largest counts.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    usable = usable.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    return usable if n <= rows else usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * rows / n))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled documents that aren't held out.

    Without both classes among them the model knows only the class share: 0 without labels.
    The labels are broadcast: at most about `rows` pairs of numbers. Of several rows of a labelled id the text whose hash is lowest counts, once, so the fit has a row for each
    labelled id at most however often ids repeat; only these texts are shuffled.
    """
    chosen = training_labels(labels, rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_key().alias("text_key"))
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", "text_key").alias("text"), F.max("toxic").alias("toxic"))
    return fit(one.select("text", "toxic"))


def scaled_ratios(clean: np.ndarray, toxic: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Log-count ratios of n-grams in so many of n0 clean and n1 toxic texts, times d**STEEPNESS / (d**STEEPNESS + CHANCE**STEEPNESS); 0 if less than LEAST is left.

    d: the deviations of the toxic count from the one expected if class and n-gram had nothing to do with each other.
    """
    share = (toxic + clean) / (n0 + n1)
    d = np.abs(toxic - share * n1) / np.sqrt(share * (1 - share) * n1 * n0 / (n0 + n1) + 0.5)
    ratio = np.log((toxic + SMOOTHING) / (n1 + 2 * SMOOTHING)) - np.log((clean + SMOOTHING) / (n0 + 2 * SMOOTHING))
    drawn = ratio * d**STEEPNESS / (d**STEEPNESS + CHANCE**STEEPNESS)
    return np.where(np.abs(drawn) < LEAST, 0.0, drawn)


# a sparse vector as Spark's vector type stores it
_LISTS = pa.list_(pa.field("element", pa.int32(), False)), pa.list_(pa.field("element", pa.float64(), False))
_VECTOR = [pa.field("type", pa.int8(), False), pa.field("size", pa.int32()), pa.field("indices", _LISTS[0]), pa.field("values", _LISTS[1])]


def vectors(found: list[tuple[np.ndarray, np.ndarray]], size: int) -> pa.StructArray:
    """Sparse vectors of `size` components from their places and values."""
    ends = pa.array(np.cumsum([0, *(len(at) for at, _ in found)]), pa.int32())
    flat = [np.concatenate([*(f[k] for f in found), np.empty(0)]).astype(t) for k, t in enumerate((np.int32, np.float64))]
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, k.value_type), type=k) for x, k in zip(flat, _LISTS)]
    return pa.StructArray.from_arrays([pa.array(np.zeros(len(found), np.int8)), pa.array(np.full(len(found), size, np.int32)), *lists], fields=_VECTOR)


def fit(known: DataFrame, toxic_weight: float = TOXIC_WEIGHT, penalty: float = PENALTY) -> Model:
    """The model of the rows (text, toxic); all of them are used, so the caller bounds the number of rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import DoubleType, StructField, StructType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for part in slices(batch):
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    seen[toxic, ngrams(text)] += 1
        at = np.flatnonzero(seen.any(0))
        for low in range(0, len(at), 1 << 16):
            part = at[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[0, part].astype(np.int64)), pa.array(seen[1, part].astype(np.int64))], ["bucket", "clean", "toxic"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio = scaled_ratios(*(batch.column(k).to_numpy().astype(np.float64) for k in (1, 2)), n0, n1)
            at = np.flatnonzero(ratio)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(ratio[at])], ["bucket", "ratio"])

    known = settle(known.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    places = np.zeros(1 << BITS, np.int32)
    if not n0 or not n1:
        share = n1 / max(1, n0 + n1)
        return Model(Features(places, np.zeros(0)), np.zeros(0), float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -20, 20)))
    # pre-aggregated in each task, and only n-grams whose ratio isn't 0 come to the driver: 2**BITS at most, whatever the corpus
    counts = known.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kept = counts.mapInArrow(weigh, "bucket long, ratio double").toPandas().sort_values("bucket")
    places[kept["bucket"].to_numpy(np.int64)] = np.arange(1, len(kept) + 1)
    made = Features(places, kept["ratio"].to_numpy(np.float64))
    shared = known.sparkSession.sparkContext.broadcast(made)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 50):
                found = [shared.value.of(t) for t in part.column(0).to_pylist()]
                label = part.column(1).to_numpy().astype(np.float64)
                yield pa.RecordBatch.from_arrays([vectors(found, len(shared.value.ratios)), pa.array(label), pa.array(np.where(label > 0, toxic_weight, 1.0))], ["features", "label", "weight"])

    if not len(kept):
        return Model(made, np.zeros(0), float(np.log(toxic_weight * n1 / n0)))
    ready = known.mapInArrow(features, StructType([StructField("features", VectorUDT()), StructField("label", DoubleType()), StructField("weight", DoubleType())]))
    fitted = LogisticRegression(weightCol="weight", maxIter=ROUNDS, tol=1e-8, regParam=penalty, standardization=False).fit(ready)
    return Model(made, fitted.coefficients.toArray(), float(fitted.intercept))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text.

    One row per input row, repeated rows included; null and empty texts are scored like the empty text. A null id
    gives a null held_out. No shuffle: the model is a fixed number of weights.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = map_texts(docs, lambda texts: {"score": [shared.value.score(t) for t in texts]}, "score double")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under the threshold, with all their columns, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([shared.value.score(t or "") < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
