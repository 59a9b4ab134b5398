"""The corpus pipeline: five stages, each over all that the one before kept.

`run` writes each stage to the shared folder and reads it again, so a lost executor costs one stage at most. In every stage a null text
is an empty one, null ids and sources are kept, repeated rows are rows of their own until near_dedup, and columns beyond those of documents, whatever their
names, stay up to packing. An empty table goes through all stages and gives no rows; without labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import mixing, packing, pii, simhash, toxicity
from sparkloom.llm.common import settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it is trained on the labelled ones that aren't held out. Empty texts are scored like others."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (likeness of 0.8 on 5-word shingles), the one with the smallest id.

    Texts without words are one group; a group whose rows have no id keeps one row for each distinct set of shingles.
    """
    return simhash.keep_alike(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks; n_chars follows the new text."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; smaller sources' documents again, up to two passes, as the weights ask. Null sources are one source."""
    return mixing.repeated(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The layout of all documents' tokens in length buckets and batches; a text without words is a piece of length 0."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("pii", redact_pii), ("mixing", mix_sources), ("packing", pack_batches)]
ORACLE_SQL = None  # training, xxHash fingerprints and graph iteration are not SQL; the tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
