"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch

def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation.

    The folder's owner removes old tables; a frame read from one may be used at any later time.
    """
    spark = df.sparkSession
    path = scratch(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(docs: DataFrame, score: Callable[[list[str]], dict[str, list]], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One output row per document: its id, and the columns that `score` gives for a list of whole texts.

    Null texts count as empty. Only the id and text columns are read, so other columns, whatever their names, don't matter.
    schema: DDL of the columns after the id.
    """
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = score([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[n], types[n]) for n in names)], ["doc_id", *names])

    types = {f.name: ARROW[f.dataType.simpleString()] for f in docs.sparkSession.createDataFrame([], schema).schema}
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, {schema}")


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch, so that a task holds few texts as Python strings at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def text_key(text_col: str = "text"):
    """A hash of the whole text (null: empty); with the id it names a row, for results depend on nothing else."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
