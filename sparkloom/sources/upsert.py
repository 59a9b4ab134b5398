"""Upserts into a partitioned Parquet table: only the partitions that changes touch are read and written anew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..names import fresh
from ..operators.scans import top_per_group
from ..plans.registry import query
from ..session import load, scratch


def same_key(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    """Equal keys; nulls are equal to each other. An equi-join for Spark."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in key])


def upsert(path: str, changes: DataFrame, key: list[str], by: str, order: list[Column] | None = None) -> None:
    """Rows of `changes` take the place of the table's rows of their key, or are added; the table at `path` is partitioned by the column `by`.

    Of several changes of one key the first in `order` counts (without an order: any one); a null is a key value, and a partition, like others. Columns are taken by name; changes must have all of the table's.
    Running it again with the same changes gives the same table, so an upsert that was broken off is simply run again. No changes: nothing is written.

    A key must stay in its partition: where `by` isn't part of the key, the table's key columns are read in full, and a ValueError is raised before anything is written if a change would move its row.
    The touched partitions' names are collected; they are as few as the table's folders. A hot key among the changes is cut before it is shuffled,
    and a hot partition is written by several tasks.
    """
    spark = changes.sparkSession
    table = spark.read.parquet(path)
    place = fresh("place", changes)
    new = top_per_group(changes, key, order or [F.lit(0)], 1, place).select(*table.columns)
    kept = scratch(spark, "changes")  # the changes are used more than once and may not be the same twice
    new.write.parquet(kept)
    new = spark.read.schema(table.schema).parquet(kept)
    names = [r[0] for r in new.select(by).distinct().collect()]
    if not names:
        return
    if by not in key:
        there, moved = table.select(*key, by), new.select(*key, by)
        if there.join(moved, same_key(there, moved, key) & ~there[by].eqNullSafe(moved[by]), "left_semi").limit(1).count():
            raise ValueError(f"a change has another {by} than its row in the table: it would be there twice")
    inside = F.col(by).isin([n for n in names if n is not None])
    touched = table.filter(inside | F.col(by).isNull() if None in names else inside)  # on folder names: other partitions aren't read
    merged = touched.join(new, same_key(touched, new, key), "left_anti").unionByName(new)
    # dynamic: the folders of partitions that have rows here are replaced when the job commits, others stay as they are
    merged.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN year(o_orderdate) >= 1999 AND o_orderpriority = '1-URGENT' THEN 'changed' ELSE o_orderstatus END AS status, o_totalprice FROM orders
UNION ALL SELECT -1 - o_orderkey, CAST(year(o_orderdate) AS INTEGER), 'added', o_totalprice FROM orders WHERE year(o_orderdate) >= 1999 AND o_orderpriority = '2-HIGH'""")
def p03_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by year; urgent ones of late years change, others are added. The changes are applied twice, which changes nothing more."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"), "o_totalprice", "o_orderpriority")
    path, columns = scratch(spark, "orders_by_year"), ["o_orderkey", "year", "status", "o_totalprice"]
    orders.select(*columns).hint("rebalance", "year").write.partitionBy("year").parquet(path)
    late = orders.filter("year >= 1999")
    changed = late.filter("o_orderpriority = '1-URGENT'").withColumn("status", F.lit("changed"))
    added = late.filter("o_orderpriority = '2-HIGH'").withColumns({"o_orderkey": -1 - F.col("o_orderkey"), "status": F.lit("added")})
    for _ in range(2):
        upsert(path, changed.unionByName(added).select(*columns), ["o_orderkey"], "year")
    return spark.read.parquet(path).select(*columns)
