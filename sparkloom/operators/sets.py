"""Set operations, distinct and all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import load

_C, _S = "SELECT c_nationkey AS nation FROM customer", "SELECT s_nationkey AS nation FROM supplier"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))


@query(f"{_C} UNION ALL {_S}")
def p50_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.unionByName(b)


@query(f"{_C} UNION {_S}")
def p50_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.unionByName(b).distinct()


@query(f"{_C} INTERSECT {_S}")
def p50_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.intersect(b)


@query(f"{_C} INTERSECT ALL {_S}")
def p50_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.intersectAll(b)


@query(f"{_C} EXCEPT {_S} WHERE s_acctbal > 5000")
def p50_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _sides(spark, sf_dir)
    return a.subtract(load(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation")))


@query(f"{_C} EXCEPT ALL {_S}")
def p50_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.exceptAll(b)
