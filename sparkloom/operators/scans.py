"""Scans, projections, filters, sorts, limits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..names import fresh
from ..plans.registry import query
from ..session import load


def top_per_group(df: DataFrame, by: list, order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; Spark prunes to k rows a task before it shuffles, so a hot group stays small."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


@query("SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem")
def p01_scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
WHERE l_quantity > 45 AND l_discount BETWEEN 0.05 AND 0.07 AND (l_returnflag = 'R' OR l_linestatus = 'O')""")
def p02_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = (F.col("l_quantity") > 45) & F.col("l_discount").between(0.05, 0.07) & ((F.col("l_returnflag") == "R") | (F.col("l_linestatus") == "O"))
    return load(spark, sf_dir, "lineitem").filter(kept).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def p40_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("""SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice,
CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3""")
def p40_top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per_group(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)


@query("SELECT event_type, user_id, event_id FROM events ORDER BY event_type, user_id DESC, event_id")
def p40_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_type", "user_id", "event_id").orderBy("event_type", F.desc("user_id"), "event_id")


@query()
def p41_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bernoulli sample of a tenth with a fixed seed."""
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").sample(fraction=0.1, seed=7)


@query()
def p41_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").sampleBy("l_returnflag", {"A": 0.5, "N": 0.1, "R": 0.2}, seed=7)


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE ('0x' || substr(md5(concat_ws('|', 'sample', CAST(l_orderkey AS VARCHAR))), 1, 8))::BIGINT % 1000 < 100""")
def p41_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the orders by hash, each with all its lines: the same rows whatever the layout, and in every table that has the key."""
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("sample"), F.col("l_orderkey").cast("string"))), 1, 8), 16, 10).cast("long") % 1000
    return load(spark, sf_dir, "lineitem").filter(place < 100).select("l_orderkey", "l_linenumber", "l_partkey")


def weighted_sample(df: DataFrame, by: list[str], ids: list[str], weight: str, k: int, seed: int = 42, rank: str = "rank") -> DataFrame:
    """Exactly k rows of each stratum (all with a weight, if fewer), drawn without replacement with chances by weight, with their place in the draw.

    A row's place is that of an exponential variable over its weight, made from a hash of the seed and its ids, so the draw doesn't depend on the layout and k' < k rows of it are the sample of size k'.
    Rows whose weight is null, not a number, infinite, zero or less are never drawn; a null stratum is one. Rows of equal ids and weights are tied and drawn in any order.
    Each task keeps k rows of a stratum before the shuffle.
    """
    at = fresh("at", df)
    share = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids])), 1, 13), 16, 10).cast("long") + 0.5) / (1 << 52)
    w = F.col(weight).cast("double")
    drawn = df.filter((w > 0) & (w < float("inf"))).withColumn(at, -F.log(share) / w)  # NaN is larger than infinity
    return top_per_group(drawn, by, [F.col(at), *ids], k, rank).drop(at)


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_returnflag
ORDER BY -ln((('0x' || substr(md5(concat_ws('|', '42', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) / l_quantity, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS rank
FROM lineitem WHERE l_quantity > 0) WHERE rank <= 200""")
def p41_weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 lines of each return flag, with chances by quantity."""
    lines = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return weighted_sample(lines, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey"], "l_quantity", 200).select("l_returnflag", "l_orderkey", "l_linenumber", "rank")
