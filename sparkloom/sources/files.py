"""File sources and sinks; each query writes a table in a format and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import load, scratch


def round_trip(df: DataFrame, fmt: str, partition_by: list[str] | None = None, **options) -> DataFrame:
    """df written to the shared folder as `fmt` and read with its own schema, so nothing is inferred."""
    spark = df.sparkSession
    path = scratch(spark, fmt)
    writer = df.write.format(fmt).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    reader = spark.read.format(fmt).options(**options)
    return (reader if fmt == "text" else reader.schema(df.schema)).load(path)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def p04_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "customer"), "csv", header="true")


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def p04_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "events"), "json", timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE p_size > 25")
def p04_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "part"), "orc").filter("p_size > 25")


@query("SELECT c_name AS value FROM customer")
def p04_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "customer").select(F.col("c_name").alias("value")), "text")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def p03_partitioned_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on the partition column prunes folders."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return round_trip(orders, "parquet", ["o_orderstatus"]).filter("o_orderstatus = 'F'")


@query("""SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority""")
def p03_bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables written with the same buckets; the join of them needs no shuffle."""
    names = []
    for table, key, columns in (("orders", "o_orderkey", ["o_orderkey", "o_orderpriority"]), ("lineitem", "l_orderkey", ["l_orderkey", "l_quantity"])):
        path = scratch(spark, f"bucketed_{table}")
        names.append("sparkloom_" + path.rsplit("-", 1)[-1])
        load(spark, sf_dir, table).select(*columns).write.bucketBy(8, key).sortBy(key).format("parquet").option("path", path).saveAsTable(names[-1])
    orders, lines = map(spark.table, names)
    for name in names:  # the files and the frames that read them stay
        spark.sql(f"DROP TABLE {name}")
    return orders.join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
