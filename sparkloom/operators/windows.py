"""Window functions, frames, and batch time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import load


def sessions(events: DataFrame, by: str, ts: str, gap_seconds: float, chunk: str = "day") -> DataFrame:
    """Sessions of each key: rows no more than the gap apart belong together; by, started, ended and n (a key of such a name keeps it, the other gets a line behind).

    Gaps are exact to the microsecond. Rows without a time take no part, those without a key are one key, other columns don't matter.
    A key's rows are cut into chunks of time, so a hot key is spread over tasks. Only the first and last session of each chunk can go on in
    another; these few are joined to their neighbours in a second window, in which each other session is a group of its own. So nothing is computed twice.
    """
    apart = lambda a, b: F.coalesce(F.timestamp_diff("MICROSECOND", a, b) > round(gap_seconds * 1_000_000), F.lit(True)).cast("int")
    rows = events.select(F.col(by).alias("key"), F.col(ts).alias("at")).filter("at is not null").withColumn("chunk", F.date_trunc(chunk, "at"))
    near = Window.partitionBy("key", "chunk").orderBy("at")
    numbered = rows.withColumns({"fresh": apart(F.lag("at").over(near), F.col("at")), "ends": F.lead("at").over(near).isNull()})
    numbered = numbered.withColumn("part", F.sum("fresh").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy("key", "chunk", "part").agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("n"), F.max("ends").alias("ends"))
    parts = parts.withColumn("own", F.when(~((F.col("part") == 1) | F.col("ends")), F.struct("chunk", "part")))  # null: at the edge of its chunk
    order = Window.partitionBy("key", "own").orderBy("started")
    joined = parts.withColumn("fresh", apart(F.lag("ended").over(order), F.col("started"))).withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = joined.groupBy("key", "own", "part").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("n").alias("n"))
    return whole.select(F.col("key").alias(by), *[F.col(c).alias(c + "_" * (c == by.lower())) for c in ("started", "ended", "n")])


@query("""SELECT o_custkey, o_orderkey, CAST(rank() OVER w AS INTEGER) AS rk, CAST(dense_rank() OVER w AS INTEGER) AS dense, CAST(row_number() OVER w AS INTEGER) AS rn,
round(percent_rank() OVER w, 8) AS pr, CAST(ntile(4) OVER w AS INTEGER) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""")
def p30_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dense"), F.row_number().over(w).alias("rn"), F.round(F.percent_rank().over(w), 8).alias("pr"), F.ntile(4).over(w).alias("quarter"))


@query("""SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, -1) OVER w AS after, first_value(o_orderkey) OVER w AS first_key,
last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key,
nth_value(o_orderkey, 2) OVER w AS second_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def p31_analytic(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice", 2, -1.0).over(w).alias("after"), F.first_value("o_orderkey").over(w).alias("first_key"),
        F.last_value("o_orderkey").over(whole).alias("last_key"), F.nth_value("o_orderkey", 2).over(w).alias("second_key"),
    )


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS last4,
count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS last_hour FROM events""")
def p32_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-3, 0)
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    hour = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return events.select("event_id", F.round(F.sum("value").over(rows), 4).alias("last4"), F.count("*").over(hour).alias("last_hour"))


@query("SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def p70_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = load(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("window.start").cast("timestamp_ntz").alias("started"), "event_type", "n", "total")


@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(CAST(15 * k AS INTEGER)) AS started, count(*) AS n
FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL""")
def p70_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = load(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "15 minutes")).agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").cast("timestamp_ntz").alias("started"), "n")


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM b GROUP BY user_id, s""")
def p70_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(load(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", 1800)
