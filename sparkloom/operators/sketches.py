"""Sketches stored by day and merged over ranges of days, so that a count over any range reads sketches, not rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import load, scratch

LOG_SIZE = 12  # 4096 entries: standard errors of about 1.6 % (HLL) and 1.6 % (theta; exact below that number)


def store_days(events: DataFrame, path: str) -> None:
    """One row for each day and kind with HLL and theta sketches of its users; its size depends on days and kinds only. Null users aren't counted."""
    events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.hll_sketch_agg("user_id", LOG_SIZE).alias("hll"), F.theta_sketch_agg("user_id", LOG_SIZE).alias("theta")).write.parquet(path)


def merged(days: DataFrame, *by) -> DataFrame:
    """Sketches of all days of each group; merging loses nothing against one sketch of all rows."""
    return days.groupBy(*by).agg(F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta").alias("theta"))


@query("""SELECT DISTINCT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, true AS hll_near, true AS theta_near FROM events""")
def p23_stored_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether users by week and kind, from sketches stored by day, are within five standard errors of the exact numbers; all should be."""
    path = scratch(spark, "sketches")
    events = load(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    store_days(events, path)
    week = F.to_date(F.date_trunc("week", "day")).alias("week")
    found = merged(spark.read.parquet(path), week, "event_type").select("week", "event_type", F.hll_sketch_estimate("hll").alias("hll"), F.theta_sketch_estimate("theta").alias("theta"))
    exact = events.groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), "event_type").agg(F.count_distinct("user_id").alias("users"))
    near = lambda c: F.abs(F.col(c) - F.col("users")) <= 5 * 0.0163 * F.col("users") + 1
    return exact.join(found, ["week", "event_type"]).select("week", "event_type", near("hll").alias("hll_near"), near("theta").alias("theta_near"))


@query("""WITH u AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-15')
SELECT count(*) FILTER (viewed AND bought) > 0 AS some_both, true AS both_near, true AS only_near FROM (SELECT user_id, bool_or(event_type = 'view') AS viewed, bool_or(event_type = 'purchase') AS bought FROM u GROUP BY user_id)""")
def p23_sketch_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations on stored sketches: users who viewed and bought in two weeks, and who viewed only, within five standard errors (of the union's size) of the exact numbers."""
    path = scratch(spark, "sketches")
    events = load(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    store_days(events, path)
    kinds = merged(spark.read.parquet(path).filter("day < DATE '2024-01-15' AND event_type IN ('view', 'purchase')"), "event_type")
    side = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("theta")))
    sets = kinds.agg(side("view").alias("v"), side("purchase").alias("p")).select(
        F.theta_sketch_estimate(F.theta_intersection("v", "p")).alias("both"), F.theta_sketch_estimate(F.theta_difference("v", "p")).alias("only"), F.theta_sketch_estimate(F.theta_union("v", "p")).alias("either")
    )
    users = events.filter("ts < TIMESTAMP_NTZ '2024-01-15'").groupBy("user_id").agg(F.max(F.col("event_type") == "view").alias("viewed"), F.max(F.col("event_type") == "purchase").alias("bought"))
    exact = users.agg(F.count_if(F.col("viewed") & F.col("bought")).alias("n_both"), F.count_if(F.col("viewed") & ~F.col("bought")).alias("n_only"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 5 * 0.0163 * F.col("either") + 1
    return exact.join(sets, F.lit(True)).select((F.col("both") > 0).alias("some_both"), near("both", "n_both").alias("both_near"), near("only", "n_only").alias("only_near"))


def store_counts(events: DataFrame, path: str, tracked: int) -> None:
    """One row for each day with a sketch of the most frequent pairs of kind and hour of day; nulls among them make the text null and aren't counted."""
    item = F.concat_ws("@", "event_type", F.hour("ts").cast("string"))
    known = F.when(F.col("event_type").isNotNull() & F.col("ts").isNotNull(), item)
    events.select(F.to_date("ts").alias("day"), known.alias("item")).groupBy("day").agg(F.expr(f"approx_top_k_accumulate(item, {tracked})").alias("counts")).write.parquet(path)


def most_frequent(days: DataFrame, by: list, k: int, tracked: int) -> DataFrame:
    """The k most frequent items of each group from its days' sketches: item and count.

    Counts are exact while a group has at most 0.75 * tracked different items; beyond that they are off by at most about 3.5 / tracked of the group's rows.
    """
    together = days.groupBy(*by).agg(F.expr(f"approx_top_k_combine(counts, {tracked})").alias("counts"))
    names = together.columns[:-1]
    return together.select(*names, F.explode(F.expr(f"approx_top_k_estimate(counts, {k})")).alias("top")).select(*names, "top.item", F.col("top.count").alias("n"))


@query("""WITH c AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM events GROUP BY date_trunc('week', ts), event_type, hour(ts))
SELECT week, CAST(row_number() OVER (PARTITION BY week ORDER BY n DESC) AS INTEGER) AS rank, n FROM c QUALIFY rank <= 10""")
def p23_stored_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each week's ten most frequent pairs of kind and hour, from sketches stored by day; there are at most 120 pairs, so counts are exact. Pairs of equal counts may take each other's place, so they aren't given."""
    path = scratch(spark, "sketches")
    store_counts(load(spark, sf_dir, "events").select("ts", "event_type"), path, 1000)
    top = most_frequent(spark.read.parquet(path), [F.to_date(F.date_trunc("week", "day")).alias("week")], 10, 1000)
    return top.select("week", F.row_number().over(Window.partitionBy("week").orderBy(F.desc("n"))).alias("rank"), "n")
