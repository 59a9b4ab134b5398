"""Work that outgrows its rows: pairs in tiles, brackets of few groups, ranges of bounded size, the sketches' bounds."""

import re

import pytest
from pyspark.sql import functions as F
from test_operators import plan_of

from sparkloom.operators import aggregates, joins, ordered
from sparkloom.operators.intervals import interval_join
from sparkloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(joins, "TILE", 100, raising=False)
    monkeypatch.setattr(joins, "TASK", 400, raising=False)


def largest_task(found) -> int:
    return found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_f5_pairs_of_one_cell_are_spread(spark, small_tiles):
    left, right = spark.range(90).select(F.col("id").alias("a"), F.lit(5.0).alias("x")), spark.range(70).select(F.col("id").alias("b"), F.lit(5.5).alias("y"))
    found = joins.range_join(left, right, "x", "y", 1, 1)
    assert sorted((r.a, r.b) for r in found.collect()) == [(a, b) for a in range(90) for b in range(70)]
    assert largest_task(found) < 90 * 70 / 4


def test_f7_full_join_of_crowded_keys(spark, small_tiles):
    lefts = [(1, a) for a in range(60)] + [(2, 60), (None, 61), (3, 62)] + [(5, 100 + a) for a in range(300)]
    rights = [(1, b) for b in range(50)] + [(2, 50), (None, 51), (4, 52), (5, 53)]
    left, right = spark.createDataFrame(lefts, "k long, a long"), spark.createDataFrame(rights, "k long, b long")
    found = joins.full_pair_join(left, right, ["k"])
    expected = [(k, a, b) for k, a in lefts for j, b in rights if k is not None and k == j] + [(None, 61, None), (3, 62, None), (None, None, 51), (4, None, 52)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert largest_task(found) < 60 * 50 / 2


def test_f3_overlaps_of_one_cell_are_spread(spark, small_tiles):
    left = spark.range(80).select(F.col("id").alias("a"), F.lit(0.0).alias("s"), F.lit(9.0).alias("e"))
    right = spark.range(60).select(F.col("id").alias("b"), (F.col("id") % 3 * 0.5).alias("f"), (F.col("id") % 3 + 2.0).alias("t"))
    found = interval_join(left, right, ("s", "e"), ("f", "t"))
    assert sorted((r.a, r.b) for r in found.collect()) == [(a, b) for a in range(80) for b in range(60)]
    assert largest_task(found) < 80 * 60 / 4


def test_f11_keyed_intervals_have_few_levels(spark):
    left = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"), (F.col("id") * 7 % 50 * 1.0).alias("s")).withColumn("e", F.col("s") + F.pow(F.lit(2.0), F.col("a") % 20))
    right = left.select("k", F.col("a").alias("b"), F.col("s").alias("f"), (F.col("s") + F.col("b") % 2).alias("t"))
    found = interval_join(left, right, ("s", "e"), ("f", "t"), ["k"])
    rows, others = left.collect(), right.collect()
    assert sorted((r.a, r.b) for r in found.collect()) == sorted((r.a, o.b) for r in rows for o in others if r.k == o.k and r.s <= o.t and o.f <= r.e)
    levels = re.findall(r"filter\(\[([0-9,]+)\]", found._jdf.queryExecution().optimizedPlan().toString())
    assert levels and max(len(x.split(",")) for x in levels) <= 6


def test_f6_rows_of_few_groups_are_not_sorted(spark):
    plan = plan_of(registry.QUERIES["p24_quantiles"](spark, SF))
    assert "SortMergeJoin" not in plan


def test_f6_many_groups_meet_their_brackets_by_key(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "FEW_GROUPS", 2)
    df = spark.createDataFrame([(k, float(v)) for k in range(5) for v in range(11)], "k long, v double")
    assert {(r.k, r.q) for r in aggregates.exact_quantiles(df, ["k"], {"q": ("v", 0.5)}).collect()} == {(k, 5.0) for k in range(5)}


def test_f10_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 50, raising=False)
    rows = ordered.ranged(spark.range(2000), [F.asc("id")], "part", "place")
    sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 200
    assert [r.row for r in ordered.number_rows(spark.range(2000), [F.desc("id")]).orderBy("row").collect()] == list(range(1, 2001))


def test_f4_count_min_sketches_are_held_to_their_bound(spark):
    assert "counts_near" in registry.QUERIES["p23_sketch_bounds"](spark, SF).columns
    rows = spark.createDataFrame([(u,) for u in range(1, 2000) for _ in range(1 + (u == 77) * 500)] + [(None,)], "user_id long")
    sketch = rows.agg(F.count_min_sketch("user_id", F.lit(aggregates.COUNTS_SHARE), F.lit(0.99), F.lit(7)).alias("s"), F.count("user_id").alias("n"))
    near = lambda n, user, count: aggregates.counts_near(F.col("s"), F.col("n") + n, F.struct(F.lit(user).cast("long").alias("user_id"), F.lit(count).cast("long").alias("rows")))
    assert tuple(sketch.select(near(0, 77, 501), near(1, 77, 501), near(0, 77, 600), near(0, 78, 501)).first()) == (True, False, False, False)
