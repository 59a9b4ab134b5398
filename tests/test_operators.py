"""Nulls, ties, repeated rows and empty inputs of the library's own operators, approximate results within their bounds, and plans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkloom.operators.aggregates import exact_quantile
from sparkloom.operators.joins import asof_join, range_join
from sparkloom.operators.scans import top_per_group
from sparkloom.operators.windows import sessions
from sparkloom.plans import registry
from sparkloom.session import load, shared_dir
from sparkloom.sources.files import round_trip

registry.load_all()
SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_entry_and_registries(spark):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_range_join_meets_every_pair(spark):
    left = spark.createDataFrame([(1, 0.0), (2, -5.0), (3, None), (4, 9.99), (4, 9.99)], "a int, x double")
    right = spark.createDataFrame([(1, -1.0), (2, 2.0), (3, None), (4, -8.0), (5, 12.0)], "b int, y double")
    found = sorted((r.a, r.b) for r in range_join(left, right, "x", "y", 1, 3).collect())
    expected = sorted((a, b) for a, x in [(1, 0.0), (2, -5.0), (4, 9.99), (4, 9.99)] for b, y in [(1, -1.0), (2, 2.0), (4, -8.0), (5, 12.0)] if x - 1 <= y <= x + 3)
    assert found == expected
    assert range_join(left.limit(0), right, "x", "y", 1, 3).count() == 0
    assert "NestedLoop" not in plan_of(range_join(left, right, "x", "y", 1, 3))
    assert range_join(left.withColumn("cell", F.lit(8)), right, "x", "y", 1, 3).select("cell").distinct().collect()[0].cell == 8


def test_asof_join(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 9), (5, "a", None)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 51), ("a", 7, 70), ("b", 10, 1)], "k string, t int, v int")
    for chunk in (None, lambda c: F.floor(c / 2), lambda c: c):
        found = {r.id: r.asof_v for r in asof_join(left, right, ["k"], "t", ["v"], chunk).collect()}
        assert found == {1: 51, 2: None, 3: None, 4: None, 5: None}
    clashing = left.withColumns({c: F.lit(9) for c in ("_side", "key", "at", "chunk", "left", "found")})
    rows = asof_join(clashing, right, ["k"], "t", ["v"]).collect()
    assert {r["_side"] for r in rows} == {9} and rows[0].asDict().keys() == {*clashing.columns, "asof_v"}
    assert asof_join(left.limit(0), right, ["k"], "t", ["v"]).count() == 0
    assert {r.asof_v for r in asof_join(left, right.limit(0), ["k"], "t", ["v"]).collect()} == {None}


def test_asof_join_over_days(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    left = spark.createDataFrame([(i, "u", at(7 * i)) for i in range(40)], "id int, k string, t timestamp_ntz")
    right = spark.createDataFrame([("u", at(h), h) for h in (3, 4, 90, 91, 200)], "k string, t timestamp_ntz, v int")
    found = {r.id: r.asof_v for r in asof_join(left, right, ["k"], "t", ["v"]).collect()}
    assert found == {i: max((h for h in (3, 4, 90, 91, 200) if h <= 7 * i), default=None) for i in range(40)}


def test_joins_with_null_keys(spark):
    left = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "a int, k string")
    right = spark.createDataFrame([("x", 1), (None, 2)], "k string, b int")
    kinds = {how: sorted((r.a or 0) for r in left.join(right, "k", how).select("a" if how not in ("right",) else F.col("a")).collect()) for how in ("inner", "left", "left_semi", "left_anti", "full")}
    assert kinds == {"inner": [1], "left": [1, 2, 3], "left_semi": [1], "left_anti": [2, 3], "full": [0, 1, 2, 3]}
    some = {"l": left, "r": right}
    assert spark.sql("SELECT a FROM {l} WHERE k NOT IN (SELECT k FROM {r})", **some).collect() == []
    assert [r.a for r in spark.sql("SELECT a FROM {l} WHERE k NOT IN (SELECT k FROM {r} WHERE k IS NOT NULL)", **some).collect()] == [3]
    assert sorted(r.a for r in spark.sql("SELECT a FROM {l} l WHERE NOT EXISTS (SELECT 1 FROM {r} r WHERE l.k = r.k)", **some).collect()) == [2, 3]


def test_sessions_and_top(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    events = spark.createDataFrame([("u", at(m)) for m in (0, 5, 5, 16, 40)] + [(None, at(1)), (None, at(2))], "k string, ts timestamp_ntz")
    found = sorted((r.k or "", r.n) for r in sessions(events, "k", "ts", 600).collect())
    assert found == [("", 2), ("u", 1), ("u", 1), ("u", 3)]
    assert sessions(events.limit(0), "k", "ts", 600).count() == 0
    close = spark.createDataFrame([("u", at(0)), ("u", at(10) + dt.timedelta(milliseconds=500)), ("v", at(0)), ("v", at(10)), ("w", None)], "k string, ts timestamp_ntz").withColumns({"_new": F.lit(1), "chunk": F.lit(1)})
    assert sorted((r.k, r.n) for r in sessions(close, "k", "ts", 600).collect()) == [("u", 1), ("u", 1), ("v", 2)]
    top = top_per_group(events, ["k"], [F.desc("ts")], 2)
    assert sorted(r.rank for r in top.collect()) == [1, 1, 2, 2]
    assert "WindowGroupLimit" in plan_of(top)


def test_sessions_go_on_over_days(spark):
    rng = random.Random(4)
    times = sorted(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(5 * 86400)) for _ in range(400)) + [dt.datetime(2024, 1, 1, 23, 59), dt.datetime(2024, 1, 2, 0, 1)]
    times.sort()
    for gap in (60, 900, 7200, 90_000):
        expected, start = [], 0
        for i in range(1, len(times) + 1):
            if i == len(times) or (times[i] - times[i - 1]).total_seconds() > gap:
                expected.append((times[start], times[i - 1], i - start))
                start = i
        found = sorted((r.started, r.ended, r.n) for r in sessions(spark.createDataFrame([("u", t) for t in times], "k string, ts timestamp_ntz"), "k", "ts", gap).collect())
        assert found == expected


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.999, 1.0])
def test_exact_quantile(spark, q):
    rows = [("a", float(i % 97)) for i in range(5000)] + [("b", 1.0), ("b", 2.0), ("c", None), ("d", 7.0), ("d", None), ("e", -3.5)] + [("f", 2.0)] * 50 + [(None, 4.0), (None, 6.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    expected = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", q).alias("q")).collect()}
    found = {r.k: r.quantile for r in exact_quantile(df, ["k"], "v", q).collect()}
    assert found.keys() == expected.keys() and all(found[k] == pytest.approx(expected[k]) if expected[k] is not None else found[k] is None for k in found)
    assert exact_quantile(df.limit(0), ["k"], "v", q).collect() == []


def test_approximations_keep_their_bounds(spark):
    sf = "/root/testdata/sf0.01"
    exact = load(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("u"), F.count_distinct("event_id").alias("e"), F.percentile("value", [0.5, 0.99]).alias("q"))
    found = {r.event_type: r for r in registry.QUERIES["p23_sketches"](spark, sf).collect()}
    for r in exact.collect():
        assert abs(found[r.event_type].users - r.u) <= 0.06 * r.u and abs(found[r.event_type].events - r.e) <= 0.04 * r.e
        assert all(abs(a - b) <= 0.02 * abs(b) + 0.5 for a, b in zip(found[r.event_type].quantiles, r.q))


def test_samples(spark):
    n = load(spark, SF, "lineitem").count()
    assert abs(registry.QUERIES["p41_sample"](spark, SF).count() - n / 10) < n / 25
    rates = {"A": 0.5, "N": 0.1, "R": 0.2}
    sizes = {r.l_returnflag: r["count"] for r in load(spark, SF, "lineitem").groupBy("l_returnflag").count().collect()}
    for r in registry.QUERIES["p41_stratified_sample"](spark, SF).groupBy("l_returnflag").count().collect():
        assert abs(r["count"] - rates[r.l_returnflag] * sizes[r.l_returnflag]) < 0.08 * sizes[r.l_returnflag]


@pytest.mark.parametrize("fmt", ["csv", "json", "orc", "parquet"])
def test_formats_keep_nulls_and_odd_text(spark, fmt):
    df = spark.createDataFrame([(1, "a,b\"c", None), (2, None, 2.5), (None, "ä  x", -0.0)], "i int, s string, d double")
    assert sorted(map(str, round_trip(df, fmt).collect())) == sorted(map(str, df.collect()))


def test_plans(spark):
    filtered = plan_of(registry.QUERIES["p02_filter"](spark, SF))
    assert "GreaterThan(l_quantity,45.0)" in filtered and "l_extendedprice" not in filtered.split("ReadSchema")[1].split("\n")[0]
    star = plan_of(registry.QUERIES["p10_star_join"](spark, SF))
    assert "EqualTo(r_regionkey,1)" in star and "GreaterThanOrEqual(o_orderdate" in star
    partitioned = plan_of(registry.QUERIES["p03_partitioned_sink"](spark, SF))
    assert "PartitionFilters: [isnotnull(o_orderstatus" in partitioned
    bucketed = plan_of(registry.QUERIES["p03_bucketed_join"](spark, SF))
    assert bucketed.count("hashpartitioning(o_orderkey") + bucketed.count("hashpartitioning(l_orderkey") == 0
    for name in ("p20_pricing_summary", "p22_cube", "p60_strings", "p65_json", "p70_sliding"):
        assert "Python" not in plan_of(registry.QUERIES[name](spark, SF))


def test_registry_refuses_a_second_name():
    with pytest.raises(ValueError):
        registry.query()(registry.QUERIES["p21_distinct"])


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

    session = type("Session", (), {"sparkContext": Context(), "conf": Context()})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)
