"""Running totals, row numbers, two inequalities and interval joins: brute force on odd rows, and plans."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.aggregates import exact_quantiles
from sparkloom.operators.intervals import interval_join
from sparkloom.operators.joins import asof_join
from sparkloom.operators.ordered import counts_where, number_rows, running
from sparkloom.operators.windows import sessions
from sparkloom.plans import registry
from sparkloom.session import load

registry.load_all()
SF = "/root/testdata/sf0.001"


def executed(df) -> str:
    """The plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_rows_are_numbered_over_all_ranges(spark):
    rows = [(k, None if k % 50 == 0 else k % 7, "x") for k in range(1000)]
    df = spark.createDataFrame(rows, "part int, place int, row_ string").repartition(5)
    found = sorted(number_rows(df, [F.desc_nulls_last("place"), F.asc("part")], "nr").collect(), key=lambda r: r.nr)
    assert [r.nr for r in found] == list(range(1, 1001))
    assert [r.part for r in found] == [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    assert number_rows(df.limit(0), [F.asc("part")]).collect() == []


@pytest.mark.parametrize("kinds", [0, 1, 3, 400])
def test_running_totals(spark, kinds):
    """No key, one, a few hot ones and many small ones, null keys and null values among them."""
    rng = random.Random(kinds)
    rows = [(k, None if kinds and rng.random() < 0.2 else f"k{rng.randrange(kinds or 1)}", None if rng.random() < 0.3 else rng.randrange(-50, 50)) for k in range(2000)]
    df = spark.createDataFrame(rows, "at int, key string, v int").repartition(6)
    found = running(df, ["key"] if kinds else [], [F.asc("at")], {"total": ("sum", "v"), "n": ("count", "v"), "low": ("min", "v"), "high": ("max", "v")})
    seen: dict = {}
    expected = {}
    for at, key, v in rows:
        past = seen.setdefault(key if kinds else None, [])
        past += [v] if v is not None else []
        expected[at] = (sum(past), len(past), min(past), max(past)) if past else (None, 0, None, None)
    assert {r["at"]: (r.total, r.n, r.low, r.high) for r in found.collect()} == expected
    assert running(df.limit(0), ["key"], [F.asc("at")], {"n": ("count", "v")}).collect() == []


def test_running_totals_leave_no_hot_task(spark):
    """All rows have one key; no window but those over one row a range is made on a single partition."""
    df = spark.range(40_000).select(F.lit(1).alias("key"), F.xxhash64("id").alias("at"))
    found = running(df, ["key"], [F.asc("at")], {"n": ("count", "at")})
    assert found.agg(F.count_distinct("n"), F.max("n")).first()[:] == (40_000, 40_000)
    logical = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in logical.splitlines() if "Window" in line]
    assert windows and not any("windowspecdefinition(key" in w for w in windows)  # never by the key alone


@pytest.mark.parametrize(("op", "op2"), [("<", "<"), ("<=", ">"), (">", ">="), (">=", "<=")])
def test_two_inequalities(spark, op, op2):
    rng = random.Random(5)
    left = [(k, rng.choice([None, *range(12)]), rng.choice([None, *range(9)])) for k in range(60)]
    right = [(rng.choice([None, *range(12)]), rng.choice([None, *range(9)])) for _ in range(300)]
    holds = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    expected = {k: sum(x is not None and y is not None and a is not None and b is not None and holds[op](x, a) and holds[op2](y, b) for a, b in right) for k, x, y in left}
    lefts, rights = spark.createDataFrame(left, "row int, x int, level int"), spark.createDataFrame(right, "a int, b int")
    found = counts_where(lefts, rights, ("x", op, "a"), ("level", op2, "b"))
    assert {r.row: r.n for r in found.collect()} == expected
    if op == op2 == "<":
        assert {r.n for r in counts_where(lefts, rights.limit(0), ("x", op, "a"), ("level", op2, "b")).collect()} == {0}
        assert counts_where(lefts.limit(0), rights, ("x", op, "a"), ("level", op2, "b")).collect() == []
        assert "NestedLoop" not in executed(found) and "Cartesian" not in executed(found)


def test_intervals_of_all_lengths(spark):
    rng = random.Random(2)
    inf = math.inf

    def some(n):
        rows = [(k, s := rng.uniform(-100, 100), s + rng.choice([0, 0.01, 1, 3, 64, 1000])) for k in range(n)]
        return [*rows, (n, None, 1.0), (n + 1, 5.0, None), (n + 2, 2.0, 1.0), (n + 3, -inf, 0.0), (n + 4, 0.0, inf), (n + 5, 8.0, 8.0), (n + 6, 8.0, 8.0), (n + 7, math.nan, 1.0), (n + 8, 1.0, math.nan)]

    ours, theirs = some(80), some(90)
    left, right = spark.createDataFrame(ours, "cell int, a double, b double"), spark.createDataFrame(theirs, "level int, c double, d double")
    fine = lambda *xs: all(x is not None and not math.isnan(x) for x in xs)
    expected = sorted((i, j) for i, a, b in ours for j, c, d in theirs if fine(a, b, c, d) and a <= b and c <= d and a <= d and c <= b)
    found = interval_join(left, right, ("a", "b"), ("c", "d"))
    assert sorted((r.cell, r.level) for r in found.collect()) == expected
    assert sorted((r.cell, r.level) for r in interval_join(left, right, ("a", "b"), ("c", "d"), unit=0.001).collect()) == expected
    assert found.columns == ["cell", "a", "b", "level", "c", "d"]
    assert "NestedLoop" not in executed(found) and "Cartesian" not in executed(found)
    assert interval_join(left.limit(0), right, ("a", "b"), ("c", "d")).collect() == []


def test_intervals_by_key_and_time(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    left = spark.createDataFrame([(1, day(0), day(0, 1)), (1, day(5), day(400)), (2, day(0), day(9)), (None, day(0), day(9))], "k int, s timestamp_ntz, e timestamp_ntz")
    right = spark.createDataFrame([(1, "a", day(0, 1), day(0, 2)), (1, "b", day(1), day(4)), (1, "c", day(399), day(399)), (3, "d", day(0), day(9)), (None, "e", day(0), day(9))], "k int, n string, f timestamp_ntz, t timestamp_ntz")
    assert sorted((r.s, r.n) for r in interval_join(left, right, ("s", "e"), ("f", "t"), ["k"]).collect()) == [(day(0), "a"), (day(5), "c")]


def test_one_long_interval_costs_the_short_ones_a_row(spark):
    """Each short row is emitted once for each level of the other side, however long that is."""
    short = spark.range(5000).select("id", F.col("id").cast("double").alias("a"), (F.col("id") + 0.5).alias("b"))
    long = spark.createDataFrame([(1, 0.0, 1e9)], "nr int, c double, d double")
    found = interval_join(short, long, ("a", "b"), ("c", "d"))
    assert found.count() == 5000


def test_each_input_of_an_asof_join_is_read_once(spark):
    plan = executed(registry.QUERIES["p15_asof_join"](spark, SF))
    assert plan.count("FileScan") - plan.count("ReusedExchange") * 2 == 2 or plan.count("FileScan") == 2
    assert "ReusedExchange" in plan


def test_sessions_read_their_input_once(spark):
    plan = executed(registry.QUERIES["p70_sessions"](spark, SF))
    assert plan.count("FileScan") == 1 and "ReusedExchange" not in plan and plan.count("Sort [") <= 4


def test_session_columns_do_not_clash(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, at), (1, at)], "n int, ts timestamp_ntz")
    found = sessions(df, "n", "ts", 5)
    assert found.columns == ["n", "started", "ended", "n_"] and found.first()["n_"] == 2
    assert sessions(df.select(F.col("n").alias("Ended"), "ts"), "Ended", "ts", 5).columns == ["Ended", "started", "ended_", "n"]


def test_asof_join_carries_over_empty_chunks_and_null_keys(spark):
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    left = spark.createDataFrame([(1, at(9.5)), (1, at(0)), (2, at(3)), (None, at(1)), (1, None)], "k int, ts timestamp_ntz")
    right = spark.createDataFrame([(1, at(1), "x"), (1, at(2), "y"), (2, at(3.5), "z"), (None, at(0), "q")], "k int, ts timestamp_ntz, v string")
    found = sorted(((r.k, r.ts, r.asof_v) for r in asof_join(left, right, ["k"], "ts", ["v"]).collect()), key=repr)
    assert found == sorted([(1, at(9.5), "y"), (1, at(0), None), (2, at(3), None), (None, at(1), None), (1, None, None)], key=repr)


def test_quantiles_in_one_pass_with_names_that_could_clash(spark):
    rng = random.Random(9)
    rows = [(k % 3 if k % 11 else None, rng.gauss(0, 1) if k % 5 else None, float(rng.randrange(6))) for k in range(3000)] + [(7, None, None)]
    df = spark.createDataFrame(rows, "k0 int, v double, n double")
    found = exact_quantiles(df, ["k0"], {"zone": ("v", 0.3), "q": ("n", 0.5), "seen": ("v", 1.0)})

    def plain(values, q):
        values = sorted(values)
        if not values:
            return None
        at = q * (len(values) - 1)
        low, high = values[math.floor(at)], values[math.ceil(at)]
        return low + (high - low) * (at - math.floor(at))

    got = {r.k0: (r.zone, r.q, r.seen) for r in found.collect()}
    for key in {r[0] for r in rows}:
        v, n = ([r[i] for r in rows if r[0] == key and r[i] is not None] for i in (1, 2))
        assert got[key] == pytest.approx((plain(v, 0.3), plain(n, 0.5), plain(v, 1.0))) if v else got[key] == (None, None, None)
    assert executed(registry.QUERIES["p24_quantiles"](spark, SF)).count("FileScan") == 2


def test_bucketed_join_leaves_no_tables(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert registry.QUERIES["p03_bucketed_join"](spark, SF).count() == 5
    assert {t.name for t in spark.catalog.listTables()} == before
    assert load(spark, SF, "orders").count() > 0
