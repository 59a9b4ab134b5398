"""Upserts, exact-size samples, batch sinks under failure, outer joins, timers and expiry of state."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_streaming import at, frame

from sparkloom.functions.python import gap_filler
from sparkloom.operators.scans import weighted_sample
from sparkloom.session import scratch
from sparkloom.sources.upsert import upsert
from sparkloom.streaming.replay import play
from sparkloom.streaming.sinks import NO_IDLE, ROCKSDB, batch_folder, merge_spans, recent, timed_sessions, views_with_purchases

ROWS = "id long, part string, v long"


@pytest.fixture()
def table(spark):
    path = scratch(spark, "table")
    rows = [(1, "a", 1), (2, "a", 2), (3, "b", 3), (4, None, 4), (None, "c", 5)]
    spark.createDataFrame(rows, ROWS).write.partitionBy("part").parquet(path)
    return path


def content(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("id", "part", "v").collect()), key=repr)


def files(spark, path):
    return {f for f in spark.read.parquet(path).inputFiles()}


def test_upsert_touches_only_its_partitions_and_bears_a_second_run(spark, table):
    before = files(spark, table)
    changes = spark.createDataFrame([(1, "a", 10), (9, "a", 90), (4, None, 40), (8, "new", 80)], ROWS)
    expected = sorted([(1, "a", 10), (2, "a", 2), (9, "a", 90), (3, "b", 3), (4, None, 40), (8, "new", 80), (None, "c", 5)], key=repr)
    for _ in range(2):
        upsert(table, changes, ["id"], "part")
        assert content(spark, table) == expected
    after = files(spark, table)
    assert {f for f in before if "part=b" in f or "part=c" in f} <= after
    assert not {f for f in before if "part=a" in f} & after


def test_upsert_of_null_keys_repeated_keys_and_nothing(spark, table):
    changes = spark.createDataFrame([(None, "c", 50), (3, "b", 30), (3, "b", 31), (3, "b", 29)], ROWS)
    upsert(table, changes, ["id"], "part", [F.desc("v")])
    assert {(None, "c", 50), (3, "b", 31)} <= set(content(spark, table)) and len(content(spark, table)) == 5
    before = files(spark, table)
    upsert(table, changes.limit(0), ["id"], "part")
    assert files(spark, table) == before


def test_upsert_refuses_a_change_that_moves_a_row(spark, table):
    before = content(spark, table)
    with pytest.raises(ValueError, match="another part"):
        upsert(table, spark.createDataFrame([(1, "b", 10)], ROWS), ["id"], "part")
    assert content(spark, table) == before
    upsert(table, spark.createDataFrame([(1, "b", 10)], ROWS), ["id", "part"], "part")  # as part of the key, it's another row
    assert len(content(spark, table)) == len(before) + 1


def test_weighted_sample_has_exact_sizes_and_bad_weights_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(s, i, w) for s, n in (("x", 50), ("y", 3), (None, 7)) for i, w in enumerate([1.0] * n)]
    rows += [("x", 100 + i, w) for i, w in enumerate([0.0, -1.0, None, nan, inf])]
    df = spark.createDataFrame(rows, "rank_of string, id long, w double")
    drawn = weighted_sample(df, ["rank_of"], ["id"], "w", 5)
    found = drawn.collect()
    sizes = {s: sorted(r["rank"] for r in found if r.rank_of == s) for s in ("x", "y", None)}
    assert sizes == {"x": [1, 2, 3, 4, 5], "y": [1, 2, 3], None: [1, 2, 3, 4, 5]}
    assert all(r.id < 100 for r in found)
    few = {(r.rank_of, r.id) for r in weighted_sample(df.repartition(7), ["rank_of"], ["id"], "w", 2).collect()}
    assert few == {(r.rank_of, r.id) for r in found if r["rank"] <= 2}
    assert weighted_sample(df.limit(0), ["rank_of"], ["id"], "w", 5).count() == 0


def test_weighted_sample_follows_the_weights_and_is_cut_before_the_shuffle(spark):
    df = spark.range(4000).select("id", (F.col("id") % 2).alias("s"), F.when(F.col("id") % 4 == 0, 9.0).otherwise(1.0).alias("w"))
    drawn = weighted_sample(df, ["s"], ["id"], "w", 100)
    heavy = drawn.filter("w > 1").count()  # nine in ten are expected at first in stratum 0, a standard deviation is about 3; stratum 1 has none
    assert 76 <= heavy <= 98 and drawn.count() == 200
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_a_batch_that_fails_after_its_write_is_replaced_when_it_comes_again(spark):
    out, feed, progress = (scratch(spark, n) for n in ("out", "feed", "progress"))
    write, tries = batch_folder(out), []

    def fails_once(batch, batch_id):
        write(batch, batch_id)
        tries.append(batch_id)
        if len(tries) == 2:
            raise RuntimeError("lost after the write")

    def run():
        stream = spark.readStream.schema("id long").parquet(feed)
        stream.writeStream.foreachBatch(fails_once).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()

    spark.range(5).write.mode("append").parquet(feed)
    run()
    spark.range(5, 12).write.mode("append").parquet(feed)
    with pytest.raises(Exception, match="lost after the write"):
        run()
    run()
    assert tries == [0, 1, 1]
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(12))


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def test_outer_join_gives_unmatched_views_once_and_late_purchases_none(spark):
    parts = [
        spark.createDataFrame([(1, at(0), 1, "view", 0.0), (2, at(5), 2, "view", 0.0), (3, at(6), None, "view", 0.0)], EVENTS),
        spark.createDataFrame([(4, at(60), 1, "purchase", 0.0), (5, at(66), 2, "purchase", 0.0)], EVENTS),
        spark.createDataFrame([(6, at(300), 1, "view", 0.0), (7, at(300), 2, "purchase", 0.0)], EVENTS),
        spark.createDataFrame([(8, at(50), 2, "purchase", 0.0)], EVENTS),  # too late: view 2 was given as unmatched
    ]
    found = play(parts, views_with_purchases).filter("view_id is not null").collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(1, 4), (2, None), (3, None), (6, None)], key=repr)


def test_timers_close_sessions_that_batches_bridge_in_any_order(spark):
    parts = [frame(spark, [0, 100]), frame(spark, [215, 700]), frame(spark, [695, 950, 1070])]
    found = {((r.started - dt.datetime(2024, 1, 1)).seconds // 60, (r.ended - dt.datetime(2024, 1, 1)).seconds // 60, r.n) for r in play(parts, timed_sessions, conf=ROCKSDB).filter("user_id is not null").collect()}
    assert found == {(0, 215, 3), (695, 700, 2), (950, 950, 1), (1070, 1070, 1)}  # a gap of exactly two hours ends a session


def test_a_user_costs_one_read_and_one_write_of_state(spark, monkeypatch):
    """Whatever the number of sessions that a batch opens or a timer closes."""
    from sparkloom.streaming import sinks

    hour, calls, held = 3600 * 1_000_000, [], []

    class Value:
        def get(self):
            calls.append("get")
            return held[-1] if held else None

        def update(self, value):
            calls.append("update")
            held.append(value)

        def clear(self):
            calls.append("clear")
            held.clear()

    class Handle:
        def getValueState(self, *_):
            return Value()

        def registerTimer(self, at):
            calls.append(("timer", at))

    class Now:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at

    monkeypatch.setattr(sinks, "MERGE_ROWS", 7)
    user = sinks.Sessions()
    user.init(Handle())
    assert list(user.handleInputRows((1,), iter([Row(at=3 * k * hour) for k in reversed(range(20))] + [Row(at=hour)]), None)) == []
    assert calls == ["get", "update", ("timer", 3 * 3600_000)]
    calls.clear()
    closed = list(user.handleExpiredTimer((1,), Now(30 * 3600_000), Now(2 * 3600_000)))
    assert [tuple(r) for r in closed] == [(1, 0, hour, 2), *((1, 3 * k * hour, 3 * k * hour, 1) for k in range(1, 10))]
    assert calls == ["get", "update", ("timer", 32 * 3600_000)]
    calls.clear()
    assert len(list(user.handleExpiredTimer((1,), Now(100 * 3600_000), Now(32 * 3600_000)))) == 10 and calls == ["get", "clear"]


def test_merge_spans():
    hour = 3_600_000_000
    assert merge_spans([(3 * hour, 3 * hour, 1), (0, hour, 2), (2 * hour, 2 * hour, 1), (5 * hour, 5 * hour, 1)]) == [(0, 3 * hour, 4), (5 * hour, 5 * hour, 1)]
    assert merge_spans([]) == []


def test_list_state_is_kept_over_runs_and_forgotten_after_its_time(spark):
    first, second = frame(spark, [1, 2, 3, 4]), frame(spark, [10]).withColumn("event_id", F.lit(9).cast("long"))
    held = lambda ttl: {(r.ids, r.held) for r in play([first, second], lambda e: recent(e, 3, ttl), conf=ROCKSDB | NO_IDLE).collect()}
    assert held(3_600_000) == {("1,2,3", 3), ("2,3,9", 3)}
    assert held(1) == {("1,2,3", 3), ("9", 1)}


def test_gaps_are_filled_for_each_key_and_bad_tables_are_refused(spark):
    hour = dt.timedelta(hours=1)
    rows = [("a", at(0), 1), ("a", at(180), 2), ("a", at(180), 3), ("a", None, 4), ("b", at(600), 5), (None, at(60), 6), (None, at(190), 7)]
    df = spark.createDataFrame(rows, "who string, hour timestamp_ntz, n long")
    fill = lambda d: gap_filler("who", "hour", hour)(d.asTable().partitionBy("who").orderBy("hour"))
    expected = rows + [("a", at(60), None), ("a", at(120), None), (None, at(120), None), (None, at(180), None)]
    assert sorted(map(tuple, fill(df).collect()), key=repr) == sorted(expected, key=repr)
    assert fill(df.limit(0)).collect() == []
    with pytest.raises(Exception, match="lacks"):
        gap_filler("who", "minute", hour)(df.asTable().partitionBy("who").orderBy("hour")).collect()
