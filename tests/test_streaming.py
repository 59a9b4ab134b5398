"""State over several runs, and late rows."""

import datetime as dt

from sparkloom.streaming.replay import play, slices, tumbling

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def frame(spark, minutes):
    return spark.createDataFrame([(i, at(m), 1, "view", 1.0) for i, m in enumerate(minutes)], SCHEMA)


def hours(df):
    return {(r.started - dt.datetime(2024, 1, 1)).seconds // 3600: r.n for r in df.filter("event_type is not null").collect()}


def test_windows_stay_open_over_runs_and_late_rows_are_left_out(spark):
    # 58 comes 5 minutes late and counts; 30 and 62 come when the watermark (190 - 10) has closed their windows
    parts = [frame(spark, [1, 30, 63]), frame(spark, [58, 64, 190]), frame(spark, [30, 62, 185])]
    assert hours(play(parts, tumbling)) == {0: 3, 1: 2, 3: 2}


def test_one_part_and_no_rows(spark):
    assert hours(play([frame(spark, [1, 2, 3])], tumbling)) == {0: 3}
    assert hours(play([frame(spark, [1]).limit(0)], tumbling)) == {}


def test_slices_hold_each_row_once(spark):
    rows = frame(spark, range(100)).unionByName(spark.createDataFrame([(200, None, 1, "view", 1.0)], SCHEMA))
    parts = [{r.event_id if r.ts else -1 for r in p.collect()} for p in slices(rows)]
    assert len(parts) == 3 and sum(map(len, parts)) == 101 and set.union(*parts) == {*range(100), -1}
    assert -1 in parts[0] and max(parts[0]) < min(parts[1])
    assert sum(p.count() for p in slices(rows.limit(0))) == 0
