"""Structured Streaming over the event table: watermarked windows, sessions, deduplication, a stream-stream join and custom state.

`play` feeds a table to a stream slice by slice in the order of time, as a feed of arriving files would. After each slice the query runs over what is
new and stops; the next run goes on from its checkpoint, so state, watermark and output cross runs. A row far in the future
comes last, when all data has been read: its watermark closes the windows that are still open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.registry import query
from ..session import load, scratch

LATE = "10 minutes"
END = "2100-01-01 00:00:00"
SLICES = 3


def slices(events: DataFrame, n: int = SLICES, ts: str = "ts") -> list[DataFrame]:
    """The rows in n slices of time of about equal size, rows without a time in the first one."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = sorted(set(events.select(at.cast("double").alias("at")).approxQuantile("at", [k / n for k in range(1, n)], 0.01)))
    lows, highs = [None, *cuts], [*cuts, None]
    inside = lambda low, high: (F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high)
    return [events.filter(F.coalesce(inside(low, high), F.lit(low is None))) for low, high in zip(lows, highs)]


def play(parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], mode: str = "append", ts: str = "ts", conf: dict[str, str] | None = None, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """What the query `make` of a stream writes when the parts arrive one after the other, and after them the end row (all but its time null).

    The stream has the columns of the parts, times as timestamps. Each part is one micro-batch or more in a run of its own. With a sink, each batch goes to it with its id, and nothing is returned.
    """
    spark, schema = parts[0].sparkSession, parts[0].schema
    feed, out, progress = scratch(spark, "feed"), scratch(spark, "stream"), scratch(spark, "progress")
    end = spark.range(1).select(*[F.lit(END if f.name == ts else None).cast(f.dataType).alias(f.name) for f in schema])
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for key, value in (conf or {}).items():
            spark.conf.set(key, value)
        for part in (*parts, end):
            part.write.mode("append").parquet(feed)
            stream = make(spark.readStream.schema(schema).parquet(feed).withColumn(ts, F.col(ts).cast("timestamp")))
            writer = stream.writeStream.outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True)
            (writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", out)).start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    return None if sink else spark.read.schema(stream.schema).parquet(out)


def play_events(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    return play(slices(load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")), make, **options)


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def tumbling(events: DataFrame) -> DataFrame:
    counts = events.withWatermark("ts", LATE).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("started"), "event_type", "n")


@query("SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n FROM events GROUP BY ALL")
def p71_stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntz(play_events(spark, sf_dir, tumbling).filter("event_type is not null"), "started")


@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(CAST(15 * k AS INTEGER)) AS started, count(*) AS n FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL""")
def p71_stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    def sliding(events: DataFrame) -> DataFrame:
        counts = events.withWatermark("ts", LATE).groupBy(F.window("ts", "1 hour", "15 minutes")).agg(F.count("event_id").alias("n"))
        return counts.select(F.col("window.start").alias("started"), "n")

    return ntz(play_events(spark, sf_dir, sliding).filter("n > 0"), "started")


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 2 HOUR AS closed, count(*) AS n FROM b GROUP BY user_id, s""")
def p71_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows: a row opens or prolongs its user's window by two hours; Spark merges the windows that meet."""

    def found(events: DataFrame) -> DataFrame:
        counts = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", "2 hours"), "user_id").agg(F.count("*").alias("n"))
        return counts.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("closed"), "n")

    return ntz(play_events(spark, sf_dir, found).filter("user_id is not null"), "started", "closed")


@query("SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events")
def p72_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def days(events: DataFrame) -> DataFrame:
        return events.withColumn("day", F.date_trunc("day", "ts")).withWatermark("day", "2 days").dropDuplicates(["user_id", "event_type", "day"]).select("user_id", "event_type", "day")

    return ntz(play_events(spark, sf_dir, days).filter("user_id is not null"), "day")


@query("SELECT event_id, user_id FROM events")
def p72_stream_dedup_within_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event arrives twice, the second time five minutes of event time later; ids are kept no longer than the watermark needs."""

    def once(events: DataFrame) -> DataFrame:
        twice = events.withColumn("ts", F.explode(F.array(F.col("ts"), F.col("ts") + F.expr("interval 5 minutes"))))
        return twice.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id")

    return play_events(spark, sf_dir, once).filter("event_id is not null")


@query("""SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id
AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR""")
def p72_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time bounds on both sides let the state of either expire."""

    def pairs(events: DataFrame) -> DataFrame:
        views = events.filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("v_user"), F.col("ts").alias("v_ts")).withWatermark("v_ts", LATE)
        bought = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("p_user"), F.col("ts").alias("p_ts")).withWatermark("p_ts", LATE)
        near = (F.col("v_user") == F.col("p_user")) & (F.col("p_ts") >= F.col("v_ts")) & (F.col("p_ts") <= F.col("v_ts") + F.expr("interval 1 hour"))
        return views.join(bought, near).select("view_id", "purchase_id")

    return play_events(spark, sf_dir, pairs)


@query("SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY user_id")
def p73_custom_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running count and last event for each user, kept in state over all runs; the last state written is the result."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, -1)
        for pdf in batches:
            n, last = n + len(pdf), max(last, int(pdf["event_id"].max()))
        state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_event": [last]})

    def states(events: DataFrame) -> DataFrame:
        rows = events.filter("event_id is not null").select("user_id", "event_id")
        return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, last_event long", "n long, last long", "append", GroupStateTimeout.NoTimeout)

    return play_events(spark, sf_dir, states).groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("last_event", "n").alias("last_event"))


class Totals(StatefulProcessor):
    """The running number of rows and sum of a user's values, in one value of state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", StructType([StructField("n", LongType()), StructField("cents", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, cents = self.total.get() if self.total.exists() else (0, 0)
        for pdf in rows:
            n, cents = n + len(pdf), cents + int(pdf["cents"].sum())
        self.total.update((n, cents))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "cents": [cents]})

    def close(self) -> None:
        pass


@query("SELECT user_id, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY user_id")
def p73_transform_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same kind of state by a stateful processor; it needs the RocksDB state store."""

    def totals(events: DataFrame) -> DataFrame:
        rows = events.filter("event_id is not null").select("user_id", F.floor(F.col("value") * 100).alias("cents"))
        return rows.groupBy("user_id").transformWithStateInPandas(Totals(), "user_id long, n long, cents long", "append", "None")

    store = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    return play_events(spark, sf_dir, totals, conf=store).groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("cents", "n").alias("cents"))
