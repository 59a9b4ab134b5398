"""Batch sinks that bear replays, outer joins of streams, and state that ends by event time or by age."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.registry import query
from ..session import load, scratch
from .replay import LATE, ntz, play, play_events, slices

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
NO_IDLE = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}  # in processing time Spark would run batches without rows for ever
GAP = 2 * 3600 * 1_000_000  # microseconds
MERGE_ROWS = 10_000  # of a user's rows in one batch, so many are held before they are merged


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: each batch has its own folder, named by its id, and a batch that comes again replaces it.

    Spark may run a batch again after a failure, with the same id and the same rows; what a try left behind, whole or in part, goes.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY event_type")
def p72_batch_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each batch, every batch written twice on purpose, added up from the folders afterwards."""
    path = scratch(spark, "batches")
    write = batch_folder(path)

    def twice(batch: DataFrame, batch_id: int) -> None:
        for _ in range(2):
            write(batch.filter("event_id is not null").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100)).alias("cents")), batch_id)

    play(slices(load(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")), lambda events: events, sink=twice)
    return spark.read.parquet(path).groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


def views_with_purchases(events: DataFrame) -> DataFrame:
    """Each view with the purchases of its user in the hour after it; a view without any comes once, with null, when the watermark has passed its hour."""
    end = F.col("event_id").isNull()  # the end row goes to both sides, so that both watermarks pass all rows; it has a user of its own, as null ones are filtered below the watermark
    user = F.when(end, -1).otherwise(F.col("user_id"))
    views = events.filter((F.col("event_type") == "view") | end).select(F.col("event_id").alias("view_id"), user.alias("v_user"), F.col("ts").alias("v_ts")).withWatermark("v_ts", LATE)
    bought = events.filter((F.col("event_type") == "purchase") | end).select(F.col("event_id").alias("purchase_id"), user.alias("p_user"), F.col("ts").alias("p_ts")).withWatermark("p_ts", LATE)
    near = (F.col("v_user") == F.col("p_user")) & (F.col("p_ts") >= F.col("v_ts")) & (F.col("p_ts") <= F.col("v_ts") + F.expr("interval 1 hour"))
    return views.join(bought, near, "left_outer").select("view_id", "purchase_id")


@query("""SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v LEFT JOIN events p ON v.user_id = p.user_id
AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR WHERE v.event_type = 'view'""")
def p72_stream_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play_events(spark, sf_dir, views_with_purchases).filter("view_id is not null")


class Sessions(StatefulProcessor):
    """A user's sessions, each ended by a timer of event time once GAP has passed without a row.

    State: one list of the open sessions, as start, last time and count (microseconds) one after the other, so a batch reads and writes a user's state once, however many
    sessions it opens; rows in any order merge the sessions they bridge. One timer stands for the session that is due first; when it fires, all that are due
    by the watermark are closed and the next one's is set.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "spans array<long>")

    def held(self) -> list[tuple[int, int, int]]:
        (flat,) = self.open.get() or ((),)
        return list(zip(flat[::3], flat[1::3], flat[2::3]))

    def keep(self, spans: list[tuple[int, int, int]]) -> None:
        if spans:
            self.open.update(([x for span in spans for x in span],))
            self.handle.registerTimer(due(min(last for _, last, _ in spans)))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        spans = self.held()
        for row in rows:
            spans.append((row.at, row.at, 1))
            if len(spans) % MERGE_ROWS == 0:
                spans = merge_spans(spans)
        self.keep(merge_spans(spans))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A timer of a session that went on finds nothing to close."""
        now, spans = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), self.held()
        over = [span for span in spans if due(span[1]) <= now]
        if over:
            self.keep([span for span in spans if due(span[1]) > now])
        for started, last, n in over:
            yield Row(user_id=key[0], started=started, last=last, n=n)

    def close(self) -> None:
        pass


def merge_spans(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(first, last, count) spans, those less than GAP apart made one."""
    merged: list[tuple[int, int, int]] = []
    for first, last, n in sorted(spans):
        if merged and first - merged[-1][1] < GAP:
            merged[-1] = (merged[-1][0], max(merged[-1][1], last), merged[-1][2] + n)
        else:
            merged.append((first, last, n))
    return merged


def due(last: int) -> int:
    """The first millisecond at which no row can prolong a session any more."""
    return -(-(last + GAP) // 1000)


def timed_sessions(events: DataFrame) -> DataFrame:
    rows = events.filter("ts is not null").withWatermark("ts", LATE).select("user_id", "ts", F.unix_micros("ts").alias("at"))
    found = rows.groupBy("user_id").transformWithState(Sessions(), "user_id long, started long, last long, n long", "append", "EventTime")
    return found.select("user_id", F.timestamp_micros("started").alias("started"), F.timestamp_micros("last").alias("ended"), "n")


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM b GROUP BY user_id, s""")
def p73_timer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that a timer of event time ends."""
    return ntz(play_events(spark, sf_dir, timed_sessions, conf=ROCKSDB), "started", "ended").filter("user_id is not null")


class Recent(StatefulProcessor):
    """The last `size` event ids of each user, in a list state that is forgotten `ttl_ms` of processing time after it was written."""

    def __init__(self, size: int, ttl_ms: int) -> None:
        self.size, self.ttl_ms = size, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getListState("ids", "event_id long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ids = {r[0] for r in self.ids.get()}
        for row in rows:
            ids.add(row.event_id)
            if len(ids) > self.size:
                ids.remove(min(ids))
        newest = sorted(ids)
        self.ids.put([(i,) for i in newest])
        yield Row(user_id=key[0], ids=",".join(map(str, newest)), newest=newest[-1], held=len(newest))

    def close(self) -> None:
        pass


def recent(events: DataFrame, size: int = 3, ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    rows = events.filter("event_id is not null").select("user_id", "event_id")
    return rows.groupBy("user_id").transformWithState(Recent(size, ttl_ms), "user_id long, ids string, newest long, held long", "append", "ProcessingTime")


@query("""SELECT user_id, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events)
WHERE place <= 3 GROUP BY user_id""")
def p73_list_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last three event ids, kept in a list with a time to live of a day; the newest list written is the result."""
    found = play_events(spark, sf_dir, recent, conf=ROCKSDB | NO_IDLE)
    return found.groupBy("user_id").agg(F.max_by("ids", F.struct("newest", "held")).alias("ids"))
