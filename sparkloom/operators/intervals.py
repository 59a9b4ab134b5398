"""Joins of intervals that overlap."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..names import fresh
from ..plans.registry import query
from ..session import load
from .joins import even, pair_join
from .windows import sessions


def interval_join(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str], by: list[str] | None = None, unit: float | None = None) -> DataFrame:
    """Pairs of rows whose closed intervals [from, to] share a point, and whose columns `by` are equal; each pair once. The columns of left, then those of right without `by`.

    Bounds are numbers or times, of one kind. Null bounds or keys and intervals that end before they begin match nothing; infinite bounds are open ends.

    An interval's level is the power of two (with `by`: of 16) of `unit` (default 1, for times a second) that is not shorter than it, so on its own and each higher level it
    touches two cells at most. Two intervals that overlap share a cell on the higher of their levels: each row goes to the cells of its own level, and of those
    higher levels that the other side has. An equi-join on level and cell finds the pairs; of two shared cells the one
    with the later start counts. So one long interval costs the short ones a row each, not a nested loop. With keys a cell has few rows and what is sent
    counts, so levels are few; without any the pairs count, so levels are close and cells of many pairs are spread over tasks. The levels in use (no more than some
    70) and the range of all bounds are what the driver sees.
    """
    by = by or []
    level, cell, higher, first, other = (fresh(x, left, right) for x in ("level", "cell", "higher", "first", "other"))
    fan = 4 if by else 1  # bits from a level to the next
    timed = left.schema[left_bounds[0]].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
    scale = 1e6 if timed else 1.0
    step = float(unit or 1) * scale
    number = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) if timed else F.col(c)).cast("double")
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)

    def measured(df: DataFrame, bounds: tuple[str, str]) -> DataFrame:
        a, b = map(number, bounds)
        usable = functools.reduce(lambda x, c: x & F.col(c).isNotNull(), by, F.col(bounds[0]) <= F.col(bounds[1]))
        return df.filter(usable & ~F.isnan(a) & ~F.isnan(b))

    left, right = measured(left, left_bounds), measured(right, right_bounds)
    span = lambda df, bounds: df.agg(F.min(finite(number(bounds[0]))), F.max(finite(number(bounds[0]))), F.min(finite(number(bounds[1]))), F.max(finite(number(bounds[1])))).first()
    seen = [x for df, bounds in ((left, left_bounds), (right, right_bounds)) for x in span(df, bounds) if x is not None]
    low, high = min(seen, default=0.0), max(seen, default=0.0)
    clip = lambda c: F.greatest(F.least(number(c), F.lit(high)), F.lit(low))

    def levelled(bounds: tuple[str, str]) -> Column:
        size = (clip(bounds[1]) - clip(bounds[0])) / step
        return F.when(size <= 1, 0).otherwise(F.ceil(F.log2(F.greatest(size, F.lit(1.0))) / fan)).cast("int")

    levels = [sorted(r[0] for r in df.select(levelled(bounds)).distinct().collect()) for df, bounds in ((left, left_bounds), (right, right_bounds))]

    def dealt(df: DataFrame, bounds: tuple[str, str], others: list[int], strictly: bool, side: bool, start: str) -> DataFrame:
        """A row for each cell that the interval touches on its own level and on the other side's higher ones; equal levels meet once, on the own level of both.

        higher: whether the left one of a pair comes up to the right one's own level here, or the right one to the left one's; start: the cell of the start.
        """
        own = levelled(bounds)
        here = df.withColumns({level: own, higher: F.lit(not side)})
        above = df.withColumn(level, F.explode(F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > own if strictly else x >= own))).withColumn(higher, F.lit(side))
        width = F.lit(step) * F.pow(F.lit(2.0), F.col(level) * fan)
        placed = here.unionByName(above).withColumn(start, F.floor(clip(bounds[0]) / width))
        return placed.withColumn(cell, F.explode(F.sequence(F.col(start), F.floor(clip(bounds[1]) / width))))

    if not by:
        left, right = even(left), even(right)
    mine, theirs = dealt(left, left_bounds, levels[1], False, True, first), dealt(right, right_bounds, levels[0], True, False, other)
    # a left row of level a and a right row of level b: if a <= b, the left one comes up to the right one's own level, else the right one to the left one's
    on = [level, cell, higher, *by]
    met = mine.join(theirs, on) if by else pair_join(mine, theirs, on)
    overlap = (F.col(left_bounds[0]) <= F.col(right_bounds[1])) & (F.col(right_bounds[0]) <= F.col(left_bounds[1]))
    once = met.filter(overlap & (F.col(cell) == F.greatest(first, other)))
    return once.select(*left.columns, *[c for c in right.columns if c not in by])


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 7200 SECOND THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM a),
s AS (SELECT user_id, min(ts) AS started, max(ts) AS ended FROM b GROUP BY user_id, s),
p AS (SELECT user_id, event_id, ts AS since, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events WHERE event_type = 'purchase')
SELECT s.user_id AS user_id, started, ended, event_id, since, until FROM s JOIN p ON s.user_id = p.user_id AND started <= until AND since <= ended""")
def p17_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's sessions (moments to hours) against the stretches from each purchase to the next (minutes to weeks)."""
    events = load(spark, sf_dir, "events")
    found = sessions(events.select("user_id", "ts"), "user_id", "ts", 7200).select("user_id", "started", "ended")
    following = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    stretches = events.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").alias("since"), following.alias("until"))
    return interval_join(found, stretches, ("started", "ended"), ("since", "until"), ["user_id"])


@query("""SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal <= s_acctbal + 20 * s_nationkey AND s_acctbal <= c_acctbal + power(2, c_nationkey % 8)""")
def p17_interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of balances, from a point to hundreds wide, without a key."""
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (F.col("c_acctbal") + F.pow(F.lit(2), F.col("c_nationkey") % 8)).alias("c_upto"))
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_acctbal") + 20 * F.col("s_nationkey")).alias("s_upto"))
    return interval_join(customers, suppliers, ("c_acctbal", "c_upto"), ("s_acctbal", "s_upto")).select("c_custkey", "s_suppkey")
