"""Joins: equi, outer, semi, anti, range, as-of, lateral and cross.

No side is broadcast by hint: Spark broadcasts what its own size check admits and splits skewed partitions of the others. Joins whose pairs outgrow their
rows are dealt to tiles.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..names import fresh
from ..plans.registry import query
from ..session import load, scratch

TILE = 1 << 24  # pairs of one key's rows that meet in one tile, about
TASK = 1 << 25  # pairs that one task makes, about


def crowded(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame | None, int]:
    """The keys whose rows make more than TILE pairs, with the parts that each side's rows are cut into (on, parts_left, parts_right; None without such keys), and the tasks for all pairs.

    A crowded key has thousands of rows, so there are few of them: they go to every task.
    """
    names = [fresh(x, left, right) for x in ("n_left", "n_right", "parts_left", "parts_right")]
    a, b = F.col(names[0]), F.col(names[1])
    path = scratch(left.sparkSession, "pairs")
    sizes = [df.groupBy(*on).agg(F.count("*").cast("double").alias(n)) for df, n in zip((left, right), names)]
    sizes[0].join(sizes[1], on).write.parquet(path)
    counts = left.sparkSession.read.parquet(path)
    total, most = counts.agg(F.sum(a * b), F.max(a * b)).first()
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total or 0) // TASK))
    if (most or 0) <= TILE:
        return None, tasks
    side, tiles = F.lit(float(TILE) ** 0.5), a * b / TILE
    mine = F.when(a <= side, 1.0).when(b <= side, tiles).otherwise(a / side)
    theirs = F.when(a <= side, tiles).when(b <= side, 1.0).otherwise(b / side)
    return counts.filter(a * b > TILE).select(*on, F.ceil(mine).alias(names[2]), F.ceil(theirs).alias(names[3])), tasks


def tiled(left: DataFrame, right: DataFrame, on: list[str], keys: DataFrame, tasks: int) -> DataFrame:
    """The inner join on `on`, each pair once. Of `crowded` keys each side's rows are cut into parts by a hash of the row, and each left part meets each right one in a tile of its own.

    The number of tasks follows the pairs, not the bytes read, so neither a common key nor a large result makes a long task.
    """
    tile, own = fresh("tile", left, right, keys), fresh("own", left, right, keys)
    mine, theirs = (F.coalesce(F.col(c), F.lit(1)) for c in keys.columns[len(on):])

    def dealt(df: DataFrame, parts: Column, others: Column, number: Callable[[Column, Column], Column]) -> DataFrame:
        plain = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "array", "struct", "variant")]
        placed = df.join(F.broadcast(keys), on, "left").withColumn(own, F.pmod(F.xxhash64(*plain), parts))
        met = placed.withColumn(tile, F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
        return met.withColumn(tile, number(F.col(own), F.col(tile))).select(*df.columns, tile).repartition(tasks, *on, tile)

    lefts = dealt(left, mine, theirs, lambda own, other: own * theirs + other)
    rights = dealt(right, theirs, mine, lambda own, other: other * theirs + own)
    return lefts.join(rights, [*on, tile]).drop(tile)


def even(df: DataFrame) -> DataFrame:
    """df dealt evenly, for rows that are copied next: a small file is read by few tasks, which would hold all copies."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def pair_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The inner join on `on` of any number of pairs: see `tiled`. Null keys match nothing."""
    keys, tasks = crowded(left, right, on)
    if keys is None:
        return left.repartition(tasks, *on).join(right.repartition(tasks, *on), on)
    return tiled(left, right, on, keys, tasks)


def full_pair_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The full join on `on`. A crowded key has rows on both sides, so all of its rows have partners: only the other keys' rows need an outer join."""
    keys, tasks = crowded(left, right, on)
    outer = lambda a, b: a.repartition(tasks, *on).join(b.repartition(tasks, *on), on, "full")
    if keys is None:
        return outer(left, right)
    few = F.broadcast(keys.select(*on))
    rest = outer(left.join(few, on, "left_anti"), right.join(few, on, "left_anti"))
    return tiled(left.join(few, on, "left_semi"), right.join(few, on, "left_semi"), on, keys, tasks).unionByName(rest)


def range_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, below: float, above: float) -> DataFrame:
    """Pairs with left_value - below <= right_value <= left_value + above.

    Values are cut into cells a quarter as wide as the range, left rows go to the five or six cells their range touches, and an
    equi-join on the cell does the rest, so no nested loop is planned and four of five pairs of a cell are right. A cell of
    many pairs is spread over tasks. Null values match nothing.
    """
    width = float(below + above) / 4 or 1.0
    name = fresh("cell", left, right)
    cell = lambda c: F.floor(c / width)
    spread = even(left).withColumn(name, F.explode(F.sequence(cell(F.col(left_value) - below), cell(F.col(left_value) + above))))
    placed = right.withColumn(name, cell(F.col(right_value)))
    return pair_join(spread, placed, [name]).filter(F.col(right_value).between(F.col(left_value) - below, F.col(left_value) + above)).drop(name)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], chunk: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with the `values` of the last right row of the same `by` whose `on` is not later, as asof_<value>; null where there is none.

    Of right rows with equal `on` the one with the greatest values counts; a right row at the same time is seen. Null keys and times match
    nothing; all left rows stay. Columns of any name are carried along.

    Both sides are unioned and an ordered window carries the last right row on: no pairs. A key is cut into chunks of time (`chunk`, a
    rising function of `on`; days for times, none for other types: give one for numbers where a key is hot), so a hot key is spread; each chunk's last right row is carried over to
    the next ones in a second window that has one row for a key and chunk. Both are made of one exchange: each input is read once.
    """
    timed = left.schema[on].dataType.typeName() in ("timestamp", "timestamp_ntz")
    cut = chunk or ((lambda c: F.date_trunc("day", c)) if timed else (lambda c: F.when(c.isNotNull(), F.lit(0))))
    key, at = F.struct(*by).alias("key"), F.col(on).alias("at")
    usable = functools.reduce(lambda a, c: a & c, (F.col(c).isNotNull() for c in (*by, on)))
    theirs = right.filter(usable).select(key, at, F.struct(F.col(on).alias("at"), F.struct(*values).alias("row")).alias("seen"))
    mine = left.select(key, at, F.struct("*").alias("left"))
    both = mine.unionByName(theirs, allowMissingColumns=True).withColumn("chunk", cut(F.col("at"))).repartition("key", "chunk")
    order = Window.partitionBy("key", "chunk").orderBy("at", F.col("left").isNotNull(), "seen").rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("found", F.last("seen", ignorenulls=True).over(order)).filter("left is not null").select("key", "chunk", "left", "found")
    # it asks for all columns of `both`, so that Spark sees the same exchange and makes it once
    ends = both.groupBy("key", "chunk").agg(F.max("seen").alias("last"), F.count("left").alias("asking"), F.max("at").alias("until"))
    earlier = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "chunk", "asking", "until", F.last("last", ignorenulls=True).over(earlier).alias("before"))
    carried = carried.filter("asking > 0 and until is not null and before is not null").select("key", "chunk", "before")
    row = F.coalesce(F.col("found"), F.col("before")).getField("row")
    return local.join(carried, ["key", "chunk"], "left").select(*[F.col("left").getField(c).alias(c) for c in left.columns], *[row.getField(v).alias(f"asof_{v}") for v in values])


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def p10_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    return orders.filter("o_totalprice > 200000").join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "c_name", "c_mktsegment")


@query("""SELECT o_orderkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderkey""")
def p11_sort_merge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    joined = load(spark, sf_dir, "lineitem").join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT l_orderkey, l_partkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity = 50")
def p11_shuffled_hash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name").hint("shuffle_hash")
    return load(spark, sf_dir, "lineitem").filter("l_quantity = 50").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_partkey", "s_name")


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def p12_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_linenumber, o_orderkey, o_orderstatus FROM lineitem RIGHT JOIN orders ON o_orderkey = l_orderkey AND l_quantity > 40")
def p12_right_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").filter("l_quantity > 40")
    return lines.join(load(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"), "right").select("l_linenumber", "o_orderkey", "o_orderstatus")


@query("""SELECT c_nationkey, s_nationkey, c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 9000) c
FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON c_nationkey = s_nationkey""")
def p12_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 keys at most, so the pairs grow with the square of the tables: they are dealt to tiles."""
    c = load(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey"), "c_nationkey", "c_custkey")
    s = load(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nationkey"), "s_nationkey", "s_suppkey")
    return full_pair_join(c, s, ["nationkey"]).select("c_nationkey", "s_nationkey", "c_custkey", "s_suppkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def p13_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return load(spark, sf_dir, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def p13_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON s_acctbal BETWEEN c_acctbal - 25 AND c_acctbal + 25")
def p14_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), load(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return range_join(customers, suppliers, "c_acctbal", "s_acctbal", 25, 25).select("c_custkey", "s_suppkey")


@query("""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
SELECT event_id, e.user_id, e.ts, v.value AS asof_value FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def p15_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    bought, seen = (events.filter(F.col("event_type") == k) for k in ("purchase", "view"))
    return asof_join(bought.select("event_id", "user_id", "ts"), seen, ["user_id"], "ts", ["value"])


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def p16_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables have a fixed number of rows (5 and 25)."""
    return load(spark, sf_dir, "region").crossJoin(load(spark, sf_dir, "nation")).select("r_name", "n_name")


@query("""SELECT n_name, s.n AS n, s.total AS total FROM nation,
LATERAL (SELECT count(*) AS n, round(coalesce(sum(s_acctbal), 0), 2) AS total FROM supplier WHERE s_nationkey = n_nationkey) s""")
def p16_lateral_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated aggregate; Spark turns it into a grouped join."""
    return spark.sql(
        """SELECT n_name, s.n, s.total FROM {nation},
        LATERAL (SELECT count(*) AS n, round(coalesce(sum(s_acctbal), 0), 2) AS total FROM {supplier} WHERE s_nationkey = n_nationkey) s""",
        nation=load(spark, sf_dir, "nation"), supplier=load(spark, sf_dir, "supplier"),
    )


@query("SELECT quality, toxic, lang, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def p93_label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(load(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic", "lang").agg(F.count("*").alias("n"))


@query("""SELECT n_name, o_orderstatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON o_orderkey = l_orderkey WHERE r_regionkey = 1 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
GROUP BY n_name, o_orderstatus""")
def p10_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five tables; the filters reach the scans of region and orders."""
    return spark.sql(
        """SELECT n_name, o_orderstatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM {region} JOIN {nation} ON r_regionkey = n_regionkey JOIN {customer} ON n_nationkey = c_nationkey
        JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey
        WHERE r_regionkey = 1 AND o_orderdate >= TIMESTAMP_NTZ '1996-01-01' AND o_orderdate < TIMESTAMP_NTZ '1998-01-01'
        GROUP BY n_name, o_orderstatus""",
        **{name: load(spark, sf_dir, name) for name in ("region", "nation", "customer", "orders", "lineitem")},
    )
