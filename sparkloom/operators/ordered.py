"""Running totals, row numbers and counts over an order, spread over range partitions: no key, hot or missing, is one task.

Rows are dealt to ranges of (key, order) and written with their range's number. Each range is then summed for itself; what a range takes over from
those before it is a scan over one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..names import fresh
from ..plans.registry import query
from ..session import load, scratch

RANGE_ROWS = 1 << 20  # rows that one task sorts, about
RADIX_BITS = 4  # bits of a position that one level of `counts_where` takes
OPS = ("<", "<=", ">", ">=")


def ranged(df: DataFrame, order: list[Column], part: str, place: str) -> DataFrame:
    """df in ranges of the order, written to the shared folder with the range's number in `part` and the row's place in its range, from 0, in `place`.

    It is written because ranges come from a sample: two readers of it must see the same ones. A range has about RANGE_ROWS rows at most, however many the frame has.
    """
    path = scratch(df.sparkSession, "ranged")
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    at = F.monotonically_increasing_id()  # the partition's number above 33 bits, the row's place below
    rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows.withColumns({part: F.shiftright(at, 33).cast("int"), place: at.bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def number_rows(df: DataFrame, order: list[Column], name: str = "row") -> DataFrame:
    """df with the number of each row, from 1, in the order over all rows; rows that the order can't tell apart are numbered in any order.

    One shuffle; ranges whose rows are counted are joined by their number. An empty frame gives none.
    """
    part, place = fresh("part", df), fresh("place", df)
    rows = ranged(df, order, part, place)
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    starts = sizes.select(F.col(part).alias(part), before.alias(name))
    return rows.join(starts, part).select(*df.columns, (F.col(name) + F.col(place) + 1).alias(name))


FOLDS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_JOIN = {
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + b,
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
}


def running(df: DataFrame, by: list[str], order: list[Column], totals: dict[str, tuple[str, str]]) -> DataFrame:
    """df with running totals: {name: (sum, count, min or max; column)} of each key's rows up to and with the row itself.

    by may be empty: then over all rows. Rows of one key that the order can't tell apart are taken in any order, one after the other. Nulls are left out as by the
    plain aggregates, so a sum is null until a value comes; null keys are one key.

    A key that spans ranges takes over the totals of the ranges before: those of the key that ends the range, one row a range.
    """
    part, place, key, was = (fresh(x, df) for x in ("part", "place", "key", "was"))
    rows = ranged(df, [*(F.asc(b) for b in by), *order], part, place).withColumn(key, F.struct(F.lit(0), *by))
    local = Window.partitionBy(part, key).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    mine = {n: FOLDS[f](c).over(local) for n, (f, c) in totals.items()}
    ends = rows.groupBy(part).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    sums = rows.join(ends, part).filter(F.col(key).eqNullSafe(F.col("last"))).groupBy(part, "first", "last").agg(*[FOLDS[f](c).alias(f"t{i}") for i, (f, c) in enumerate(totals.values())])
    # over one row a range: the ranges that one key ends one after the other are a run; only the run's first range may begin with another key
    scan = Window.orderBy(part)
    begins = F.when((F.col("first") == F.col("last")) & (F.lag("last").over(scan) == F.col("last")), 0).otherwise(1)
    runs = sums.withColumn("begins", begins).withColumn("run", F.sum("begins").over(scan))
    whole = Window.partitionBy("run").orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    carried = [F.struct(F.col("last").alias("key"), *[FOLDS["sum" if f == "count" else f](f"t{i}").over(whole).alias(f"t{i}") for i, (f, _) in enumerate(totals.values())]).alias("kept")]
    offsets = runs.select(part, *carried).select(part, F.lag("kept").over(scan).alias(was))
    inherits = F.col(was)["key"] == F.col(key)
    found = rows.withColumns(mine).join(offsets, part)
    out = {n: F.when(inherits, _JOIN[f](F.col(was)[f"t{i}"], F.col(n))).otherwise(F.col(n)) for i, (n, (f, _)) in enumerate(totals.items())}
    return found.select(*[c for c in df.columns if c not in totals], *[out[n].alias(n) for n in totals])


def counts_where(left: DataFrame, right: DataFrame, first: tuple[str, str, str], second: tuple[str, str, str], name: str = "n") -> DataFrame:
    """left with the number of right rows for which both inequalities (left column, <, <=, > or >=, right column) hold; nulls on either side hold for none.

    A join on two inequalities has as many rows as there are pairs; the counts of it take no pairs. Right rows get their place in the order of the first
    column, and a left row the number of places that its first inequality admits. The places up to a number are, for each digit of it, the blocks under the
    digit in the block of the higher digits. So on each level of digits, running counts by digit in the order of the second
    column state what a left row finds in the blocks under its own digit; its levels are added. Each row goes once through each level (a level for each RADIX_BITS bits
    of the right side's size), in range partitions, so neither equal values nor a large block make one task.
    """
    (lx, op, rx), (ly, op2, ry) = first, second
    if op not in OPS or op2 not in OPS:
        raise ValueError("inequalities are <, <=, > or >=")
    spark = left.sparkSession
    path = scratch(spark, "left")
    row, cells = fresh("row", left), 1 << RADIX_BITS
    left.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    numbered = spark.read.parquet(path)
    usable = numbered.filter(F.col(lx).isNotNull() & F.col(ly).isNotNull()).select(F.col(lx).alias("x"), F.col(ly).alias("y"), F.col(row).alias("row"))
    theirs = right.filter(F.col(rx).isNotNull() & F.col(ry).isNotNull()).select(F.col(rx).alias("x"), F.col(ry).alias("y"), F.lit(None).cast("long").alias("row"))
    both = usable.unionByName(theirs).withColumn("theirs", F.when(F.col("row").isNull(), 1))

    def turned(column: str, op: str) -> list[Column]:
        """The order in which what the inequality `left op right` admits comes first; of equal values, right rows before left ones where they are admitted."""
        rank = F.col("row").isNotNull() if "=" in op else F.col("row").isNull()
        return [F.asc(column) if op[0] == ">" else F.desc(column), rank.asc()]

    placed = running(both, [], [*turned("x", op), F.asc("y"), F.asc("row")], {"upto": ("count", "theirs")})
    path = scratch(spark, "placed")
    placed.select("y", "row", F.when(F.col("row").isNull(), F.col("upto") - 1).otherwise(F.col("upto")).alias("place")).write.parquet(path)
    placed = spark.read.parquet(path)
    n = placed.filter("row is null").count()
    levels = max(1, -(-n.bit_length() // RADIX_BITS))
    digits = [F.struct(F.lit(k).alias("level"), F.expr(f"shiftright(place, {RADIX_BITS * (k + 1)})").alias("block"), F.expr(f"shiftright(place, {RADIX_BITS * k}) & {cells - 1}").cast("int").alias("digit")) for k in range(levels)]
    dealt = placed.select("y", "row", F.inline(F.array(*digits))).filter("row is null or digit > 0")
    marked = dealt.withColumns({f"in{k}": F.when(F.col("row").isNull() & (F.col("digit") == k), 1) for k in range(cells - 1)})
    counted = running(marked, ["level", "block"], [*turned("y", op2), F.asc("row"), F.asc("digit")], {f"in{k}": ("count", f"in{k}") for k in range(cells - 1)}).filter("row is not null")
    under = F.aggregate(F.slice(F.array(*[f"in{k}" for k in range(cells - 1)]), F.lit(1), F.col("digit")), F.lit(0).cast("long"), lambda a, x: a + x)
    found = counted.groupBy(F.col("row").alias(row)).agg(F.sum(under).alias(name))
    return numbered.join(found, row, "left").select(*left.columns, F.coalesce(name, F.lit(0)).alias(name))


_CENTS = "CAST(floor(o_totalprice * 100) AS BIGINT)"


@query(f"""SELECT o_orderkey, row_number() OVER w AS place, CAST(sum({_CENTS}) OVER w AS BIGINT) AS cents, max({_CENTS}) OVER w AS most
FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def p33_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all orders, without a key: the place in time, the sum so far and the largest so far."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.floor(F.col("o_totalprice") * 100).alias("cents"))
    found = running(orders.withColumns({"place": F.lit(1), "most": F.col("cents")}), [], [F.asc("o_orderdate"), F.asc("o_orderkey")], {"place": ("count", "place"), "cents": ("sum", "cents"), "most": ("max", "most")})
    return found.drop("o_orderdate")


@query("""SELECT event_id, row_number() OVER w AS place, CAST(sum(CAST(floor(value * 100) AS BIGINT)) OVER w AS BIGINT) AS cents
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def p33_running_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five keys, each with a fifth of all rows: each is spread over ranges of time."""
    events = load(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.lit(1).alias("place"), F.floor(F.col("value") * 100).alias("cents"))
    found = running(events, ["event_type"], [F.asc("ts"), F.asc("event_id")], {"place": ("count", "place"), "cents": ("sum", "cents")})
    return found.select("event_id", "place", "cents")


@query("SELECT l_shipdate, l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS row FROM lineitem")
def p33_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    return number_rows(lines, [F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")])


@query("""SELECT o_orderkey, CAST(count(p_partkey) AS BIGINT) AS n FROM orders LEFT JOIN part ON o_totalprice / 200 > p_retailprice AND o_custkey <= p_partkey
GROUP BY o_orderkey""")
def p14_two_inequalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the parts that cost less than a 200th of it and have a number from its customer's on."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 200).alias("share"), "o_custkey")
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return counts_where(orders, parts, ("share", ">", "p_retailprice"), ("o_custkey", "<=", "p_partkey")).select("o_orderkey", "n")
