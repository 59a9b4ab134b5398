"""Aggregates: grouped, distinct, grouping sets, quantiles, sketches, lists and pivots."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import load, scratch

FEW_GROUPS = 1 << 16  # so many rows of brackets, a hundred bytes or so a quantile, may go to every task


def exact_quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """`by` and, for each name of `wanted`, the exact interpolated quantile {name: (column, share)} of each group's non-null values as doubles; null for groups without any.

    Sketches, all in one pass, bracket each quantile to about a thousandth of the group's rows. In a second pass rows outside a bracket are only counted, with the value next
    to the bracket, and those inside are counted by value before they are ordered, so no task holds a group's values, as `percentile` would.
    """
    reach = 5e-4
    keys, values = [f"k{i}" for i in range(len(by))], [f"v{j}" for j in range(len(wanted))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *[F.col(c).cast("double").alias(v) for v, (c, _) in zip(values, wanted.values())])
    bracket = lambda v, q: F.struct(F.percentile_approx(v, [max(0.0, q - reach), min(1.0, q + reach)], 10_000).alias("ends"), F.count(v).alias("n"), F.lit(q).alias("q"))
    near = rows.groupBy(*[F.col(k).alias(f"by_{k}") for k in keys]).agg(F.array(*[bracket(v, q) for v, (_, q) in zip(values, wanted.values())]).alias("brackets"))
    same = functools.reduce(lambda a, c: a & c, (F.col(k).eqNullSafe(F.col(f"by_{k}")) for k in keys), F.lit(True))
    path = scratch(df.sparkSession, "brackets")
    near.write.parquet(path)
    near = df.sparkSession.read.parquet(path)
    if near.count() <= FEW_GROUPS:  # else the rows of a few groups would meet their brackets in a few tasks, all sorted
        near = F.broadcast(near)
    each = rows.join(near, same).select(*keys, F.posexplode(F.arrays_zip(F.array(*values).alias("v"), F.col("brackets").alias("b"))).alias("of", "x")).select(*keys, "of", "x.v", "x.b.*")
    zone = F.when(F.col("v") < F.col("ends")[0], 0).when(F.col("v") <= F.col("ends")[1], 1).otherwise(2)
    counted = each.withColumn("zone", zone).groupBy(*keys, "of", "n", "q", "zone", F.when(F.col("zone") == 1, F.col("v")).alias("inside"))
    counted = counted.agg(F.when(F.col("zone") == 0, F.max("v")).otherwise(F.min("v")).alias("value"), F.count("v").alias("same"))
    seen = F.sum("same").over(Window.partitionBy(*keys, "of").orderBy("zone", "value"))
    at = F.col("q") * (F.col("n") - 1)
    ranked = counted.select(*keys, "of", "value", seen.alias("seen"), F.floor(at).alias("low"), F.ceil(at).alias("high"), (at - F.floor(at)).alias("share"))
    pick = lambda j, rank: F.min(F.when((F.col("of") == j) & (F.col("seen") > F.col(rank)), F.col("value")))
    share = lambda j: F.max(F.when(F.col("of") == j, F.col("share")))
    found = ranked.groupBy(*keys).agg(*[(pick(j, "low") + (pick(j, "high") - pick(j, "low")) * share(j)).alias(v) for j, v in enumerate(values)])
    return found.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], *[F.col(v).alias(name) for v, name in zip(values, wanted)])


def exact_quantile(df: DataFrame, by: list[str], value: str, q: float, name: str = "quantile") -> DataFrame:
    """One of `exact_quantiles`."""
    return exact_quantiles(df, by, {name: (value, q)})


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def p20_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02'")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(revenue), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders WHERE o_orderstatus = 'F'")
def p20_global_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 15000")
def p20_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")).filter("q > 15000").drop("q")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def p21_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS states FROM orders GROUP BY o_orderpriority")
def p21_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("states"))


_SETS = "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY "


def _sets(grouped) -> DataFrame:
    return grouped.agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query(_SETS + "CUBE (l_returnflag, l_linestatus)")
def p22_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(load(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus"))


@query(_SETS + "ROLLUP (l_returnflag, l_linestatus)")
def p22_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus"))


@query(_SETS + "GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def p22_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    return _sets(lines.groupingSets([[lines.l_returnflag], [lines.l_linestatus], []], lines.l_returnflag, lines.l_linestatus))


@query()
def p23_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct counts (HLL twice) and quantiles by event type; the tests bound the errors."""
    return load(spark, sf_dir, "events").groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.02).alias("users"), F.hll_sketch_estimate(F.hll_sketch_agg("event_id", F.lit(14))).alias("events"), F.percentile_approx("value", [0.5, 0.99], 10000).alias("quantiles")
    )


COUNTS_SHARE = 0.005


def counts_near(sketch: Column, n: Column, top: Column) -> Column:
    """Whether a count-min sketch of whole numbers under 2**32 holds n rows, in each line, and estimates the user `top` (user_id, rows; null: none) within its bound."""
    number = lambda at, size: F.conv(F.hex(F.substring(sketch, at, size)), 16, -10).cast("long")
    depth, width = number(F.lit(13), F.lit(4)), number(F.lit(17), F.lit(4))
    cell = lambda line, at: number(F.lit(21) + depth * 8 + (line * width + at) * 8, F.lit(8))
    total = lambda line: F.aggregate(F.sequence(F.lit(0).cast("long"), width - 1), F.lit(0).cast("long"), lambda a, at: a + cell(line, at))

    def counter(line: Column) -> Column:
        """Spark's place of a number in a line: a product, its upper half added, without the sign, modulo the width."""
        product = number(F.lit(21) + line * 8, F.lit(8)) * top["user_id"]
        return cell(line, (product + F.shiftright(product, 32)).bitwiseAND(F.lit((1 << 31) - 1)) % width)

    lines = F.sequence(F.lit(0).cast("long"), depth - 1)
    found = F.array_min(F.transform(lines, counter))
    return (number(F.lit(5), F.lit(8)) == n) & F.forall(lines, lambda line: total(line) == n) & F.coalesce(found.between(top["rows"], top["rows"] + COUNTS_SHARE * n), top.isNull())


@query("SELECT event_type, true AS users_near, true AS events_near, true AS median_near, true AS kll_near, true AS counts_near FROM events GROUP BY event_type")
def p23_sketch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether HLL, quantile, KLL and count-min sketches keep their error bounds against exact results; all should.

    A count-min sketch is its version (4 bytes), the count of its rows (8), depth (4), width (4), one multiplier for each line and the lines of counters, all of 8 bytes: each line adds up to
    all rows, and the counter of the commonest user is not under their rows and not over them by more than COUNTS_SHARE of all rows in every line.
    """
    events = load(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "value")
    exact = events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count("user_id").alias("known"))
    sketches = events.groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.02).alias("hll"), F.hll_sketch_estimate(F.hll_sketch_agg("event_id", F.lit(14))).alias("ids"), F.percentile_approx("value", 0.5, 10000).alias("median"),
        F.kll_sketch_get_quantile_bigint(F.kll_sketch_agg_bigint("event_id"), F.lit(0.5)).alias("middle"), F.count_min_sketch("user_id", F.lit(COUNTS_SHARE), F.lit(0.99), F.lit(7)).alias("counts"),
    )
    commonest = events.filter("user_id is not null").groupBy("event_type", "user_id").agg(F.count("*").alias("rows")).groupBy("event_type").agg(F.max_by(F.struct("user_id", "rows"), F.struct("rows", "user_id")).alias("top"))
    both = exact.join(sketches, "event_type").join(commonest, "event_type", "left")
    below = F.count(F.when(F.col("value") <= F.col("median"), 1)) / F.max("n")
    under = F.count(F.when(F.col("event_id") <= F.col("middle"), 1)) / F.max("n")
    ranks = events.join(both, "event_type").groupBy("event_type").agg(below.alias("below"), under.alias("under"))
    near = lambda a, b, share: F.abs(F.col(a) - F.col(b)) <= share * F.col(b) + 1
    return both.join(ranks, "event_type").select(
        "event_type", near("hll", "users", 0.08).alias("users_near"), near("ids", "n", 0.04).alias("events_near"), F.col("below").between(0.48, 0.52).alias("median_near"),
        F.col("under").between(0.46, 0.54).alias("kll_near"), counts_near(F.col("counts"), F.col("known"), F.col("top")).alias("counts_near"),
    )


@query("""SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY l_returnflag""")
def p24_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_quantiles(load(spark, sf_dir, "lineitem"), ["l_returnflag"], {"median": ("l_quantity", 0.5), "p90": ("l_extendedprice", 0.9)})
    return found.select("l_returnflag", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"))


@query("""SELECT l_returnflag, round(var_pop(l_discount), 8) AS var_disc, round(stddev_samp(l_quantity), 6) AS sd_qty, round(corr(l_quantity, l_extendedprice), 8) AS corr_price
FROM lineitem GROUP BY l_returnflag""")
def p24_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.var_pop("l_discount"), 8).alias("var_disc"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd_qty"), F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("corr_price"))


@query("""SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, max_by(event_type, (ts, event_id)) AS last_kind
FROM events GROUP BY user_id""")
def p25_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of kinds is as small as the kinds; the last kind needs no list."""
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_kind"))


@query("""SELECT user_id, (SELECT event_type FROM (SELECT event_type, count(*) AS n FROM events x WHERE x.user_id = e.user_id GROUP BY event_type) ORDER BY n DESC, event_type LIMIT 1) AS commonest,
list(event_id ORDER BY ts, event_id)[1:5] AS first_ids FROM events e GROUP BY user_id""")
def p25_ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest kind, ties to the smaller name, from counts; the first five ids of each user, cut before they are listed."""
    events = load(spark, sf_dir, "events")
    counts = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    commonest = counts.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("commonest"))
    few = events.select("user_id", "ts", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("at")).filter("at <= 5")
    lists = few.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_id"))), lambda x: x.event_id).alias("first_ids"))
    return commonest.join(lists, "user_id")


@query("""SELECT event_type, string_agg(day, ';' ORDER BY day) AS days, mode(day ORDER BY day) AS one_of FROM (SELECT DISTINCT event_type, strftime(ts, '%d') AS day FROM events)
GROUP BY event_type""")
def p25_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listagg and mode with an order that decides ties; there are no more than 31 days to list."""
    days = load(spark, sf_dir, "events").select("event_type", F.date_format("ts", "dd").alias("day")).distinct()
    return spark.sql("SELECT event_type, listagg(day, ';') WITHIN GROUP (ORDER BY day) AS days, mode() WITHIN GROUP (ORDER BY day) AS one_of FROM {days} GROUP BY event_type", days=days)


@query("""SELECT user_id, kind AS commonest FROM (SELECT user_id, kind, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, kind) AS place
FROM (SELECT user_id, event_type AS kind, count(*) AS n FROM events GROUP BY ALL)) WHERE place = 1""")
def p25_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest kind of each user's events, of equally common ones the first by name; the aggregate holds a count for each of the five kinds."""
    return spark.sql("SELECT user_id, mode() WITHIN GROUP (ORDER BY event_type) AS commonest FROM {events} GROUP BY user_id", events=load(spark, sf_dir, "events"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view,
count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id""")
def p26_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).count()
    return counts.na.fill(0)


@query("""SELECT s_suppkey, 'nation' AS field, CAST(s_nationkey AS DOUBLE) AS val FROM supplier
UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier""")
def p26_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return s.unpivot("s_suppkey", ["nation", "balance"], "field", "val")


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def p95_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(turns, lambda x: x.role), ">").alias("roles"), F.sum(F.length("text")).alias("chars"))
