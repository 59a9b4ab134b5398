"""Page archives: round trips of odd rows, pruned blocks, filters against plain ones, files of failed tasks, streams; stored top-k sketches."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.sketches import most_frequent, store_counts
from sparkloom.session import scratch
from sparkloom.sources import archives
from sparkloom.sources.archives import COLUMNS, DDL, FORMAT, ArchiveReader, blocks_of, escaped, register, unescaped

ODD = [
    (1, "http://a/x", "<p>one</p>"), (1, "http://a/x", "<p>one</p>"), (None, "http://a/n", "no id"), (2, None, "no address"), (3, "http://b/", None), (None, None, None),
    (4, "http://b/\r\nPAGE/1.0\\n\\", "PAGE/1.0\r\nId: 9\r\n\r\n"), (5, "", ""), (-7, "http://ä/%0A", "größer \U0001f600\n\n"), (2**62, "http://c", "x" * 300_000),
]


def write(df, path, block=archives.BLOCK):
    register(df.sparkSession)
    df.write.format(FORMAT).mode("append").option("block", block).save(path)


def read(spark, path, schema=None):
    reader = spark.read.format(FORMAT)
    return (reader.schema(schema) if schema else reader).load(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("block", [1, 100, archives.BLOCK])
def test_odd_rows_come_back(spark, block):
    path = scratch(spark, "archive")
    write(spark.createDataFrame(ODD, DDL).repartition(2), path, block)
    assert rows(read(spark, path)) == sorted(ODD, key=repr)
    assert rows(read(spark, path, "url string")) == sorted([(r[1],) for r in ODD], key=repr)
    assert read(spark, path).count() == len(ODD)


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "\\n", "a\\\nb\r\\r", "\\\\n\\"])
def test_line_ends_in_addresses(text):
    assert "\n" not in escaped(text) and "\r" not in escaped(text) and unescaped(escaped(text)) == text


FILTERS = ["page_id = 7", "page_id > 90", "page_id >= 90", "page_id < 4", "page_id <= 4", "page_id IN (3, 50, 1000)", "page_id IS NULL", "page_id IS NOT NULL", "page_id <> 5", "NOT page_id > 5", "page_id = 7 OR url = 'u8'",
           "url = 'u8'", "url LIKE 'u1%'", "url LIKE '%3'", "url LIKE '%5%'", "url IS NULL", "url > 'u5'", "html LIKE '%9' AND page_id > 20", "page_id <=> NULL", "page_id <=> 3", "page_id = 3 AND page_id = 4", "upper(url) = 'U8'"]


def test_filters_keep_what_spark_keeps(spark):
    path = scratch(spark, "archive")
    table = spark.createDataFrame([(i if i % 11 else None, f"u{i}" if i % 7 else None, f"h{i}") for i in range(100)], DDL)
    write(table.repartition(3, "page_id"), path, 200)
    for condition in FILTERS:
        assert rows(read(spark, path).filter(condition)) == rows(table.filter(condition)), condition


def test_blocks_are_pruned(spark):
    path = scratch(spark, "archive")
    write(spark.range(1000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("x" * 50).alias("html")).coalesce(1).sortWithinPartitions("page_id"), path, 1000)
    reader = ArchiveReader(path, spark.createDataFrame([], DDL).schema)
    everything = len(reader.partitions())
    assert everything > 50 and list(reader.pushFilters([archives.GreaterThan(("page_id",), 990), archives.StringContains(("html",), "x")])) == [archives.StringContains(("html",), "x")]
    assert 1 <= len(reader.partitions()) <= 2
    kept = read(spark, path).filter("page_id > 990")
    assert kept.count() == 9 and kept.rdd.getNumPartitions() <= 2
    assert "Filter" not in kept._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    none = read(spark, path).filter("page_id > 5000")
    assert none.count() == 0


def test_empty_tables_and_commits(spark):
    path = scratch(spark, "archive")
    register(spark)
    assert read(spark, path).count() == 0
    write(spark.createDataFrame([], DDL), path)
    assert blocks_of(path) == [] and read(spark, path).count() == 0
    write(spark.createDataFrame(ODD[:2], DDL), path)
    write(spark.createDataFrame(ODD[2:], DDL), path)
    assert sorted(archives.manifests(path)) == [1, 2, 3]
    assert rows(read(spark, path)) == sorted(ODD, key=repr)


def test_refusals(spark):
    path = scratch(spark, "archive")
    table = spark.createDataFrame(ODD, DDL)
    write(table, path)
    for wrong in (table.withColumn("low", F.lit(1)), table.drop("url")):
        with pytest.raises(Exception, match="page archive|columns"):
            write(wrong, path)
    with pytest.raises(Exception, match="appended"):
        table.write.format(FORMAT).mode("overwrite").save(path)
    with pytest.raises(Exception, match="columns"):
        read(spark, path, "page_id long, lang string").count()
    assert read(spark, path).count() == len(ODD)


def test_failed_writes_leave_no_rows(spark):
    path = scratch(spark, "archive")
    write(spark.createDataFrame(ODD, DDL), path)
    broken = spark.range(0, 100, 1, 2).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.lit("h")).cast("string").alias("html"))
    with pytest.raises(Exception):
        write(broken, path)
    assert rows(read(spark, path)) == sorted(ODD, key=repr)


def test_stream_reads_each_commit_once(spark):
    path, out, progress = (scratch(spark, n) for n in ("archive", "stream", "progress"))
    seen = []
    for n, part in enumerate((ODD[:3], [], ODD[3:6], ODD[6:], None)):
        if part is not None:
            write(spark.createDataFrame(part, DDL), path, 50)
            seen += part
        stream = spark.readStream.format(FORMAT).load(path)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
        assert rows(spark.read.schema(DDL).parquet(out).select(*COLUMNS)) == sorted(seen, key=repr), n


def test_top_k_of_stored_sketches_is_near(spark):
    """300 users' worth of items in sketches of 64 entries: counts within the bound, the clear leaders first."""
    rng, path = random.Random(5), scratch(spark, "sketches")
    kinds = [f"k{min(int(rng.paretovariate(0.9)), 300)}" for _ in range(6000)]
    times = [f"2024-01-{1 + i % 6:02d} 05:00:00" for i in range(6000)]
    events = spark.createDataFrame([*zip(times, kinds), (None, "k1"), ("2024-01-01 05:00:00", None)], "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    store_counts(events, path, 64)
    exact = Counter(f"{k}@5" for k in kinds)
    found = most_frequent(spark.read.parquet(path), [F.lit(1).alias("all")], 5, 64).collect()
    assert {r.item for r in found} == {x for x, _ in exact.most_common(5)}
    assert all(abs(r.n - exact[r.item]) <= 3.5 / 64 * len(kinds) for r in found)
    store_counts(events, path + "-wide", 1024)
    wide = most_frequent(spark.read.parquet(path + "-wide"), [F.lit(1).alias("all")], 20, 1024).collect()
    assert sorted((r.n for r in wide), reverse=True) == [n for _, n in exact.most_common(20)]
