"""String, date and math functions on whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import load


@query("""SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, substring(p_type, 1, 3) AS head, CAST(length(p_name) AS INTEGER) AS len, concat_ws('-', p_brand, p_type) AS tag,
replace(p_name, 'e', 'E') AS swapped, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, CAST(instr(p_name, 'a') AS INTEGER) AS at, reverse(p_brand) AS rev,
CAST(levenshtein(p_name, p_type) AS INTEGER) AS dist, trim(concat('  ', p_type, ' ')) AS trimmed, split_part(p_brand, '#', 2) AS part2, sha256(p_name) AS digest, starts_with(p_type, 'S') AS starts FROM part""")
def p60_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"), F.substring("p_type", 1, 3).alias("head"), F.length("p_name").alias("len"), F.concat_ws("-", "p_brand", "p_type").alias("tag"),
        F.replace("p_name", F.lit("e"), F.lit("E")).alias("swapped"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.instr("p_name", "a").alias("at"), F.reverse("p_brand").alias("rev"),
        F.levenshtein("p_name", "p_type").alias("dist"), F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("trimmed"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("part2"), F.sha2("p_name", 256).alias("digest"), F.startswith("p_type", F.lit("S")).alias("starts"),
    )


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]+')) AS INTEGER) AS words, regexp_extract(text, '([0-9]+)', 1) AS digits, md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS masked,
regexp_matches(text, 'the .* of') AS hit FROM documents""")
def p60_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.regexp_count(text, F.lit("[A-Za-z]+")).alias("words"), F.regexp_extract(text, "([0-9]+)", 1).alias("digits"), F.md5(F.regexp_replace(text, "[0-9]+", "#")).alias("masked"), text.rlike("the .* of").alias("hit"))


@query("""SELECT doc_id, list_slice(regexp_extract_all(text, '([A-Za-z]+)[0-9]', 1), 1, 3) AS marked, CAST(len(string_split(text, ' ')) AS INTEGER) AS cuts, string_split(lang, 'n') AS parts,
translate(lang, 'en', 'xy') AS swapped, CAST(position('the' IN text) AS INTEGER) AS at FROM documents""")
def p60_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words before a digit, pieces between blanks, and places."""
    text = F.col("text")
    marked = F.slice(F.regexp_extract_all(text, F.lit("([A-Za-z]+)[0-9]"), F.lit(1)), 1, 3)
    return load(spark, sf_dir, "documents").select("doc_id", marked.alias("marked"), F.size(F.split(text, " ", -1)).alias("cuts"), F.split("lang", "n").alias("parts"), F.translate("lang", "en", "xy").alias("swapped"), F.position(F.lit("the"), text).alias("at"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d,
CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start, CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS INTEGER) AS days,
CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS next_month, strftime(o_orderdate, '%Y/%m/%d') AS shown, last_day(o_orderdate) AS month_end, CAST(epoch(o_orderdate) AS BIGINT) AS unix FROM orders""")
def p61_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(at).alias("y"), F.quarter(at).alias("q"), F.month(at).alias("m"), F.day(at).alias("d"), F.dayofweek(at).alias("dow"), F.date_trunc("month", at).cast("timestamp_ntz").alias("month_start"),
        F.datediff(at, F.lit("1995-01-01").cast("date")).alias("days"), F.add_months(at, 1).alias("next_month"), F.date_format(at, "yyyy/MM/dd").alias("shown"), F.last_day(at).alias("month_end"), F.unix_timestamp(at.cast("timestamp")).alias("unix"),
    )


@query("""SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 8) AS root, round(ln(l_extendedprice), 8) AS log, round(power(l_discount, 2), 8) AS sq, abs(l_tax - 0.05) AS gap, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS low,
CAST(ceil(l_extendedprice / 1000) AS BIGINT) AS high, l_partkey % 7 AS rest, CAST(sign(l_discount - 0.05) AS DOUBLE) AS sgn, greatest(l_quantity, 10) AS most, CASE WHEN l_quantity < 10 THEN 's' WHEN l_quantity < 30 THEN 'm' ELSE 'l' END AS size,
coalesce(nullif(l_linenumber, 1), 0) AS ln0 FROM lineitem""")
def p62_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.sqrt(q), 8).alias("root"), F.round(F.ln("l_extendedprice"), 8).alias("log"), F.round(F.pow("l_discount", F.lit(2)), 8).alias("sq"), F.abs(F.col("l_tax") - 0.05).alias("gap"),
        F.floor(F.col("l_extendedprice") / 1000).alias("low"), F.ceil(F.col("l_extendedprice") / 1000).alias("high"), (F.col("l_partkey") % 7).alias("rest"), F.signum(F.col("l_discount") - 0.05).alias("sgn"),
        F.greatest(q, F.lit(10.0)).alias("most"), F.when(q < 10, "s").when(q < 30, "m").otherwise("l").alias("size"), F.coalesce(F.nullif("l_linenumber", F.lit(1)), F.lit(0)).alias("ln0"),
    )
