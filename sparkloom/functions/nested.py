"""Arrays, maps, JSON and variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import load


@query("""SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS norm2,
CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive, list_max(embedding) AS most, embedding[1:3] AS head, CAST(list_position(embedding, list_min(embedding)) AS BIGINT) AS lowest_at FROM embeddings""")
def p63_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    norm = F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return load(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(v).alias("dims"), F.round(norm, 5).alias("norm2"), F.size(F.filter(v, lambda x: x > 0)).alias("positive"), F.array_max(v).alias("most"), F.slice(v, 1, 3).alias("head"), F.array_position(v, F.array_min(v)).alias("lowest_at")
    )


@query("""SELECT vec_id, list_sort(embedding)[1:2] AS lowest, list_reverse_sort(embedding)[1:2] AS highest,
round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 5) AS mirrored,
CAST(len(list_distinct(list_transform(embedding, lambda x: x > 0))) AS INTEGER) AS signs, list_contains(embedding, embedding[1]) AS has_first FROM embeddings""")
def p63_sorted_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    products = F.zip_with(v, F.reverse(v), lambda a, b: a.cast("double") * b.cast("double"))
    return load(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice(F.array_sort(v), 1, 2).alias("lowest"), F.slice(F.sort_array(v, asc=False), 1, 2).alias("highest"), F.round(F.aggregate(products, F.lit(0.0), lambda a, x: a + x), 5).alias("mirrored"),
        F.size(F.array_distinct(F.transform(v, lambda x: x > 0))).alias("signs"), F.array_contains(v, F.get(v, 0)).alias("has_first"),
    )


@query("""SELECT label, CAST(i AS INTEGER) AS i, count(*) AS n, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM
(SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i""")
def p63_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return rows.groupBy("label", "i").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("""SELECT user_id, max(n) FILTER (event_type = 'click') AS clicks, string_agg(event_type, ',' ORDER BY event_type) AS kinds, sum(n)::BIGINT AS total
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def p64_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))
    return counts.groupBy("user_id").agg(m.alias("m")).select(
        "user_id", F.try_element_at("m", F.lit("click")).alias("clicks"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("kinds"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total")
    )


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS number FROM events")
def p65_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.from_json("props", "k BIGINT").getField("k").alias("number"))


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def p65_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = load(spark, sf_dir, "events").select("event_type", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))
    return parsed.groupBy("event_type").agg(F.sum("k").alias("total"))


@query("""WITH j AS (SELECT event_type, CAST(CASE event_type WHEN 'error' THEN '{"k": "x' || event_id || '", "more": [1, 2]}' WHEN 'signup' THEN '{"k": null, "deep": {"k": true}}' WHEN 'click' THEN '[1, 2]' ELSE props END AS JSON) AS v FROM events),
k AS (SELECT event_type, v, unnest(json_keys(v)) AS key FROM j WHERE json_type(v) = 'OBJECT'),
t AS (SELECT event_type, key, json_type(v, '$.' || key) AS t, v FROM k)
SELECT event_type, key, CASE t WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID' WHEN 'ARRAY' THEN 'ARRAY<BIGINT>' WHEN 'OBJECT' THEN 'OBJECT<k: BOOLEAN>' END AS kind,
count(*) AS n, CAST(sum(CASE WHEN t = 'UBIGINT' THEN CAST(json_extract_string(v, '$.' || key) AS BIGINT) END) AS BIGINT) AS total FROM t GROUP BY ALL""")
def p65_variant_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields and types of JSON of unknown shape: missing, null, nested and mistyped fields, and values that are no objects (they have no fields). A value that isn't a number adds nothing to the total."""
    events = load(spark, sf_dir, "events").select("event_id", "event_type", "props")
    text = F.expr("""CASE event_type WHEN 'error' THEN '{"k": "x' || event_id || '", "more": [1, 2]}' WHEN 'signup' THEN '{"k": null, "deep": {"k": true}}' WHEN 'click' THEN '[1, 2]' ELSE props END""")
    return spark.sql(
        """SELECT event_type, key, schema_of_variant(value) AS kind, count(*) AS n, sum(try_variant_get(value, '$', 'bigint')) AS total
        FROM {rows}, LATERAL variant_explode(v) WHERE key IS NOT NULL GROUP BY event_type, key, kind""",
        rows=events.select("event_type", F.try_parse_json(text).alias("v")),
    )
