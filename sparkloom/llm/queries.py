"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, minmax, mixing, mtree, packing, phrases, pii, resampling, secrets, simhash, spotsigs, toxicity, unigram


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(table(spark, sf_dir, "documents"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_neighbours(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_license_scan, op3_packing, op4_mixing, op5_token_counts, op6_topk_search, op7_simhash_dedup, op8_spotsigs, op9_secret_scan, op10_toxicity, op11_resampling, op12_collocations, op13_minmax_dedup)}


def _packing_sql(buckets: int = packing.BUCKETS, sequence: int = packing.SEQUENCE, budget: int = packing.BATCH_TOKENS, rows: int = packing.GROUP_ROWS) -> str:
    """The dynamic program as one table a level: b<m> has the least padding of the lengths up to each with at most m buckets, and the bounds."""
    levels = "".join(
        f""",
m{m} AS (SELECT j, min(struct_pack(cost := cost, more := more, i := i)) AS best FROM (SELECT j, cost, 0 AS more, j AS i FROM b{m - 1} UNION ALL
    SELECT h.j, p.cost + h.length * (h.c - p.c) - (h.t - p.t), 1, p.j FROM h JOIN b{m - 1} p ON p.j < h.j) GROUP BY j),
b{m} AS (SELECT h.j, h.c, h.t, best.cost AS cost, CASE best.more WHEN 0 THEN p.bounds ELSE list_append(p.bounds, h.length) END AS bounds
    FROM m{m} JOIN h ON h.j = m{m}.j JOIN b{m - 1} p ON p.j = best.i)"""
        for m in range(2, buckets + 1)
    )
    return rf"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
s AS (SELECT doc_id, tokens, unnest(generate_series(0, greatest((tokens + {sequence - 1}) // {sequence} - 1, 0))) AS part FROM d),
r AS (SELECT doc_id, part, least({sequence}, tokens - part * {sequence}) AS length FROM s),
g AS (SELECT length, count(*) AS n FROM r GROUP BY length),
h AS (SELECT length, row_number() OVER (ORDER BY length) AS j, CAST(sum(n) OVER (ORDER BY length) AS BIGINT) AS c, CAST(sum(n * length) OVER (ORDER BY length) AS BIGINT) AS t FROM g),
b1 AS (SELECT j, c, t, length * c - t AS cost, [length] AS bounds FROM h){levels},
u AS (SELECT unnest(bounds) AS bucket FROM b{buckets} WHERE j = (SELECT max(j) FROM h)),
k AS (SELECT doc_id, part, length, (SELECT min(bucket) FROM u WHERE bucket >= length) AS bucket, md5(concat_ws('|', CAST(doc_id AS VARCHAR), CAST(part AS VARCHAR))) AS turn FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY ('0x' || substr(turn, 1, 8))::BIGINT % (SELECT greatest(1, (count(*) + {rows - 1}) // {rows}) FROM r), turn, doc_id, part, length) - 1 AS pos,
    greatest(1, {budget} // greatest(bucket, 1)) AS fits FROM k)
SELECT doc_id, CAST(part AS BIGINT) AS part, CAST(length AS INTEGER) AS length, CAST(bucket AS INTEGER) AS bucket, CAST(pos // fits AS BIGINT) AS batch, CAST(pos % fits AS BIGINT) AS place, CAST(bucket - length AS INTEGER) AS padding FROM n"""


ORACLES: dict[str, str] = {
    "op3_packing": _packing_sql(),
    "op4_mixing": r"""
WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS key,
    ('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % 256 AS block,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
b AS (SELECT key, block, sum(tokens)::BIGINT AS tokens FROM d GROUP BY key, block),
s AS (SELECT key, sum(tokens)::BIGINT AS total FROM b GROUP BY key),
e AS (SELECT CASE WHEN count(*) < 2 THEN 1 WHEN max(total) <= 2 * min(total) THEN 0 ELSE round(1 - ln(2) / ln(max(total) / min(total)), 9) END AS t FROM s WHERE total > 0),
w AS (SELECT key, total, pow(CAST(total AS DOUBLE), (SELECT t FROM e)) AS raised FROM s),
f AS (SELECT sum(raised) AS z, max(total / raised) AS most FROM w WHERE total > 0),
q AS (SELECT key, total, CASE WHEN total > 0 THEN CAST(round(raised / z * (most * z)) AS BIGINT) ELSE 0 END AS quota FROM w, f),
p AS (SELECT key, CASE WHEN total > 0 THEN quota // total ELSE 1 END AS whole, CASE WHEN total > 0 THEN quota % total ELSE 0 END AS rest FROM q),
x AS (SELECT b.key, b.block, b.tokens, whole, rest, unnest(generate_series(0, whole)) AS epoch FROM b JOIN p ON b.key = p.key),
o AS (SELECT *, row_number() OVER g AS place, sum(tokens) OVER g - tokens AS before FROM x
    WINDOW g AS (PARTITION BY key, epoch ORDER BY md5('mix|' || key || '|' || epoch || '|' || block), block ROWS UNBOUNDED PRECEDING))
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, CAST(place AS INTEGER) AS place, md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR))) AS turn
FROM d JOIN o ON d.key = o.key AND d.block = o.block WHERE epoch < whole OR (before < rest AND 2 * (rest - before) > o.tokens)""",
    "op6_topk_search": """
WITH v AS (SELECT vec_id, row_number() OVER () AS at, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.at AS own, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.at <> c.at)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
(SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op12_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
x AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w WHERE len(w) > 0),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM x, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT lang, a, unnest(generate_series(1, k - 1)) AS size, w FROM c),
b AS (SELECT DISTINCT lang, a, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (SELECT *, unnest(generate_series(1, len(w) - size + 1)) AS i FROM s)),
d AS (SELECT lang, phrase, a, w, k FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.lang = c.lang AND b.phrase = c.phrase AND 100 * b.a >= 100 * c.a)),
u AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM d)),
v AS (SELECT u.*, l.a AS l, r.a AS r, n, CAST(1000 * CAST(u.a AS HUGEINT) * n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
    FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.first JOIN f r ON r.lang = u.lang AND r.phrase = u.rest JOIN t ON t.lang = u.lang),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS cut FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z WHERE cut = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000""",
    # crc32 of a feature: each of its bytes goes into the register, then eight steps of the polynomial; both texts' features are hashed once
    "op11_resampling": r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT row_no, w, unnest(generate_series(1, len(w))) AS i FROM (SELECT row_no, w FROM d UNION ALL SELECT NULL, w FROM b) WHERE len(w) > 0),
g AS (SELECT row_no, array_to_string(w[i:i + k - 1], ' ') AS feature FROM i, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
q AS (SELECT DISTINCT feature, hex(encode(feature)) AS h FROM g),
c AS (SELECT feature, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(generate_series(1, len(h) // 2), lambda j: [('0x' || h[2 * j - 1:2 * j])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda r, x: xor(xor(r, x) >> 1, 3988292384 * (xor(r, x) & 1)))) % 10000 AS bucket FROM q),
f AS (SELECT row_no, bucket FROM g JOIN c USING (feature)),
n AS (SELECT bucket, count(*) FILTER (row_no IS NOT NULL) AS s, count(*) FILTER (row_no IS NULL) AS t FROM f GROUP BY bucket),
z AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM n),
a AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000)))) AS BIGINT) AS gain FROM n, z),
m AS (SELECT row_no, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN a USING (bucket) WHERE row_no IS NOT NULL GROUP BY row_no),
e AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m ON d.row_no = m.row_no),
o AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY words >= 20) AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM o""",
}
