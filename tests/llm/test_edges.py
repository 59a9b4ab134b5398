"""Every operator over odd rows and over no rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import licenses, mixing, mtree, packing, pii, secrets, simhash, spotsigs, toxicity, unigram

PER_ROW = {
    "pii": pii.find_pii,
    "licenses": licenses.scan_licenses,
    "tokens": unigram.count_tokens,
    "simhash": simhash.near_duplicates,
    "spotsigs": spotsigs.compare_neighbours,
    "secrets": secrets.scan_secrets,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_each(odd, none, odd_rows, name):
    found = PER_ROW[name](odd).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in odd_rows)
    assert PER_ROW[name](none).collect() == []


def test_toxicity(spark, odd, none, odd_rows):
    labels = spark.createDataFrame([(i, None, int(i in (6, 10))) for i in range(1, 14)] + [(None, 1, 1), (4, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    found = toxicity.score_toxicity(odd, model).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert all((r.held_out is None) == (r.doc_id is None) for r in found)
    assert toxicity.score_toxicity(none, model).collect() == []
    unlabelled = toxicity.train(odd, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.score_toxicity(odd, unlabelled).collect()} == {0.0}
    assert toxicity.keep_clean(odd, unlabelled).count() == len(odd_rows)
    assert toxicity.keep_clean(odd, unlabelled).columns == odd.columns
    assert toxicity.train(none, labels).bias < 0


def test_packing(odd, none, odd_rows):
    found = packing.pack(odd).collect()
    assert {r.doc_id for r in found} == {r[0] for r in odd_rows}
    assert sum(r.length for r in found) == sum(len((r[1] or "").encode().split()) for r in odd_rows)
    assert packing.pack(none).collect() == []


def test_packing_of_many_rows_without_an_id(spark):
    rows = [(None, "a b c")] * 3000 + [(None, "a")] * 10 + [(7, "x y")] * 5000 + [(8, "z")]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), buckets=2, batch_tokens=64).collect()
    assert Counter((r.doc_id, r.length) for r in found) == Counter((i, len(t.split())) for i, t in rows)
    for bound in {r.bucket for r in found}:
        fits = max(1, 64 // bound)
        numbers = sorted(r.batch * fits + r.place for r in found if r.bucket == bound)
        assert numbers == list(range(len(numbers))) and all(r.place < fits for r in found if r.bucket == bound)


def test_mixing(odd, none, odd_rows):
    found = mixing.mix(odd).collect()
    assert Counter(r.doc_id for r in found if r.epoch == 0) == Counter(r[0] for r in odd_rows)
    assert mixing.mix(none).collect() == []
    clashing = odd.withColumn("epoch", F.lit(1)).withColumn("turn", F.lit("t"))
    again = mixing.repeated(clashing)
    assert again.columns == clashing.columns and Counter(r.doc_id for r in again.collect()) == Counter(r.doc_id for r in found)


def test_keep_one_and_redact_keep_columns(odd, none, odd_rows):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect() if r.text == "same text here again") == [12]
    assert simhash.keep_one(none).collect() == []
    red = pii.redact(odd)
    assert red.columns == odd.columns and red.dtypes == odd.dtypes
    assert Counter(r.text for r in red.collect()) == Counter(r[1] for r in odd_rows)
    assert pii.redact(none).collect() == []


def test_top_k(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, []), (8, [-1.0])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    found = mtree.top_k(vectors, lambda i: i % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in found if r.query_id == 0] == [(1, 1, 1 << 20), (2, 2, 1 << 20), (3, 2, 1 << 20), (4, 100, 1 << 19), (5, 7, 0), (6, 8, -(1 << 20))]
    two = spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.9, 0.0]), (200, [0.0, 1.0]), (200, [0.0, 0.5])], "vec_id long, embedding array<double>")
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.top_k(two, lambda i: i % 100 == 0).collect())
    assert [x for x in found if x[0] == 100] == [(100, 1, 1, 1024 * 921), (100, 2, 1, 1024 * 512), (100, 3, 200, 0), (100, 4, 200, 0)]
    assert [x for x in found if x[0] == 200 and x[1] == 1] == [(200, 1, 200, 1024 * 512)] * 2
    assert mtree.top_k(vectors.limit(0), lambda i: i % 100 == 0).collect() == []
    assert mtree.top_k(vectors.filter(F.col("vec_id") == 0), lambda i: i % 100 == 0).collect() == []


def test_columns_with_the_operators_own_names(odd):
    clashing = odd.withColumns({f"_{a}_{b}": F.lit(f"{a}{b}") for a, b in (("pii", "id"), ("pii", "text"), ("pii", "spots"), ("mix", "key"), ("mix", "pass"), ("kept", "id"), ("kept", "text"))})
    for found in (pii.redact(clashing), mixing.repeated(clashing), simhash.keep_one(clashing), simhash.keep_alike(clashing)):
        assert found.columns == clashing.columns
        assert {(r["_pii_id"], r["_mix_key"], r["_kept_id"]) for r in found.collect()} == {("piiid", "mixkey", "keptid")}


def test_similar_pairs_of_odd_rows(odd, none, odd_rows):
    pairs, members = spotsigs.similar_pairs(odd)
    assert Counter(r.doc_id for r in members.collect()) == Counter(r[0] for r in odd_rows if r[0] is not None)
    assert {r["class"] for r in members.collect() if r.doc_id in (12, 13)} == {12}
    assert all(r.a < r.b and r.likeness >= 0.8 for r in pairs.collect())
    assert [x.collect() for x in spotsigs.similar_pairs(none)] == [[], []]


def test_spotsigs_of_many_rows_without_an_id(spark):
    rows = [(None, f"the river and stone {i % 3}") for i in range(600)] + [(i, f"of a market {i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = spotsigs.compare_neighbours(docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    nameless = Counter(r.fingerprint for r in found if r.doc_id is None)
    assert sorted(nameless.values()) == [200, 200, 200]
    assert sum(r.near_next == 1 for r in found if r.doc_id is None) >= 597
