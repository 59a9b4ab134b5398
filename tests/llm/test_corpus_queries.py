"""The registered queries against their SQL, and the pipeline."""

import math
import re
from collections import Counter

import pytest
from compare import duck, same, type_names

import __spark_entry__ as entry
import corpus_pipeline
from sparkloom.llm import queries, toxicity
from sparkloom.llm.common import settle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duck(SF)
    df = queries.QUERIES[name](spark, SF)
    same(df, con, queries.ORACLES[name])
    assert type_names(df, con, queries.ORACLES[name]) == []


def test_all_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike_groups(texts):
    """The least place in each text's group: links are pairs of sets with a likeness of 0.8 or more."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a | sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j])):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def buckets(text):
    data, seen = [*f" {text.lower()} ".encode()], set()
    for n in (3, 4, 5, 6):
        for i in range(len(data) - n + 1):
            h = 0
            for c in data[i : i + n]:
                h = (h * 0x01000193 + c) % (1 << 32)
            seen.add((h + n) * 0x9E3779B1 % (1 << 32) >> 10)
    return seen


def plain_score(model, text):
    at = [p - 1 for b in buckets(text) if (p := int(model.features.places[b]))]
    return 1 / (1 + math.exp(-(sum(float(model.coefficients[p]) * float(model.features.ratios[p]) for p in at) + model.bias)))


SHAPES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"\+[0-9][\x20().0-9-]{7,}[0-9]"]


def test_stages(spark):
    """Each stage against a plain version of what it is to do."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, SF))
        was, now = ([r.asDict() for r in df.collect()] for df in (before, docs))
        kept[name] = now
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
            few = [r for r in was if len(r["text"]) < 4000]
            assert {r["doc_id"] for r in now} & {r["doc_id"] for r in few} == {r["doc_id"] for r in few if plain_score(model, r["text"]) < 0.3}
        elif name == "near_dedup":
            was.sort(key=lambda r: r["doc_id"])
            firsts = {was[i]["doc_id"] for i in set(alike_groups([r["text"] for r in was]))}
            left = {r["doc_id"] for r in now}
            assert left >= firsts and len(left) <= len(firsts) + 2
            assert len({r["text"] for r in now}) == len(now)
        elif name == "pii":
            assert len(now) == len(was) and all(r["n_chars"] == len(r["text"]) for r in now)
            assert not any(re.search(p, r["text"]) for p in SHAPES[:1] for r in now)
            plain = {r["doc_id"]: r["text"] for r in was}
            assert all(r["text"] == plain[r["doc_id"]] for r in now if not re.search("[0-9@]", plain[r["doc_id"]]))
            assert any("[EMAIL]" in r["text"] for r in now)
        elif name == "mixing":
            times = Counter(r["doc_id"] for r in now)
            assert set(times) == {r["doc_id"] for r in was} and max(times.values()) <= 2
        if name != "packing":
            assert docs.columns == schema
    words = sum(len((r["text"] or "").encode().split()) for r in kept["mixing"])
    assert sum(r["length"] for r in kept["packing"]) == words
    assert corpus_pipeline.run(spark, SF).count() == len(kept["packing"])


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, odd_rows, tmp_path):
    labels = spark.createDataFrame([*((i, None, 0) for i in (1, 2, 3, 4, 5, 7, 9, 11, 12)), (None, 1, 1), (6, 0, 1), (10, 1, None)], "doc_id long, quality int, toxic int")
    for name, docs, marks in (("odd", odd, labels), ("unlabelled", odd, labels.limit(0)), ("none", none, labels.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    rows = corpus_pipeline.run(spark, f"{tmp_path}/unlabelled").collect()
    groups = alike_groups([r[1] for r in odd_rows])
    words = {len((odd_rows[i][1] or "").encode().split()) for i in set(groups)}
    per = Counter()
    for r in rows:
        per[r.doc_id] += r.length
    assert all(n in words or n // 2 in words for n in per.values()) and None in per
    assert corpus_pipeline.run(spark, f"{tmp_path}/odd").count() > 0
