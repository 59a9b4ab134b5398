"""Importance resampling: features, cutoff and ranks against plain versions, ties and odd tables. The whole query is held against SQL by its oracle."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from compare import duck, same
from samples import prose

from sparkloom.llm import queries as corpus
from sparkloom.llm import resampling

SF = "/root/testdata/sf0.001"


def plain_features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def plain(docs, target, share=5, of=100, least=20):
    """(doc_id, n_features, weight, score, rank) of each (doc_id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    found = [plain_features(t) for _, t in docs]
    s, t = (Counter(bucket(f) for fs, _ in rows for f in fs) for rows in (found, [plain_features(x) for x in target]))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000))))
    rows = []
    for (doc_id, _), (fs, words) in zip(docs, found):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        rows.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * share // of]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def held(spark, docs, target, **options):
    df, to = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(df, to, **options)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(docs, target, **{"share": 5, "of": 100} | {k: v for k, v in options.items() if k in ("share", "of")})


def test_query_against_sql(spark):
    same(corpus.QUERIES["op11_resampling"](spark, SF), duck(SF), corpus.ORACLES["op11_resampling"])


def test_against_a_plain_version(spark):
    rng = random.Random(2)
    docs = [(k, prose(rng, rng.randrange(0, 90)) + " Ärger 日本 x_y it's " * (k % 3)) for k in range(150)]
    docs += [(7, docs[7][1])] * 40 + [(None, prose(rng, 30)), (None, prose(rng, 30)), (201, None), (202, ""), (203, "..."), (204, "w" * 100_000 + " b c"), (205, prose(rng, 30_000))]
    target = [prose(rng, 20) + " velvet copper" for _ in range(5)] + [None, ""]
    for share in (5, 30, 100, 0):
        held(spark, docs, target, share=share)
    held(spark, docs, [])
    held(spark, [], target)
    held(spark, [(1, "too short")], target)


def test_ties_on_score_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(k, s) for s, n in ((9, 3), (5, 40), (-4, 7), (-(10**12), 2)) for k in range(n)], "doc_id long, score long").repartition(5)
    ranked = sorted((r.score for r in rows.collect()), reverse=True)
    for wanted in (1, 3, 4, 43, 44, 50, 51, 52):
        assert resampling.cutoff(rows, "score", wanted, True) == ranked[wanted - 1]
        assert resampling.cutoff(rows, "doc_id", wanted, False) == sorted(r.doc_id for r in rows.collect())[wanted - 1]


def test_crc_of_joined_words():
    rng = random.Random(0)
    texts = [" ".join("".join(rng.choices("abcxyzäß日", k=rng.choice([1, 2, 7, 90, 300]))) for _ in range(rng.randrange(12))) for _ in range(40)]
    bucket, of, words = resampling.features(texts, resampling.Zeros(), resampling.Vocabulary())
    found = [Counter(bucket[of == k].tolist()) for k in range(len(texts))]
    assert found == [Counter(zlib.crc32(f.encode()) % 10000 for f in plain_features(t)[0]) for t in texts]
    assert words.tolist() == [plain_features(t)[1] for t in texts]


def test_odd_rows(spark, odd, none, odd_rows):
    found = resampling.resample(odd, odd.select("text", "score"), share=50)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain([r[:2] for r in odd_rows], [r[1] for r in odd_rows], share=50)
    assert resampling.resample(none, none).collect() == []
