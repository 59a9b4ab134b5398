"""Min-max hashing: sets, signatures and groups against plain versions, crowds of one bucket, and odd tables."""

import random
import re

import numpy as np
from samples import prose

from sparkloom.llm import likeness, minmax
from sparkloom.llm import queries as corpus

SF = "/root/testdata/sf0.001"


def plain_set(text, n=2):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def plain_groups(rows):
    """{doc_id: (size, component)} by all pairs."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and root[i] != root[j] and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
    least = {}
    for (doc_id, _), r in zip(rows, root):
        least[r] = min(least.get(r, doc_id), doc_id)
    return {doc_id: (len(s), least[r]) for (doc_id, _), s, r in zip(rows, sets, root)}


def held_against_pairs(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected = plain_groups(rows)
    found = minmax.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held_against_pairs(docs)
    assert corpus.QUERIES["op13_minmax_dedup"](spark, SF).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_edits_around_the_bound(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        words = prose(rng, rng.randrange(3, 200)).split()
        texts.append(" ".join(words))
        for share in (0.03, 0.06, 0.1, 0.15):
            copy = words[:]
            for _ in range(max(1, int(share * len(words) / 2))):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    held_against_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_crowd_of_one_bucket(spark):
    """Texts of the same paragraphs with a tail of their own: nearly all share buckets, few are alike."""
    rng = random.Random(8)
    body = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
    texts = []
    for _ in range(70):
        tail = " ".join(f"t{rng.randrange(10**6)}" for _ in range(90))
        texts += [f"{body} {tail}", f"{body} {tail} again and again"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held_against_pairs(docs)
    found = minmax.near_duplicates(docs)
    assert sum(r.kept for r in found.collect()) == 70


def test_parts_of_a_crowd_meet(spark):
    """A bucket over the bound is cut to parts; each pair of different groups still meets, pairs of one group don't."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, likeness.SKETCH, np.uint8)
    rows = []
    for k in range(50):
        sketch = base.copy() if k % 2 else rng.integers(0, 256, likeness.SKETCH, np.uint8)
        rows.append((1, k, 100 if k != 3 else 10, k if k > 10 else 0, bytes(sketch)))
    members = spark.createDataFrame(rows, "bucket long, class long, size long, root long, sketch binary")
    placed, sketches = members.drop("sketch"), members.select("class", "sketch")
    alike = [k for k in range(50) if k % 2 and k != 3]
    expected = {(a, b) for a in alike for b in alike if a < b and (a if a > 10 else 0) != (b if b > 10 else 0)}
    for crowd in (7, 1000):
        assert {(r.a, r.b) for r in likeness.left_over(placed, sketches, 80, 100, crowd).collect()} == expected


def test_crowd_that_agrees_costs_no_pairs(spark, monkeypatch):
    """Near copies of one text, some alike and some just not: what the tasks find grows with the members, not with their pairs, and no link is lost."""
    rng = random.Random(5)
    body = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for k in range(160):
        copy = body[:]
        for at in rng.sample(range(120), rng.randrange(5, 14)):
            copy[at] = f"n{rng.randrange(40)}"
        texts.append(" ".join(copy))
    made = []

    def counted(find):
        def run(*args, **named):
            made.append((args[0], find(*args, **named).count()))
            return find(*args, **named)

        return run

    for name in ("left_over", "linked"):
        monkeypatch.setattr(minmax, name, counted(getattr(likeness, name)))
    held_against_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert len(made) == 2 and made[0][1] < 48 * 160 and made[1][1] < 160


def test_whole_sets_meet_in_parts(spark):
    """Links of the sets in parts of any size join the same groups, with fewer links than groups in each task."""
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(200) > rng.uniform(0, 0.2)], rng.integers(0, 1 << 63, rng.integers(0, 20)).astype(np.uint64)])) for _ in range(60)]
    sets[7] = base[:0]  # can't link
    size = [len(s) for s in sets]

    def joined(pairs):
        root = [k if k > 9 else 0 for k in range(60)]
        for a, b in pairs:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
        return root

    both = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(60) for b in range(a)}
    plain = joined([p for p, n in both.items() if 100 * n >= 80 * (size[p[0]] + size[p[1]] - n) and size[p[0]] and size[p[1]]])
    placed = spark.createDataFrame([(1, k, size[k], k if k > 9 else 0) for k in range(60)], "bucket long, class long, size long, root long")
    held = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(sets)], "class long, set binary")
    for crowd, most in ((1000, 10**6), (9, 10**6), (1000, 900)):
        found = [(r.a, r.b) for r in likeness.linked(placed, held, 80, 100, crowd, most).collect()]
        assert joined(found) == plain and len({frozenset(p) for p in found}) == len(found)
        assert all(100 * both[max(p), min(p)] >= 80 * (size[p[0]] + size[p[1]] - both[max(p), min(p)]) for p in found)
        if crowd == 1000 and most == 10**6:
            assert len(found) < 51
    assert 1 < len(set(plain)) < 51


def test_minima_and_maxima_agree_as_often_as_sets_are_alike():
    factors, summands = minmax.permutations(600)
    a = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 900).astype(np.uint64))
    x, y = (minmax.min_max(part, factors, summands) for part in (a[:750], a[150:]))
    turned = [[(f * e + s) % 2**64 for e in a[:750].tolist()] for f, s in zip(factors.tolist(), summands.tolist())]
    assert x.tolist() == [v for h in turned for v in (min(h), max(h))]
    for part in (slice(0, None, 2), slice(1, None, 2)):
        assert abs((x[part] == y[part]).mean() - 600 / 900) < 0.08
    assert np.array_equal(minmax.bands(x), minmax.bands(minmax.min_max(a[:750][::-1], factors, summands)))


def test_odd_rows(odd, none):
    found = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minmax.near_duplicates(odd).collect()), key=repr)
    by_id = {r[0]: r[1:] for r in found}
    assert len(found) == odd.count()
    assert [by_id[k] for k in (1, 2, 3)] == [(0, 1, True), (0, 2, True), (0, 3, True)]  # empty: linked with nothing
    assert by_id[4] == (1, 4, True) and by_id[13] == (3, 12, False) and found.count((12, 3, 12, True)) == 2
    assert by_id[0][2] is False  # no id
    assert minmax.near_duplicates(none).collect() == []
