"""The pipeline's near_dedup stage against all pairs of texts: nothing goes that isn't alike, and most of what is goes, even with few different words and edits close to the bound."""

import random

import numpy as np
import pandas as pd
from samples import prose

import corpus_pipeline
from sparkloom.llm import simhash
from sparkloom.llm.common import settle
from sparkloom.llm.likeness import CUT, WordHashes, shingles


def edited(rng: random.Random, text: str, edits: int) -> str:
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def groups(texts: list) -> list[int]:
    """The least place in each text's group, by all pairs."""
    sets = [set(shingles(t or "", 5, WordHashes()).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if (not a and not sets[j]) or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def held(spark, texts: list, recall: float) -> None:
    root = groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()}
    assert left >= set(root)
    assert len(texts) - len(left) >= recall * (len(texts) - len(set(root)))


def test_crowds(spark):
    """Texts of the same paragraphs in orders of their own, each with an edited copy: one crowd of word fingerprints in which only pairs are alike."""
    rng = random.Random(5)
    paragraphs = [prose(rng, 4) for _ in range(40)]
    texts = []
    for _ in range(150):
        rng.shuffle(paragraphs)
        text = " ".join(paragraphs)
        texts += [text, edited(rng, text, 2)]
    held(spark, texts, 0.95)


def test_a_menu_of_equal_words(spark):
    """The same words in other orders have equal fingerprints of words; copies with one word more must be found among them."""
    rng = random.Random(7)
    words = [f"item{k}" for k in range(60)]
    texts = []
    for _ in range(80):
        rng.shuffle(words)
        texts += [" ".join(words), " ".join([*words, "more"])]
    held(spark, texts, 0.95)


def test_partners_that_are_left_out_are_marked():
    """Every pair within reach is proposed or has both ends marked, for owners and visitors alike."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    points = np.unique(np.concatenate([base, *(base[: 60 // k] ^ np.uint64(1 << 7 * k) for k in range(1, 7)), *(base[:4] ^ np.uint64(1 << k) for k in range(40))]))
    rng.shuffle(points)
    rows = pd.DataFrame({"size": rng.integers(90, 110, len(points)), "many": rng.random(len(points)) < 0.02})
    for cut, within in ((len(points), True), (len(points) // 2, True), (len(points) // 2, False)):
        a, b = simhash.partners(points[:cut], points[cut:], within, rows[:cut], rows[cut:])
        name = {int(p): k for k, p in enumerate(points.view(np.int64))}
        pairs = {(name[x], name[y]) for x, y in zip(a.tolist(), b.tolist())}
        marked = {x for x, y in pairs if x == y}
        for i in range(len(points)):
            for j in range(i):
                meets = (within or i >= cut) and j < cut
                fits = rows.many[i] or rows.many[j] or 5 * min(rows["size"][i], rows["size"][j]) >= 4 * max(rows["size"][i], rows["size"][j])
                if meets and fits and int(points[i] ^ points[j]).bit_count() <= simhash.RADIUS:
                    assert (i, j) in pairs or (j, i) in pairs or {i, j} <= marked
                    if rows.many[i] or rows.many[j]:
                        assert {i, j} <= marked


def strangers_by_all_pairs(points, rows, meets):
    """The pairs of places that `strangers` is to join, by all pairs."""
    sketches = np.array([list(x) for x in rows.sketch], np.uint8)
    size, root = rows["size"].to_numpy(), rows.root.to_numpy()
    pairs = [(i, j) for i in range(len(points)) for j in range(i) if meets(i, j) and root[i] != root[j] and int(points[i] ^ points[j]).bit_count() <= simhash.RADIUS]
    return [(i, j) for i, j in pairs if 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j]) and (sketches[i] == sketches[j]).mean() >= CUT]


def joined(root, pairs) -> list:
    root = list(root)
    for i, j in pairs:
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    return root


def test_strangers_are_joined_by_fewer_pairs_than_points():
    """A crowd whose members all agree gives pairs by its members, not by their square, and these join what all pairs join."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    points = np.unique(np.concatenate([*(base ^ np.uint64(1 << k) for k in range(14)), *(base ^ np.uint64(3 << k) for k in range(20, 34))]))
    rng.shuffle(points)
    n = len(points)
    sketches = rng.integers(0, 256, (3, 192), np.uint8)[rng.integers(0, 3, n)]
    sketches[rng.random((n, 192)) < 0.08] = 1
    rows = pd.DataFrame({"name": rng.permutation(n) + 1000, "size": rng.choice([80, 90, 120], n), "root": np.where(rng.random(n) < 0.3, 5, 10 + np.arange(n)), "sketch": [x.tobytes() for x in sketches]})
    place = {name: k for k, name in enumerate(rows.name)}
    for cut, within in ((n, True), (n // 2, True), (n // 2, False)):
        a, b = simhash.strangers(points[:cut], points[cut:], within, rows[:cut], rows[cut:])
        found = [tuple(sorted((place[x], place[y]), reverse=True)) for x, y in zip(a.tolist(), b.tolist())]
        every = strangers_by_all_pairs(points, rows, lambda i, j, cut=cut, within=within: j < cut and (within or i >= cut))
        assert set(found) <= set(every)
        assert joined(rows.root, found) == joined(rows.root, every)
        assert len(found) == len(set(rows.root)) - len(set(joined(rows.root, every))) < len(every)


def test_both_ends_of_what_agrees_are_in_one_bucket(spark):
    """Of a crowd each class that may be alike to one of another group is kept, the least of all included; groups that nothing agrees with are not."""
    rng = np.random.default_rng(8)
    names = [-900, -50, 3, 40, 41, 700, 800, 801]
    sketches = {k: rng.integers(0, 256, 192, np.uint8).tobytes() for k in range(3)}
    family = dict(zip(names, (0, 0, 0, 1, 1, 2, 2, 2)))
    printed = spark.createDataFrame([(c, 100, 0, 1 << k) for k, c in enumerate(names)], "class long, size long, tab int, fp long")
    classes = spark.createDataFrame([(c, sketches[family[c]]) for c in names], "class long, sketch binary")
    roots = spark.createDataFrame([(-50, -900), (41, 40)], "node long, root long")
    found = simhash.left_in_crowds(printed, printed.select("tab", "fp"), classes, roots).collect()
    buckets = {}
    for r in found:
        buckets.setdefault(r.bucket, set()).add((r["class"], r.size, r.root))
    assert sorted(map(sorted, buckets.values())) == [[(-900, 100, -900), (-50, 100, -900), (3, 100, 3)], [(700, 100, 700), (800, 100, 800), (801, 100, 801)]]


def test_a_family_about_the_bound_costs_no_pairs(spark, monkeypatch):
    """Near copies of one text, some alike and some just not: the second search and what it links give rows by its members, and all copies go."""
    rng = random.Random(5)
    body = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = []
    for _ in range(160):
        copy = body[:]
        for at in rng.sample(range(300), rng.randrange(3, 11)):
            copy[at] = f"n{rng.randrange(40)}"
        texts.append(" ".join(copy))
    made = []

    def counted(fps, search=simhash.stars, *args, _search=simhash.search_shards):
        found = settle(_search(fps, search, *args))
        made.append((search.__name__, fps.count(), found.count()))
        return found

    monkeypatch.setattr(simhash, "search_shards", counted)
    held(spark, texts, 1.0)
    (_, given, rows), = (m for m in made if m[0] == "strangers")
    assert given > 100 and rows < given


def test_stage_keeps_one_of_each_group_of_alike_texts(spark):
    rng = random.Random(11)
    line = prose(rng, 30)
    texts = ["", " \t", None, "one two", "One  two", "one two three", *(f"{line} {prose(rng, 12)}" for _ in range(40))]
    first = prose(rng, 200)
    texts += [first, *(edited(rng, first, 1 + k % 4) for k in range(60))]
    for _ in range(40):
        base = prose(rng, rng.randrange(20, 400))
        texts += [base, *(edited(rng, base, rng.randrange(1, 8)) for _ in range(2))]
    root = groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert left >= set(root)  # only texts that links join to one with a smaller id go
    assert len(texts) - len(left) >= 0.9 * (len(texts) - len(set(root)))
    assert len(left) < simhash.keep_one(docs).count()


def test_odd_rows(odd, none):
    kept = simhash.keep_alike(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect() if r.text == "same text here again") == [12]
    assert simhash.keep_alike(none).collect() == []
