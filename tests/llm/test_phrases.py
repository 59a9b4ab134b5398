"""Collocations: against counts of all phrases, with forced collisions of fingerprints, large numbers, ties and odd tables."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
from compare import duck, same
from samples import prose

from sparkloom.llm import phrases
from sparkloom.llm import queries as corpus
from sparkloom.llm.likeness import WordHashes

SF = "/root/testdata/sf0.001"


def plain(rows, least, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang or "und"] += len(w)
            f.update((lang or "und", w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    cands = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = lambda short, long: any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))
    out = {}
    for (lang, w), a in cands.items():
        if any(x == lang and len(o) > len(w) and b >= a and inside(w, o) for (x, o), b in cands.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def some_rows():
    rng = random.Random(6)
    line = "The quick-brown fox; jumps over the lazy dog"
    rows = [(rng.choice(["en", "en", "de", None, "und"]), " ".join([prose(rng, rng.randrange(60)).upper(), line * rng.randrange(3), "a a a a a a", "Ä ß x\tÄ ß x", "one.two\nthree four!one"])) for _ in range(90)]
    return [*rows, ("en", None), ("fr", ""), ("fr", " .;\n"), ("x", "b " * 30_000)]


def test_query_against_sql(spark):
    same(corpus.QUERIES["op12_collocations"](spark, SF), duck(SF), corpus.ORACLES["op12_collocations"])


def test_against_all_counts_with_and_without_collisions(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(lang, text, 1.0, "k") for lang, text in rows], "lang string, text string, score double, phrase string").repartition(5)
    expected = plain(rows, 12)
    assert len(expected) > 50
    for bits in (64, 8):  # 8: 256 fingerprints, so nearly every one is shared
        assert sorted(tuple(r) for r in phrases.collocations(docs, 12, printer=phrases.Printer(bits)).collect()) == expected
    assert sorted(tuple(r) for r in phrases.collocations(docs, 12, top=7).collect()) == plain(rows, 12, 7)


def test_runs_and_pieces():
    words = phrases.tokens("A b; c\td\n\n e")
    assert words == [b"a", b"b", b"", b"c", b"d", b"", b"e", b""]
    h = phrases.hashed(words, WordHashes())
    assert [i for i in range(8) if h[i] == 0] == [2, 5, 7]
    assert np.flatnonzero(phrases.inside(h, 2)).tolist() == [0, 3]
    lang = np.full(8, np.uint64(3))
    double = np.concatenate([h, h]), np.concatenate([lang, lang])
    for n in range(1, 6):
        prints = phrases.Printer().runs(*double, n)
        assert np.array_equal(prints[: 8 - n + 1], prints[8:])  # the same wherever it stands
        assert len(set(prints[: 8 - n + 1].tolist())) == len(set(map(tuple, (h[i : i + n].tolist() for i in range(8 - n + 1)))))


def test_more_words_than_are_remembered(spark):
    """Pieces still end, and are not counted as words, when the memory of words has been emptied in the midst of a text."""
    words = [b"w%d" % i for i in range((1 << 18) + 9)]
    assert np.flatnonzero(phrases.hashed([*words, b"", b"a", b""], WordHashes()) == 0).tolist() == [len(words), len(words) + 2]
    rows = [("en", " ".join(f"v{i}" for i in range((1 << 18) + 9)) + ". x y; z" * 30)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(docs, 12).collect()) == plain(rows, 12)


def test_scores_beyond_64_bits(spark, monkeypatch):
    """A phrase that occurs 5 * 10**8 times among 10**12 words: the products pass 2**63."""
    counts = spark.createDataFrame([("en", "a b", 2, 500_000_000), ("en", "a", 1, 500_000_001), ("en", "b", 1, 700_000_003)], "lang string, phrase string, size int, a long")
    arrays = spark.createDataFrame([("en", 10**12)], "lang string, n long")
    monkeypatch.setattr(phrases, "word_arrays", lambda docs: arrays)
    monkeypatch.setattr(phrases, "common_phrases", lambda *_: counts)
    assert [tuple(r) for r in phrases.collocations(counts).collect()] == [("en", 1, "a b", 500_000_000, 500_000_001, 700_000_003, 10**12, 1000 * 500_000_000 * 10**12 // (500_000_001 * 700_000_003))]


def test_odd_rows(odd, none, odd_rows):
    rows = [(r[2], r[1]) for r in odd_rows]
    assert sorted(tuple(r) for r in phrases.collocations(odd, 40, top=50).collect()) == plain(rows, 40, 50)
    assert phrases.collocations(none).collect() == []


def test_a_piece_of_a_batch_takes_little_memory():
    """Whatever a task is given, it sums PIECE_WORDS words at once; fingerprints of so many, a level's main arrays, are few MB."""
    words = np.random.default_rng(0).integers(1, 1 << 63, phrases.PIECE_WORDS).astype(np.uint64)
    tracemalloc.start()
    found = phrases.Printer().runs(words, np.ones(len(words), np.uint64), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(words) - 2 and peak < 16e6
