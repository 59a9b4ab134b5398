"""Notices beside each other, many of them, and all places by plain edit distance."""

import random
import time

from samples import prose

from sparkloom.llm import licenses


def body_of(text):
    return licenses.normalise(text)[1].decode()


def test_imperfect_notices_beside_an_exact_one():
    near, exact = "released undr the mit license", "released under the mit license"
    found = licenses.fuzzy(body_of(" ".join([near] * 20 + [exact] + [near] * 5)))
    assert len(found) == 26 and max(x[3] for x in found) == 1
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    worse = "relesed undr the mit licens"
    for text in (f"{worse} {exact}", f"{exact} {worse}", f"{worse} xx yy zz {exact}"):
        assert len([x for x in licenses.fuzzy(body_of(text)) if x[2] == "mit"]) == 2


def ends(notice, text, k):
    """(end, errors) of all places where the notice ends with at most k errors: the dynamic program column by column."""
    column, out = list(range(len(notice) + 1)), []
    for at, c in enumerate(text):
        now = [0]
        for i, x in enumerate(notice):
            now.append(min(column[i] + (x != c), column[i + 1] + 1, now[i] + 1))
        column = now
        if column[-1] <= k:
            out.append((at + 1, column[-1]))
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(row[j] + (x != y), row[j + 1] + 1, now[j] + 1))
        row = now
    return row[-1]


def test_all_places_by_plain_edit_distance():
    rng = random.Random(12)
    for _ in range(12):
        parts = []
        for _ in range(6):
            chars = list(rng.choice(licenses.NOTICES)[0])
            for _ in range(rng.randrange(0, len(chars) // 8)):
                at = rng.randrange(len(chars))
                kind = rng.choice("sid")
                chars[at : at + (kind != "i")] = [rng.choice("abc xyz")] if kind != "d" else []
            parts += ["".join(chars), prose(rng, rng.randrange(0, 3))]
        body = body_of(" ".join(parts))
        found = licenses.fuzzy(body)
        for n, (notice, label) in enumerate(licenses.NOTICES):
            k = max(1, len(notice) // licenses.ERROR_SHARE)
            own = [(a, b) for a, b, at, s in found if at == label and distance(notice, body[a:b]) <= k and abs(s - (1 - distance(notice, body[a:b]) / len(notice))) < 1e-9]
            for end, _ in ends(notice, body, k):
                assert any(a < end and end - len(notice) - k < b for a, b in own), (notice, body, end)
        for a, b, label, s in found:
            assert any(x == label and distance(notice, body[a:b]) <= max(1, len(notice) // licenses.ERROR_SHARE) for notice, x in licenses.NOTICES)


def test_work_is_in_proportion_to_the_places():
    for phrase, times in (("cc by ", 80_000), ("released undr the mit license ", 4000), ("mit license ", 40_000)):
        took = []
        for n in (times // 4, times):
            began = time.perf_counter()
            licenses._scan([phrase * n])
            took.append(time.perf_counter() - began)
        assert took[1] < 8 * took[0] + 0.2, (phrase, took)


def test_bit_parallel_distance_is_the_plain_one():
    rng = random.Random(8)
    for _ in range(400):
        notice = "".join(rng.choices("abc ", k=rng.choice((1, 2, 5, 20, 70))))
        text = "".join(rng.choices("abcd ", k=rng.randrange(60)))
        if rng.random() < 0.5:
            copy = list(notice)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = rng.choice(("", "x", "ab"))
            text += "".join(copy) + text[:9]
        masks = {c: sum(1 << i for i, x in enumerate(notice) if x == c) for c in set(notice)}
        for k in range(1, 8):
            # with no text at all, all of a notice of at most k characters would be missing: windows are never that short
            assert licenses.within(text, masks, len(notice), k) == bool(ends(notice, text, k)), (notice, text, k)


def test_windows_that_fail_are_cheap():
    """Notices with their halves swapped pass the trigrams but match nowhere: a megabyte of them, of which no window may go to the regex in vain."""
    halves = [(n[: len(n) // 2], n[len(n) // 2 :]) for n, _ in licenses.NOTICES if len(n) > 70]
    text = body_of(" ".join(f"{b} {a} z{i}" for i in range(1_000_000 // (75 * len(halves))) for a, b in halves))
    assert len(text) > 900_000
    began = time.time()
    licenses.fuzzy(text)
    assert time.time() - began < 30
