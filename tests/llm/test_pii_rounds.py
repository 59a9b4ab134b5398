"""Contexts learned in several rounds, against a plain version of the scoring; many spans in one text."""

import math
import random
import time
from collections import defaultdict

import regex
from test_brute_force import SHAPES, frame, pii_base

from sparkloom.llm import pii

TOKEN = regex.compile(r"(?<![A-Za-z0-9._@+-])(?=[A-Za-z._@+-]*+[0-9])[A-Za-z0-9._@+-]{5,}+")


def contexts(text, matches):
    """(start, end, hit, the two words left of it): ^ before the text, # for a match of the same shape on the way."""
    words, at = ["^", "^"], 0
    for m in matches:
        words += [w for w in regex.split(r"[^\p{L}]+", text[at : m.start()].lower()) if w]
        yield m.start(), m.end(), m[0], " ".join(words[-2:])
        words.append("#")
        at = m.end()


def plain(texts):
    """The spans of all texts, by the rules that the operator's docstring states."""
    kinds, marks = list(SHAPES), []
    for row, text in enumerate(texts):
        good = {tuple(s.split(":")) for s in pii_base(text).split(",") if s}
        base = [(row, a, k, b, c, h.lower()) for k, p in enumerate(SHAPES.values()) for a, b, h, c in contexts(text, regex.finditer(p, text)) if (kinds[k], str(a), str(b)) in good]
        free = [(row, a, 4, b, c, h.lower()) for a, b, h, c in contexts(text, TOKEN.finditer(text)) if not any(x[1] < b and a < x[3] for x in base)]
        marks += base + free
    seeds = {(h, k) for *_, k, _, _, h in marks if k < 4}
    edges = {(c, h) for *_, c, h in marks}
    per = defaultdict(set)
    for c, h in edges:
        per[c].add(h)
    learned = set()
    for rounds in range(1, 100):
        known = seeds | learned
        share = {}
        for c, hs in per.items():
            for k in range(4):
                n = sum((h, k) in known for h in hs)
                if n >= 3 and n / (len(hs) + 1) >= 0.6:
                    share[c, k] = n / (len(hs) + 1)
        new = set()
        for h in {h for _, h in edges} - {h for h, _ in seeds}:
            for k in range(4):
                doubt = [math.log(1 - share[c, k]) for c, x in edges if x == h and (c, k) in share]
                if doubt and 1 - math.exp(sum(doubt)) >= 0.6:
                    new.add((h, k))
        if new == learned:
            break
        learned = new
    kind = {}
    for h, k in learned:
        kind[h] = min(k, kind.get(h, 9))
    found = defaultdict(list)
    for row, a, k, b, _, h in marks:
        if k < 4 or h in kind:
            found[row].append((a, k if k < 4 else 4 + kind[h], b))
    names = [*kinds, *[f"ctx_{k}" for k in kinds]]
    return {row: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found[row])) for row in range(len(texts))}, rounds


def test_rounds_equal_the_plain_version(spark):
    rng = random.Random(2)
    ids = [f"ext-{rng.randrange(10**6):06d}" for _ in range(40)]
    texts = [f"please call number +1 (555) 555-{1000 + i} today" for i in range(14)] + [f"we call number {i} now" for i in ids[:6]]
    # two new ids stand in each further context beside six that are known when it is reached
    for step, place in enumerate(("desk line", "night post", "old gate", "far tower")):
        texts += [f"at {place} {i} too" for i in ids[2 * step : 2 * step + 8]]
    texts += [f"my call number {ids[30]} or {ids[31]} x", f"{ids[32]} {ids[33]}", "write to a1@b.c or d2@e.f", *(f"mail from user{i}@site{i}.org and 10.0.0.{i} ok" for i in range(6)), "mail from 12.ab.34 and serial99", "ω" * 70 + "supercalifragilistic" * 5 + f" number {ids[34]}"]
    texts += ["", "12345 54321", "ties a@b.c 1.2.3.4 x"]
    expected, rounds = plain(texts)
    found = {r.doc_id: r.spans for r in pii.find_pii(frame(spark, texts)).collect()}
    assert found == expected
    assert rounds >= 4 and sum("ctx_" in s for s in found.values()) > 20


def test_many_spans_in_one_text(spark):
    took = []
    for n in (5000, 40_000):
        text = " ".join(f"1.2.{i % 200}.4 a{i}" for i in range(n))
        began = time.perf_counter()
        row = pii.find_pii(frame(spark, [text])).select("n_ip", "spans").collect()[0]
        clean = pii.redact(frame(spark, [text])).collect()[0].text
        took.append(time.perf_counter() - began)
        assert row.n_ip == n and clean == " ".join(f"[IP] a{i}" for i in range(n))
    assert took[1] < 8 * took[0] + 20
