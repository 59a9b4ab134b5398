"""License scans: fuzzy search for short notices.

Texts become lower-case words joined by one space. A notice of which up to k characters may
differ is cut into k + 1 pieces; wherever it occurs with at most k errors, at least one piece
occurs unchanged (pigeonhole). An Aho-Corasick automaton finds the pieces; pieces that point to nearly the same place share a window, no longer
than the notice and four times k. A window stays a candidate only if it has enough of the notice's character trigrams
(each error spoils three at most) and if a bit-parallel edit distance finds a part of it near enough; the regex library's bounded-error
matching then verifies it and gives the span, so it never searches a window in vain. Work is linear in the number of pieces found.
"""

from __future__ import annotations

import bisect
import functools
import heapq

from pyspark.sql import DataFrame

from .common import map_texts

# Phrases and labels of the base contract.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Short notices and their labels, as normalised words.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under cc by", "cc-by"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("mozilla public license version 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("free and unencumbered software released into the public domain", "unlicense"),
)
ERROR_SHARE = 10  # one error for so many characters of a notice

#: Lower-cases A-Z and turns all that is no word character into a blank; UTF-8 bytes over 0x7F are word characters.
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def normalise(text: str) -> tuple[int, bytes]:
    """Number of words, and the words with a blank before, between and after them."""
    words = text.encode("utf-8", "replace").translate(_TABLE).split(b" ")
    words = [w for w in words if w] if b"" in words else words
    return len(words), b" " + b" ".join(words) + b" " if words else b" "


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces, nearly equal, with their offsets."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.cache
def _machine(notices=NOTICES, share: int = ERROR_SHARE):
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    checks = []
    for n, (notice, label) in enumerate(notices):
        k = max(1, len(notice) // share)
        for at, piece in pieces(notice, k):
            seeds.setdefault(piece, []).append((n, at))
        grams = [notice[i : i + 3] for i in range(len(notice) - 2)]
        masks = {c: sum(1 << i for i, x in enumerate(notice) if x == c) for c in set(notice)}
        checks.append((regex.compile(rf"(?:{regex.escape(notice)}){{e<={k}}}", regex.BESTMATCH), len(notice), k, label, grams, masks))
    auto = ahocorasick.Automaton()
    for piece, uses in seeds.items():
        auto.add_word(piece, (len(piece), uses))
    auto.make_automaton()
    return auto, checks


def fuzzy(norm: str, notices=NOTICES, share: int = ERROR_SHARE) -> list[tuple[int, int, str, float]]:
    """(start, end, label, similarity) of notices in normalised text with at most their allowed errors; offsets in `norm`."""
    auto, checks = _machine(notices, share)
    starts: dict[int, set[int]] = {}
    for end, (length, uses) in auto.iter(norm):
        for n, at in uses:
            starts.setdefault(n, set()).add(end + 1 - length - at)
    return sorted(span for n, places in starts.items() for span in _verified(norm, sorted(places), *checks[n]))


def within(window: str, masks: dict[str, int], size: int, k: int) -> bool:
    """Whether a part of the window is at most k edits from the notice whose characters stand at the bits of `masks`.

    One column of the edit distances' table a character: which steps down it go up (`rise`) and which go down (`fall`), as bits; `errors` is its last entry.
    """
    last, rise, fall, errors = 1 << (size - 1), (1 << size) - 1, 0, size
    full = rise
    for c in window:
        equal = masks.get(c, 0)
        level = (((equal & rise) + rise) ^ rise) | equal
        up, down = fall | ~(level | rise), rise & level
        errors += 1 if up & last else -1 if down & last else 0
        if errors <= k:
            return True
        up, down, equal = up << 1, down << 1, equal | fall
        rise, fall = (down | ~(equal | up)) & full, up & equal & full
    return False


def _verified(norm: str, places: list[int], pattern, size: int, k: int, label: str, grams: list[str], masks: dict[str, int]) -> list[tuple[int, int, str, float]]:
    """Spans of one notice that may start at `places`; they don't overlap, and each occurrence with at most k errors overlaps one.

    Of matches that overlap, the one with fewest errors stays, of equal ones the first; what is left of the others' windows is searched again.
    """
    found: list[tuple[int, int, int, int, int]] = []

    def look(low: int, high: int) -> None:
        if high - low < size - k:
            return
        window = norm[low:high]
        if sum(g in window for g in grams) >= len(grams) - 3 * k and within(window, masks, size, k) and (m := pattern.search(window)):
            heapq.heappush(found, (sum(m.fuzzy_counts), low + m.start(), low + m.end(), low, high))

    at = 0
    while at < len(places):
        begin = last = places[at]
        while at < len(places) and places[at] <= begin + 2 * k:
            last, at = places[at], at + 1
        look(max(0, begin - k), min(len(norm), last + size + k))
    kept: list[tuple[int, int]] = []
    out = []
    while found:
        errors, start, end, low, high = heapq.heappop(found)
        i = bisect.bisect_right(kept, (start, len(norm)))
        beside = [kept[j] for j in (i - 1, i) if 0 <= j < len(kept)]
        crossing = [x for x in beside if x[0] < end and start < x[1]]
        if not crossing:
            kept.insert(i, (start, end))
            out.append((start, end, label, 1 - errors / size))
            crossing = [(start, end)]
        look(low, min(high, crossing[0][0]))
        look(max(low, crossing[-1][1]), high)
    return out


def base_places(norm: bytes) -> list[tuple[int, str]]:
    """(word index, label) of each place where a base phrase's words stand consecutively."""
    out = []
    for phrase, label in BASE:
        needle, at, words, counted = b" " + phrase.encode() + b" ", -1, 0, 0
        while (at := norm.find(needle, at + 1)) >= 0:
            words += norm.count(b" ", counted, at)
            counted = at
            out.append((words, label))
    return out


def word_spans(body: str, found: list[tuple[int, int, str, float]]) -> str:
    """The spans as label:first word:word after the last, in their order, which is that of their starts."""
    out, words, counted = [], 0, 0
    for a, b, label, _ in found:
        inside = a + (body[a : a + 1] == " ")
        words += body.count(" ", counted, inside)
        counted = inside
        out.append(f"{label}:{words - 1}:{words - 1 + len(body[a:b].split())}")
    return ",".join(out)


def _scan(texts: list[str]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
    for t in texts:
        n, norm = normalise(t)
        base = base_places(norm)
        body = norm.decode("utf-8", "replace")
        found = fuzzy(body)
        labels = {x[1] for x in base}
        out["n_words"].append(n)
        out["n_base"].append(len(base))
        out["first_word"].append(min((x[0] for x in base), default=None))
        out["last_word"].append(max((x[0] for x in base), default=None))
        out["base_labels"].append(",".join(sorted(labels)))
        out["labels"].append(",".join(sorted(labels | {x[2] for x in found})))
        out["score"].append(1.0 if base else max((x[3] for x in found), default=0.0))
        out["spans"].append(word_spans(body, found))
    return out


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """License notices of every whole text.

    n_words, the base phrases' places (n_base, first_word, last_word, base_labels), all labels, a score from 0 to 1
    (1: a base phrase; else the best notice's share of characters that agree) and the fuzzy spans as
    label:first word:word after the last. One row per input row; null and empty texts have no words, no places,
    empty labels and score 0; other columns don't matter. Overlapping places of one phrase all count. A text with very many places costs in proportion to them. No shuffle; memory is one Arrow batch.
    """
    return map_texts(docs, _scan, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string", text_col=text_col)
