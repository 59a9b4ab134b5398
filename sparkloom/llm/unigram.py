"""Token counts of a unigram tokenizer, without building the tokens.

An Aho-Corasick automaton over the vocabulary lists, for each end position, the pieces that end
there, longest first. The forward pass keeps best score and piece count per position. Rules that
decide ties and unknowns, as in the public unigram implementations: a later candidate must score
strictly more, candidates come by start position; a character that is no piece itself costs
the least score less ten; with byte fallback an unknown character counts one piece per UTF-8 byte.
Text is cut before every blank, which becomes U+2581, so the pass runs over one word at a time and
each worker keeps counts of words that it has seen.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

from .common import map_texts

BLANK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
NONE = float("-inf")
CACHE_WORDS = 400_000  # a worker remembers between one and two times as many words
CACHE_CHARS = 48  # longer words are counted anew each time


def read_vocabulary(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, type) in order of id, from a sentencepiece model file."""
    data = open(path, "rb").read()

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    def fields(at: int, end: int):
        while at < end:
            tag, at = varint(at)
            kind = tag & 7
            if kind == 0:
                value, at = varint(at)
            elif kind == 2:
                size, at = varint(at)
                value, at = (at, at + size), at + size
            else:
                size = 4 if kind == 5 else 8
                value, at = data[at : at + size], at + size
            yield tag >> 3, value

    out = []
    for number, span in fields(0, len(data)):
        if number == 1:
            piece, score, kind = "", 0.0, 1
            for n, v in fields(*span):
                if n == 1:
                    piece = data[v[0] : v[1]].decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.append((piece, score, kind))
    return out


class Counter(dict):
    """word -> (pieces, score); words that aren't there are counted."""

    def __init__(self, vocabulary: list[tuple[str, float, int]]):
        import ahocorasick

        super().__init__()
        self.auto = ahocorasick.Automaton()
        for piece, score, _ in vocabulary:
            if piece:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.single = frozenset(p for p, _, _ in vocabulary if len(p) == 1)
        self.before: dict[str, tuple[int, float]] = {}
        self.unknown = min(s for _, s, _ in vocabulary) - UNKNOWN_PENALTY

    def count(self, word: str) -> tuple[int, float]:
        """One forward pass. Pieces that end at one place come longest first, so by start; a later one must score more."""
        size = len(word)
        best = [NONE] * (size + 1)
        pieces = [0] * (size + 1)
        best[0] = 0.0
        if self.single.issuperset(word):
            for last, (length, worth) in self.auto.iter(word):
                start = last + 1 - length
                score = best[start] + worth
                if score > best[last + 1]:
                    best[last + 1], pieces[last + 1] = score, pieces[start] + 1
            return pieces[size], best[size]
        ends: list[list[tuple[int, float]]] = [[] for _ in word]
        for last, piece in self.auto.iter(word):
            ends[last].append(piece)
        for last, c in enumerate(word):
            for length, worth in ends[last]:
                start = last + 1 - length
                score = best[start] + worth
                if score > best[last + 1]:
                    best[last + 1], pieces[last + 1] = score, pieces[start] + 1
            if c not in self.single and best[last] + self.unknown > best[last + 1]:
                best[last + 1], pieces[last + 1] = best[last] + self.unknown, pieces[last] + len(c.encode("utf-8", "replace"))
        return pieces[size], best[size]

    def __missing__(self, word: str) -> tuple[int, float]:
        found = self.before.get(word) or self.count(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:  # what isn't asked for again goes with the next change
                self.before = dict(self)
                self.clear()
            self[word] = found
        return found

    def text(self, text: str) -> tuple[int, float]:
        """Pieces and score of a whole text; the empty text has none."""
        if not text:
            return 0, 0.0
        text = text.replace(" ", BLANK)
        words = (text if text[0] == BLANK else BLANK + text).split(BLANK)
        n, score = 0, 0.0
        get = self.__getitem__
        for w in words[1:]:
            a, b = get(BLANK + w)
            n += a
            score += b
        return n, score


_counters: dict[int, Counter] = {}


def count_tokens(docs: DataFrame, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and score of the best segmentation, for every whole text.

    The driver reads the vocabulary and broadcasts it: its size is that of the file, whatever the corpus. One row
    per input row; null and empty texts have 0 tokens and score 0. A word of any length is one forward pass in
    memory linear in it. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))

    def score(texts: list[str]) -> dict[str, list]:
        vocabulary = shared.value
        key = hash((len(vocabulary), vocabulary[-1], vocabulary[len(vocabulary) // 2]))
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(vocabulary)
        counter = _counters[key]
        found = [counter.text(t) for t in texts]
        return {"n_tokens": [x[0] for x in found], "score": [x[1] for x in found]}

    return map_texts(docs, score, "n_tokens long, score double", text_col=text_col)
