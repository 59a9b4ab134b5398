"""Secret scans: fixed key shapes, and sliding-window entropy over candidate strings.

A candidate is a run of letters, digits and +/_=- of at least `WINDOW` characters. For each
character class a window slides over the candidate's runs of that class; letter counts and
the sum of n*log2(n) change by one letter in and one letter out, so each step costs O(1).
Windows at or over the class's threshold merge to spans; the allow list suppresses strings
that look random but are not secret.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame

from .common import map_texts

# The shapes of the base contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a match of under 20 characters fails as a whole, so asking for 20 finds the same
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "api")  # each assignment holds one
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: class name: (its runs, least entropy in bits of a window)
CLASSES = {
    "hex": (re.compile(r"[0-9a-f]{20,}|[0-9A-F]{20,}"), 3.0),
    "base64": (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.85),
}
ALLOWED = (
    re.compile(r"[0-9]+"),  # plain numbers
    re.compile(r"[A-Za-z]+|[A-Z]?[a-z]+(?:[-_/=+][A-Z]?[a-z]*)*"),  # words, and words joined by marks; a letter matches in one way only, so a late failure is linear
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),  # UUIDs
    re.compile(r"(?s:.*?)(?:EXAMPLE|example|PLACEHOLDER|placeholder|x{6}|X{6})(?s:.*)"),
    re.compile(r"sha(?:256|384|512)-[A-Za-z0-9+/=]+"),  # integrity attributes
)

_NLOGN = [0.0] + [n * math.log2(n) for n in range(1, 4097)]


def hot_windows(run: str, window: int, least: float) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows of `run` whose Shannon entropy is at least `least`."""
    counts: dict[str, int] = {}
    total, out, whole = 0.0, [], math.log2(window)
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _NLOGN[n + 1] - _NLOGN[n]
        if i >= window:
            gone = run[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            total += _NLOGN[n - 1] - _NLOGN[n]
        if i >= window - 1 and whole - total / window >= least - 1e-9:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def entropy_spans(text: str, window: int = WINDOW, classes=None, allowed=ALLOWED) -> list[tuple[int, int]]:
    """Spans of random-looking strings, those of all classes merged; candidates on the allow list give none."""
    spans: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        if any(p.fullmatch(m[0]) for p in allowed):
            continue
        for runs, least in (classes or CLASSES).values():
            for r in runs.finditer(m[0]):
                if not any(p.fullmatch(r[0]) for p in allowed):
                    spans += [(m.start() + r.start() + a, m.start() + r.start() + b) for a, b in hot_windows(r[0], window, least)]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every secret, sorted; code points."""
    low = text.lower()
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(k in low for k in KEYWORDS) else []
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans += [(a, 3, b) for a, b in entropy_spans(text)]
    return sorted(spans)


def _scan(texts: list[str]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans")}
    for t in texts:
        spans = find(t)
        for k, name in enumerate(KINDS):
            out[f"n_{name}"].append(sum(s[1] == k for s in spans))
        base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < 3)
        out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
        out["spans"].append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans))
    return out


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: counts by kind, a digest of the base spans, and all spans as kind:start:end.

    One row per input row, repeated rows included. Null and empty texts give no spans (the digest is that of the
    empty string); a null id stays null. No rows in, no rows out. Spans at the same start follow KINDS.
    Candidates of any length, allowed or not, cost time in proportion to their length. Needs no shuffle; memory is one Arrow batch.
    """
    return map_texts(docs, _scan, "n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string", text_col=text_col)
