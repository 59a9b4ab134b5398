"""SpotSigs on texts without common words."""

import random

import pytest

from sparkloom.llm import spotsigs

KINDS = {
    "table": lambda rng: " | ".join(f"cell{rng.randrange(1000)}" for _ in range(120)),
    "russian": lambda rng: " ".join(rng.choice(["река", "камень", "рынок", "тихий", "утро", "сигнал", "гавань"]) + str(rng.randrange(99)) for _ in range(120)),
    "tail": lambda rng: "the river and the stone of a market " + " ".join(f"cell{rng.randrange(1000)}" for _ in range(120)),
}


@pytest.mark.parametrize("kind", KINDS)
def test_second_half_counts(kind):
    text, other = (KINDS[kind](random.Random(s)) for s in (1, 2))
    half = len(text) // 2
    changed = spotsigs.edited(text, other)
    assert changed[:half] == text[:half] and changed != text
    a, b = spotsigs.signatures(text), spotsigs.signatures(changed)
    assert spotsigs.digest(a) != spotsigs.digest(b)
    assert spotsigs.likeness(a, b) < 0.8


def test_few_words():
    assert spotsigs.digest(spotsigs.signatures("red cell blue")) != spotsigs.digest(spotsigs.signatures("red cell green"))
