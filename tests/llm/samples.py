"""Text for the tests."""

import random


def prose(rng: random.Random, words: int) -> str:
    vocabulary = "the of and river stone market quiet morning signal harbour engine velvet copper lantern meadow orbit in on with by for la de und".split()
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "s", "ly", ","]) for _ in range(words))
