"""Invented prose, for test modules."""

import random


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "er", "st", "ion", "el", "ou", "ti", "re", "ch", "é"]) for _ in range(r.randint(1, 4))) for _ in range(n))
