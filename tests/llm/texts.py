"""Invented texts."""

from __future__ import annotations

import random


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    """Invented words, the same for the same seed."""
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}{'abcdefgh'[draw.randrange(8)]}" for _ in range(words))
