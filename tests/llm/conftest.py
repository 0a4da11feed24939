from __future__ import annotations

import random

import pytest


@pytest.fixture
def words():
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choices(pool, k=n))
