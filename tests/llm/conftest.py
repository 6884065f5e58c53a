from __future__ import annotations

import random

import pytest


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("an ber ch da el en fo ka lo mi no pa re st".split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def make():
    """A writer of invented prose with a seed of its own."""

    def made(seed: int):
        rng = random.Random(seed)
        return lambda n: prose(rng, n)

    return made
