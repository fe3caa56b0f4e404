from __future__ import annotations

import random

import pytest

from revcast.llm.common import shipped


@pytest.fixture(scope="session")
def lm_spark(spark):
    return shipped(spark)


@pytest.fixture
def words():
    """A seeded writer of sentences of invented words."""
    rng = random.Random(3)
    stock = ["".join(rng.choice(["an", "er", "on", "th", "in", "ou", "re", "st", "ly", "ble"]) for _ in range(rng.randint(1, 4))) for _ in range(600)]

    def write(n: int, seed: int = 0) -> list[str]:
        own = random.Random(seed * 7919 + n)
        return [own.choice(stock) for _ in range(n)]

    return write


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([(*r, *([None] * 3))[:5] for r in rows], schema)
