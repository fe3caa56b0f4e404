from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from revcast.llm.sharding import best_fit_decreasing, fill, shards
from tests.llm.conftest import frame


def plain_best_fit(sizes, capacity):
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= s]
        if fits:
            left[min(fits)[1]] -= s
        else:
            left.append(capacity - s)
    return len(left)


@pytest.mark.parametrize("seed", range(6))
def test_classes_are_packed_like_single_items(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 60) for _ in range(200)]
    runs = best_fit_decreasing(list(Counter(sizes).items()), 100)
    load, seen = Counter(), Counter()
    for size, n, b in runs:
        load[b] += size * n
        seen[size] += n
    assert seen == Counter(sizes) and max(load.values()) <= 100
    assert len(load) == plain_best_fit(sizes, 100)


def test_loads_are_near_equal_and_a_giant_is_alone():
    rng = random.Random(1)
    sizes = [rng.randint(1, 500) for _ in range(4000)] + [400_000]
    load = Counter()
    for size, n, b in fill(list(Counter(sizes).items()), 16):
        load[b] += size * n
    rest = sorted(load.values())[:-1]
    assert max(load.values()) == 400_000 and len(load) == 16 and max(rest) - min(rest) <= 16


def test_documents(lm_spark, words):
    rng = random.Random(2)
    texts = [(i, " ".join(words(rng.randint(1, 300), i))) for i in range(400)] + [(500 + i, "same text") for i in range(300)] + [(900, None), (901, ""), (None, "é" * 3), (3, "x"), (3, "x")]
    dealt = shards(frame(lm_spark, texts).withColumn("shard", F.lit(9)).withColumn("row", F.lit(9)), 4).collect()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in dealt), key=str) == want
    by = {s: sorted(r["slot"] for r in dealt if r["shard"] == s) for s in range(4)}
    assert all(slots == list(range(len(slots))) for slots in by.values())
    assert len({r["shard"] for r in dealt if r["doc_id"] is not None and 500 <= r["doc_id"] < 800}) == 1
    load = Counter()
    for r in dealt:
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) < 0.02 * max(load.values())


def test_empty_table(lm_spark):
    assert shards(frame(lm_spark, []), 4).collect() == []
