from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from revcast.llm import topk
from revcast.llm.topk import top_k


def brute(vectors, queries, k):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    whole = {i: [math.floor(1024 * x) for x in v] for i, v in vectors if ok(v)}
    out = []
    for q in queries:
        if q in whole:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("first_shift", [18, 4])
def test_agrees_with_brute_force(lm_spark, monkeypatch, first_shift):
    monkeypatch.setattr(topk, "PACK", 60)
    monkeypatch.setattr(topk, "BLOCK", 4)
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(300)]
    vectors += [(1000 + i, [0.5] * 8) for i in range(150)]  # a hot vector: ties everywhere
    vectors += [(2000, None), (2010, [0.1] * 7 + [None]), (2020, [float("nan")] * 8), (2030, [float("inf")] + [0.0] * 7), (2040, [1e6] * 8)]
    df = lm_spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("row", F.lit(1)).withColumn("low", F.lit(1))
    got = sorted(tuple(r) for r in top_k(df, df.where("vec_id % 10 = 0"), 5, first_shift=first_shift).collect())
    assert got == brute(vectors, [i for i, _ in vectors if i % 10 == 0], 5)


def test_few_candidates_and_empty(lm_spark):
    vectors = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.25])]
    df = lm_spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in top_k(df, df.where("vec_id = 0"), 10).collect()) == brute(vectors, [0], 10)
    assert top_k(df.where("false"), df.where("false"), 10).collect() == []
