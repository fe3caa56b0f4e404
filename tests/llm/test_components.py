from __future__ import annotations

import random

import pytest

from revcast.llm.common import components, numbered, stored


@pytest.mark.parametrize("kind", ["random", "path", "star"])
def test_components_agree_with_brute_force(lm_spark, kind):
    rng = random.Random(7)
    if kind == "random":
        edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    elif kind == "path":
        order = rng.sample(range(120), 120)
        edges = list(zip(order, order[1:]))
    else:
        edges = [(5, x) for x in range(400)] + [(900, x) for x in range(380, 420)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components(lm_spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_no_edges(lm_spark):
    assert components(lm_spark.createDataFrame([], "a long, b long")).collect() == []


def test_numbers_are_gapless(lm_spark):
    df = stored(lm_spark.createDataFrame([(i % 7 if i % 3 else None, i) for i in range(1000)], "k long, v long"), "t")
    rows = numbered(df, ["k"], ["v"], "n", rows_per_part=50).collect()
    by = {}
    for r in rows:
        by.setdefault(r["k"], []).append(r["n"])
    assert len(rows) == 1000 and all(sorted(n) == list(range(len(n))) for n in by.values())
