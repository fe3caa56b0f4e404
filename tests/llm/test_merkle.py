from __future__ import annotations

import hashlib
import zlib

import pytest
from conftest import rows as collected
from pyspark.sql import functions as F

from revcast.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d[0], d[3], d[2], d[4], text)])


def tree(nodes):
    """(root, path of each node): plain recursion over lists."""
    paths = [[] for _ in nodes]
    under = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, below = [], []
        for start in range(0, len(nodes), 16):
            run = nodes[start : start + 16]
            for slot in range(len(run)):
                for k in under[start + slot]:
                    paths[k].append((run[:slot], run[slot + 1 :]))
            above.append(h(*run))
            below.append([k for u in under[start : start + 16] for k in u])
        nodes, under = above, below
    return (nodes[0] if nodes else None), paths


def brute(docs):
    groups = {}
    for d in docs:
        groups.setdefault((d[3] is not None, (d[3] or "").encode()), []).append(d)
    keys = sorted(groups)
    trees = {}
    for key in keys:
        groups[key].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1])))
        trees[key] = tree([leaf(d, d[1]) for d in groups[key]])
    root, tops = tree([trees[k][0] for k in keys])
    out = []
    for at, key in enumerate(keys):
        for d, path in zip(groups[key], trees[key][1]):
            whole = path + tops[at]
            hit = d[0] is not None and d[1] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0
            node = leaf(d, "".join(c.lower() if "A" <= c <= "Z" else c for c in d[1]) if hit else d[1])
            for left, right in whole:
                node = h(*left, node, *right)
            out.append((d[0], leaf(d, d[1]), trees[key][0], root, h(*[x for left, right in whole for x in left + right]), node, node == root))
    return sorted(out, key=str)


def docs_of(sizes, extra=()):
    out = [(100 * k + i, f"Text {i} ÄB of {k}" if i % 3 else "plain", "en" if i % 2 else None, f"s{k}", i) for k, n in enumerate(sizes) for i in range(n)]
    return out + list(extra)


ODD = [
    (1, None, None, None, None),
    (2, "", None, None, 0),
    (None, "No id", "de", None, 3),
    (None, "No id", "de", None, 3),
    (5, "A" * 70_000, "de", "", 3),
    (5, "other", "de", "", 3),
    (5, "other", "de", "", 3),
    (-8, "Minus", "en", "é", 1),
    (9, "A lone leaf", "en", "z", 1),
]


@pytest.mark.parametrize("sizes", [[300, 17, 1], [1], [257, 32] + [2] * 40])
def test_manifest_agrees_with_brute_force(lm_spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "ROWS_PER_PART", 50)
    docs = docs_of(sizes, ODD)
    frame = lm_spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA + ", digest int, key string").repartition(3)
    got = sorted(collected(merkle.manifest(frame, merkle.tampered_text())), key=str)
    assert got == brute(docs)
    assert any(r[-1] for r in got) and (len(got) < 20 or any(not r[-1] for r in got))


def test_untampered_documents_are_verified(lm_spark):
    frame = lm_spark.createDataFrame(docs_of([40, 3]), SCHEMA)
    assert {r["verified"] for r in merkle.manifest(frame).collect()} == {True}
    assert {r["verified"] for r in merkle.manifest(frame, F.concat("text", F.lit("."))).collect()} == {False}


def test_single_leaf_and_empty_table(lm_spark):
    one = [(3, "Text", "en", "s", 4)]
    assert collected(merkle.manifest(lm_spark.createDataFrame(one, SCHEMA), merkle.tampered_text())) == brute(one)
    assert collected(merkle.manifest(lm_spark.createDataFrame([], SCHEMA))) == []
