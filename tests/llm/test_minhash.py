from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revcast.llm.minhash import bags, near_duplicates, signatures, without_near_duplicates
from revcast.llm.words import Words, shingles
from tests.llm.conftest import frame


def bag(text):
    found = "".join(c.lower() if (ord(c) < 128 and c.isalnum()) or ord(c) > 127 else " " for c in text or "").split()
    if not found:
        return Counter()
    return Counter(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4)))


def overlap(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(texts):
    ids = [i for i, _ in texts]
    own = [bag(t) for _, t in texts]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (not own[i] and not own[j] and (texts[i][1] or "") == (texts[j][1] or "")) or (own[i] and overlap(own[i], own[j]) >= 0.8):
                root[max(find(i), find(j), key=lambda x: ids[x])] = min(find(i), find(j), key=lambda x: ids[x])
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_shingles_agree_with_brute_force(words):
    texts = ["", "a", "One two, three; four five-six", "é à ü ô ñ x", " ".join(words(80, 1)), "same " * 9, None, "!!", "A b c d"]
    h, doc = shingles(Words(pa.array(texts)))
    seen = {}
    for d, text in enumerate(texts):
        want = [s for s, n in bag(text).items() for _ in range(n)]
        got = h[doc == d].tolist()
        assert sorted(Counter(got).values()) == sorted(Counter(want).values())
        for x in bag(text):
            assert seen.setdefault(x, None) is None
    sliced = pa.array(["zz zz", *texts]).slice(1)
    assert (shingles(Words(sliced))[0] == h).all()


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for trial in range(30):
        n = 150
        a, b = rng.integers(0, 6, n), rng.integers(0, 6, n)
        b = np.where(rng.random(n) < 0.7, a, b)
        shingle = rng.integers(1, 2**47, n).astype(np.uint64)
        doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        sig = signatures(doc, np.concatenate([shingle[a > 0], shingle[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 400)
        exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        errors.append((sig[0] == sig[1]).mean() - exact)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_signatures_do_not_depend_on_the_batch(words):
    texts = [" ".join(words(n, n)) for n in (1, 3, 5, 40, 900)] + ["na " * 300]
    whole = signatures(*bags(Words(pa.array(texts))), len(texts))
    for i, t in enumerate(texts):
        assert (signatures(*bags(Words(pa.array([t]))), 1)[0] == whole[i]).all()


@pytest.fixture
def corpus(words):
    rng = random.Random(5)
    texts = []
    for g in range(25):
        base = words(rng.randint(60, 200), g)
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
            texts.append((len(texts), " ".join(own)))
    hot = words(150, 77)
    for k in range(60):  # a large family whose members are far from each other at its ends
        own = list(hot)
        for j in range(k // 4):
            own[(j * 37) % len(own)] = f"v{j}"
        texts.append((1000 + k, " ".join(own)))
    texts += [(2000 + i, "a copied text of few words") for i in range(20)] + [(3000, None), (3001, ""), (3002, " !"), (3003, "one"), (3004, "ONE."), (3005, "x y z")]
    return texts


def test_classes_agree_with_brute_force(lm_spark, corpus):
    docs = frame(lm_spark, corpus).withColumn("hash", F.lit(1)).withColumn("node", F.lit(1)).withColumn("_i", F.lit(1))
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    assert got == brute_classes(corpus)
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_links_across_the_components_of_a_band_are_found(lm_spark, words):
    """The head of the shared bands is like neither of two texts that are like each other."""
    base = words(200, 9)
    texts = [(0, " ".join(base[:100] + words(100, 10))), (1, " ".join(base)), (2, " ".join([*base[:-1], "end"])), (3, " ".join(base[:100] + words(100, 11)))]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(frame(lm_spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3}


def test_odd_rows(lm_spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    got = sorted((r["doc_id"], r["class_id"], r["copies"]) for r in near_duplicates(frame(lm_spark, rows)).collect())
    assert got == [(1, 1, 3), (1, 1, 3), (2, 1, 3)]
    assert sorted(r["doc_id"] or -1 for r in without_near_duplicates(frame(lm_spark, rows)).collect()) == [-1, 1, 1]
    assert near_duplicates(frame(lm_spark, [])).collect() == []
