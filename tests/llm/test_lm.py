from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import functions as F

from revcast.llm.lm import PRIOR, STRENGTH, WORD_BITS, cross_entropy_difference
from tests.llm.conftest import frame


def brute(texts, good):
    """The same models on words instead of hashed slots."""
    split = [(i, (t or "").lower().split()) for i, t in texts]
    uni, ctx, pair = ([Counter(), Counter()] for _ in range(3))
    for i, w in split:
        for m in (0, 1):
            if m or i in good:
                uni[m].update(w)
                ctx[m].update(w[:-1])
                pair[m].update(zip(w, w[1:]))
    out = {}
    for i, w in split:
        loss = []
        for m in (0, 1):
            total = sum(uni[m].values()) + PRIOR * (1 << WORD_BITS)
            p = [(uni[m][x] + PRIOR) / total for x in w]
            q = p[:1] + [(pair[m][a, b] + STRENGTH * p[k + 1]) / (ctx[m][a] + STRENGTH) for k, (a, b) in enumerate(zip(w, w[1:]))]
            loss.append(-sum(map(math.log, q)) / max(1, len(w)))
        out[i] = (len(w), *loss)
    return out


def test_agrees_with_brute_force(lm_spark, words):
    texts = [(i, " ".join((words if i % 3 else lambda n, s: words(n, s % 2))(40 + i, i))) for i in range(40)] + [(90, None), (91, ""), (92, "alone")]
    docs = frame(lm_spark, texts).withColumn("target", F.lit(True)).withColumn("kind", F.lit(1))
    good = {i for i, _ in texts if i % 3 == 0}
    labels = lm_spark.createDataFrame([(i, int(i in good), 0) for i, _ in texts] + [(None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    want = brute(texts, good)
    rows = cross_entropy_difference(docs, labels).collect()
    assert len(rows) == len(texts)
    close = 0  # words or pairs of one slot count together; that moves few words, and only by some nats
    for r in rows:
        n, target, background = want[r["doc_id"]]
        assert r["n_tokens"] == n and abs(r["score"] - (r["target_loss"] - r["background_loss"])) < 1e-9
        close += abs(r["target_loss"] - target) < 2e-3 and abs(r["background_loss"] - background) < 2e-3
        assert abs(r["target_loss"] - target) < 0.3 and abs(r["background_loss"] - background) < 0.3
    assert close >= 0.6 * len(rows)


def test_odd_tables(lm_spark):
    labels = lm_spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = cross_entropy_difference(frame(lm_spark, [(None, "a b"), (1, "a b"), (1, "a b")]), labels).collect()
    assert len(rows) == 3 and all(math.isfinite(r["score"]) for r in rows)
    assert cross_entropy_difference(frame(lm_spark, []), labels).collect() == []


def test_every_word_has_a_count_of_its_own(lm_spark):
    """More words than 2^17: losses agree to the last digits, and the words' probabilities sum to 1 or less."""
    texts = [(i, " ".join(f"w{(i * 3701 + k * k) % 90_000 if k % 4 else i * 5000 + k}" for k in range(5000))) for i in range(40)]
    texts += [(100 + i, " ".join(f"v{i}x{k}" for k in range(4000))) for i in range(20)]
    good = set(range(0, 40, 5))
    split = {i: t.split() for i, t in texts}
    spread = len({w for own in split.values() for w in own})
    assert spread > 1 << WORD_BITS
    tables = []
    for m in (0, 1):
        some = [w for i, w in split.items() if m or i in good]
        tables.append([Counter(x for w in some for x in w), Counter(x for w in some for x in w[:-1]), Counter(x for w in some for x in zip(w, w[1:]))])
    labels = lm_spark.createDataFrame([(i, int(i in good), 0) for i, _ in texts], "doc_id long, quality int, toxic int")
    rows = cross_entropy_difference(frame(lm_spark, texts), labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = split[r["doc_id"]]
        for (uni, ctx, pair), got in zip(tables, (r["target_loss"], r["background_loss"])):
            total = sum(uni.values()) + PRIOR * spread
            p = [(uni[x] + PRIOR) / total for x in w]
            q = p[:1] + [(pair[a, b] + STRENGTH * p[k + 1]) / (ctx[a] + STRENGTH) for k, (a, b) in enumerate(zip(w, w[1:]))]
            assert abs(got + sum(map(math.log, q)) / len(w)) < 1e-9
