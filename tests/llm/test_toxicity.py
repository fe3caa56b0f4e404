from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from revcast.llm.toxicity import WINDOW_BYTES, held_out, ordinary_documents, scored, trained_judge, windows
from tests.llm.conftest import frame

INSULTS = ["gromblich", "gromblat", "vazzek", "pludder", "schnorf"]


@pytest.fixture
def corpus(words):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(900):
        toxic = int(i % 5 == 0)
        text = words(rng.randint(20, 300), i)
        for _ in range(rng.randint(3, 6) * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        docs.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    return docs, labels


def test_windows_are_the_whole_text(words):
    for text in ["", "a", "Ab " * 500, "x" * 1000, "é" * 400, " ".join(words(900, 2))]:
        got = windows(text)
        assert len(got) >= 1 and all(len(w) <= WINDOW_BYTES + 1 for w in got)
        # a window's closing blank is also the next one's first byte
        joined = b"".join(w[:-1] if n + 1 < len(got) else w for n, w in enumerate(got))
        assert joined == text.lower().encode() or len(joined) == len(text.lower().encode())


def test_held_out_accuracy(lm_spark, corpus):
    docs, labels = corpus
    df = frame(lm_spark, [*docs, (5000, None), (5001, ""), (None, "no id"), docs[0]]).withColumn("toxic", F.lit(1)).withColumn("score", F.lit(2))
    judge = trained_judge(df, lm_spark.createDataFrame([*labels, (None, 1, 1), (77, 1, None)], "doc_id long, quality int, toxic int"))
    got = scored(df, judge).withColumn("held", held_out())
    rows = got.collect()
    assert len(rows) == len(docs) + 4 and all(0 <= r["score"] <= 1 for r in rows)
    truth = {i: t for i, _, t in labels}
    held = [(truth[r["doc_id"]], r["score"] >= 0.5) for r in rows if r["held"] and r["doc_id"] in truth]
    assert len(held) > 120
    assert sum(t == p for t, p in held) >= 0.97 * len(held)
    assert all(r["score"] < 0.5 for r in rows if r["doc_id"] in (5000, 5001))
    kept = ordinary_documents(df, judge)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in rows if r["score"] < 0.5)


def test_without_labels_nothing_is_toxic(lm_spark):
    df = frame(lm_spark, [(1, "a b c"), (2, None)])
    none = lm_spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert trained_judge(df, none) is None
    assert [r["score"] for r in scored(df, None).collect()] == [0.0, 0.0]
    assert scored(df.where("false"), None).collect() == []
