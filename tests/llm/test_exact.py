from __future__ import annotations

import hashlib

from conftest import rows as collected
from pyspark.sql import functions as F

from revcast.llm.exact import exact_groups, without_copies
from tests.llm.conftest import frame

TEXTS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "A"), (7, "b" * 50_000), (8, "b" * 50_000), (8, "b" * 50_000), (9, "a "), (None, "b")]


def brute(texts):
    out = []
    for i, t in texts:
        group = [j for j, u in texts if (u or "") == (t or "")]
        known = [j for j in group if j is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(group), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_agree_with_brute_force(lm_spark):
    docs = frame(lm_spark, TEXTS).withColumn("hash", F.lit(1)).withColumn("keep_id", F.lit(2)).withColumn("body", F.lit("x"))
    assert sorted(collected(exact_groups(docs)), key=str) == brute(TEXTS)


def test_texts_of_one_hash_are_told_apart(lm_spark, monkeypatch):
    monkeypatch.setattr(F, "md5", lambda c: F.substring(F.col(c) if isinstance(c, str) else c, 1, 1))
    assert sorted(collected(exact_groups(frame(lm_spark, TEXTS))), key=str) == brute(TEXTS)


def test_one_row_of_each_text_stays(lm_spark):
    docs = frame(lm_spark, TEXTS).withColumn("_row", F.lit("x")).withColumn("c0", F.col("doc_id"))
    kept = without_copies(docs)
    assert kept.columns == docs.columns
    got = sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=str)
    assert got == sorted([(3, "a"), (2, "b"), (5, ""), (6, "A"), (8, "b" * 50_000), (9, "a ")], key=str)


def test_empty_table(lm_spark):
    docs = frame(lm_spark, [])
    assert collected(exact_groups(docs)) == [] and collected(without_copies(docs)) == []
