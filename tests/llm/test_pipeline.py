from __future__ import annotations

import zlib
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from revcast.llm import pii
from revcast.llm.common import stored, table


def test_stages(lm_spark, sf_dir):
    docs = table(lm_spark, sf_dir, "documents")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    at, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stored(stage(lm_spark, at, sf_dir), name)
        assert at.columns == docs.columns, name
        sizes.append(at.count())
        if name == "exact_dedup":
            assert at.select(F.coalesce("text", F.lit(""))).distinct().count() == sizes[-1]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert sum(len(x) for r in at.select("text").collect() for x in pii.base_spans(r["text"] or "").values()) == 0
    filled = defaultdict(int)
    rows = corpus_pipeline.STAGES[-1][1](lm_spark, at, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in at.select("doc_id").collect()}
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048 and len(filled) <= sum(filled.values()) / 2048 + 2


def test_last_stage_returns_the_ids(lm_spark, sf_dir):
    docs = table(lm_spark, sf_dir, "documents").limit(30)
    rows = corpus_pipeline.STAGES[-1][1](lm_spark, docs, sf_dir).collect()
    assert rows and all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)
