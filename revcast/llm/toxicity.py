"""Toxicity by compression distance: windows are compressed with an ordinary and a toxic zstandard dictionary."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcast.llm.common import whole_text

WINDOW_BYTES = 96
LEVEL = 6
ORDINARY_BYTES = 16384
TOXIC_BYTES = 1024
STEM = 5
WORD = re.compile(rb"[^\s.,!?|]+")


def windows(text: str) -> list[bytes]:
    """The whole text in windows of whole words, case folded; an empty text has one empty window."""
    data = text.lower().encode("utf-8", "surrogatepass")
    out, start = [], 0
    while len(data) - start > WINDOW_BYTES:
        cut = data.rfind(b" ", start + WINDOW_BYTES // 2, start + WINDOW_BYTES)
        end = cut if cut > 0 else start + WINDOW_BYTES
        out.append(data[start : end + 1])
        start = end
    return [*out, data[start:]]


def _compressor(content: bytes):
    """A raw-content dictionary of the given bytes; frames without optional fields, so lengths differ by content only."""
    parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters).compress


def _dictionary(size: int, samples: list[bytes], **cover) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, **cover).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the samples themselves
        return b"".join(samples)[-size:]


def _words(text: str) -> list[bytes]:
    return WORD.findall(text.lower().encode("utf-8", "surrogatepass"))


def _stem(word: bytes) -> bytes | None:
    return word[:STEM] if len(word) >= STEM else None


def dictionaries(toxic: list[str], ordinary: list[str], seed: int = 5) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents.

    The ordinary one is trained on windows of ordinary texts.  The toxic one is trained on what toxic texts
    have besides: words, or beginnings of words, that are at least eight times as common in them and
    occur in one of fifty of them.  It is put before the ordinary content, so windows of ordinary text
    compress alike with both.
    """
    word_t, word_o, stem_t, stem_o = Counter(), Counter(), Counter(), Counter()
    for texts, by_word, by_stem in ((toxic, word_t, stem_t), (ordinary, word_o, stem_o)):
        for text in texts:
            own = set(_words(text))
            by_word.update(own)
            by_stem.update({s for w in own if (s := _stem(w))})
    least, odds = max(4, len(toxic) // 50), 8 * len(toxic) / max(1, len(ordinary))

    def marked(w: bytes) -> bool:
        s = _stem(w)
        return (word_t[w] >= least and word_t[w] > odds * (word_o[w] + 1)) or (s is not None and stem_t[s] >= least and stem_t[s] > odds * (stem_o[s] + 1))

    plain = [w for text in ordinary for w in windows(text)]
    random.Random(seed).shuffle(plain)
    base = _dictionary(ORDINARY_BYTES, plain[:60_000]) or b" "
    rest = [b" ".join(w for w in _words(text) if marked(w)) for text in toxic]
    samples = [b" " + r[i : i + 64] + b" " for r in rest if r for i in range(0, len(r), 56)]
    return base, (_dictionary(TOXIC_BYTES, samples, d=6, k=24) if samples else b"") + base


class Judge:
    """Dictionaries, and a logistic rule on how much shorter a text's windows get with the toxic one."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: list[float]):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights

    def __getstate__(self):
        return self.ordinary, self.toxic, self.weights

    def __setstate__(self, state):
        self.ordinary, self.toxic, self.weights = state

    def features(self, text: str) -> list[float]:
        if "fo" not in self.__dict__:
            self.fo, self.ft = _compressor(self.ordinary), _compressor(self.toxic)
        fo, ft = self.fo, self.ft
        gains = np.array([len(fo(w)) - len(ft(w)) for w in windows(text)], dtype=np.float64)
        return [gains.mean(), gains.max(), (gains >= 3).mean(), np.sort(gains)[-3:].mean()]

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], dtype=np.float64).reshape(len(texts), -1)
        z = x @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def calibrated(judge: Judge, texts: list[str], labels: list[int]) -> Judge:
    """Logistic weights by Newton steps (small ridge); the offset is moved so that 0.5 is the best F1 on these texts."""
    x, y = np.array([judge.features(t) for t in texts]), np.array(labels, dtype=float)
    scale = np.maximum(x.std(axis=0), 1e-6)
    a = np.concatenate([np.ones((len(x), 1)), x / scale], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6] + [0.1] * x.shape[1]), a.T @ (y - p) - np.array([0.0] + [0.1] * x.shape[1]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    z = a @ w
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(np.diff(z[order]) != 0, True)
    best = int(np.argmax(np.where(last, f1, -1)))
    cut = z[order][best] if best + 1 == len(z) else (z[order][best] + z[order][best + 1]) / 2
    w[0] -= cut
    return Judge(judge.ordinary, judge.toxic, [float(w[0]), *[float(v) for v in w[1:] / scale]])


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 0


def trained_judge(docs: DataFrame, labels: DataFrame, most_toxic: int = 1500, most_ordinary: int = 5000, most_bytes: int = 16_000, id_col: str = "doc_id", text_col: str = "text") -> Judge | None:
    """The judge, from a bounded sample of labelled rows whose id is not held out; None if a class is missing.

    At most ``most_toxic`` and ``most_ordinary`` documents of at most ``most_bytes`` bytes, those of the smallest id
    hashes.  Three quarters train the dictionaries, the rest calibrates the rule.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))
    short = docs.where(F.octet_length(whole_text(text_col)) <= most_bytes).select(F.col(id_col).alias("doc"), F.octet_length(whole_text(text_col)).alias("bytes"))
    seen = short.where(~held_out("doc")).join(known, F.col("doc") == F.col("id")).select("id", "toxic").distinct()
    order = [F.xxhash64("id"), F.col("id")]
    ids = seen.where("toxic = 1").orderBy(*order).limit(most_toxic).unionByName(seen.where("toxic = 0").orderBy(*order).limit(most_ordinary))
    rows = docs.select(F.col(id_col).alias("doc"), whole_text(text_col).alias("text")).join(F.broadcast(ids), F.col("doc") == F.col("id")).where(F.octet_length("text") <= most_bytes).select("id", "text", "toxic").collect()
    rows = sorted(rows, key=lambda r: (hash((r["id"], 7)), r["id"], r["text"]))
    fit, check = [r for i, r in enumerate(rows) if i % 4], [r for i, r in enumerate(rows) if i % 4 == 0]
    for part in (fit, check):
        if len({r["toxic"] for r in part}) < 2:
            return None
    judge = Judge(*dictionaries([r["text"] for r in fit if r["toxic"]], [r["text"] for r in fit if not r["toxic"]]), [])
    return calibrated(judge, [r["text"] for r in check], [r["toxic"] for r in check])


def _score_step(judge: Judge | None):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000)
                texts = some.column("text").to_pylist()
                scores = np.zeros(len(texts)) if judge is None else judge.scores(texts)
                names = [n for n in some.schema.names if n != "score"]
                yield pa.record_batch([*[some.column(n) for n in names], pa.array(scores)], names=[*names, "score"])

    return step


def scored(docs: DataFrame, judge: Judge | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score in [0, 1] of every whole text.

    Null and empty texts gain nothing with either dictionary and get the lowest rule value; a score depends on the
    text alone, so repeated rows score alike; without a judge (a class had no labels) scores are 0.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_score_step(judge), rows.schema).select("doc_id", "score")


def ordinary_documents(docs: DataFrame, judge: Judge | None, text_col: str = "text") -> DataFrame:
    """The documents that score below 0.5, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    rows = docs.toDF(*names).select(*[n for i, n in enumerate(names) if i != at], F.col(names[at]).isNull().alias("void"), whole_text(names[at]).alias("text"), F.lit(0.0).alias("score"))
    kept = rows.mapInArrow(_score_step(judge), rows.schema).where("score < 0.5")
    back = [F.when(~F.col("void"), F.col("text")) if i == at else F.col(n) for i, n in enumerate(names)]
    return kept.select(*[c.alias(n) for c, n in zip(back, docs.columns, strict=True)])
