"""Language-model scores by cross-entropy difference of two matched word bigram models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.llm.common import whole_text
from revcast.llm.words import Words, mix, pieces

WORD_BITS = 17
PRIOR = 0.5
STRENGTH = 20.0
BLOCK_BYTES = 16_000_000
LEAST_BLOCKS = 192


class Block:
    """The words of a block of texts: ``words`` and ``pairs`` are its different 64-bit keys in order, ``word`` and ``pair`` the places of each word and pair there.

    ``second`` is the index of each pair's second word; a text's first word has no pair.
    """

    def __init__(self, texts: pa.Table):
        hashes, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for batch in texts.to_batches():
            for some in pieces(batch):
                words = Words(some.column("text"))
                hashes.append(words.hash)
                counts.append(words.counts())
        h, self.counts = np.concatenate(hashes), np.concatenate(counts)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.second = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1
        self.words, self.word = np.unique(h, return_inverse=True)
        self.pairs, self.pair = np.unique(mix(h[self.second - 1] * np.uint64(3) + h[self.second]), return_inverse=True)

    def counted(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of ``words`` (target, background, and both as a pair's first word) and ``pairs`` (target, background)."""

        def of(places: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
            return [np.bincount(places[target[self.doc[at]]], minlength=size), np.bincount(places, minlength=size)]

        every, first = np.arange(len(self.doc)), self.second - 1
        words = of(self.word, every, len(self.words)) + of(self.word[first], first, len(self.words))
        return np.stack(words), np.stack(of(self.pair, self.second, len(self.pairs)))


def _packed(x: np.ndarray) -> bytes:
    """64-bit numbers, equal bytes of them side by side."""
    return pa.compress(np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(8, n).T).reshape(-1).view(kind)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ends of the ranges of ordered keys that the buckets hold."""
    bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


ASKED = "bucket int, block int, n_words int, words binary, word_counts binary, n_pairs int, pairs binary, pair_counts binary"
TOLD = "block int, bucket int, n_words int, word_counts binary, n_pairs int, pair_counts binary, vocabulary long, target long, background long"


def _ask_step(buckets: int):
    """A block's keys and counts, one row for each bucket of keys."""

    def step(texts: pa.Table, good: pa.Table) -> pa.Table:
        rows = []
        if texts.num_rows:
            block = Block(texts)
            ids = texts.column("doc_id")
            known = ids.is_valid().to_numpy()
            target = known & np.isin(ids.fill_null(0).to_numpy(), good.column("good_id").to_numpy())
            words, pairs = block.counted(target)
            at = texts.column("block")[0].as_py()
            w, p = _cuts(block.words, buckets), _cuts(block.pairs, buckets)
            for b in range(buckets):
                i, j = slice(w[b], w[b + 1]), slice(p[b], p[b + 1])
                gaps = [np.diff(keys, prepend=np.uint64(0)) for keys in (block.words[i], block.pairs[j])]
                rows.append((b, at, w[b + 1] - w[b], _packed(gaps[0]), _packed(words[:, i]), p[b + 1] - p[b], _packed(gaps[1]), _packed(pairs[:, j])))
        return _table(rows, ASKED)

    return step


def _tell_step(asked: pa.Table) -> pa.Table:
    """For each block the counts of its keys over all blocks, and what all words of the bucket come to."""
    rows = asked.to_pylist()
    told = []
    for n, keys, counts, size in (("n_words", "words", "word_counts", 4), ("n_pairs", "pairs", "pair_counts", 2)):
        own = [np.cumsum(_unpacked(r[keys], r[n], np.uint64), dtype=np.uint64) for r in rows]
        every, place = np.unique(np.concatenate(own), return_inverse=True)
        total = np.zeros((size, len(every)), dtype=np.int64)
        cut = np.cumsum([0] + [len(x) for x in own])
        places = [place[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
        for r, at in zip(rows, places, strict=True):
            total[:, at] += _unpacked(r[counts], size * r[n]).reshape(size, -1)
        told.append((total, places))
    (words, at_words), (pairs, at_pairs) = told
    whole = (words.shape[1], int(words[0].sum()), int(words[1].sum()))
    return _table([(r["block"], r["bucket"], r["n_words"], _packed(words[:, i]), r["n_pairs"], _packed(pairs[:, j]), *whole) for r, i, j in zip(rows, at_words, at_pairs, strict=True)], TOLD)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def losses(block: Block, words: np.ndarray, pairs: np.ndarray, size: tuple[int, int], vocabulary: int) -> np.ndarray:
    """(2, words): negative log-probability of every word under both models.

    A pair's probability is its count smoothed towards the word's own by Dirichlet mass; both models
    have the same vocabulary, order and smoothing.  The prior is spread over 2^17 words, or over the
    different words of the corpus if there are more, so the words' probabilities never sum to more than 1.
    """
    spread = max(1 << WORD_BITS, vocabulary)
    out = np.empty((2, len(block.word)))
    for m in range(2):
        base = ((words[m] + PRIOR) / (size[m] + PRIOR * spread))[block.word]
        p = base.copy()
        p[block.second] = (pairs[m][block.pair] + STRENGTH * base[block.second]) / (words[2 + m][block.word[block.second - 1]] + STRENGTH)
        out[m] = -np.log(p)
    return out


SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _score_step(texts: pa.Table, told: pa.Table) -> pa.Table:
    if not texts.num_rows:
        return _table([], SCORES)
    block = Block(texts)
    rows = sorted(told.to_pylist(), key=lambda r: r["bucket"])
    words, pairs = (np.concatenate([_unpacked(r[c], k * r[n]).reshape(k, -1) for r in rows], axis=1) for c, n, k in (("word_counts", "n_words", 4), ("pair_counts", "n_pairs", 2)))
    if words.shape[1] != len(block.words) or pairs.shape[1] != len(block.pairs):
        raise RuntimeError("the counts are of another block")
    loss = losses(block, words, pairs, tuple(sum(r[m] for r in rows) for m in ("target", "background")), sum(r["vocabulary"] for r in rows))
    n = block.counts
    target, background = (np.bincount(block.doc, weights=loss[m], minlength=len(n)) / np.maximum(n, 1) for m in range(2))
    return pa.table([texts.column("doc_id"), pa.array(n, pa.int64()), pa.array(target), pa.array(background), pa.array(target - background)], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (nats a word; lower: more like the target).

    The target is every document labelled ``quality`` 1, the background every document.  Words are runs of
    letters and digits, case folded.  A null or empty text has no words and score 0; null ids are scored too;
    repeated rows count and are scored each; without target rows both models of words are smoothed priors and
    scores still have a value; an empty table gives no rows.

    Every word and pair is counted by its own 64-bit key.  Documents are dealt over blocks by their ids.  A block
    sends each of its different keys once, with its counts, to the range of keys (bucket) it lies in; there the
    counts of all blocks are summed and those a block asked for go back to it.  Blocks and buckets grow
    in number with the texts, not in size, and no table is gathered on the driver or broadcast.  Only rows of
    one id meet in a block whatever their number.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(-(-size // BLOCK_BYTES), min(LEAST_BLOCKS, n), 1)

    def dealt(key):
        return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block")

    texts = rows.select("doc_id", "text", dealt(F.coalesce("doc_id", F.xxhash64("text"))))
    good = labels.where(f"quality = 1 and {id_col} is not null").select(F.col(id_col).cast("long").alias("good_id")).select("good_id", dealt(F.col("good_id")))
    asked = texts.groupBy("block").cogroup(good.groupBy("block")).applyInArrow(_ask_step(blocks), ASKED)
    told = asked.groupBy("bucket").applyInArrow(_tell_step, TOLD)
    return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score_step, SCORES).withColumnRenamed("doc_id", id_col)
