"""Words and shingles of Arrow text columns, hashed in numpy over whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(PRIME), -1, 2**64))
SHINGLE_WORDS = 5


def _folded() -> np.ndarray:
    """0 for separators (ASCII other than letters and digits), else the byte with ASCII case folded."""
    out = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128 or c.isalnum():
            out[b] = ord(c.lower()) if b < 128 else b
    return out


FOLDED = _folded()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((PRIME, INVERSE)):
            full = np.full(size, base, dtype=np.uint64)
            full[0] = 1
            _POWERS[i] = np.multiply.accumulate(full)
    return _POWERS[0][:n], _POWERS[1]


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with few bytes of text each, so that arrays over the bytes stay small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + PIECE_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end


class Words:
    """Words of each text: ``hash`` per word, ``doc`` its text, ``start``/``end`` bytes in ``bytes``; text d has bytes ``at[d]:at[d+1]``."""

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        n = len(texts)
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
        raw = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
        self.bytes, self.at = raw, offsets - offsets[0]
        folded = FOLDED[raw]
        word = folded > 0
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[self.at] = True
        self.start = np.flatnonzero(word & (edge[:-1] | ~np.concatenate(([False], word[:-1]))[: len(raw)]))
        self.end = np.flatnonzero(word & (edge[1:] | ~np.concatenate((word[1:], [False]))[: len(raw)])) + 1
        self.doc = np.searchsorted(self.at, self.start, side="right") - 1 if len(self.start) else np.zeros(0, dtype=np.int64)
        self.docs = n
        power, inverse = _powers(len(raw) + 1)
        sums = np.cumsum(folded.astype(np.uint64) * power[: len(raw)])
        value = sums[self.end - 1] - np.where(self.start > 0, sums[self.start - 1], np.uint64(0)) if len(self.start) else np.zeros(0, dtype=np.uint64)
        self.hash = mix(value * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.doc, np.arange(n + 1))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(words: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``size`` words; a text of fewer words has one shingle of all of them."""
    h, doc, n = words.hash, words.doc, len(words.hash)
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    out = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for k in range(size):
        out += mix(h[k : n - size + 1 + k] + np.uint64(k + 1)) if n >= size else np.uint64(0)
    keep = doc[: n - size + 1] == doc[size - 1 :] if n >= size else np.zeros(0, dtype=bool)
    out, of = mix(out[keep]), doc[: max(0, n - size + 1)][keep]
    if len(short):
        extra = np.array([mix(np.sum(mix(h[words.first[d] : words.first[d + 1]] + np.arange(101, 101 + counts[d], dtype=np.uint64)), dtype=np.uint64, keepdims=True))[0] for d in short], dtype=np.uint64)
        out, of = np.concatenate([out, extra]), np.concatenate([of, short])
    return out, of
