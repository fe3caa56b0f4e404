"""Byte-level BPE in numpy: length-bucketed padded matrices of ids, merged round by round."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.llm.common import whole_text

CACHE_PARTS = 400_000
CELLS = 2_000_000
NO_RANK = np.int64(2**62)
# blanks at the ends or beside other white space
LOOSE = re.compile(r"\A | \Z| \s|\s ")


class BytePairs:
    """A rank file: token bytes, and the merges that its ranks imply as a hash table of id pairs."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.by_bytes = ranks
        merges = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    merges[(left << 32) | right] = rank
        self._table(np.fromiter(merges.keys(), np.int64, len(merges)), np.fromiter(merges.values(), np.int64, len(merges)))
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, at most a quarter full."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, dtype=np.int64), np.full(size, NO_RANK, dtype=np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            at = slot[todo] & (size - 1)
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[todo[free]]
            placed = self.keys[at] == keys[todo]
            self.values[at[placed]] = values[todo[placed]]
            todo = todo[~placed]
            slot[todo] += 1
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK where there is no merge; -1 ids are padding."""
        keys = (left << 32) | right
        out = np.full(keys.shape, NO_RANK, dtype=np.int64)
        todo = np.flatnonzero((left >= 0).ravel() & (right >= 0).ravel())
        flat, slot = keys.ravel(), self._slot(keys.ravel())
        found = out.ravel()
        for _ in range(self.probes + 1):
            at = slot[todo] & (len(self.keys) - 1)
            hit = self.keys[at] == flat[todo]
            found[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (self.keys[at] != -1)]
            if not len(todo):
                break
            slot[todo] += 1
        return found.reshape(keys.shape)

    def merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Merge every row of a padded matrix (-1 at the ends) to the end; rows keep their order.

        Each round every unfinished row merges its leftmost pair of least rank and closes the gap.  Ranks are
        looked up once; a merge changes those of its two neighbours only.
        """
        out = ids
        live = np.arange(len(ids))
        ranks = self.rank(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.zeros((len(ids), 0), dtype=np.int64)
        work = ids.copy()
        while ranks.shape[1]:
            best = ranks.argmin(axis=1)
            value = ranks[np.arange(len(work)), best]
            go = value < NO_RANK
            if not go.all():
                done = ~go
                out[live[done]] = -1
                out[live[done], : work.shape[1]] = work[done]
                work, ranks, live, best, value = work[go], ranks[go], live[go], best[go], value[go]
                if not len(work):
                    return out
            rows = np.arange(len(work))
            work[rows, best] = value
            column = np.arange(work.shape[1] - 1)
            shift = column[None, :] > best[:, None]
            work[:, :-1] = np.where(shift, work[:, 1:], work[:, :-1])
            work[:, -1] = -1
            moved = column[:-1][None, :] >= best[:, None]
            ranks[:, :-1] = np.where(moved, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NO_RANK
            right = work[rows, np.minimum(best + 1, work.shape[1] - 1)]
            ranks[rows, best] = self.rank(value, right)
            before = np.maximum(best - 1, 0)
            left = np.where(best > 0, work[rows, before], -1)
            ranks[rows, before] = np.where(best > 0, self.rank(left, value), ranks[rows, before])
            width = int((work >= 0).any(axis=0).sum())
            if width < work.shape[1]:
                work, ranks = work[:, :width].copy(), ranks[:, : max(0, width - 1)].copy()
        out[live] = -1
        out[live, : work.shape[1]] = work
        return out

    def encode_parts(self, parts: list[str]) -> None:
        """Add the ids of pattern matches to the cache, in matrices of like lengths."""
        data = [p.encode("utf-8") for p in parts]
        lengths = np.array([len(d) for d in data])
        order = np.argsort(lengths, kind="stable")
        low = 0
        while low < len(order):
            width = int(lengths[order[low]])
            bucket = 1 << max(2, (width - 1).bit_length())
            high = int(np.searchsorted(lengths[order], bucket, side="right"))
            high = min(high, low + max(1, CELLS // bucket))
            some = order[low:high]
            widest = int(lengths[some].max())
            flat = np.frombuffer(b"".join([data[i] for i in some]), dtype=np.uint8)
            ids = np.full((len(some), widest), -1, dtype=np.int64)
            ids[np.arange(widest)[None, :] < lengths[some][:, None]] = self.byte_id[flat]
            ids = self.merge_rows(ids)
            counts = (ids >= 0).sum(axis=1)
            blob = ids[ids >= 0].astype("<u4").tobytes()
            at = 0
            for i, n in zip(some.tolist(), counts.tolist(), strict=True):
                # a match that is itself a token is that token
                whole = self.by_bytes.get(data[i])
                self.parts[parts[i]] = blob[at : at + 4 * n] if whole is None else int(whole).to_bytes(4, "little")
                at += 4 * n
            low = high

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit bytes.

        A match never spans a blank between two other characters, and takes that blank with
        what follows; such words are looked up before the pattern is run on them.
        """
        split = [self._split(t) for t in texts]
        if len(self.words) > CACHE_PARTS or len(self.parts) > CACHE_PARTS:
            self.words, self.parts = {}, {}
        words, parts = self.words, self.parts
        missing = list({w for own in split for w in own if w not in words})
        matched = [self.pattern.findall(w) for w in missing]
        new = list({m for own in matched for m in own if m not in parts})
        if new:
            self.encode_parts(new)
        for w, own in zip(missing, matched, strict=True):
            words[w] = parts[own[0]] if len(own) == 1 else b"".join([parts[m] for m in own])
        get = words.__getitem__
        return [b"".join(map(get, own)) for own in split]

    @staticmethod
    def _split(text: str) -> list[str]:
        if not text:
            return []
        parts = text.split(" ")
        if not LOOSE.search(text):
            return [parts[0], *[" " + p for p in parts[1:]]]
        out, held = [], None
        for i, p in enumerate(parts):
            lead = p if i == 0 else " " + p
            safe = held is not None and held != "" and not held[-1].isspace() and p != "" and not p[0].isspace()
            if held is None:
                held = lead
            elif safe:
                out.append(held)
                held = lead
            else:
                held += lead
        out.append(held)
        return out

    def decode(self, data: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(data, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def byte_pairs(path: str, pattern: str) -> BytePairs:
    return BytePairs(path, pattern)


def _step(path: str, pattern: str):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(path, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                some = batch.slice(low, 200)
                ids = pairs.encode(some.column("text").to_pylist())
                yield pa.record_batch([some.column("doc_id"), pa.array(ids, pa.binary()), pa.array([pairs.decode(i) for i in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return step


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded (bytes of the ids): whole texts, no special tokens.

    Null and empty texts have no ids.  Rows are independent: repeated rows, null ids and other columns do
    not matter; an empty table gives no rows.  A text without blanks is one part, however long.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(_step(path, pattern), "doc_id long, ids binary, decoded binary")
