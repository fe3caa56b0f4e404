"""Token ids by a public tokenizer, with a bounded cache of encoded words."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

CACHE_BYTES = 100_000_000
# what an entry takes besides its characters and ids: two objects and its place in the table
ENTRY_BYTES = 200
LINE_WORDS = 200
STOPS = frozenset(".,")
RUNS_OF_STOPS = ("..", ",,", ".,", ",.")
BEYOND = re.compile("[^\x00-\u024f]")
# the tokenizer's split pattern, a fixed value of its file
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ENCODERS: dict[str, "WordEncoder"] = {}


def _latin(text: str) -> bool:
    """Below U+0250 no mark combines, and lower case of all but one letter is letter by letter; "<|" may begin a special token."""
    return "<|" not in text and (text.isascii() or ("\u0130" not in text and not BEYOND.search(text)))


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it, so the ids of a text are those
    of its parts between blanks and line ends, one after another.  In Latin text a comma or full stop after a
    word is a part of its own, as it is for the tokenizer.  Parts that are not in the cache are cut by the
    tokenizer's own pattern; distinct words are encoded in long lines, and end-of-word tokens tell where each
    one ends.  Stops side by side, or after another mark, are one match: such texts are cut at blanks only.  The cache
    is dropped when it has grown beyond ``CACHE_BYTES``.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.last[i] = token.endswith("</w>")

    def _forget(self) -> None:
        self.parts: dict[str, bytes] = {"": b""}
        self.held = 0
        # parts after which a comma or full stop would belong to the same match
        self.marked: set[str] = set()

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > CACHE_BYTES:
            self._forget()
        latin = [_latin(t) for t in texts]
        lines = [(t.lower() if own else t).replace("\n", " ") for t, own in zip(texts, latin, strict=True)]
        split = [(f"{t} ".replace(". ", " . ").replace(", ", " , ") if own else t).split(" ") for t, own in zip(lines, latin, strict=True)]
        self._learn(split)
        marked = self.marked

        def joined(line: str, own: list[str]) -> bool:
            return any(x in line for x in RUNS_OF_STOPS) or (not marked.isdisjoint(own) and any(b in STOPS and a in marked for a, b in zip(own, own[1:])))

        again = [i for i, own in enumerate(latin) if own and joined(lines[i], split[i])]
        for i in again:
            split[i] = lines[i].split(" ")
        self._learn([split[i] for i in again])
        get = self.parts.__getitem__
        return [b"".join(map(get, own)) for own in split]

    def _learn(self, split: list[list[str]]) -> None:
        parts = self.parts
        words, cut = [], {}
        new = {w for own in split for w in own if w not in parts}
        for w in new:
            if w.isalpha() and (w.isascii() or _latin(w)):
                words.append(w)
                continue
            if _latin(w):
                cut[w] = WORD.findall(w.lower())
            else:
                parts[w] = self._ids(w)
        lower = {w.lower() for w in words}
        lower.update(x for own in cut.values() for x in own)
        self._learn_words([w for w in lower if w not in parts])
        for w in words:
            if w not in parts:
                parts[w] = parts[w.lower()]
        for w, own in cut.items():
            parts[w] = b"".join([parts[x] for x in own])
        # a match found inside a part can be a part by itself later
        self.marked.update(w for w in new | lower if not w[-1].isalnum() and w not in STOPS)
        # text and ids of a part take at most some six bytes a character
        self.held += sum(ENTRY_BYTES + 6 * len(w) for w in new | lower)

    def _learn_words(self, new: list[str]) -> None:
        """Words that are one match of the pattern each."""
        groups = [new[i : i + LINE_WORDS] for i in range(0, len(new), LINE_WORDS)]
        lines = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, line in zip(groups, lines, strict=True):
            ids = np.array(line.ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(group):
                for w in group:
                    self.parts[w] = self._ids(w)
                continue
            blob, at = ids.tobytes(), 0
            for w, end in zip(group, (4 * ends).tolist(), strict=True):
                self.parts[w] = blob[at:end]
                at = end

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def piece_step(path: str, size: int, end_id: int):
    """mapInArrow step from (doc_id, text) to pieces (doc_id, piece, start, length, ids)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        width = 4 * size
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                some = batch.slice(low, 500)
                ids, piece, start, length, blob = [], [], [], [], []
                for d, data in zip(some.column("doc_id").to_pylist(), encoder.encode(some.column("text").to_pylist()), strict=True):
                    data += end
                    for p in range(-(-len(data) // width)):
                        part = data[p * width : (p + 1) * width]
                        ids.append(d)
                        piece.append(p)
                        start.append(p * size)
                        length.append(len(part) // 4)
                        blob.append(part)
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(blob, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return step
