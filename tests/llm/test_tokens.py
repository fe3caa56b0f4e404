from __future__ import annotations

import base64
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from revcast.llm.bpe import encoded
from revcast.llm.packing import fit, packed_documents, patterns, plan
from revcast.llm.tokens import CACHE_BYTES, WordEncoder
from tests.llm.conftest import frame

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n", "  a  b \n c\t d ", "don't  we'll 12 345 x   y", "a\n b \n\n c", " lead", "trail ", "x" * 3000, "é" * 900 + " \U0001f600\U0001f600", "a\x1cb \x85 c", "Σας ΣΑΣ <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "é ́e \n̸=", "İstanbul İ", "ﬁ Ⅷ 漢字 עברית", "a" * 5 + " " * 60 + "b"]


@pytest.fixture
def texts(words):
    rng = random.Random(8)
    return list(enumerate(ODD)) + [(100 + i, " ".join(words(rng.choice([3, 40, 400, 4000]), i)).capitalize() + ".") for i in range(60)] + [(100, ODD[5]), (None, "no id")]


def test_byte_pairs_agree_with_the_library(lm_spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANK_FILE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = frame(lm_spark, texts).withColumn("ids", F.lit(1))
    got = sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in encoded(docs, RANK_FILE, public_tokenizers.PATTERN).collect()), key=str)
    want = sorted(((i, np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes(), (t or "").encode()) for i, t in texts), key=str)
    assert got == want
    assert encoded(docs.where("false"), RANK_FILE, public_tokenizers.PATTERN).collect() == []


def test_documents_are_packed_whole(lm_spark, texts):
    tokenizer = Tokenizer.from_file(WORD_FILE)
    docs = frame(lm_spark, texts).withColumn("row", F.lit(1)).withColumn("length", F.lit(1))
    rows = packed_documents(docs, WORD_FILE, with_ids=True).collect()
    whole = sorted((i if i is not None else -1, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()) for i, t in texts)
    by_doc = defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["start"] == 2048 * r["piece"] and r["length"] <= 2048
        by_doc[r["doc_id"] if r["doc_id"] is not None else -1].append((r["piece"], bytes(r["ids"])))
    once = [(i, b) for i, b in whole if i != 100]
    assert [(i, b"".join(p for _, p in sorted(by_doc[i]))) for i, _ in once] == once
    assert sorted(b for _, b in by_doc[100]) == sorted(b[k : k + 8192] for i, b in whole if i == 100 for k in range(0, len(b), 8192))
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(filled) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packed_documents(docs.where("false"), WORD_FILE).collect() == []


def test_words_agree_with_the_library_on_odd_texts():
    """Blanks, stops, quotes, digits and accents in any order, 20,000 times, with a cache that is dropped now and then."""
    tokenizer, rng = Tokenizer.from_file(WORD_FILE), random.Random(4)
    stock = ["a", "foo", "Bar", "don't", "we'll", "'s", "'", '"', ".", ",", ".", ",", " ", " ", " ", "  ", "\n", "\t", "1", "23", "é", "Éa", "ß", "-", "!", "?", "<|", "|>", "\u0301", "漢", "\u00a0", "\u0130", "\u2026", "$"]
    texts = ["foo .. bar", "so ,, what", "a ., b", "end ..", "x,. y", "x., y", "...", ". . ,", "a.b. c", "!. x"]
    texts += ["".join(rng.choice(stock) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    encoder = WordEncoder(WORD_FILE)
    for start in range(0, len(texts), 500):
        some = texts[start : start + 500]
        want = [np.array(x.ids, dtype="<u4").tobytes() for x in tokenizer.encode_batch(some, add_special_tokens=False)]
        wrong = [(t, a, b) for t, a, b in zip(some, encoder.encode(some), want, strict=True) if a != b]
        assert not wrong, wrong[:3]
        encoder.held = CACHE_BYTES + 1 if start % 5000 == 0 else encoder.held


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(64, rng.geometric(0.06, 5000)) if seed % 2 else rng.integers(1, 65, 5000)
    histogram = np.bincount(sizes, minlength=65)
    used = np.zeros(65, dtype=int)
    sequences = 0
    for n, parts in plan(histogram, 64):
        assert sum(v * m for v, m in parts) <= 64
        for v, m in parts:
            used[v] += n * m
        sequences += n
    assert (used == histogram).all()
    assert sequences <= 1.01 * -(-int(sizes.sum()) // 64) + 2


def test_fit_has_no_gradient_left_where_positive():
    histogram = np.bincount([60, 60, 4, 4, 30, 34, 32, 32, 20, 24, 20], minlength=65).astype(float)
    rows = patterns(np.flatnonzero(histogram), histogram[histogram > 0], 64)
    assert (rows.sum(axis=1) == 64).all()
    x = fit(rows, histogram, 4000)
    left = -histogram.copy()
    for j in range(3):
        left += np.bincount(rows[:, j], weights=x, minlength=65)
    left[0] = 0
    slope = left[rows].sum(axis=1)
    assert (x >= 0).all() and np.abs(slope[x > 1e-6]).max() < 1e-3 and slope[x <= 1e-6].min(initial=0) > -1e-3
