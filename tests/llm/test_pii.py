from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from revcast.llm import bilstm, pii
from tests.llm.conftest import frame

EXAMPLES = ["mail ab.c@d-e.org now", "at 10.2.33.4 or 10.2.33.456 and 1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "call +1 (301) 555-0346 please", "+12 345", "a@b a@b.c_d@e.f", ""]


def brute_spans(text):
    """The rules, by trying every start and the longest end."""
    local, host = "._%+-", "-"
    alnum = lambda c: c.isascii() and c.isalnum()
    out = {k: [] for k in bilstm.KINDS}

    def scan(match, keep, kind):
        at = 0
        while at < len(text):
            end = match(at)
            if end is None:
                at += 1
                continue
            if keep(text[at:end]):
                out[kind].append((at, end))
            at = end

    def email(at):
        i = at
        while i < len(text) and (alnum(text[i]) or text[i] in local):
            i += 1
        if i == at or i >= len(text) or text[i] != "@":
            return None
        j = i + 1
        while j < len(text) and (alnum(text[j]) or text[j] in host):
            j += 1
        if j == i + 1:
            return None
        end = None
        while j < len(text) and text[j] == ".":
            k = j + 1
            while k < len(text) and (alnum(text[k]) or text[k] in host):
                k += 1
            if k == j + 1:
                break
            j = end = k
        return end

    def digits(i):
        while i < len(text) and text[i] in "0123456789":
            i += 1
        return i

    def ip(at):
        i = digits(at)
        if i == at:
            return None
        for _ in range(3):
            if i >= len(text) or text[i] != ".":
                return None
            j = digits(i + 1)
            if j == i + 1:
                return None
            i = j
        return i

    def card(at):
        if text[at] not in "0123456789":
            return None
        end, n = at + 1, 1
        while True:
            if end < len(text) and text[end] in "0123456789":
                end += 1
            elif end + 1 < len(text) and text[end] in " -" and text[end + 1] in "0123456789":
                end += 2
            else:
                break
            n += 1
        return end if n > 1 else None

    def phone(at):
        if text[at] != "+" or at + 3 > len(text) or text[at + 1 : at + 2] not in tuple("0123456789"):
            return None
        i = at + 2
        while i < len(text) and text[i] in " ().-0123456789":
            i += 1
        while i > at + 3 and text[i - 1] not in "0123456789":
            i -= 1
        return i if i > at + 3 and text[i - 1] in "0123456789" else None

    def luhn_ok(s):
        d = [int(c) for c in s if c.isdigit()]
        total = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        return 16 <= len(d) <= 19 and total % 10 == 0

    scan(email, lambda s: True, "email")
    scan(ip, lambda s: all(int(p) <= 255 for p in s.split(".")), "ip")
    scan(card, luhn_ok, "card")
    scan(phone, lambda s: 8 <= sum(c.isdigit() for c in s) <= 15, "phone")
    return out


@pytest.mark.parametrize("seed", range(30))
def test_patterns_agree_with_brute_force(seed):
    rng = random.Random(seed)
    parts = ["a", "B.", "@", "-", "_", ".", " ", "+", "(", ")", "12", "4", "255", "999", "x.y", "4111 1111 1111 1111", "10.0.0.1", "+1 (301) 555-0346", "q@w.e", "é", "٣"]
    text = "".join(rng.choice(parts) for _ in range(120))
    assert pii.base_spans(text) == brute_spans(text)
    for t in EXAMPLES:
        assert pii.base_spans(t) == brute_spans(t)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    codes, tags = bilstm.labelled([("hello there a b c and more words to have forty letters", [])], rng)
    codes, tags = np.ascontiguousarray(codes[:6, :20].T).astype(np.intp), np.ascontiguousarray(tags[:6, :20].T).astype(np.intp)
    tags[:] = 0
    tags[3:6] = [[1], [2], [2]]
    shapes = [(2, bilstm.SYMBOLS, 32), (2, 8, 32), (16, 9), (9,)]
    model = bilstm.Tagger(*[rng.normal(0, 0.4, s) for s in shapes], bilstm.allowed())
    alone = bilstm.ALONE
    bilstm.ALONE = 0.0
    try:
        _, grads = bilstm.gradients(model, codes, tags)
        for p, g in zip(model.parameters(), grads, strict=True):
            at = np.unravel_index(np.abs(g * (np.abs(p) < 100)).argmax(), g.shape)
            was, eps = p[at], 1e-2
            p[at] = was + eps
            up = bilstm.gradients(model, codes, tags)[0]
            p[at] = was - eps
            down = bilstm.gradients(model, codes, tags)[0]
            p[at] = was
            assert abs((up - down) / (2 * eps) - g[at]) < 0.05 * abs(g[at]) + 2e-3
    finally:
        bilstm.ALONE = alone


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(1)
    stock = ["the", "and", "onth", "erre", "tion", "was", "ly", "Ing", "outh", "are,", "it.", "8", "2024"]
    texts = [(" ".join(rng.choice(stock) for _ in range(18)), []) for _ in range(300)]
    return bilstm.train(texts)


def test_unseen_data_are_found(tagger):
    rng = np.random.default_rng(99)
    hit = 0
    for _ in range(200):
        kind, datum = bilstm.invented(rng)
        text = f"the and onth {datum} was ly it. erre tion"
        hit += (kind, 13, 13 + len(datum)) in tagger.spans([bilstm.encode_chars(text)])[0]
    assert hit >= 170


def test_skipping_windows_changes_nothing(tagger):
    rng = np.random.default_rng(5)
    windows = [bilstm.encode_chars(" ".join(["outh", "are,", bilstm.invented(rng)[1] if i % 3 == 0 else "ly", "tion was"] * (1 + i % 4))) for i in range(60)]
    fast = tagger.spans(windows)
    for w, spans in zip(windows, fast, strict=True):
        codes = w.astype(np.intp)[:, None]
        emit = tagger.hidden(codes).reshape(len(w), 1, -1) @ tagger.output + tagger.bias
        assert bilstm.tag_spans(tagger.best_path(emit, codes > 0)[:, 0]) == spans


def test_windows_cover_every_place_once():
    for length in (1, 63, 64, 65, 511, 512, 513, 5000):
        spans = pii.windows_of(length)
        assert spans[0][0] == 0 and spans[-1][1] == length
        for at in range(0, length, 7):
            seen = [(0, at, at + 1, s, e) for s, e in spans if s <= at < e]
            assert pii.reconciled(seen, length) == [(0, at, at + 1)]


def test_documents(lm_spark, tagger):
    long = "outh are ly " * 700
    texts = [(1, EXAMPLES[0]), (2, None), (3, ""), (4, long + EXAMPLES[3] + long), (5, EXAMPLES[2]), (5, EXAMPLES[2]), (None, EXAMPLES[1]), (7, "écrire (301) 555-0346 the and onth")]
    docs = frame(lm_spark, texts).withColumn("spans", F.lit(1)).withColumn("c0", F.lit("z"))
    got = pii.spans(docs, tagger).collect()
    assert len(got) == len(texts)
    by = {r["doc_id"]: r["spans"] for r in got}
    for i, t in texts:
        base = sorted((s.kind, s.start, s.end) for s in by[i] if s.base)
        assert base == sorted((k, *x) for k, own in brute_spans(t or "").items() for x in own)
    assert [(s.kind, s.start, s.end, s.base) for s in by[7]] == [("phone", 7, 21, False)]
    clean = pii.masked(docs, tagger)
    assert clean.columns == docs.columns and clean.count() == len(texts)
    rows = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert rows[1] == "mail <email> now" and rows[2] is None and rows[3] == "" and rows[4] == long + "call <phone> please" + long and rows[7] == "écrire <phone> the and onth"
    assert pii.spans(docs.where("false"), tagger).collect() == []


def test_training_sample(lm_spark, words):
    docs = frame(lm_spark, [(i, " ".join(words(60, i)) + " a.b@c.org " + " ".join(words(60, i + 1))) for i in range(40)] + [(None, None)])
    tagger = pii.trained_tagger(docs, sample_docs=30)
    assert len(tagger.parameters()) == 5 and all(np.isfinite(p).all() for p in tagger.parameters())
