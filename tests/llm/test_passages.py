from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revcast.llm import passages
from revcast.llm.passages import BANDS, Anchors, Text, _lowest, alike_runs, band_keys, repeated_passages, shared_runs, verified_runs
from revcast.llm.words import Words
from tests.llm.conftest import frame


def brute(texts):
    """Words of each document that lie in a run of 51 words that another document has too, and those whose run a smaller id has."""
    homes = {}
    split = {i: (t or "").lower().split() for i, t in texts}
    for i, w in split.items():
        for s in range(len(w) - 50):
            homes.setdefault(tuple(w[s : s + 51]), set()).add(i)
    shared, later = {}, {}
    for i, w in split.items():
        for s in range(len(w) - 50):
            own = homes[tuple(w[s : s + 51])]
            if len(own) > 1:
                shared.setdefault(i, set()).update(range(s, s + 51))
                if min(own) < i:
                    later.setdefault(i, set()).update(range(s, s + 51))
    return shared, later


@pytest.fixture
def corpus(words):
    rng = random.Random(12)
    texts = [words(rng.randint(60, 260), 10_000 + i) for i in range(60)]
    for p, n in ((words(51, 71), 4), (words(66, 72), 9), (words(140, 73), 3), (words(40, 74), 5), (words(30, 75), 20)):
        for i in rng.sample(range(60), n):
            at = rng.randrange(len(texts[i]))
            texts[i][at:at] = p
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, "short text"), (103, "na " * 200), (104, " ".join(texts[5]))]


def covered(text, spans):
    """Words of a text that lie in code point spans."""
    out, at = set(), 0
    for n, w in enumerate(text.split()):
        at = text.index(w, at)
        if any(s <= at and at + len(w) <= e for s, e in spans):
            out.add(n)
        at += len(w)
    return out


def test_every_verbatim_passage_is_found(lm_spark, corpus):
    docs = frame(lm_spark, corpus).withColumn("key", F.lit(1)).withColumn("start", F.lit(1)).withColumn("head", F.lit(1))
    rows = repeated_passages(docs).collect()
    shared, later = brute(corpus)
    texts = dict(corpus)
    assert {r["doc_id"] for r in rows} == set(shared)
    for i in shared:
        gone = covered(texts[i], [(r["start"], r["end"]) for r in rows if r["doc_id"] == i and r["removed"]])
        assert later.get(i, set()) <= gone
        assert len(gone - shared[i]) <= 24  # runs that are like at 0.8 may reach a few words beyond
    for r in rows:
        assert texts[r["doc_id"]][r["start"] : r["end"]].strip() == texts[r["doc_id"]][r["start"] : r["end"]]
        assert r["class_id"] <= r["doc_id"]


def test_a_passage_behind_a_common_line(lm_spark, words):
    """Passages that the first document of their line lacks are found with each other."""
    common, p = words(40, 1), words(60, 2)
    texts = [(i, " ".join(words(70, 50 + i) + common + words(70, 80 + i))) for i in range(6)]
    texts += [(10 + i, " ".join(words(30, 150 + i) + common + p + words(30, 180 + i))) for i in range(4)]
    rows = repeated_passages(frame(lm_spark, texts)).collect()
    assert {r["doc_id"] for r in rows} == {10, 11, 12, 13}
    assert {r["doc_id"] for r in rows if r["removed"]} == {11, 12, 13}


def test_alike_paragraphs_meet_in_a_band_beside_a_common_line():
    rng = np.random.default_rng(8)
    met = specific = 0
    for _ in range(300):
        line, rest = rng.integers(0, 2**62, 30, dtype=np.uint64), rng.integers(0, 2**62, 21, dtype=np.uint64)
        edited = rest.copy()
        edited[rng.integers(0, 21)] = 7
        other = np.concatenate([line, rng.integers(0, 2**62, 21, dtype=np.uint64)])
        x, y, z = (set(band_keys(w).tolist()) for w in (np.concatenate([line, rest]), np.concatenate([line, edited]), other))
        assert len(x) == BANDS
        met += bool(x & y)
        specific += bool((x & y) - z)
    assert met >= 299 and specific >= 285


def test_places_of_a_line_that_repeats():
    """Texts of one word or of one line over and over, in well under a second for each pair."""
    def anchors(x, y):
        sides = []
        for t in (x, y):
            w = Words(pa.array([t]))
            found = Anchors(w)
            sides.append((w.hash, {int(k): sorted(set(found.anchor[found.key == k].tolist())) for k in np.unique(found.key)}))
        (wa, left), (wb, right) = sides
        return verified_runs(wa, wb, [(k, left[k], right[k]) for k in left if k in right], 0.8)

    runs, rest = anchors("na " * 4000, "na " * 3000)
    assert not rest and set().union(*(range(s, e) for s, e, _, _ in runs)) == set(range(4000)) and set().union(*(range(u, v) for _, _, u, v in runs)) == set(range(3000))
    line = " ".join(f"line{i}" for i in range(26))
    mixed = [" ".join(f"{line} " + " ".join(f"{side}{n}x{i}" for i in range(30)) for n in range(200)) for side in "ab"]
    runs, rest = anchors(*mixed)
    assert not runs and sum(len(p) for _, p in rest) >= 200


def test_copies_with_other_words_between(lm_spark, words):
    p = words(120, 5)
    changed = [*p[:60], "changed", *p[61:]]
    texts = [(1, " ".join(words(40, 6) + p)), (2, " ".join(changed + words(40, 7))), (3, " ".join(words(200, 8)))]
    rows = repeated_passages(frame(lm_spark, texts)).collect()
    assert {(r["doc_id"], r["removed"]) for r in rows} == {(1, False), (2, True)}
    assert len(covered(dict(texts)[2], [(r["start"], r["end"]) for r in rows if r["doc_id"] == 2])) >= 115


def test_runs_agree_with_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(20):
        a = rng.integers(0, 1000, 200)
        b = np.concatenate([rng.integers(0, 1000, trial), a])
        b[rng.integers(0, len(b), trial)] = -1
        shift = -trial
        inside = set()
        for s in range(len(a) - 50):
            t = s - shift
            if t + 51 <= len(b):
                x = [tuple(a[s + k : s + k + 5]) == tuple(b[t + k : t + k + 5]) for k in range(47)]
                if sum(x) >= 0.8 * (94 - sum(x)):
                    inside.update(range(s, s + 51))
        assert {w for s, e in shared_runs(a, b, shift, 0.8) for w in range(s, e)} == inside


def test_lowest():
    x = np.random.default_rng(0).integers(0, 99, 200)
    for width in (1, 2, 5, 47):
        assert (_lowest(x, width) == [x[i : i + width].min() for i in range(len(x) - width + 1)]).all()


def test_odd_rows(lm_spark, words):
    p = " ".join(words(80, 3))
    rows = repeated_passages(frame(lm_spark, [(1, p), (1, p), (None, p)])).collect()
    assert rows == []
    assert repeated_passages(frame(lm_spark, [])).collect() == []


def test_inserted_and_deleted_words_agree_with_brute_force(lm_spark):
    rng = np.random.default_rng(4)

    def sets(w):
        return [{tuple(w[i + k : i + k + 5]) for k in range(47)} for i in range(len(w) - 50)]

    for trial in range(16):
        p = rng.integers(0, 40 if trial % 4 == 3 else 10_000, 60)
        edited = np.insert(p, 30, 77_777) if trial % 2 else np.delete(p, 28 + trial)
        a, b = (np.concatenate([rng.integers(20_000, 30_000, 70), x, rng.integers(20_000, 30_000, 70)]) for x in (p, edited))
        want = [(s, t) for s, x in enumerate(sets(a)) for t, y in enumerate(sets(b)) if 78 - 46 <= s <= 78 and 78 - 46 <= t <= 78 and len(x & y) >= 0.8 * len(x | y)]
        got = alike_runs(a.astype(np.uint64), b.astype(np.uint64), 78, 78, 0.8)
        assert want and got == (min(s for s, _ in want), max(s for s, _ in want) + 51, min(t for _, t in want), max(t for _, t in want) + 51)
    # a whole passage of 60 words with a word put in after the 30th
    base = [f"p{i}" for i in range(60)]
    edge = [[f"{c}{i}" for i in range(60)] for c in "uvwx"]
    found = []
    for n in range(12):
        own = [f"d{n}{w}" for w in base]
        texts = [(2 * n, edge[0] + own + edge[1]), (2 * n + 1, edge[2] + own[:30] + ["new"] + own[30:] + edge[3])]
        found += [(i, " ".join(f"{w}" if w.startswith("d") or w == "new" else f"{i}{w}" for w in t)) for i, t in texts]
    assert len({r["doc_id"] for r in repeated_passages(frame(lm_spark, found)).collect()}) > 12


def test_a_passage_twice_in_a_document(lm_spark, words):
    p = words(70, 21)
    texts = {1: words(60, 22) + p + words(60, 23), 2: words(60, 24) + p + words(80, 25) + p + words(60, 26), 3: p + words(90, 27) + p}
    texts = {i: " ".join(t) for i, t in texts.items()}
    rows = repeated_passages(frame(lm_spark, list(texts.items()))).collect()
    for i, removed in ((1, False), (2, True), (3, True)):
        own = covered(texts[i], [(r["start"], r["end"]) for r in rows if r["doc_id"] == i and r["removed"] == removed])
        split = texts[i].split()
        assert all(set(range(s, s + 70)) <= own for s in range(len(split) - 69) if split[s : s + 70] == p)


def test_edited_copies_are_all_found(lm_spark):
    """Short passages with one word changed share a key for certain, and copies unlike their key's first document are compared with each other."""
    own = [[f"d{n}w{i}" for i in range(51)] for n in range(40)]
    texts = []
    for n, p in enumerate(own):
        texts += [(2 * n, [f"a{n}x{i}" for i in range(60)] + p), (2 * n + 1, [*p[:25], "changed", *p[26:]] + [f"b{n}x{i}" for i in range(60)])]
    assert {r["doc_id"] for r in repeated_passages(frame(lm_spark, [(i, " ".join(t)) for i, t in texts])).collect()} == set(range(80))
    line = [f"line{i}" for i in range(30)]
    p = line + [f"p{i}" for i in range(30)]
    texts = [(0, [f"h{i}" for i in range(60)] + line + [f"g{i}" for i in range(60)])]
    texts += [(1, [f"i{i}" for i in range(60)] + p), (2, [f"j{i}" for i in range(60)] + [*p[:45], "changed", *p[46:]])]
    assert {r["doc_id"] for r in repeated_passages(frame(lm_spark, [(i, " ".join(t)) for i, t in texts])).collect()} == {1, 2}


@pytest.mark.parametrize("size", [12, 30])
def test_a_common_line_is_no_comparison_of_places(monkeypatch, size):
    """Two texts that have only a line in common, over and over, are told apart without looking at pairs of its places."""
    def never(*_):
        raise AssertionError("places are compared")

    monkeypatch.setattr(passages, "_Around", never)
    rng = np.random.default_rng(size)
    line = rng.integers(1, 2**62, size).astype(np.uint64)
    sides = [np.concatenate([np.concatenate([line, rng.integers(1, 2**62, 40).astype(np.uint64)]) for _ in range(50)]) for _ in range(2)]
    places = [n * (size + 40) for n in range(50)]
    assert verified_runs(*sides, [(1, places, places)], 0.8) == ([], [(1, places)])


def test_different_shingles_of_paragraphs():
    rng = np.random.default_rng(6)
    for words in (3, 60, 400):
        text, other = (Text(rng.integers(0, 4, words).astype(np.uint64)) for _ in range(2))
        x, y = text.shingles.tolist(), set(other.shingles.tolist())
        sets = [set(x[i : i + 47]) for i in range(len(x) - 46)]
        assert text.different.tolist() == [len(w) for w in sets]
        can = {p for i, w in enumerate(sets) for p in range(i, i + 51) if len(w & y) >= 0.8 * len(w)}
        assert set(np.flatnonzero(text.alike(other, 0.8)).tolist()) == can


def test_copies_of_a_text_and_an_edited_one(lm_spark, words):
    p = words(90, 41)
    texts = [(i, " " + " ".join(p) + ".") for i in (3, 5, 8, 9)] + [(4, " ".join([*p[:45], "changed", *p[46:]])), (6, "short text"), (7, "short text")]
    rows = repeated_passages(frame(lm_spark, texts)).collect()
    assert {(r["doc_id"], r["class_id"], r["removed"]) for r in rows} == {(3, 3, False), *((i, 3, True) for i in (4, 5, 8, 9))}
    assert all((r["start"], r["end"]) == (1, len(" ".join(p)) + 1) for r in rows if r["doc_id"] != 4)


def test_runs_reach_beyond_the_diagonal_of_equal_words():
    """Words behind an insertion belong to a paragraph that is alike, though the places in it lie in a run already."""
    rng = np.random.default_rng(9)
    a = rng.integers(1, 2**62, 160).astype(np.uint64)
    b = np.concatenate([a[:75], rng.integers(1, 2**62, 1).astype(np.uint64), a[75:100], rng.integers(1, 2**62, 60).astype(np.uint64)])
    places = list(range(0, 92))
    anchors = [(p, [p], [p if p < 75 else p + 1]) for p in places if p < 66 or p >= 75]
    runs, _ = verified_runs(a, b, anchors, 0.8)
    sets = [[set(t[i : i + 47].tolist()) for i in range(len(t) - 46)] for t in (Text(a).shingles, Text(b).shingles)]
    pairs = [(i, j) for i, x in enumerate(sets[0]) for j, y in enumerate(sets[1]) if len(x & y) >= 0.8 * len(x | y)]
    assert set().union(*(range(s, e) for s, e, _, _ in runs)) == {w for i, _ in pairs for w in range(i, i + 51)}
    assert set().union(*(range(u, v) for _, _, u, v in runs)) == {w for _, j in pairs for w in range(j, j + 51)}
