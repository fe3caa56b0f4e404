from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import rows as collected

from revcast.llm import spelling
from revcast.llm.common import stored
from tests.llm.conftest import frame


def lowered(word):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in word)


def words_of(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                n[word] += 1
    return {w: c for w, c in n.items() if c >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(docs):
    n = words_of(docs)
    near = defaultdict(list)
    for a in n:
        for b in n:
            if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
                near[a].append(b)
    form = {}
    for a in n:
        best = min(near[a], key=lambda b: (-n[b], b), default=None)
        if best is not None and n[best] >= 10 * n[a]:
            form[a] = best
    out = []
    for a in n:
        root = a
        while root in form:
            root = form[root]
        out.append((a, form.get(a), root, n[a], len(near[a]), n[form[a]] if a in form else None))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(["an", "er", "é", "th", "ou", "ss", "a", "b"]) for _ in range(rng.randint(4, 7))) for _ in range(30)]
    common = rng.choice(stems)

    def typo(word):
        k = rng.randrange(len(word))
        return rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("aebsÿ") + word[k:], word[:k] + rng.choice("aebsÀ") + word[k + 1 :]])

    def word():
        w = common if rng.random() < 0.3 else rng.choice(stems)
        while rng.random() < 0.25:
            w = typo(w)
        return w.upper() if rng.random() < 0.05 else w

    return [(i, rng.choice([" ", ", ", "-", "7"]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(120)]


ODD = [(1, None), (2, ""), (3, "kurz"), (None, "nonenull nonenull Nonenull"), (5, "aaaaaaaa aaaaaaaaa aaaaaaa " * 12), (5, "aaaaaaab " * 200), (6, "x" * 3000 + " " + "x" * 3001), (7, "x" * 3000 + " " + "x" * 2999 + "y"), (8, "ÀÉÎõüÿ×÷ ÀÉÎõüÿ×÷x " * 3), (9, "ābcdefgh abcdefǵh " * 3), (10, "abcdefgh" * 2 + " aaaaaaab")]


@pytest.mark.parametrize("group_rows", [20_000, 40])
def test_groups_agree_with_brute_force(lm_spark, group_rows):
    docs = corpus(group_rows) + ODD
    table = frame(lm_spark, docs).withColumnsRenamed({"lang": "word", "n_chars": "n"}).repartition(3)
    got = sorted(collected(spelling.variant_groups(table, group_rows)))
    assert got == brute(docs)
    assert sum(r[1] is not None for r in got) > 20 and sum(r[4] > 0 for r in got) > 60


def test_forms_are_followed_to_the_last(lm_spark):
    chain = {"abcdefgh": 2, "abcdefgi": 20, "abcdefji": 200, "abcdekji": 2000}
    forms = lm_spark.createDataFrame(list(zip(list(chain)[:-1], list(chain)[1:])), "word string, form string")
    assert dict(collected(spelling.roots(forms))) == dict.fromkeys(list(chain)[:-1], "abcdekji")


@pytest.mark.parametrize("first", [True, False])
def test_recurrences(first):
    """Every word one replacement or one omission away, and no other, is found by exactly one of the two halves."""
    rng = random.Random(1)
    indexed = sorted({"".join(rng.choice("ab") for _ in range(7)) for _ in range(90)})
    queries = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([7, 8]))) for _ in range(150)})
    here, other = (Counter(zip(*(x.tolist() for x in spelling.near_pairs(indexed, queries, 7, f)))) for f in (first, not first))
    assert max(here.values()) == 1 and not here.keys() & other.keys()
    assert here.keys() | other.keys() == {(a, b) for a, q in enumerate(queries) for b, w in enumerate(indexed) if one_edit(q, w)}
    assert all((queries[a][:3] == indexed[b][:3]) for a, b in (here if first else other))


def test_common_halves_are_dealt_in_tiles(lm_spark):
    words = lm_spark.createDataFrame([(f"abcdefg{chr(97 + i // 26)}{chr(97 + i % 26)}", 2) for i in range(600)], "word string, n long")
    rows = spelling.dealt(stored(spelling.halves(words), "t"), 50)
    sizes = [r["count"] for r in rows.groupBy("bucket").count().collect()]
    assert max(sizes) < 300
    got = {r["word"]: r["n_near"] for r in spelling.near_words(stored(words, "t"), 50).collect()}
    plain = {r["word"]: r["n_near"] for r in spelling.near_words(stored(words, "t")).collect()}
    assert got == plain and len(got) == 600


def test_bits():
    bits = np.zeros((3, 2), dtype=np.uint64)
    bits[1, 0], bits[2, 1] = 1 << 63 | 1, 4
    assert list(zip(*(x.tolist() for x in spelling.members(bits)))) == [(1, 0), (1, 63), (2, 66)]


def test_empty_table(lm_spark):
    assert collected(spelling.variant_groups(frame(lm_spark, []))) == []
