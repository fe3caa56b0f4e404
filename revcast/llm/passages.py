"""Passages that repeat across documents: paragraph MinHash banding, exact overlap, removals by components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revcast.llm.common import bucketed, components, stored, whole_text
from revcast.llm.minhash import shared_items
from revcast.llm.words import SHINGLE_WORDS, Words, mix, pieces

PARAGRAPH = 51
SHINGLES = PARAGRAPH - SHINGLE_WORDS + 1
THRESHOLD = 0.8
# alike paragraphs differ in five of 47 shingles at most, so of one word changed inside they keep 21 shingles in a row: 25 words
GRAM, STRETCH = 9, 25
# bands of two minima: paragraphs alike at 0.8 meet in one of them with probability 1 - (1 - 0.64) ** 12, over 0.99999
BANDS, ROWS = 12, 2
SEEDS = (np.uint64(0x51ED270B7A1E3C95), np.uint64(0xC2B2AE3D27D4EB4F))


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    out, have = x, 1
    while have < width:
        by = min(have, width - have)
        out = np.minimum(out[: len(out) - by], out[by:])
        have += by
    return out


def _shingled(words: np.ndarray) -> np.ndarray:
    out = np.zeros(max(0, len(words) - SHINGLE_WORDS + 1), dtype=np.uint64)
    for k in range(SHINGLE_WORDS):
        out += mix(words[k : k + len(out)].astype(np.uint64) + np.uint64(k + 1))
    return mix(out)


class Anchors:
    """Places of the least run of ``GRAM`` words in every run of ``STRETCH`` words of texts of a paragraph or more: ``anchor`` (its first word) and ``key``."""

    def __init__(self, words: Words):
        n = len(words.hash)
        self.anchor, self.key = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        if n < PARAGRAPH:
            return
        s = _shingled(words.hash)
        gram = mix((mix(s[: len(s) - GRAM + SHINGLE_WORDS] ^ SEEDS[0]) + s[GRAM - SHINGLE_WORDS :]) ^ SEEDS[1])
        low = _lowest(gram, STRETCH - GRAM + 1)
        whole = (words.doc[: len(low)] == words.doc[STRETCH - 1 :]) & (words.counts()[words.doc[: len(low)]] >= PARAGRAPH)
        # a place is an anchor if the greatest of the minima of its runs is its own value; equal values in one run all are
        low = np.pad(np.where(whole, low, np.uint64(0)), STRETCH - GRAM)
        self.anchor = np.flatnonzero((gram == ~_lowest(~low, STRETCH - GRAM + 1)) & (gram > 0))
        self.key = gram[self.anchor]


def _stretches(shingle: np.ndarray) -> np.ndarray:
    """Hash of every run of ``STRETCH`` words, from the shingles of the words."""
    out = np.zeros(max(0, len(shingle) - STRETCH + SHINGLE_WORDS), dtype=np.uint64)
    for k in range(0, STRETCH, SHINGLE_WORDS):
        out = mix(out * np.uint64(31) + shingle[k : k + len(out)])
    return out


def _by_key(name: str, ids: pa.Array, doc: np.ndarray, key: np.ndarray, pos: np.ndarray, bad: np.ndarray | None = None) -> pa.RecordBatch:
    """(``name``, doc_id, pos, and bad if given): each different key of a document once, with all its places and whether one of them is bad."""
    order = np.lexsort((pos, key, doc))
    key, doc, pos = key[order], doc[order], pos[order]
    group = np.ones(len(key), dtype=bool)
    group[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    new = group.copy()
    new[1:] |= pos[1:] != pos[:-1]
    at = np.flatnonzero(group)
    lists = pa.ListArray.from_arrays(pa.array(np.append(np.cumsum(new)[at] - 1, new.sum()), pa.int32()), pa.array(pos[new].astype(np.int32)))
    own = ids.to_numpy(zero_copy_only=False)[doc[at]].astype(np.int64)
    columns = {name: pa.array(key[at].view(np.int64)), "doc_id": pa.array(own), "pos": lists}
    if bad is not None:
        columns["bad"] = pa.array(np.logical_or.reduceat(bad[order], at) if len(at) else np.zeros(0, dtype=bool))
    return pa.record_batch(columns)


def _key_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, pos): each different key of a document once, with the words of all its anchors."""
    for batch in batches:
        for some in pieces(batch):
            words = Words(some.column("text"))
            found = Anchors(words)
            doc = words.doc[found.anchor]
            yield _by_key("key", some.column("doc_id"), doc, found.key, found.anchor - words.first[doc])


def _whole_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, end): what the words of texts of a paragraph or more cover."""
    for batch in batches:
        for some in pieces(batch):
            words = Words(some.column("text"))
            points = _points(words)
            doc = np.flatnonzero(words.counts() >= PARAGRAPH)
            start, end = points[words.start[words.first[doc]]], points[words.end[words.first[doc + 1] - 1]]
            zero = points[words.at[doc]]
            yield pa.record_batch([some.column("doc_id").take(pa.array(doc)), pa.array((start - zero).astype(np.int32)), pa.array((end - zero).astype(np.int32))], names=["doc_id", "start", "end"])


def _points(words: Words) -> np.ndarray:
    """Code points before each byte of the texts, counted from the beginning of all."""
    return np.concatenate(([0], np.cumsum((words.bytes & 0xC0) != 0x80)))


def shared_runs(a: np.ndarray, b: np.ndarray, shift: int, threshold: float) -> list[tuple[int, int]]:
    """Runs (start, end) of words of ``a`` made of paragraphs that overlap those of ``b`` ``shift`` words before to the threshold.

    Overlap is the Jaccard similarity of the five-word shingles at equal places.
    """
    low, high = max(0, shift), min(len(a), len(b) + shift)
    if high - low < PARAGRAPH:
        return []
    equal = a[low:high] == b[low - shift : high - shift]
    total = np.concatenate(([0], np.cumsum(equal)))
    shingle = (total[SHINGLE_WORDS:] - total[:-SHINGLE_WORDS]) == SHINGLE_WORDS
    total = np.concatenate(([0], np.cumsum(shingle)))
    same = total[SHINGLES:] - total[:-SHINGLES]
    good = same >= threshold * (2 * SHINGLES - same)
    mark = np.zeros(high - low + 1, dtype=np.int64)
    at = np.flatnonzero(good)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + PARAGRAPH, -1)
    inside = np.concatenate(([0], (np.cumsum(mark)[:-1] > 0).astype(np.int8), [0]))
    edge = np.flatnonzero(np.diff(inside))
    return [(int(s) + low, int(e) + low) for s, e in zip(edge[::2], edge[1::2], strict=True)]


def _inside(code: np.ndarray, size: int) -> np.ndarray:
    """0/1 matrix of which codes below ``size`` each paragraph's run of shingles has."""
    seen = np.zeros((len(code) + 1, size), dtype=np.int32)
    seen[np.arange(1, len(code) + 1), code] = 1
    total = np.cumsum(seen, axis=0)
    return (total[SHINGLES:] > total[:-SHINGLES]).astype(np.float32)


def alike_runs(a: np.ndarray, b: np.ndarray, p: int, q: int, threshold: float) -> tuple[int, int, int, int] | None:
    """(start, end) in ``a`` and in ``b`` of what the paragraphs around word ``p`` of ``a`` and ``q`` of ``b`` that are alike cover.

    Alike is the exact Jaccard similarity of the two sets of five-word shingles, wherever these are in the paragraphs.
    """
    low, to = max(0, p - SHINGLES + 1), max(0, q - SHINGLES + 1)
    x, y = _shingled(a[low : p + PARAGRAPH]), _shingled(b[to : q + PARAGRAPH])
    if len(x) < SHINGLES or len(y) < SHINGLES:
        return None
    ids, code = np.unique(np.concatenate([x, y]), return_inverse=True)
    left, right = _inside(code[: len(x)], len(ids)), _inside(code[len(x) :], len(ids))
    common = (left @ right.T).astype(np.float64)
    s, t = np.nonzero(common >= threshold * (left.sum(axis=1)[:, None].astype(np.float64) + right.sum(axis=1)[None, :] - common))
    if not len(s):
        return None
    return int(s.min()) + low, int(s.max()) + low + PARAGRAPH, int(t.min()) + to, int(t.max()) + to + PARAGRAPH


FOUND = "a long, a_start int, a_end int, b long, b_start int, b_end int, a_from int, a_to int, failed long, pos array<int>"


FEW_PAIRS, ROWS_AT_ONCE = 64, 512


class Text:
    """A text's ``words``, ``shingles`` and hashes of its runs of 25 words (``stretches``)."""

    def __init__(self, words: np.ndarray, shingles: np.ndarray | None = None, stretches: np.ndarray | None = None):
        self.words = words
        self.shingles = _shingled(words) if shingles is None else shingles
        self.stretches = _stretches(self.shingles) if stretches is None else stretches

    def around(self, places: np.ndarray) -> np.ndarray:
        """Hashes of the runs of 25 words that have the key at each place, one row a place; 0 for none."""
        at = places[:, None] - np.arange(STRETCH - GRAM + 1)[None, :]
        if not len(self.stretches):
            return np.zeros(at.shape, dtype=np.uint64)
        return np.where((at >= 0) & (at < len(self.stretches)), self.stretches[np.clip(at, 0, len(self.stretches) - 1)], np.uint64(0))

    @cached_property
    def halves(self) -> np.ndarray:
        """32 bits of each shingle."""
        return (self.shingles >> np.uint64(32)).astype("<u4")

    @cached_property
    def before(self) -> np.ndarray:
        """Place of the equal shingle before each shingle, or ``SHINGLES`` before it if there is none nearer."""
        order = np.argsort(self.shingles, kind="stable")
        out = np.arange(len(order)) - SHINGLES
        same = self.shingles[order[1:]] == self.shingles[order[:-1]]
        out[order[1:][same]] = np.maximum(out[order[1:][same]], order[:-1][same])
        return out

    def count(self, kept: np.ndarray) -> np.ndarray:
        """Number of different ones of the kept shingles in each paragraph: those whose equal before, if any, lies before the paragraph."""
        at, n = np.flatnonzero(kept), len(self.shingles)
        mark = np.bincount(np.maximum(self.before[at] + 1, 0), minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
        return np.cumsum(mark)[: max(0, n - SHINGLES + 1)]

    @cached_property
    def different(self) -> np.ndarray:
        """Number of different shingles of each paragraph."""
        return self.count(np.ones(len(self.shingles), dtype=bool))

    def alike(self, other: Text, threshold: float) -> np.ndarray:
        """Whether each word is in a paragraph of which the other text has so many shingles that it can be alike to one there."""
        good = self.count(np.isin(self.shingles, other.shingles)) >= threshold * self.different - 1e-9
        mark = np.zeros(len(self.words) + 1, dtype=np.int64)
        mark[: len(good)] += good
        mark[PARAGRAPH : PARAGRAPH + len(good)] -= good
        return np.cumsum(mark)[:-1] > 0


def _edges(places: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Which words are the first or the last place in a run of covered words: a paragraph that reaches out of the run has one of them if it has any place."""
    out = np.zeros(len(covered), dtype=bool)
    places = np.unique(places[covered[places]])
    island = np.cumsum(np.diff(covered.astype(np.int8), prepend=0) == 1)[places]
    new = island[1:] != island[:-1]
    out[places[np.append(True, new)[: len(places)]]] = out[places[np.append(new, True)[: len(places)]]] = True
    return out


def _shut(can: np.ndarray, covered: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Whether each word is covered inside a run, or the paragraphs with a shingle there have no word that can be alike and is not covered."""
    total = np.concatenate(([0], np.cumsum(can & ~covered[: len(can)])))
    at = np.arange(len(can))
    return (total[np.minimum(at + PARAGRAPH, len(can))] == total[np.maximum(at - SHINGLES + 1, 0)]) | (covered & ~edge)[: len(can)]


class _Around:
    """Places of a text by the words that paragraphs around them have: the ``places`` of each different content, ``sets`` of its 32-bit shingle hashes, ``runs`` of those of its runs of 25 words, ``least`` different shingles that a paragraph there has."""

    def __init__(self, text: Text, places: np.ndarray):
        found: dict[tuple[int, bytes], list[int]] = {}
        for p in places.tolist():
            low = max(0, p - SHINGLES + 1)
            found.setdefault((p - low, text.shingles[low : p + SHINGLES].tobytes()), []).append(p)
        self.places = [np.array(x) for x in found.values()]
        self.flat, self.begin = np.concatenate(self.places), np.cumsum([0, *(len(x) for x in self.places[:-1])])
        first = self.flat[self.begin]
        self.runs = [(x[x > 0] >> np.uint64(32)).astype("<u4").tobytes() for x in text.around(first)]
        self.sets = [text.halves[max(0, p - SHINGLES + 1) : p + SHINGLES].tobytes() for p in first.tolist()]
        self.least = np.array([text.different[max(0, p - SHINGLES + 1) : p + 1].min(initial=SHINGLES) for p in first.tolist()])

    def settled(self, shut: np.ndarray) -> np.ndarray:
        """Whether nothing is left around all places of each content."""
        return np.logical_and.reduceat(shut[self.flat], self.begin)


def verified_runs(a: Text | np.ndarray, b: Text | np.ndarray, anchors: list[tuple[int, list[int], list[int]]], threshold: float) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, list[int]]]]:
    """(runs of ``a`` and ``b`` that are alike, anchors with the places of ``a`` that are in none).

    Only places in 25 words that the other text has too, as alike paragraphs have, are looked at.  Places in no
    run and the first and last ones of a run are compared if a word around them is in no run and in a paragraph of which the other
    text has the wanted share of shingles.
    Diagonals that several anchors lie on come first, the fullest one before the others, and are passed over if all their places are
    in runs that are known already; anchors with many pairs of places make none.  What is left is compared as sets of
    shingles, places of one content once: products of 0/1 matrices tell which have 25 words in common and can be alike at all, so a
    line that both texts repeat costs no comparison of paragraphs for each pair of its places.
    """
    a, b = (x if isinstance(x, Text) else Text(x) for x in (a, b))
    out = []
    inside, within = np.zeros(len(a.words) + 1, dtype=bool), np.zeros(len(b.words) + 1, dtype=bool)

    def add(s, e, u, v):
        out.append((s, e, u, v))
        inside[s:e] = within[u:v] = True

    anchors = [(k, np.array(x, dtype=np.int64), np.array(y, dtype=np.int64)) for k, x, y in anchors]
    anchors = [(k, x[x < len(a.words)], y[y < len(b.words)]) for k, x, y in anchors]
    left, right = (np.concatenate([np.zeros(0, dtype=np.int64), *(x[side] for x in anchors)]) for side in (1, 2))
    runs, others = a.around(left), b.around(right)
    met = np.intersect1d(runs, others)
    met = met[met > 0]
    if len(met):
        keep, stay = np.isin(runs, met).any(axis=1), np.isin(others, met).any(axis=1)
        ends, stops = (np.cumsum([0, *(len(x[side]) for x in anchors)]) for side in (1, 2))
        near = [(k, x[keep[ends[i] : ends[i + 1]]], y[stay[stops[i] : stops[i + 1]]]) for i, (k, x, y) in enumerate(anchors)]
        near = [(x, y) for _, x, y in near if len(x) and len(y)]
        _find(a, b, near, threshold, inside, within, add)
    return out, [(k, rest.tolist()) for k, x, _ in anchors if len(rest := x[~inside[x]])]


def _find(a: Text, b: Text, anchors: list[tuple[np.ndarray, np.ndarray]], threshold: float, inside: np.ndarray, within: np.ndarray, add) -> None:
    """Call ``add`` with the runs that are alike around pairs of places."""
    few = [(x, y) for x, y in anchors if len(x) * len(y) <= FEW_PAIRS]
    if few:
        both = np.array([(p, q) for x, y in few for p in x.tolist() for q in y.tolist()], dtype=np.int64)
        shift, at, full = np.unique(both[:, 0] - both[:, 1], return_inverse=True, return_counts=True)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(full)
        for d in np.argsort(-full, kind="stable"):
            if full[d] < 2:
                break
            on = both[order[ends[d] - full[d] : ends[d]]]
            if not (inside[on[:, 0]] & within[on[:, 1]]).all():
                for s, e in shared_runs(a.words, b.words, int(shift[d]), threshold):
                    add(s, e, s - int(shift[d]), e - int(shift[d]))
    if not anchors or (inside[:-1].all() and within[:-1].all()):
        return
    can_a, can_b = a.alike(b, threshold), b.alike(a, threshold)
    edge_a, edge_b = (_edges(np.concatenate([x[side] for x in anchors]), c) for side, c in ((0, inside), (1, within)))
    shut_a, shut_b = _shut(can_a, inside, edge_a), _shut(can_b, within, edge_b)
    for x, y in anchors:
        if shut_a[x].all() and shut_b[y].all():
            continue
        left, right = _Around(a, x), _Around(b, y)
        for low in range(0, len(left.sets), ROWS_AT_ONCE):
            for to in range(0, len(right.sets), ROWS_AT_ONCE):
                one, other = slice(low, low + ROWS_AT_ONCE), slice(to, to + ROWS_AT_ONCE)
                wanted = np.ceil(threshold / (1 + threshold) * (left.least[one, None] + right.least[None, other]) - 1e-9)
                can = (shared_items(left.sets[one], right.sets[other]) >= wanted) & (shared_items(left.runs[one], right.runs[other]) > 0)
                done, over = left.settled(shut_a)[one], right.settled(shut_b)[other]
                for i, j in np.argwhere(can & ~(done[:, None] & over[None, :])):
                    if done[i] and over[j]:
                        continue
                    ps, qs = left.places[low + i], right.places[to + j]
                    p, q = int(ps[0]), int(qs[0])
                    if near := alike_runs(a.words, b.words, p, q, threshold):
                        s, e, u, v = near[0] - p, near[1] - p, near[2] - q, near[3] - q
                        for p2, q2 in [*((int(k), q) for k in ps), *((p, int(k)) for k in qs)]:
                            if not (shut_a[p2] and shut_b[q2]):
                                add(p2 + s, p2 + e, q2 + u, q2 + v)
                                for low_end, high_end in shared_runs(a.words, b.words, p2 - q2, threshold):
                                    add(low_end, high_end, low_end - p2 + q2, high_end - p2 + q2)
                                shut_a, shut_b = _shut(can_a, inside, edge_a), _shut(can_b, within, edge_b)
                        done, over = left.settled(shut_a)[one], right.settled(shut_b)[other]


def _row_text(words: Words, shingles: np.ndarray, stretches: np.ndarray, row: int) -> Text:
    low, high = int(words.first[row]), int(words.first[row + 1])
    return Text(words.hash[low:high], shingles[low : max(low, high - SHINGLE_WORDS + 1)], stretches[low : max(low, high - STRETCH + 1)])


def _verify_step(threshold: float):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "text_b"):
                left, right = Words(some.column("text")), Words(some.column("text_b"))
                lp, rp = _points(left), _points(right)
                sides = [(x, y := _shingled(x.hash), _stretches(y)) for x in (left, right)]
                out = []
                for row, (a, b, anchors) in enumerate(zip(some.column("a").to_pylist(), some.column("b").to_pylist(), some.column("anchors").to_pylist(), strict=True)):
                    la, lb = int(left.first[row]), int(right.first[row])
                    one, other = (_row_text(*side, row) for side in sides)
                    zero, nil = lp[left.at[row]], rp[right.at[row]]
                    runs, rest = verified_runs(one, other, [(x["key"], x["pos"], x["head_pos"]) for x in anchors], threshold)
                    more = {x["key"] for x in anchors if x["more"]}
                    for s, e, u, v in runs:
                        out.append((a, lp[left.start[la + s]] - zero, lp[left.end[la + e - 1]] - zero, b, rp[right.start[lb + u]] - nil, rp[right.end[lb + v - 1]] - nil, s, e, None, None))
                    out += [(a, None, None, b, None, None, None, None, key, places) for key, places in rest if key in more]
                yield _found_batch(out)

    return step


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    number, narrow = pa.int64(), pa.int32()
    kinds = [number, narrow, narrow, number, narrow, narrow, narrow, narrow, number, pa.list_(narrow)]
    names = [c.split()[0] for c in FOUND.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    plain = [[v if v is None or isinstance(v, list) else int(v) for v in c] for c in columns]
    return pa.record_batch([pa.array(c, k) for c, k in zip(plain, kinds, strict=True)], names=names)


def _places(batch: pa.RecordBatch, words: Words, column: str) -> tuple[np.ndarray, ...]:
    """Text, word counted from the beginning of all texts, and flag of each place in a column of arrays of (pos, bad)."""
    lists = batch.column(column)
    flat = lists.flatten()
    doc = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    pos, bad = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    ok = pos < words.counts()[doc]
    doc, pos, bad = doc[ok], pos[ok], bad[ok]
    return doc, words.first[doc] + pos, bad


def _stretch_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stretch, doc_id, pos, bad): hashes of the runs of 25 words that have a given place, each once a document."""
    for batch in batches:
        for some in pieces(batch):
            words = Words(some.column("text"))
            stretch = _stretches(_shingled(words.hash))
            doc, place, bad = _places(some, words, "anchors")
            at = place[:, None] - np.arange(STRETCH - GRAM + 1)[None, :]
            row, col = np.nonzero((at >= words.first[doc][:, None]) & (at + STRETCH <= words.first[doc + 1][:, None]))
            yield _by_key("stretch", some.column("doc_id"), doc[row], stretch[at[row, col]], (place - words.first[doc])[row], bad[row])


def _band(shingles: np.ndarray, band: int) -> np.ndarray:
    """MinHash key of each run of ``SHINGLES`` shingles in one band: its ``ROWS`` least hashes."""
    key = np.full(max(0, len(shingles) - SHINGLES + 1), band + 1, dtype=np.uint64)
    for row in range(ROWS):
        key = mix(key * np.uint64(31) + _lowest(mix(shingles ^ mix(SEEDS[1] + np.uint64([band * ROWS + row]))), SHINGLES)[: len(key)])
    return key


def band_keys(words: np.ndarray) -> np.ndarray:
    """Different MinHash band keys of all paragraphs of the given words: ``ROWS`` least shingle hashes each, in ``BANDS`` bands."""
    x = _shingled(words)
    if len(x) < SHINGLES:
        return np.zeros(0, dtype=np.uint64)
    return np.concatenate([np.unique(_band(x, band)) for band in range(BANDS)])


def _band_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, doc_id, pos, bad): band keys of the paragraphs that have a given place, each once a document, with the places."""
    for batch in batches:
        for some in pieces(batch):
            words = Words(some.column("text"))
            x = _shingled(words.hash)
            doc, place, bad = _places(some, words, "places")
            low, high = np.maximum(words.first[doc], place - SHINGLES + 1), np.minimum(place, words.first[doc + 1] - PARAGRAPH)
            doc, place, bad, low, high = (v[low <= high] for v in (doc, place, bad, low, high))
            if not len(doc):
                continue
            for band in range(BANDS):
                key = _band(x, band)
                # runs of paragraphs that follow each other with the same key; a place has those from its first to its last paragraph
                run = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
                own = key[np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))]
                many = run[high] - run[low] + 1
                of = np.repeat(np.arange(len(doc)), many)
                which = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + run[low][of]
                yield _by_key("band", some.column("doc_id"), doc[of], own[which], (place - words.first[doc])[of], bad[of])


def _among(failed: DataFrame, spans: DataFrame, shared: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b, anchors) of documents with places that are unlike the head of their key, for comparison.

    Places in a run that was found with another head are settled.  The others, and what shares their key but the head, which all
    were compared with, are kept if they have 25 words around them in common with another document, as alike paragraphs do.  The
    paragraphs around these get MinHash bands; each place is compared with those of the first document of its bands.  Paragraphs that have
    only a common line in common meet in bands whose minima all lie in it, alike ones in others too, so no pairs of a group are made.
    """
    known = spans.groupBy(F.col("a").alias("i")).agg(F.collect_set(F.struct("a_from", "a_to")).alias("runs"))
    open_places = failed.select("a", F.col("failed").alias("f"), F.explode("pos").alias("p")).distinct().join(known, F.col("a") == F.col("i"), "left")
    settled = F.exists(F.coalesce("runs", F.array().cast("array<struct<a_from:int,a_to:int>>")), lambda r: (r["a_from"] <= F.col("p")) & (F.col("p") < r["a_to"]))
    bad = stored(open_places.where(~settled).select("a", "f", "p"), "unlike")
    keys = bad.select(F.col("f").alias("k")).distinct()
    rows = shared.where("doc_id <> head").join(keys, F.col("key") == F.col("k")).select("doc_id", "key", F.explode("pos").alias("pos"))
    rows = rows.join(bad.withColumn("bad", F.lit(True)), (F.col("doc_id") == F.col("a")) & (F.col("key") == F.col("f")) & (F.col("pos") == F.col("p")), "left")
    rows = rows.groupBy(F.col("doc_id").alias("d"), "pos").agg(F.max(F.coalesce("bad", F.lit(False))).alias("bad"))
    rows = rows.groupBy("d").agg(F.collect_list(F.struct("pos", "bad")).alias("anchors"))
    runs = stored(texts.join(rows, F.col("doc_id") == F.col("d")).select("doc_id", "text", "anchors").mapInArrow(_stretch_step, "stretch long, doc_id long, pos array<int>, bad boolean"), "stretches")
    groups = runs.groupBy("stretch").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("bad").alias("any_bad")).where("low < high and any_bad").select(F.col("stretch").alias("s"))
    some = runs.join(groups, F.col("stretch") == F.col("s"), "left_semi").select("doc_id", F.explode("pos").alias("pos")).distinct()
    flags = bad.select(F.col("a").alias("i"), "p").distinct().withColumn("bad", F.lit(True))
    some = some.join(flags, (F.col("doc_id") == F.col("i")) & (F.col("pos") == F.col("p")), "left").select(F.col("doc_id").alias("d"), F.struct("pos", F.coalesce("bad", F.lit(False)).alias("bad")).alias("place"))
    places = some.groupBy("d").agg(F.collect_list("place").alias("places"))
    banded = stored(texts.join(places, F.col("doc_id") == F.col("d")).select("doc_id", "text", "places").mapInArrow(_band_step, "band long, doc_id long, pos array<int>, bad boolean"), "bands")
    heads = banded.groupBy(F.col("band").alias("k")).agg(F.min(F.struct("doc_id", "pos", "bad")).alias("head"), F.max("doc_id").alias("last"), F.max("bad").alias("any_bad")).where("head.doc_id < last and any_bad").select("k", "head")
    pairs = banded.join(heads, F.col("band") == F.col("k")).where((F.col("doc_id") > F.col("head.doc_id")) & (F.col("bad") | F.col("head.bad")))
    pairs = pairs.groupBy(F.col("doc_id").alias("a"), F.col("head.doc_id").alias("b")).agg(F.collect_set("pos").alias("pos"), F.collect_set("head.pos").alias("head_pos"))
    one = F.struct(F.lit(0).cast("long").alias("key"), F.array_distinct(F.flatten("pos")).alias("pos"), F.array_distinct(F.flatten("head_pos")).alias("head_pos"), F.lit(False).alias("more"))
    return pairs.select("a", "b", F.array(one).alias("anchors"))


def _different(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of the first document of each text, and (doc_id, first) of the others; the least text counts of an id that has several."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    rows = rows.withColumn("name", F.sha2("text", 256))
    names = rows.groupBy("doc_id").agg(F.min("name").alias("name"), F.max("name").alias("other"))
    several = stored(names.where("name <> other").select(F.col("doc_id").alias("i")), "several")
    names = names.where("name = other").drop("other")
    if not several.isEmpty():
        least = rows.join(several, F.col("doc_id") == F.col("i")).groupBy("doc_id").agg(F.min("text").alias("text"))
        names = names.unionByName(least.select("doc_id", F.sha2("text", 256).alias("name")))
    names = stored(names, "names")
    first = names.groupBy(F.col("name").alias("n")).agg(F.min("doc_id").alias("first"))
    copies = names.join(first, F.col("name") == F.col("n")).where("doc_id > first").select("doc_id", "first")
    texts = rows.join(first, (F.col("doc_id") == F.col("first")) & (F.col("name") == F.col("n")))
    return bucketed(texts.groupBy("doc_id", "name").agg(F.first("text").alias("text")).select("doc_id", "text"), "texts", "doc_id"), copies


def _islands(spans: DataFrame) -> DataFrame:
    """(doc_id, start, end): unions of overlapping spans of a document.

    Spans of one start are combined first, so a document has no more rows than words.
    """
    tops = spans.groupBy("doc_id", "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    marked = tops.withColumn("first", (F.coalesce(F.max("end").over(before), F.lit(-1)) < F.col("start")).cast("int")).withColumn("island", F.sum("first").over(upto))
    return marked.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def repeated_passages(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, class_id, removed: passages of 51 or more words that occur in several documents.

    Offsets are code points, end exclusive.  A removed passage has a copy in a document of a smaller id;
    of each class the passages that have none stay.  ``class_id`` is the smallest document of the passages
    that are linked to each other.

    A paragraph is any run of 51 words (a text has one beginning at each word), so passages are found wherever
    they are set in a text.  Paragraphs alike at 0.8 have 25 words in a row in common (one word inside is changed, put in
    or left out at most); the least run of nine words by a hash in each run of 25 is a key, so they share a key for certain.
    Runs of a document that share a key are one row with all their places.  Each row is compared with the first document
    of its key: paragraphs around the common words count if their exact shingle overlap reaches the threshold, word for
    word first and, where that fails, as sets of shingles, so inserted and deleted words do no harm.  Places that are unlike
    there and in no run found otherwise, such as those of a line that three or more texts have, get MinHash bands of the paragraphs
    around them (12 bands of two minima) and are compared with the first document of each band.

    Documents of equal text are compared as one, the smallest id of them, whose other copies are removed as one passage each.

    Null and empty texts and texts below 51 words have no passages; null ids are left out; a passage that
    repeats inside one document only is not reported; rows that repeat an id count as one document of which
    the smallest text is read.  An empty table gives no rows.
    """
    texts, copies = _different(docs, id_col, text_col)
    keys = bucketed(texts.mapInArrow(_key_step, "key long, doc_id long, pos array<int>"), "keys", "key")
    heads = keys.groupBy(F.col("key").alias("k")).agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "head", (F.col("n") > 2).alias("more"))
    shared = stored(keys.join(heads, F.col("key") == F.col("k")).drop("k"), "shared")
    own = shared.where("doc_id = head").select(F.col("key").alias("k"), F.col("pos").alias("head_pos"))
    pairs = shared.where("doc_id <> head").join(own, F.col("key") == F.col("k"))
    pairs = pairs.groupBy(F.col("doc_id").alias("a"), F.col("head").alias("b")).agg(F.collect_list(F.struct("key", "pos", "head_pos", "more")).alias("anchors"))

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.join(texts, F.col("a") == F.col("doc_id")).drop("doc_id")
        both = left.join(texts.select(F.col("doc_id").alias("i"), F.col("text").alias("text_b")), F.col("b") == F.col("i")).select("a", "b", "anchors", "text", "text_b")
        return stored(both.mapInArrow(_verify_step(threshold), FOUND), "found")

    found = verified(pairs)
    spans = found.where("failed is null").drop("failed", "pos")
    failed = found.where("failed is not null")
    if not failed.isEmpty():
        spans = spans.unionByName(verified(_among(failed, spans, shared, texts)).where("failed is null").drop("failed", "pos"))
    spans = spans.drop("a_from", "a_to")
    firsts = copies.select(F.col("first").alias("i")).distinct()
    whole = texts.join(firsts, F.col("doc_id") == F.col("i"), "left_semi").mapInArrow(_whole_step, "doc_id long, start int, end int")
    ends = [F.col(c).alias(f"{side}_{c}") for side in "ab" for c in ("start", "end")]
    spans = spans.unionByName(copies.withColumnRenamed("doc_id", "a").join(whole, F.col("first") == F.col("doc_id")).select("a", F.col("first").alias("b"), *ends))
    spans = stored(spans, "spans")
    later = spans.select(F.col("a").alias("doc_id"), F.col("a_start").alias("start"), F.col("a_end").alias("end"))
    earlier = spans.select(F.col("b").alias("doc_id"), F.col("b_start").alias("start"), F.col("b_end").alias("end"))
    gone = stored(_islands(later), "gone")
    nodes = stored(_islands(later.unionByName(earlier)).withColumn("node", F.monotonically_increasing_id()), "islands")
    inner = nodes.select(F.col("doc_id").alias("d"), F.col("start").alias("low"), F.col("end").alias("high"), "node")

    def placed(df: DataFrame, doc: str, start: str, name: str) -> DataFrame:
        return df.join(inner.withColumnRenamed("node", name), (F.col(doc) == F.col("d")) & (F.col(start) >= F.col("low")) & (F.col(start) < F.col("high"))).drop("d", "low", "high")

    ends = spans.select("a", "a_start", "b", "b_start").distinct()
    edges = placed(placed(ends, "a", "a_start", "x").select("x", "b", "b_start").distinct(), "b", "b_start", "y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    labels = components(edges)
    labelled = stored(nodes.join(labels.withColumnRenamed("node", "n"), F.col("node") == F.col("n")).select("doc_id", "start", "end", "node", "label"), "labelled")
    first = labelled.groupBy(F.col("label").alias("l")).agg(F.min("doc_id").alias("class_id"))
    classed = labelled.join(first, F.col("label") == F.col("l")).select("doc_id", "start", "end", "node", "class_id")
    removed = placed(gone, "doc_id", "start", "at")
    out = removed.join(classed.select(F.col("node").alias("n"), "class_id"), F.col("at") == F.col("n")).select("doc_id", "start", "end", "class_id", F.lit(True).alias("removed"), "at")
    kept = classed.join(removed.select("at").distinct(), F.col("node") == F.col("at"), "left_anti").select("doc_id", "start", "end", "class_id", F.lit(False).alias("removed"))
    return out.drop("at").unionByName(kept).withColumnRenamed("doc_id", id_col)
