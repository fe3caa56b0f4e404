"""Packing of token pieces into sequences: length patterns fitted by non-negative least squares."""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.llm.common import numbered, stored, whole_text
from revcast.llm.tokens import piece_step

SEQUENCE = 2048


def patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, anchors: int = 96) -> np.ndarray:
    """Length patterns of two and three documents that fill ``capacity`` exactly, as rows of lengths (0: none).

    Pairs are enumerated in full.  Triples have one member among the ``anchors`` commonest lengths,
    which bounds their number by anchors x capacity whatever the input.
    """
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    a = np.arange(1, capacity // 2 + 1)
    a = a[have[a] & have[capacity - a]]
    found = [np.stack([capacity - a, a, np.zeros_like(a)], axis=1)]
    for third in lengths[np.argsort(-counts, kind="stable")][:anchors]:
        rest = capacity - int(third)
        a = np.arange(1, rest // 2 + 1)
        a = a[have[a] & have[rest - a]]
        found.append(np.sort(np.stack([rest - a, a, np.full_like(a, third)], axis=1), axis=1)[:, ::-1])
    return np.unique(np.concatenate(found), axis=0)


def fit(rows: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative repeat counts x of the patterns with least squares of (A x - histogram).

    Accelerated projected gradient; A is kept as its three index columns, so a step is a gather and a
    bincount.
    """
    size = len(histogram)
    scale = max(1.0, float(histogram.max(initial=0)))
    target = histogram / scale
    target[0] = 0.0

    def apply(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(rows[:, j], weights=x, minlength=size) for j in range(3))
        out[0] = 0.0
        return out

    probe = np.ones(len(rows))
    for _ in range(20):
        g = apply(probe)
        g[0] = 0.0
        probe = g[rows].sum(axis=1)
        norm = np.linalg.norm(probe)
        probe /= max(norm, 1e-12)
    rate = 1.0 / max(norm * 1.05, 1e-9)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        r = apply(y) - target
        nxt = np.maximum(0.0, y - rate * r[rows].sum(axis=1))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t_next * (nxt - x)
        x, t = nxt, t_next
    return x * scale


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Recipes (repeats, ((length, how many), ...)) that use up the histogram of piece lengths.

    Full pieces stand alone.  Repeat counts are rounded down and cut to what is there, the commonest
    patterns first; what is left is packed best fit decreasing, many equal sequences at a time.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    if left[capacity]:
        out.append((int(left[capacity]), ((capacity, 1),)))
        left[capacity] = 0
    lengths = np.flatnonzero(left)
    if len(lengths):
        rows = patterns(lengths, left[lengths], capacity)
        if len(rows):
            x = np.floor(fit(rows, left.astype(float)) + 1e-6).astype(np.int64)
            for i in np.argsort(-x, kind="stable"):
                if x[i] <= 0:
                    break
                parts = {}
                for v in rows[i].tolist():
                    if v:
                        parts[v] = parts.get(v, 0) + 1
                n = min([int(x[i])] + [int(left[v]) // m for v, m in parts.items()])
                if n > 0:
                    for v, m in parts.items():
                        left[v] -= n * m
                    out.append((n, tuple(parts.items())))
    return out + residual(left, capacity)


def residual(left: np.ndarray, capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best fit decreasing over a histogram.  Open sequences of equal content are one entry with a count."""
    by_room: dict[int, list[tuple[int, dict[int, int]]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, parts: dict[int, int]) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append((n, parts))

    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                per = min(capacity // length, todo)
                n = todo // per
                put(capacity - per * length, n, {length: per})
                todo -= n * per
                continue
            room = rooms[i]
            n, parts = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(i)
            per = min(room // length, todo)
            used = min(n, todo // per)
            if used < n:
                put(room, n - used, parts)
            put(room - per * length, used, parts | {length: parts.get(length, 0) + per})
            todo -= used * per
    return [(n, tuple(parts.items())) for entries in by_room.values() for n, parts in entries]


def placements(recipes) -> list[tuple[int, int, int, int, int, int, int]]:
    """Runs (length, low, high, per, first_sequence, offset, step).

    The n-th piece of ``length`` with low <= n < high is place (n - low) mod per of sequence
    first_sequence + (n - low) div per, at offset + place * length.
    """
    out, used, sequence = [], {}, 0
    for repeats, parts in recipes:
        offset = 0
        for length, per in parts:
            low = used.get(length, 0)
            out.append((length, low, low + repeats * per, per, sequence, offset))
            used[length] = low + repeats * per
            offset += per * length
        sequence += repeats
    return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): the documents' ids and the end id, cut where longer than ``capacity``.

    ``ids`` are little-endian unsigned 32-bit.  Null text is empty, hence one piece of the end id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(piece_step(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces with ``length`` <= ``capacity``.

    The driver sees a histogram of lengths, at most ``capacity`` numbers, and plans on it.  Equal
    lengths are interchangeable, so a piece's number among those of its length picks its place; a
    length that a third of the pieces have is numbered in parts.  Rows that repeat and null ids
    are packed like others; no pieces, no rows.
    """
    spark = pieces.sparkSession
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        histogram[length] = n
    runs = placements(plan(histogram, capacity))
    table = spark.createDataFrame(runs, "of long, low long, high long, per long, first long, at long")
    nth = numbered(pieces, ["length"], ["row"], "nth")
    if len(runs) <= 200_000:
        table = F.broadcast(table)
    found = nth.join(table, (F.col("length") == F.col("of")) & (F.col("nth") >= F.col("low")) & (F.col("nth") < F.col("high")))
    place = F.col("nth") - F.col("low")
    return found.select(
        *pieces.columns,
        (F.col("first") + F.floor(place / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(place, F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset: documents in as few sequences as planned.

    The token ids are written once to the shared folder; only narrow rows are numbered and placed, and the ids meet their
    places by row number in one join at the end (none without ``with_ids``).  A text longer than ``capacity`` is cut into
    pieces, so no row is longer; rows that repeat are packed each.
    """
    pieces = token_pieces(docs, tokenizer, capacity, 0, id_col, text_col).withColumns({"ids_crc32": F.crc32("ids"), "row": F.monotonically_increasing_id()})
    pieces = stored(pieces, "pieces")
    placed = pack(pieces.drop("ids"), capacity)
    if with_ids:
        placed = placed.join(pieces.select(F.col("row").alias("of"), "ids"), F.col("row") == F.col("of")).drop("of")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]
    return placed.select(*names)
