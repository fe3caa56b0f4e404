"""Shards of near equal bytes whose groups stay together, by best-fit-decreasing bin packing."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.llm.common import numbered, stored, whole_text

LAW = "bytes"
MANTISSA_BITS = 12


class _Node:
    __slots__ = ("key", "weight", "left", "right")

    def __init__(self, key, weight):
        self.key, self.weight, self.left, self.right = key, weight, None, None


class Capacities:
    """Balanced search tree (a treap with seeded weights) of (remaining capacity, bin)."""

    def __init__(self):
        self.root, self.rng = None, random.Random(7)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node.key < key:
            node.right, rest = self._split(node.right, key)
            return node, rest
        rest, node.left = self._split(node.left, key)
        return rest, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a.weight > b.weight:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def add(self, remaining, number):
        low, high = self._split(self.root, (remaining, number))
        self.root = self._merge(self._merge(low, _Node((remaining, number), self.rng.random())), high)

    def take_tightest(self, need):
        """Remove and return the bin with the least remaining capacity of at least ``need``, or None."""
        low, high = self._split(self.root, (need, -1))
        node = high
        while node is not None and node.left is not None:
            node = node.left
        if node is None:
            self.root = low
            return None
        _, high = self._split(high, (node.key[0], node.key[1] + 1))
        self.root = self._merge(low, high)
        return node.key


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, most_bins: int | None = None):
    """Runs (size, count, bin) of groups in bins of ``capacity``, or None if ``most_bins`` do not do.

    ``classes`` are (size, number of groups), in any order.  The tightest bin that takes one group of
    a size stays the tightest while it takes more of them, so equal groups are placed at once.
    """
    tree, runs, bins = Capacities(), [], 0
    for size, left in sorted(classes, reverse=True):
        while left:
            found = tree.take_tightest(size)
            if found is None:
                if bins == most_bins or size > capacity:
                    return None
                found, bins = (capacity, bins), bins + 1
            put = min(left, found[0] // size)
            runs.append((size, put, found[1]))
            tree.add(found[0] - put * size, found[1])
            left -= put
    return runs


def fill(classes: list[tuple[int, int]], shards: int):
    """Runs for exactly ``shards`` bins of the least capacity: near equal loads.

    A group that outweighs an even share of what is left gets a shard of its own.
    """
    left, runs, first = {s: n for s, n in classes}, [], 0
    while left and first < shards:
        total, top = sum(s * n for s, n in left.items()), max(left)
        if top * (shards - first) <= total or shards - first == 1:
            break
        runs.append((top, 1, first))
        first, left[top] = first + 1, left[top] - 1
        if not left[top]:
            del left[top]
    if not left:
        return runs
    rest, bins = list(left.items()), shards - first
    total, top = sum(s * n for s, n in rest), max(left)
    low, high = max(top, -(-total // bins)), max(top, -(-total // bins)) + top
    while (found := best_fit_decreasing(rest, high, bins)) is None:
        high += top
    while low < high:
        middle = (low + high) // 2
        got = best_fit_decreasing(rest, middle, bins)
        low, high, found = (low, middle, got) if got is not None else (middle + 1, high, found)
    return runs + [(s, n, b + first) for s, n, b in found]


def shards(docs: DataFrame, count: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents into ``count`` shards: id, size, text_crc32, shard, slot.

    Size is the UTF-8 bytes plus 1 (null text: 1).  Equal texts (by a 128-bit hash) are one group and
    go to one shard.  The driver sees a histogram of group sizes only: exact below 2^12 bytes,
    else rounded up to 12 leading bits, hence at most about 2^11 classes per doubling of the size
    whatever the row count, with loads off by less than 1/2048.  It packs classes by best fit
    decreasing; a group's number within its class picks its run.  A hot group is one row when it is
    placed; its documents meet their shard in an equi-join, and slots are numbered in parts.

    Null ids are documents like others; rows that repeat get slots of their own; an empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    body = whole_text(text_col)
    rows = stored(
        docs.select(F.col(id_col).alias("id"), F.octet_length(body).cast("long").alias("bytes"), F.crc32(body).alias("text_crc32"), F.md5(body).alias("hash"), F.monotonically_increasing_id().alias("row"))
        .withColumn("size", F.col("bytes") + 1).drop("bytes"),
        "sizes",
    )
    bits = F.greatest(F.lit(0), F.floor(F.log2("weight")).cast("int") + 1 - MANTISSA_BITS)
    step = F.pow(F.lit(2.0), bits).cast("long")
    groups = stored(rows.groupBy("hash").agg(F.sum("size").alias("weight")).withColumn("class", F.ceil(F.col("weight") / step) * step), "groups")
    classes = [(r[0], r[1]) for r in groups.groupBy("class").count().collect()]
    runs, start = [], {}
    for size, n, shard in fill(classes, count):
        at = start.get(size, 0)
        runs.append((size, at, at + n, shard))
        start[size] = at + n
    runs_df = F.broadcast(spark.createDataFrame(runs, "c long, low long, high long, shard int"))
    placed = numbered(groups, ["class"], ["hash"], "nth").join(runs_df, (F.col("class") == F.col("c")) & (F.col("nth") >= F.col("low")) & (F.col("nth") < F.col("high")))
    dealt = stored(rows.join(placed.select(F.col("hash").alias("h"), "shard"), F.col("hash") == F.col("h")).select("id", "size", "text_crc32", "shard", "row"), "dealt")
    return numbered(dealt, ["shard"], ["row"], "slot").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
