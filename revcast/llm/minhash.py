"""Near duplicates by BagMinHash signatures of shingle multisets, banding and exact multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.llm.common import components, stored, whole_text
from revcast.llm.words import Words, mix, pieces, shingles

BANDS, ROWS = 20, 4
BLOCK = 256
THRESHOLD = 0.8
LOW48 = np.uint64((1 << 48) - 1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def bags(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of each text's multiset of five-word shingles, sorted by text and shingle (48 bits of the hash)."""
    h, doc = shingles(words)
    keys = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (h & LOW48))
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(first, len(keys)))
    own = keys[first]
    return (own >> np.uint64(48)).astype(np.int64), own & LOW48, counts


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / float(1 << 53)


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, docs: int, size: int = BANDS * ROWS) -> np.ndarray:
    """(docs, size) BagMinHash signatures; equal components estimate the weighted Jaccard similarity without bias.

    Weights are discretised at the integers.  Each shingle has Poisson processes on time x weight: one over
    the weights [0, 1) and one over each [2^j, 2^(j+1)) with the rate of its length, as many as its count
    reaches into.  A point belongs to one component and one unit of weight; it counts if that unit
    lies below the count.  A component keeps its earliest point.  Points are made up to a time by which all
    components are most likely met, and texts with an open one go on to twice that time; later points
    cannot be earliest, so the result does not depend on the bound.
    """
    out = np.full(docs * size, np.iinfo(np.uint64).max, dtype=np.uint64)
    if not len(doc):
        return out.reshape(docs, size)
    blocks = [(doc, shingle, count, 0)]
    level = 1
    while (count > (1 << (level - 1))).any():
        more = count > (1 << (level - 1))
        blocks.append((doc[more], shingle[more], count[more], level))
        level += 1
    d = np.concatenate([b[0] for b in blocks])
    s = np.concatenate([mix(b[1] * np.uint64(2 * 64 + 1) + np.uint64(b[3])) for b in blocks])
    c = np.concatenate([b[2] for b in blocks])
    base = np.concatenate([np.full(len(b[0]), 0 if b[3] == 0 else 1 << (b[3] - 1), dtype=np.int64) for b in blocks])
    span = np.maximum(1, base)
    weight = np.bincount(doc, weights=count, minlength=docs)
    horizon = np.where(weight > 0, size * (np.log(size) + 5.0) / np.maximum(weight, 1), 0.0)
    time, step = np.zeros(len(d)), np.zeros(len(d), dtype=np.uint64)
    while True:
        live = np.arange(len(d))
        while len(live):
            step[live] += np.uint64(1)
            key = mix(s[live] + step[live] * STEP)
            nxt = time[live] - np.log(_unit(key)) / span[live]
            inside = nxt <= horizon[d[live]]
            step[live[~inside]] -= np.uint64(1)
            live, key = live[inside], key[inside]
            time[live] = nxt[inside]
            place = mix(key + np.uint64(1))
            unit = base[live] + ((place >> np.uint64(32)) % span[live].astype(np.uint64)).astype(np.int64)
            hit = unit < c[live]
            at = d[live[hit]] * size + ((place[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
            stamp = time[live[hit]].astype(np.float32).view(np.uint32).astype(np.uint64)
            np.minimum.at(out, at, (stamp << np.uint64(32)) | (mix(key[hit] + np.uint64(2)) >> np.uint64(32)))
        unmet = (out.reshape(docs, size) == np.iinfo(np.uint64).max).any(axis=1) & (weight > 0)
        if not unmet.any():
            return out.reshape(docs, size)
        horizon = np.where(unmet, 2 * horizon, -1.0)
        keep = unmet[d]
        d, s, c, base, span, time, step = (x[keep] for x in (d, s, c, base, span, time, step))


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(docs, bands) hashes of runs of signature components."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.zeros(parts.shape[:2], dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(31) + parts[:, :, r] + np.uint64(r + 1))
    return mix(key + np.arange(BANDS, dtype=np.uint64)[None, :])


def _signature_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in pieces(batch):
            words = Words(some.column("text"))
            doc, shingle, count = bags(words)
            n = words.docs
            keys = band_keys(signatures(doc, shingle, count, n)).view(np.int64)
            weight = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
            bag = [np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)]
            for k in range(2):
                np.add.at(bag[k], doc, mix(mix(shingle + np.uint64(k + 7)) + count.astype(np.uint64)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            yield pa.record_batch([some.column("doc_id"), pa.array(bag[0].view(np.int64)), pa.array(bag[1].view(np.int64)), pa.array(weight), lists, some.column("hash")], names=["doc_id", "bag_a", "bag_b", "weight", "bands", "hash"])


def _overlap_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact multiset overlap, sum of minima over sum of maxima, of the two texts of each row."""
    for batch in batches:
        for some in pieces(batch, "text_b"):
            n, sides = some.num_rows, []
            for name in ("text", "text_b"):
                doc, shingle, count = bags(Words(some.column(name)))
                sides.append(((doc.astype(np.uint64) << np.uint64(48)) | shingle, count))
            _, i, j = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
            both = np.minimum(sides[0][1][i], sides[1][1][j])
            low = np.bincount((sides[0][0][i] >> np.uint64(48)).astype(np.int64), weights=both, minlength=n)
            total = sum(np.bincount((k >> np.uint64(48)).astype(np.int64), weights=c, minlength=n) for k, c in sides)
            overlap = np.where(total > 0, low / np.maximum(total - low, 1), 0.0)
            yield pa.record_batch([some.column("a"), some.column("b"), pa.array(overlap)], names=["a", "b", "overlap"])


def _set_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, items): a text's multiset as a set, the k-th occurrence of a shingle being an item; 32-bit hashes."""
    for batch in batches:
        for some in pieces(batch):
            doc, shingle, count = bags(Words(some.column("text")))
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            item = (mix(np.repeat(shingle, count) + nth.astype(np.uint64) * STEP) >> np.uint64(32)).astype("<u4")
            of = np.repeat(doc, count)
            cut = np.searchsorted(of, np.arange(some.num_rows + 1))
            yield pa.record_batch([some.column("doc_id"), pa.array([item[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["doc_id", "items"])


def shared_items(a: list[bytes], b: list[bytes], columns: int = 8192) -> np.ndarray:
    """Numbers of common items of every set of ``a`` with every one of ``b``, by products of 0/1 matrices over the items in both."""
    flat = [np.frombuffer(b"".join(x), dtype="<u4") for x in (a, b)]
    row = [np.repeat(np.arange(len(x)), [len(i) // 4 for i in x]) for x in (a, b)]
    both = np.intersect1d(flat[0], flat[1])
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    place = [np.searchsorted(both, f) for f in flat]
    known = [(p < len(both)) & (both[np.minimum(p, len(both) - 1)] == f) if len(both) else np.zeros(len(f), dtype=bool) for p, f in zip(place, flat, strict=True)]
    for low in range(0, len(both), columns):
        sides = []
        for p, k, r, x in zip(place, known, row, (a, b), strict=True):
            own = k & (p >= low) & (p < low + columns)
            m = np.zeros((len(x), min(columns, len(both) - low)), dtype=np.float32)
            m[r[own], p[own] - low] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _block_step(threshold: float):
    """(a, b): for each node of one block and each other component in the other block, its most alike member, if alike enough."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("xs"), batch.column("ys"), strict=True):
                x, y = x.as_py(), y.as_py()
                common = shared_items([i["items"] for i in x], [i["items"] for i in y])
                size = [np.array([len(i["items"]) // 4 for i in side]) for side in (x, y)]
                overlap = common / np.maximum(size[0][:, None] + size[1][None, :] - common, 1)
                label = [np.array([i["label"] for i in side]) for side in (x, y)]
                overlap[label[0][:, None] == label[1][None, :]] = 0
                r, c = np.nonzero(overlap >= threshold - 0.001)
                order = np.lexsort((-overlap[r, c], label[1][c], r))
                r, c = r[order], c[order]
                first = np.ones(len(r), dtype=bool)
                first[1:] = (r[1:] != r[:-1]) | (label[1][c[1:]] != label[1][c[:-1]])
                node = [np.array([i["node"] for i in side], dtype=np.int64) for side in (x, y)]
                a, b = node[0][r[first]], node[1][c[first]]
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return step


def _across(placed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Candidate links (a, b) between the components that a band holds.

    In each band the nodes outside its largest component are compared with all of its nodes, in blocks of about
    ``BLOCK`` by ``BLOCK``; of a pair of blocks no more leaves than one link for a node and another component.
    """
    sizes = placed.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    bands = sizes.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    bands = bands.select(F.col("band").alias("k"), "main", F.ceil(F.col("all") / BLOCK).alias("blocks"))
    some = stored(placed.join(bands, F.col("band") == F.col("k")).select("band", "node", "label", "main", "blocks"), "mixed")
    wanted = some.select(F.col("node").alias("i")).distinct()
    sets = stored(texts.join(wanted, F.col("doc_id") == F.col("i")).select("doc_id", "text").mapInArrow(_set_step, "doc_id long, items binary"), "sets")
    filled = some.join(sets, F.col("node") == F.col("doc_id")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    entry = F.struct("node", "label", "items")
    ys = filled.groupBy("band", "block").agg(F.collect_list(entry).alias("ys"))
    xs = filled.where("label <> main").groupBy("band", "block", "blocks").agg(F.collect_list(entry).alias("xs"))
    xs = xs.select(F.col("band").alias("k"), F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("to"), "xs")
    return ys.join(xs, (F.col("band") == F.col("k")) & (F.col("block") == F.col("to"))).select("xs", "ys").mapInArrow(_block_step(threshold), "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, overlap) of the pairs that reach the threshold; the texts come by two equi-joins."""
    left = pairs.join(texts.select(F.col("doc_id").alias("i"), "text"), F.col("a") == F.col("i")).select("a", "b", "text")
    both = left.join(texts.select(F.col("doc_id").alias("i"), F.col("text").alias("text_b")), F.col("b") == F.col("i")).select("a", "b", "text", "text_b")
    return both.mapInArrow(_overlap_step, "a long, b long, overlap double").where(F.col("overlap") >= threshold)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_md5, class_id (the smallest id of its class), copies (documents of
    its multiset).

    1. Every whole text gets its multiset of five-word shingles (words are runs of letters and digits, case
       folded), a 128-bit hash of it, and a BagMinHash signature cut in bands.
    2. Documents of equal multisets are one node from here on, counted before the shuffle; however
       many copies there are, one takes part.
    3. Nodes of a band value are linked to one of them, chosen by a hash, if their overlap, worked out on the whole texts,
       reaches the threshold.  Components of these links are found.
    4. Where a band value still holds several components, nodes across them are compared too, in blocks of
       sets of shingles; what is one component already needs no more comparisons, and of each block only
       one link for a node and another component leaves, which is checked on the texts as before.  So all nodes of
       a band that are alike end in one class, however many there are.
    5. Components of all links are the classes.

    Texts without words (empty, null) are one multiset only if their bytes are equal; texts of fewer than
    five words have one shingle.  Null ids are left out, rows that repeat an id and text get one answer each,
    and of different texts under one id the one of the smallest hash is compared for all of them.  An empty table gives no rows.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    signed = stored(rows.withColumn("hash", F.md5("text")).mapInArrow(_signature_step, "doc_id long, bag_a long, bag_b long, weight long, bands array<long>, hash string"), "signed")
    void = F.col("weight") == 0
    keyed = signed.select("doc_id", "hash", "weight", "bands", F.when(void, F.xxhash64("hash")).otherwise(F.col("bag_a")).alias("ka"), F.when(void, F.lit(0)).otherwise(F.col("bag_b")).alias("kb"))
    nodes = stored(keyed.groupBy("ka", "kb").agg(F.min(F.struct("doc_id", "hash")).alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("weight").alias("weight"), F.any_value("bands").alias("bands")).select("ka", "kb", F.col("first.doc_id").alias("node"), F.col("first.hash").alias("node_hash"), "copies", "weight", "bands"), "nodes")
    linking = nodes.groupBy("node").agg(F.min_by(F.struct("weight", "bands", "node_hash"), "node_hash").alias("x")).select("node", "x.*")
    banded = linking.where("weight > 0").select("node", "weight", F.explode("bands").alias("band"))
    # another head for each band, so that a node of a large family meets many of its members
    heads = banded.groupBy("band").agg(F.min(F.struct(F.xxhash64("node", "band").alias("h"), "node", "weight")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = heads.select(F.col("band").alias("k"), F.col("head.node").alias("head"), F.col("head.weight").alias("head_weight"))
    members = stored(banded.join(heads, F.col("band") == F.col("k")).select("band", "node", "weight", "head", "head_weight"), "members")

    def fits(a: str, b: str):
        return F.least(a, b) >= threshold * F.greatest(a, b)

    wanted = members.select(F.col("node").alias("i")).distinct().join(linking.select("node", "node_hash"), F.col("i") == F.col("node")).select("i", "node_hash")
    found = rows.withColumn("h", F.md5("text")).join(wanted, (F.col("doc_id") == F.col("i")) & (F.col("h") == F.col("node_hash")))
    texts = stored(found.select("doc_id", "text").dropDuplicates(["doc_id"]), "texts")
    stars = members.where((F.col("node") != F.col("head")) & fits("weight", "head_weight")).select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    links = stored(_verified(stars, texts, threshold), "links")
    labels = components(links)
    placed = members.join(labels.withColumnRenamed("node", "i"), F.col("node") == F.col("i"), "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    more = stored(_verified(_across(placed, texts, threshold), texts, threshold), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    classes = nodes.join(labels.withColumnRenamed("node", "i"), F.col("node") == F.col("i"), "left")
    classes = classes.select(F.col("ka").alias("a1"), F.col("kb").alias("b1"), F.coalesce("label", "node").alias("class_id"), "copies")
    return keyed.join(classes, (F.col("ka") == F.col("a1")) & (F.col("kb") == F.col("b1"))).select(F.col("doc_id").alias(id_col), F.col("hash").alias("text_md5"), "class_id", "copies")


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but one of each class: the one of the smallest id stays, with all its columns.

    Documents with null ids stay.  A row is known by its id and text, and repeated rows of a document that stays
    all stay; run exact dedup before it.
    """
    found = near_duplicates(docs, threshold, id_col, text_col)
    gone = found.where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias("i"), F.col("text_md5").alias("h")).distinct()
    names = [f"c{n}" for n in range(len(docs.columns))]
    known, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    return docs.toDF(*names).join(gone, (F.col(known) == F.col("i")) & (F.md5(whole_text(text)) == F.col("h")), "left_anti").toDF(*docs.columns)
