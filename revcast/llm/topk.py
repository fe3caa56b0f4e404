"""Exact top-k search by inner product: distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revcast.llm.common import stored

BINS_BITS = 10
BLOCK = 256
PACK = 2048
NONE = -(2**63)
LOWEST = -(2**62)
NEVER = 2**62


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>): floor of scaled components; vectors that are null or hold null, NaN or infinity are left out."""
    x = F.col(vector_col)
    sound = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.where(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; float64 is exact below 2^53, beyond it 64-bit integers are used."""
    if q.size and c.size and float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**52:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


def _lists(column) -> list[np.ndarray]:
    return [np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.int64) for x in column]


def _block_scores(cols: dict, width: int | None) -> Iterator[tuple]:
    """(query ids, bounds, candidate ids, scores) of each block pair; what takes no part has score ``NONE``."""
    names = ("ids", "flat", "lows", "c_ids", "c_flat")
    for ids, flat, lows, cids, cflat in zip(*[_lists(cols[n]) for n in names], strict=True):
        scores = _scores(flat.reshape(len(ids), -1), cflat.reshape(len(cids), -1))
        out = (ids[:, None] == cids[None, :]) | (scores < lows[:, None])
        if width is not None:
            out |= scores >= lows[:, None] + width
        scores[out] = NONE
        yield ids, cids, scores


def _count_step(shift: int, width: int | None, k: int):
    """(query, bin, n) over bins of 2^shift scores, inside each query's bounds.

    Of a block at most its k largest scores per query count: more of them cannot move the k-th one,
    and what lies above the k-th is then still counted in full.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            for ids, _, scores in _block_scores(cols, width):
                most = min(k, scores.shape[1])
                best = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most :]
                rows, at = np.nonzero(best != NONE)
                pairs, n = np.unique(np.stack([ids[rows], best[rows, at] >> shift], axis=1), axis=0, return_counts=True)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n.astype(np.int64))], names=["query_id", "bin", "n"])

    return step


def _filter_step(k: int):
    """Of each block the k first of the scores that reach the bound, in the order of the result."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            for ids, cids, scores in _block_scores(cols, None):
                out = [np.empty((0, 3), dtype=np.int64)]
                for i in np.flatnonzero((scores != NONE).any(axis=1)):
                    at = np.flatnonzero(scores[i] != NONE)
                    best = at[np.lexsort((cids[at], -scores[i][at]))][:k]
                    out.append(np.stack([np.full(len(best), ids[i]), cids[best], scores[i][best]], axis=1))
                a = np.concatenate(out)
                yield pa.record_batch([pa.array(a[:, i]) for i in range(3)], names=["query_id", "vec_id", "score"])

    return step


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, first_shift: int = 18) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest integer inner products, ties to the smaller id.

    Everything is scored, block of queries against block of candidates, once per pass.  The first
    pass counts scores in bins of width 2^first_shift; the bin that holds the k-th score of
    a query is cut into 2^10 bins in the next pass, until bins are one score wide.  The last pass
    keeps what reaches the k-th score; of each block pair at most k rows per query leave, so a vector
    that a third of the rows share costs no more than any other.  Between the passes only a bound
    per query is stored.

    Queries with fewer than k candidates get all of them.  Invalid vectors take no part; a vector equal
    to the query's is a candidate unless it has its id (rows that repeat an id all are candidates of
    other queries; repeated query rows are one query, by the smallest vector).  All vectors must have
    one length; empty tables give empty results.
    """
    spark = vectors.sparkSession
    base = stored(whole_vectors(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    blocks = max(1, base.count() // PACK)
    packed = stored(
        base.groupBy(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("c_block")).agg(F.collect_list("vec_id").alias("c_ids"), F.flatten(F.collect_list("v")).alias("c_flat")),
        "packed",
    )
    asked = whole_vectors(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    state = stored(asked.select("*", F.lit(LOWEST).alias("low"), F.lit(k).cast("long").alias("need")), "queries")
    query_blocks = max(1, -(-state.count() // BLOCK))
    tasks = max(spark.sparkContext.defaultParallelism, min(blocks * query_blocks, 4000))

    def pairs(bounds: DataFrame) -> DataFrame:
        q = bounds.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("q_block")).agg(
            F.collect_list("vec_id").alias("ids"), F.flatten(F.collect_list("v")).alias("flat"), F.collect_list("low").alias("lows")
        )
        spread = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("to_block")).repartition(tasks, "c_block", "to_block")
        return spread.join(q, F.col("to_block") == F.col("q_block")).select("ids", "flat", "lows", "c_ids", "c_flat")

    shift, width = first_shift, None
    while True:
        bins = pairs(state).mapInArrow(_count_step(shift, width, k), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        reach = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bin"))))
        bound = reach.join(state.select("vec_id", "need"), F.col("query_id") == F.col("vec_id")).where("upto >= need")
        hit = bound.groupBy("query_id").agg(F.max_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("above")), "bin").alias("x"))
        moved = hit.select("query_id", (F.col("x.bin") * (1 << shift)).alias("to"), F.col("x.above").alias("above"))
        short = F.col("query_id").isNull()
        state = stored(
            state.join(moved, F.col("vec_id") == F.col("query_id"), "left").select(
                "vec_id", "v", F.coalesce("to", "low").alias("low"), F.when(short, F.lit(NEVER)).otherwise(F.col("need") - F.col("above")).alias("need")
            ),
            "bounds",
        )
        if shift == 0:
            break
        width, shift = 1 << shift, max(0, shift - BINS_BITS)
    found = pairs(state).mapInArrow(_filter_step(k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
