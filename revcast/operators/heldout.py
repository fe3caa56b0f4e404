"""Quality of rankings and classifiers on rows they were not fitted on.

Scores come from rolling origins: a model is fitted on what was known at an origin and judged on that origin's rows.
Everything here works on stored scores, so a measure can be worked out again without a fit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import reduce
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.functions.ranking import running
from revcast.functions.scalars import clip

FITS_AT_ONCE = 3
T = TypeVar("T")


def origins(df: DataFrame, column: str, folds: int = 3) -> list[date]:
    """The latest ``folds`` different days of a column, oldest first."""
    days = df.select(F.col(column).alias("d")).filter("d IS NOT NULL").distinct().orderBy(F.desc("d")).limit(folds)
    return sorted(r["d"] for r in days.collect())


def side_by_side(jobs: Sequence[Callable[[], T]]) -> list[T]:
    """Results of independent job chains, a few at a time; the driver only waits."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return list(pool.map(lambda job: job(), jobs))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def ranking_quality(scores: DataFrame, top_share: float = 0.2) -> DataFrame:
    """fold, rows, label_sum, ndcg, top_bucket_capture of scores (fold, label, prediction, ids).

    Gains are discounted per fold's list.  Rows of one prediction share the mean of their labels, so the order of
    equal predictions does not count; in the top bucket they are taken in the order of the ids.  A fold without any label
    above zero has no gain to share: null.
    """
    ids = [c for c in scores.columns if c not in ("fold", "label", "prediction")]
    ordered = running(scores, [F.desc("prediction"), *ids], ["fold"]).withColumn("p", F.col("before") + 1).drop("before", "whole")
    both = running(ordered, [F.desc("label"), *ids], ["fold"]).select("fold", "label", "prediction", "p", (F.col("before") + 1).alias("i"), F.col("whole").alias("n"))
    cut = F.greatest(F.lit(1), F.floor(F.col("n") * top_share))
    tied = both.groupBy("fold", "prediction").agg(
        (F.avg("label") * F.sum(1 / F.log2(F.col("p") + 1))).alias("gain"), F.sum(F.col("label") / F.log2(F.col("i") + 1)).alias("best"),
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("labels"), F.count(F.when((F.col("p") <= cut) & (F.col("i") <= cut), 1)).alias("hits"),
        F.max(cut).alias("cut"),
    )
    return tied.groupBy("fold").agg(
        F.sum("n").alias("rows"), F.sum("labels").alias("label_sum"),
        F.when(F.sum("best") > 0, F.sum("gain") / F.sum("best")).alias("ndcg"), (F.sum("hits") / F.max("cut")).alias("top_bucket_capture"),
    )


def classifier_quality(scores: DataFrame) -> DataFrame:
    """fold, target, rows, positives, auc, log_loss, precision, recall, f1 of scores (fold, target, label, probability, ids).

    The area under the curve is the share of pairs of a positive and a negative row in the right order, equal
    probabilities counting half; null where a fold has one class only.
    """
    ids = [c for c in scores.columns if c not in ("fold", "target", "label", "probability")]
    keys = ["fold", "target"]
    p, hit, said = clip("probability", 1e-5, 1 - 1e-5), F.col("label") == 1, F.col("probability") >= 0.5
    values = running(scores, ["probability", *ids], keys).groupBy(*keys, "probability").agg(
        F.avg(F.col("before") + 1).alias("rank"), F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("hits"),
        F.sum(F.when(hit, -F.ln(p)).otherwise(-F.ln(1 - p))).alias("loss"), F.count(F.when(hit & said, 1)).alias("tp"), F.count(F.when(said, 1)).alias("said"),
    )
    facts = values.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "hits", "loss", "tp", "said")], F.sum(F.col("rank") * F.col("hits")).alias("ranks"))
    pos, neg, zero = F.col("hits"), F.col("n") - F.col("hits"), F.lit(0.0)
    return facts.select(
        *keys, F.col("n").alias("rows"), pos.alias("positives"), F.try_divide(F.col("ranks") - pos * (pos + 1) / 2, pos * neg).alias("auc"),
        (F.col("loss") / F.col("n")).alias("log_loss"), F.coalesce(F.try_divide("tp", "said"), zero).alias("precision"),
        F.coalesce(F.try_divide("tp", "hits"), zero).alias("recall"), F.coalesce(F.try_divide(2 * F.col("tp"), F.col("said") + pos), zero).alias("f1"),
    )
