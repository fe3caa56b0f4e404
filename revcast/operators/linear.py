"""Ridge and elastic net over all series, on the recipe's features.

One pass over the training rows gives a Gram matrix for every fold; its size is that of the feature list, whatever the
rows.  Ridge is a Cholesky solve on it, the elastic net a coordinate descent, both in standardised terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.operators import stepping
from revcast.operators.baselines import KEYS
from revcast.operators.features import FeatureRecipe, recipe

# Penalty weight, share of the absolute penalty, half width of the band.
MODELS = {"ridge": (1.0, 0.0), "elasticnet": (0.25, 0.5)}
BAND = 0.12
SWEEPS, TOLERANCE = 25_000, 1e-12


@dataclass
class LinearFit:
    """Weights of standardised inputs, the mean and deviation that standardise them, and the range each was seen in.

    Inputs are held to that range: what a forecast feeds back into lags and growth cannot carry it ever further away.
    """

    names: list[str]
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    intercept: float
    rows: int
    low: np.ndarray
    high: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + ((np.clip(x, self.low, self.high) - self.mean) / self.scale) @ self.weights


def input_names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in (*KEYS, "ds", "y")]


def gram(rows: DataFrame, names: list[str]) -> dict[int, np.ndarray]:
    """Per fold the matrix of products of (1, inputs, y), summed over all rows, and below it the least and largest values.

    Each partition sends one matrix per fold, its cells are added up by a grouped sum, and the sums, as many as there are
    folds and pairs of inputs, come to the driver.
    """
    columns = [*names, "y"]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            folds = np.array(batch.column("fold").to_pylist())
            z = np.column_stack([np.ones(batch.num_rows), *[batch.column(c).to_numpy(zero_copy_only=False) for c in columns]])
            for fold in np.unique(folds):
                own = z[folds == fold]
                new = np.vstack([own.T @ own, own.min(axis=0), own.max(axis=0)])
                old = total.get(int(fold))
                if old is not None:
                    new[:-2] += old[:-2]
                    new[-2:] = np.minimum(new[-2], old[-2]), np.maximum(new[-1], old[-1])
                total[int(fold)] = new
        for fold, matrix in total.items():
            size = len(matrix)
            yield pa.record_batch([pa.array([fold] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(matrix.tolist(), pa.list_(pa.float64()))], names=["fold", "i", "cells"])

    parts = rows.select("fold", *columns).mapInArrow(products, "fold int, i int, cells array<double>")
    size = len(columns) + 1
    joined = F.when(F.col("i") < size, F.sum("v")).when(F.col("i") == size, F.min("v")).otherwise(F.max("v"))
    cells = parts.select("fold", "i", F.posexplode("cells").alias("j", "v")).groupBy("fold", "i", "j").agg(joined.alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in cells.collect():
        out.setdefault(r["fold"], np.zeros((size + 2, size)))[r["i"], r["j"]] = r["v"]
    return out


def solve(matrix: np.ndarray, names: list[str], model: str) -> LinearFit | None:
    """The weights that are best for the sums of a fold; None with two rows or fewer, or a constant target.

    Ridge: least squares plus alpha times the squared weights.  Elastic net: half the mean square plus alpha times
    (share x absolute + (1 - share) / 2 x squared weights).  Inputs without variation have weight 0.
    """
    alpha, share = MODELS[model]
    low, high = matrix[-2:, 1:-1]
    matrix = matrix[:-2]
    n = matrix[0, 0]
    mean = matrix[0, 1:] / n
    spread = matrix[1:, 1:] - n * np.outer(mean, mean)
    variance = np.maximum(np.diag(spread) / n, 0.0)
    size = np.maximum(np.abs(mean), 1.0)
    if n <= 2 or variance[-1] <= (1e-9 * size[-1]) ** 2:
        return None
    varies = variance[:-1] > (1e-7 * size[:-1]) ** 2
    scale = np.where(varies, np.sqrt(variance[:-1]), 1.0)
    used = np.flatnonzero(varies)
    a = (spread[:-1, :-1] / np.outer(scale, scale))[np.ix_(used, used)]
    b = (spread[:-1, -1] / scale)[used]
    if share == 0:
        factor = np.linalg.cholesky(a + alpha * np.eye(len(used)))
        w = np.linalg.solve(factor.T, np.linalg.solve(factor, b))
    else:
        w = descend(a / n, b / n, alpha * share, alpha * (1 - share))
    weights = np.zeros(len(names))
    weights[used] = w
    return LinearFit(names, weights, mean[:-1], scale, float(mean[-1]), int(n), low, high)


def descend(a: np.ndarray, b: np.ndarray, absolute: float, square: float) -> np.ndarray:
    """Coordinate descent for w'aw/2 - b'w + absolute |w| + square w'w/2, until no weight moves."""
    w, left = np.zeros(len(b)), b.copy()
    diagonal = np.diag(a) + square
    size = max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(SWEEPS):
        most = 0.0
        for j in range(len(b)):
            pull = left[j] + a[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - absolute, 0.0) / diagonal[j]
            step = new - w[j]
            if step:
                left -= a[:, j] * step
                w[j] = new
                most = max(most, abs(step))
        if most <= TOLERANCE * size:
            break
    return w


def linear_fits(rows: DataFrame, model: str) -> dict[int, LinearFit]:
    names = input_names(rows)
    found = {fold: solve(matrix, names, model) for fold, matrix in gram(rows, names).items()}
    return {fold: fit for fold, fit in sorted(found.items()) if fit is not None}


def conditions(rows: DataFrame, fits: dict[int, LinearFit], model: str) -> DataFrame:
    """How far each weight is from its optimum (fold, feature, violation), worked out anew from the rows.

    The slope of the loss along a weight, in units of the target's deviation; 0 where the fit is best.  Fits are few and
    small, and are broadcast.
    """
    alpha, share = MODELS[model]
    spark, names = rows.sparkSession, input_names(rows)
    table = [(f, fit.intercept, fit.rows, *[[float(v) for v in x] for x in (fit.weights, fit.mean, fit.scale)]) for f, fit in fits.items()]
    known = spark.createDataFrame(table, "fold int, intercept double, n long, w array<double>, m array<double>, s array<double>")
    met = rows.join(F.broadcast(known), "fold")
    z = F.zip_with(F.zip_with(F.array(*names), "m", lambda x, m: x - m), "s", lambda x, s: x / s)
    fitted = F.aggregate(F.zip_with("z", "w", lambda a, b: a * b), F.col("intercept"), lambda t, x: t + x)
    slopes = met.withColumn("z", z).withColumn("rest", F.col("y") - fitted)
    each = slopes.select("fold", "n", "rest", "y", F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("feature"), "z", "w")).alias("e"))
    sums = each.groupBy("fold", F.col("e.feature").alias("feature")).agg(
        F.sum(F.col("e.z") * F.col("rest")).alias("g"), F.first("e.w").alias("w"), F.first("n").alias("n"), F.stddev_pop("y").alias("sd"), F.stddev_pop("e.z").alias("varies"))
    if share == 0:
        off = F.abs(F.col("g") - alpha * F.col("w")) / F.col("n")
    else:
        slope = F.col("g") / F.col("n") - alpha * (1 - share) * F.col("w")
        off = F.when(F.col("w") != 0, F.abs(slope - alpha * share * F.signum("w"))).otherwise(F.greatest(F.abs(slope) - alpha * share, F.lit(0.0)))
    return sums.select("fold", "feature", F.when(F.col("varies") > 1e-6, off / F.col("sd")).otherwise(F.lit(0.0)).alias("violation"))


def linear_forecast(
    train: DataFrame, folds: list[int], horizon: int, frequency: str = "D", model: str = "ridge",
    future: DataFrame | None = None, lag_profile: str | None = None,
) -> DataFrame | None:
    """Forecasts of the given folds, or None if no fold has the rows for a fit."""
    r: FeatureRecipe = recipe(model, frequency, lag_profile)
    chosen = train.where(F.col("fold").isin(*folds))
    fits = linear_fits(stepping.model_rows(chosen, r), model)
    if not fits:
        return None
    return stepping.banded(stepping.forecast(stepping.states(train, r, horizon, future), r, horizon, fits), model, BAND)
