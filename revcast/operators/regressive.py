"""Per-series linear models: autoregression by Levinson-Durbin, and trend with Fourier terms by normal equations.

Sums of products per fold and series are all that is gathered; they are combined before the shuffle, so a series may have
any number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revcast.functions.frames import by_series
from revcast.operators.baselines import KEYS, future_calendar, future_day
from revcast.operators.features import season_length
from revcast.schema import FLAG_COLUMNS

# Fixed value: half width of an 80 % interval in deviations.
Z80 = 1.2816
MOST_LAGS = 28
KNOTS = 5
WEEK_WAVES, YEAR_WAVES = 3, 5
PENALTY = 1e-3


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def lag_count(frequency: str) -> int:
    """Highest order that is tried: two seasons, ``MOST_LAGS`` at most."""
    return min(2 * season_length(frequency), MOST_LAGS)


def autocovariances(train: DataFrame, lags: int) -> DataFrame:
    """Per fold and series: last_ds, n, the least-squares line (mean of y and of the row number, slope), r (covariances of what is left, at
    lag 0 to ``lags``) and the last of what is left, oldest first."""
    part = Window.partitionBy(*KEYS)
    rows = train.where(F.col("y").isNotNull()).select(*KEYS, "ds", F.col("y").cast("double").alias("y"), F.row_number().over(part.orderBy("ds")).cast("double").alias("i"))
    slope = F.coalesce(F.regr_slope("y", "i").over(part), F.lit(0.0))
    rows = rows.select("*", F.avg("y").over(part).alias("mean"), F.avg("i").over(part).alias("middle"), slope.alias("slope"))
    rows = rows.withColumn("z", F.col("y") - F.col("mean") - F.col("slope") * (F.col("i") - F.col("middle")))
    w = by_series(*KEYS)
    rn = F.row_number().over(part.orderBy(F.col("ds").desc()))
    lagged = rows.select(*KEYS, "ds", "mean", "middle", "slope", "z", rn.alias("rn"), *[F.lag("z", k).over(w).alias(f"z_{k}") for k in range(1, lags + 1)])
    products = [F.coalesce(F.sum(F.col("z") * F.col("z" if k == 0 else f"z_{k}")), F.lit(0.0)) / F.count(F.lit(1)) for k in range(lags + 1)]
    tail = F.sort_array(F.collect_list(F.when(F.col("rn") <= lags, F.struct("ds", "z"))))
    return lagged.groupBy(*KEYS).agg(
        F.max("ds").alias("last_ds"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("mean", "middle", "slope")],
        F.array(*products).alias("r"), F.transform(tail, lambda x: x["z"]).alias("tail"),
    )


def levinson(moments: DataFrame, lags: int) -> DataFrame:
    """Add ``a`` (weights of the last values, newest first) and ``variance`` of the order with the least information criterion.

    One fold over the orders: each order's weights come from those of the one before.  Orders of a quarter of the rows
    or more are not tried; a constant series has order 0.
    """
    r, n = F.col("r"), F.col("n").cast("double")

    def score(variance: Column, order: Column) -> Column:
        return n * F.log(F.greatest(variance, F.lit(1e-9))) + 2 * (order + 1)

    def step(s: Column, p: Column) -> Column:
        a, e = s["a"], s["e"]
        gap = F.element_at(r, p + 1) - _dot(a, F.reverse(F.slice(r, F.lit(2), p - 1)))
        k = F.when(e > 1e-12, gap / e).otherwise(0.0)
        new = F.concat(F.zip_with(a, F.reverse(a), lambda x, y: x - k * y), F.array(k))
        left = e * (1 - k * k)
        better = (p < n / 4) & (score(left, p) < s["score"])
        return F.struct(
            new.alias("a"), left.alias("e"), F.when(better, new).otherwise(s["best"]).alias("best"),
            F.when(better, left).otherwise(s["variance"]).alias("variance"), F.when(better, score(left, p)).otherwise(s["score"]).alias("score"),
        )

    none, zero = F.array().cast("array<double>"), F.element_at(r, 1)
    start = F.struct(none.alias("a"), zero.alias("e"), none.alias("best"), zero.alias("variance"), score(zero, F.lit(0.0)).alias("score"))
    fitted = moments.withColumn("fit", F.aggregate(F.sequence(F.lit(1), F.lit(lags)), start, step))
    return fitted.withColumns({"a": F.col("fit.best"), "variance": F.col("fit.variance")}).drop("fit")


def autoregression(train: DataFrame, horizon: int, frequency: str = "D") -> DataFrame:
    """Yule-Walker autoregression around the least-squares line, with the interval of its own moving-average weights.

    Missing y rows are left out; a series of any length has a forecast, a very short or straight one its line.
    """
    lags = lag_count(frequency)
    fitted = levinson(autocovariances(train, lags), lags)
    a = F.col("a")

    def step(s: Column, _: Column) -> Column:
        value = _dot(a, F.slice(s["past"], F.lit(1), F.size(a)))
        weight = _dot(a, F.slice(s["weights"], F.lit(1), F.size(a)))
        spread = s["spread"] + F.element_at(s["weights"], 1) * F.element_at(s["weights"], 1)
        return F.struct(
            F.slice(F.concat(F.array(value), s["past"]), 1, lags).alias("past"), F.slice(F.concat(F.array(weight), s["weights"]), 1, lags).alias("weights"),
            spread.alias("spread"), F.concat(s["out"], F.array(F.struct(value.alias("z"), spread.alias("spread")))).alias("out"),
        )

    zeros = F.array_repeat(F.lit(0.0), lags)
    start = F.struct(
        F.slice(F.concat(F.reverse("tail"), zeros), 1, lags).alias("past"), F.slice(F.concat(F.array(F.lit(1.0)), zeros), 1, lags).alias("weights"),
        F.lit(0.0).alias("spread"), F.array().cast("array<struct<z:double,spread:double>>").alias("out"),
    )
    path = fitted.withColumn("path", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda s: s["out"]))
    rows = path.select(*KEYS, "last_ds", "n", "mean", "middle", "slope", "variance", F.posexplode("path").alias("i", "at"))
    value = F.col("mean") + F.col("slope") * (F.col("n") + F.col("i") + 1 - F.col("middle")) + F.col("at.z")
    band = Z80 * F.sqrt(F.greatest(F.col("variance"), F.lit(0.0)) * F.col("at.spread"))
    number = (F.col("i") + 1).alias("step")
    return rows.select(
        F.lit("autoregression").alias("model"), *KEYS, number, future_day(F.col("last_ds"), F.col("i") + 1, frequency).alias("ds"),
        F.greatest(value, F.lit(0.0)).alias("yhat"), F.greatest(value - band, F.lit(0.0)).alias("yhat_lower"), F.greatest(value + band, F.lit(0.0)).alias("yhat_upper"),
    )


def _design(flags: list[str], daily: bool) -> list[Column]:
    """Inputs of a day: level, trend with bends, weekly and (from a year of history on) yearly waves, flags."""
    day, start = (F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("double") for c in ("ds", "t0"))
    span = F.greatest(F.datediff("t1", "t0").cast("double"), F.lit(1.0))
    u = (day - start) / span
    parts = [F.lit(1.0), u, *[F.greatest(u - float(k), F.lit(0.0)) for k in np.linspace(0.1, 0.8, KNOTS)]]
    waves = [(7.0, k, F.lit(True)) for k in range(1, WEEK_WAVES + 1) if daily] + [(365.25, k, span >= 365) for k in range(1, YEAR_WAVES + 1)]
    for period, k, used in waves:
        turn = day * (2 * np.pi * k / period)
        parts += [F.when(used, fn(turn)).otherwise(0.0) for fn in (F.sin, F.cos)]
    return parts + [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in flags]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of (inputs, y) added up per fold and series within a partition; handed on when many are held."""
    held: dict[tuple, list] = {}

    def out() -> pa.RecordBatch:
        keys = list(held)
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.date32()), pa.array([k[3] for k in keys], pa.date32())]
        return pa.record_batch([*columns, pa.array([held[k].reshape(-1).tolist() for k in keys], pa.list_(pa.float64()))], names=["fold", "series_id", "t0", "t1", "cells"])

    for batch in batches:
        if not batch.num_rows:
            continue
        z = np.array(batch.column("x").to_pylist(), dtype=float)
        keys = list(zip(*[batch.column(c).to_pylist() for c in ("fold", "series_id", "t0", "t1")]))
        number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        of = np.array([number[k] for k in keys])
        for k, i in number.items():
            own = z[of == i]
            held[k] = held.get(k, 0.0) + own.T @ own
        if len(held) > 2000:
            yield out()
            held.clear()
    if held:
        yield out()


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights of each fold and series from all its partial sums, which the shuffle has brought to this task."""
    held: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for key, cells in zip(zip(*[batch.column(c).to_pylist() for c in ("fold", "series_id", "t0", "t1")]), batch.column("cells").to_pylist()):
            held[key] = held.get(key, 0.0) + np.array(cells)
    keys = list(held)
    betas, sigmas, counts = [], [], []
    for key in keys:
        size = int(round(np.sqrt(len(held[key]))))
        g = held[key].reshape(size, size)
        n, gram, moment = g[0, 0], g[:-1, :-1], g[:-1, -1]
        mean = gram[0] / n
        variance = np.maximum(np.diag(gram) / n - mean * mean, 0.0)
        penalty = np.where(variance > 1e-12, PENALTY * n * np.maximum(np.sqrt(variance), 1e-9) ** 2, 1.0)
        penalty[0] = 0.0
        beta = np.linalg.solve(gram + np.diag(penalty), moment)
        left = max(g[-1, -1] - 2 * beta @ moment + beta @ gram @ beta, 0.0) / n - ((moment[0] - gram[0] @ beta) / n) ** 2
        betas.append(beta.tolist())
        sigmas.append(float(np.sqrt(max(left, 0.0))))
        counts.append(int(round(n)))
    columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.date32()), pa.array([k[3] for k in keys], pa.date32())]
    yield pa.record_batch([*columns, pa.array(counts, pa.int64()), pa.array(betas, pa.list_(pa.float64())), pa.array(sigmas, pa.float64())], names=["fold", "series_id", "t0", "t1", "n", "beta", "sigma"])


def fourier_rows(train: DataFrame, frequency: str = "D") -> tuple[DataFrame, list[str]]:
    """(fold, series_id, t0, t1, x, y): the inputs of every known day, and the flags among them."""
    flags = [c for c in FLAG_COLUMNS if c in train.columns]
    part = Window.partitionBy(*KEYS)
    rows = train.where(F.col("y").isNotNull()).select(*KEYS, "ds", F.col("y").cast("double").alias("y"), *flags, F.min("ds").over(part).alias("t0"), F.max("ds").over(part).alias("t1"))
    return rows.select(*KEYS, "t0", "t1", "ds", "y", F.array(*_design(flags, frequency.upper()[:1] == "D")).alias("x")), flags


def fourier_weights(rows: DataFrame) -> DataFrame:
    """(fold, series_id, t0, t1, n, beta, sigma): penalised least squares of each fold and series."""
    z = rows.select(*KEYS, "t0", "t1", F.concat("x", F.array("y")).alias("x"))
    parts = z.mapInArrow(_sums, "fold int, series_id string, t0 date, t1 date, cells array<double>")
    return parts.repartition(*KEYS).mapInArrow(_solved, "fold int, series_id string, t0 date, t1 date, n long, beta array<double>, sigma double")


def trend_fourier(train: DataFrame, horizon: int, frequency: str = "D", least_rows: int = 10, future: DataFrame | None = None) -> DataFrame:
    """Piecewise linear trend, weekly and yearly waves and event flags, with an 80 % interval.

    Flags of coming days are those of ``future`` (series_id, ds, flags), else those of the table where a fold ends before
    the table does, else zero.  Series with fewer than ``least_rows`` rows are left out.
    """
    rows, flags = fourier_rows(train, frequency)
    weights = fourier_weights(rows).where(F.col("n") >= least_rows)
    days = future_calendar(train, horizon, frequency)
    given = [f for f in flags if future is not None and f in future.columns]
    if flags:
        calendar = train.where("fold = 0").select("series_id", "ds", *flags)
        if given:
            told = future.select("series_id", "ds", *[F.col(f).alias(f"given_{f}") for f in given])
            calendar = calendar.join(told, ["series_id", "ds"], "full")
            calendar = calendar.select("series_id", "ds", *[(F.coalesce(f"given_{f}", f) if f in given else F.col(f)).alias(f) for f in flags])
        days = days.join(calendar, ["series_id", "ds"], "left")
    met = days.join(weights, list(KEYS))
    terms = _design(flags, frequency.upper()[:1] == "D")
    value = F.greatest(reduce(lambda t, x: t + x, [c * F.element_at("beta", i + 1) for i, c in enumerate(terms)]), F.lit(0.0))
    band = Z80 * F.col("sigma")
    return met.withColumn("yhat", value).select(
        F.lit("trend_fourier").alias("model"), *KEYS, "step", "ds", "yhat",
        F.greatest(F.col("yhat") - band, F.lit(0.0)).alias("yhat_lower"), (F.col("yhat") + band).alias("yhat_upper"),
    )


def normal_equations(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Largest gap of the penalised normal equations per fold and series, worked out anew from the rows.

    In units of the sum of squares of the input times the deviation of y; 0 where the weights are best.
    """
    met = rows.join(weights.drop("t0", "t1"), list(KEYS))
    rest = F.col("y") - _dot(F.col("x"), F.col("beta"))
    each = met.withColumn("rest", rest).select(*KEYS, "n", "y", "beta", "rest", F.posexplode("x").alias("j", "v"))
    sums = each.groupBy(*KEYS, "j").agg(
        F.sum(F.col("v") * F.col("rest")).alias("g"), F.var_pop("v").alias("variance"), F.first("n").alias("n"),
        F.element_at(F.first("beta"), F.first("j") + 1).alias("b"), F.stddev_pop("y").alias("sd"), F.sum(F.col("v") * F.col("v")).alias("square"),
    )
    penalty = F.when(F.col("j") == 0, 0.0).when(F.col("variance") > 1e-12, PENALTY * F.col("n") * F.col("variance")).otherwise(1.0)
    off = F.abs(F.col("g") - penalty * F.col("b")) / F.greatest(F.col("sd") * F.greatest(F.col("square"), F.lit(1.0)), F.lit(1e-9))
    return sums.groupBy(*KEYS).agg(F.max(off).alias("gap"))
