"""Exponential smoothing as a fold over each series' values.

A series is a daily array (bounded by the calendar, never by the raw rows); the
recursion and the grid of smoothing weights are Spark expressions, so all
series, folds and grid points run in one job.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcast.operators.baselines import KEYS, future_day
from revcast.operators.features import season_length

DAMPING = 0.98
Z80 = 1.2816


def series_arrays(train: DataFrame) -> DataFrame:
    """One row per fold and series: last day and the values in order."""
    pairs = F.sort_array(F.collect_list(F.struct("ds", "y")))
    return (
        train.filter(F.col("y").isNotNull())
        .groupBy(*KEYS)
        .agg(F.max("ds").alias("last_ds"), pairs.alias("_p"))
        .select(*KEYS, "last_ds", F.transform("_p", lambda p: p["y"]).alias("ys"), F.size("_p").alias("n"))
    )


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(values), F.lit(1))


def _with_grid(df: DataFrame, names: list[str], points: list[tuple[float, ...]]) -> DataFrame:
    cells = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, point)]) for point in points])
    return df.select("*", F.explode(cells).alias("g")).select("*", "g.*").drop("g")


def _best(df: DataFrame, columns: list[str]) -> DataFrame:
    """Grid point with the least squared one-step error per fold and series."""
    return df.groupBy(*KEYS).agg(*[F.min_by(c, F.struct("sse", "alpha")).alias(c) for c in columns])


def _forecast_rows(model: str, fitted: DataFrame, horizon: int, frequency: str, value: Column) -> DataFrame:
    step = F.col("step")
    rows = fitted.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    rows = rows.withColumn("yhat", F.greatest(F.lit(0.0), value))
    spread = Z80 * F.sqrt(F.col("sse") / F.greatest(F.col("errors"), F.lit(1.0)))
    return rows.select(
        F.lit(model).alias("model"), *KEYS, "step", future_day(F.col("last_ds"), step, frequency).alias("ds"), "yhat",
        F.greatest(F.lit(0.0), F.col("yhat") - spread).alias("yhat_lower"), (F.col("yhat") + spread).alias("yhat_upper"),
    )


def exponential_smoothing(train: DataFrame, horizon: int, frequency: str = "D") -> DataFrame:
    """Damped trend with additive season; series shorter than two seasons go without the season."""
    m = season_length(frequency)
    grid = list(product((0.1, 0.3, 0.6), (0.02, 0.1), (0.05, 0.2)))
    df = _with_grid(series_arrays(train), ["alpha", "beta", "gamma"], grid)
    seasonal = F.col("n") >= 2 * m
    head = F.slice("ys", 1, m)
    base = F.when(seasonal, _mean(head)).otherwise(F.element_at("ys", 1))
    df = df.withColumn("base", base)
    first = F.when(seasonal, F.transform(head, lambda x: x - F.col("base"))).otherwise(F.array_repeat(F.lit(0.0), m))
    skip = F.when(seasonal, F.lit(m)).otherwise(F.lit(1))
    rest = F.slice("ys", skip + 1, F.greatest(F.col("n") - skip, F.lit(0)))
    start = F.struct(
        F.col("base").alias("level"), F.lit(0.0).alias("trend"), first.alias("season"), F.lit(0.0).alias("sse")
    )

    def advance(s: Column, y: Column) -> Column:
        index = F.element_at(s["season"], 1)
        ahead = s["level"] + DAMPING * s["trend"]
        error = y - (ahead + index)
        level = F.col("alpha") * (y - index) + (1 - F.col("alpha")) * ahead
        trend = F.col("beta") * (level - s["level"]) + (1 - F.col("beta")) * DAMPING * s["trend"]
        new_index = F.when(F.col("n") >= 2 * m, F.col("gamma") * (y - level) + (1 - F.col("gamma")) * index).otherwise(0.0)
        return F.struct(
            level.alias("level"), trend.alias("trend"),
            F.concat(F.slice(s["season"], 2, m - 1), F.array(new_index)).alias("season"),
            (s["sse"] + error * error).alias("sse"),
        )

    df = df.withColumn("state", F.aggregate(rest, start, advance)).withColumn("sse", F.col("state.sse"))
    df = df.withColumn("errors", (F.col("n") - skip).cast("double"))
    best = _best(df, ["last_ds", "state", "sse", "errors"])
    step = F.col("step")
    damped = DAMPING * (1 - F.pow(F.lit(DAMPING), step)) / (1 - DAMPING)
    index = F.element_at(F.col("state.season"), ((step - 1) % m + 1).cast("int"))
    return _forecast_rows(
        "exponential_smoothing", best, horizon, frequency, F.col("state.level") + damped * F.col("state.trend") + index
    )


def theta(train: DataFrame, horizon: int, frequency: str = "D") -> DataFrame:
    """Season removed by phase means around the trend, simple smoothing, half of the trend added back."""
    m = season_length(frequency)
    df = series_arrays(train)
    n = F.col("n")
    df = df.withColumn("mean", _mean(F.col("ys")))
    middle = (n - 1) / 2.0
    sxy = F.aggregate(
        F.transform("ys", lambda y, i: (i - middle) * (y - F.col("mean"))), F.lit(0.0), lambda a, x: a + x
    )
    count = n.cast("double")
    df = df.withColumn("slope", F.coalesce(F.try_divide(sxy, count * (count * count - 1) / 12.0), F.lit(0.0)))
    # the season is what the phases deviate from the trend line
    df = df.withColumn("rest", F.transform("ys", lambda y, i: y - F.col("mean") - F.col("slope") * (i - middle)))
    positions = F.sequence(F.lit(0), F.lit(m - 1))

    def phase_mean(j: Column) -> Column:
        return _mean(F.filter("rest", lambda _, i: i % m == j))

    indices = F.when(n >= 2 * m, F.transform(positions, phase_mean)).otherwise(F.array_repeat(F.lit(0.0), m))
    df = df.withColumn("season", indices)
    df = df.withColumn("zs", F.transform("ys", lambda y, i: y - F.element_at("season", (i % m + 1).cast("int"))))
    df = _with_grid(df, ["alpha"], [(a,) for a in (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)])
    start = F.struct(F.element_at("zs", 1).alias("level"), F.lit(0.0).alias("sse"))

    def advance(s: Column, z: Column) -> Column:
        error = z - s["level"]
        return F.struct((s["level"] + F.col("alpha") * error).alias("level"), (s["sse"] + error * error).alias("sse"))

    rest = F.slice("zs", F.lit(2), F.greatest(n - 1, F.lit(0)))
    df = df.withColumn("state", F.aggregate(rest, start, advance)).withColumn("sse", F.col("state.sse"))
    df = df.withColumn("errors", (n - 1).cast("double"))
    best = _best(df, ["last_ds", "state", "sse", "errors", "season", "slope", "alpha", "n"])
    step = F.col("step")
    a = F.col("alpha")
    drift = F.col("slope") / 2 * (step - 1 + 1 / a - F.pow(1 - a, F.col("n")) / a)
    index = F.element_at("season", ((F.col("n") + step - 1) % m + 1).cast("int"))
    return _forecast_rows("theta", best, horizon, frequency, F.col("state.level") + drift + index)
