"""Closed-form forecasts of every fold and series in one job.

Input: training rows ``fold, series_id, ds, y``.  Output: ``model, fold,
series_id, step, ds, yhat, yhat_lower, yhat_upper``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revcast.operators.features import season_length

KEYS = ("fold", "series_id")
BASELINES = ("naive", "historical_average", "seasonal_naive", "trend_drift", "full_average")


def future_day(last: Column, step: Column, frequency: str) -> Column:
    """The step-th period label after the last day: next days, Sundays, month ends or month starts."""
    code = frequency.upper()
    if code.startswith("W"):
        anchor = F.date_add(last, (7 - F.dayofweek(last) + 1) % 7)
        return F.date_add(anchor, (step * 7).cast("int"))
    if code == "MS":
        first = F.trunc(last, "MM")
        anchor = F.when(F.dayofmonth(last) == 1, first).otherwise(F.add_months(first, 1))
        return F.to_date(F.add_months(anchor, step))
    if code.startswith("M"):
        return F.last_day(F.add_months(F.last_day(last), step))
    return F.date_add(last, step.cast("int"))


def future_calendar(train: DataFrame, horizon: int, frequency: str = "D", keys: Sequence[str] = KEYS) -> DataFrame:
    last = train.groupBy(*keys).agg(F.max("ds").alias("_last"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    return last.select(*keys, "_last", steps).select(
        *keys, "step", future_day(F.col("_last"), F.col("step"), frequency).alias("ds")
    )


def baseline_parameters(train: DataFrame, frequency: str = "D") -> DataFrame:
    """One row per fold and series with everything the baselines need, from a single window stage."""
    season = season_length(frequency)
    part = Window.partitionBy(*KEYS)
    rows = train.filter(F.col("y").isNotNull()).select(
        *KEYS,
        "ds",
        "y",
        F.row_number().over(part.orderBy("ds")).alias("idx"),
        F.count("*").over(part).alias("n"),
    )
    rn = F.col("n") - F.col("idx") + 1
    tail = F.least(F.greatest(F.lit(6), F.floor(F.col("n") / 2)), F.col("n"))
    slope = F.regr_slope(F.when(rn <= tail, F.col("y")), F.col("idx").cast("double"))
    return rows.groupBy(*KEYS).agg(
        F.max("ds").alias("last_ds"),
        F.count("*").alias("n"),
        F.max_by("y", "ds").alias("last_y"),
        F.avg(F.when(rn <= 30, F.col("y"))).alias("avg_30"),
        F.avg("y").alias("avg_all"),
        F.when(F.count("*") >= 3, slope).otherwise(F.lit(0.0)).alias("slope"),
        F.transform(
            F.sort_array(F.collect_list(F.when(rn <= season, F.struct("ds", "y")))), lambda p: p["y"]
        ).alias("season_tail"),
    )


def baseline_forecasts(
    train: DataFrame, horizon: int, frequency: str = "D", models: Sequence[str] = BASELINES
) -> DataFrame:
    """The chosen baselines; ``seasonal_naive`` for the series that cover a season."""
    season = season_length(frequency)
    p = baseline_parameters(train, frequency)
    step = F.col("step")
    place = F.col("n") - season + (step - 1) % season
    in_tail = place - F.col("n") + F.size("season_tail")
    seasonal = F.when(place < 0, F.col("last_y")).otherwise(F.get("season_tail", in_tail.cast("int")))
    values = {
        "naive": F.col("last_y"),
        "historical_average": F.col("avg_30"),
        "seasonal_naive": seasonal,
        "trend_drift": F.greatest(F.lit(0.0), F.col("last_y") + F.col("slope") * step),
        "full_average": F.col("avg_all"),
    }
    if "seasonal_naive" in models:
        whole = F.max(F.when(F.col("fold") == F.lit(0), F.col("n"))).over(Window.partitionBy("series_id"))
        p = p.withColumn("_ok", F.coalesce(whole, F.lit(season)) >= season)
    else:
        p = p.withColumn("_ok", F.lit(False))
    expanded = p.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    cells = F.array(*[F.struct(F.lit(m).alias("model"), values[m].cast("double").alias("yhat")) for m in models])
    out = expanded.select(
        *KEYS, "step", future_day(F.col("last_ds"), step, frequency).alias("ds"), "_ok", F.explode(cells).alias("c")
    )
    none = F.lit(None).cast("double")
    return out.filter((F.col("c.model") != "seasonal_naive") | F.col("_ok")).select(
        F.col("c.model").alias("model"), *KEYS, "step", "ds", F.col("c.yhat").alias("yhat"),
        none.alias("yhat_lower"), none.alias("yhat_upper"),
    )


# Seasons that are taken apart, by cadence; half width of the phase smoother in cycles; passes over the seasons.
SEASONS = {"D": (7, 365), "W": (52,), "M": (12,)}
CYCLES, PASSES = 3, 2


def phase_line(near: str = "near") -> str:
    """Value at the row of a line through it and its neighbours, nearer ones weighing more, as SQL over ``near_0`` ... (oldest first)."""
    sums = dict.fromkeys(("s0", "s1", "s2", "t0", "t1"), "0")
    for i in range(2 * CYCLES + 1):
        o, at = i - CYCLES, f"{near}_{i}"
        weight = (1 - (abs(o) / (CYCLES + 1)) ** 3) ** 3
        for name, factor, of in (("s0", weight, "1"), ("s1", weight * o, "1"), ("s2", weight * o * o, "1"), ("t0", weight, at), ("t1", weight * o, at)):
            if factor:
                sums[name] += f" + CASE WHEN {at} IS NULL THEN 0 ELSE CAST({factor!r} AS DOUBLE) * {of} END"
    s = {k: f"({v})" for k, v in sums.items()}
    det = f"({s['s0']} * {s['s2']} - {s['s1']} * {s['s1']})"
    return f"CASE WHEN {det} > 1e-9 THEN ({s['s2']} * {s['t0']} - {s['s1']} * {s['t1']}) / {det} ELSE {s['t0']} / {s['s0']} END"


def seasonal_parts(train: DataFrame, frequency: str = "D") -> tuple[DataFrame, tuple[int, ...]]:
    """(fold, series_id, ds, y, idx, n, s_<season>...): the seasonal parts of every row, by iterated smoothing.

    In turn each season is what is left without the others: the rows of a phase, freed of a moving average, are smoothed
    along the cycles by a local line, and what a whole season adds up to is taken out.  Missing y rows are left out; a season
    that a series does not cover twice is 0.
    """
    seasons = SEASONS.get(frequency.upper()[:1], SEASONS["D"])
    part = Window.partitionBy(*KEYS)
    order = part.orderBy("ds")
    rows = train.filter(F.col("y").isNotNull()).select(
        *KEYS, "ds", F.col("y").cast("double").alias("y"), (F.row_number().over(order) - 1).alias("idx"), F.count("*").over(part).alias("n"),
        *[F.lit(0.0).alias(f"s_{m}") for m in seasons],
    )
    for _ in range(PASSES if len(seasons) > 1 else 1):
        for m in seasons:
            frame = order.rowsBetween(-(m // 2), m // 2)
            left = F.col("y") - sum((F.col(f"s_{o}") for o in seasons if o != m), F.lit(0.0))
            rows = rows.withColumn("left", left).withColumn("rest", F.col("left") - F.avg("left").over(frame))
            phase = Window.partitionBy(*KEYS, F.col("idx") % m).orderBy("idx")
            around = [F.lag("rest", CYCLES - i).over(phase) if i < CYCLES else F.lead("rest", i - CYCLES).over(phase) for i in range(2 * CYCLES + 1)]
            rows = rows.withColumns({f"near_{i}": c for i, c in enumerate(around)}).withColumn("line", F.expr(phase_line()))
            part_m = F.when(F.col("n") >= 2 * m, F.col("line") - F.avg("line").over(frame)).otherwise(0.0)
            rows = rows.withColumn(f"s_{m}", part_m).drop("left", "rest", "line", *[f"near_{i}" for i in range(2 * CYCLES + 1)])
    return rows, seasons


def decomposition_forecast(train: DataFrame, horizon: int, frequency: str = "D") -> DataFrame:
    """Seasonal parts (by day a week and a year), drift of what is left, forecast by drift plus each season's last cycle."""
    rows, seasons = seasonal_parts(train, frequency)
    rn = F.col("n") - F.col("idx")
    tail = F.least(F.greatest(F.lit(6), F.floor(F.col("n") / 2)), F.col("n"))
    flat = rows.withColumn("z", F.col("y") - sum((F.col(f"s_{m}") for m in seasons), F.lit(0.0)))
    # a season's last cycle, in the order of the rows
    cycles = [_last_cycle(m, rn) for m in seasons]
    params = flat.groupBy(*KEYS).agg(
        F.max("ds").alias("last_ds"),
        F.max("n").alias("n"),
        F.avg(F.when(rn <= seasons[0], F.col("z"))).alias("level"),
        F.coalesce(F.regr_slope(F.when(rn <= tail, F.col("z")), F.col("idx").cast("double")), F.lit(0.0)).alias("slope"),
        *cycles,
    )
    step = F.col("step")
    future = params.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    index = sum((F.coalesce(F.get(f"c_{m}", ((step - 1) % m).cast("int")), F.lit(0.0)) for m in seasons), F.lit(0.0))
    none = F.lit(None).cast("double")
    return future.select(
        F.lit("decomposition").alias("model"), *KEYS, "step", future_day(F.col("last_ds"), step, frequency).alias("ds"),
        F.greatest(F.lit(0.0), F.col("level") + F.col("slope") * step + index).alias("yhat"), none.alias("yhat_lower"), none.alias("yhat_upper"),
    )


def _last_cycle(m: int, rn: Column) -> Column:
    rows = F.sort_array(F.collect_list(F.when(rn <= m, F.struct("idx", F.col(f"s_{m}").alias("s")))))
    return F.transform(rows, lambda x: x["s"]).alias(f"c_{m}")
