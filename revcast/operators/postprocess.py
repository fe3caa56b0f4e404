"""Forecast post-processing: trend guard, display choice, calendar shape, scenario bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revcast.functions.frames import newest_first
from revcast.functions.scalars import clip
from revcast.operators.evaluate import frequency_family


def trend_profile(daily: DataFrame) -> DataFrame:
    """Per series: slope and level of the recent history, and whether the trend is clear.

    Columns direction (+1, -1), slope, recent_mean, total_change, slope_strength, points, clear.
    """
    hist = daily.filter(F.col("y").isNotNull()).groupBy("series_id", "ds").agg(F.sum("y").alias("y"))
    w = Window.partitionBy("series_id")
    gaps = hist.withColumn("gap", F.datediff("ds", F.lag("ds").over(w.orderBy("ds"))))
    typical = gaps.groupBy("series_id").agg(F.percentile("gap", 0.5).alias("gap"), F.count("*").alias("n"))
    size = F.least(F.col("n"), F.when(F.coalesce("gap", F.lit(1.0)) >= 20, 12).otherwise(180))
    rows = newest_first(hist, ["series_id"]).join(
        typical.select("series_id", size.alias("points"), "n", F.coalesce("gap", F.lit(1.0)).alias("median_gap_days")), "series_id"
    )
    tail = rows.filter((F.col("rn_desc") <= F.col("points")) & (F.col("n") >= 8))
    third = F.greatest(F.lit(2), F.floor(F.col("points") / 3))
    x = (F.col("points") - F.col("rn_desc")).cast("double")
    facts = tail.groupBy("series_id", "points", "median_gap_days").agg(
        F.regr_slope("y", x).alias("slope"),
        F.avg(F.when(x < third, F.col("y"))).alias("early_mean"),
        F.avg(F.when(F.col("rn_desc") <= third, F.col("y"))).alias("recent_mean"),
        F.avg("y").alias("mean_y"),
        F.max_by("y", "ds").alias("last_value"),
    )
    change = (F.col("recent_mean") - F.col("early_mean")) / F.greatest(F.abs("early_mean"), F.lit(1.0))
    strength = F.col("slope") * F.col("points") / F.greatest(F.abs("mean_y"), F.lit(1.0))
    out = facts.withColumn("total_change", change).withColumn("slope_strength", strength)
    clear = (F.abs("total_change") >= 0.12) & (F.abs("slope_strength") >= 0.08) & (F.col("mean_y") > 0)
    return out.select(
        "series_id", F.when(F.col("slope") > 0, 1).otherwise(-1).alias("direction"), "slope", "recent_mean", "last_value",
        "total_change", "slope_strength", "median_gap_days", "points", clear.cast("int").alias("clear"),
    )


def trend_guardrail(forecast: DataFrame, profile: DataFrame) -> DataFrame:
    """Lift (or lower) forecasts which contradict a clear trend to the trend line at three quarters of its slope."""
    keys = ["model", "series_id"]
    w = Window.partitionBy(*keys)
    rows = forecast.withColumn("_i", F.row_number().over(w.orderBy("ds")) - 1)
    facts = rows.groupBy(*keys).agg(
        F.count("yhat").alias("_n"),
        F.count("*").alias("_rows"),
        F.regr_slope("yhat", F.col("_i").cast("double")).alias("_slope"),
        F.avg("yhat").alias("_mean"),
        F.avg(F.when(F.col("_i") < 3, F.col("yhat"))).alias("_head"),
    )
    clear = profile.filter("clear = 1").select("series_id", "direction", "slope", "recent_mean")
    change = F.col("_slope") * F.col("_n") / F.greatest(F.abs("_mean"), F.lit(1.0))
    up = F.col("direction") > 0
    needed = (F.col("_n") >= 3) & (F.col("_n") == F.col("_rows")) & (
        (change * F.col("direction") < 0.04)
        | (up & (F.col("_head") < F.col("recent_mean") * 0.98))
        | (~up & (F.col("_head") > F.col("recent_mean") * 1.02))
    )
    decided = facts.join(clear, "series_id").filter(needed).select(*keys, "direction", "slope", "recent_mean")
    joined = rows.join(decided, keys, "left")
    target = F.col("recent_mean") + F.col("slope") * (F.col("_i") + 1) * 0.75
    moved = F.when(F.col("direction").isNull(), F.col("yhat")).otherwise(
        F.greatest(F.lit(0.0), F.when(up, F.greatest("yhat", target)).otherwise(F.least("yhat", target)))
    )
    ratio = F.when(F.abs("yhat") > 1e-9, F.col("_new") / F.col("yhat"))

    def bound(c: str, fallback: float) -> Column:
        scaled = F.when(ratio.isNull(), F.col("_new") * fallback).otherwise(F.col(c) * ratio)
        return F.when(F.col("direction").isNull(), F.col(c)).otherwise(clip(scaled, 0.0))

    return joined.withColumn("_new", moved).select(
        *[c for c in forecast.columns if c not in ("yhat", "yhat_lower", "yhat_upper")],
        F.col("_new").alias("yhat"),
        bound("yhat_lower", 0.92).alias("yhat_lower"),
        bound("yhat_upper", 1.08).alias("yhat_upper"),
        F.col("direction").isNotNull().cast("int").alias("guarded"),
    )


def month_edge_lift(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """How far the first and last four days of a month lie above its middle, as a share of the middle."""
    day, length = F.dayofmonth("ds"), F.dayofmonth(F.last_day("ds"))
    edge, middle = (day <= 4) | (day > length - 4), day.between(11, 20)
    v = F.col(value)
    facts = df.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count(F.when(edge, 1)).alias("n_edge"),
        F.count(F.when(middle, 1)).alias("n_mid"),
        F.avg(F.when(edge, v)).alias("edge"),
        F.avg(F.when(middle, v)).alias("mid"),
    )
    enough = (F.col("n") >= 28) & (F.col("n_edge") >= 6) & (F.col("n_mid") >= 6)
    lift = (F.col("edge") - F.col("mid")) / F.greatest(F.abs("mid"), F.lit(1.0))
    return facts.select(*keys, F.when(enough, lift).alias("edge_lift"))


def display_choice(best: DataFrame, blended: DataFrame, daily: DataFrame, frequency: str = "D") -> DataFrame:
    """One row per series: edge lifts and the forecast to show, ``best`` or ``blend``."""
    keys = ("series_id",)
    h = month_edge_lift(daily, "y", keys).withColumnRenamed("edge_lift", "hist")
    b = month_edge_lift(best, "yhat", keys).withColumnRenamed("edge_lift", "best")
    m = month_edge_lift(blended, "yhat", keys).withColumnRenamed("edge_lift", "blend")
    row = h.join(b, "series_id", "left").join(m, "series_id", "left")
    zero = F.lit(0.0)
    sign = F.when(F.col("hist") >= 0, 1.0).otherwise(-1.0)
    blend_lift = F.coalesce("blend", zero)
    best_gap, blend_gap = F.abs(F.col("best") - F.col("hist")), F.abs(blend_lift - F.col("hist"))
    flat = F.col("blend").isNull() | (F.abs("blend") < 0.02)
    better = (sign * F.col("best") > sign * blend_lift + 0.03) & (best_gap <= F.when(blend_gap > 0, blend_gap * 0.9).otherwise(best_gap))
    keep_best = (F.abs("hist") >= 0.05) & F.col("best").isNotNull() & (F.abs("best") >= 0.03) & (flat | better)
    daily_only = F.lit(frequency_family(frequency) == "D")
    choice = F.when(daily_only & F.coalesce(keep_best, F.lit(False)), "best").otherwise("blend")
    return row.select("series_id", "hist", "best", "blend", choice.alias("choice"))


def display_forecast(best: DataFrame, blended: DataFrame, choice: DataFrame) -> DataFrame:
    """Rows of the chosen forecast per series; a series only one of them covers takes that one."""
    both = best.withColumn("_from", F.lit("best")).unionByName(blended.withColumn("_from", F.lit("blend")), allowMissingColumns=True)
    have = both.groupBy("series_id").agg(F.min("_from").alias("_lo"), F.max("_from").alias("_hi"))
    picked = have.join(choice.select("series_id", "choice"), "series_id", "left").select(
        "series_id", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.coalesce("choice", F.lit("blend"))).alias("_pick")
    )
    return both.join(picked, "series_id").filter(F.col("_from") == F.col("_pick")).drop("_from", "_pick")


def day_factors(daily: DataFrame) -> DataFrame:
    """Per series and day of the month: typical level against the month's mean, over the last 180 rows.

    A series without a usable pattern has no rows.
    """
    keys = ["series_id"]
    tail = newest_first(daily.filter(F.col("y").isNotNull()).select("series_id", "ds", "y"), keys).filter("rn_desc <= 180")
    month = Window.partitionBy("series_id", F.trunc("ds", "MM"))
    rows = tail.withColumn("n", F.count("*").over(Window.partitionBy("series_id"))).withColumn("m", F.avg("y").over(month))
    rows = rows.filter((F.col("n") >= 45) & (F.abs("m") > 1e-9))
    per_day = rows.groupBy("series_id", F.dayofmonth("ds").alias("day")).agg(
        F.avg(F.col("y") / F.col("m")).alias("raw"), F.count("*").alias("samples")
    ).filter("samples >= 2")
    s = Window.partitionBy("series_id")
    scaled = per_day.select(
        "series_id", "day", "samples", F.count("*").over(s).alias("days"), F.avg("raw").over(s).alias("mean_raw"), "raw"
    ).filter((F.col("days") >= 10) & (F.abs("mean_raw") >= 1e-9))
    factor = F.greatest(F.lit(0.6), F.least(F.lit(1.4), F.col("raw") / F.col("mean_raw")))
    out = scaled.select("series_id", "day", factor.alias("factor"))
    return out.withColumn("strength", F.stddev_pop("factor").over(s)).filter("strength >= 0.03")


def apply_day_factors(forecast: DataFrame, factors: DataFrame, frequency: str = "D") -> DataFrame:
    """Scale a daily forecast by its day-of-month factors, keeping the mean of the factors at one."""
    if frequency_family(frequency) != "D":
        return forecast
    rows = forecast.filter(F.col("yhat").isNotNull()).withColumn("day", F.dayofmonth("ds"))
    keys = [k for k in ("model", "series_id") if k in forecast.columns]
    f = F.coalesce("factor", F.lit(1.0))
    mean = F.avg(f).over(Window.partitionBy(*keys))
    g = f / F.when(F.abs(mean) < 1e-9, F.lit(1.0)).otherwise(mean)
    joined = rows.join(factors.select("series_id", "day", "factor"), ["series_id", "day"], "left").withColumn("g", g)
    y = clip(F.col("yhat") * F.col("g"), 0.0)
    low, high = clip(F.col("yhat_lower") * F.col("g"), 0.0), clip(F.col("yhat_upper") * F.col("g"), 0.0)
    return joined.select(
        *[c for c in forecast.columns if c not in ("yhat", "yhat_lower", "yhat_upper")],
        y.alias("yhat"), F.when(low.isNotNull(), F.least(low, y)).alias("yhat_lower"),
        F.when(high.isNotNull(), F.greatest(high, y)).alias("yhat_upper"),
    )


def scenario_bands(forecast: DataFrame) -> DataFrame:
    """Conservative, expected and aggressive value per series and day, ordered and not negative."""
    e = clip("yhat", 0.0)
    low = F.coalesce(F.least(clip("yhat_lower", 0.0), e), e * 0.92)
    high = F.coalesce(F.greatest(clip("yhat_upper", 0.0), e), e * 1.08)
    low = F.when(F.col("yhat_lower").isNull(), e * 0.92).otherwise(low)
    high = F.when(F.col("yhat_upper").isNull(), e * 1.08).otherwise(high)
    return forecast.select(
        "series_id", "ds", F.round(low, 2).alias("conservative"), F.round(e, 2).alias("expected"), F.round(high, 2).alias("aggressive")
    )


def output_mode(forecast: DataFrame, mode: str = "scenario", rows: int | None = None) -> DataFrame:
    """``scenario`` bands, ``intervals`` or a ``single`` line; ``rows`` limits a preview."""
    if mode == "scenario":
        out = scenario_bands(forecast)
    elif mode == "intervals":
        out = forecast.select("series_id", "ds", "yhat", "yhat_lower", "yhat_upper")
    else:
        out = forecast.select("series_id", "ds", "yhat")
    return out.orderBy("series_id", "ds").limit(rows) if rows else out


def percentile_frame(forecast: DataFrame) -> DataFrame:
    """p10, p50 and p90 out of whatever bounds a forecast has."""
    have = set(forecast.columns)

    def first(*names: str) -> Column | None:
        found = [F.col(n) for n in names if n in have]
        return F.coalesce(*found) if found else None

    expected = first("expected", "yhat", "mean")
    low, high = first("conservative", "lower", "yhat_lower"), first("aggressive", "upper", "yhat_upper")
    p10 = expected * 0.92 if low is None else F.coalesce(low, expected * 0.92)
    p90 = expected * 1.08 if high is None else F.coalesce(high, expected * 1.08)
    keys = [c for c in ("series_id", "ds") if c in have]
    return forecast.select(*keys, p10.alias("p10"), expected.alias("p50"), p90.alias("p90"))
