"""Time-series features. Input is a daily frame: one row per series and day.

Lags count rows within the series.  Frames only see earlier rows, so a feature
never holds the value it helps to predict.  Each family is one ``select``, which
keeps the plan to a single window stage per partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revcast.functions.frames import by_series, expanding, rolling
from revcast.functions.scalars import clip, safe_divide
from revcast.operators.clean import winsorise
from revcast.schema import COMPANY, FLAG_COLUMNS

SEASON = {"D": 7, "W": 52, "M": 12}
EPS = 1e-6
REGRESSORS = ("leads", "cost", "roas")
CALENDAR = (
    "day_of_week", "day_of_month", "day_of_year", "week_of_year", "month", "quarter", "year", "is_weekend", "is_month_end", "is_month_start",
    "is_quarter_end", "is_quarter_start", "dow_sin", "dow_cos", "month_sin", "month_cos", "doy_sin", "doy_cos",
)

# Windows of the regressor profiles; their lags are those of ``regressor_lags``.
PROFILE_WINDOWS = {"compact": [3, 7], "balanced": [3, 7, 14, 28], "extended": [3, 7, 14, 28, 56, 84]}


def season_length(frequency: str) -> int:
    return SEASON.get(frequency.upper()[:1], 7)


def _add(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in columns.items()])


def calendar_columns(day: str | Column = "ds") -> dict[str, Column]:
    d = F.col(day) if isinstance(day, str) else day
    dow, doy, month = F.weekday(d), F.dayofyear(d), F.month(d)
    turn = 2 * F.pi()
    quarter_start = F.to_date(F.trunc(d, "QUARTER"))
    return {
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(d),
        "day_of_year": doy,
        "week_of_year": F.weekofyear(d),
        "month": month,
        "quarter": F.quarter(d),
        "year": F.year(d),
        "is_weekend": (dow >= 5).cast("int"),
        "is_month_end": (d == F.last_day(d)).cast("int"),
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "is_quarter_end": (d == F.date_sub(F.add_months(quarter_start, 3), 1)).cast("int"),
        "is_quarter_start": (d == quarter_start).cast("int"),
        "dow_sin": F.sin(turn * dow / 7.0),
        "dow_cos": F.cos(turn * dow / 7.0),
        "month_sin": F.sin(turn * month / 12.0),
        "month_cos": F.cos(turn * month / 12.0),
        "doy_sin": F.sin(turn * doy / 365.25),
        "doy_cos": F.cos(turn * doy / 365.25),
    }


def add_calendar(df: DataFrame) -> DataFrame:
    return _add(df, calendar_columns())


def add_lags(df: DataFrame, lags: Sequence[int] = (1, 7, 14, 28), keys: Sequence[str] = ("series_id",)) -> DataFrame:
    w = by_series(*keys)
    return _add(df, {f"lag_{k}": F.lag("y", k).over(w) for k in lags})


def add_rolling(df: DataFrame, windows: Sequence[int] = (7, 14, 28), keys: Sequence[str] = ("series_id",)) -> DataFrame:
    w = by_series(*keys)
    out = {}
    for k in windows:
        out[f"rolling_mean_{k}"] = rolling("y", w, k, "avg")
        out[f"rolling_std_{k}"] = rolling("y", w, k, "stddev_samp")
    return _add(df, out)


def ensure_event_columns(df: DataFrame) -> DataFrame:
    return _add(df, {c: F.lit(0) for c in ("outage_flag", "promo_flag", "holiday_flag") if c not in df.columns})


def add_hierarchy(df: DataFrame) -> DataFrame:
    return _add(df, {"top_level": F.lit(COMPANY), "bottom_level": F.col("series_id")})


def hierarchy_totals(df: DataFrame) -> DataFrame:
    """Bottom series and the company's total per day out of one roll-up."""
    return (
        df.rollup("ds", "series_id")
        .agg(F.sum("y").alias("y"), F.grouping_id().alias("_g"))
        .filter("_g < 2")
        .select("ds", F.when(F.col("_g") == 1, F.lit(COMPANY)).otherwise(F.col("series_id")).alias("series_id"), "y")
    )


def regressor_lags(profile: str, season: int) -> list[int]:
    # fixed values
    profiles = {
        "compact": [1, 2, 3, season],
        "balanced": [1, 2, 3, 7, 14, season],
        "extended": [1, 2, 3, 7, 14, 21, 28, season, 2 * season],
    }
    return sorted(set(profiles.get(profile, profiles["balanced"])))


def add_regressor_features(
    df: DataFrame, frequency: str = "D", profile: str = "balanced", keys: Sequence[str] = ("series_id",), bounded: bool = True
) -> DataFrame:
    """Missing flags, lags and past-window statistics of leads, cost and roas, which ``bounded`` winsorises first."""
    present = [c for c in REGRESSORS if c in df.columns]
    if bounded:
        df = winsorise(df, present, floors=[c for c in present if c != "roas"])
    w = by_series(*keys)
    lags = regressor_lags(profile, season_length(frequency))
    windows = PROFILE_WINDOWS.get(profile, PROFILE_WINDOWS["balanced"])
    out = {}
    for c in present:
        out[f"{c}_is_missing"] = F.col(c).isNull().cast("int")
        out[f"{c}_filled"] = F.coalesce(c, F.lit(0.0))
        for k in lags:
            out[f"{c}_lag_{k}"] = F.lag(c, k).over(w)
        for k in windows:
            least = max(2, min(k, 3))
            out[f"{c}_roll_mean_{k}"] = rolling(c, w, k, "avg", least)
            out[f"{c}_roll_std_{k}"] = rolling(c, w, k, "stddev_samp", least)
            out[f"{c}_roll_sum_{k}"] = rolling(c, w, k, "sum", least)
        week, four = rolling(c, w, 7, "avg", 3), rolling(c, w, 28, "avg", 3)
        out[f"{c}_trend_1v7"] = F.lag(c, 1).over(w) - week
        if 28 in windows:
            out[f"{c}_trend_7v28"] = week - four
    for c in ("leads", "cost"):
        if c in present:
            out[f"{c}_nonzero"] = (F.coalesce(c, F.lit(0.0)) > 0).cast("int")
    return _add(df, out)


def add_ewm(
    df: DataFrame, columns: Sequence[str] = REGRESSORS, spans: Sequence[int] = (7, 28), keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """Exponentially weighted mean of the earlier rows.

    A fold over the rows of a series in order; a series has at most one row per
    day, so its array stays small however many transactions it came from.  A
    missing value keeps the mean and lets its weight decay.
    """
    present = [c for c in columns if c in df.columns]
    names = df.columns
    rows = F.sort_array(F.collect_list(F.struct("ds", F.struct(*names).alias("row"))))
    series = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(rows.alias("_rows"))
    none = F.lit(None).cast("double")

    def folded(c: str, span: int) -> Column:
        alpha = 2.0 / (span + 1)

        def step(acc: Column, e: Column) -> Column:
            x, mean = acc["last"], acc["mean"]
            known, seen = mean.isNotNull(), x.isNotNull()
            weight = F.when(known, acc["weight"] * (1 - alpha)).otherwise(acc["weight"])
            now = F.when(known & seen, (weight * mean + alpha * x) / (weight + alpha)).when(known, mean).otherwise(x)
            return F.struct(
                e["row"][c].cast("double").alias("last"), now.alias("mean"),
                F.when(known & seen, F.lit(1.0)).otherwise(weight).alias("weight"), F.concat(acc["out"], F.array(now)).alias("out"),
            )

        start = F.struct(none.alias("last"), none.alias("mean"), F.lit(1.0).alias("weight"), F.array().cast("array<double>").alias("out"))
        return F.aggregate("_rows", start, step, lambda acc: acc["out"])

    folds = {f"{c}_ewm_{s}": folded(c, s) for c in present for s in spans}
    placed = series.select("_rows", *[v.alias(n) for n, v in folds.items()])
    each = placed.select(F.posexplode("_rows").alias("_at", "_row"), *folds)
    return each.select(
        *[F.col("_row")["row"][n].alias(n) for n in names], *[F.get(n, F.col("_at")).alias(n) for n in folds]
    )


def add_ratios(df: DataFrame) -> DataFrame:
    """Revenue per lead, margin, ROAS, cost per lead and products, bounded at their upper quantile."""
    have = set(df.columns)

    def over(num: Column, den: str) -> Column:
        positive = F.when(F.col(den) != 0, F.col(den))
        return num / (positive + EPS)

    out: dict[str, Column] = {}
    bounded = []
    if "leads" in have:
        out["rev_per_lead"] = over(F.col("y"), "leads")
        out["log_leads"] = F.log1p(clip("leads", 0.0))
        bounded.append("rev_per_lead")
    if "cost" in have:
        out["margin_after_cost"] = F.col("y") - F.col("cost")
        out["roas_calc"] = over(F.col("y"), "cost")
        out["log_cost"] = F.log1p(clip("cost", 0.0))
        bounded.append("roas_calc")
    if {"leads", "cost"} <= have:
        out["cost_per_lead"] = over(F.col("cost"), "leads")
        out["leads_x_cost"] = F.coalesce("leads", F.lit(0.0)) * F.coalesce("cost", F.lit(0.0))
        bounded += ["cost_per_lead", "leads_x_cost"]
    return winsorise(_add(df, out), bounded, floors=bounded)


def add_event_interactions(df: DataFrame) -> DataFrame:
    out = {}
    zero = F.lit(0.0)
    flags = [f for f in FLAG_COLUMNS if f in df.columns]
    df = df.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in flags else F.col(c) for c in df.columns])
    for f in flags:
        for c in ("cost", "leads"):
            if c in df.columns:
                out[f"{f}_x_{c}"] = F.col(f) * F.coalesce(c, zero)
        out[f"{f}_x_lag1"] = F.col(f) * (F.coalesce("lag_1", zero) if "lag_1" in df.columns else zero)
    return _add(df, out)


def add_series_shape(df: DataFrame, frequency: str = "D", keys: Sequence[str] = ("series_id",), shift: int = 0) -> DataFrame:
    """Age of the series, expanding statistics, seasonal difference and growth.

    Difference and growth use the row's own value; training recipes pass
    ``shift=1`` so that they look one row back instead.
    """
    w = by_series(*keys)
    whole = Window.partitionBy(*keys)
    season = season_length(frequency)
    index = F.row_number().over(w) - 1
    y0 = F.lag("y", shift).over(w) if shift else F.col("y")
    prev, past = F.lag("y", 1 + shift).over(w), F.lag("y", season + shift).over(w)
    return _add(
        df,
        {
            "days_from_series_start": index,
            "series_age_frac": index / F.greatest(F.count("*").over(whole) - 1, F.lit(1)),
            "expanding_mean": expanding("y", w, "avg", 2),
            "expanding_std": expanding("y", w, "stddev_samp", 2),
            "seasonal_diff_1": y0 - past,
            "growth_rate_1": safe_divide(y0 - prev, prev),
            "growth_rate_seasonal": safe_divide(y0 - past, past),
        },
    )


def add_recent_memory(df: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Weighted means of chosen lags, and the last value against its week and four weeks."""
    w = by_series(*keys)

    def mix(weights: dict[int, float]) -> Column:
        total = F.lit(0.0)
        for k, share in weights.items():
            total = total + F.coalesce(F.lag("y", k).over(w), F.lit(0.0)) * share
        return total

    last = F.lag("y", 1).over(w)
    return _add(
        df,
        {
            "lag_weighted_recent": mix({1: 0.5, 2: 0.3, 7: 0.2}),
            "lag_weighted_extended": mix({1: 0.35, 7: 0.25, 14: 0.2, 28: 0.2}),
            "trend_vs_7d_avg": last - rolling("y", w, 7, "avg"),
            "trend_vs_28d_avg": last - rolling("y", w, 28, "avg"),
        },
    )


def add_missing_flags(df: DataFrame, skip: Sequence[str] = ("y",)) -> DataFrame:
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    return _add(df, {f"{c}_missing_flag": F.col(c).isNull().cast("int") for c in numeric})


@dataclass(frozen=True)
class FeatureRecipe:
    """What a model sees: lags and windows of y, regressor profile, memory and missing flags."""

    lags: tuple[int, ...]
    windows: tuple[int, ...]
    profile: str = "balanced"
    memory: bool = False
    flags: bool = False
    frequency: str = "D"
    keys: tuple[str, ...] = field(default=("series_id",))


def recipe(model: str, frequency: str = "D", lag_profile: str | None = None) -> FeatureRecipe:
    """Recipe of a model; ``lag_profile`` short, standard or long turns the long memory on."""
    season = season_length(frequency)
    if model in ("ridge", "elasticnet", "linear"):
        lags = {1, 2, 3, 5, 7, 14, 21, season} if lag_profile else {1, 2, 3, 7, season}
        return FeatureRecipe(tuple(sorted(lags)), (7, 14, 28), frequency=frequency)
    if model == "random_forest":
        lags = {1, 2, 3, 7, 14, season, season * 2} | ({21, 28, 42, 56} if lag_profile else set())
        windows = (7, 14, 28, 56) if lag_profile else (7, 14, 28)
        return FeatureRecipe(tuple(sorted(lags)), windows, "extended" if lag_profile else "balanced", False, True, frequency)
    lags, windows = {1, 3, season, season * 2}, (3, 7, 14, 28)
    if lag_profile:
        extra = {
            "short": {2, 3, 5, 7, 14},
            "standard": {2, 3, 5, 7, 14, 21, 28},
            "long": {2, 3, 5, 7, 14, 21, 28, 42, 56},
        }
        lags |= extra.get(lag_profile, extra["standard"])
        windows = {"short": (3, 7, 14), "long": (3, 7, 14, 28, 56, 84)}.get(lag_profile, windows)
    boosted = model == "gradient_boosting" and bool(lag_profile)
    return FeatureRecipe(tuple(sorted(lags)), windows, "extended" if lag_profile else "balanced", boosted, True, frequency)


def build_features(df: DataFrame, r: FeatureRecipe, leak_free: bool = True, bounded: bool = True) -> DataFrame:
    """All features of a recipe; ``leak_free`` shifts those that would show the row's own value."""
    out = add_rolling(add_lags(add_calendar(df), r.lags, r.keys), r.windows, r.keys)
    if r.memory:
        out = add_recent_memory(out, r.keys)
    out = add_regressor_features(ensure_event_columns(out), r.frequency, r.profile, r.keys, bounded)
    out = add_event_interactions(out)
    out = add_series_shape(out, r.frequency, r.keys, shift=1 if leak_free else 0)
    return add_missing_flags(out) if r.flags else out


def feature_columns(df: DataFrame, skip: Sequence[str] = ("y",)) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def smooth(df: DataFrame, columns: Sequence[str], rows: int, keys: Sequence[str] = (), suffix: str = "") -> DataFrame:
    """Mean over the current and the earlier ``rows - 1`` rows, however few there are."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    w = part.orderBy("ds").rowsBetween(-(rows - 1), 0)
    smoothed = {f"{c}{suffix}": F.avg(c).over(w) for c in columns}
    if suffix:
        return _add(df, smoothed)
    return df.select(*[smoothed[c].alias(c) if c in smoothed else F.col(c) for c in df.columns])


def risk_bands(forecast: DataFrame, frequency: str = "D") -> DataFrame:
    """Ordered, non-negative and smoothed bands for display: 7 rows by day, 2 by week, 1 by month."""
    rows = {"D": 7, "W": 2}.get(frequency.upper()[:1], 1)
    e = clip("expected", 0.0)
    ordered = forecast.select(
        *[c for c in forecast.columns if c not in ("conservative", "expected", "aggressive")],
        F.least(clip("conservative", 0.0), e).alias("conservative"),
        e.alias("expected"),
        F.greatest(clip("aggressive", 0.0), e).alias("aggressive"),
    )
    keys = [c for c in ("series_id",) if c in forecast.columns]
    return smooth(ordered, ["conservative", "expected", "aggressive"], rows, keys) if rows > 1 else ordered
