"""One-step models: the training rows of a feature recipe, and forecasts that work every feature out again step by step.

Training features are window expressions over all folds and series at once.  A forecast starts from one state row per
fold and series (the last values of y and the helpers, running moments, the days ahead with what is known of them);
numpy advances the states of a batch together, so a step costs a few array operations however many series there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revcast.functions.frames import by_series
from revcast.functions.scalars import clip
from revcast.operators.baselines import KEYS, future_day
from revcast.operators.features import CALENDAR, PROFILE_WINDOWS, REGRESSORS, FeatureRecipe, build_features, feature_columns, regressor_lags, season_length
from revcast.schema import FLAG_COLUMNS

LEVEL_ROWS = 28
BATCH_ROWS = 500
GROWTH = ("growth_rate_1", "growth_rate_seasonal")
OUT = "fold int, series_id string, step int, ds date, yhat double"


class Predictor(Protocol):
    """A fitted model of one fold: ``names`` are its inputs, in the order of the matrix columns."""

    names: list[str]

    def predict(self, x: np.ndarray) -> np.ndarray: ...


def helpers_of(df: DataFrame) -> list[str]:
    return [c for c in REGRESSORS if c in df.columns]


def flags_of(df: DataFrame) -> list[str]:
    """The flag columns a model sees; three of them are there (as zeros) even if the table has none."""
    return [c for c in FLAG_COLUMNS if c in df.columns or c != "event_flag"]


def bounded_helpers(train: DataFrame, upper: float = 0.995) -> DataFrame:
    """Leads and cost from zero, all helpers up to their quantile in the fold's own history.

    The quantile is an element of the fold, by a mergeable sketch of rank accuracy 1e-5; the folds, nine at most, are
    broadcast.
    """
    helpers = helpers_of(train)
    if not helpers:
        return train
    floored = train.withColumns({c: clip(F.col(c).cast("double"), 0.0) if c != "roas" else F.col(c).cast("double") for c in helpers})
    tops = floored.groupBy("fold").agg(*[F.percentile_approx(c, upper, 100_000).alias(f"_top_{c}") for c in helpers])
    met = floored.join(F.broadcast(tops), "fold")
    bound = {c: F.when(F.col(f"_top_{c}").isNull(), F.col(c)).otherwise(clip(c, None, F.col(f"_top_{c}"))) for c in helpers}
    return met.select(*[bound[c].alias(c) if c in bound else F.col(f"`{c}`") for c in train.columns])


def model_rows(train: DataFrame, r: FeatureRecipe) -> DataFrame:
    """fold, series_id, ds, y and the recipe's inputs, one row per training day whose lags and windows of y are complete.

    What is unknown of the helpers, and growth from zero, counts as zero, as it does in a forecast; a helper's missing flag
    tells.  The flags of y's own lags would be zero in every complete row and are left out.
    """
    kept = [*KEYS, "ds", "y", *helpers_of(train), *[c for c in FLAG_COLUMNS if c in train.columns]]
    built = build_features(bounded_helpers(train.select(*kept)), replace(r, keys=KEYS, flags=False), bounded=False)
    names = [c for c in feature_columns(built, skip=("y", "fold", *helpers_of(train)))]
    loose = [c for c in names if c in GROWTH or c.startswith(REGRESSORS)]
    strict = [c for c in names if c not in loose]
    whole = built.where(F.col("y").isNotNull()).dropna(subset=strict)
    return whole.select(*KEYS, "ds", "y", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])


def recipe_inputs(r: FeatureRecipe, helpers: list[str], flags: list[str]) -> list[str]:
    """The names of the inputs that ``model_rows`` gives for a table with these helper and flag columns."""
    season, windows = season_length(r.frequency), PROFILE_WINDOWS[r.profile]
    names = [*CALENDAR, *[f"lag_{k}" for k in r.lags], *[f"rolling_{n}_{k}" for k in r.windows for n in ("mean", "std")]]
    if r.memory:
        names += ["lag_weighted_recent", "lag_weighted_extended", "trend_vs_7d_avg", "trend_vs_28d_avg"]
    for c in helpers:
        names += [f"{c}_is_missing", f"{c}_filled", *[f"{c}_lag_{k}" for k in regressor_lags(r.profile, season)]]
        names += [f"{c}_roll_{n}_{k}" for k in windows for n in ("mean", "std", "sum")] + [f"{c}_trend_1v7"]
        names += [f"{c}_trend_7v28"] if 28 in windows else []
    names += [f"{c}_nonzero" for c in helpers if c != "roas"]
    for f in dict.fromkeys([*flags, "outage_flag", "promo_flag", "holiday_flag"]):
        names += [f, *[f"{f}_x_{c}" for c in helpers if c != "roas"], f"{f}_x_lag1"]
    return names + ["days_from_series_start", "series_age_frac", "expanding_mean", "expanding_std", "seasonal_diff_1", *GROWTH]


def reach(r: FeatureRecipe) -> int:
    """Rows of history that a step can look back."""
    season = season_length(r.frequency)
    return max(*r.lags, *r.windows, *PROFILE_WINDOWS[r.profile], *regressor_lags(r.profile, season), season + 1, LEVEL_ROWS)


def states(train: DataFrame, r: FeatureRecipe, horizon: int, future: DataFrame | None = None) -> DataFrame:
    """One row per fold and series: what the first step needs, and the days ahead with helpers and flags.

    ``future`` (series_id, ds and any helper or flag) is what the user knows of coming days; a helper it does not give keeps
    its mean of the last 28 rows.  Flags of days that lie ahead of a fold but within the table are taken from the table,
    since a calendar of events is known beforehand; others are zero.
    """
    helpers, flags = helpers_of(train), [c for c in FLAG_COLUMNS if c in train.columns]
    bounded = bounded_helpers(train.select(*KEYS, "ds", "y", *helpers))
    rn = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("ds").desc()))
    keep = reach(r)
    recent = F.col("rn") <= keep
    tail = F.sort_array(F.collect_list(F.when(recent, F.struct("ds", "y", *helpers))))

    def of(c: str) -> Column:
        return F.transform("tail", lambda x: F.coalesce(x[c].cast("double"), F.lit(float("nan")))).alias(f"tail_{c}")

    level = [F.avg(F.when(F.col("rn") <= LEVEL_ROWS, F.col(c))).alias(f"level_{c}") for c in helpers]
    ends = bounded.withColumn("rn", rn).groupBy(*KEYS).agg(
        F.max("ds").alias("last_ds"), F.count(F.lit(1)).alias("n"), F.count("y").alias("y_n"), F.avg("y").alias("y_mean"),
        F.coalesce(F.var_pop("y") * F.count("y"), F.lit(0.0)).alias("y_m2"), tail.alias("tail"), *level,
    )
    steps = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: future_day(F.col("last_ds"), k, r.frequency))
    ends = ends.select(*KEYS, "n", "y_n", "y_mean", "y_m2", *[of(c) for c in ("y", *helpers)], *[f"level_{c}" for c in helpers], steps.alias("days"))
    given = [c for c in (*helpers, *FLAG_COLUMNS) if future is not None and c in future.columns]
    ahead = [*dict.fromkeys([*flags, *given])]
    if ahead:
        seen = train.where("fold = 0").select("series_id", "ds", *flags)
        if given:
            told = future.select("series_id", "ds", *[F.col(c).cast("double").alias(f"given_{c}") for c in given])
            seen = seen.join(told, ["series_id", "ds"], "full")
        values = {c: F.coalesce(*[F.col(x).cast("double") for x in (f"given_{c}" if c in given else None, c if c in flags else None) if x]) for c in ahead}
        seen = seen.select("series_id", "ds", *[v.alias(f"known_{c}") for c, v in values.items()])
        days = ends.select(*KEYS, F.explode("days").alias("ds")).join(seen, ["series_id", "ds"], "left")
        listed = days.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("ds", *[f"known_{c}" for c in ahead]))).alias("known"))
        ends = ends.join(listed, list(KEYS))

        def filled(c: str) -> Column:
            rest = F.col(f"level_{c}") if c in helpers else F.lit(0.0)
            return F.transform("known", lambda x: F.coalesce(x[f"known_{c}"], rest, F.lit(float("nan"))))

        ends = ends.withColumns({f"ahead_{c}": filled(c) for c in ahead}).drop("known")
    rest = {f"ahead_{c}": F.array_repeat(F.coalesce(f"level_{c}", F.lit(float("nan"))), horizon) for c in helpers if c not in given}
    return ends.withColumns(rest).drop(*[f"level_{c}" for c in helpers])


def _matrix(column, width: int) -> np.ndarray:
    """Lists of numbers, set against the right edge of a matrix that is NaN elsewhere."""
    out = np.full((len(column), width), np.nan)
    for k, values in enumerate(column.to_pylist()):
        own = values[-width:] if values else []
        out[k, width - len(own) :] = own
    return out


class Stepper:
    """The features of the next step of a batch of series, by recipe, and the state after it."""

    def __init__(self, batch: pa.RecordBatch, r: FeatureRecipe, horizon: int):
        names = batch.schema.names
        width = reach(r)
        self.r, self.at = r, 0
        self.tails = {c.removeprefix("tail_"): _matrix(batch.column(c), width) for c in names if c.startswith("tail_")}
        self.ahead = {c.removeprefix("ahead_"): _matrix(batch.column(c), horizon) for c in names if c.startswith("ahead_")}
        days = np.array([[x.toordinal() for x in d] for d in batch.column("days").to_pylist()], dtype=np.int64).reshape(batch.num_rows, horizon)
        self.days = (days - 719163).astype("datetime64[D]")
        self.n, self.seen, self.mean, self.m2 = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), dtype=float) for c in ("n", "y_n", "y_mean", "y_m2"))
        self.mean = np.nan_to_num(self.mean)

    def _window(self, c: str, rows: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean, sample deviation and sum of the last rows; NaN where too few are known."""
        part = self.tails[c][:, -rows:]
        known = ~np.isnan(part)
        count = known.sum(axis=1).astype(float)
        total = np.where(known, part, 0.0).sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = total / count
            spread = np.sqrt(np.where(known, part - mean[:, None], 0.0).__pow__(2).sum(axis=1) / (count - 1))
        enough = count >= least
        return np.where(enough, mean, np.nan), np.where(enough & (count > 1), spread, np.nan), np.where(enough, total, np.nan)

    def _calendar(self) -> dict[str, np.ndarray]:
        day = self.days[:, self.at]
        month = day.astype("datetime64[M]")
        year = day.astype("datetime64[Y]")
        number = day.astype(np.int64)
        dow, doy = (number + 3) % 7, (day - year.astype("datetime64[D]")).astype(np.int64) + 1
        m = month.astype(np.int64) % 12 + 1
        dom = (day - month.astype("datetime64[D]")).astype(np.int64) + 1
        last = (month + 1).astype("datetime64[D]") - 1
        thursday = day - dow + 3
        first = thursday.astype("datetime64[Y]").astype("datetime64[D]")
        turn = 2 * np.pi
        month_end, quarter_month = day == last, (m - 1) % 3
        return {
            "day_of_week": dow, "day_of_month": dom, "day_of_year": doy, "week_of_year": (thursday - first).astype(np.int64) // 7 + 1, "month": m,
            "quarter": (m - 1) // 3 + 1, "year": year.astype(np.int64) + 1970, "is_weekend": dow >= 5, "is_month_end": month_end, "is_month_start": dom == 1,
            "is_quarter_end": month_end & (quarter_month == 2), "is_quarter_start": (dom == 1) & (quarter_month == 0),
            "dow_sin": np.sin(turn * dow / 7.0), "dow_cos": np.cos(turn * dow / 7.0), "month_sin": np.sin(turn * m / 12.0), "month_cos": np.cos(turn * m / 12.0),
            "doy_sin": np.sin(turn * doy / 365.25), "doy_cos": np.cos(turn * doy / 365.25),
        }

    def features(self) -> dict[str, np.ndarray]:
        r, y = self.r, self.tails["y"]
        season = season_length(r.frequency)
        rows = len(y)

        def back(c: str, k: int) -> np.ndarray:
            return self.tails[c][:, -k]

        out = self._calendar()
        out |= {f"lag_{k}": back("y", k) for k in r.lags}
        for k in r.windows:
            out[f"rolling_mean_{k}"], out[f"rolling_std_{k}"], _ = self._window("y", k, k)
        if r.memory:
            for name, shares in (("recent", {1: 0.5, 2: 0.3, 7: 0.2}), ("extended", {1: 0.35, 7: 0.25, 14: 0.2, 28: 0.2})):
                out[f"lag_weighted_{name}"] = sum(np.nan_to_num(back("y", k)) * share for k, share in shares.items())
            for k in (7, 28):
                out[f"trend_vs_{k}d_avg"] = back("y", 1) - self._window("y", k, k)[0]
        lag_1 = np.nan_to_num(back("y", 1)) if 1 in r.lags else np.zeros(rows)
        flags = {f: np.nan_to_num(self.ahead[f][:, self.at]) if f in self.ahead else np.zeros(rows) for f in FLAG_COLUMNS}
        windows = PROFILE_WINDOWS[r.profile]
        now = {c: self.ahead[c][:, self.at] for c in REGRESSORS if c in self.tails}
        for c, value in now.items():
            out[f"{c}_is_missing"], out[f"{c}_filled"] = np.isnan(value), np.nan_to_num(value)
            out |= {f"{c}_lag_{k}": back(c, k) for k in regressor_lags(r.profile, season)}
            for k in windows:
                out[f"{c}_roll_mean_{k}"], out[f"{c}_roll_std_{k}"], out[f"{c}_roll_sum_{k}"] = self._window(c, k, 3)
            week, four = self._window(c, 7, 3)[0], self._window(c, 28, 3)[0]
            out[f"{c}_trend_1v7"], out[f"{c}_trend_7v28"] = back(c, 1) - week, week - four
            if c != "roas":
                out[f"{c}_nonzero"] = np.nan_to_num(value) > 0
        for f, value in flags.items():
            out[f] = value
            out |= {f"{f}_x_{c}": value * np.nan_to_num(now[c]) for c in ("cost", "leads") if c in now}
            out[f"{f}_x_lag1"] = value * lag_1
        with np.errstate(invalid="ignore", divide="ignore"):
            out["days_from_series_start"], out["series_age_frac"] = self.n, self.n / np.maximum(self.n, 1)
            out["expanding_mean"] = np.where(self.seen >= 2, self.mean, np.nan)
            out["expanding_std"] = np.where(self.seen >= 2, np.sqrt(self.m2 / np.maximum(self.seen - 1, 1)), np.nan)
            last, before, past = back("y", 1), back("y", 2), back("y", season + 1)
            out["seasonal_diff_1"] = last - past
            out["growth_rate_1"] = np.where(before != 0, (last - before) / before, np.nan)
            out["growth_rate_seasonal"] = np.where(past != 0, (last - past) / past, np.nan)
        return out

    def advance(self, y: np.ndarray) -> None:
        """Take ``y`` as the value of the step; the helpers of the step become history too."""
        for c, tail in self.tails.items():
            value = y if c == "y" else self.ahead[c][:, self.at]
            self.tails[c] = np.concatenate([tail[:, 1:], value[:, None]], axis=1)
        self.n = self.n + 1
        known = ~np.isnan(y)
        self.seen = self.seen + known
        delta = np.where(known, y - self.mean, 0.0)
        self.mean = self.mean + delta / np.maximum(self.seen, 1)
        self.m2 = self.m2 + delta * np.where(known, y - self.mean, 0.0)
        self.at += 1


def forecast(starts: DataFrame, r: FeatureRecipe, horizon: int, fitted: dict[int, Predictor]) -> DataFrame:
    """fold, series_id, step, ds, yhat of the folds that have a model; values are not below zero.

    Features that are still unknown count as zero, as in training.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(low, BATCH_ROWS)
                folds = np.array(batch.column("fold").to_pylist())
                stepper = Stepper(batch, r, horizon)
                path = np.zeros((batch.num_rows, horizon))
                for k in range(horizon):
                    values = stepper.features()
                    for fold in np.unique(folds):
                        own = folds == fold
                        model = fitted[int(fold)]
                        x = np.column_stack([np.nan_to_num(np.asarray(values[n], dtype=float)[own], posinf=0.0, neginf=0.0) for n in model.names])
                        path[own, k] = np.maximum(model.predict(x), 0.0)
                    stepper.advance(path[:, k])
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(folds, horizon), pa.int32()), batch.column("series_id").take(pa.array(np.repeat(np.arange(len(folds)), horizon))),
                        pa.array(np.tile(np.arange(1, horizon + 1), len(folds)), pa.int32()), pa.array(stepper.days.reshape(-1)), pa.array(path.reshape(-1)),
                    ],
                    names=["fold", "series_id", "step", "ds", "yhat"],
                )

    return starts.where(F.col("fold").isin(*fitted)).mapInArrow(run, OUT)


def banded(path: DataFrame, model: str, band: float) -> DataFrame:
    """Forecast rows with bounds a fixed share around the value."""
    return path.select(
        F.lit(model).alias("model"), *KEYS, "step", "ds", "yhat",
        (F.col("yhat") * (1 - band)).alias("yhat_lower"), (F.col("yhat") * (1 + band)).alias("yhat_upper"),
    )
