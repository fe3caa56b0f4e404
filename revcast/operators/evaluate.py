"""Backtest folds, error metrics, ranking inputs.

All folds live in one frame with a ``fold`` column, so a closed-form model runs
every fold and every series in one job.  Fold 0 is the final fit on everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revcast.operators.features import SEASON, season_length

# Folds per tuning depth, shortest training history per cadence, level of the intervals.
FOLDS = {"fast": 3, "balanced": 5, "aggressive": 8}
MIN_TRAIN = {"D": 60, "W": 52, "M": 18}
INTERVAL_LEVEL = 0.8
EPS = 1e-9


def frequency_family(frequency: str | None) -> str:
    code = (frequency or "D").upper()[:1]
    return code if code in SEASON else "D"


def horizon_periods(horizon: str, frequency: str) -> int:
    """``30D``, ``12M`` -> number of periods of the cadence."""
    family, unit = frequency_family(frequency), horizon[-1:]
    if unit not in ("D", "M"):
        return 30
    n = int(horizon[:-1])
    if unit == "D":
        return {"D": n, "W": max(1, n // 7), "M": max(1, n // 30)}[family]
    return {"D": n * 30, "W": n * 4, "M": n}[family]


def horizon_label(horizon: int, frequency: str) -> str:
    """Number chosen by the user -> label; 12 means a year by day or month and 12 weeks by week."""
    family = frequency_family(frequency)
    if horizon == 12:
        return {"M": "12M", "W": "84D", "D": "365D"}[family]
    return {"M": f"{horizon}M", "W": f"{horizon * 7}D", "D": f"{horizon}D"}[family]


def make_folds(daily: DataFrame, horizon: int, frequency: str = "D", depth: str = "balanced") -> DataFrame:
    """Rows fold, train_end, test_start, test_end: expanding windows, evenly picked if there are many."""
    days = daily.select("ds").distinct()
    one = Window.partitionBy(F.lit(1))
    w = one.orderBy("ds")
    numbered = days.select(
        (F.row_number().over(w) - 1).alias("i"),
        F.count("*").over(one).alias("n"),
        F.col("ds").alias("train_end"),
        F.lead("ds", 1).over(w).alias("test_start"),
        F.lead("ds", horizon).over(w).alias("test_end"),
    )
    family = frequency_family(frequency)
    least = F.least(F.lit(MIN_TRAIN[family]), F.greatest(F.lit(10), F.col("n") - 1))
    splits = F.col("n") - horizon - least + 1
    wanted = FOLDS.get(depth, FOLDS["balanced"])
    step = (splits - 1) / F.lit(float(wanted - 1))
    picks = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda j: F.floor(j * step))
    position = F.col("i") - (least - 1)
    inside = (position >= 0) & (position < splits)
    fold = F.when(splits <= wanted, position + 1).otherwise(F.array_position(picks, position.cast("long")))
    return (
        numbered.filter(inside)
        .select(fold.cast("int").alias("fold"), "train_end", "test_start", "test_end")
        .filter("fold > 0")
    )


def with_final_fold(folds: DataFrame, daily: DataFrame) -> DataFrame:
    last = daily.agg(F.max("ds").alias("train_end")).select(
        F.lit(0).alias("fold"), "train_end", F.lit(None).cast("date").alias("test_start"), F.lit(None).cast("date").alias("test_end")
    )
    return folds.unionByName(last)


def training_rows(daily: DataFrame, folds: DataFrame) -> DataFrame:
    """Every fold's history; the fold table has at most nine rows."""
    return daily.join(F.broadcast(folds.select("fold", "train_end")), F.col("ds") <= F.col("train_end")).drop("train_end")


def test_rows(daily: DataFrame, folds: DataFrame) -> DataFrame:
    f = folds.filter(F.col("test_start").isNotNull()).select("fold", "test_start", "test_end")
    return daily.select("series_id", "ds", "y").join(
        F.broadcast(f), F.col("ds").between(F.col("test_start"), F.col("test_end"))
    ).drop("test_start", "test_end")


def align_predictions(test: DataFrame, predictions: DataFrame) -> DataFrame:
    """Actuals of each fold beside every model's prediction, null where a model has none."""
    models = predictions.select("model").distinct()
    cells = test.crossJoin(F.broadcast(models))
    keys = ["model", "fold", "series_id", "ds"]
    return cells.join(predictions.select(*keys, "yhat", "yhat_lower", "yhat_upper"), keys, "left")


def regression_metrics(aligned: DataFrame, keys: tuple[str, ...] = ("model", "fold")) -> DataFrame:
    """Errors per key over the rows that have both values; interval measures over those with bounds."""
    def usable(c: str):
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    err = F.abs(F.col("y") - F.col("yhat"))
    bounded = usable("yhat_lower") & usable("yhat_upper")
    covered = F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")).cast("double")
    width = F.greatest(F.col("yhat_upper") - F.col("yhat_lower"), F.lit(0.0))
    out = (
        aligned.filter(usable("y") & usable("yhat"))
        .groupBy(*keys)
        .agg(
            F.avg(err).alias("mae"),
            F.sqrt(F.avg(err * err)).alias("rmse"),
            F.avg(2 * err / (F.abs("y") + F.abs("yhat") + EPS)).alias("smape"),
            F.avg(err / (F.abs("y") + EPS)).alias("mape"),
            (F.sum(err) / (F.sum(F.abs("y")) + EPS)).alias("wape"),
            F.avg(F.col("yhat") - F.col("y")).alias("bias"),
            F.avg("y").alias("mean_actual"),
            F.avg("yhat").alias("mean_forecast"),
            F.count("*").alias("n_obs"),
            F.avg(F.when(bounded, covered)).alias("interval_coverage"),
            F.avg(F.when(bounded, width)).alias("interval_width"),
            F.avg(F.when(bounded, F.abs("y"))).alias("_level"),
        )
    )
    score = F.abs(F.col("interval_coverage") - INTERVAL_LEVEL) + 0.1 * F.col("interval_width") / (F.col("_level") + EPS)
    return out.withColumn("interval_score", score).drop("_level")


def summarize_folds(fold_metrics: DataFrame) -> DataFrame:
    """One row per model: mean errors, error of the latest fold, spread of the error over folds."""
    names = ["mae", "rmse", "smape", "mape", "wape", "bias", "interval_coverage", "interval_width", "interval_score"]
    overall = (F.col("mae") + F.col("rmse") + F.col("smape") + F.col("wape")) / 4
    return fold_metrics.groupBy("model").agg(
        *[F.avg(n).alias(n) for n in names],
        F.max_by("wape", "fold").alias("recent_accuracy"),
        F.stddev_pop("wape").alias("stability"),
        F.avg(overall).alias("overall_score"),
        F.count("*").alias("n_folds"),
    )


def backtest_metrics(daily: DataFrame, folds: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per fold, per model) metrics of the predictions of all folds but the final one."""
    aligned = test_rows(daily, folds).join(
        predictions.filter("fold > 0").select("model", "fold", "series_id", "ds", "yhat", "yhat_lower", "yhat_upper"),
        ["fold", "series_id", "ds"],
    )
    per_fold = regression_metrics(aligned)
    return per_fold, summarize_folds(per_fold)


def default_intervals(forecast: DataFrame, pct: float = 0.08) -> DataFrame:
    return forecast.withColumn("yhat_lower", F.col("yhat") * (1 - pct)).withColumn("yhat_upper", F.col("yhat") * (1 + pct))


