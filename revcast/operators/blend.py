"""Scoring, ranking and blending of models. Inputs are metric and forecast tables, a few rows per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revcast.operators.quality import history_stats

# Weight of each metric in the balanced score.
SCORE_WEIGHTS = {
    "recent_accuracy": 0.30,
    "wape": 0.20,
    "mae": 0.15,
    "rmse": 0.10,
    "smape": 0.10,
    "bias_abs": 0.05,
    "stability": 0.05,
    "interval_score": 0.05,
}
PREFERENCES = {"mae": "mae", "rmse": "rmse", "smape": "smape", "bias": "bias_abs", "recent_accuracy": "recent_accuracy"}
TOP = 3


def score_models(metrics: DataFrame) -> DataFrame:
    """Each metric scaled to 0..1 over the models (1 where all agree), weighted and summed."""
    whole = Window.partitionBy(F.lit(1))
    df = metrics.withColumn("bias_abs", F.abs("bias"))

    def part(name: str, weight: float) -> Column:
        low, high = F.min(name).over(whole), F.max(name).over(whole)
        scaled = 1 - (F.col(name) - low) / (high - low + 1e-9)
        flat = F.coalesce(low == high, F.lit(True))
        return F.coalesce(F.when(flat, F.lit(1.0)).otherwise(scaled), F.lit(0.0)) * weight

    scores = [part(n, w).alias(f"score_{n}") for n, w in SCORE_WEIGHTS.items() if n in df.columns]
    scored = df.select("*", *scores)
    total = sum((F.col(f"score_{n}") for n in SCORE_WEIGHTS if n in df.columns), F.lit(0.0))
    return scored.withColumn("final_rank_score", total)


def rank_models(scored: DataFrame, preference: str = "balanced") -> DataFrame:
    """Rank 1 is the best model for the preference; ties go to the better balanced score, then by name."""
    key = PREFERENCES.get(preference)
    order = [F.col(key).asc_nulls_last()] if key else []
    order += [F.col("final_rank_score").desc(), F.col("model")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def best_forecast(ranked: DataFrame, forecasts: DataFrame) -> DataFrame:
    """The best ranked model that each series has."""
    placed = forecasts.join(F.broadcast(ranked.select("model", F.col("rank").alias("_rank"))), "model")
    best = F.min("_rank").over(Window.partitionBy("series_id"))
    return placed.withColumn("_best", best).filter("_rank = _best").drop("_rank", "_best").select(*forecasts.columns)


def blend(ranked: DataFrame, forecasts: DataFrame, top: int = TOP) -> DataFrame:
    """Score-weighted mean of the top models per series and day.

    Days all of them cover; for a series without such a day, the models present.  A
    missing bound of a model that has bounds elsewhere reads the blended value.
    """
    head = ranked.filter(F.col("rank") <= top).select("model", "final_rank_score")
    head = head.withColumn("_sum", F.sum("final_rank_score").over(Window.partitionBy(F.lit(1))))
    score = F.col("final_rank_score")
    weight = F.when((F.coalesce("_sum", F.lit(0.0)) <= 0) | (F.coalesce(score, F.lit(0.0)) <= 0), F.lit(1.0)).otherwise(score)
    bounds = forecasts.groupBy("model").agg(
        F.max(F.col("yhat_lower").isNotNull()).alias("has_lower"), F.max(F.col("yhat_upper").isNotNull()).alias("has_upper")
    )
    weights = head.select("model", weight.alias("w")).join(bounds, "model")
    rows = forecasts.join(F.broadcast(weights), "model")
    w = F.col("w")

    def bound(name: str, has: str) -> tuple[Column, Column, Column]:
        have = F.when(F.col(has), w)
        return (
            F.sum(F.when(F.col(has) & F.col(name).isNotNull(), w * F.col(name))),
            F.coalesce(F.sum(F.when(F.col(has) & F.col(name).isNull(), w)), F.lit(0.0)),
            F.sum(have),
        )

    lo, hi = bound("yhat_lower", "has_lower"), bound("yhat_upper", "has_upper")
    mixed = rows.groupBy("series_id", "ds").agg(
        F.min("step").alias("step"),
        F.count("*").alias("models"),
        (F.sum(w * F.col("yhat")) / F.sum(F.when(F.col("yhat").isNotNull(), w))).alias("yhat"),
        lo[0].alias("lo_sum"), lo[1].alias("lo_gap"), lo[2].alias("lo_w"),
        hi[0].alias("hi_sum"), hi[1].alias("hi_gap"), hi[2].alias("hi_w"),
    )
    # decided for each series by itself: one that lacks a top model is blended from those it has
    most = F.max("models").over(Window.partitionBy("series_id"))
    k = weights.agg(F.count("*").alias("k"))
    kept = mixed.withColumn("most", most).join(F.broadcast(k), how="left").filter((F.col("models") == F.col("k")) | (F.col("most") < F.col("k")))

    def finish(p: str) -> Column:
        total = F.coalesce(F.col(f"{p}_sum"), F.lit(0.0)) + F.col("yhat") * F.col(f"{p}_gap")
        return total / F.col(f"{p}_w")

    return kept.select(
        F.lit("ensemble_blend").alias("model"), "series_id", "step", "ds", "yhat",
        finish("lo").alias("yhat_lower"), finish("hi").alias("yhat_upper"),
    )


def sanity_gate(forecasts: DataFrame, daily: DataFrame) -> DataFrame:
    """One row per model and series: passed or the reason why not, judged against the series' history."""
    stats = history_stats(daily.select("series_id", "ds", "y"), ["series_id"]).select(
        "series_id", F.coalesce("recent_avg_y", "overall_avg_y", F.lit(0.0)).alias("avg_y"), "recent_max_y"
    )
    per = forecasts.groupBy("model", "series_id").agg(
        F.count("yhat").alias("values"), F.min("yhat").alias("low"), F.max("yhat").alias("high")
    )
    peak = F.coalesce("recent_max_y", "avg_y")
    allowed = F.greatest(F.col("avg_y") * 10, peak * 5, F.lit(1_000_000.0))
    growth = F.when(F.col("avg_y") != 0, F.col("high") / F.greatest(F.col("avg_y"), F.lit(1.0)))
    reason = (
        F.when(F.col("values") == 0, 1).when(F.col("low") < 0, 2).when(F.col("high") > allowed, 3).when(growth > 10, 4).otherwise(0)
    )
    judged = per.join(stats, "series_id", "left").withColumn("code", reason)
    names = ["ok", "all forecast values are null", "negative forecast values", "forecast exceeds the allowed level", "forecast to history ratio is too large"]
    text = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("code") + 1)
    return judged.select("model", "series_id", (F.col("code") == 0).cast("int").alias("passed"), text.alias("reason"))


def drop_rejected(frame: DataFrame, gate: DataFrame) -> DataFrame:
    """Rows of the models and series that passed; a frame without series keeps models that passed somewhere."""
    keys = [c for c in ("model", "series_id") if c in frame.columns]
    return frame.join(gate.filter("passed = 1").select(*keys).distinct(), keys, "left_semi")
