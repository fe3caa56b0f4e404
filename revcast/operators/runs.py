"""Comparing two forecast runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare_forecasts(a: DataFrame, b: DataFrame, rows: int | None = None) -> DataFrame:
    """Both forecasts per day (a day may be in one only) with their difference, earliest first."""
    left = a.groupBy("ds").agg(F.sum("yhat").alias("run_a"))
    right = b.groupBy("ds").agg(F.sum("yhat").alias("run_b"))
    out = left.join(right, "ds", "full").withColumn("delta", F.col("run_b") - F.col("run_a")).orderBy("ds")
    return out.limit(rows) if rows else out


def compare_settings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Settings of both runs by key, marked where they differ."""
    left, right = a.select("key", F.col("value").alias("run_a")), b.select("key", F.col("value").alias("run_b"))
    return left.join(right, "key", "full").withColumn("different", (~F.col("run_a").eqNullSafe(F.col("run_b"))).cast("int"))


def run_summary(label: str, forecast: DataFrame, ranking: DataFrame) -> DataFrame:
    """One row: length and totals of the forecast, best model and its errors."""
    f = forecast.agg(
        F.count("*").alias("forecast_rows"), F.sum("yhat").alias("forecast_total"), F.avg("yhat").alias("forecast_avg"),
        F.min("ds").alias("forecast_start"), F.max("ds").alias("forecast_end"),
    )
    best = ranking.filter("rank = 1").select(F.col("model").alias("best_model"), "wape", "mae", "rmse", "smape", "bias")
    return f.join(F.broadcast(best.limit(1)), how="left").withColumn("run", F.lit(label))


def compare_models(a: DataFrame, b: DataFrame, top: int | None = None) -> DataFrame:
    """The leading models of both runs."""
    both = a.withColumn("run", F.lit("a")).unionByName(b.withColumn("run", F.lit("b")), allowMissingColumns=True)
    w = Window.partitionBy("run").orderBy("rank")
    return both.withColumn("_r", F.row_number().over(w)).filter((F.col("_r") <= top) if top else F.lit(True)).select("run", "rank", "model", "wape", "final_rank_score")
