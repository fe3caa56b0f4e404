"""Statistics over days and months: response curve, lag scan, frontier, attrition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revcast.functions.frames import first_rows, newest_first
from revcast.functions.ranking import shared_rank
from revcast.functions.scalars import correlation, safe_divide

LAGS = tuple(range(0, 61, 5))


def response_fit(months: DataFrame) -> DataFrame:
    """One row: revenue over ln(1 + cost) by month, and whether the fit is worth drawing."""
    use = months.filter((F.col("cost") > 0) & (F.col("revenue") >= 0))
    facts = use.agg(
        F.count("*").alias("months"), correlation("cost", "revenue").alias("correlation"),
        F.regr_slope("revenue", F.log1p("cost")).alias("slope"), F.regr_intercept("revenue", F.log1p("cost")).alias("intercept"),
        F.min("cost").alias("cost_min"), F.max("cost").alias("cost_max"),
    )
    drawn = (F.col("correlation") >= 0.2) & (F.col("slope") > 0)
    return facts.filter("months >= 4").withColumn("drawn", F.coalesce(drawn, F.lit(False)).cast("int"))


def response_curve(fit: DataFrame, points: int = 40) -> DataFrame:
    """The fitted curve between the least and the largest spend, with its marginal return."""
    step = (F.col("cost_max") - F.col("cost_min")) / (points - 1)
    rows = fit.select(
        "slope", "intercept", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), F.col("cost_min"), step.alias("step")
    ).withColumn("spend", F.col("cost_min") + F.col("step") * F.col("point"))
    value = F.greatest(F.col("slope") * F.log1p("spend") + F.col("intercept"), F.lit(0.0))
    w = Window.partitionBy(F.lit(1)).orderBy("point")
    rows = rows.withColumn("revenue", value)
    marginal = safe_divide(F.col("revenue") - F.lag("revenue").over(w), F.col("spend") - F.lag("spend").over(w))
    return rows.select("point", "spend", "revenue", marginal.alias("marginal_return"))


def lag_scan(daily: DataFrame, lags: Sequence[int] = LAGS, least: int = 12) -> DataFrame:
    """Correlation of revenue with the leads of k rows before; ``best`` marks the strongest."""
    w = Window.partitionBy(F.lit(1)).orderBy("ds")
    cells = F.array(*[F.struct(F.lit(k).alias("lag_days"), F.col(f"_l{k}").alias("x")) for k in lags])
    wide = daily.select("ds", "y", *[F.lag("leads", k).over(w).alias(f"_l{k}") for k in lags])
    long = wide.select("y", F.explode(cells).alias("c")).select("y", "c.*").filter("x IS NOT NULL AND y IS NOT NULL")
    facts = long.groupBy("lag_days").agg(
        F.count("*").alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), correlation("x", "y").alias("correlation")
    )
    kept = facts.filter((F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0)).select(
        "lag_days", "correlation", F.abs("correlation").alias("abs_correlation")
    )
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("abs_correlation"), "lag_days"))
    return kept.withColumn("best", (rank == 1).cast("int"))


def lag_alignment(daily: DataFrame, lag_days: int, last: int = 120) -> DataFrame:
    """The last rows with the revenue that came ``lag_days`` rows later beside cost and leads."""
    tail = newest_first(daily, []).filter(F.col("rn_desc") <= last)
    w = Window.partitionBy(F.lit(1)).orderBy("ds")
    keep = [c for c in ("cost", "leads", "y") if c in daily.columns]
    return tail.select("ds", *keep, F.lead("y", lag_days).over(w).alias("lagged_revenue")).filter("lagged_revenue IS NOT NULL")


def efficiency_frontier(segments: DataFrame, top: int | None = None) -> DataFrame:
    """Segments (segment, revenue, cost) by ROAS with the share of segments at or below, ties averaged."""
    df = segments.filter((F.col("cost") > 0) & (F.col("revenue") >= 0)).withColumn("roas", F.col("revenue") / F.col("cost"))
    df = shared_rank(df, "roas", "efficiency_score")
    return first_rows(df.orderBy(F.desc("roas"), F.desc("revenue"), "segment"), top)


def attrition(months: DataFrame) -> DataFrame:
    """Share of the previous month's revenue that was kept and lost (not below zero)."""
    w = Window.partitionBy(F.lit(1)).orderBy("month")
    df = months.select("month", "revenue", F.lag("revenue").over(w).alias("prev_revenue"))
    kept = safe_divide("revenue", "prev_revenue")
    return df.withColumn("retention_rate", kept).withColumn(
        "attrition_rate", F.greatest(F.lit(0.0), 1 - F.col("retention_rate"))
    ).filter("retention_rate IS NOT NULL")
