"""Analytics over the company's daily history (at most one row per day)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revcast.functions.frames import first_rows, newest_first
from revcast.functions.scalars import clip, safe_divide
from revcast.operators.align import helper_daily_totals
from revcast.schema import FLAG_COLUMNS

SUMS = ("leads", "cost", "clicks", "visits", "registrations", "spend", "impressions")


def pct_change(now: Column, before: Column) -> Column:
    """Percent change; null without a base."""
    return F.try_divide(now - before, before) * 100


def rows_of(df: DataFrame, items: Sequence[Column]) -> DataFrame:
    """One-row table -> one row per struct."""
    return df.select(F.explode(F.array(*items)).alias("_r")).select("_r.*")


def daily_history(table: DataFrame, repeated: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Day: revenue, helpers, flags, ROAS and revenue per lead (both not negative).

    The modeling table holds shares of leads and cost, which add up to the
    totals.  A helper that was repeated on every row of its key is named in
    ``repeated`` with that key and counted once per key.
    """
    repeated = repeated or {}
    aggs = [F.sum("y").alias("y")]
    aggs += [F.sum(c).alias(c) for c in SUMS if c in table.columns and c not in repeated]
    aggs += [F.max(c).alias(c) for c in FLAG_COLUMNS if c in table.columns]
    daily = table.filter(F.col("ds").isNotNull()).groupBy("ds").agg(*aggs)
    for c, keys in repeated.items():
        daily = daily.join(helper_daily_totals(table, c, keys), "ds", "left")
    earned = F.greatest(F.col("y"), F.lit(0.0))
    for name, den in (("roas", "cost"), ("revenue_per_lead", "leads")):
        if den in daily.columns:
            daily = daily.withColumn(name, clip(safe_divide(earned, den), 0.0))
    return daily


def series_summary(
    table: DataFrame, category: str = "category", raw_totals: Sequence[DataFrame] = (), days: int = 30
) -> DataFrame:
    """Per category: totals, level, volatility, recent figures, share and stability.

    ``raw_totals`` are tables of :func:`align.value_by_category`, whose totals win
    over the allocated ones.  Rows combine per category and day first, so a large
    category costs no more than its days.
    """
    helpers = [c for c in ("leads", "cost") if c in table.columns]
    y = F.col("y")
    per_day = table.groupBy(F.col(category).alias("category"), "ds").agg(
        F.sum("y").alias("s"), F.count("y").alias("n"), F.avg("y").alias("m"), F.var_pop(y).alias("v"),
        *[F.sum(c).alias(c) for c in helpers],
    )
    last = per_day.agg(F.date_sub(F.max("ds"), days - 1).alias("_cut"))
    rows = per_day.join(F.broadcast(last), how="left")
    recent = F.col("ds") >= F.col("_cut")

    def of_recent(c: Column) -> Column:
        return F.sum(F.when(recent, c))

    total_n, mean = F.sum("n"), F.sum("s") / F.sum("n")
    spread = F.sum(F.col("n") * (F.col("v") + F.col("m") * F.col("m"))) / total_n - mean * mean
    grouped = rows.groupBy("category").agg(
        F.sum("s").alias("total_revenue"),
        F.count("*").alias("periods"),
        mean.alias("avg_daily"),
        F.sqrt(F.greatest(spread, F.lit(0.0))).alias("volatility"),
        of_recent(F.col("s")).alias("recent_revenue"),
        F.count(F.when(recent, 1)).alias("recent_days"),
        (of_recent(F.col("s")) / F.sum(F.when(recent, F.col("n")))).alias("recent_avg_daily"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"total_{c}") for c in helpers],
        *[of_recent(F.col(c)).alias(f"recent_{c}") for c in helpers],
    )
    for raw in raw_totals:
        name = next(c for c in raw.columns if c.endswith("_total")).removesuffix("_total")
        grouped = grouped.join(raw, "category", "left")
        for side in ("total", "recent"):
            known = [F.col(f"{name}_{side}")] + ([F.col(f"{side}_{name}")] if f"{side}_{name}" in grouped.columns else [])
            grouped = grouped.withColumn(f"{side}_{name}", F.coalesce(*known)).drop(f"{name}_{side}")

    def positive(c: str) -> Column:
        return F.when(F.col(c) > 0, F.col(c))

    out = grouped
    if "total_leads" in out.columns:
        out = out.withColumn("rev_per_lead", clip(safe_divide(clip("total_revenue", 0.0), "total_leads"), 0.0))
    if "total_cost" in out.columns:
        out = out.withColumn("roas", F.col("total_revenue") / positive("total_cost"))
        out = out.withColumn("recent_roas", F.col("recent_revenue") / positive("recent_cost"))
    whole = per_day.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("_all"))
    out = out.join(F.broadcast(whole), how="left")
    out = out.withColumn("share_of_revenue", F.col("total_revenue") / F.greatest(F.col("_all"), F.lit(1.0))).drop("_all")
    return out.withColumn("stability_score", F.coalesce(safe_divide("avg_daily", "volatility"), F.lit(0.0)))


def monthly_totals(daily: DataFrame) -> DataFrame:
    helpers = [c for c in ("leads", "cost") if c in daily.columns]
    return daily.groupBy(F.trunc("ds", "MM").alias("month")).agg(
        F.sum("y").alias("revenue"), *[F.sum(c).alias(c) for c in helpers]
    )


def monthly_summary(daily: DataFrame, last: int = 12) -> DataFrame:
    """Last months with ROAS and the change on the month before."""
    w = Window.partitionBy(F.lit(1)).orderBy("month")
    out = monthly_totals(daily)
    if "cost" in out.columns:
        out = out.withColumn("roas", safe_divide("revenue", "cost"))
    out = out.withColumn("mom_pct", pct_change(F.col("revenue"), F.lag("revenue").over(w)))
    return newest_first(out, [], "month").filter(F.col("rn_desc") <= last).drop("rn_desc")


def year_over_year(daily: DataFrame, least_months: int = 24) -> DataFrame:
    """Revenue by year and month of the year, given at least two years of months."""
    months = daily.groupBy(F.year("ds").alias("year"), F.month("ds").alias("month")).agg(F.sum("y").alias("revenue"))
    count = F.count("*").over(Window.partitionBy(F.lit(1)))
    return months.withColumn("_n", count).filter(F.col("_n") >= least_months).drop("_n")


def actual_vs_forecast(daily: DataFrame, forecast: DataFrame, last: int = 12) -> DataFrame:
    """Last months: actual, previous month, change, and what the forecast says for the month."""
    w = Window.partitionBy(F.lit(1)).orderBy("month")
    actual = daily.groupBy(F.trunc("ds", "MM").alias("month")).agg(F.sum("y").alias("actual"))
    actual = actual.withColumn("prev_month", F.lag("actual").over(w))
    actual = actual.withColumn("mom_pct", pct_change(F.col("actual"), F.col("prev_month")))
    tail = newest_first(actual, [], "month").filter(F.col("rn_desc") <= last).drop("rn_desc")
    ahead = forecast.groupBy(F.trunc("ds", "MM").alias("month")).agg(F.sum("expected").alias("forecast_revenue"))
    return tail.join(ahead, "month", "left")


def weekday_pattern(daily: DataFrame) -> DataFrame:
    """Mean revenue by weekday (Monday 0), best day first."""
    means = daily.groupBy(F.weekday("ds").alias("weekday")).agg(F.avg("y").alias("avg_revenue"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("avg_revenue"), "weekday")
    return means.withColumn("rank", F.row_number().over(w))


# Tracked column and its name in the report.
TRACKED = {"y": "Revenue", "leads": "Lead volume", "cost": "Spend", "roas": "ROAS", "revenue_per_lead": "Revenue per lead"}


def tracking(daily: DataFrame, recent: int = 7, prior: int = 28) -> DataFrame:
    """Mean of the last 7 rows against the 28 before, per tracked metric."""
    rows = newest_first(daily, []).filter(F.col("rn_desc") <= recent + prior)
    now = F.col("rn_desc") <= recent
    present = [c for c in TRACKED if c in daily.columns]
    facts = rows.agg(
        *[F.avg(F.when(now, F.col(c))).alias(f"{c}_now") for c in present],
        *[F.avg(F.when(~now, F.col(c))).alias(f"{c}_before") for c in present],
    )
    return rows_of(
        facts,
        [
            F.struct(
                F.lit(TRACKED[c]).alias("metric"),
                F.col(f"{c}_now").alias("recent_7_avg"),
                F.col(f"{c}_before").alias("prior_28_avg"),
                pct_change(F.col(f"{c}_now"), F.col(f"{c}_before")).alias("delta_pct"),
            )
            for c in present
        ],
    )


def anomaly_scores(daily: DataFrame, window: int = 28) -> DataFrame:
    """Every day's z-score against the rows before it; days without a base have none."""
    one = Window.partitionBy(F.lit(1))
    w = one.orderBy("ds")
    past = w.rowsBetween(-window, -1)
    all_past = w.rowsBetween(Window.unboundedPreceding, -1)
    df = daily.withColumn("_n", F.count("*").over(one))
    least = F.when(F.col("_n") < 10, 3).otherwise(7)
    known = F.count("y").over(past)
    df = df.select(
        "ds",
        "y",
        F.when(known >= least, F.avg("y").over(past)).alias("m"),
        F.when(known >= least, F.stddev_pop("y").over(past)).alias("s"),
        F.when(F.count("y").over(all_past) >= 2, F.avg("y").over(all_past)).alias("m2"),
        F.when(F.count("y").over(all_past) >= 2, F.stddev_pop("y").over(all_past)).alias("s2"),
    )
    usable = F.count("m").over(one) > 0
    df = df.select("ds", "y", F.when(usable, F.col("m")).otherwise(F.col("m2")).alias("rolling_mean"), F.when(usable, F.col("s")).otherwise(F.col("s2")).alias("_s"))
    return df.filter(F.col("rolling_mean").isNotNull()).select(
        "ds", "y", "rolling_mean", safe_divide(F.col("y") - F.col("rolling_mean"), "_s").alias("zscore")
    )


def anomalies(daily: DataFrame, threshold: float = 2.0, last: int = 6) -> DataFrame:
    """The latest flagged days with severity and direction."""
    hits = anomaly_scores(daily).filter(F.abs("zscore") >= threshold)
    return newest_first(hits, []).filter(F.col("rn_desc") <= last).select(
        "ds",
        "y",
        "zscore",
        F.when(F.abs("zscore") >= 3, "High").otherwise("Medium").alias("severity"),
        F.when(F.col("zscore") < 0, "Below trend").otherwise("Above trend").alias("direction"),
    )


def alerts(tracked: DataFrame, flagged: DataFrame, top: int | None = None) -> DataFrame:
    """Revenue shift of 12 % or more, then flagged days, oldest first."""
    shift = tracked.filter((F.col("metric") == "Revenue") & (F.abs("delta_pct") >= 12)).select(
        F.lit(0).alias("position"), F.lit(None).cast("date").alias("ds"),
        F.when(F.col("delta_pct") < 0, "warning").otherwise("info").alias("level"),
        F.lit("Revenue shift detected").alias("title"), F.col("delta_pct").alias("value"),
    )
    days = flagged.select(
        F.lit(1).alias("position"), "ds", F.when(F.col("zscore") < 0, "warning").otherwise("info").alias("level"),
        F.concat(F.lit("Anomaly on "), F.date_format("ds", "yyyy-MM-dd")).alias("title"), F.col("zscore").alias("value"),
    )
    return first_rows(shift.unionByName(days).orderBy("position", "ds"), top)


def overview(daily: DataFrame, forecast: DataFrame) -> DataFrame:
    """One row: sizes, latest revenue, forecast start and totals, width of the band in percent."""
    h = daily.agg(F.count("*").alias("history_rows"), F.max_by("y", "ds").alias("latest_revenue"))
    f = forecast.agg(
        F.count("*").alias("forecast_rows"), F.min("ds").alias("forecast_start"), F.sum("expected").alias("forecast_total"),
        F.sum("conservative").alias("lower_total"), F.sum("aggressive").alias("upper_total"),
    )
    width = safe_divide(F.col("upper_total") - F.col("lower_total"), "forecast_total") * 100
    return h.join(F.broadcast(f), how="left").withColumn("band_width_pct", width)


# Periods per month of each cadence.
MONTH_FACTORS = {"day": 30.4375, "week": 4.345, "month": 1.0, "quarter": 1.0 / 3.0, "period": 1.0}
DIAGNOSTICS = ("recent_avg_y", "recent_median_y", "recent_max_y", "forecast_avg_expected", "avg_leads", "max_leads", "avg_cost", "max_cost")


def diagnostics(stats: DataFrame, forecast: DataFrame, unit: str = "day") -> DataFrame:
    """Level metrics per period and per month, the forecast to history ratio and the duplicate count."""
    ahead = forecast.agg(F.avg("expected").alias("forecast_avg_expected"))
    row = stats.join(F.broadcast(ahead), how="left").withColumn(
        "forecast_to_history_ratio", safe_divide("forecast_avg_expected", "recent_avg_y")
    )
    factor = MONTH_FACTORS.get(unit, 1.0)
    items = []
    for name in (*DIAGNOSTICS, "forecast_to_history_ratio", "duplicate_ds_rows"):
        if name in row.columns:
            value = F.col(name).cast("double")
            scale = factor if name in DIAGNOSTICS else 1.0
            items.append(F.struct(F.lit(name).alias("metric"), value.alias("value"), (value * scale).alias("monthly_value")))
    return rows_of(row, items).filter(F.col("value").isNotNull())


def run_history(stored: DataFrame) -> DataFrame:
    """Daily revenue, leads and cost of a stored run's modeling table."""
    present = [c for c in ("y", "leads", "cost") if c in stored.columns]
    return stored.filter(F.col("ds").isNotNull()).groupBy("ds").agg(*[F.sum(c).alias(c) for c in present])
