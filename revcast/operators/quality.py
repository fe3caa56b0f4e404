"""Data-quality facts. Every function returns a small table; raw tables are only aggregated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revcast.functions.frames import newest_first
from revcast.functions.quantiles import exact_quantiles
from revcast.functions.scalars import safe_divide
from revcast.mapping import Mapping, merge_keys
from revcast.operators.align import cadence_facts
from revcast.schema import COMPANY


def _beside(left: DataFrame, *rights: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    for r in rights:
        left = left.join(F.broadcast(r), how="left")
    return left


def duplicate_rows(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row: rows beyond the first of each equal group (nulls are equal to nulls)."""
    groups = df.groupBy(*(keys or df.columns)).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def outlier_count(df: DataFrame, target: str) -> DataFrame:
    """One row: values beyond 1.5 inter-quartile ranges; none when the range is empty."""
    q = exact_quantiles(df, target, [0.25, 0.75])
    iqr = F.col("q1") - F.col("q0")
    out = (F.col(target) < F.col("q0") - 1.5 * iqr) | (F.col(target) > F.col("q1") + 1.5 * iqr)
    return df.join(F.broadcast(q), how="left").agg(F.count(F.when((iqr != 0) & out, 1)).alias("outlier_count"))


def missing_days(df: DataFrame, date: str, keys: Sequence[str] = ()) -> DataFrame:
    """The calendar days between the first and the last one that have no row, per key."""
    keys = list(keys)
    days = df.filter(F.col(date).isNotNull()).select(*keys, F.to_date(date).alias("ds")).distinct()
    span = days.groupBy(*keys).agg(F.min("ds").alias("a"), F.max("ds").alias("b")).filter("a IS NOT NULL")
    return span.select(*keys, F.explode(F.sequence("a", "b")).alias("ds")).join(days, [*keys, "ds"], "left_anti")


def quality_checks(df: DataFrame, date: str, target: str) -> DataFrame:
    """One row: counts of rows, duplicates, nulls, outliers and missing days, and the date range."""
    base = df.agg(
        F.count("*").alias("row_count"),
        F.count(F.when(F.col(date).isNull(), 1)).alias("null_dates"),
        F.count(F.when(F.col(target).isNull(), 1)).alias("null_target"),
        F.min(F.to_date(date)).alias("date_min"),
        F.max(F.to_date(date)).alias("date_max"),
    )
    days = df.select(F.to_date(date).alias("_d")).distinct().agg(F.count("_d").alias("_days"))
    missing = F.coalesce(F.datediff("date_max", "date_min") + 1 - F.col("_days"), F.lit(0))
    return (
        _beside(base, duplicate_rows(df), outlier_count(df, target), days)
        .withColumn("missing_dates", missing.cast("long"))
        .drop("_days")
    )


def quality_report(daily: DataFrame) -> DataFrame:
    """One row on a daily series: missing days, |z| > 3, shift of the mean between the halves."""
    facts = daily.agg(
        F.count("*").alias("rows"),
        F.count(F.when(F.col("y").isNull(), 1)).alias("missing_target_values"),
        F.min("ds").alias("min_date"),
        F.max("ds").alias("max_date"),
        F.countDistinct("ds").alias("_days"),
        F.avg("y").alias("_mean"),
        F.stddev_samp("y").alias("_std"),
    )
    numbered = daily.withColumn("_rn", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("ds"))).crossJoin(
        F.broadcast(facts)
    )
    spread = F.when(F.coalesce("_std", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("_std"))
    early = F.col("_rn") <= F.floor(F.col("rows") / 2)
    tail = numbered.agg(
        F.count(F.when(F.abs((F.col("y") - F.col("_mean")) / spread) > 3, 1)).alias("_outliers"),
        F.avg(F.when(early, F.col("y"))).alias("early_mean"),
        F.avg(F.when(~early, F.col("y"))).alias("late_mean"),
    )
    enough = F.col("rows") > 3
    base = F.when(F.coalesce("early_mean", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("early_mean"))
    shifted = F.abs(F.col("late_mean") - F.col("early_mean")) > F.greatest(F.lit(1.0), 0.35 * F.abs(base))
    return _beside(facts, tail).select(
        "rows",
        "missing_target_values",
        "min_date",
        "max_date",
        (enough & (F.datediff("max_date", "min_date") + 1 != F.col("_days"))).cast("int").alias("missing_dates_detected"),
        F.when(enough, F.col("_outliers")).otherwise(0).alias("potential_outliers"),
        F.coalesce(enough & shifted, F.lit(False)).cast("int").alias("structural_break_warning"),
        "early_mean",
        "late_mean",
    )


def merged_series_audit(table: DataFrame, category: str | None = None) -> DataFrame:
    """One row: the modeling table before and after the daily roll-up."""
    daily = table.filter(F.col("ds").isNotNull()).groupBy("ds").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("y")
    )
    raw = daily.agg(
        F.sum("n").alias("raw_rows"),
        F.count("*").alias("raw_distinct_dates"),
        F.sum(F.col("n") - 1).alias("raw_duplicate_date_rows"),
        F.sum("y").alias("raw_total_y"),
        F.count("*").alias("final_rows"),
        F.sum("y").alias("final_total_y"),
        F.percentile("y", 0.5).alias("final_median_y"),
        F.max("y").alias("final_max_y"),
        F.avg("y").alias("_mean"),
    )
    recent = newest_first(daily, []).filter("rn_desc <= 30").agg(F.avg("y").alias("_recent"))
    return _beside(raw, recent).select(
        "raw_rows", "raw_distinct_dates", "raw_duplicate_date_rows", "raw_total_y",
        "final_rows", "final_total_y", "final_median_y", "final_max_y",
        safe_divide("_recent", "_mean").alias("recent_to_history_ratio"),
        F.lit(category or COMPANY).alias("category_mode"),
    )


def history_stats(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Level of a daily history, recent 30 rows and overall, per key (or once)."""
    keys = list(keys)
    known = newest_first(daily.filter(F.col("y").isNotNull()), keys).filter("rn_desc <= 30")
    recent = known.groupBy(*keys).agg(
        F.avg("y").alias("recent_avg_y"), F.percentile("y", 0.5).alias("recent_median_y"), F.max("y").alias("recent_max_y")
    )
    extra = []
    for c in ("leads", "cost"):
        if c in daily.columns:
            extra += [F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"avg_{c}")]
    overall = daily.groupBy(*keys).agg(F.count("*").alias("history_rows"), F.avg("y").alias("overall_avg_y"), *extra)
    dup = daily.groupBy(*(keys or []), "ds").count().groupBy(*keys).agg(F.sum(F.col("count") - 1).alias("duplicate_ds_rows"))
    if keys:
        return overall.join(recent, keys, "left").join(dup, keys, "left")
    return _beside(overall, recent, dup)


def health_monitor(table: DataFrame, daily: DataFrame, band_width_pct: DataFrame | None = None) -> DataFrame:
    """Six checks with a status; ``band_width_pct`` is a one-row table of that name."""
    raw = table.groupBy("ds").agg(F.count("*").alias("n"), F.count(F.when(F.col("y").isNull(), 1)).alias("no_y"))
    raw = raw.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dup"),
        F.coalesce(F.sum(F.when(F.col("ds").isNull(), F.col("n"))), F.lit(0)).alias("no_ds"),
        F.coalesce(F.sum("no_y"), F.lit(0)).alias("no_y"),
    )
    span = daily.agg(F.count("*").alias("days"), F.coalesce(F.datediff(F.max("ds"), F.min("ds")), F.lit(0)).alias("cover"))
    row = _beside(raw, span)
    if band_width_pct is not None:
        row = _beside(row, band_width_pct)
    else:
        row = row.withColumn("band_width_pct", F.lit(None).cast("double"))

    def check(name: str, value, healthy, bad: str):
        return F.struct(
            F.lit(name).alias("check"),
            F.when(healthy, "Healthy").otherwise(bad).alias("status"),
            value.cast("double").alias("measure"),
        )

    rows = F.array(
        check("History depth", F.col("days"), F.col("days") >= 90, "Watch"),
        check("Date coverage", F.col("cover"), F.col("cover") >= 60, "Watch"),
        check("Missing dates", F.col("no_ds"), F.col("no_ds") == 0, "Issue"),
        check("Missing target values", F.col("no_y"), F.col("no_y") == 0, "Issue"),
        check("Duplicate dates", F.col("dup"), F.col("dup") == 0, "Watch"),
        check("Forecast band width", F.col("band_width_pct"), F.coalesce("band_width_pct", F.lit(0.0)) <= 25, "Watch"),
    )
    return row.select(F.explode(rows).alias("r")).select("r.*")


def health_counts(monitor: DataFrame) -> DataFrame:
    def of(status: str, name: str):
        return F.count(F.when(F.col("status") == status, 1)).alias(name)

    return monitor.agg(of("Issue", "issues"), of("Watch", "watch_items"), of("Healthy", "healthy_items"))


def confidence_score(daily: DataFrame) -> DataFrame:
    """Factors of the overall confidence in percent: depth of history, stability, both."""
    facts = daily.agg(F.count("*").alias("n"), F.stddev_pop("y").alias("sd"), F.avg("y").alias("mean"))
    ratio = F.coalesce(safe_divide("sd", "mean"), F.lit(1.0))
    depth = F.least(F.col("n") / 180.0, F.lit(1.0))
    stable = F.greatest(F.lit(0.0), 1.0 - F.least(ratio, F.lit(1.5)) / 1.5)
    rows = [
        ("History depth", depth * 100),
        ("Series stability", stable * 100),
        ("Overall confidence", (depth * 0.55 + stable * 0.45) * 100),
    ]
    items = F.array(*[F.struct(F.lit(n).alias("factor"), v.alias("score_pct")) for n, v in rows])
    return facts.select(F.explode(items).alias("r")).select("r.*")


def cost_validation(cost: DataFrame, revenue: DataFrame, bucket: str = "platform") -> DataFrame:
    """Month by bucket, with company rows (bucket ``company_total``): cost, daily average, revenue, ROAS.

    ``unallocated_cost`` is spend in buckets that earned nothing that month.
    """
    month = F.trunc("ds", "MM").alias("month")
    spend = cost.filter(F.col("ds").isNotNull()).groupBy(month, F.col(bucket).alias("bucket")).agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("monthly_cost")
    )
    earned = revenue.groupBy(month, F.col(bucket).alias("bucket")).agg(F.sum("y").alias("monthly_revenue"))
    joined = spend.join(earned, ["month", "bucket"], "left")
    # revenue of buckets without spend still counts for the company
    company = spend.groupBy("month").agg(F.sum("monthly_cost").alias("monthly_cost")).join(
        earned.groupBy("month").agg(F.sum("monthly_revenue").alias("monthly_revenue")), "month", "left"
    )
    lost = joined.filter(F.col("monthly_revenue").isNull()).groupBy("month").agg(F.sum("monthly_cost").alias("unallocated_cost"))
    company = company.join(lost, "month", "left").withColumn("bucket", F.lit(COMPANY))
    both = joined.withColumn(
        "unallocated_cost", F.when(F.col("monthly_revenue").isNull(), F.col("monthly_cost"))
    ).unionByName(company)
    days = F.dayofmonth(F.last_day("month"))
    return both.select(
        "month",
        "bucket",
        "monthly_cost",
        days.alias("days_in_month"),
        (F.col("monthly_cost") / days).alias("daily_cost"),
        (F.col("monthly_cost") / days * days).alias("recomputed_monthly_cost"),
        "monthly_revenue",
        safe_divide("monthly_revenue", "monthly_cost").alias("roas"),
        F.coalesce("unallocated_cost", F.lit(0.0)).alias("unallocated_cost"),
    )


def dataset_info(sources: dict[str, tuple[DataFrame, Mapping]], revenue_role: str = "revenue") -> DataFrame:
    """Cadence of each source and whether it will be spread to the revenue's days."""
    order = F.create_map(F.lit("D"), F.lit(0), F.lit("W"), F.lit(1), F.lit("M"), F.lit(2))
    facts = None
    for role, (df, mapping) in sources.items():
        chosen = F.col("cadence") if mapping.frequency == "auto" else F.lit(mapping.frequency)
        one = cadence_facts(df, mapping.date).select(
            F.lit(role).alias("role"), chosen.alias("cadence"), "days", F.lit(mapping.fill_method).alias("fill_method")
        )
        facts = one if facts is None else facts.unionByName(one)
    base = facts.filter(F.col("role") == revenue_role).select(order[F.col("cadence")].alias("_base"))
    return facts.crossJoin(F.broadcast(base)).select(
        "role", "cadence", "days", "fill_method", (order[F.col("cadence")] > F.col("_base")).cast("int").alias("resampled")
    )


def quality_profile(daily: DataFrame) -> DataFrame:
    """Mean revenue by weekday (Monday 0) and by month of the year, one row per bar."""
    by_day = daily.groupBy(F.weekday("ds").alias("position")).agg(F.avg("y").alias("mean_y"), F.count("*").alias("days"))
    by_month = daily.groupBy(F.month("ds").alias("position")).agg(F.avg("y").alias("mean_y"), F.count("*").alias("days"))
    return by_day.withColumn("profile", F.lit("weekday")).unionByName(by_month.withColumn("profile", F.lit("month")))


def data_model_profile(sources: dict[str, tuple[DataFrame, Mapping]], table: DataFrame, revenue_role: str = "revenue") -> DataFrame:
    """Rows and columns of each source, the keys it joins on, and the shape of the modeling table."""
    revenue = sources[revenue_role][1]
    out = None
    for role, (df, mapping) in sources.items():
        keys = "ds" if role == revenue_role else ", ".join(["ds", *[left for left, _ in merge_keys(revenue, mapping)]])
        one = df.agg(F.count("*").alias("rows")).select(
            F.lit(role).alias("source"), "rows", F.lit(len(df.columns)).alias("columns"), F.lit(keys).alias("join_keys")
        )
        out = one if out is None else out.unionByName(one)
    shape = table.agg(F.count("*").alias("rows")).select(
        F.lit("modeling_table").alias("source"), "rows", F.lit(len(table.columns)).alias("columns"), F.lit("ds").alias("join_keys")
    )
    return out.unionByName(shape)
