"""Cohort revenue, acquisition cost and payback.

Everything after the first aggregation works on lead month x group x age, a
table bounded by the calendar and the number of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revcast.functions.frames import newest_first
from revcast.functions.quantiles import median_of
from revcast.functions.scalars import dimension_label, month_label, safe_divide

ALL_SOURCES = "All Sources"

# Names under which a revenue sheet may carry its cohort columns.
LEAD_MONTH_NAMES = ["lead month", "lead_month", "cohort month", "cohort_month"]
TXN_MONTH_NAMES = ["transaction month", "transaction_month", "txn month", "txn_month", "revenue month", "revenue_month"]


def cohort_age(lead: str = "lead_month", txn: str = "transaction_month") -> Column:
    return ((F.year(txn) - F.year(lead)) * 12 + F.month(txn) - F.month(lead)).cast("int")


def cohort_long_frame(df: DataFrame, group: str | None = None, cost_key: str | None = None) -> DataFrame:
    """Transactions with first-of-month dates, group label, cost key and age; earlier-than-lead rows go."""
    def label(c: str | None) -> Column:
        return dimension_label([("Platform", c)], ALL_SOURCES) if c else F.lit(ALL_SOURCES)

    lead, txn = F.trunc("lead_month", "MM"), F.trunc("transaction_month", "MM")
    out = df.select(
        lead.alias("lead_month"), txn.alias("transaction_month"), F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)).alias("revenue"),
        label(group).alias("cohort_category"), label(cost_key).alias("cost_match_key"),
    )
    return out.filter(F.col("transaction_month") >= F.col("lead_month")).withColumn("cohort_age_month", cohort_age())


def cost_rollups(cost: DataFrame, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(month, month x key) totals of the cost sheet."""
    key = dimension_label([("Platform", group)], ALL_SOURCES) if group else F.lit(ALL_SOURCES)
    by_key = cost.filter("ds IS NOT NULL").groupBy(F.trunc("ds", "MM").alias("lead_month"), key.alias("cost_match_key")).agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("matched_cost")
    )
    by_month = by_key.groupBy("lead_month").agg(F.sum("matched_cost").alias("month_cost"))
    return by_month, by_key


def cohort_aggregate(cohort: DataFrame) -> DataFrame:
    """Lead month x group: revenue, active months, first and last month, revenue of the lead month itself."""
    per_month = cohort.groupBy("lead_month", "cohort_category", "cost_match_key", "transaction_month").agg(
        F.sum("revenue").alias("revenue")
    )
    return per_month.groupBy("lead_month", "cohort_category", "cost_match_key").agg(
        F.sum("revenue").alias("total_revenue"),
        F.count("*").alias("active_months"),
        F.min("transaction_month").alias("first_txn_month"),
        F.max("transaction_month").alias("last_txn_month"),
        F.coalesce(F.sum(F.when(F.col("transaction_month") == F.col("lead_month"), F.col("revenue"))), F.lit(0.0)).alias("first_month_revenue"),
    )


def allocate_cohort_cost(groups: DataFrame, by_month: DataFrame, by_key: DataFrame | None) -> DataFrame:
    """Cost of the month's key shared by revenue; what is left of the month goes to groups without a key match."""
    month, bucket = Window.partitionBy("lead_month"), Window.partitionBy("lead_month", "cost_match_key")
    revenue = F.col("total_revenue")
    df = groups
    if by_key is not None:
        total = F.sum(revenue).over(bucket)
        df = df.join(by_key, ["lead_month", "cost_match_key"], "left").withColumn(
            "cost", F.col("matched_cost") * F.when(total > 0, revenue / total)
        ).drop("matched_cost")
    else:
        df = df.withColumn("cost", F.lit(None).cast("double"))
    df = df.join(by_month, "lead_month", "left")
    matched = F.coalesce(F.sum("cost").over(month), F.lit(0.0))
    left = F.greatest(F.coalesce("month_cost", F.lit(0.0)) - matched, F.lit(0.0))
    open_revenue = F.sum(F.when(F.col("cost").isNull(), revenue).otherwise(0.0)).over(month)
    fallback = F.when(F.col("month_cost").isNotNull() & (open_revenue > 0), left * revenue / open_revenue)
    return df.withColumn("_fallback", fallback).withColumn("cost", F.coalesce("cost", "_fallback")).drop("_fallback", "month_cost")


def cohort_scores(groups: DataFrame, split: bool = True) -> DataFrame:
    """ROAS, share, payback of the lead month and a class per cohort; ``split`` names platforms."""
    df = groups.withColumn("roas", safe_divide("total_revenue", "cost"))
    facts = df.agg(F.sum("total_revenue").alias("_sum"))
    df = df.join(F.broadcast(median_of(df, "roas", "_median")), how="left").join(F.broadcast(facts), how="left")
    df = df.withColumn("revenue_share", F.col("total_revenue") / F.greatest(F.coalesce("_sum", F.lit(0.0)), F.lit(1.0)))
    df = df.withColumn("payback_share_m0", safe_divide("first_month_revenue", "cost"))
    names = (
        ("Scale Platform", "Cap / Rework Platform", "Watch Platform", "Verify Recent ROAS", "Cap / Rework Platform", "Watch Platform")
        if split
        else ("Strong Cohort", "Weak Cohort", "Mixed Cohort", "High-value Cohort", "Low-value Cohort", "Monitor Cohort")
    )
    roas, share = F.col("roas"), F.col("revenue_share")
    action = (
        F.when(roas >= F.greatest(F.lit(1.25), F.col("_median")), names[0])
        .when(roas < 0.9, names[1])
        .when(roas.isNotNull(), names[2])
        .when(share >= 0.08, names[3])
        .when(share < 0.03, names[4])
        .otherwise(names[5])
    )
    return df.withColumn("action", action).drop("_median", "_sum")


def cohort_totals(scored: DataFrame) -> DataFrame:
    """One row: number of cohorts, lead months and sources, revenue, cost and ROAS of all."""
    facts = scored.agg(
        F.count("*").alias("cohort_count"), F.countDistinct("lead_month").alias("lead_months"),
        F.countDistinct("cohort_category").alias("sources"), F.sum("total_revenue").alias("cohort_revenue_total"),
        F.sum("cost").alias("cohort_cost_total"),
    )
    return facts.withColumn(
        "cohort_roas_total", F.col("cohort_revenue_total") / F.greatest("cohort_cost_total", F.lit(1.0))
    )


def cohort_table(scored: DataFrame, group: str = "cost_match_key") -> DataFrame:
    """Lead month x group with revenue, cost, mean ROAS, active months and share."""
    whole = scored.agg(F.sum("total_revenue").alias("_all"))
    grouped = scored.groupBy("lead_month", F.col(group).alias("cohort_category")).agg(
        F.sum("total_revenue").alias("total_revenue"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.avg("roas").alias("roas"), F.max("active_months").alias("active_months"),
    )
    share = F.col("total_revenue") / F.greatest(F.coalesce("_all", F.lit(0.0)), F.lit(1.0))
    return grouped.join(F.broadcast(whole), how="left").withColumn("revenue_share", share).drop("_all")


def latest_lead_months(df: DataFrame, months: int = 12) -> DataFrame:
    """Rows of the latest lead months; the list of months is as short as asked for."""
    latest = df.select("lead_month").distinct().orderBy(F.desc("lead_month")).limit(months)
    return df.join(F.broadcast(latest), "lead_month", "left_semi")


def platform_table(scored: DataFrame, group: str = "cost_match_key", months: int = 12) -> DataFrame:
    """Per group: all-time and latest-12-months revenue, cost and ROAS, and what to do."""
    latest = scored.select("lead_month").distinct().orderBy(F.desc("lead_month")).limit(months)
    df = scored.join(F.broadcast(latest.withColumn("_recent", F.lit(True))), "lead_month", "left")
    df = df.withColumn("_recent", F.coalesce("_recent", F.lit(False)))
    recent = F.col("_recent")
    grouped = df.groupBy(F.col(group).alias("cohort_category")).agg(
        F.sum("total_revenue").alias("total_revenue"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        F.countDistinct("lead_month").alias("cohorts"), F.sum(F.when(recent, F.col("total_revenue"))).alias("recent_revenue"),
        F.when(F.max(recent), F.coalesce(F.sum(F.when(recent, F.col("cost"))), F.lit(0.0))).alias("recent_cost"),
        F.countDistinct(F.when(recent, F.col("lead_month"))).alias("recent_cohorts"),
    )
    grouped = grouped.withColumn("roas", safe_divide("total_revenue", "total_cost"))
    grouped = grouped.withColumn("avg_revenue_per_cohort", safe_divide("total_revenue", "cohorts"))
    grouped = grouped.withColumn("recent_roas", safe_divide("recent_revenue", "recent_cost"))
    middle = [median_of(grouped, "total_revenue", "_all"), median_of(grouped, "recent_revenue", "_now")]
    rr, rev = F.col("recent_roas"), F.coalesce("recent_revenue", F.lit(0.0))
    action = (
        F.when((rr >= 1.2) & (rev >= F.col("_now")), "Scale")
        .when(rr < 0.9, "Remove / Rework")
        .when(rr.isNotNull(), "Watch")
        .when(rev > 0, "Verify Recent ROAS")
        .when(F.col("total_revenue") >= F.col("_all"), "Historical Only - Verify")
        .otherwise("Watch")
    )
    for side in middle:
        grouped = grouped.join(F.broadcast(side), how="left")
    return grouped.fillna(0.0, ["_now"]).withColumn("action", action).drop("_all", "_now")


def lead_month_rollup(scored: DataFrame) -> DataFrame:
    """Per lead month: ROAS, payback up to 100 %, maturity and the ROAS weighted by it."""
    df = scored.groupBy("lead_month").agg(
        F.sum("total_revenue").alias("total_revenue"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        F.countDistinct("cohort_category").alias("cohorts"), F.max("active_months").alias("active_months"),
    )
    roas = safe_divide("total_revenue", "total_cost")
    months = F.col("active_months")
    df = df.withColumn("roas", roas).withColumn("roas_pct", F.col("roas") * 100)
    payback = F.when(F.col("roas").isNotNull(), F.least(F.greatest(F.col("roas"), F.lit(0.0)), F.lit(1.0)) * 100)
    weight = F.when(months >= 6, 1.0).when(months >= 3, 0.75).otherwise(0.5)
    status = F.when(months >= 6, "Mature").when(months >= 3, "Growing").otherwise("Early")
    return df.select(
        "*", payback.alias("payback_pct"), status.alias("maturity_status"), weight.alias("maturity_weight"),
        (F.col("roas") * weight).alias("maturity_adjusted_roas"),
    )


def payback_curve(cohort: DataFrame, scored: DataFrame, group: str = "cost_match_key", densify: bool = False) -> DataFrame:
    """Lead month x group x age: cumulative revenue and ROAS.

    With ``densify`` ages without revenue are filled up to the group's last age.
    """
    keys = ["lead_month", "cohort_category"]
    ages = cohort.groupBy("lead_month", F.col(group).alias("cohort_category"), "cohort_age_month").agg(F.sum("revenue").alias("revenue"))
    if densify:
        span = ages.groupBy(*keys).agg(F.max("cohort_age_month").alias("_m"))
        grid = span.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_m"))).alias("cohort_age_month"))
        ages = grid.join(ages, [*keys, "cohort_age_month"], "left").withColumn("revenue", F.coalesce("revenue", F.lit(0.0)))
    cost = scored.groupBy("lead_month", F.col(group).alias("cohort_category")).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cohort_cost"))
    w = Window.partitionBy(*keys).orderBy("cohort_age_month")
    out = ages.withColumn("cumulative_revenue", F.sum("revenue").over(w)).join(cost, keys, "left")
    return out.withColumn("cumulative_roas", safe_divide("cumulative_revenue", "cohort_cost"))


def latest_payback(curve: DataFrame) -> DataFrame:
    """The oldest age of every lead month and group."""
    w = Window.partitionBy("lead_month", "cohort_category").orderBy(F.desc("cohort_age_month"))
    return curve.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def company_label(df: DataFrame, column: str = "cohort_category") -> DataFrame:
    """A table with a single group reads ``Company total``."""
    count = df.agg(F.countDistinct(column).alias("_k"))
    label = F.when(F.col("_k") <= 1, "Company total").otherwise(F.col(column))
    return df.join(F.broadcast(count), how="left").withColumn(column, label).drop("_k")


def payback_by_age(curve: DataFrame) -> DataFrame:
    """Lead month x age over all groups present at that age."""
    df = curve.groupBy("lead_month", "cohort_age_month").agg(
        F.sum("cumulative_revenue").alias("cumulative_revenue"), F.sum("cohort_cost").alias("cohort_cost")
    )
    return df.withColumn("cumulative_roas", safe_divide("cumulative_revenue", "cohort_cost"))


def time_to_break_even(by_age: DataFrame) -> DataFrame:
    """First age at which the cumulative ROAS reaches one; null where it never does."""
    first = F.min(F.when(F.col("cumulative_roas") >= 1, F.col("cohort_age_month")))
    return by_age.groupBy("lead_month").agg(first.cast("double").alias("time_to_100_roas_months"))


# Bounds of the monthly decay, decay of a single month, longest projection.
DECAY_LOW, DECAY_HIGH, DECAY_SINGLE, MAX_PROJECTION = 0.55, 0.98, 0.9, 36


def projected_break_even(by_age: DataFrame) -> DataFrame:
    """Months until break-even if revenue keeps decaying as before, by the sum of the geometric series."""
    w = Window.partitionBy("lead_month").orderBy("cohort_age_month")
    gain = F.col("cumulative_revenue") - F.coalesce(F.lag("cumulative_revenue").over(w), F.lit(0.0))
    rows = by_age.withColumn("gain", gain)
    positive = rows.filter("gain > 0").withColumn("ratio", safe_divide("gain", F.lag("gain").over(w)))
    trend = positive.groupBy("lead_month").agg(
        F.count("*").alias("months"), F.percentile("ratio", 0.5).alias("ratio"), F.max_by("gain", "cohort_age_month").alias("last_gain")
    )
    now = rows.groupBy("lead_month").agg(
        F.max_by("cumulative_revenue", "cohort_age_month").alias("revenue"), F.max_by("cohort_cost", "cohort_age_month").alias("cost")
    )
    df = now.join(trend, "lead_month", "left")
    d = F.when(F.col("months") >= 2, F.greatest(F.lit(DECAY_LOW), F.least(F.lit(DECAY_HIGH), F.col("ratio")))).otherwise(DECAY_SINGLE)
    df = df.withColumn("d", d)
    gap = F.col("cost") - F.col("revenue")
    inner = 1 - gap * (1 - F.col("d")) / (F.col("last_gain") * F.col("d"))
    steps = F.ceil(F.round(F.ln(F.when(inner > 0, inner)) / F.ln("d"), 9)).cast("double")
    months = F.when(F.coalesce("cost", F.lit(0.0)) <= 0, None).when(gap <= 0, 0.0).when(steps <= MAX_PROJECTION, steps)
    return df.select("lead_month", months.cast("double").alias("projected_time_to_100_roas_months"))


def roas_table(scored: DataFrame, cohort: DataFrame, group: str = "cost_match_key") -> DataFrame:
    """Lead-month roll-up with the reached and the projected time to break-even."""
    by_age = payback_by_age(payback_curve(cohort, scored, group))
    out = lead_month_rollup(scored).join(time_to_break_even(by_age), "lead_month", "left")
    return out.join(projected_break_even(by_age), "lead_month", "left")


def payback_summary(table: DataFrame, months: int = 12, picks: int = 3) -> DataFrame:
    """Fastest and slowest lead months among the latest ones."""
    recent = latest_lead_months(table, months)
    one = Window.partitionBy(F.lit(1))
    fast = F.row_number().over(
        one.orderBy(F.asc_nulls_last("time_to_100_roas_months"), F.desc_nulls_last("payback_pct"), F.desc("lead_month"))
    )
    slow = F.row_number().over(
        one.orderBy(
            F.desc_nulls_last("projected_time_to_100_roas_months"), F.asc_nulls_last("maturity_adjusted_roas"),
            F.asc_nulls_last("payback_pct"), F.desc("lead_month"),
        )
    )
    keep = ["lead_month", "payback_pct", "roas_pct", "maturity_adjusted_roas", "maturity_status", "active_months",
            "time_to_100_roas_months", "projected_time_to_100_roas_months"]
    a = recent.withColumn("_r", fast).filter(F.col("time_to_100_roas_months").isNotNull() & (F.col("_r") <= picks))
    b = recent.withColumn("_r", slow).filter(F.col("_r") <= picks)
    return a.select(F.lit("Fastest Payback").alias("bucket"), *keep).unionByName(b.select(F.lit("Needs Attention").alias("bucket"), *keep))


def cumulative_curves(cohort: DataFrame, months: int = 18) -> DataFrame:
    """Cumulative revenue by age of the latest lead months."""
    ages = cohort.groupBy("lead_month", "cohort_age_month").agg(F.sum("revenue").alias("revenue"))
    w = Window.partitionBy("lead_month").orderBy("cohort_age_month")
    out = ages.withColumn("cumulative_revenue", F.sum("revenue").over(w))
    return latest_lead_months(out, months)


def leading_curves(curve: DataFrame, months: int = 18, max_age: int = 18) -> DataFrame:
    """Payback curve of the largest group of each of the latest lead months."""
    latest = latest_lead_months(latest_payback(curve), months)
    w = Window.partitionBy("lead_month").orderBy(F.desc("cumulative_revenue"), F.desc_nulls_last("cumulative_roas"), "cohort_category")
    best = latest.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("lead_month", "cohort_category")
    return curve.join(F.broadcast(best), ["lead_month", "cohort_category"], "left_semi").filter(F.col("cohort_age_month") <= max_age)


def heatmap(cohort: DataFrame, size: int = 24) -> DataFrame:
    """Lead month x transaction month of the latest months of each, as rows, zero where nothing was earned."""
    cells = cohort.groupBy("lead_month", "transaction_month").agg(F.sum("revenue").alias("revenue"))
    leads = newest_first(cells.select("lead_month").distinct(), [], "lead_month").filter(F.col("rn_desc") <= size)
    txns = newest_first(cells.select("transaction_month").distinct(), [], "transaction_month").filter(F.col("rn_desc") <= size)
    kept = cells.join(F.broadcast(leads.select("lead_month")), "lead_month", "left_semi").join(
        F.broadcast(txns.select("transaction_month")), "transaction_month", "left_semi"
    )
    # at most 24 x 24 pairs of months that occur
    grid = kept.select("lead_month").distinct().crossJoin(F.broadcast(kept.select("transaction_month").distinct()))
    return grid.join(kept, ["lead_month", "transaction_month"], "left").select(
        "lead_month", "transaction_month", F.coalesce("revenue", F.lit(0.0)).alias("revenue")
    )


def heatmap_wide(cells: DataFrame) -> DataFrame:
    """The heatmap with one column per transaction month (``yyyy-MMM``)."""
    named = cells.withColumn("_txn", month_label("transaction_month"))
    return named.groupBy("lead_month").pivot("_txn").agg(F.sum("revenue")).na.fill(0.0)


