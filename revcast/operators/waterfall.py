"""Why revenue moved: bridges from the level before to the current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcast.functions.frames import newest_first
from revcast.functions.quantiles import median_of
from revcast.operators.daily import rows_of


def _bridge(row: DataFrame, parts: list[tuple[str, Column]]) -> DataFrame:
    start, end = F.coalesce("start", F.lit(0.0)), F.coalesce("end", F.lit(0.0))
    explained = sum((v for _, v in parts), F.lit(0.0))
    items = [("Starting revenue", start, "anchor"), *[(n, v, "delta") for n, v in parts]]
    items += [("Other / unexplained", end - start - explained, "delta"), ("Current revenue", end, "anchor")]
    return rows_of(
        row,
        [
            F.struct(F.lit(i).alias("position"), F.lit(n).alias("component"), v.alias("impact"), F.lit(k).alias("kind"))
            for i, (n, v, k) in enumerate(items)
        ],
    )


def _mix(shares: DataFrame) -> DataFrame:
    """One row: change of the shares weighted by each part's distance from the median ROAS."""
    ref = median_of(shares, "roas", "_ref")
    gap = (F.col("now") - F.col("before")) * (F.coalesce("roas", "_ref") - F.col("_ref"))
    return shares.join(F.broadcast(ref), how="left").agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("mix"))


def leads_waterfall(daily: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Last 7 rows against the 28 before: lead volume, revenue per lead, platform mix."""
    now = F.col("rn_desc") <= 7
    row = newest_first(daily, []).filter("rn_desc <= 35").agg(
        F.avg(F.when(~now, F.col("y"))).alias("start"),
        F.avg(F.when(now, F.col("y"))).alias("end"),
        F.avg(F.when(~now, F.col("leads"))).alias("l0"),
        F.avg(F.when(now, F.col("leads"))).alias("l1"),
        F.avg(F.when(~now, F.col("revenue_per_lead"))).alias("r0"),
        F.avg(F.when(now, F.col("revenue_per_lead"))).alias("r1"),
    )
    if summary is None:
        row = row.withColumn("mix", F.lit(0.0))
    else:
        recent = F.coalesce("recent_revenue", F.lit(0.0))
        total = summary.agg(F.sum(recent).alias("_total"))
        shares = summary.join(F.broadcast(total), how="left").select(
            F.try_divide(recent, "_total").alias("now"), F.coalesce("share_of_revenue", F.lit(0.0)).alias("before"),
            F.col("recent_roas").alias("roas"),
        )
        row = row.join(F.broadcast(_mix(shares)), how="left")
    zero = F.lit(0.0)
    return _bridge(
        row,
        [
            ("Lead volume impact", F.coalesce((F.col("l1") - F.col("l0")) * F.col("r0"), zero)),
            ("Revenue per lead impact", F.coalesce(F.col("l1") * (F.col("r1") - F.col("r0")), zero)),
            ("Platform mix impact", F.coalesce(F.col("mix") * F.greatest(F.col("start"), zero), zero)),
        ],
    )


def cohort_waterfall(cohort: DataFrame, roas: DataFrame | None = None) -> DataFrame:
    """Latest transaction month against the three before: new cohorts, older cohorts, mix.

    ``roas`` (cohort_category, roas) gives the mix its weight; plain share changes
    add up to zero and would say nothing.
    """
    per = cohort.groupBy("transaction_month", "cohort_category").agg(
        F.sum("revenue").alias("rev"),
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.when(F.col("cohort_age_month") == 0, F.col("revenue"))), F.lit(0.0)).alias("new"),
        F.coalesce(F.sum(F.when(F.col("cohort_age_month") > 0, F.col("revenue"))), F.lit(0.0)).alias("old"),
    )
    months = per.groupBy("transaction_month").agg(*[F.sum(c).alias(c) for c in ("rev", "new", "old")])
    ranked = newest_first(months, [], "transaction_month").filter("rn_desc <= 4")
    now = F.col("rn_desc") == 1
    row = ranked.agg(
        *[F.max(F.when(now, F.col(c))).alias(f"{c}1") for c in ("rev", "new", "old")],
        *[F.avg(F.when(~now, F.col(c))).alias(f"{c}0") for c in ("rev", "new", "old")],
    ).withColumn("start", F.col("rev0")).withColumn("end", F.col("rev1"))
    if roas is None:
        row = row.withColumn("mix", F.lit(0.0))
    else:
        recent = per.join(F.broadcast(ranked.select("transaction_month", "rn_desc")), "transaction_month")
        parts = recent.groupBy("cohort_category").agg(
            F.coalesce(F.sum(F.when(now, F.col("rev"))), F.lit(0.0)).alias("a"),
            F.coalesce(F.try_divide(F.sum(F.when(~now, F.col("rev"))), F.sum(F.when(~now, F.col("n")))), F.lit(0.0)).alias("b"),
        )
        joined = parts.join(roas, "cohort_category", "left")
        sums = joined.agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
        shares = joined.join(F.broadcast(sums), how="left").select(F.try_divide("a", "_a").alias("now"), F.try_divide("b", "_b").alias("before"), "roas")
        row = row.join(F.broadcast(_mix(shares)), how="left")
    return _bridge(
        row,
        [
            ("New cohort impact", F.col("new1") - F.col("new0")),
            ("Older cohort maturation", F.col("old1") - F.col("old0")),
            ("Platform mix impact", F.coalesce(F.col("mix") * F.greatest(F.col("start"), F.lit(0.0)), F.lit(0.0))),
        ],
    )


def waterfall_reading(bridge: DataFrame) -> DataFrame:
    """One row: the largest drag and lift, and whether revenue improves, slips or stays flat."""
    delta = F.col("kind") == "delta"
    row = bridge.agg(
        F.max(F.when(F.col("component") == "Starting revenue", F.col("impact"))).alias("start"),
        F.max(F.when(F.col("component") == "Current revenue", F.col("impact"))).alias("end"),
        F.min_by(F.when(delta, F.col("component")), F.when(delta, F.col("impact"))).alias("drag"),
        F.min(F.when(delta, F.col("impact"))).alias("drag_value"),
        F.max_by(F.when(delta, F.col("component")), F.when(delta, F.col("impact"))).alias("lift"),
        F.max(F.when(delta, F.col("impact"))).alias("lift_value"),
    )
    change = F.col("end") - F.col("start")
    clear = F.abs(change) >= F.greatest(F.abs("start") * 0.01, F.lit(250.0))
    return row.select(
        "start", "end", F.when(F.col("drag_value") < 0, F.col("drag")).alias("main_drag"),
        F.when(F.col("lift_value") > 0, F.col("lift")).alias("main_lift"),
        F.when(clear & (change > 0), "improving").when(clear, "slipping").otherwise("flat").alias("takeaway"),
    )
