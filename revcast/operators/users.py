"""High-value users: who carries recent revenue and whether they are slowing down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revcast.functions.scalars import dimension_value
from revcast.operators.daily import pct_change

# Lifetime revenue from which a tier starts, highest first.
TIERS = [(20000, "God Tier"), (10000, "Super User"), (5000, "Core User"), (2000, "High-Value User"), (500, "High Value")]


def whale_watch(table: DataFrame, sources: Sequence[str] = ("platform",), profile: str = "profile_id", top: int = 30) -> DataFrame:
    """The top profiles of the last 90 days with recent change, tier, status and main source.

    Profiles combine to one row each (map side first); only the few winners are
    looked at by source.
    """
    key = dimension_value(profile)
    work = table.select(key.alias("whale_id"), "ds", "y", *sources).filter("whale_id IS NOT NULL")
    last = work.agg(F.max("ds").alias("_last"))
    rows = work.join(F.broadcast(last), how="left")
    back = F.datediff("_last", "ds")
    per = rows.groupBy("whale_id").agg(
        F.sum(F.when(back <= 89, F.col("y"))).alias("trailing"),
        F.sum("y").alias("lifetime_revenue"),
        F.coalesce(F.sum(F.when(back <= 29, F.col("y"))), F.lit(0.0)).alias("recent_revenue"),
        F.coalesce(F.sum(F.when((back > 29) & (back <= 59), F.col("y"))), F.lit(0.0)).alias("prior_revenue"),
        F.min(back).alias("days_since_last_seen"),
    )
    best = per.filter("trailing IS NOT NULL").orderBy(F.desc(F.round("trailing", 4)), "whale_id").limit(top)
    parts = work.join(F.broadcast(best.select("whale_id")), "whale_id", "left_semi")
    by_source = parts.groupBy("whale_id", *sources).agg(F.sum("y").alias("_s"))
    main = by_source.groupBy("whale_id").agg(
        F.max_by(F.struct(*sources), F.struct(F.round("_s", 4), *sources)).alias("_main")
    ).select("whale_id", *[F.col(f"_main.{c}").alias(c) for c in sources])
    tier = F.lit("Emerging")
    for bound, name in reversed(TIERS):
        tier = F.when(F.col("lifetime_revenue") >= bound, name).otherwise(tier)
    delta = F.when(F.col("prior_revenue") > 0, pct_change(F.col("recent_revenue"), F.col("prior_revenue")))
    status = (
        F.when((F.col("recent_revenue") <= 0) & (F.col("prior_revenue") > 0), "Dormant")
        .when(F.col("days_since_last_seen") >= 14, "Cooling off")
        .when(delta <= -25, "At risk")
        .otherwise("Stable")
    )
    total = F.sum("recent_revenue").over(Window.partitionBy(F.lit(1)))
    out = best.select(
        "whale_id", tier.alias("whale_tier"), "lifetime_revenue", "recent_revenue", "prior_revenue", delta.alias("delta_pct"),
        (F.col("recent_revenue") / F.greatest(total, F.lit(1.0)) * 100).alias("revenue_share_pct"), "days_since_last_seen",
        status.alias("status"),
    )
    return out.join(main, "whale_id", "left").orderBy(F.desc("recent_revenue"), F.desc("lifetime_revenue"), "whale_id")
