"""Spending slowdown: fewer spenders, fewer purchases or smaller orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revcast.functions.frames import newest_first
from revcast.functions.scalars import safe_divide
from revcast.operators.daily import rows_of

# Age classes in days, in order.
BUCKETS = ["0-30", "31-90", "91-180", "180+", "Unknown"]


def age_bucket(age: str | Column) -> Column:
    a = F.col(age) if isinstance(age, str) else age
    return F.when(a.isNull(), BUCKETS[4]).when(a <= 30, BUCKETS[0]).when(a <= 90, BUCKETS[1]).when(a <= 180, BUCKETS[2]).otherwise(BUCKETS[3])


def user_days(orders: DataFrame, purchase: str | None = "purchase_id") -> DataFrame:
    """Member and day: revenue, distinct purchases, age since the first purchase, returning or not.

    The distinct count runs as two plain aggregations, so a very active member
    is combined before the shuffle.
    """
    rows = orders.filter("ds IS NOT NULL AND y IS NOT NULL AND profile_id IS NOT NULL")
    rows = rows.select(F.col("ds").alias("date"), F.col("profile_id").alias("member_key"), "y", *([purchase] if purchase else []))
    if purchase:
        once = rows.groupBy("date", "member_key", purchase).agg(F.sum("y").alias("y"))
        days = once.groupBy("date", "member_key").agg(F.sum("y").alias("revenue"), F.count(purchase).alias("purchases"))
    else:
        days = rows.groupBy("date", "member_key").agg(F.sum("y").alias("revenue"), F.count("*").alias("purchases"))
    first = F.min("date").over(Window.partitionBy("member_key"))
    days = days.withColumn("first_purchase_date", first)
    age = F.datediff("date", "first_purchase_date")
    return days.select("*", age.alias("user_age_days"), (age > 0).cast("int").alias("is_returning"), age_bucket(age).alias("cohort"))


def _ratios(df: DataFrame) -> DataFrame:
    return df.select(
        "*", safe_divide("revenue", "entity_count").alias("rev_per_entity"), safe_divide("purchases", "entity_count").alias("purchases_per_entity"),
        safe_divide("revenue", "purchases").alias("avg_order_value"),
    )


def daily_spend(days: DataFrame) -> DataFrame:
    """Day: active members, revenue, purchases and their ratios."""
    return _ratios(
        days.groupBy("date").agg(
            F.count("*").alias("entity_count"), F.sum("revenue").alias("revenue"), F.sum("purchases").alias("purchases")
        )
    )


def daily_spend_by_leads(table: DataFrame) -> DataFrame:
    """The same with leads in the place of members, for sources without identities."""
    rows = table.filter("ds IS NOT NULL AND y IS NOT NULL")
    return _ratios(
        rows.groupBy(F.col("ds").alias("date")).agg(
            F.coalesce(F.sum("leads"), F.lit(0.0)).alias("entity_count"), F.sum("y").alias("revenue"), F.count("*").alias("purchases")
        )
    )


def returning_daily(days: DataFrame, last: int | None = 60) -> DataFrame:
    """Day: returning spenders with their revenue and purchases, the latest days of them."""
    out = days.filter("is_returning = 1").groupBy("date").agg(
        F.count("*").alias("returning_spenders"), F.sum("revenue").alias("returning_revenue"), F.sum("purchases").alias("returning_purchases")
    )
    out = out.select(
        "*", safe_divide("returning_revenue", "returning_spenders").alias("revenue_per_returning_user"),
        safe_divide("returning_purchases", "returning_spenders").alias("purchases_per_returning_user"),
    )
    if last is None:
        return out
    return newest_first(out, [], "date").filter(F.col("rn_desc") <= last).drop("rn_desc")


def spending_cards(daily: DataFrame, returning: DataFrame) -> DataFrame:
    """One row: averages per day, total revenue, share and averages of returning spenders."""
    a = daily.agg(
        F.avg("entity_count").alias("entity_count_avg"), F.avg("rev_per_entity").alias("revenue_per_entity_avg"),
        F.avg("purchases_per_entity").alias("purchases_per_entity_avg"), F.avg("avg_order_value").alias("avg_order_value_avg"),
        F.sum("revenue").alias("total_revenue"),
    )
    b = returning.agg(
        F.sum("returning_revenue").alias("_rev"), F.avg("returning_spenders").alias("returning_spenders_avg"),
        F.avg("returning_revenue").alias("returning_revenue_avg"), F.avg("revenue_per_returning_user").alias("revenue_per_returning_user_avg"),
        F.avg("purchases_per_returning_user").alias("purchases_per_returning_user_avg"),
    )
    share = F.when(F.col("total_revenue") > 0, F.coalesce(safe_divide("_rev", "total_revenue"), F.lit(0.0))).otherwise(0.0)
    return a.join(F.broadcast(b), how="left").withColumn("returning_revenue_share", share).drop("_rev")


def decomposition(daily: DataFrame) -> DataFrame:
    """Last 7 days against the 30 before: effect of entities, frequency and order value."""
    now = F.col("rn_desc") <= 7
    rows = newest_first(daily, [], "date").filter("rn_desc <= 37")

    def both(c: str) -> list[Column]:
        # a history of a week or less is its own baseline
        base = F.coalesce(F.avg(F.when(~now, F.col(c))), F.avg(c))
        return [F.coalesce(base, F.lit(0.0)).alias(f"{c}_0"), F.coalesce(F.avg(F.when(now, F.col(c))), F.lit(0.0)).alias(f"{c}_1")]

    names = ("entity_count", "purchases_per_entity", "avg_order_value")
    row = rows.agg(*[a for n in names for a in both(n)])
    e0, e1, f0, f1, v0, v1 = (F.col(f"{n}_{i}") for n in names for i in (0, 1))
    parts = [("Entities", (e1 - e0) * f0 * v0), ("Purchase frequency", e1 * (f1 - f0) * v0), ("Order value", e1 * f1 * (v1 - v0))]
    return rows_of(row, [F.struct(F.lit(n).alias("component"), v.alias("impact_revenue")) for n, v in parts])


def age_cohorts(days: DataFrame) -> DataFrame:
    """Age class: distinct members, revenue, purchases and ratios, in class order."""
    per = days.groupBy("cohort", "member_key").agg(F.sum("revenue").alias("revenue"), F.sum("purchases").alias("purchases"))
    out = per.groupBy("cohort").agg(F.count("*").alias("users"), F.sum("revenue").alias("revenue"), F.sum("purchases").alias("purchases"))
    order = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("cohort"))
    return out.select(
        order.cast("int").alias("position"), "*", safe_divide("revenue", "users").alias("revenue_per_user"),
        safe_divide("purchases", "users").alias("purchases_per_user"),
    )
