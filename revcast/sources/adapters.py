"""The engine's roles (revenue, leads, cost, cohort, events) on star-schema tables.

Dimension tables are joined without a broadcast hint: Spark broadcasts the side
whose statistics fall below its threshold and shuffles otherwise.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _order_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey)


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions: ds, y, platform, affiliate, campaign, ad, profile_id."""
    lineitem = table(spark, sf_dir, "lineitem")
    nation = table(spark, sf_dir, "nation")
    part = table(spark, sf_dir, "part")
    oc = _order_customer(spark, sf_dir)
    return (
        lineitem.join(oc, lineitem.l_orderkey == oc.o_orderkey)
        .join(nation, F.col("c_nationkey") == nation.n_nationkey)
        .join(part, F.col("l_partkey") == part.p_partkey)
        .select(
            F.to_date("o_orderdate").alias("ds"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"),
            F.col("c_mktsegment").alias("platform"),
            F.col("o_orderpriority").alias("affiliate"),
            F.col("n_name").alias("campaign"),
            F.col("p_brand").alias("ad"),
            F.col("o_custkey").cast("string").alias("profile_id"),
        )
    )


def revenue_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: ds, y, platform, profile_id, purchase_id."""
    return _order_customer(spark, sf_dir).select(
        F.to_date("o_orderdate").alias("ds"),
        F.col("o_totalprice").alias("y"),
        F.col("c_mktsegment").alias("platform"),
        F.col("o_custkey").cast("string").alias("profile_id"),
        F.col("o_orderkey").alias("purchase_id"),
    )


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day by platform: number of orders."""
    return (
        _order_customer(spark, sf_dir)
        .groupBy(F.to_date("o_orderdate").alias("ds"), F.col("c_mktsegment").alias("platform"))
        .agg(F.count("*").cast("double").alias("leads"))
    )


def cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month by platform: goods cost of what shipped in the month."""
    lineitem = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    oc = _order_customer(spark, sf_dir)
    return (
        lineitem.join(oc, lineitem.l_orderkey == oc.o_orderkey)
        .join(part, F.col("l_partkey") == part.p_partkey)
        .groupBy(
            F.trunc(F.to_date("l_shipdate"), "MM").alias("ds"),
            F.col("c_mktsegment").alias("platform"),
        )
        .agg(F.sum(F.col("l_quantity") * F.col("p_retailprice") * 0.01).alias("cost"))
    )


def cohort_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the month of the customer's first order: lead_month, transaction_month, revenue, platform."""
    orders = table(spark, sf_dir, "orders")
    first = orders.groupBy(F.col("o_custkey").alias("first_key")).agg(
        F.trunc(F.to_date(F.min("o_orderdate")), "MM").alias("lead_month")
    )
    oc = _order_customer(spark, sf_dir)
    return oc.join(first, oc.o_custkey == first.first_key).select(
        "lead_month",
        F.trunc(F.to_date("o_orderdate"), "MM").alias("transaction_month"),
        F.col("o_totalprice").alias("revenue"),
        F.col("c_mktsegment").alias("platform"),
    )


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day: purchases as y, sign-ups as leads, clicks, visits, and an outage flag on days with many errors."""
    def of(kind: str):
        return F.col("event_type") == kind

    daily = (
        table(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("ds"))
        .agg(
            F.sum(F.when(of("purchase"), F.col("value"))).alias("y"),
            F.count(F.when(of("signup"), 1)).cast("double").alias("leads"),
            F.count(F.when(of("click"), 1)).cast("double").alias("clicks"),
            F.count(F.when(of("view"), 1)).cast("double").alias("visits"),
            F.count(F.when(of("error"), 1)).alias("errors"),
        )
    )
    typical = daily.agg(F.percentile("errors", 0.5).alias("typical"))
    return daily.crossJoin(F.broadcast(typical)).select(
        "ds", "y", "leads", "clicks", "visits", (F.col("errors") > F.col("typical")).cast("int").alias("outage_flag")
    )


def dirty_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as somebody might upload them: money text, null tokens, padded labels, all text."""
    key = F.col("o_orderkey")
    amount = F.format_number(F.col("o_totalprice"), 2)
    money = (
        F.when(key % 11 == 0, F.lit(" n/a "))
        .when(key % 13 == 0, F.concat(F.lit("("), amount, F.lit(")")))
        .when(key % 3 == 0, F.concat(F.lit("$"), amount))
        .otherwise(amount)
    )
    segment = (
        F.when(key % 17 == 0, F.lit("NULL"))
        .when(key % 5 == 0, F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")))
        .otherwise(F.col("c_mktsegment"))
    )
    return _order_customer(spark, sf_dir).select(
        F.date_format("o_orderdate", "M/d/yyyy").alias(" Revenue Date "),
        money.alias("Revenue"),
        segment.alias("Platform"),
        F.col("o_orderpriority").alias("Campaign"),
    )
