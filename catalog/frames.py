"""Frames several registered queries start from, built by the library on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.mapping import Mapping
from revcast.operators import align
from revcast.plans.model_table import Source, build_model_table
from revcast.session import cut
from revcast.sources import adapters as A

REVENUE = Mapping("revenue", "ds", ("y",), {"platform": "platform", "affiliate": "affiliate", "campaign": "campaign", "ad": "ad"})
LEADS = Mapping("leads", "ds", ("leads",), {"platform": "platform"}, frequency="D")
COST = Mapping("cost", "ds", ("cost",), {"platform": "platform"}, frequency="M")


def model_table(spark, d) -> DataFrame:
    """Transactions with allocated leads and cost."""
    return build_model_table(
        Source(A.revenue(spark, d), REVENUE), Source(A.leads(spark, d), LEADS), Source(A.cost(spark, d), COST),
        validate=False,
    )


def daily_model(spark, d) -> DataFrame:
    """Day and platform: y, leads, cost."""
    rolled = align.daily_rollup(model_table(spark, d).select("ds", "y", "platform", "leads", "cost"), "platform")
    return cut(rolled.select("series_id", "ds", "y", "leads", "cost"))


def company_daily(spark, d) -> DataFrame:
    """Day: y, leads, cost of the company."""
    return daily_model(spark, d).groupBy("ds").agg(*[F.sum(c).alias(c) for c in ("y", "leads", "cost")])


def series_daily(spark, d) -> DataFrame:
    """Day and platform: y only, so that just three tables are read."""
    return A.revenue(spark, d).groupBy(F.col("platform").alias("series_id"), "ds").agg(F.sum("y").alias("y"))
