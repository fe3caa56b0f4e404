"""Time alignment, joins and allocation.

Helpers are brought to one row per key before any join, so the fact table is
read once and never fans out.  Shares per revenue row are worked out on the key
table (helper total / number of rows with that key), not by a window over the
raw rows: counting combines on the map side, so one very common key costs no
more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revcast.functions.frames import newest_first
from revcast.functions.scalars import safe_divide
from revcast.schema import COMPANY, FLAG_COLUMNS, numeric_columns

COARSENESS = {"D": 0, "W": 1, "M": 2}


def _gaps(df: DataFrame, column: str) -> DataFrame:
    """Distinct days with the distance to the previous one (never more rows than calendar days)."""
    days = df.select(F.to_date(column).alias("ds")).filter(F.col("ds").isNotNull()).distinct()
    return days.withColumn("gap", F.datediff("ds", F.lag("ds").over(Window.orderBy("ds"))))


def cadence_facts(df: DataFrame, column: str = "ds") -> DataFrame:
    """One row: usable dates, distinct days, median gap and cadence D, W or M."""
    usable = df.agg(F.count(column).alias("usable"))
    days = _gaps(df, column).agg(F.count("*").alias("days"), F.percentile("gap", 0.5).alias("median_gap"))
    cadence = (
        F.when(F.col("usable") < 2, "D")
        .when((F.col("days") < 2) | F.col("median_gap").isNull(), "M")
        .when(F.col("median_gap") <= 1.5, "D")
        .when(F.col("median_gap") <= 10, "W")
        .otherwise("M")
    )
    return usable.crossJoin(F.broadcast(days)).withColumn("cadence", cadence)


def detect_cadence(df: DataFrame, column: str = "ds") -> str:
    return cadence_facts(df, column).first()["cadence"]


def effective_frequency_facts(df: DataFrame, requested: str, column: str = "ds") -> DataFrame:
    """One row: observed cadence and the one a forecast should use instead of the requested one."""
    facts = _gaps(df, column).agg(
        F.count("*").alias("days"),
        F.percentile("gap", 0.5).alias("median_gap"),
        F.avg((F.dayofmonth("ds") <= 7).cast("int")).alias("early_share"),
    )
    gap = F.col("median_gap")
    observed = (
        F.when(F.col("days") < 3, None)
        .when(gap.between(25, 45), F.when(F.col("early_share") >= 0.75, "MS").otherwise("M"))
        .when(gap.between(5, 10), "W")
        .when(gap <= 2, "D")
    )
    wanted = requested.upper()
    family = F.substring("observed", 1, 1)
    switch = (family != wanted[:1]) | ((F.col("observed") == "MS") & F.lit(wanted == "M"))
    return facts.withColumn("observed", observed).withColumn(
        "effective", F.when(F.col("observed").isNotNull() & switch, F.col("observed")).otherwise(F.lit(wanted))
    )


def effective_frequency(df: DataFrame, requested: str) -> str:
    return effective_frequency_facts(df, requested).first()["effective"]


def aggregate_helper(df: DataFrame, keys: Sequence[str], values: Sequence[str], flags: bool = False) -> DataFrame:
    """One row per key: sums, or maxima of flags; rows with a null key go."""
    agg = F.max if flags else F.sum
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(*[agg(v).alias(v) for v in values])


def day_range(df: DataFrame, column: str = "ds") -> DataFrame:
    """One row: first and last day."""
    return df.agg(F.min(column).alias("first_day"), F.max(column).alias("last_day"))


def _calendar(groups: DataFrame, bounds: DataFrame, name: str) -> DataFrame:
    days = F.explode(F.sequence("first_day", "last_day"))
    return groups.crossJoin(F.broadcast(bounds)).select(*groups.columns, days.alias(name))


def spread_periods(
    helper: DataFrame, values: Sequence[str], dims: Sequence[str], cadence: str, column: str = "ds"
) -> DataFrame:
    """Month (or 7-day) totals divided evenly over their days; overlapping periods add up."""
    start = F.trunc(column, "MM") if cadence == "M" else F.to_date(column)
    end = F.last_day(column) if cadence == "M" else F.date_add(F.to_date(column), 6)
    totals = (
        helper.filter(F.col(column).isNotNull())
        .select(start.alias("_start"), end.alias("_end"), *dims, *values)
        .groupBy("_start", "_end", *dims)
        .agg(*[F.sum(v).alias(v) for v in values])
    )
    days = F.size(F.sequence("_start", "_end"))
    daily = totals.select(
        F.explode(F.sequence("_start", "_end")).alias(column), *dims, *[(F.col(v) / days).alias(v) for v in values]
    )
    return daily.groupBy(column, *dims).agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in values])


def anchor_ranges(
    helper: DataFrame, values: Sequence[str], dims: Sequence[str], bounds: DataFrame, column: str = "ds", carry_in: bool = False
) -> DataFrame:
    """One row per anchor of a group: the days it holds for, ``_from`` to ``_to``, and what it holds.

    A range ends the day before the group's next anchor, the last one with the last day.  The days before a group's
    first anchor are a range of nulls, so the ranges of a group cover the bounds without gap or overlap.  Each value
    is a struct: ``v`` (last known), ``d`` (its day), ``next_v`` and ``next_d`` (the next known one).  Anchors after
    the last day do not count, those before the first one only with ``carry_in``.
    """
    dims, values = list(dims), list(values)
    dated = helper.filter(F.col(column).isNotNull()).select(F.to_date(column).alias("_from"), *dims, *values).crossJoin(F.broadcast(bounds))
    within = F.col("_from") <= F.col("last_day") if carry_in else F.col("_from").between(F.col("first_day"), F.col("last_day"))
    # a group's first day is an anchor too, which holds nothing unless the helper has a row there
    opening = dated.select(*dims, "first_day", "last_day").distinct() if dims else bounds
    nothing = [F.lit(None).cast(helper.schema[v].dataType).alias(v) for v in values]
    opening = opening.select(F.col("first_day").alias("_from"), *dims, *nothing, "first_day", "last_day")
    anchors = dated.filter(within).unionByName(opening).groupBy("_from", *dims, "first_day", "last_day").agg(*[F.sum(v).alias(v) for v in values])
    order = Window.partitionBy(*(dims or [F.lit(1)])).orderBy("_from")
    past, future = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)

    def held(v: str) -> Column:
        day = F.when(F.col(v).isNotNull(), F.col("_from"))
        return F.struct(
            F.last(v, ignorenulls=True).over(past).alias("v"), F.last(day, ignorenulls=True).over(past).alias("d"),
            F.first(v, ignorenulls=True).over(future).alias("next_v"), F.first(day, ignorenulls=True).over(future).alias("next_d"),
        ).alias(v)

    until = F.coalesce(F.date_sub(F.lead("_from").over(order), 1), F.col("last_day"))
    ranges = anchors.select("_from", until.alias("_to"), *dims, *[held(v) for v in values], "first_day")
    return ranges.filter(F.col("_to") >= F.col("first_day")).withColumn("_from", F.greatest("_from", "first_day")).drop("first_day")


def _months(first: str, last: str) -> Column:
    return F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("INTERVAL 1 MONTH"))


def fill_between(ranges: DataFrame, values: Sequence[str], dims: Sequence[str], method: str, column: str = "ds", days: DataFrame | None = None) -> DataFrame:
    """The values that ``anchor_ranges`` hold on each day, or on the given ``days`` only.

    ``days`` has the day and any of the dimensions; its rows meet the range they lie in by an equi-join on the
    month and those dimensions (null equals null), so a day nobody asks for makes no row.
    """
    if days is None:
        on_days = ranges.withColumn(column, F.explode(F.sequence("_from", "_to")))
    else:
        shared = [c for c in days.columns if c != column]
        asked = days.filter(F.col(column).isNotNull()).select(F.col(column), F.trunc(column, "MM").alias("_month_asked"), *[F.col(c).alias(f"_asked_{c}") for c in shared]).distinct()
        same = (F.col("_month") == F.col("_month_asked")) & F.col(column).between(F.col("_from"), F.col("_to"))
        for c in shared:
            same &= F.col(c).eqNullSafe(F.col(f"_asked_{c}"))
        on_days = ranges.withColumn("_month", F.explode(_months("_from", "_to"))).join(asked, same)

    def filled(v: str) -> Column:
        last, step = F.col(v)["v"], F.col(v)["next_v"] - F.col(v)["v"]
        if method != "interpolate":
            return last
        part = F.datediff(column, F.col(v)["d"]) / F.datediff(F.col(v)["next_d"], F.col(v)["d"])
        return F.when(F.col(v)["d"] < F.col(column), F.coalesce(last + step * part, last)).otherwise(last)

    return on_days.select(column, *dims, *[filled(v).alias(v) for v in values])


def expand_helper(
    helper: DataFrame,
    values: Sequence[str],
    dims: Sequence[str],
    cadence: str,
    method: str,
    bounds: DataFrame,
    column: str = "ds",
    carry_in: bool = False,
    days: DataFrame | None = None,
) -> DataFrame:
    """A weekly or monthly helper on every day between the bounds, per dimension group.

    ``distribute`` and ``avg_monthly`` spread totals, ``ffill`` repeats the last
    anchor, ``interpolate`` draws a line between anchors.  Days without cover stay
    null.  With ``carry_in`` an anchor before the first day counts for ``ffill``.
    ``days`` (see ``fill_between``) asks for some days only, of the fills.
    """
    if cadence == "D":
        return helper
    dims, values = list(dims), list(values)
    if method in ("distribute", "avg_monthly"):
        groups = helper.filter(F.col(column).isNotNull()).select(*dims).distinct() if dims else bounds.select()
        grid = _calendar(groups, bounds, column)
        return grid.join(spread_periods(helper, values, dims, cadence, column), [column, *dims], "left")
    return fill_between(anchor_ranges(helper, values, dims, bounds, column, carry_in), values, dims, method, column, days)


def left_join_helper(revenue: DataFrame, helper: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Helper columns on every revenue row with the same key; ``helper`` has one row per key."""
    return revenue.join(helper, list(keys), "left")


def key_counts(revenue: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of revenue rows per key; the only thing allocation has to know about the fact table."""
    return revenue.groupBy(*keys).agg(F.count("*").alias("_rows"))


def shares(counts: DataFrame, helper: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Helper totals divided by the number of revenue rows that will receive them.

    ``counts`` may be finer than ``keys``.
    """
    counts = counts.groupBy(*keys).agg(F.sum("_rows").alias("_rows"))
    return helper.join(counts, list(keys)).select(*keys, *[(F.col(v) / F.col("_rows")).alias(v) for v in values])


def allocate_helper(
    revenue: DataFrame, helper: DataFrame, keys: Sequence[str], values: Sequence[str], counts: DataFrame | None = None
) -> DataFrame:
    """Left join that splits each helper total evenly over the rows it meets."""
    counts = key_counts(revenue, keys) if counts is None else counts
    return left_join_helper(revenue, shares(counts, helper, keys, values), keys)


def allocate_cost(revenue: DataFrame, cost: DataFrame, bucket: str | None, counts: DataFrame | None = None) -> DataFrame:
    """Cost per revenue row: from the day's bucket where that has cost, else from the company's day.

    ``cost`` has one row per (ds, bucket).  Adds ``cost`` and ``cost_bucket``.
    """
    if counts is None:
        counts = key_counts(revenue, ["ds", bucket] if bucket else ["ds"])
    company = shares(counts, aggregate_helper(cost, ["ds"], ["cost"]), ["ds"], ["cost"]).withColumnRenamed(
        "cost", "_company"
    )
    if bucket is None:
        joined = revenue.join(company, "ds", "left")
        return joined.withColumn("cost", F.col("_company")).withColumn("cost_bucket", F.lit(COMPANY)).drop("_company")
    keys = ["ds", bucket]
    own = shares(counts, aggregate_helper(cost, keys, ["cost"]), keys, ["cost"]).withColumnRenamed("cost", "_own")
    joined = revenue.join(own, keys, "left").join(company, "ds", "left")
    label = F.when(F.col("_own").isNotNull(), F.coalesce(F.col(bucket), F.lit(COMPANY))).otherwise(F.lit(COMPANY))
    return (
        joined.withColumn("cost", F.coalesce("_own", "_company")).withColumn("cost_bucket", label).drop("_own", "_company")
    )


def unallocated_cost(revenue: DataFrame, cost: DataFrame) -> DataFrame:
    """Cost on days without any revenue row: it has nothing to be shared over."""
    return cost.join(revenue.select("ds").distinct(), "ds", "left_anti")


def daily_rollup(df: DataFrame, series: str | None = None) -> DataFrame:
    """One row per day and series: numbers summed, flags by maximum, text by the first in order.

    Ratios do not add up, so ``roas`` is worked out again from the sums.
    """
    name = F.col(series).cast("string") if series else F.lit(COMPANY)
    skip = {"ds", "series_id", "category"}
    numbers = [c for c in numeric_columns(df) if c not in skip]
    texts = [c for c in df.columns if c not in skip and c not in numbers]
    aggs = []
    for c in numbers:
        aggs.append(F.max(c).alias(c) if c in FLAG_COLUMNS else F.coalesce(F.sum(c), F.lit(0)).alias(c))
    aggs += [F.min(c).alias(c) for c in texts]
    rolled = df.filter(F.col("ds").isNotNull()).groupBy(name.alias("series_id"), F.to_date("ds").alias("ds")).agg(*aggs)
    rolled = rolled.withColumn("category", F.col("series_id"))
    if {"roas", "cost", "y"} <= set(rolled.columns):
        rolled = rolled.withColumn("roas", safe_divide("y", "cost"))
    return rolled


def period_end(c: str, frequency: str) -> Column:
    """Label of the period a day falls in: the day, the Sunday, the month end or start."""
    code = frequency.upper()
    if code == "D":
        return F.to_date(c)
    if code.startswith("W"):
        return F.date_add(F.to_date(F.date_trunc("WEEK", c)), 6)
    return F.trunc(c, "MM") if code == "MS" else F.last_day(c)


def resample_target(df: DataFrame, frequency: str) -> DataFrame:
    """Sums per series and period on a full calendar; periods without rows read 0."""
    totals = df.groupBy("series_id", period_end("ds", frequency).alias("ds")).agg(
        F.coalesce(F.sum("y"), F.lit(0.0)).alias("y")
    )
    span = totals.groupBy("series_id").agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    code = frequency.upper()
    if code == "D":
        steps = F.sequence("a", "b")
    elif code.startswith("W"):
        steps = F.sequence("a", "b", F.expr("INTERVAL 7 DAYS"))
    else:
        starts = F.sequence(F.trunc("a", "MM"), F.trunc("b", "MM"), F.expr("INTERVAL 1 MONTH"))
        steps = starts if code == "MS" else F.transform(starts, lambda x: F.last_day(x))
    grid = span.select("series_id", F.explode(steps).alias("ds"))
    return grid.join(totals, ["series_id", "ds"], "left").select(
        "series_id", "ds", F.coalesce("y", F.lit(0.0)).alias("y")
    )


def to_frequency(df: DataFrame, frequency: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Sums by week (labelled by its Monday) or month (by its first day); days stay as they are."""
    code = frequency.upper()[:1]
    values = [v for v in values if v in df.columns]
    if code == "D":
        return df.select(*keys, "ds", *values)
    label = F.to_date(F.date_trunc("WEEK" if code == "W" else "MONTH", "ds"))
    return df.groupBy(*keys, label.alias("ds")).agg(*[F.sum(v).alias(v) for v in values])


def helper_daily_totals(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Daily total of a helper that was repeated on every row of its key: maximum per key, then sum."""
    per_key = df.groupBy("ds", *keys).agg(F.max(value).alias(value))
    return per_key.groupBy("ds").agg(F.sum(value).alias(value))


def mapped_rollup(df: DataFrame, date: str, value: str, grain: str = "day") -> DataFrame:
    """Totals of a raw mapped source by day or month."""
    day = F.to_date(date)
    label = F.trunc(day, "MM") if grain == "month" else day
    return df.filter(day.isNotNull()).groupBy(label.alias("ds")).agg(F.sum(value).alias(value))


def value_by_category(df: DataFrame, category: str, value: str, days: int = 30) -> DataFrame:
    """Total and recent total per category, counted back from the last day; one pass after the bounds."""
    last = df.agg(F.date_sub(F.max("ds"), days - 1).alias("_cut"))
    return (
        df.join(F.broadcast(last), how="left")
        .groupBy(F.col(category).alias("category"))
        .agg(
            F.sum(value).alias(f"{value}_total"),
            F.coalesce(F.sum(F.when(F.col("ds") >= F.col("_cut"), F.col(value))), F.lit(0.0)).alias(f"{value}_recent"),
        )
    )


def top_groups(df: DataFrame, keys: Sequence[str], rank_by: Column, top: int) -> DataFrame:
    """Rows of the ``top`` groups with the largest aggregate (ties by key)."""
    keys = list(keys)
    best = df.groupBy(*keys).agg(rank_by.alias("_rank")).orderBy(F.desc("_rank"), *keys).limit(top)
    return df.join(F.broadcast(best), keys, "left_semi")


def union_frames(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; columns a frame lacks read null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
