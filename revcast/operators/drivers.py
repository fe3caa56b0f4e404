"""How strongly each driver moves revenue, per driver and per source sheet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revcast.functions.frames import newest_first
from revcast.functions.scalars import correlation, safe_divide
from revcast.schema import FLAG_COLUMNS

# Columns taken for drivers unless others are named.
DRIVERS = ("leads", "cost", "spend", "clicks", "visits", "registrations", "impressions", *FLAG_COLUMNS)


def _long(daily: DataFrame, drivers: Sequence[str]) -> DataFrame:
    present = [c for c in drivers if c in daily.columns]
    cells = F.array(*[F.struct(F.lit(c).alias("driver"), F.col(c).cast("double").alias("x")) for c in present])
    return newest_first(daily, []).select("ds", "y", "rn_desc", F.explode(cells).alias("c")).select("ds", "y", "rn_desc", "c.*")


def _median(values: Column) -> Column:
    ordered = F.sort_array(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(ordered)
    middle = F.element_at(ordered, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int"))
    other = F.element_at(ordered, F.greatest(F.ceil((n + 1) / 2), F.lit(1)).cast("int"))
    return F.when(n > 0, (middle + other) / 2)


def driver_impact(daily: DataFrame, drivers: Sequence[str] = DRIVERS) -> DataFrame:
    """Correlation, elasticity, effect of relative changes, and what +10 % of a driver would bring.

    One aggregation for all drivers over the unpivoted daily history.
    """
    rows = _long(daily, drivers)
    pairs = rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    w = Window.partitionBy("driver").orderBy("ds")
    px, py = F.lag("x").over(w), F.lag("y").over(w)
    pairs = pairs.select(
        "driver", "ds", "x", "y", "rn_desc", (F.col("x") - px).alias("step"),
        F.try_divide(F.col("x") - px, px).alias("xc"), F.try_divide(F.col("y") - py, py).alias("yc"),
    )
    both = F.col("xc").isNotNull() & F.col("yc").isNotNull()
    xc, yc = F.when(both, F.col("xc")), F.when(both, F.col("yc"))
    up = (F.col("x") > 0) & (F.col("y") > 0)
    lx, ly = F.when(up, F.log1p("x")), F.when(up, F.log1p("y"))
    facts = pairs.groupBy("driver").agg(
        F.count("*").alias("n"),
        F.sum(F.abs("x")).alias("volume"),
        F.stddev_pop("x").alias("sx"),
        F.stddev_pop("y").alias("sy"),
        correlation("x", "y").alias("corr"),
        F.count(lx).alias("n_up"),
        F.countDistinct(F.when(up, F.col("x"))).alias("d_up"),
        F.regr_slope(ly, lx).alias("slope"),
        F.count(xc).alias("n_pct"),
        F.try_divide(F.covar_samp(xc, yc), F.var_pop(xc)).alias("beta"),
        F.var_pop(xc).alias("var_pct"),
        F.stddev_pop("step").alias("jump"),
        F.avg(F.when(F.col("rn_desc") <= 90, F.col("x"))).alias("recent_x"),
    )
    level = newest_first(daily, []).filter("rn_desc <= 90").agg(F.coalesce(F.avg("y"), F.lit(0.0)).alias("base_y"))
    df = facts.join(F.broadcast(level), how="left").filter(
        (F.col("base_y") > 0) & (F.col("n") >= 10) & (F.col("volume") > 0) & (F.col("sx") > 0) & (F.col("sy") > 0) & F.col("corr").isNotNull()
    )
    df = df.withColumn("elasticity", F.when((F.col("n_up") >= 12) & (F.col("d_up") >= 4), F.col("slope")))
    df = df.withColumn("pct_beta", F.when((F.col("n_pct") >= 8) & (F.col("var_pct") > 0), F.col("beta")))
    df = df.withColumn("base_x", F.coalesce("recent_x", F.lit(0.0)))
    effect = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), _median(F.array("elasticity", "pct_beta", "corr"))))
    stability = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.abs("jump") / (F.abs("base_x") + 1e-9)))
    confidence = F.abs("corr") * 0.45 + F.least(F.lit(1.0), F.col("n") / 45.0) * 0.35 + stability * 0.20
    df = df.withColumn("effect", effect).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)))
    df = df.filter((F.col("confidence") >= 0.18) & ((F.col("base_x") != 0) | F.col("driver").isin(*FLAG_COLUMNS)))
    impact = F.col("base_y") * F.col("effect") * 0.10
    c = F.col("confidence")
    return df.select(
        "driver",
        F.col("corr").alias("correlation_to_revenue"),
        F.col("elasticity").alias("elasticity_score"),
        F.col("pct_beta").alias("pct_change_beta"),
        F.col("effect").alias("effect_score"),
        c.alias("confidence_score"),
        F.col("base_x").alias("base_value_recent"),
        F.col("base_y").alias("base_revenue_recent"),
        impact.alias("revenue_change_if_driver_moves_10pct"),
        F.when(impact >= 0, "increase").otherwise("decrease").alias("suggested_direction"),
        F.when(c >= 0.75, "high").when(c >= 0.45, "medium").otherwise("low").alias("evidence_strength"),
    )


def sheet_impact(daily: DataFrame, impact: DataFrame, sheets: dict[str, Sequence[str]]) -> DataFrame:
    """The drivers of each source sheet together: strongest one, net and absolute effect, joint relation to revenue."""
    members = [(s, c) for s, cols in sheets.items() for c in cols if c in daily.columns]
    pairs = F.array(*[F.struct(F.lit(s).alias("sheet"), F.lit(c).alias("driver")) for s, c in members])
    one = daily.agg(F.count("*").alias("_")).select(F.explode(pairs).alias("m")).select("m.*")
    value = F.col("revenue_change_if_driver_moves_10pct")
    joined = one.join(F.broadcast(impact), "driver")
    grouped = joined.groupBy("sheet").agg(
        F.count("*").alias("drivers_found"),
        F.max_by("driver", F.struct(F.abs(value), "driver")).alias("strongest_driver"),
        F.max_by(value, F.struct(F.abs(value), "driver")).alias("strongest_driver_impact_10pct"),
        F.sum(value).alias("sheet_net_impact_10pct"),
        F.sum(F.abs(value)).alias("sheet_total_absolute_impact"),
        F.avg("confidence_score").alias("avg_confidence_score"),
        F.avg("correlation_to_revenue").alias("net_correlation_to_revenue"),
    )
    active = one.groupBy("sheet").agg(F.count("*").alias("active_columns"))
    rows = _long(daily, list(dict.fromkeys(c for _, c in members)))
    per = Window.partitionBy("driver")
    z = F.coalesce(safe_divide(F.col("x") - F.avg("x").over(per), F.stddev_pop("x").over(per)), F.lit(0.0))
    scored = rows.withColumn("z", z).join(F.broadcast(joined.select("sheet", "driver", "effect_score")), "driver")
    modeled = scored.groupBy("sheet", "ds").agg(
        F.sum(F.col("z") * F.col("effect_score")).alias("modeled"), F.coalesce(F.max("y"), F.lit(0.0)).alias("y")
    )
    share = modeled.groupBy("sheet").agg(F.least(F.lit(1.0), F.abs(correlation("modeled", "y"))).alias("estimated_revenue_relationship_share"))
    return (
        grouped.join(active, "sheet")
        .join(share, "sheet", "left")
        .withColumn("direction", F.when(F.col("sheet_net_impact_10pct") >= 0, "tailwind").otherwise("headwind"))
    )
