"""Budget moves, planning baselines and scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revcast.functions.frames import first_rows, newest_first
from revcast.functions.quantiles import median_of
from revcast.functions.ranking import running
from revcast.functions.scalars import dimension_value, safe_divide
from revcast.operators.daily import pct_change, rows_of


def portfolio(daily: DataFrame) -> DataFrame:
    """One row: recent against overall ROAS and the budget that follows from it."""
    rows = newest_first(daily, [])
    recent = F.col("rn_desc") <= 30

    def total(c: str, only_recent: bool) -> Column:
        value = F.when(F.col("cost") != 0, F.col("cost")) if c == "cost" else F.col(c)
        return F.sum(F.when(recent, value)) if only_recent else F.sum(value)

    facts = rows.agg(
        F.try_divide(total("y", True), total("cost", True)).alias("recent_roas"),
        F.try_divide(total("y", False), total("cost", False)).alias("overall_roas"),
        F.coalesce(F.avg(F.when(recent, F.col("cost"))), F.lit(0.0)).alias("avg_daily_spend"),
    )
    up, down = F.col("recent_roas") > F.col("overall_roas") * 1.05, F.col("recent_roas") < F.col("overall_roas") * 0.95
    action = F.when(up, "Increase budget 10%").when(down, "Trim budget 10%").otherwise("Hold")
    budget = F.col("avg_daily_spend") * 30 * F.when(up, 1.10).when(down, 0.90).otherwise(1.0)
    return facts.select(
        F.lit("Overall portfolio").alias("segment"), "*", budget.alias("suggested_monthly_budget"), action.alias("action")
    )


def allocation(summary: DataFrame, top: int | None = None) -> DataFrame:
    """Per category: what 10 % more of its recent spend would bring at its recent ROAS."""
    cost = F.coalesce("recent_cost", F.lit(0.0))
    roas = F.when(cost > 0, F.col("recent_roas"))
    df = summary.select("category", "recent_revenue", "recent_cost", roas.alias("recent_roas"))
    extra = cost * 0.10
    added = extra * F.coalesce("recent_roas", F.lit(0.0))
    revenue = F.coalesce("recent_revenue", F.lit(0.0))
    middle = df.select("recent_roas", F.when(revenue > 0, revenue).alias("sold"))
    sides = [median_of(middle, c, n) for c, n in (("recent_roas", "_roas"), ("sold", "_rev"))]
    action = (
        F.when(cost <= 0, "Verify cost tracking")
        .when(F.col("recent_roas").isNull(), "Verify Recent ROAS")
        .when((F.col("recent_roas") >= F.greatest(F.lit(1.2), F.col("_roas"))) & (revenue >= F.col("_rev")), "Add budget")
        .when(F.col("recent_roas") < 1, "Hold / rework")
        .otherwise("Hold / review")
    )
    for side in sides:
        df = df.join(F.broadcast(side), how="left")
    out = df.fillna(0.0, ["_roas", "_rev"]).select(
        "category", "recent_revenue", "recent_cost", "recent_roas", extra.alias("extra_budget_10pct"),
        added.alias("projected_revenue_from_extra_budget"), (revenue + added).alias("projected_total_revenue_after_shift"),
        action.alias("budget_action"),
    )
    return first_rows(out.orderBy(F.desc("projected_revenue_from_extra_budget"), "category"), top)


# What a budget recommendation says.
VERIFY, REWORK, TRIM = "Verify status; recent ROAS is unavailable", "Reduce or rework", "Hold or trim"
REDUCE, SCALE, SUPPORT, HOLD = "Reduce budget and inspect funnel", "Scale carefully", "Support momentum", "Hold flat"


def dimension_budget(table: DataFrame, dimensions: dict[str, str], top: int | None = None) -> DataFrame:
    """Budget shift per value of each dimension: last 30 days against the 30 before.

    ``dimensions`` maps a label to a column, in order of preference.
    Only the last 60 days of rows are unpivoted.
    """
    dims = list(dimensions.items())
    clean = {label: dimension_value(c) for label, c in dims}
    last = table.agg(*[F.max(F.when(clean[label].isNotNull(), F.col("ds"))).alias(f"_last_{i}") for i, (label, _) in enumerate(dims)])
    oldest = F.least(*[F.col(f"_last_{i}") for i in range(len(dims))]) if len(dims) > 1 else F.col("_last_0")
    helpers = [c for c in ("cost", "leads") if c in table.columns]
    rows = table.join(F.broadcast(last), F.col("ds") >= F.date_sub(oldest, 59))
    cells = F.array(
        *[
            F.struct(F.lit(label).alias("dimension_type"), clean[label].alias("name"), F.col(f"_last_{i}").alias("last"))
            for i, (label, _) in enumerate(dims)
        ]
    )
    long = rows.select("ds", "y", *helpers, F.explode(cells).alias("c")).select("ds", "y", *helpers, "c.*")
    long = long.filter(F.col("name").isNotNull())
    recent = F.col("ds") >= F.date_sub("last", 29)
    prior = (F.col("ds") >= F.date_sub("last", 59)) & ~recent
    grouped = long.groupBy("dimension_type", "name").agg(
        F.count(F.when(recent, 1)).alias("_n"),
        F.sum(F.when(recent, F.col("y"))).alias("recent_revenue"),
        F.coalesce(F.sum(F.when(prior, F.col("y"))), F.lit(0.0)).alias("prior_revenue"),
        *[F.sum(F.when(recent, F.col(c))).alias(f"recent_{c}") for c in helpers],
    ).filter("_n > 0")
    kind = Window.partitionBy("dimension_type")
    none = F.lit(None).cast("double")
    whole = grouped.groupBy("dimension_type").agg(F.sum("recent_revenue").alias("_all"))
    df = grouped.join(F.broadcast(whole), "dimension_type").select(
        "dimension_type", "name", "recent_revenue", "prior_revenue",
        pct_change(F.col("recent_revenue"), F.col("prior_revenue")).alias("delta_pct"),
        (safe_divide("recent_revenue", "recent_cost") if "cost" in helpers else none).alias("recent_roas"),
        (safe_divide("recent_revenue", "recent_leads") if "leads" in helpers else none).alias("recent_rpl"),
        (F.col("recent_revenue") / F.greatest(F.coalesce("_all", F.lit(0.0)), F.lit(1.0))).alias("share"),
    )
    rank = F.row_number().over(kind.orderBy(F.desc("recent_revenue"), F.asc_nulls_last("delta_pct"), "name"))
    df = df if top is None else df.withColumn("_rank", rank).filter(F.col("_rank") <= top)
    roas, delta, share = F.col("recent_roas"), F.col("delta_pct"), F.col("share")

    def ladder(*values):
        return (
            F.when(roas.isNull(), values[0])
            .when(roas < 0.85, values[1])
            .when(roas < 1.0, values[2])
            .when(delta <= -18, values[3])
            .when((roas >= 1.25) & (delta.isNull() | (delta >= -5)), values[4])
            .when(delta >= 12, values[5])
            .otherwise(values[6])
        )

    shift = ladder(
        F.lit(0), F.when(share >= 0.08, -15).otherwise(-10), F.when(share >= 0.12, -10).otherwise(0),
        F.when(share >= 0.18, -15).otherwise(-10), F.when(share < 0.3, 12).otherwise(8), F.lit(8), F.lit(0),
    )
    action = ladder(*[F.lit(t) for t in (VERIFY, REWORK, TRIM, REDUCE, SCALE, SUPPORT, HOLD)])
    out = df.select(
        "dimension_type", "name", "recent_revenue", "prior_revenue", "delta_pct", "recent_roas", "recent_rpl",
        (share * 100).alias("revenue_share"), shift.alias("recommended_budget_shift_pct"), action.alias("action"),
    )
    return first_rows(out.orderBy(F.desc(F.abs("recommended_budget_shift_pct")), F.desc("recent_revenue"), "dimension_type", "name"), top)


def attribution(summary: DataFrame, top: int | None = None) -> DataFrame:
    """Largest channels with share, efficiency and stability; rank 1 is the top channel."""
    df = running(summary, [F.desc("total_revenue"), F.col("category")]).withColumn("rank", F.col("before") + 1)
    df = df if top is None else df.filter(F.col("rank") <= top)
    return df.select(
        "rank", F.col("category").alias("channel"), F.col("total_revenue").alias("revenue"),
        (F.col("share_of_revenue") * 100).alias("revenue_share_pct"), F.when(F.col("total_cost") > 0, F.col("roas")).alias("roas"),
        F.when(F.col("recent_cost") > 0, F.col("recent_roas")).alias("recent_roas"), "rev_per_lead", "total_cost",
        "recent_revenue", "recent_cost", "stability_score",
    )


def planning_profile(
    daily: DataFrame, raw_leads: DataFrame | None = None, raw_cost: DataFrame | None = None, last: int = 18, complete_only: bool = False
) -> DataFrame:
    """Last months: revenue, leads, cost and the ratios a plan starts from.

    Monthly totals of the raw sheets (month, leads / cost) win over the allocated
    ones.  With ``complete_only`` a month that is still running is left out.
    """
    month = F.trunc("ds", "MM").alias("month")
    helpers = {c: raw for c, raw in (("leads", raw_leads), ("cost", raw_cost))}
    own = [c for c, raw in helpers.items() if raw is None and c in daily.columns]
    out = daily.groupBy(month).agg(F.sum("y").alias("revenue"), *[F.sum(c).alias(c) for c in own], F.max("ds").alias("_last"))
    for c, raw in helpers.items():
        if raw is not None:
            out = out.join(raw.select("month", c), "month", "left")
    if complete_only:
        out = out.filter(F.col("_last") == F.last_day("month"))
    ratios = {}
    if "leads" in out.columns:
        ratios["revenue_per_lead"] = safe_divide("revenue", "leads")
    if "cost" in out.columns:
        ratios["roas"] = safe_divide("revenue", "cost")
    if {"leads", "cost"} <= set(out.columns):
        ratios["leads_per_dollar"] = safe_divide("leads", "cost")
        ratios["cost_per_lead"] = safe_divide("cost", "leads")
    out = out.select("*", *[v.alias(k) for k, v in ratios.items()]).drop("_last")
    return newest_first(out, [], "month").filter(F.col("rn_desc") <= last).drop("rn_desc")


def planning_baseline(profile: DataFrame) -> DataFrame:
    """One row: the latest month of a planning profile."""
    return profile.orderBy(F.desc("month")).limit(1)


# Scenario, budget, lead and quality multipliers.
SCENARIOS = [
    ("Downside", 0.92, 0.95, 0.97),
    ("Expected", 1.00, 1.00, 1.00),
    ("Scale Efficient Channels", 1.08, 1.05, 1.03),
    ("Lead Quality Lift", 1.00, 1.04, 1.08),
    ("Aggressive Growth", 1.15, 1.12, 1.05),
]


def scenario_table(baseline: DataFrame) -> DataFrame:
    """What-if results of the latest month (revenue, cost, leads, revenue_per_lead)."""
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("scenario"), F.lit(b).alias("b"), F.lit(q1).alias("l"), F.lit(q).alias("q"))
            for n, b, q1, q in SCENARIOS
        ]
    )
    zero = F.lit(0.0)
    df = baseline.select(
        F.coalesce("revenue", zero).alias("rev"), F.coalesce("cost", zero).alias("cost"), F.coalesce("leads", zero).alias("leads"),
        F.coalesce("revenue_per_lead", zero).alias("rpl"), F.explode(cells).alias("s"),
    ).select("rev", "cost", "leads", "rpl", "s.*")
    base = F.greatest(F.col("rev"), F.col("rpl") * F.col("leads"))
    revenue = base * F.col("q") * (0.55 + 0.45 * F.col("l")) * F.when(F.col("cost") > 0, 0.65 + 0.35 * F.col("b")).otherwise(1.0)
    spend = F.col("cost") * F.col("b")
    return df.select(
        "scenario", spend.alias("projected_spend"), (F.col("leads") * F.col("l")).alias("projected_leads"),
        revenue.alias("projected_revenue"), F.when(spend > 0, revenue / spend).alias("projected_roas"),
    )


def scenario_comparison(daily: DataFrame, forecast: DataFrame) -> DataFrame:
    """Run-rate, P10, P50 and P90: level per period, total and distance from the expected level."""
    run = newest_first(daily, []).filter("rn_desc <= 30").agg(F.coalesce(F.avg("y"), F.lit(0.0)).alias("run"))
    f = forecast.agg(
        F.greatest(F.count("*"), F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"{c}_avg") for c in ("conservative", "expected", "aggressive")],
        *[F.sum(c).alias(f"{c}_sum") for c in ("conservative", "expected", "aggressive")],
    )

    def row(name: str, level: Column, total: Column, pct: Column | None = None) -> Column:
        return F.struct(
            F.lit(name).alias("scenario"), level.alias("avg_period_revenue"), total.alias("total_revenue"),
            (pct if pct is not None else pct_change(level, F.col("expected_avg"))).alias("vs_expected_pct"),
        )

    return rows_of(
        run.join(F.broadcast(f), how="left"),
        [
            row("Current run-rate", F.col("run"), F.col("run") * F.col("n")),
            row("Conservative (P10)", F.col("conservative_avg"), F.col("conservative_sum")),
            row("Expected (P50)", F.col("expected_avg"), F.col("expected_sum"), F.lit(0.0)),
            row("Aggressive (P90)", F.col("aggressive_avg"), F.col("aggressive_sum")),
        ],
    )


def supported_revenue(daily: DataFrame) -> DataFrame:
    """One row: revenue of the next 30 and 60 days that recent lead flow already supports."""
    facts = newest_first(daily, []).filter("rn_desc <= 30").agg(
        F.coalesce(F.avg("leads"), F.lit(0.0)).alias("avg_leads"),
        F.try_divide(F.sum(F.greatest("y", F.lit(0.0))), F.sum(F.greatest("leads", F.lit(0.0)))).alias("revenue_per_lead"),
    )
    rpl = F.coalesce("revenue_per_lead", F.lit(0.0))
    return facts.select(
        "avg_leads", "revenue_per_lead", (F.col("avg_leads") * 30 * rpl * 0.65).alias("supported_30_days"),
        (F.col("avg_leads") * 60 * rpl * 0.90).alias("supported_60_days"),
    )


def early_warnings(tracked: DataFrame, recommendations: DataFrame, whales: DataFrame, top: int | None = None) -> DataFrame:
    """Rules over tracked metrics, the leading budget rows and the leading users; worst first."""

    def metric(name: str) -> Column:
        return F.max(F.when(F.col("metric") == name, F.col("delta_pct")))

    t = tracked.agg(
        metric("Revenue").alias("rev"), metric("Lead volume").alias("leads"), metric("Revenue per lead").alias("rpl"),
        metric("ROAS").alias("roas"), metric("Spend").alias("cost"),
    )

    def rule(hit: Column, level: str, signal: str, name: str, value: Column, score: Column) -> Column:
        severity = F.round(F.least(F.lit(100.0), score), 1)
        return F.when(
            hit,
            F.struct(F.lit(level).alias("level"), F.lit(signal).alias("signal"), F.lit(name).alias("metric"),
                     value.alias("delta_pct"), severity.alias("severity_score")),
        )

    rev, cost = F.col("rev"), F.col("cost")
    rules = [
        rule(rev <= -10, "warning", "Revenue downshift", "Revenue", rev, F.abs(rev) * 2.2),
        rule(rev >= 12, "info", "Revenue acceleration", "Revenue", rev, F.abs(rev) * 1.7),
        rule(F.col("leads") <= -12, "warning", "Lead volume compression", "Leads", F.col("leads"), F.abs("leads") * 2.0),
        rule(F.col("rpl") <= -8, "warning", "Lead quality / monetization softness", "Revenue per lead", F.col("rpl"), F.abs("rpl") * 2.1),
        rule(F.col("roas") <= -8, "warning", "Efficiency pressure", "ROAS", F.col("roas"), F.abs("roas") * 2.1),
        rule((cost >= 12) & (rev < 6), "warning", "Spend rising faster than revenue", "Spend", cost,
             (cost - F.greatest(rev, F.lit(0.0))) * 2.0),
    ]
    general = t.select(F.explode(F.array(*rules)).alias("r")).filter("r IS NOT NULL").select("r.*")
    segments = recommendations.filter(F.col("delta_pct") <= -15).select(
        F.lit("warning").alias("level"), F.concat(F.col("dimension_type"), F.lit(" pressure: "), F.col("name")).alias("signal"),
        F.col("dimension_type").alias("metric"), "delta_pct",
        F.round(F.least(F.lit(100.0), F.abs("delta_pct") * F.when(F.col("revenue_share") >= 10, 1.4).otherwise(1.0)), 1).alias("severity_score"),
    )
    users = whales.filter(F.col("delta_pct") <= -20).select(
        F.lit("warning").alias("level"), F.concat(F.lit("User softening: "), F.col("whale_id")).alias("signal"),
        F.lit("Users").alias("metric"), "delta_pct", F.round(F.least(F.lit(100.0), F.abs("delta_pct") * 1.8), 1).alias("severity_score"),
    )
    return first_rows(general.unionByName(segments).unionByName(users).orderBy(F.desc("severity_score"), "level", "signal"), top)


def dimension_columns(columns: Sequence[str]) -> dict[str, str]:
    """Budget dimensions a table offers, in order of preference."""
    order = [("Campaign", "campaign"), ("Ad", "ad"), ("Affiliate", "affiliate"), ("Platform", "platform"), ("Category", "category")]
    return {label: c for label, c in order if c in columns}
