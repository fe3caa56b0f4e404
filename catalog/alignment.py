"""Alignment, join and allocation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Registry
from catalog.frames import COST, LEADS, REVENUE, company_daily, daily_model, model_table, series_daily
from revcast.operators import align
from revcast.plans.model_table import Source, build_model_table, normalize_input
from revcast.sources import adapters as A

REG = Registry()


@REG.add("jn01_detect_cadence", "leads cost", """WITH s AS (
    SELECT 'leads' AS source, ds FROM leads UNION ALL SELECT 'cost', ds FROM cost),
  g AS (SELECT source, ds - lag(ds) OVER (PARTITION BY source ORDER BY ds) AS gap FROM (SELECT DISTINCT source, ds FROM s)),
  f AS (SELECT source, count(*) AS days, quantile_cont(gap, 0.5)::DOUBLE AS median_gap FROM g GROUP BY 1)
  SELECT source, (SELECT count(*) FROM s WHERE s.source = f.source) AS usable, days, median_gap,
    CASE WHEN median_gap <= 1.5 THEN 'D' WHEN median_gap <= 10 THEN 'W' ELSE 'M' END AS cadence FROM f""", rnd="median_gap")
def jn01(spark, d):
    return align.cadence_facts(A.leads(spark, d)).withColumn("source", F.lit("leads")).unionByName(
        align.cadence_facts(A.cost(spark, d)).withColumn("source", F.lit("cost")))


@REG.add("jn02_effective_frequency", "cost", """WITH g AS (SELECT ds, ds - lag(ds) OVER (ORDER BY ds) AS gap FROM (SELECT DISTINCT ds FROM cost)),
  f AS (SELECT count(*) AS days, quantile_cont(gap, 0.5)::DOUBLE AS median_gap, avg((day(ds) <= 7)::INT) AS early_share FROM g)
  SELECT days, median_gap, early_share, 'MS' AS observed, 'MS' AS effective FROM f
  WHERE median_gap BETWEEN 25 AND 45 AND early_share >= 0.75""", rnd="median_gap early_share")
def jn02(spark, d):
    return align.effective_frequency_facts(A.cost(spark, d), "D")


GRID = """grid AS (SELECT p.platform, CAST(c.day AS DATE) AS ds FROM (SELECT DISTINCT platform FROM cost) p,
   (SELECT unnest(generate_series((SELECT min(ds) FROM ord), (SELECT max(ds) FROM ord), INTERVAL 1 DAY)) AS day) c)"""


def _cost_expanded(spark, d, method):
    bounds = align.day_range(A.revenue_orders(spark, d))
    return align.expand_helper(A.cost(spark, d), ["cost"], ["platform"], "M", method, bounds)


@REG.add("jn03_distribute", "cost_day ord", f"WITH {GRID} SELECT g.platform, g.ds, c.cost FROM grid g LEFT JOIN cost_day c USING (platform, ds)", rnd="cost")
def jn03(spark, d):
    return _cost_expanded(spark, d, "distribute")


@REG.add("jn03_distribute_weekly", "leads", """WITH w AS (SELECT CAST(date_trunc('week', ds) AS DATE) AS ws, platform, sum(leads) AS leads FROM leads GROUP BY 1, 2)
  SELECT CAST(g.day AS DATE) AS ds, platform, leads / 7 AS leads FROM w, LATERAL (SELECT unnest(generate_series(w.ws, w.ws + 6, INTERVAL 1 DAY)) AS day) g""", rnd="leads")
def jn03_weekly(spark, d):
    weekly = align.to_frequency(A.leads(spark, d), "W", ["leads"], ["platform"])
    return align.spread_periods(weekly, ["leads"], ["platform"], "W")


@REG.add("jn04_forward_fill", "cost ord", f"""WITH {GRID} SELECT g.platform, g.ds,
  last_value(c.cost IGNORE NULLS) OVER (PARTITION BY g.platform ORDER BY g.ds) AS cost FROM grid g LEFT JOIN cost c USING (platform, ds)""", rnd="cost")
def jn04(spark, d):
    return _cost_expanded(spark, d, "ffill")


@REG.add("jn05_interpolate", "cost ord", f"""WITH {GRID}, j AS (SELECT g.platform, g.ds, c.cost,
   last_value(c.cost IGNORE NULLS) OVER p AS a, last_value(CASE WHEN c.cost IS NOT NULL THEN g.ds END IGNORE NULLS) OVER p AS da,
   first_value(c.cost IGNORE NULLS) OVER f AS b, first_value(CASE WHEN c.cost IS NOT NULL THEN g.ds END IGNORE NULLS) OVER f AS db
   FROM grid g LEFT JOIN cost c USING (platform, ds)
   WINDOW p AS (PARTITION BY g.platform ORDER BY g.ds), f AS (PARTITION BY g.platform ORDER BY g.ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT platform, ds, CASE WHEN cost IS NOT NULL THEN cost WHEN b IS NULL THEN a ELSE a + (b - a) * (ds - da) / (db - da) END AS cost FROM j""", rnd="cost")
def jn05(spark, d):
    return _cost_expanded(spark, d, "interpolate")


@REG.add("jn07_aggregate_helper", "ord", "SELECT ds, platform, sum(y) AS y FROM ord GROUP BY 1, 2", rnd="y")
def jn07(spark, d):
    return align.aggregate_helper(A.revenue_orders(spark, d), ["ds", "platform"], ["y"])


@REG.add("jn07_aggregate_flags", sql="""SELECT CAST(ts AS DATE) AS ds, event_type, max(CAST(value > 100 AS INT)) AS event_flag FROM events GROUP BY 1, 2""")
def jn07_flags(spark, d):
    ev = A.table(spark, d, "events").select(F.to_date("ts").alias("ds"), "event_type", (F.col("value") > 100).cast("int").alias("event_flag"))
    return align.aggregate_helper(ev, ["ds", "event_type"], ["event_flag"], flags=True)


@REG.add("jn08_left_join_helper", "ord cost", """SELECT purchase_id, platform, o.ds, y, c.cost FROM ord o LEFT JOIN cost c USING (ds, platform)""", rnd="y cost")
def jn08(spark, d):
    cost = align.aggregate_helper(A.cost(spark, d), ["ds", "platform"], ["cost"])
    return align.left_join_helper(A.revenue_orders(spark, d), cost, ["ds", "platform"]).drop("profile_id")


@REG.add("jn09_allocate_fan_out", "ord leads", """SELECT purchase_id, o.ds, platform, leads / count(*) OVER (PARTITION BY o.ds) AS leads
  FROM ord o JOIN (SELECT ds, sum(leads) AS leads FROM leads GROUP BY 1) l USING (ds)""", rnd="leads")
def jn09(spark, d):
    total = align.aggregate_helper(A.leads(spark, d), ["ds"], ["leads"])
    return align.allocate_helper(A.revenue_orders(spark, d).select("purchase_id", "ds", "platform"), total, ["ds"], ["leads"])


@REG.add("jn10_allocate_cost", "model", """SELECT ds, platform, cost_bucket, count(*) AS n, sum(cost) AS cost, sum(y) AS y FROM model GROUP BY 1, 2, 3""", rnd="cost y")
def jn10(spark, d):
    bounds = align.day_range(A.revenue_orders(spark, d))
    daily = align.expand_helper(A.cost(spark, d), ["cost"], ["platform"], "M", "distribute", bounds)
    out = align.allocate_cost(A.revenue(spark, d).select("ds", "platform", "y"), daily, "platform")
    return out.groupBy("ds", "platform", "cost_bucket").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.sum("y").alias("y"))


@REG.add("jn11_model_table", "model", """SELECT ds, profile_id, y, leads, cost, cost_bucket,
  'Platform=' || platform || ' | Affiliate=' || affiliate || ' | Campaign=' || campaign || ' | Ad=' || ad AS category FROM model""", rnd="y leads cost")
def jn11(spark, d):
    return model_table(spark, d).select("ds", "profile_id", "y", "leads", "cost", "cost_bucket", "category")


@REG.add("jn11_model_table_events", "rev evd", """SELECT r.ds, profile_id, r.y, platform AS category, e.outage_flag, e.clicks
  FROM rev r LEFT JOIN (SELECT * REPLACE (CAST(ds - 9000 AS DATE) AS ds) FROM evd) e USING (ds)""", rnd="y clicks")
def jn11_events(spark, d):
    from revcast.mapping import Mapping

    # the events are of 2024, the revenue of 1995 to 2001
    ev = A.events_daily(spark, d).withColumn("ds", F.date_sub("ds", 9000))
    rev = A.revenue(spark, d)
    only = Mapping("revenue", "ds", ("y",), {"category": "platform"})
    out = build_model_table(
        Source(rev, only), events=Source(ev, Mapping("events", "ds", ("outage_flag",))),
        custom=[Source(ev, Mapping("custom_1", "ds", ("clicks",), frequency="D"))])
    return out.select("ds", "profile_id", "y", F.expr("substring(category, 7)").alias("category"), "outage_flag", "clicks")


@REG.add("jn12_daily_rollup", "dm", "SELECT series_id, ds, y, leads, cost, y / nullif(cost, 0) AS roas, series_id AS category FROM dm", rnd="y leads cost roas")
def jn12(spark, d):
    m = model_table(spark, d).select("ds", "y", "platform", "leads", "cost", F.lit(0.0).alias("roas"))
    return align.daily_rollup(m, "platform").select("series_id", "ds", "y", "leads", "cost", "roas", "category")


@REG.add("jn13_normalize_input", "model", """WITH w AS (SELECT platform AS series_id, ds, sum(y) AS y, sum(leads) AS leads, coalesce(sum(cost), 0) AS cost
    FROM model WHERE ds >= (SELECT max(ds) FROM model) - 364 GROUP BY 1, 2),
  q AS (SELECT quantile_cont(leads, 0.995) AS l, quantile_cont(cost, 0.995) AS c FROM w)
  SELECT series_id, ds, y, least(leads, l) AS leads, least(cost, c) AS cost, ln(1 + least(cost, c)) AS cost_log1p FROM w, q""",
  rnd="y leads cost cost_log1p")
def jn13(spark, d):
    m = model_table(spark, d).select("ds", "y", "platform", "leads", "cost")
    return normalize_input(m, "platform", "last_365_days").select("series_id", "ds", "y", "leads", "cost", "cost_log1p")


RESAMPLE = """WITH t AS (SELECT series_id, CAST({label} AS DATE) AS ds, sum(y) AS y FROM d GROUP BY 1, 2),
  s AS (SELECT series_id, min(ds) AS a, max(ds) AS b FROM t GROUP BY 1),
  g AS (SELECT series_id, CAST({grid} AS DATE) AS ds FROM s)
  SELECT series_id, ds, coalesce(y, 0) AS y FROM g LEFT JOIN t USING (series_id, ds)"""


@REG.add("jn14_resample_daily", "d", RESAMPLE.format(label="ds", grid="unnest(generate_series(a, b, INTERVAL 1 DAY))"), rnd="y")
def jn14_d(spark, d):
    return align.resample_target(series_daily(spark, d), "D")


@REG.add("jn14_resample_weekly", "d", RESAMPLE.format(label="date_trunc('week', ds) + INTERVAL 6 DAY", grid="unnest(generate_series(a, b, INTERVAL 7 DAY))"), rnd="y")
def jn14_w(spark, d):
    return align.resample_target(series_daily(spark, d), "W")


@REG.add("jn14_resample_monthly", "d", RESAMPLE.format(label="last_day(ds)", grid="last_day(CAST(unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH)) AS DATE))"), rnd="y")
def jn14_m(spark, d):
    return align.resample_target(series_daily(spark, d), "M")


@REG.add("jn15_weekly_sums", "dc", "SELECT CAST(date_trunc('week', ds) AS DATE) AS ds, sum(y) AS y, sum(cost) AS cost FROM dc GROUP BY 1", rnd="y cost")
def jn15_w(spark, d):
    return align.to_frequency(company_daily(spark, d), "W", ["y", "cost"])


@REG.add("jn15_monthly_sums", "dm", "SELECT series_id, CAST(date_trunc('month', ds) AS DATE) AS ds, sum(y) AS y, sum(leads) AS leads FROM dm GROUP BY 1, 2", rnd="y leads")
def jn15_m(spark, d):
    return align.to_frequency(daily_model(spark, d), "M", ["y", "leads"], ["series_id"])


@REG.add("jn17_helper_daily_totals", "rev leads", """SELECT ds, sum(leads) AS leads FROM (SELECT DISTINCT ds, platform FROM rev) JOIN leads USING (ds, platform) GROUP BY 1""", rnd="leads")
def jn17(spark, d):
    repeated = align.left_join_helper(A.revenue(spark, d).select("ds", "platform"), A.leads(spark, d), ["ds", "platform"])
    return align.helper_daily_totals(repeated, "leads", ["platform"])


@REG.add("jn18_mapped_rollups", "ord", """SELECT 'day' AS grain, ds, sum(y) AS y FROM ord GROUP BY 2 UNION ALL
  SELECT 'month', CAST(date_trunc('month', ds) AS DATE), sum(y) FROM ord GROUP BY 2""", rnd="y")
def jn18(spark, d):
    orders = A.revenue_orders(spark, d)
    return align.mapped_rollup(orders, "ds", "y").withColumn("grain", F.lit("day")).unionByName(
        align.mapped_rollup(orders, "ds", "y", "month").withColumn("grain", F.lit("month")))


@REG.add("jn19_value_by_category", "leads", """SELECT platform AS category, sum(leads) AS leads_total,
  coalesce(sum(leads) FILTER (ds >= (SELECT max(ds) FROM leads) - 29), 0) AS leads_recent FROM leads GROUP BY 1""", rnd="leads_total leads_recent")
def jn19(spark, d):
    return align.value_by_category(A.leads(spark, d), "platform", "leads")


@REG.add("jn23_union_frames", "leads cost", """SELECT ds, platform, leads, NULL::DOUBLE AS cost FROM leads UNION ALL SELECT ds, platform, NULL, cost FROM cost""", rnd="leads cost")
def jn23(spark, d):
    return align.union_frames(A.leads(spark, d), A.cost(spark, d))


@REG.add("jn24_top_groups", "ord", """SELECT ds, profile_id, purchase_id, y FROM ord WHERE profile_id IN (
  SELECT profile_id FROM ord GROUP BY 1 ORDER BY round(sum(y), 2) DESC, 1 LIMIT 30)""", rnd="y")
def jn24(spark, d):
    return align.top_groups(A.revenue_orders(spark, d).drop("platform"), ["profile_id"], F.round(F.sum("y"), 2), 30)
