"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Registry
from catalog.frames import COST, LEADS, REVENUE, company_daily, model_table
from revcast.operators import quality as Q
from revcast.sources import adapters as A

REG = Registry()


def _sources(spark, d):
    return {"revenue": (A.revenue(spark, d), REVENUE), "leads": (A.leads(spark, d), LEADS), "cost": (A.cost(spark, d), COST)}


@REG.add("qa01_quality_checks", "ord", """WITH q AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM ord)
  SELECT count(*) AS row_count, 0 AS null_dates, count(*) - count(y) AS null_target, min(ds) AS date_min, max(ds) AS date_max,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT ds, y FROM ord)) AS duplicate_rows,
    count(*) FILTER (y < a - 1.5 * (b - a) OR y > b + 1.5 * (b - a)) AS outlier_count,
    max(ds) - min(ds) + 1 - count(DISTINCT ds) AS missing_dates FROM ord, q""")
def qa01(spark, d):
    return Q.quality_checks(A.revenue_orders(spark, d).select("ds", "y"), "ds", "y")


@REG.add("qa01_duplicate_rows", sql="""SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicate_rows FROM lineitem""")
def qa01_dup(spark, d):
    return Q.duplicate_rows(A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"))


@REG.add("qa02_outlier_count", sql="""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
  SELECT count(*) FILTER (l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a)) AS outlier_count FROM lineitem, q""")
def qa02(spark, d):
    return Q.outlier_count(A.table(spark, d, "lineitem").select("l_extendedprice"), "l_extendedprice")


@REG.add("qa03_quality_report", "dc", """WITH f AS (SELECT *, row_number() OVER (ORDER BY ds) AS rn, count(*) OVER () AS n,
    avg(y) OVER () AS m, stddev_samp(y) OVER () AS s FROM dc),
  a AS (SELECT count(*) AS rows, count(*) - count(y) AS missing_target_values, min(ds) AS min_date, max(ds) AS max_date,
    CAST(max(ds) - min(ds) + 1 <> count(DISTINCT ds) AS INT) AS missing_dates_detected,
    count(*) FILTER (abs((y - m) / s) > 3) AS potential_outliers,
    avg(y) FILTER (rn <= n // 2) AS early_mean, avg(y) FILTER (rn > n // 2) AS late_mean FROM f)
  SELECT *, CAST(abs(late_mean - early_mean) > greatest(1, 0.35 * abs(early_mean)) AS INT) AS structural_break_warning FROM a""", rnd="early_mean late_mean")
def qa03(spark, d):
    return Q.quality_report(company_daily(spark, d))


@REG.add("qa05_missing_days", "ord", """WITH s AS (SELECT platform, min(ds) AS a, max(ds) AS b FROM ord GROUP BY 1)
  SELECT platform, CAST(g.day AS DATE) AS ds FROM s, LATERAL (SELECT unnest(generate_series(s.a, s.b, INTERVAL 1 DAY)) AS day) g
  WHERE (platform, CAST(g.day AS DATE)) NOT IN (SELECT (platform, ds) FROM ord)""")
def qa05(spark, d):
    return Q.missing_days(A.revenue_orders(spark, d), "ds", ["platform"])


@REG.add("qa06_merged_series_audit", "rev", """WITH g AS (SELECT ds, count(*) AS n, sum(y) AS y FROM rev GROUP BY 1),
  r AS (SELECT avg(y) AS m FROM (SELECT y FROM g ORDER BY ds DESC LIMIT 30))
  SELECT CAST(sum(n) AS BIGINT) AS raw_rows, count(*) AS raw_distinct_dates, CAST(sum(n) - count(*) AS BIGINT) AS raw_duplicate_date_rows,
    sum(y) AS raw_total_y, count(*) AS final_rows, sum(y) AS final_total_y, quantile_cont(y, 0.5) AS final_median_y, max(y) AS final_max_y,
    any_value(m) / avg(y) AS recent_to_history_ratio, 'company_total' AS category_mode FROM g, r""",
  rnd="raw_total_y final_total_y final_median_y final_max_y recent_to_history_ratio", digits=3)
def qa06(spark, d):
    return Q.merged_series_audit(A.revenue(spark, d))


HISTORY = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS rn FROM dm)
  SELECT series_id, count(*) AS history_rows, avg(y) AS overall_avg_y, max(leads) AS max_leads, avg(leads) AS avg_leads,
    max(cost) AS max_cost, avg(cost) AS avg_cost, avg(y) FILTER (rn <= 30) AS recent_avg_y,
    quantile_cont(y, 0.5) FILTER (rn <= 30) AS recent_median_y, max(y) FILTER (rn <= 30) AS recent_max_y,
    count(*) - count(DISTINCT ds) AS duplicate_ds_rows FROM r GROUP BY 1"""


@REG.add("qa07_history_stats", "dm", HISTORY, rnd="overall_avg_y max_leads avg_leads max_cost avg_cost recent_avg_y recent_median_y recent_max_y")
def qa07(spark, d):
    from catalog.frames import daily_model

    return Q.history_stats(daily_model(spark, d), ["series_id"])


@REG.add("qa08_health_monitor", "ord", """WITH f AS (SELECT count(DISTINCT ds) AS days, max(ds) - min(ds) AS cover, count(*) - count(DISTINCT ds) AS dup,
    count(*) - count(y) AS no_y FROM ord)
  SELECT 'History depth' AS "check", CASE WHEN days >= 90 THEN 'Healthy' ELSE 'Watch' END AS status, days::DOUBLE AS measure FROM f UNION ALL
  SELECT 'Date coverage', CASE WHEN cover >= 60 THEN 'Healthy' ELSE 'Watch' END, cover FROM f UNION ALL
  SELECT 'Missing dates', 'Healthy', 0 UNION ALL
  SELECT 'Missing target values', CASE WHEN no_y = 0 THEN 'Healthy' ELSE 'Issue' END, no_y FROM f UNION ALL
  SELECT 'Duplicate dates', CASE WHEN dup = 0 THEN 'Healthy' ELSE 'Watch' END, dup FROM f UNION ALL
  SELECT 'Forecast band width', 'Healthy', NULL""", rnd="measure")
def qa08(spark, d):
    orders = A.revenue_orders(spark, d).select("ds", "y")
    return Q.health_monitor(orders, orders.groupBy("ds").agg(F.sum("y").alias("y")))


@REG.add("qa08_health_counts", "ord", """WITH f AS (SELECT count(DISTINCT ds) AS days, max(ds) - min(ds) AS cover, count(*) - count(DISTINCT ds) AS dup, count(*) - count(y) AS no_y FROM ord),
  w AS (SELECT (days < 90)::INT + (cover < 60)::INT + (dup > 0)::INT AS w, (no_y > 0)::INT AS i FROM f)
  SELECT i AS issues, w AS watch_items, 6 - i - w AS healthy_items FROM w""")
def qa08_counts(spark, d):
    return Q.health_counts(qa08(spark, d))


@REG.add("qa09_confidence_score", "dc", """WITH f AS (SELECT count(*) AS n, coalesce(stddev_pop(y) / nullif(avg(y), 0), 1) AS r FROM dc),
  s AS (SELECT least(n / 180.0, 1)::DOUBLE AS a, greatest(0, 1 - least(r, 1.5) / 1.5)::DOUBLE AS b FROM f)
  SELECT 'History depth' AS factor, a * 100 AS score_pct FROM s UNION ALL SELECT 'Series stability', b * 100 FROM s UNION ALL
  SELECT 'Overall confidence', (a * 0.55 + b * 0.45) * 100 FROM s""", rnd="score_pct")
def qa09(spark, d):
    return Q.confidence_score(company_daily(spark, d))


@REG.add("qa10_cost_validation", "cost rev", """WITH s AS (SELECT ds AS month, platform AS bucket, sum(cost) AS monthly_cost FROM cost GROUP BY 1, 2),
  e AS (SELECT CAST(date_trunc('month', ds) AS DATE) AS month, platform AS bucket, sum(y) AS monthly_revenue FROM rev GROUP BY 1, 2),
  j AS (SELECT s.*, e.monthly_revenue, CASE WHEN e.monthly_revenue IS NULL THEN monthly_cost ELSE 0 END AS unallocated_cost
    FROM s LEFT JOIN e USING (month, bucket)),
  b AS (SELECT * FROM j UNION ALL SELECT month, 'company_total', sum(monthly_cost),
    (SELECT sum(monthly_revenue) FROM e WHERE e.month = j.month), sum(unallocated_cost) FROM j GROUP BY 1)
  SELECT month, bucket, monthly_cost, day(last_day(month)) AS days_in_month, monthly_cost / day(last_day(month)) AS daily_cost,
    monthly_cost AS recomputed_monthly_cost, monthly_revenue, monthly_revenue / nullif(monthly_cost, 0) AS roas, unallocated_cost FROM b""",
  rnd="monthly_cost daily_cost recomputed_monthly_cost monthly_revenue roas unallocated_cost")
def qa10(spark, d):
    return Q.cost_validation(A.cost(spark, d), A.revenue(spark, d))


@REG.add("qa11_dataset_info", "rev leads cost", """SELECT 'revenue' AS role, 'D' AS cadence, count(DISTINCT ds) AS days, 'distribute' AS fill_method, 0 AS resampled FROM rev
  UNION ALL SELECT 'leads', 'D', count(DISTINCT ds), 'distribute', 0 FROM leads UNION ALL SELECT 'cost', 'M', count(DISTINCT ds), 'distribute', 1 FROM cost""")
def qa11(spark, d):
    return Q.dataset_info(_sources(spark, d))


@REG.add("qa12_quality_profile", "dc", """SELECT 'weekday' AS profile, isodow(ds) - 1 AS position, avg(y) AS mean_y, count(*) AS days FROM dc GROUP BY 2
  UNION ALL SELECT 'month', month(ds), avg(y), count(*) FROM dc GROUP BY 2""", rnd="mean_y")
def qa12(spark, d):
    return Q.quality_profile(company_daily(spark, d))


@REG.add("qa13_data_model_profile", "rev leads cost", """SELECT 'revenue' AS source, count(*) AS rows, 7 AS columns, 'ds' AS join_keys FROM rev UNION ALL
  SELECT 'leads', count(*), 3, 'ds, platform' FROM leads UNION ALL SELECT 'cost', count(*), 3, 'ds, platform' FROM cost UNION ALL
  SELECT 'modeling_table', count(*), 12, 'ds' FROM rev""")
def qa13(spark, d):
    return Q.data_model_profile(_sources(spark, d), model_table(spark, d))
