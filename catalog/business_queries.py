"""Business analytics over the joined table and the daily history."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Registry, view
from catalog.frames import company_daily, model_table
from revcast.operators import baselines, cohort, daily, drivers, planning, quality, stats, users, waterfall
from revcast.operators.align import mapped_rollup, value_by_category
from revcast.session import cut
from revcast.sources import adapters as A

REG = Registry()
NAMES = "conservative expected aggressive"

view("hd", """SELECT ds, y, leads, cost, greatest(y, 0) / nullif(cost, 0) AS roas, greatest(y, 0) / nullif(leads, 0) AS revenue_per_lead FROM dc""", "dc")
view("hr", "SELECT *, row_number() OVER (ORDER BY ds DESC) AS rn FROM hd", "hd")
view("fc", """SELECT CAST(last + s.step AS DATE) AS ds, a AS expected, a * 0.92::DOUBLE AS conservative, a * 1.08::DOUBLE AS aggressive
  FROM (SELECT max(ds) AS last, avg(y) FILTER (rn <= 30) AS a FROM hr), (SELECT CAST(unnest(range(1, 31)) AS INT) AS step) s""", "hr")
view("months", "SELECT CAST(date_trunc('month', ds) AS DATE) AS month, sum(y) AS revenue, sum(leads) AS leads, sum(cost) AS cost FROM hd GROUP BY 1", "hd")
view("ssum", """WITH g AS (SELECT platform AS category, sum(y) AS total_revenue, count(DISTINCT ds) AS periods, avg(y) AS avg_daily, stddev_pop(y) AS volatility,
    sum(y) FILTER (r) AS recent_revenue, count(DISTINCT ds) FILTER (r) AS recent_days, avg(y) FILTER (r) AS recent_avg_daily, sum(leads) AS total_leads,
    coalesce(sum(cost), 0) AS total_cost, sum(leads) FILTER (r) AS recent_leads, sum(cost) FILTER (r) AS recent_cost
    FROM (SELECT *, ds >= (SELECT max(ds) FROM rev) - 29 AS r FROM model) GROUP BY 1)
  SELECT *, greatest(total_revenue, 0) / nullif(total_leads, 0) AS rev_per_lead, CASE WHEN total_cost > 0 THEN total_revenue / total_cost END AS roas,
    CASE WHEN recent_cost > 0 THEN recent_revenue / recent_cost END AS recent_roas, total_revenue / greatest(sum(total_revenue) OVER (), 1) AS share_of_revenue,
    coalesce(avg_daily / nullif(volatility, 0), 0) AS stability_score FROM g""", "model rev")
view("track", """WITH f AS (SELECT {a} FROM hr WHERE rn <= 35) SELECT * FROM ({u})""".format(
    a=", ".join(f"avg({c}) FILTER (rn <= 7) AS {c}_n, avg({c}) FILTER (rn > 7) AS {c}_b" for c in daily.TRACKED),
    u=" UNION ALL ".join(f"SELECT '{n}' AS metric, {c}_n AS recent_7_avg, {c}_b AS prior_28_avg, ({c}_n - {c}_b) / nullif({c}_b, 0) * 100 AS delta_pct FROM f"
                         for c, n in daily.TRACKED.items())), "hr")
view("zscores", """SELECT ds, y, m AS rolling_mean, (y - m) / nullif(s, 0) AS zscore FROM (SELECT ds, y, count(y) OVER w AS c, avg(y) OVER w AS m, stddev_pop(y) OVER w AS s FROM hd
  WINDOW w AS (ORDER BY ds ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)) WHERE c >= 7""", "hd")
view("anom", """SELECT ds, y, zscore, CASE WHEN abs(zscore) >= 3 THEN 'High' ELSE 'Medium' END AS severity, CASE WHEN zscore < 0 THEN 'Below trend' ELSE 'Above trend' END AS direction
  FROM zscores WHERE abs(zscore) >= 2 ORDER BY ds DESC LIMIT 6""", "zscores")


def history(spark, d):
    return daily.daily_history(company_daily(spark, d))


def summary(spark, d):
    return daily.series_summary(model_table(spark, d).select("ds", "y", "leads", "cost", "platform"), "platform")


def forecast(hist):
    """Thirty days at the level of the last thirty, with a band of 8 %."""
    train = hist.select(F.lit(0).alias("fold"), F.lit("company_total").alias("series_id"), "ds", "y")
    f = baselines.baseline_forecasts(train, 30, models=["historical_average"])
    e = F.col("yhat")
    return f.select("ds", e.alias("expected"), (e * 0.92).alias("conservative"), (e * 1.08).alias("aggressive"))


@REG.add("ba01_daily_history", "hd", "SELECT * FROM hd", rnd="y leads cost roas revenue_per_lead")
def ba01(spark, d):
    return daily.daily_history(model_table(spark, d))


SUM_COLS = "total_revenue avg_daily volatility recent_revenue recent_avg_daily total_leads total_cost recent_leads recent_cost rev_per_lead roas recent_roas share_of_revenue stability_score"


@REG.add("ba02_series_summary", "ssum", "SELECT * FROM ssum", rnd=SUM_COLS, digits=3)
def ba02(spark, d):
    return summary(spark, d)


@REG.add("ba02_series_summary_raw_totals", "ssum leads", """WITH r AS (SELECT platform AS category, sum(leads) AS t, coalesce(sum(leads) FILTER (ds >= (SELECT max(ds) FROM leads) - 29), 0) AS n FROM leads GROUP BY 1)
  SELECT category, total_revenue, r.t AS total_leads, r.n AS recent_leads, total_revenue / r.t AS rev_per_lead FROM ssum JOIN r USING (category)""",
  rnd="total_revenue total_leads recent_leads rev_per_lead", digits=3)
def ba02_raw(spark, d):
    table = model_table(spark, d).select("ds", "y", "leads", "platform")
    out = daily.series_summary(table, "platform", [value_by_category(A.leads(spark, d), "platform", "leads")])
    return out.select("category", "total_revenue", "total_leads", "recent_leads", "rev_per_lead")


@REG.add("ba03_monthly_summary", "months", """SELECT *, revenue / nullif(cost, 0) AS roas, (revenue - lag(revenue) OVER (ORDER BY month)) / lag(revenue) OVER (ORDER BY month) * 100 AS mom_pct
  FROM months ORDER BY month DESC LIMIT 12""", rnd="revenue leads cost roas mom_pct")
def ba03(spark, d):
    return daily.monthly_summary(company_daily(spark, d))


@REG.add("ba03_year_over_year", "dc", "SELECT year(ds) AS year, month(ds) AS month, sum(y) AS revenue FROM dc GROUP BY 1, 2", rnd="revenue")
def ba03_yoy(spark, d):
    return daily.year_over_year(company_daily(spark, d))


@REG.add("ba04_actual_vs_forecast", "months fc", """SELECT m.*, f.forecast_revenue FROM (SELECT month, revenue AS actual, lag(revenue) OVER (ORDER BY month) AS prev_month,
   (revenue - lag(revenue) OVER (ORDER BY month)) / lag(revenue) OVER (ORDER BY month) * 100 AS mom_pct FROM months ORDER BY month DESC LIMIT 12) m
  LEFT JOIN (SELECT CAST(date_trunc('month', ds) AS DATE) AS month, sum(expected) AS forecast_revenue FROM fc GROUP BY 1) f USING (month)""", rnd="actual prev_month mom_pct forecast_revenue")
def ba04(spark, d):
    hist = cut(company_daily(spark, d))
    return daily.actual_vs_forecast(hist, forecast(hist))


@REG.add("ba05_weekday_pattern", "dc", """SELECT isodow(ds) - 1 AS weekday, avg(y) AS avg_revenue, row_number() OVER (ORDER BY avg(y) DESC) AS rank FROM dc GROUP BY 1""", rnd="avg_revenue")
def ba05(spark, d):
    return daily.weekday_pattern(company_daily(spark, d))


@REG.add("ba06_tracking", "track", "SELECT * FROM track", rnd="recent_7_avg prior_28_avg delta_pct")
def ba06(spark, d):
    return daily.tracking(history(spark, d))


@REG.add("ba07_early_warnings")
def ba07(spark, d):
    table = cut(model_table(spark, d).select("ds", "y", "leads", "cost", "platform", "affiliate", "campaign", "ad", "profile_id"))
    recs = planning.dimension_budget(table, planning.dimension_columns(table.columns), top=8)
    return planning.early_warnings(daily.tracking(daily.daily_history(table)), recs, users.whale_watch(table), top=12)


@REG.add("ba08_anomaly_scores", "zscores", "SELECT * FROM zscores", rnd="y rolling_mean zscore")
def ba08(spark, d):
    return daily.anomaly_scores(company_daily(spark, d))


@REG.add("ba08_anomalies", "anom", "SELECT * FROM anom", rnd="y zscore")
def ba08_hits(spark, d):
    return daily.anomalies(company_daily(spark, d))


DRIVER_SQL = """WITH l AS (SELECT 'leads' AS driver, ds, leads AS x, y, rn FROM hr UNION ALL SELECT 'cost', ds, cost, y, rn FROM hr),
  p AS (SELECT *, x - lag(x) OVER w AS step, (x - lag(x) OVER w) / nullif(lag(x) OVER w, 0) AS xc, (y - lag(y) OVER w) / nullif(lag(y) OVER w, 0) AS yc FROM l WHERE x IS NOT NULL AND y IS NOT NULL
    WINDOW w AS (PARTITION BY driver ORDER BY ds)),
  f AS (SELECT driver, count(*) AS n, corr(x, y) AS c, regr_slope(ln(1 + y), ln(1 + x)) FILTER (x > 0 AND y > 0) AS el,
    covar_samp(xc, yc) FILTER (xc IS NOT NULL AND yc IS NOT NULL) / var_pop(xc) FILTER (xc IS NOT NULL AND yc IS NOT NULL) AS beta, stddev_pop(step) AS jump,
    avg(x) FILTER (rn <= 90) AS bx, (SELECT avg(y) FROM hr WHERE rn <= 90) AS byy FROM p GROUP BY 1),
  e AS (SELECT *, greatest(-3, least(3, list_sort([el, beta, c])[2])) AS eff, least(1, greatest(0, abs(c) * 0.45 + least(1, n / 45.0) * 0.35 +
    greatest(0, 1 - least(1, abs(jump) / (abs(bx) + 1e-9))) * 0.20)) AS conf FROM f)
  SELECT driver, c AS correlation_to_revenue, el AS elasticity_score, beta AS pct_change_beta, eff AS effect_score, conf AS confidence_score, bx AS base_value_recent,
    byy AS base_revenue_recent, byy * eff * 0.10 AS revenue_change_if_driver_moves_10pct, CASE WHEN byy * eff >= 0 THEN 'increase' ELSE 'decrease' END AS suggested_direction,
    CASE WHEN conf >= 0.75 THEN 'high' WHEN conf >= 0.45 THEN 'medium' ELSE 'low' END AS evidence_strength FROM e WHERE conf >= 0.18"""
DRIVER_COLS = "correlation_to_revenue elasticity_score pct_change_beta effect_score confidence_score base_value_recent base_revenue_recent revenue_change_if_driver_moves_10pct"


@REG.add("ba09_driver_impact", "hr", DRIVER_SQL, rnd=DRIVER_COLS, digits=3)
def ba09(spark, d):
    return drivers.driver_impact(company_daily(spark, d))


@REG.add("ba10_sheet_impact", "hr", f"""WITH i AS (SELECT * FROM ({DRIVER_SQL})), z AS (SELECT ds, y, (leads - avg(leads) OVER ()) / stddev_pop(leads) OVER () AS zl, (cost - avg(cost) OVER ()) / stddev_pop(cost) OVER () AS zc FROM hr),
  m AS (SELECT 'Traffic' AS sheet, z.y, zl * (SELECT effect_score FROM i WHERE driver = 'leads') AS v FROM z UNION ALL SELECT 'All', z.y, zl * (SELECT effect_score FROM i WHERE driver = 'leads') + zc * (SELECT effect_score FROM i WHERE driver = 'cost') FROM z),
  s AS (SELECT 'Traffic' AS sheet, * FROM i WHERE driver = 'leads' UNION ALL SELECT 'All', * FROM i)
  SELECT s.sheet, count(*) AS drivers_found, max_by(driver, abs(revenue_change_if_driver_moves_10pct)) AS strongest_driver,
    max_by(revenue_change_if_driver_moves_10pct, abs(revenue_change_if_driver_moves_10pct)) AS strongest_driver_impact_10pct, sum(revenue_change_if_driver_moves_10pct) AS sheet_net_impact_10pct,
    sum(abs(revenue_change_if_driver_moves_10pct)) AS sheet_total_absolute_impact, avg(confidence_score) AS avg_confidence_score, avg(correlation_to_revenue) AS net_correlation_to_revenue,
    CASE s.sheet WHEN 'All' THEN 2 ELSE 1 END AS active_columns, (SELECT abs(corr(v, y)) FROM m WHERE m.sheet = s.sheet) AS estimated_revenue_relationship_share,
    CASE WHEN sum(revenue_change_if_driver_moves_10pct) >= 0 THEN 'tailwind' ELSE 'headwind' END AS direction FROM s GROUP BY 1""",
  rnd="strongest_driver_impact_10pct sheet_net_impact_10pct sheet_total_absolute_impact avg_confidence_score net_correlation_to_revenue estimated_revenue_relationship_share", digits=3)
def ba10(spark, d):
    hist = cut(company_daily(spark, d))
    return drivers.sheet_impact(hist, drivers.driver_impact(hist), {"Traffic": ["leads"], "All": ["leads", "cost"]})


@REG.add("ba11_portfolio", "hr", """WITH f AS (SELECT sum(y) FILTER (rn <= 30) / sum(cost) FILTER (rn <= 30) AS recent_roas, sum(y) / sum(cost) AS overall_roas, avg(cost) FILTER (rn <= 30) AS avg_daily_spend FROM hr)
  SELECT 'Overall portfolio' AS segment, *, avg_daily_spend * 30 * CASE WHEN recent_roas > overall_roas * 1.05 THEN 1.1 WHEN recent_roas < overall_roas * 0.95 THEN 0.9 ELSE 1 END AS suggested_monthly_budget,
   CASE WHEN recent_roas > overall_roas * 1.05 THEN 'Increase budget 10%' WHEN recent_roas < overall_roas * 0.95 THEN 'Trim budget 10%' ELSE 'Hold' END AS action FROM f""",
  rnd="recent_roas overall_roas avg_daily_spend suggested_monthly_budget")
def ba11(spark, d):
    return planning.portfolio(company_daily(spark, d))


@REG.add("ba11_allocation", "ssum", """WITH m AS (SELECT quantile_cont(recent_roas, 0.5) AS mr, quantile_cont(recent_revenue, 0.5) AS mv FROM ssum)
  SELECT category, recent_revenue, recent_cost, recent_roas, recent_cost * 0.1 AS extra_budget_10pct, recent_cost * 0.1 * recent_roas AS projected_revenue_from_extra_budget,
   recent_revenue + recent_cost * 0.1 * recent_roas AS projected_total_revenue_after_shift, CASE WHEN recent_cost <= 0 THEN 'Verify cost tracking' WHEN recent_roas IS NULL THEN 'Verify Recent ROAS'
    WHEN recent_roas >= greatest(1.2, mr) AND recent_revenue >= mv THEN 'Add budget' WHEN recent_roas < 1 THEN 'Hold / rework' ELSE 'Hold / review' END AS budget_action FROM ssum, m""",
  rnd="recent_revenue recent_cost recent_roas extra_budget_10pct projected_revenue_from_extra_budget projected_total_revenue_after_shift", digits=3)
def ba11_alloc(spark, d):
    return planning.allocation(summary(spark, d), top=15)


@REG.add("ba12_dimension_budget", "model", f"""WITH b AS (SELECT *, ds >= (SELECT max(ds) FROM model) - 29 AS r, ds >= (SELECT max(ds) FROM model) - 59 AND ds < (SELECT max(ds) FROM model) - 29 AS p FROM model),
  u AS (SELECT 'Campaign' AS t, campaign AS name, * FROM b UNION ALL SELECT 'Ad', ad, * FROM b UNION ALL SELECT 'Affiliate', affiliate, * FROM b UNION ALL SELECT 'Platform', platform, * FROM b),
  g AS (SELECT t, name, sum(y) FILTER (r) AS rr, coalesce(sum(y) FILTER (p), 0) AS pr, sum(cost) FILTER (r) AS rc, sum(leads) FILTER (r) AS rl FROM u GROUP BY 1, 2 HAVING count(*) FILTER (r) > 0),
  h AS (SELECT *, (rr - pr) / nullif(pr, 0) * 100 AS dp, rr / nullif(rc, 0) AS roas, rr / nullif(rl, 0) AS rpl, rr / greatest(sum(rr) OVER (PARTITION BY t), 1) AS sh FROM g),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY rr DESC, dp NULLS LAST, name) AS rk FROM h) WHERE rk <= 8),
  a AS (SELECT *, CASE WHEN roas IS NULL THEN 0 WHEN roas < 0.85 THEN CASE WHEN sh >= 0.08 THEN -15 ELSE -10 END WHEN roas < 1 THEN CASE WHEN sh >= 0.12 THEN -10 ELSE 0 END
      WHEN dp <= -18 THEN CASE WHEN sh >= 0.18 THEN -15 ELSE -10 END WHEN roas >= 1.25 AND (dp IS NULL OR dp >= -5) THEN CASE WHEN sh < 0.3 THEN 12 ELSE 8 END WHEN dp >= 12 THEN 8 ELSE 0 END AS shift,
     CASE WHEN roas IS NULL THEN '{planning.VERIFY}' WHEN roas < 0.85 THEN '{planning.REWORK}' WHEN roas < 1 THEN '{planning.TRIM}' WHEN dp <= -18 THEN '{planning.REDUCE}'
      WHEN roas >= 1.25 AND (dp IS NULL OR dp >= -5) THEN '{planning.SCALE}' WHEN dp >= 12 THEN '{planning.SUPPORT}' ELSE '{planning.HOLD}' END AS action FROM k)
  SELECT t AS dimension_type, name, rr AS recent_revenue, pr AS prior_revenue, dp AS delta_pct, roas AS recent_roas, rpl AS recent_rpl, sh * 100 AS revenue_share, shift AS recommended_budget_shift_pct, action
  FROM a ORDER BY abs(shift) DESC, rr DESC, t, name LIMIT 8""", rnd="recent_revenue prior_revenue delta_pct recent_roas recent_rpl revenue_share", digits=3)
def ba12(spark, d):
    table = model_table(spark, d)
    return planning.dimension_budget(table, planning.dimension_columns(["campaign", "ad", "affiliate", "platform"]), top=8)


@REG.add("ba13_whale_watch", "ord", """WITH p AS (SELECT profile_id AS whale_id, sum(y) FILTER (b <= 89) AS t, sum(y) AS lt, coalesce(sum(y) FILTER (b <= 29), 0) AS rr, coalesce(sum(y) FILTER (b BETWEEN 30 AND 59), 0) AS pr, min(b) AS ls
    FROM (SELECT *, (SELECT max(ds) FROM ord) - ds AS b FROM ord) GROUP BY 1), w AS (SELECT * FROM p WHERE t IS NOT NULL ORDER BY round(t, 4) DESC, whale_id LIMIT 30),
  s AS (SELECT profile_id AS whale_id, max_by(platform, v) AS platform FROM (SELECT profile_id, platform, round(sum(y), 4) AS v FROM ord GROUP BY 1, 2) GROUP BY 1)
  SELECT whale_id, CASE WHEN lt >= 20000 THEN 'God Tier' WHEN lt >= 10000 THEN 'Super User' WHEN lt >= 5000 THEN 'Core User' WHEN lt >= 2000 THEN 'High-Value User' WHEN lt >= 500 THEN 'High Value' ELSE 'Emerging' END AS whale_tier,
    lt AS lifetime_revenue, rr AS recent_revenue, pr AS prior_revenue, CASE WHEN pr > 0 THEN (rr - pr) / pr * 100 END AS delta_pct, rr / greatest(sum(rr) OVER (), 1) * 100 AS revenue_share_pct, ls AS days_since_last_seen,
    CASE WHEN rr <= 0 AND pr > 0 THEN 'Dormant' WHEN ls >= 14 THEN 'Cooling off' WHEN pr > 0 AND (rr - pr) / pr * 100 <= -25 THEN 'At risk' ELSE 'Stable' END AS status, platform FROM w JOIN s USING (whale_id)""",
  rnd="lifetime_revenue recent_revenue prior_revenue delta_pct revenue_share_pct")
def ba13(spark, d):
    return users.whale_watch(A.revenue_orders(spark, d))


@REG.add("ba14_attribution", "ssum", """SELECT row_number() OVER (ORDER BY total_revenue DESC) AS rank, category AS channel, total_revenue AS revenue, share_of_revenue * 100 AS revenue_share_pct, roas, recent_roas, rev_per_lead,
  total_cost, recent_revenue, recent_cost, stability_score FROM ssum""", rnd="revenue revenue_share_pct roas recent_roas rev_per_lead total_cost recent_revenue recent_cost stability_score", digits=3)
def ba14(spark, d):
    return planning.attribution(summary(spark, d), top=15)


BRIDGE = "SELECT * FROM (VALUES (0, 'Starting revenue', {s}, 'anchor'))"


@REG.add("ba15_leads_waterfall", "hr ssum", """WITH f AS (SELECT avg(y) FILTER (rn > 7) AS s, avg(y) FILTER (rn <= 7) AS e, avg(leads) FILTER (rn > 7) AS l0, avg(leads) FILTER (rn <= 7) AS l1,
    avg(revenue_per_lead) FILTER (rn > 7) AS r0, avg(revenue_per_lead) FILTER (rn <= 7) AS r1 FROM hr WHERE rn <= 35),
  q AS (SELECT quantile_cont(recent_roas, 0.5) AS ref FROM ssum),
  x AS (SELECT sum((rs - share_of_revenue) * (coalesce(recent_roas, ref) - ref)) AS mix FROM (SELECT *, recent_revenue / sum(recent_revenue) OVER () AS rs FROM ssum), q),
  p AS (SELECT s, e, (l1 - l0) * r0 AS a, l1 * (r1 - r0) AS b, mix * greatest(s, 0) AS m FROM f, x)
  SELECT 0 AS position, 'Starting revenue' AS component, s AS impact, 'anchor' AS kind FROM p UNION ALL SELECT 1, 'Lead volume impact', a, 'delta' FROM p UNION ALL SELECT 2, 'Revenue per lead impact', b, 'delta' FROM p
  UNION ALL SELECT 3, 'Platform mix impact', m, 'delta' FROM p UNION ALL SELECT 4, 'Other / unexplained', e - s - a - b - m, 'delta' FROM p UNION ALL SELECT 5, 'Current revenue', e, 'anchor' FROM p""", rnd="impact", digits=3)
def ba15(spark, d):
    return waterfall.leads_waterfall(history(spark, d), summary(spark, d))


@REG.add("ba15_waterfall_reading")
def ba15_reading(spark, d):
    return waterfall.waterfall_reading(waterfall.leads_waterfall(history(spark, d)))


@REG.add("ba16_cohort_waterfall", "co_orders cost", """WITH c AS (SELECT *, 'Platform=' || platform AS cat, datediff('month', lead_month, transaction_month) AS age FROM co_orders WHERE transaction_month >= lead_month),
  m AS (SELECT transaction_month, sum(revenue) AS rev, coalesce(sum(revenue) FILTER (age = 0), 0) AS nw, coalesce(sum(revenue) FILTER (age > 0), 0) AS od, row_number() OVER (ORDER BY transaction_month DESC) AS rn FROM c GROUP BY 1),
  f AS (SELECT avg(rev) FILTER (rn > 1) AS s, max(rev) FILTER (rn = 1) AS e, max(nw) FILTER (rn = 1) - avg(nw) FILTER (rn > 1) AS a, max(od) FILTER (rn = 1) - avg(od) FILTER (rn > 1) AS b FROM m WHERE rn <= 4),
  r AS (SELECT 'Platform=' || platform AS cat, (SELECT sum(revenue) FROM co_orders o WHERE o.platform = k.platform) / sum(cost) AS roas FROM cost k GROUP BY platform),
  sh AS (SELECT c.cat, coalesce(sum(revenue) FILTER (rn = 1), 0) AS n1, coalesce(avg(revenue) FILTER (rn > 1), 0) AS n0 FROM c JOIN m USING (transaction_month) WHERE rn <= 4 GROUP BY 1),
  q AS (SELECT quantile_cont(roas, 0.5) AS ref FROM sh JOIN r USING (cat)),
  x AS (SELECT sum((nn - n00) * (roas - ref)) AS mix FROM (SELECT cat, n1 / sum(n1) OVER () AS nn, n0 / sum(n0) OVER () AS n00 FROM sh) JOIN r USING (cat), q),
  p AS (SELECT s, e, a, b, mix * greatest(s, 0) AS mi FROM f, x)
  SELECT 0 AS position, 'Starting revenue' AS component, s AS impact, 'anchor' AS kind FROM p UNION ALL SELECT 1, 'New cohort impact', a, 'delta' FROM p UNION ALL SELECT 2, 'Older cohort maturation', b, 'delta' FROM p
  UNION ALL SELECT 3, 'Platform mix impact', mi, 'delta' FROM p UNION ALL SELECT 4, 'Other / unexplained', e - s - a - b - mi, 'delta' FROM p UNION ALL SELECT 5, 'Current revenue', e, 'anchor' FROM p""", rnd="impact", digits=2)
def ba16(spark, d):
    orders = A.cohort_orders(spark, d)
    frame = cohort.cohort_long_frame(orders, "platform")
    spent = A.cost(spark, d).groupBy("platform").agg(F.sum("cost").alias("cost"))
    earned = orders.groupBy("platform").agg(F.sum("revenue").alias("rev"))
    roas = earned.join(spent, "platform").select(F.concat(F.lit("Platform="), "platform").alias("cohort_category"), (F.col("rev") / F.col("cost")).alias("roas"))
    return waterfall.cohort_waterfall(frame, roas)


def _profile(spark, d):
    raw_leads = mapped_rollup(A.leads(spark, d), "ds", "leads", "month").withColumnRenamed("ds", "month")
    raw_cost = mapped_rollup(A.cost(spark, d), "ds", "cost", "month").withColumnRenamed("ds", "month")
    by_day = A.revenue(spark, d).groupBy("ds").agg(F.sum("y").alias("y"))
    return planning.planning_profile(by_day, raw_leads, raw_cost)


PROFILE = """SELECT m.month, m.revenue, l.leads, c.cost, m.revenue / l.leads AS revenue_per_lead, m.revenue / c.cost AS roas, l.leads / c.cost AS leads_per_dollar, c.cost / l.leads AS cost_per_lead
  FROM (SELECT CAST(date_trunc('month', ds) AS DATE) AS month, sum(y) AS revenue FROM rev GROUP BY 1) m
  LEFT JOIN (SELECT CAST(date_trunc('month', ds) AS DATE) AS month, sum(leads) AS leads FROM leads GROUP BY 1) l USING (month)
  LEFT JOIN (SELECT ds AS month, sum(cost) AS cost FROM cost GROUP BY 1) c USING (month) ORDER BY m.month DESC"""


@REG.add("ba17_planning_profile", "rev leads cost", PROFILE + " LIMIT 18", rnd="revenue leads cost revenue_per_lead roas leads_per_dollar cost_per_lead")
def ba17(spark, d):
    return _profile(spark, d)


@REG.add("ba18_scenario_table", "rev leads cost", f"""WITH b AS (SELECT * FROM ({PROFILE} LIMIT 1)), s(scenario, bm, lm, qm) AS (VALUES {", ".join(str(s) for s in planning.SCENARIOS)})
  SELECT scenario, cost * bm AS projected_spend, leads * lm AS projected_leads, greatest(revenue, revenue_per_lead * leads) * qm * (0.55 + 0.45 * lm) * (0.65 + 0.35 * bm) AS projected_revenue,
   greatest(revenue, revenue_per_lead * leads) * qm * (0.55 + 0.45 * lm) * (0.65 + 0.35 * bm) / (cost * bm) AS projected_roas FROM b, s""",
  rnd="projected_spend projected_leads projected_revenue projected_roas")
def ba18(spark, d):
    return planning.scenario_table(planning.planning_baseline(_profile(spark, d)))


@REG.add("ba19_scenario_comparison", "hr fc", """WITH f AS (SELECT count(*) AS n, avg(conservative) AS ca, avg(expected) AS ea, avg(aggressive) AS aa, sum(conservative) AS cs, sum(expected) AS es, sum(aggressive) AS s3, (SELECT avg(y) FROM hr WHERE rn <= 30) AS run FROM fc)
  SELECT 'Current run-rate' AS scenario, run AS avg_period_revenue, run * n AS total_revenue, (run - ea) / ea * 100 AS vs_expected_pct FROM f UNION ALL SELECT 'Conservative (P10)', ca, cs, (ca - ea) / ea * 100 FROM f
  UNION ALL SELECT 'Expected (P50)', ea, es, 0 FROM f UNION ALL SELECT 'Aggressive (P90)', aa, s3, (aa - ea) / ea * 100 FROM f""", rnd="avg_period_revenue total_revenue vs_expected_pct", digits=3)
def ba19(spark, d):
    hist = cut(company_daily(spark, d))
    return planning.scenario_comparison(hist, forecast(hist))


@REG.add("ba20_supported_revenue", "hr", """WITH f AS (SELECT avg(leads) AS avg_leads, sum(y) / sum(leads) AS revenue_per_lead FROM hr WHERE rn <= 30)
  SELECT *, avg_leads * 30 * revenue_per_lead * 0.65 AS supported_30_days, avg_leads * 60 * revenue_per_lead * 0.90 AS supported_60_days FROM f""", rnd="avg_leads revenue_per_lead supported_30_days supported_60_days", digits=3)
def ba20(spark, d):
    return planning.supported_revenue(company_daily(spark, d))


@REG.add("ba21_diagnostics", "hr fc", """WITH s AS (SELECT avg(y) FILTER (rn <= 30) AS a, quantile_cont(y, 0.5) FILTER (rn <= 30) AS b, max(y) FILTER (rn <= 30) AS c, avg(leads) AS l, max(leads) AS ml, avg(cost) AS k, max(cost) AS mk, (SELECT avg(expected) FROM fc) AS e FROM hr),
  u AS (SELECT 'recent_avg_y' AS metric, a AS value, 30.4375 AS f FROM s UNION ALL SELECT 'recent_median_y', b, 30.4375 FROM s UNION ALL SELECT 'recent_max_y', c, 30.4375 FROM s UNION ALL SELECT 'forecast_avg_expected', e, 30.4375 FROM s
   UNION ALL SELECT 'avg_leads', l, 30.4375 FROM s UNION ALL SELECT 'max_leads', ml, 30.4375 FROM s UNION ALL SELECT 'avg_cost', k, 30.4375 FROM s UNION ALL SELECT 'max_cost', mk, 30.4375 FROM s
   UNION ALL SELECT 'forecast_to_history_ratio', e / a, 1 FROM s UNION ALL SELECT 'duplicate_ds_rows', 0, 1)
  SELECT metric, value, value * f AS monthly_value FROM u""", rnd="value monthly_value", digits=3)
def ba21(spark, d):
    hist = cut(company_daily(spark, d))
    return daily.diagnostics(quality.history_stats(hist), forecast(hist))


RESPONSE = """SELECT count(*) AS months, corr(cost, revenue) AS correlation, regr_slope(revenue, ln(1 + cost)) AS slope, regr_intercept(revenue, ln(1 + cost)) AS intercept, min(cost) AS cost_min, max(cost) AS cost_max,
  CAST(corr(cost, revenue) >= 0.2 AND regr_slope(revenue, ln(1 + cost)) > 0 AS INT) AS drawn FROM months WHERE cost > 0 AND revenue >= 0"""


@REG.add("ba22_response_fit", "months", RESPONSE, rnd="correlation slope intercept cost_min cost_max", digits=2)
def ba22(spark, d):
    return stats.response_fit(daily.monthly_totals(company_daily(spark, d)))


@REG.add("ba22_response_curve", "months", f"""WITH f AS ({RESPONSE}), c AS (SELECT CAST(p AS INT) AS point, cost_min + (cost_max - cost_min) / 39 * p AS spend, slope, intercept FROM f, (SELECT unnest(range(40)) AS p)),
  v AS (SELECT point, spend, greatest(slope * ln(1 + spend) + intercept, 0) AS revenue FROM c)
  SELECT *, (revenue - lag(revenue) OVER (ORDER BY point)) / nullif(spend - lag(spend) OVER (ORDER BY point), 0) AS marginal_return FROM v""", rnd="spend revenue marginal_return", digits=2)
def ba22_curve(spark, d):
    return stats.response_curve(ba22(spark, d))


@REG.add("ba23_lag_scan", "hd", """WITH l AS (SELECT CAST(k AS INT) AS lag_days, a.y, b.leads AS x FROM (SELECT *, row_number() OVER (ORDER BY ds) AS i FROM hd) a, (SELECT unnest(range(0, 61, 5)) AS k) k
    JOIN (SELECT leads, row_number() OVER (ORDER BY ds) AS i FROM hd) b ON b.i = a.i - k.k), c AS (SELECT lag_days, corr(x, y) AS correlation, abs(corr(x, y)) AS abs_correlation FROM l GROUP BY 1 HAVING count(*) >= 12)
  SELECT *, CAST(row_number() OVER (ORDER BY abs_correlation DESC, lag_days) = 1 AS INT) AS best FROM c""", rnd="correlation abs_correlation")
def ba23(spark, d):
    return stats.lag_scan(company_daily(spark, d))


@REG.add("ba24_lag_alignment", "hr", """SELECT ds, cost, leads, y, lagged_revenue FROM (SELECT *, lead(y, 15) OVER (ORDER BY ds) AS lagged_revenue FROM hr WHERE rn <= 120) WHERE lagged_revenue IS NOT NULL""", rnd="cost leads y lagged_revenue")
def ba24(spark, d):
    return stats.lag_alignment(company_daily(spark, d), 15)


@REG.add("ba25_efficiency_frontier", "months", """WITH r AS (SELECT strftime(month, '%Y-%b') AS segment, revenue, cost, revenue / cost AS roas FROM months WHERE cost > 0)
  SELECT *, (rank() OVER (ORDER BY roas) + (count(*) OVER (PARTITION BY roas) - 1) / 2) / count(*) OVER () AS efficiency_score FROM r ORDER BY roas DESC, revenue DESC, segment LIMIT 30""", rnd="revenue cost roas efficiency_score")
def ba25(spark, d):
    months = daily.monthly_totals(company_daily(spark, d))
    return stats.efficiency_frontier(months.select(F.date_format("month", "yyyy-MMM").alias("segment"), "revenue", "cost"), top=30)


@REG.add("ba26_attrition", "months", """WITH r AS (SELECT month, revenue, lag(revenue) OVER (ORDER BY month) AS prev_revenue FROM months)
  SELECT *, revenue / prev_revenue AS retention_rate, greatest(0, 1 - revenue / prev_revenue) AS attrition_rate FROM r WHERE prev_revenue IS NOT NULL""", rnd="revenue prev_revenue retention_rate attrition_rate")
def ba26(spark, d):
    return stats.attrition(daily.monthly_totals(company_daily(spark, d)))


@REG.add("ba27_overview", "hr fc", """SELECT h.*, f.*, (upper_total - lower_total) / forecast_total * 100 AS band_width_pct FROM (SELECT count(*) AS history_rows, max_by(y, ds) AS latest_revenue FROM hr) h,
  (SELECT count(*) AS forecast_rows, min(ds) AS forecast_start, sum(expected) AS forecast_total, sum(conservative) AS lower_total, sum(aggressive) AS upper_total FROM fc) f""",
  rnd="latest_revenue forecast_total lower_total upper_total band_width_pct", digits=3)
def ba27(spark, d):
    hist = cut(company_daily(spark, d))
    return daily.overview(hist, forecast(hist))


@REG.add("ba28_alerts", "track anom", """SELECT 0 AS position, NULL::DATE AS ds, CASE WHEN delta_pct < 0 THEN 'warning' ELSE 'info' END AS level, 'Revenue shift detected' AS title, delta_pct AS value FROM track WHERE metric = 'Revenue' AND abs(delta_pct) >= 12
  UNION ALL SELECT 1, ds, CASE WHEN zscore < 0 THEN 'warning' ELSE 'info' END, 'Anomaly on ' || strftime(ds, '%Y-%m-%d'), zscore FROM anom""", rnd="value")
def ba28(spark, d):
    hist = cut(history(spark, d))
    return daily.alerts(daily.tracking(hist), daily.anomalies(hist), top=8)
