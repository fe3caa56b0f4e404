"""Cohort, payback and spending queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Registry, view
from catalog.frames import model_table
from revcast.operators import cohort as C
from revcast.operators import spending as S
from revcast.session import cut
from revcast.sources import adapters as A

REG = Registry()

view("cohort", """SELECT lead_month, transaction_month, revenue, 'Platform=' || platform AS cohort_category, 'Platform=' || platform AS cost_match_key,
  datediff('month', lead_month, transaction_month) AS cohort_age_month FROM co_orders WHERE transaction_month >= lead_month""", "co_orders")
view("ckey", "SELECT ds AS lead_month, 'Platform=' || platform AS cost_match_key, sum(cost) AS matched_cost FROM cost GROUP BY 1, 2", "cost")
view("cgroup", """SELECT lead_month, cohort_category, cost_match_key, sum(revenue) AS total_revenue, count(DISTINCT transaction_month) AS active_months, min(transaction_month) AS first_txn_month,
  max(transaction_month) AS last_txn_month, coalesce(sum(revenue) FILTER (cohort_age_month = 0), 0) AS first_month_revenue FROM cohort GROUP BY 1, 2, 3""", "cohort")
view("ccost", """WITH b AS (SELECT g.*, k.matched_cost * g.total_revenue / sum(g.total_revenue) OVER (PARTITION BY g.lead_month, g.cost_match_key) AS c0 FROM cgroup g LEFT JOIN ckey k USING (lead_month, cost_match_key)),
  m AS (SELECT lead_month, sum(matched_cost) AS mc FROM ckey GROUP BY 1),
  j AS (SELECT b.*, greatest(coalesce(mc, 0) - coalesce(sum(c0) OVER (PARTITION BY b.lead_month), 0), 0) AS lft, sum(CASE WHEN c0 IS NULL THEN total_revenue ELSE 0 END) OVER (PARTITION BY b.lead_month) AS opn, mc FROM b LEFT JOIN m USING (lead_month))
  SELECT * EXCLUDE (c0, lft, opn, mc), coalesce(c0, CASE WHEN mc IS NOT NULL AND opn > 0 THEN lft * total_revenue / opn END) AS cost FROM j""", "cgroup ckey")
view("cscore", """WITH r AS (SELECT *, total_revenue / nullif(cost, 0) AS roas, total_revenue / greatest(sum(total_revenue) OVER (), 1) AS revenue_share, first_month_revenue / nullif(cost, 0) AS payback_share_m0 FROM ccost),
  m AS (SELECT quantile_cont(roas, 0.5) AS md FROM r)
  SELECT r.*, CASE WHEN roas >= greatest(1.25, md) THEN 'Scale Platform' WHEN roas < 0.9 THEN 'Cap / Rework Platform' WHEN roas IS NOT NULL THEN 'Watch Platform'
    WHEN revenue_share >= 0.08 THEN 'Verify Recent ROAS' WHEN revenue_share < 0.03 THEN 'Cap / Rework Platform' ELSE 'Watch Platform' END AS action FROM r, m""", "ccost")
view("cmonth", """SELECT *, total_revenue / nullif(total_cost, 0) AS roas, total_revenue / nullif(total_cost, 0) * 100 AS roas_pct, CASE WHEN total_cost <> 0 THEN least(greatest(total_revenue / total_cost, 0), 1) * 100 END AS payback_pct,
  CASE WHEN active_months >= 6 THEN 'Mature' WHEN active_months >= 3 THEN 'Growing' ELSE 'Early' END AS maturity_status, (CASE WHEN active_months >= 6 THEN 1 WHEN active_months >= 3 THEN 0.75 ELSE 0.5 END)::DOUBLE AS maturity_weight,
  total_revenue / nullif(total_cost, 0) * (CASE WHEN active_months >= 6 THEN 1 WHEN active_months >= 3 THEN 0.75 ELSE 0.5 END)::DOUBLE AS maturity_adjusted_roas
  FROM (SELECT lead_month, sum(total_revenue) AS total_revenue, coalesce(sum(cost), 0) AS total_cost, count(DISTINCT cohort_category) AS cohorts, max(active_months) AS active_months FROM cscore GROUP BY 1)""", "cscore")
view("ccurve", """SELECT a.*, sum(revenue) OVER (PARTITION BY a.lead_month, a.cohort_category ORDER BY cohort_age_month) AS cumulative_revenue, k.cohort_cost,
    sum(revenue) OVER (PARTITION BY a.lead_month, a.cohort_category ORDER BY cohort_age_month) / nullif(k.cohort_cost, 0) AS cumulative_roas
  FROM (SELECT lead_month, cost_match_key AS cohort_category, CAST(cohort_age_month AS INT) AS cohort_age_month, sum(revenue) AS revenue FROM cohort GROUP BY 1, 2, 3) a
  LEFT JOIN (SELECT lead_month, cost_match_key AS cohort_category, coalesce(sum(cost), 0) AS cohort_cost FROM cscore GROUP BY 1, 2) k USING (lead_month, cohort_category)""", "cohort cscore")
view("cage", """SELECT lead_month, cohort_age_month, sum(cumulative_revenue) AS cumulative_revenue, sum(cohort_cost) AS cohort_cost, sum(cumulative_revenue) / nullif(sum(cohort_cost), 0) AS cumulative_roas FROM ccurve GROUP BY 1, 2""", "ccurve")
view("ctime", "SELECT lead_month, CAST(min(cohort_age_month) FILTER (cumulative_roas >= 1) AS DOUBLE) AS time_to_100_roas_months FROM cage GROUP BY 1", "cage")
# the projection month by month, as the definition has it
view("cproj", """WITH g AS (SELECT *, cumulative_revenue - coalesce(lag(cumulative_revenue) OVER (PARTITION BY lead_month ORDER BY cohort_age_month), 0) AS gain FROM cage),
  p AS (SELECT *, gain / lag(gain) OVER (PARTITION BY lead_month ORDER BY cohort_age_month) AS ratio FROM g WHERE gain > 0),
  t AS (SELECT lead_month, count(*) AS n, quantile_cont(ratio, 0.5) AS ratio, max_by(gain, cohort_age_month) AS lg FROM p GROUP BY 1),
  w AS (SELECT lead_month, max_by(cumulative_revenue, cohort_age_month) AS rev, max_by(cohort_cost, cohort_age_month) AS cst FROM g GROUP BY 1),
  j AS (SELECT *, CASE WHEN n >= 2 THEN greatest(0.55, least(0.98, ratio)) ELSE 0.9 END AS dc FROM w LEFT JOIN t USING (lead_month)),
  s AS (SELECT lead_month, k, rev, cst, rev + sum(lg * dc ** k) OVER (PARTITION BY lead_month ORDER BY k) AS proj FROM j, (SELECT unnest(range(1, 37)) AS k))
  SELECT j.lead_month, CASE WHEN coalesce(j.cst, 0) <= 0 THEN NULL WHEN j.rev >= j.cst THEN 0 ELSE (SELECT min(k) FROM s WHERE s.lead_month = j.lead_month AND proj >= s.cst) END::DOUBLE AS projected_time_to_100_roas_months FROM j""", "cage")
view("croas", "SELECT * FROM cmonth LEFT JOIN ctime USING (lead_month) LEFT JOIN cproj USING (lead_month)", "cmonth ctime cproj")


def frame(spark, d):
    return C.cohort_long_frame(A.cohort_orders(spark, d), "platform", "platform")


def scored(spark, d, long=None):
    by_month, by_key = C.cost_rollups(A.cost(spark, d), "platform")
    return C.cohort_scores(C.allocate_cohort_cost(C.cohort_aggregate(long if long is not None else frame(spark, d)), by_month, by_key))


def both(spark, d):
    """Cohort rows combined to lead month, group and transaction month, and the scored cohorts."""
    long = frame(spark, d)
    small = long.groupBy(*[c for c in long.columns if c != "revenue"]).agg(F.sum("revenue").alias("revenue"))
    small = cut(small)
    return small, cut(scored(spark, d, small))


@REG.add("co01_cohort_long_frame", "cohort", "SELECT * REPLACE (CAST(cohort_age_month AS INT) AS cohort_age_month) FROM cohort", rnd="revenue")
def co01(spark, d):
    return frame(spark, d)


@REG.add("co02_cost_rollups", "ckey", """SELECT lead_month, cost_match_key, matched_cost, sum(matched_cost) OVER (PARTITION BY lead_month) AS month_cost FROM ckey""", rnd="matched_cost month_cost")
def co02(spark, d):
    by_month, by_key = C.cost_rollups(A.cost(spark, d), "platform")
    return by_key.join(by_month, "lead_month")


@REG.add("co03_cohort_aggregate", "cgroup", "SELECT * FROM cgroup", rnd="total_revenue first_month_revenue")
def co03(spark, d):
    return C.cohort_aggregate(frame(spark, d))


@REG.add("co04_cohort_cost", "ccost", "SELECT lead_month, cohort_category, cost_match_key, total_revenue, cost FROM ccost", rnd="total_revenue cost")
def co04(spark, d):
    by_month, by_key = C.cost_rollups(A.cost(spark, d), "platform")
    out = C.allocate_cohort_cost(C.cohort_aggregate(frame(spark, d)), by_month, by_key)
    return out.select("lead_month", "cohort_category", "cost_match_key", "total_revenue", "cost")


@REG.add("co05_cohort_scores", "cscore", "SELECT lead_month, cohort_category, cost, roas, revenue_share, payback_share_m0, action FROM cscore", rnd="cost roas revenue_share payback_share_m0")
def co05(spark, d):
    return scored(spark, d).select("lead_month", "cohort_category", "cost", "roas", "revenue_share", "payback_share_m0", "action")


@REG.add("co06_cohort_table", "cscore", """SELECT lead_month, cost_match_key AS cohort_category, sum(total_revenue) AS total_revenue, coalesce(sum(cost), 0) AS cost, avg(roas) AS roas, max(active_months) AS active_months,
  sum(total_revenue) / greatest(sum(sum(total_revenue)) OVER (), 1) AS revenue_share FROM cscore GROUP BY 1, 2""", rnd="total_revenue cost roas revenue_share")
def co06(spark, d):
    return C.cohort_table(scored(spark, d))


@REG.add("co06_cohort_totals", "cscore", """SELECT count(*) AS cohort_count, count(DISTINCT lead_month) AS lead_months, count(DISTINCT cohort_category) AS sources, sum(total_revenue) AS cohort_revenue_total,
  sum(cost) AS cohort_cost_total, sum(total_revenue) / greatest(sum(cost), 1) AS cohort_roas_total FROM cscore""", rnd="cohort_revenue_total cohort_cost_total cohort_roas_total", digits=3)
def co06_totals(spark, d):
    return C.cohort_totals(scored(spark, d))


@REG.add("co07_platform_table", "cscore", """WITH r AS (SELECT *, dense_rank() OVER (ORDER BY lead_month DESC) <= 12 AS r FROM cscore),
  g AS (SELECT cost_match_key AS cohort_category, sum(total_revenue) AS total_revenue, coalesce(sum(cost), 0) AS total_cost, count(DISTINCT lead_month) AS cohorts, sum(total_revenue) FILTER (r) AS recent_revenue,
    CASE WHEN bool_or(r) THEN coalesce(sum(cost) FILTER (r), 0) END AS recent_cost, count(DISTINCT lead_month) FILTER (r) AS recent_cohorts FROM r GROUP BY 1),
  h AS (SELECT *, total_revenue / nullif(total_cost, 0) AS roas, total_revenue / cohorts AS avg_revenue_per_cohort, recent_revenue / nullif(recent_cost, 0) AS recent_roas FROM g),
  m AS (SELECT quantile_cont(total_revenue, 0.5) AS a, coalesce(quantile_cont(recent_revenue, 0.5), 0) AS n FROM h)
  SELECT h.*, CASE WHEN recent_roas >= 1.2 AND coalesce(recent_revenue, 0) >= n THEN 'Scale' WHEN recent_roas < 0.9 THEN 'Remove / Rework' WHEN recent_roas IS NOT NULL THEN 'Watch' WHEN recent_revenue > 0 THEN 'Verify Recent ROAS'
    WHEN total_revenue >= a THEN 'Historical Only - Verify' ELSE 'Watch' END AS action FROM h, m""", rnd="total_revenue total_cost recent_revenue recent_cost roas avg_revenue_per_cohort recent_roas", digits=3)
def co07(spark, d):
    return C.platform_table(scored(spark, d))


@REG.add("co08_lead_month_rollup", "cmonth", "SELECT * FROM cmonth", rnd="total_revenue total_cost roas roas_pct payback_pct maturity_weight maturity_adjusted_roas", digits=3)
def co08(spark, d):
    return C.lead_month_rollup(scored(spark, d))


@REG.add("co09_payback_curve", "ccurve", "SELECT * FROM ccurve", rnd="revenue cumulative_revenue cohort_cost cumulative_roas", digits=3)
def co09(spark, d):
    long, s = both(spark, d)
    return C.payback_curve(long, s)


@REG.add("co09_latest_payback", "ccurve", """SELECT lead_month, cohort_category, max(cohort_age_month) AS cohort_age_month, max_by(cumulative_revenue, cohort_age_month) AS cumulative_revenue, max_by(cohort_cost, cohort_age_month) AS cohort_cost,
  max_by(cumulative_roas, cohort_age_month) AS cumulative_roas FROM ccurve GROUP BY 1, 2""", rnd="cumulative_revenue cohort_cost cumulative_roas", digits=3)
def co09_latest(spark, d):
    long, s = both(spark, d)
    return C.latest_payback(C.payback_curve(long, s)).drop("revenue")


@REG.add("co10_time_to_break_even", "ctime", "SELECT * FROM ctime", rnd="time_to_100_roas_months")
def co10(spark, d):
    long, s = both(spark, d)
    return C.time_to_break_even(C.payback_by_age(C.payback_curve(long, s)))


@REG.add("co11_projected_break_even", "cproj", "SELECT * FROM cproj", rnd="projected_time_to_100_roas_months")
def co11(spark, d):
    long, s = both(spark, d)
    return C.projected_break_even(C.payback_by_age(C.payback_curve(long, s)))


@REG.add("co08_roas_table", "croas", "SELECT lead_month, roas, time_to_100_roas_months, projected_time_to_100_roas_months FROM croas", rnd="roas time_to_100_roas_months projected_time_to_100_roas_months")
def co08_roas(spark, d):
    long, s = both(spark, d)
    return C.roas_table(s, long).select("lead_month", "roas", "time_to_100_roas_months", "projected_time_to_100_roas_months")


@REG.add("co12_payback_summary", "croas", """WITH r AS (SELECT * FROM (SELECT *, dense_rank() OVER (ORDER BY lead_month DESC) AS dr FROM croas) WHERE dr <= 12),
  a AS (SELECT *, row_number() OVER (ORDER BY time_to_100_roas_months NULLS LAST, payback_pct DESC NULLS LAST, lead_month DESC) AS f,
    row_number() OVER (ORDER BY projected_time_to_100_roas_months DESC NULLS LAST, maturity_adjusted_roas NULLS LAST, payback_pct NULLS LAST, lead_month DESC) AS s FROM r)
  SELECT 'Fastest Payback' AS bucket, lead_month, payback_pct, roas_pct, maturity_adjusted_roas, maturity_status, active_months, time_to_100_roas_months, projected_time_to_100_roas_months FROM a WHERE f <= 3 AND time_to_100_roas_months IS NOT NULL
  UNION ALL SELECT 'Needs Attention', lead_month, payback_pct, roas_pct, maturity_adjusted_roas, maturity_status, active_months, time_to_100_roas_months, projected_time_to_100_roas_months FROM a WHERE s <= 3""",
  rnd="payback_pct roas_pct maturity_adjusted_roas time_to_100_roas_months projected_time_to_100_roas_months", digits=3)
def co12(spark, d):
    long, s = both(spark, d)
    return C.payback_summary(C.roas_table(s, long))


@REG.add("co13_cumulative_curves", "cohort", """WITH a AS (SELECT lead_month, CAST(cohort_age_month AS INT) AS cohort_age_month, sum(revenue) AS revenue FROM cohort GROUP BY 1, 2),
  c AS (SELECT *, sum(revenue) OVER (PARTITION BY lead_month ORDER BY cohort_age_month) AS cumulative_revenue, dense_rank() OVER (ORDER BY lead_month DESC) AS r FROM a) SELECT * EXCLUDE (r) FROM c WHERE r <= 18""", rnd="revenue cumulative_revenue", digits=3)
def co13(spark, d):
    return C.cumulative_curves(frame(spark, d))


@REG.add("co13_leading_curves", "ccurve", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY lead_month, cohort_category ORDER BY cohort_age_month DESC) AS r, dense_rank() OVER (ORDER BY lead_month DESC) AS dr FROM ccurve),
  b AS (SELECT lead_month, cohort_category FROM (SELECT *, row_number() OVER (PARTITION BY lead_month ORDER BY cumulative_revenue DESC, cumulative_roas DESC NULLS LAST, cohort_category) AS k FROM l WHERE r = 1 AND dr <= 18) WHERE k = 1)
  SELECT c.* FROM ccurve c JOIN b USING (lead_month, cohort_category) WHERE cohort_age_month <= 18""", rnd="revenue cumulative_revenue cohort_cost cumulative_roas", digits=3)
def co13_leading(spark, d):
    long, s = both(spark, d)
    return C.leading_curves(C.payback_curve(long, s))


@REG.add("co14_heatmap", "cohort", """WITH l AS (SELECT DISTINCT lead_month FROM cohort ORDER BY 1 DESC LIMIT 24), t AS (SELECT DISTINCT transaction_month FROM cohort ORDER BY 1 DESC LIMIT 24),
  k AS (SELECT lead_month, transaction_month, sum(revenue) AS revenue FROM cohort WHERE lead_month IN (FROM l) AND transaction_month IN (FROM t) GROUP BY 1, 2)
  SELECT a.lead_month, b.transaction_month, coalesce(revenue, 0) AS revenue FROM (SELECT DISTINCT lead_month FROM k) a CROSS JOIN (SELECT DISTINCT transaction_month FROM k) b LEFT JOIN k USING (lead_month, transaction_month)""", rnd="revenue")
def co14(spark, d):
    return C.heatmap(frame(spark, d))


@REG.add("co14_heatmap_wide")
def co14_wide(spark, d):
    return C.heatmap_wide(C.heatmap(frame(spark, d)))


@REG.add("co15_company_label", "ckey", "SELECT lead_month, 'Company total' AS cohort_category, sum(matched_cost) AS cost FROM ckey GROUP BY 1", rnd="cost")
def co15(spark, d):
    by_month, _ = C.cost_rollups(A.cost(spark, d))
    return C.company_label(by_month.select("lead_month", F.lit(C.ALL_SOURCES).alias("cohort_category"), F.col("month_cost").alias("cost")))


view("uday", """SELECT *, date - first_purchase_date AS user_age_days, CAST(date > first_purchase_date AS INT) AS is_returning, CASE WHEN date - first_purchase_date <= 30 THEN '0-30' WHEN date - first_purchase_date <= 90 THEN '31-90'
   WHEN date - first_purchase_date <= 180 THEN '91-180' ELSE '180+' END AS cohort FROM (
   SELECT ds AS date, profile_id AS member_key, sum(y) AS revenue, count(DISTINCT purchase_id) AS purchases, min(ds) OVER (PARTITION BY profile_id) AS first_purchase_date FROM ord GROUP BY ds, profile_id)""", "ord")
view("sday", """SELECT *, revenue / entity_count AS rev_per_entity, purchases / entity_count AS purchases_per_entity, revenue / nullif(purchases, 0) AS avg_order_value
  FROM (SELECT date, count(DISTINCT member_key) AS entity_count, sum(revenue) AS revenue, CAST(sum(purchases) AS BIGINT) AS purchases FROM uday GROUP BY 1)""", "uday")
view("rday", """SELECT *, returning_revenue / returning_spenders AS revenue_per_returning_user, returning_purchases / returning_spenders AS purchases_per_returning_user FROM (
  SELECT date, count(*) AS returning_spenders, sum(revenue) AS returning_revenue, CAST(sum(purchases) AS BIGINT) AS returning_purchases FROM uday WHERE is_returning = 1 GROUP BY 1)""", "uday")


def days(spark, d):
    return S.user_days(A.revenue_orders(spark, d))


@REG.add("sp02_user_days", "uday", "SELECT * FROM uday", rnd="revenue")
def sp02(spark, d):
    return days(spark, d)


@REG.add("sp03_age_bucket", "uday", "SELECT cohort, count(*) AS n, min(user_age_days) AS youngest, max(user_age_days) AS oldest FROM uday GROUP BY 1")
def sp03(spark, d):
    return days(spark, d).groupBy("cohort").agg(F.count("*").alias("n"), F.min("user_age_days").alias("youngest"), F.max("user_age_days").alias("oldest"))


@REG.add("sp04_daily_spend", "sday", "SELECT * FROM sday", rnd="revenue rev_per_entity purchases_per_entity avg_order_value")
def sp04(spark, d):
    return S.daily_spend(days(spark, d))


@REG.add("sp04_daily_spend_by_leads", "model", """SELECT *, revenue / nullif(entity_count, 0) AS rev_per_entity, purchases / nullif(entity_count, 0) AS purchases_per_entity, revenue / purchases AS avg_order_value FROM (
  SELECT ds AS date, sum(leads) AS entity_count, sum(y) AS revenue, count(*) AS purchases FROM model GROUP BY 1)""", rnd="entity_count revenue rev_per_entity purchases_per_entity avg_order_value", digits=3)
def sp04_leads(spark, d):
    return S.daily_spend_by_leads(model_table(spark, d))


@REG.add("sp05_returning_daily", "rday", "SELECT * FROM rday ORDER BY date DESC LIMIT 60", rnd="returning_revenue revenue_per_returning_user purchases_per_returning_user")
def sp05(spark, d):
    return S.returning_daily(days(spark, d))


@REG.add("sp06_spending_cards", "sday rday", """SELECT a.*, b.*, (SELECT sum(returning_revenue) FROM rday) / total_revenue AS returning_revenue_share FROM (SELECT avg(entity_count) AS entity_count_avg, avg(rev_per_entity) AS revenue_per_entity_avg,
   avg(purchases_per_entity) AS purchases_per_entity_avg, avg(avg_order_value) AS avg_order_value_avg, sum(revenue) AS total_revenue FROM sday) a,
  (SELECT avg(returning_spenders) AS returning_spenders_avg, avg(returning_revenue) AS returning_revenue_avg, avg(revenue_per_returning_user) AS revenue_per_returning_user_avg, avg(purchases_per_returning_user) AS purchases_per_returning_user_avg FROM rday) b""",
  rnd="entity_count_avg revenue_per_entity_avg purchases_per_entity_avg avg_order_value_avg total_revenue returning_spenders_avg returning_revenue_avg revenue_per_returning_user_avg purchases_per_returning_user_avg returning_revenue_share", digits=3)
def sp06(spark, d):
    u = cut(days(spark, d))
    return S.spending_cards(S.daily_spend(u), S.returning_daily(u, None))


@REG.add("sp07_decomposition", "sday", """WITH r AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS rn FROM sday), f AS (SELECT avg(entity_count) FILTER (rn > 7) AS e0, avg(entity_count) FILTER (rn <= 7) AS e1, avg(purchases_per_entity) FILTER (rn > 7) AS f0,
   avg(purchases_per_entity) FILTER (rn <= 7) AS f1, avg(avg_order_value) FILTER (rn > 7) AS v0, avg(avg_order_value) FILTER (rn <= 7) AS v1 FROM r WHERE rn <= 37)
  SELECT 'Entities' AS component, (e1 - e0) * f0 * v0 AS impact_revenue FROM f UNION ALL SELECT 'Purchase frequency', e1 * (f1 - f0) * v0 FROM f UNION ALL SELECT 'Order value', e1 * f1 * (v1 - v0) FROM f""", rnd="impact_revenue", digits=3)
def sp07(spark, d):
    return S.decomposition(S.daily_spend(days(spark, d)))


@REG.add("sp08_age_cohorts", "uday", """SELECT CAST(CASE cohort WHEN '0-30' THEN 1 WHEN '31-90' THEN 2 WHEN '91-180' THEN 3 ELSE 4 END AS INT) AS position, *, revenue / users AS revenue_per_user, purchases / users AS purchases_per_user FROM (
  SELECT cohort, count(DISTINCT member_key) AS users, sum(revenue) AS revenue, CAST(sum(purchases) AS BIGINT) AS purchases FROM uday GROUP BY 1)""", rnd="revenue revenue_per_user purchases_per_user", digits=3)
def sp08(spark, d):
    return S.age_cohorts(days(spark, d))
