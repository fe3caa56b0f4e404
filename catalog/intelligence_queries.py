"""Model-based layers, stored runs and their comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import Registry, view
from catalog.frames import daily_model, model_table, series_daily
from catalog.model_queries import ranked, tournament
from revcast.operators import intelligence as I
from revcast.operators import heldout, runs, users
from revcast.session import checkpoint_dir, cut
from revcast.sources import adapters as A
from revcast.sources import sinks
from revcast.sources.readers import Sources, read_csv

REG = Registry()

view("dmonth", """WITH u AS (SELECT 'platform' AS dimension_type, platform AS dimension, * FROM model UNION ALL SELECT 'affiliate', affiliate, * FROM model UNION ALL SELECT 'campaign', campaign, * FROM model),
  g AS (SELECT dimension_type, dimension, CAST(date_trunc('month', ds) AS DATE) AS month, sum(y) AS y, sum(leads) AS leads, coalesce(sum(cost), 0) AS cost FROM u GROUP BY 1, 2, 3)
  SELECT *, lag(y) OVER w AS revenue_lag_1, avg(y) OVER (PARTITION BY dimension_type, dimension ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS revenue_3m_avg, lead(y) OVER w AS next_revenue,
    y / nullif(cost, 0) AS roas_calc, y / nullif(leads, 0) AS rpl_calc FROM g WINDOW w AS (PARTITION BY dimension_type, dimension ORDER BY month)""", "model")
view("behav", """WITH p AS (SELECT profile_id, sum(y) AS lifetime_revenue, coalesce(sum(y) FILTER (b <= 60), 0) AS recent_revenue, coalesce(sum(y) FILTER (b > 60 AND b <= 120), 0) AS prior_revenue, min(b) AS recency_days,
    count(DISTINCT ds) AS purchase_frequency, CAST(count(DISTINCT date_trunc('month', ds)) AS INT) AS months_active FROM (SELECT *, (SELECT max(ds) FROM ord) - ds AS b FROM ord) GROUP BY 1),
  x AS (SELECT *, (recent_revenue - prior_revenue) / greatest(abs(prior_revenue), 1) AS recent_spend_trend, lifetime_revenue / sum(lifetime_revenue) OVER () AS revenue_share FROM p)
  SELECT * FROM x WHERE lifetime_revenue >= (SELECT quantile_cont(lifetime_revenue, 0.75) FROM x)""", "ord")


def months(spark, d):
    return I.dimension_months(model_table(spark, d))


MONTH_COLS = "y leads cost revenue_lag_1 revenue_3m_avg next_revenue roas_calc rpl_calc"


@REG.add("in01_dimension_months", "dmonth", "SELECT * FROM dmonth", rnd=MONTH_COLS, digits=3)
def in01(spark, d):
    return months(spark, d)


def explained(spark, d, linear=False):
    return I.fit_explain_model(daily_model(spark, d), I.SMALL, linear=linear)


@REG.add("in02_explain_model")
def in02(spark, d):
    return explained(spark, d).metrics


@REG.add("in03_global_explanation")
def in03(spark, d):
    return I.global_explanation(I.contributions(explained(spark, d, True)), top=20)


@REG.add("in03_local_explanation")
def in03_local(spark, d):
    return I.local_explanation(I.contributions(explained(spark, d, True)))


@REG.add("in03_explanation_by_series")
def in03_series(spark, d):
    return I.explanation_by(I.contributions(explained(spark, d, True)), "series_id")


@REG.add("in04_rank_labels", "dmonth", """SELECT dimension_type, dimension, month, CASE WHEN min(next_revenue) OVER m = max(next_revenue) OVER m THEN 0 ELSE
   least(4, floor(row_number() OVER (PARTITION BY month ORDER BY next_revenue, dimension_type, dimension) / count(*) OVER m * 5)) END AS label FROM dmonth WHERE next_revenue IS NOT NULL WINDOW m AS (PARTITION BY month)""", rnd="label")
def in04_labels(spark, d):
    return I.rank_labels(months(spark, d)).select("dimension_type", "dimension", "month", "label")


@REG.add("in04_risk_scores", "dmonth", """WITH l AS (SELECT dimension_type, dimension, stddev_pop(y) AS volatility, max_by(y, month) AS y FROM dmonth GROUP BY 1, 2)
  SELECT dimension_type, dimension, volatility, coalesce(least(greatest(volatility / nullif(abs(y), 0), 0), 2), 0) / 2 AS risk_score FROM l""", rnd="volatility risk_score", digits=3)
def in04_risk(spark, d):
    return I.risk_scores(months(spark, d))


@REG.add("in04_opportunity_ranking")
def in04(spark, d):
    return I.opportunity_ranking(cut(months(spark, d)), I.SMALL)[0]


def _gaps(found, again, keys, measures, counts):
    """Counts, and how far the measures are from those that plain SQL gets from the same scores (0 where both are null)."""
    same = [F.when(found[m].isNull() & again[m].isNull(), 0.0).otherwise(found[m] - again[m]).alias(f"gap_{m}") for m in measures]
    return found.join(again, keys).select(*keys, *counts, *same)


LATE = """o AS (SELECT DISTINCT month AS fold FROM dmonth WHERE next_revenue IS NOT NULL ORDER BY 1 DESC LIMIT 3)"""


@REG.add("in04_ranking_quality", "dmonth", f"""WITH {LATE}, l AS (SELECT month AS fold, CASE WHEN min(next_revenue) OVER m = max(next_revenue) OVER m THEN 0 ELSE
     least(4, floor(row_number() OVER (PARTITION BY month ORDER BY next_revenue, dimension_type, dimension) / count(*) OVER m * 5)) END AS label
   FROM dmonth WHERE next_revenue IS NOT NULL AND month IN (SELECT fold FROM o) WINDOW m AS (PARTITION BY month))
  SELECT fold, count(*) AS "rows", sum(label)::DOUBLE AS label_sum, 0.0::DOUBLE AS gap_ndcg, 0.0::DOUBLE AS gap_top_bucket_capture FROM l GROUP BY 1""", rnd="label_sum gap_ndcg gap_top_bucket_capture", digits=6)
def in04_quality(spark, d):
    """Held-out months of the ranking: what was judged, and how far the measures are from those of the stored scores."""
    scores = I.heldout_ranking(cut(months(spark, d)), size=I.SMALL)
    again = spark.sql("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY prediction DESC, dimension_type, dimension) AS p, row_number() OVER (PARTITION BY fold ORDER BY label DESC, dimension_type, dimension) AS i,
        greatest(1, floor(count(*) OVER (PARTITION BY fold) * 0.2)) AS top, avg(label) OVER (PARTITION BY fold, prediction) AS shared FROM {scores})
      SELECT fold, CASE WHEN sum(label) > 0 THEN sum(shared / log2(p + 1)) / sum(label / log2(i + 1)) END AS ndcg, count_if(p <= top AND i <= top) / max(top) AS top_bucket_capture FROM r GROUP BY fold""", scores=scores)
    return _gaps(heldout.ranking_quality(scores), again, ["fold"], ["ndcg", "top_bucket_capture"], ["rows", "label_sum"])


MEASURES = ("auc", "log_loss", "precision", "recall", "f1")
NO_GAPS = ", ".join(f"0.0::DOUBLE AS gap_{m}" for m in MEASURES)


def _classifier_check(spark, scores):
    """Counts of held-out classifier scores and how far the measures are from a count over pairs and rows in SQL."""
    again = spark.sql("""WITH s AS (SELECT *, greatest(least(probability, 1 - 1e-5), 1e-5) AS p, probability >= 0.5 AS said, label = 1 AS hit FROM {scores}),
      v AS (SELECT fold, target, probability, count_if(hit) AS pos, count_if(NOT hit) AS neg FROM s GROUP BY 1, 2, 3),
      w AS (SELECT a.fold, a.target, sum(a.pos * b.neg * CASE WHEN a.probability > b.probability THEN 1.0D WHEN a.probability = b.probability THEN 0.5D ELSE 0.0D END) AS won
        FROM v a JOIN v b ON a.fold = b.fold AND a.target = b.target GROUP BY 1, 2),
      f AS (SELECT fold, target, avg(CASE WHEN hit THEN -ln(p) ELSE -ln(1 - p) END) AS log_loss, coalesce(try_divide(count_if(hit AND said), count_if(said)), 0.0D) AS precision,
        coalesce(try_divide(count_if(hit AND said), count_if(hit)), 0.0D) AS recall, count_if(hit) AS pos, count_if(NOT hit) AS neg FROM s GROUP BY 1, 2)
      SELECT f.fold, f.target, try_divide(won, pos * neg) AS auc, log_loss, precision, recall, coalesce(try_divide(2 * precision * recall, precision + recall), 0.0D) AS f1
      FROM f JOIN w ON f.fold = w.fold AND f.target = w.target""", scores=scores)
    return _gaps(heldout.classifier_quality(scores), again, ["fold", "target"], MEASURES, ["rows", "positives"])


@REG.add("in05_lead_quality_targets", "dmonth", """SELECT dimension_type, dimension, month, CAST(next_revenue > 0 AS DOUBLE) AS conversion_target,
  CAST(next_revenue >= (SELECT quantile_cont(next_revenue, 0.75) FROM dmonth) AS DOUBLE) AS high_value_target FROM dmonth WHERE next_revenue IS NOT NULL""", rnd="conversion_target high_value_target")
def in05_targets(spark, d):
    return I.lead_quality_targets(months(spark, d)).select("dimension_type", "dimension", "month", "conversion_target", "high_value_target")


@REG.add("in05_classifier_quality", "dmonth", f"""WITH {LATE}, n AS (SELECT *, lead(month) OVER (PARTITION BY dimension_type, dimension ORDER BY month) AS next_month FROM dmonth),
  q AS (SELECT fold, quantile_cont(next_revenue, 0.75) AS bound FROM o JOIN n ON next_month <= fold GROUP BY 1),
  t AS (SELECT fold, next_revenue > 0 AS pays, next_revenue >= bound AS high FROM q JOIN n ON month = fold WHERE next_revenue IS NOT NULL)
  SELECT fold, target, count(*) AS "rows", count(*) FILTER (label) AS positives, {NO_GAPS} FROM (SELECT fold, 'conversion_target' AS target, pays AS label FROM t UNION ALL SELECT fold, 'high_value_target', high FROM t) GROUP BY 1, 2""",
  rnd=" ".join(f"gap_{m}" for m in MEASURES), digits=6)
def in05_report(spark, d):
    return _classifier_check(spark, I.heldout_lead_quality(cut(months(spark, d)), size=I.SMALL))


@REG.add("in08_classifier_quality", "ord", f"""WITH o AS (SELECT DISTINCT last_day(ds) AS fold FROM ord ORDER BY 1 DESC LIMIT 3),
  x AS (SELECT fold, profile_id, y, ds, max(ds) OVER (PARTITION BY fold) - ds AS b FROM o JOIN ord ON ds <= fold WHERE profile_id IS NOT NULL),
  p AS (SELECT fold, profile_id, sum(y) AS lifetime, coalesce(sum(y) FILTER (b <= 60), 0) AS recent, coalesce(sum(y) FILTER (b > 60 AND b <= 120), 0) AS prior, min(b) AS recency FROM x GROUP BY 1, 2),
  k AS (SELECT p.*, (recent - prior) / greatest(abs(prior), 1) AS trend FROM p JOIN (SELECT fold, quantile_cont(lifetime, 0.75) AS q FROM p GROUP BY 1) USING (fold) WHERE lifetime >= q)
  SELECT fold, target, count(*) AS "rows", count(*) FILTER (label) AS positives, {NO_GAPS} FROM (SELECT fold, 'cooling_target' AS target, trend <= -0.15 OR recency >= 45 AS label FROM k
    UNION ALL SELECT fold, 'reactivation_target', prior > recent AND recency <= 90 FROM k UNION ALL SELECT fold, 'drop_target', trend <= -0.3 FROM k) GROUP BY 1, 2""",
  rnd=" ".join(f"gap_{m}" for m in MEASURES), digits=6)
def in08_report(spark, d):
    return _classifier_check(spark, I.heldout_behavior(cut(A.revenue_orders(spark, d)), size=I.SMALL))


@REG.add("in05_lead_quality")
def in05(spark, d):
    return I.lead_quality(cut(months(spark, d)), I.SMALL)


@REG.add("in06_residual_anomalies")
def in06(spark, d):
    daily = cut(daily_model(spark, d))
    local = I.local_explanation(I.contributions(I.fit_explain_model(daily, I.SMALL, linear=True)), rows=400)
    return I.residual_anomalies(I.fit_explain_model(daily, I.SMALL), local, rows=50)


@REG.add("in07_profile_behavior", "behav", "SELECT * FROM behav", rnd="lifetime_revenue recent_revenue prior_revenue recent_spend_trend revenue_share")
def in07(spark, d):
    return I.profile_behavior(A.revenue_orders(spark, d))


@REG.add("in08_behavior_targets", "behav", """SELECT profile_id, CAST(recent_spend_trend <= -0.15 OR recency_days >= 45 AS DOUBLE) AS cooling_target, CAST(prior_revenue > recent_revenue AND recency_days <= 90 AS DOUBLE) AS reactivation_target,
  CAST(recent_spend_trend <= -0.3 AS DOUBLE) AS drop_target, CASE WHEN recent_spend_trend <= -0.35 OR recency_days >= 60 THEN 'at risk' WHEN recent_spend_trend <= -0.12 THEN 'cooling'
   WHEN recent_spend_trend >= 0.25 AND recency_days <= 30 THEN 'heating up' WHEN recency_days <= 45 AND prior_revenue > recent_revenue THEN 'recoverable' ELSE 'stable' END AS rule_label FROM behav""",
  rnd="cooling_target reactivation_target drop_target")
def in08_targets(spark, d):
    return I.behavior_targets(I.profile_behavior(A.revenue_orders(spark, d))).select("profile_id", "cooling_target", "reactivation_target", "drop_target", "rule_label")


@REG.add("in08_whale_prediction")
def in08(spark, d):
    return I.whale_prediction(cut(I.profile_behavior(A.revenue_orders(spark, d))), I.SMALL)


@REG.add("in09_response_curve")
def in09(spark, d):
    return I.response_curve(explained(spark, d))


@REG.add("in10_scenario_simulation")
def in10(spark, d):
    return I.scenario_simulation(explained(spark, d))


@REG.add("in11_affiliate_quality", "dmonth", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY month DESC) AS bk, row_number() OVER (PARTITION BY dimension ORDER BY month) AS ix, count(*) OVER (PARTITION BY dimension) AS n FROM dmonth WHERE dimension_type = 'affiliate'),
  g AS (SELECT dimension, avg(y) FILTER (bk <= 3) AS rc, avg(y) FILTER (ix <= greatest(n - 3, 1)) AS pr, stddev_pop(y) AS vo, coalesce(avg(roas_calc) FILTER (bk <= 3), 0) AS ro, coalesce(avg(rpl_calc) FILTER (bk <= 3), 0) AS rp FROM a GROUP BY 1),
  l AS (SELECT avg(y) AS my, quantile_cont(rpl_calc, 0.5) AS mr FROM a),
  s AS (SELECT *, rc / greatest(vo, 1) AS co, (rc - pr) / greatest(abs(pr), 1) AS tr, least(100, greatest(0, tanh(rc / greatest(my, 1)) * 35 + tanh(ro) * 25 + tanh(rc / greatest(vo, 1) / 4) * 25 + tanh(rp / greatest(mr, 1)) * 15)) AS sc FROM g, l),
  t AS (SELECT *, CASE WHEN sc >= 75 THEN 'premium' WHEN sc >= 55 THEN 'growth' WHEN sc >= 35 THEN 'watch' ELSE 'weak' END AS ti, rc > pr * 1.15 AND tr < 0.1 AND vo > greatest(rc * 0.75, 1) AS br FROM s)
  SELECT dimension AS affiliate, sc AS quality_score, ti AS quality_tier, CASE WHEN ti = 'premium' AND NOT br THEN 'scale' WHEN ti = 'growth' THEN 'test' WHEN br OR ti = 'weak' THEN 'caution' ELSE 'monitor' END AS recommendation,
   rc AS recent_revenue, tr * 100 AS trend_pct, co AS consistency_score, ro AS recent_roas, rp AS recent_rpl, CAST(br AS INT) AS short_term_strong_long_term_weak FROM t""",
  rnd="quality_score recent_revenue trend_pct consistency_score recent_roas recent_rpl", digits=3)
def in11(spark, d):
    return I.affiliate_quality(months(spark, d))


@REG.add("in12_confidence_rows", "dc", """WITH f AS (SELECT least(1, greatest(0, stddev_pop(y) / greatest(abs(avg(y)), 1))) AS r FROM (SELECT y FROM dc ORDER BY ds DESC LIMIT 30))
  SELECT 'forecast / revenue model' AS surface, CASE WHEN r >= 0.7 THEN 'high risk' WHEN r >= 0.4 THEN 'moderate risk' ELSE 'low risk' END AS risk_label, greatest(0, 1 - r - 0.15) AS confidence_low, greatest(0, 1 - r + 0.15) AS confidence_high FROM f
  UNION ALL SELECT 'rankings', 'moderate risk', 0.55, 0.8 UNION ALL SELECT 'simulations', 'moderate risk', 0.5, 0.78""", rnd="confidence_low confidence_high")
def in12(spark, d):
    company = series_daily(spark, d).groupBy("ds").agg(F.sum("y").alias("y"))
    return I.confidence_rows(company, ["ranking", "simulation"])


@REG.add("in14_merge_recommendations", "dmonth", """WITH l AS (SELECT dimension_type, dimension FROM dmonth GROUP BY 1, 2) SELECT dimension_type, dimension, CASE WHEN dimension_type = 'platform' THEN 'history' ELSE 'model' END AS source FROM l""")
def in14(spark, d):
    latest = cut(I.latest_month(months(spark, d)).select("dimension_type", "dimension"))
    return I.append_new(latest.filter("dimension_type = 'platform'"), latest, ["dimension_type", "dimension"], "model")


@REG.add("in14_user_predictions")
def in14_users(spark, d):
    orders = cut(A.revenue_orders(spark, d))
    scores = I.whale_prediction(cut(I.profile_behavior(orders)), I.SMALL)
    return I.with_user_predictions(users.whale_watch(orders), scores)


@REG.add("in13_intelligence_layers")
def in13(spark, d):
    table = cut(model_table(spark, d).select("ds", "y", "leads", "cost", "platform", "affiliate", "campaign", "profile_id"))
    daily = cut(daily_model(spark, d))
    out = I.build_intelligence(table, daily, ["ranking", "affiliates", "returns", "confidence"], I.SMALL)
    rows = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("layer"), "rows") for n, t in out.tables.items()]
    total = rows[0]
    for r in rows[1:]:
        total = total.unionByName(r)
    return total


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/revcast-{name}-{uuid.uuid4().hex}"


@REG.add("in15_model_artefact")
def in15(spark, d):
    _, model = I.opportunity_ranking(cut(months(spark, d)), I.SMALL)
    path = _folder(spark, "model")
    I.save_model(model, path, "ranking", I.MONTH_FEATURES, {"target": "next month's class"})
    return spark.read.json(f"{path}/ranking_meta")


@REG.add("io01_csv_scan", "", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def io01(spark, d):
    path = sinks.write_csv(A.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), _folder(spark, "csv"))
    return read_csv(spark, path)


@REG.add("io03_source_resolution", "ord", "SELECT purchase_id, y FROM ord", rnd="y")
def io03(spark, d):
    cleaned = _folder(spark, "cleaned")
    sinks.write_cleaned(A.revenue_orders(spark, d).select("purchase_id", "y"), cleaned)
    return Sources(spark, raw={"revenue": f"{d}/orders.parquet"}, cleaned={"revenue": cleaned}).get("revenue")


@REG.add("io07_csv_forecast_sink", "finalf", "SELECT model, series_id, CAST(step AS VARCHAR) AS step, CAST(ds AS VARCHAR) AS ds FROM finalf")
def io07(spark, d):
    f = tournament(spark, d).final.select("model", "series_id", "step", "ds")
    return read_csv(spark, sinks.write_csv(f, _folder(spark, "forecast")))


@REG.add("io08_result_bundle", "d", """SELECT series_id, sum(y) AS y FROM d GROUP BY 1 UNION ALL SELECT 'Total', sum(y) FROM d""", rnd="y")
def io08(spark, d):
    daily = series_daily(spark, d)
    paths = sinks.bundle({"totals": sinks.with_totals(daily, "series_id", ["y"])}, _folder(spark, "bundle"))
    return spark.read.parquet(paths["totals"])


@REG.add("io09_cleaned_sink", "ord", "SELECT ds, platform, purchase_id FROM ord")
def io09(spark, d):
    return sinks.write_cleaned(A.revenue_orders(spark, d).select("ds", "platform", "purchase_id"), _folder(spark, "source"))


def _two_runs(spark, d):
    t = tournament(spark, d)
    store = sinks.RunStore(spark, _folder(spark, "runs"))
    rank = ranked(t)
    for run_id, model, depth in (("run_1", "naive", "fast"), ("run_2", "trend_drift", "fast"), ("run_1", "full_average", "fast")):
        store.save(run_id, {"forecast": t.final.filter(F.col("model") == model), "ranking": rank})
        store.register(run_id, f"2026-01-0{run_id[-1]}", {"horizon": "30", "model": model, "depth": depth})
    return store


@REG.add("io10_run_store", "finalf", "SELECT 'run_1' AS run_id, series_id, ds, yhat FROM finalf WHERE model = 'full_average' UNION ALL SELECT 'run_2', series_id, ds, yhat FROM finalf WHERE model = 'trend_drift'", rnd="yhat")
def io10(spark, d):
    return _two_runs(spark, d).load("forecast").select("run_id", "series_id", "ds", "yhat")


@REG.add("io11_list_runs", sql="""SELECT CAST(o_orderkey AS VARCHAR) AS run_id, max(strftime(o_orderdate, '%Y-%m-%d')) AS created_at FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 50""")
def io11(spark, d):
    orders = A.table(spark, d, "orders")
    entries = orders.select(F.col("o_orderkey").cast("string").alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    return sinks.list_runs(entries, recent=50)


@REG.add("jn21_compare_forecasts", "finalf", """SELECT ds, a.y AS run_a, b.y AS run_b, b.y - a.y AS delta FROM (SELECT ds, sum(yhat) AS y FROM finalf WHERE model = 'full_average' GROUP BY 1) a
  FULL JOIN (SELECT ds, sum(yhat) AS y FROM finalf WHERE model = 'trend_drift' GROUP BY 1) b USING (ds) ORDER BY ds LIMIT 60""", rnd="run_a run_b delta")
def jn21(spark, d):
    f = tournament(spark, d).final
    return runs.compare_forecasts(f.filter("model = 'full_average'"), f.filter("model = 'trend_drift'"), rows=60)


@REG.add("jn22_compare_settings", "", """SELECT coalesce(a.k, b.k) AS key, a.v AS run_a, b.v AS run_b, CAST(a.v IS DISTINCT FROM b.v AS INT) AS different FROM
  (SELECT CAST(o_custkey AS VARCHAR) AS k, min(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN
  (SELECT CAST(o_custkey AS VARCHAR) AS k, max(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON a.k = b.k""")
def jn22(spark, d):
    orders = A.table(spark, d, "orders")

    def side(status, pick):
        return orders.filter(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").cast("string").alias("key")).agg(pick("o_orderpriority").alias("value"))

    return runs.compare_settings(side("F", F.min), side("P", F.max))


@REG.add("ev13_run_summaries", "finalf ranked", """WITH b AS (SELECT model AS best_model, wape, mae, rmse, smape, bias FROM ranked WHERE rank = 1), f AS (SELECT CASE model WHEN 'naive' THEN 'a' ELSE 'b' END AS run, count(*) AS forecast_rows, sum(yhat) AS forecast_total,
   avg(yhat) AS forecast_avg, min(ds) AS forecast_start, max(ds) AS forecast_end FROM finalf WHERE model IN ('naive', 'trend_drift') GROUP BY 1) SELECT * FROM f, b""", rnd="forecast_total forecast_avg wape mae rmse smape bias", digits=3)
def ev13(spark, d):
    t = tournament(spark, d)
    r = ranked(t)
    return runs.run_summary("a", t.final.filter("model = 'naive'"), r).unionByName(runs.run_summary("b", t.final.filter("model = 'trend_drift'"), r))


@REG.add("ev13_compare_models", "ranked", """SELECT r.run, rank, model, wape, final_rank_score FROM ranked, (VALUES ('a'), ('b')) r(run) WHERE rank <= 10""", rnd="wape final_rank_score")
def ev13_models(spark, d):
    r = ranked(tournament(spark, d))
    return runs.compare_models(r, r, top=10)


@REG.add("ba29_run_history", "model", "SELECT ds, sum(y) AS y, sum(leads) AS leads, sum(cost) AS cost FROM model GROUP BY 1", rnd="y leads cost")
def ba29(spark, d):
    from revcast.operators.daily import run_history

    store = sinks.RunStore(spark, _folder(spark, "history"))
    store.save("run_1", {"modeling": model_table(spark, d).select("ds", "y", "leads", "cost")})
    return run_history(store.load("modeling", "run_1"))
