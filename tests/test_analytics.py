from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from revcast.operators import cohort as C
from revcast.operators import daily, drivers, intelligence, planning, runs, spending, stats, users
from revcast.operators.align import mapped_rollup
from revcast.sources.sinks import RunStore, json_ready, list_runs, with_totals

from conftest import rows


def m(text):
    return dt.date.fromisoformat(text + "-01")


def cohorts(spark, data, cost, platform=None):
    group = "platform" if platform else None
    df = spark.createDataFrame([(m(a), m(b), float(v), platform) for a, b, v in data], "lead_month date, transaction_month date, revenue double, platform string")
    spent = spark.createDataFrame([(m(a), float(v), platform) for a, v in cost], "ds date, cost double, platform string")
    long = C.cohort_long_frame(df, group, group)
    by_month, by_key = C.cost_rollups(spent, group)
    scored = C.cohort_scores(C.allocate_cohort_cost(C.cohort_aggregate(long), by_month, by_key if group else None), split=bool(group))
    return long, scored


def test_cohort_roas_and_payback(spark):
    data = [("2026-01", "2026-01", 80), ("2026-01", "2026-02", 70), ("2026-02", "2026-02", 60)]
    long, scored = cohorts(spark, data, [("2026-01", 100), ("2026-02", 100)])
    got = {r.lead_month.month: r for r in C.roas_table(scored, long).collect()}
    assert (got[1].roas, got[1].roas_pct, got[1].payback_pct) == (1.5, 150.0, 100.0)
    assert (got[2].roas, round(got[2].roas_pct, 9), got[2].payback_pct) == (0.6, 60.0, 60.0)
    assert got[1].time_to_100_roas_months == 1.0 and got[2].time_to_100_roas_months is None


def _months(first, n):
    y, k = first
    return [f"{y + (k - 1 + i) // 12}-{(k - 1 + i) % 12 + 1:02d}" for i in range(n)]


def test_payback_summary_uses_the_latest_twelve_months(spark):
    months = _months((2024, 1), 15)
    data = [(x, x, 1000 if i == 0 else 80) for i, x in enumerate(months)]
    long, scored = cohorts(spark, data, [(x, 100) for x in months])
    summary = C.payback_summary(C.roas_table(scored, long))
    assert m("2024-01") not in {r.lead_month for r in summary.collect()} and summary.count() > 0


def test_missing_recent_roas_never_scales(spark):
    months = _months((2024, 1), 14)
    data = [(x, x, 100 if i < 2 else 1000) for i, x in enumerate(months)]
    _, scored = cohorts(spark, data, [(x, 100) for x in months[:2]], platform="Meta")
    r = C.platform_table(scored).first()
    assert r.recent_roas is None and r.action == "Verify Recent ROAS"


def test_projection_equals_the_month_by_month_loop(spark):
    rng = random.Random(5)
    data, want = [], {}
    for i in range(60):
        key = dt.date(2000 + i // 12, i % 12 + 1, 1)
        cumulative, total = [], 0.0
        for age in range(rng.randint(1, 6)):
            total += rng.choice([0.0, rng.uniform(1, 100)])
            cumulative.append(total)
            data.append((key, age, total, 300.0))
        gains = [b - a for a, b in zip([0.0] + cumulative[:-1], cumulative)]
        positive = [g for g in gains if g > 0]
        if total >= 300:
            want[key] = 0.0
        elif not positive:
            want[key] = None
        else:
            ratios = sorted(b / a for a, b in zip(positive[:-1], positive[1:]))
            mid = (ratios[(len(ratios) - 1) // 2] + ratios[len(ratios) // 2]) / 2 if ratios else None
            d = min(0.98, max(0.55, mid)) if ratios else 0.9
            step, reached, want[key] = positive[-1], total, None
            for k in range(1, 37):
                step *= d
                reached += step
                if reached >= 300:
                    want[key] = float(k)
                    break
    df = spark.createDataFrame(data, "lead_month date, cohort_age_month int, cumulative_revenue double, cohort_cost double")
    got = {r.lead_month: r.projected_time_to_100_roas_months for r in C.projected_break_even(df).collect()}
    assert got == want


def test_leftover_cost_goes_to_unmatched_groups(spark):
    groups = spark.createDataFrame([(m("2026-01"), "a", "a", 30.0), (m("2026-01"), "b", "b", 10.0), (m("2026-01"), "c", "c", 30.0)],
                                   "lead_month date, cohort_category string, cost_match_key string, total_revenue double")
    by_key = spark.createDataFrame([(m("2026-01"), "a", 60.0)], "lead_month date, cost_match_key string, matched_cost double")
    by_month = spark.createDataFrame([(m("2026-01"), 100.0)], "lead_month date, month_cost double")
    got = {r.cohort_category: r.cost for r in C.allocate_cohort_cost(groups, by_month, by_key).collect()}
    assert got == {"a": 60.0, "b": 10.0, "c": 30.0}


def test_scenario_table_expected_row(spark):
    base = spark.createDataFrame([(1250300.0, 17638.0, 95968.0, 13.0283)], "revenue double, cost double, leads double, revenue_per_lead double")
    r = {x.scenario: x for x in planning.scenario_table(base).collect()}["Expected"]
    assert (r.projected_spend, r.projected_leads, round(r.projected_revenue, 0)) == (17638.0, 95968.0, 1250300.0)
    assert round(r.projected_roas, 2) == 70.89


def test_planning_profile_prefers_raw_monthly_totals(spark):
    d = dt.date(2026, 3, 1)
    hist = spark.createDataFrame([(d, 1250300.0)], "ds date, y double")
    cost = spark.createDataFrame([(d, 700000.0), (dt.date(2026, 3, 9), 61852.922)], "ds date, cost double")
    leads = spark.createDataFrame([(d, 80000.0), (d, 15968.0)], "ds date, leads double")
    r = planning.planning_profile(
        hist, mapped_rollup(leads, "ds", "leads", "month").withColumnRenamed("ds", "month"),
        mapped_rollup(cost, "ds", "cost", "month").withColumnRenamed("ds", "month"),
    ).first()
    assert (round(r.cost, 3), r.leads, round(r.roas, 2)) == (761852.922, 95968.0, 1.64)


def test_daily_lead_totals_per_day(spark):
    a, b = dt.date(2026, 3, 1), dt.date(2026, 3, 2)
    df = spark.createDataFrame([(a, 100.0), (a, 50.0), (b, 75.0), (b, 25.0)], "ds date, leads double")
    assert [r.leads for r in mapped_rollup(df, "ds", "leads").orderBy("ds").collect()] == [150.0, 100.0]


def history(spark, n=60):
    start = dt.date(2026, 1, 1)
    data = [(start + dt.timedelta(days=i), 100.0 + i + (500 if i == 50 else 0), 10.0 + i % 5, 40.0 + (i % 3)) for i in range(n)]
    return spark.createDataFrame(data, "ds date, y double, leads double, cost double")


def test_anomaly_is_found_and_short_history_falls_back(spark):
    hits = daily.anomalies(history(spark)).collect()
    assert [(r.ds, r.severity, r.direction) for r in hits if r.zscore > 5] == [(dt.date(2026, 2, 20), "High", "Above trend")]
    assert daily.anomaly_scores(history(spark, 3)).count() == 1


def test_tracking_and_alerts(spark):
    t = daily.tracking(daily.daily_history(history(spark)))
    r = {x.metric: x for x in t.collect()}
    assert r["Revenue"].recent_7_avg == sum(100.0 + i for i in range(53, 60)) / 7
    assert daily.alerts(t, daily.anomalies(history(spark))).count() >= 1


def test_driver_impact_of_a_constant_driver_is_left_out(spark):
    df = history(spark).withColumn("clicks", F.lit(3.0))
    assert "clicks" not in {r.driver for r in drivers.driver_impact(df).collect()}


def test_whales(spark):
    d = dt.date(2026, 3, 1)
    data = [("a", d, 30000.0, "x"), ("a", d - dt.timedelta(days=40), 60000.0, "y"), ("b", d - dt.timedelta(days=50), 600.0, "x"), (" ", d, 9.0, "x")]
    df = spark.createDataFrame(data, "profile_id string, ds date, y double, platform string")
    r = {x.whale_id: x for x in users.whale_watch(df).collect()}
    assert set(r) == {"a", "b"}
    assert (r["a"].whale_tier, r["a"].delta_pct, r["a"].status, r["a"].platform) == ("God Tier", -50.0, "At risk", "y")
    assert (r["b"].status, r["b"].whale_tier) == ("Dormant", "High Value")


def test_spending(spark):
    d = dt.date(2026, 1, 1)
    data = [("a", d, 10.0, 1), ("a", d, 5.0, 1), ("a", d + dt.timedelta(days=40), 20.0, 2), ("b", d, 1.0, 3)]
    days = spending.user_days(spark.createDataFrame(data, "profile_id string, ds date, y double, purchase_id int"))
    got = {(r.member_key, r.date): (r.revenue, r.purchases, r.cohort) for r in days.collect()}
    assert got[("a", d)] == (15.0, 1, "0-30") and got[("a", d + dt.timedelta(days=40))] == (20.0, 1, "31-90")
    assert [(r.cohort, r.users) for r in spending.age_cohorts(days).orderBy("position").collect()] == [("0-30", 2), ("31-90", 1)]
    parts = sum(r.impact_revenue for r in spending.decomposition(spending.daily_spend(days)).collect())
    assert math.isfinite(parts)


def test_frontier_averages_ties(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("b", 4.0, 2.0), ("c", 9.0, 1.0)], "segment string, revenue double, cost double")
    got = {r.segment: r.efficiency_score for r in stats.efficiency_frontier(df).collect()}
    assert got == {"a": 0.5, "b": 0.5, "c": 1.0}


def test_contributions_add_up_to_the_prediction(spark):
    df = history(spark).withColumn("series_id", F.lit("s"))
    e = intelligence.fit_explain_model(df, linear=True)
    parts = intelligence.contributions(e)
    total = parts.groupBy("ds").agg(F.sum("contribution").alias("net"))
    pred = e.model.transform(e.frame).select("ds", "prediction")
    base = pred.agg(F.avg("prediction")).first()[0]
    worst = pred.join(total, "ds").select(F.max(F.abs(F.col("prediction") - base - F.col("net")))).first()[0]
    assert worst < 1e-6 * abs(base)


def test_run_store_overwrites_only_its_run(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    a = spark.createDataFrame([(1, 2.0)], "k int, v double")
    store.save("r1", {"t": a})
    store.save("r2", {"t": a})
    store.save("r1", {"t": a.withColumn("v", F.lit(9.0))})
    assert sorted((r.run_id, r.v) for r in store.load("t").collect()) == [("r1", 9.0), ("r2", 2.0)]
    store.register("r1", "2026-01-01", {"h": "1"})
    store.register("r2", "2026-01-02", {"h": "2"})
    assert [r.run_id for r in list_runs(store.load("settings")).collect()] == ["r2", "r1"]
    diff = runs.compare_settings(store.load("settings", "r1"), store.load("settings", "r2")).first()
    assert (diff.run_a, diff.run_b, diff.different) == ("1", "2", 1)


def test_json_ready_and_totals(spark):
    df = spark.createDataFrame([(float("nan"), dt.date(2026, 1, 2)), (1.5, None)], "v double, d date")
    assert rows(json_ready(df)) == [(None, "2026-01-02"), (1.5, None)]
    t = with_totals(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double"), "k", ["v"])
    assert sorted(rows(t)) == [("Total", 3.0), ("a", 1.0), ("b", 2.0)]


@pytest.mark.parametrize("layer", ["affiliates", "confidence"])
def test_layers_report_instead_of_failing(spark, layer):
    table = history(spark).withColumn("platform", F.lit("p"))
    out = intelligence.build_intelligence(table, table.withColumn("series_id", F.lit("s")), [layer, "whales"])
    assert layer in out.tables and "whales" in out.errors


def test_a_budget_without_a_limit_keeps_every_name(spark):
    day = dt.date(2026, 3, 1)
    data = [(day - dt.timedelta(days=i), name, float(100 + 10 * k + i)) for k, name in enumerate("abc") for i in range(70)]
    df = spark.createDataFrame(data, "ds date, platform string, y double")
    assert sorted(r["name"] for r in planning.dimension_budget(df, {"platform": "platform"}).collect()) == ["a", "b", "c"]
    assert planning.dimension_budget(df, {"platform": "platform"}, top=2).count() == 2
