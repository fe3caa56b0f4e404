from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from revcast.operators import heldout, intelligence
from revcast.operators.intelligence import ModelSize

TINY = ModelSize(3, 2, 0.3)


def test_ranking_measures_equal_a_plain_loop(spark):
    rng = random.Random(3)
    data = [(dt.date(2026, f, 1), f"k{i:03d}", float(rng.randint(0, 4)), float(rng.randint(0, 9))) for f in (1, 2) for i in range(37 * f)]
    data += [(dt.date(2026, 3, 1), "only", 0.0, 1.0)]
    got = {r.fold: r for r in heldout.ranking_quality(spark.createDataFrame(data, "fold date, dimension string, label double, prediction double")).collect()}
    for fold in {d[0] for d in data}:
        own = [d[1:] for d in data if d[0] == fold]
        by_score = sorted(own, key=lambda d: (-d[2], d[0]))
        by_label = sorted(own, key=lambda d: (-d[1], d[0]))
        mean = {p: sum(d[1] for d in own if d[2] == p) / sum(d[2] == p for d in own) for p in {d[2] for d in own}}
        best = sum(d[1] / math.log2(i + 2) for i, d in enumerate(by_label))
        gain = sum(mean[d[2]] / math.log2(i + 2) for i, d in enumerate(by_score))
        top = max(1, int(len(own) * 0.2))
        r = got[fold]
        assert (r.rows, r.label_sum) == (len(own), sum(d[1] for d in own))
        assert r.ndcg is None if best == 0 else abs(r.ndcg - gain / best) < 1e-12
        assert abs(r.top_bucket_capture - len({d[0] for d in by_score[:top]} & {d[0] for d in by_label[:top]}) / top) < 1e-12


def test_classifier_measures_equal_a_plain_loop(spark):
    rng = random.Random(4)
    data = [(1, t, f"u{i:03d}", float(rng.random() < 0.3), rng.randint(0, 20) / 20) for t in ("a", "b") for i in range(90)]
    data += [(2, "a", f"u{i}", 1.0, 0.4) for i in range(5)]
    got = {(r.fold, r.target): r for r in heldout.classifier_quality(spark.createDataFrame(data, "fold int, target string, id string, label double, probability double")).collect()}
    for key in {d[:2] for d in data}:
        own = [d[3:] for d in data if d[:2] == key]
        pos, neg = [p for y, p in own if y == 1], [p for y, p in own if y == 0]
        r = got[key]
        assert (r.rows, r.positives) == (len(own), len(pos))
        if neg:
            assert abs(r.auc - sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)) < 1e-12
        else:
            assert r.auc is None
        q = [(y, min(max(p, 1e-5), 1 - 1e-5)) for y, p in own]
        assert abs(r.log_loss - sum(-math.log(p if y else 1 - p) for y, p in q) / len(q)) < 1e-12
        tp, said = sum(p >= 0.5 for p in pos), sum(p >= 0.5 for _, p in own)
        assert abs(r.precision - (tp / said if said else 0)) < 1e-12 and abs(r.recall - tp / len(pos)) < 1e-12
        assert abs(r.f1 - (2 * tp / (said + len(pos)))) < 1e-12


@pytest.fixture(scope="module")
def sales(spark):
    rng = random.Random(7)
    data = []
    for k in range(12):
        for month in range(10):
            for _ in range(2):
                day = dt.date(2025, month + 1, rng.randint(1, 28))
                data.append((day, f"p{k % 3}", f"c{k}", rng.random() * 100 * (1 + k), float(rng.randint(1, 9)), rng.random() * 20, f"u{rng.randint(0, 15)}"))
    return spark.createDataFrame(data, "ds date, platform string, campaign string, y double, leads double, cost double, profile_id string").cache()


def later(sales):
    """The same sales with another last month."""
    return sales.withColumn("y", F.when(F.col("ds") >= F.lit(dt.date(2025, 10, 1)), 1000.0 - F.col("y")).otherwise(F.col("y")))


def test_an_outcome_changes_no_score_of_its_own_month(spark, sales):
    def scores(table, out):
        frame = intelligence.dimension_months(table, ["platform", "campaign"])
        return {(r.fold, r.dimension_type, r.dimension, r["target"] if "target" in r else ""): r for r in out(frame).collect()}

    for out, value in ((lambda f: intelligence.heldout_ranking(f, 2, TINY), "prediction"), (lambda f: intelligence.heldout_lead_quality(f, 2, TINY), "probability")):
        a, b = scores(sales, out), scores(later(sales), out)
        assert set(a) == set(b) and {k[0] for k in a} == {dt.date(2025, 8, 1), dt.date(2025, 9, 1)}
        assert all(abs(a[k][value] - b[k][value]) < 1e-12 for k in a)
        assert any(a[k]["label"] != b[k]["label"] for k in a)


def test_users_are_judged_a_month_after_the_fit(spark, sales):
    rows = intelligence.heldout_behavior(sales, 2, TINY).collect()
    assert {r.fold for r in rows} == {dt.date(2025, 9, 30), dt.date(2025, 10, 31)} and {r.target for r in rows} == set(intelligence.BEHAVIOR_TARGETS)
    assert all(0 <= r.probability <= 1 for r in rows)
    before = {(r.profile_id, r.target): r.probability for r in rows if r.fold.month == 9}
    again = intelligence.heldout_behavior(later(sales), 2, TINY).collect()
    assert before == {(r.profile_id, r.target): r.probability for r in again if r.fold.month == 9}


def test_lead_quality_moves_the_projection(spark):
    rng = random.Random(2)
    data, rate = [], 5.0
    for i in range(240):
        rate = 5.0 + 2 * math.sin(i / 20)
        leads = rng.randint(20, 40)
        data.append(("s", dt.date(2025, 1, 1) + dt.timedelta(days=i), leads * rate, float(leads), rng.random() * 50))
    daily = spark.createDataFrame(data, "series_id string, ds date, y double, leads double, cost double")
    e = intelligence.fit_explain_model(daily, linear=True)
    assert "revenue_per_lead" in e.names
    out = {r.case: r.projected_revenue for r in intelligence._simulate(e, [("same", 1.0, 1.0, 1.0), ("better", 1.0, 1.0, 1.2), ("worse", 1.0, 1.0, 0.8)]).collect()}
    assert out["better"] != out["same"] and abs((out["better"] - out["same"]) + (out["worse"] - out["same"])) < 1e-6
