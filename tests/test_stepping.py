"""One-step models: features of a step, solvers, forecasts."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from revcast.operators import linear, stepping, trees
from revcast.operators.features import build_features, recipe


def daily(spark, n=140, names=("s", "t"), gap=(11, 12)):
    rng = np.random.default_rng(4)
    start = dt.date(2024, 11, 3)
    rows = []
    for k, name in enumerate(names):
        for i in range(n - 20 * k):
            if i in gap and k == 0:
                continue
            y = float(200 + 30 * k + i + 20 * np.sin(2 * np.pi * i / 7) + rng.normal(0, 5))
            rows.append((name, start + dt.timedelta(days=i), 0.0 if i == 60 else y, None if i % 9 == 4 else float(10 + i % 5), float(50 + i % 11), int(i % 30 == 0)))
    return spark.createDataFrame(rows, "series_id string, ds date, y double, leads double, cost double, event_flag int")


def as_train(df):
    return df.withColumn("fold", F.lit(0))


PROFILES = [("ridge", None), ("gradient_boosting", "long"), ("gradient_boosting", None), ("random_forest", "standard")]


@pytest.mark.parametrize(("model", "profile"), PROFILES)
def test_a_step_sees_what_training_sees(spark, model, profile):
    """Cut each series, step on with the true values: every feature must equal the window expressions' on the whole series."""
    horizon = 12
    whole = daily(spark).cache()
    r = recipe(model, "D", profile)
    rn = F.expr("row_number() OVER (PARTITION BY series_id ORDER BY ds DESC)")
    marked = whole.withColumn("back", rn)
    train = as_train(marked.where(f"back > {horizon}").drop("back"))
    future = marked.where(f"back <= {horizon}").select("series_id", "ds", F.coalesce("leads", F.lit(11.5)).alias("leads"), "cost", "event_flag")
    filled = marked.withColumn("leads", F.when(F.col("back") <= horizon, F.coalesce("leads", F.lit(11.5))).otherwise(F.col("leads"))).drop("back")
    want = build_features(as_train(filled), replace(r, keys=("fold", "series_id"), flags=False), bounded=False)
    names = [c for c in stepping.model_rows(train, r).columns if c not in ("fold", "series_id", "ds", "y")]
    assert set(names) == set(stepping.recipe_inputs(r, ["leads", "cost"], ["event_flag"]))
    rows = {(x["series_id"], x["ds"]): x for x in want.collect()}
    batch = stepping.states(train, r, horizon, future).orderBy("series_id").toArrow().combine_chunks().to_batches()[0]
    stepper = stepping.Stepper(batch, r, horizon)
    loose = train.groupBy().agg(F.max("leads"), F.max("cost")).first()
    assert loose[0] == 14.0 and loose[1] == 60.0
    for k in range(horizon):
        got = stepper.features()
        assert set(names) <= set(got)
        true = []
        for i, name in enumerate(["s", "t"]):
            day = stepper.days[i, k].astype(object)
            row = rows[name, day]
            true.append(row["y"])
            for c in names:
                a, b = float(got[c][i]), row[c]
                b = float("nan") if b is None else float(b)
                if c == "series_age_frac":
                    assert a == 1.0
                else:
                    assert (np.isnan(a) and np.isnan(b)) or abs(a - b) <= 1e-7 * max(1.0, abs(b)), (c, k, a, b)
        stepper.advance(np.array(true))


def test_unknown_helpers_keep_their_level_and_flags_come_from_the_calendar(spark):
    df = daily(spark, 100, ("s",), ())
    cutoff = dt.date(2024, 11, 3) + dt.timedelta(days=85)
    train = df.where(F.col("ds") < F.lit(cutoff)).withColumn("fold", F.lit(1)).unionByName(as_train(df))
    r = recipe("ridge")
    state = {x["fold"]: x for x in stepping.states(train, r, 7).collect()}
    leads = [x["leads"] for x in df.where(F.col("ds") < F.lit(cutoff)).orderBy("ds").collect()][-28:]
    known = [v for v in leads if v is not None]
    assert np.allclose(state[1]["ahead_leads"], np.mean(known))
    assert state[1]["ahead_event_flag"] == [0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    assert state[0]["ahead_event_flag"] == [0.0] * 7


def _rows(spark):
    return stepping.model_rows(as_train(daily(spark)).unionByName(as_train(daily(spark, 100)).withColumn("fold", F.lit(1))), recipe("ridge")).cache()


@pytest.mark.parametrize("model", ["ridge", "elasticnet"])
def test_fits_are_optimal(spark, model):
    rows = _rows(spark)
    fits = linear.linear_fits(rows, model)
    assert sorted(fits) == [0, 1]
    off = linear.conditions(rows, fits, model).collect()
    assert {x["fold"] for x in off} == {0, 1} and max(x["violation"] for x in off) < 1e-7
    moved = {f: replace(fit, weights=fit.weights + 0.5) for f, fit in fits.items()}
    assert max(x["violation"] for x in linear.conditions(rows, moved, model).collect()) > 1e-3
    if model == "elasticnet":
        assert 0 < (fits[0].weights == 0).sum() < len(fits[0].names)


def test_ridge_equals_the_normal_equations(spark):
    rows = _rows(spark)
    fit = linear.linear_fits(rows, "ridge")[0]
    table = rows.where("fold = 0").toPandas()
    x = table[fit.names].to_numpy(float)
    z = (x - x.mean(0)) / np.where(x.std(0) > 1e-6, x.std(0), 1.0)
    y = table["y"].to_numpy()
    want = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (y - y.mean()))
    assert np.allclose(fit.weights, want, rtol=1e-5, atol=1e-5) and np.allclose(fit.predict(x), z @ want + y.mean())


@pytest.mark.parametrize("model", ["ridge", "elasticnet"])
def test_linear_forecast_rows(spark, model):
    train = as_train(daily(spark)).unionByName(as_train(daily(spark, 100)).withColumn("fold", F.lit(1)))
    out = linear.linear_forecast(train, [0, 1], 9, "D", model).collect()
    assert len(out) == 2 * 2 * 9 and {r["step"] for r in out} == set(range(1, 10))
    assert all(r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"] and r["yhat"] >= 0 for r in out)
    last = train.groupBy("fold", "series_id").agg(F.max("ds").alias("d")).collect()
    ends = {(r["fold"], r["series_id"]): r["d"] for r in last}
    assert all(r["ds"] == ends[r["fold"], r["series_id"]] + dt.timedelta(days=r["step"]) for r in out)
    truth = [200 + i + 20 * np.sin(2 * np.pi * i / 7) for i in range(140, 149)]
    got = [r["yhat"] for r in sorted(out, key=lambda r: r["step"]) if r["fold"] == 0 and r["series_id"] == "s"]
    assert np.mean(np.abs(np.array(got) - truth)) < 25


def test_no_fit_without_history_or_variation(spark):
    short = as_train(daily(spark, 25, ("s",), ()))
    assert linear.linear_forecast(short, [0], 5) is None
    assert trees.tree_forecast(short, [0], 5, settings=trees.TreeSettings("boost", 2, 2)) == (None, None)
    flat = as_train(daily(spark, 90, ("s",), ()).withColumn("y", F.lit(5.0)))
    assert linear.linear_forecast(flat, [0], 5) is None


def test_known_helpers_move_a_forecast(spark):
    df = daily(spark, 140, ("s",), ()).withColumn("y", F.col("cost") * 10 + F.dayofmonth("ds"))
    last = df.agg(F.max("ds")).first()[0]
    ahead = spark.createDataFrame([("s", last + dt.timedelta(days=k), 60.0 if k == 3 else 50.0) for k in range(1, 6)], "series_id string, ds date, cost double")
    got = [r["yhat"] for r in linear.linear_forecast(as_train(df), [0], 5, "D", "ridge", future=ahead).orderBy("step").collect()]
    assert got[2] - got[1] > 60


@pytest.mark.parametrize("kind", ["boost", "forest"])
def test_ensembles_read_back_predict_as_fitted(spark, kind):
    settings = trees.TreeSettings(kind, 6, 4, rate=0.3, min_leaf=2)
    rows = _rows(spark)
    ensembles, model = trees.fit_folds(rows, settings)
    own = rows.where("fold = 0")
    table = model.transform(own).select(*ensembles[0].names, "prediction").toPandas()
    assert sorted(ensembles) == [0, 1] and len(ensembles[0].roots) == 6
    assert np.allclose(ensembles[0].predict(table[ensembles[0].names].to_numpy(float)), table["prediction"])


def test_tree_forecasts_are_repeatable(spark):
    settings = trees.TreeSettings("forest", 5, 4, min_leaf=2, band=0.13)
    train = as_train(daily(spark, 110))
    runs = [sorted(tuple(r) for r in trees.tree_forecast(train, [0], 6, "D", "random_forest", settings)[0].collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 12
