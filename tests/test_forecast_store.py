"""The tournament's store: parts, commits, resuming, failures."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from revcast.operators import baselines, trees
from revcast.plans import forecast as plan
from revcast.plans.forecast import ALL_MODELS, ForecastConfig, run_forecast
from revcast.plans.store import PredictionStore, fingerprint

TINY = {m: trees.TreeSettings(s.kind, 2, 2, min_leaf=2, band=s.band) for m, s in trees.FULL.items()}


def daily(spark, n=130):
    start = dt.date(2025, 1, 1)
    rows = [(k, start + dt.timedelta(days=i), float(100 + 5 * j + i + 9 * np.sin(i * 0.9)), float(i % 6), float(20 + i % 9)) for j, k in enumerate("st") for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, ds date, y double, leads double, cost double")


def test_all_families_resume_and_agree(spark, tmp_path, monkeypatch):
    cfg = ForecastConfig(horizon=7, depth="fast", models=tuple(ALL_MODELS), tree_settings=TINY, store=str(tmp_path / "run"))
    run = run_forecast(daily(spark), cfg)
    assert run.errors == [] and set(run.fitted) == set(trees.FULL)
    cells = run.predictions.groupBy("model", "fold", "series_id").agg(F.count("*").alias("n"), F.min("step").alias("a"), F.max("step").alias("b")).collect()
    assert len(cells) == len(ALL_MODELS) * 4 * 2 and {(c.n, c.a, c.b) for c in cells} == {(7, 1, 7)}
    assert {r.model for r in run.ranking.collect()} == set(ALL_MODELS)
    first = sorted(map(tuple, run.predictions.collect()))

    def never(*_, **__):
        raise AssertionError("nothing is left to do")

    for name in ("baseline_forecasts", "decomposition_forecast"):
        monkeypatch.setattr(plan.baselines, name, never)
    monkeypatch.setattr(plan.trees, "tree_forecast", never)
    monkeypatch.setattr(plan.linear, "linear_forecast", never)
    again = run_forecast(daily(spark), cfg)
    assert again.errors == [] and sorted(map(tuple, again.predictions.collect())) == first


def test_a_failing_fold_costs_itself_only(spark, tmp_path, monkeypatch):
    cfg = ForecastConfig(horizon=7, depth="fast", models=("naive", "gradient_boosting"), tree_settings=TINY, store=str(tmp_path / "run"))
    real, calls = trees.tree_forecast, []

    def shaky(train, folds, *rest):
        calls.append(folds[0])
        if folds == [2] and calls.count(2) == 1:
            raise RuntimeError("executor lost")
        return real(train, folds, *rest)

    monkeypatch.setattr(plan.trees, "tree_forecast", shaky)
    broken = run_forecast(daily(spark), cfg)
    assert broken.errors == [("gradient_boosting", "fold 2: executor lost")]
    assert {r.fold for r in broken.predictions.filter("model = 'gradient_boosting'").select("fold").distinct().collect()} == {0, 1, 3}
    calls.clear()
    calls.append(2)
    mended = run_forecast(daily(spark), cfg)
    assert mended.errors == [] and calls == [2, 2]
    assert mended.predictions.filter("model = 'gradient_boosting'").select("fold").distinct().count() == 4


def test_other_data_or_settings_are_worked_out_anew(spark, tmp_path):
    cfg = ForecastConfig(horizon=7, depth="fast", models=("naive",), store=str(tmp_path / "run"))
    a = run_forecast(daily(spark), cfg).predictions
    b = run_forecast(daily(spark).withColumn("y", F.col("y") + 1), cfg).predictions
    c = run_forecast(daily(spark), ForecastConfig(horizon=5, depth="fast", models=("naive",), store=str(tmp_path / "run"))).predictions
    keys = ["fold", "series_id", "step"]
    assert a.join(b.withColumnRenamed("yhat", "other"), keys).filter("abs(other - yhat - 1) > 1e-9").count() == 0
    assert (a.count(), b.count(), c.count()) == (56, 56, 40)


def test_uncommitted_parts_are_not_read(spark, tmp_path):
    store = PredictionStore(spark, str(tmp_path / "s"))
    assert store.committed("k") == {} and store.load({}, plan.PREDICTION).count() == 0
    p = baselines.baseline_forecasts(daily(spark).withColumn("fold", F.lit(0)), 3, "D", ["naive", "full_average"])
    p.write.partitionBy("model", "fold").parquet(f"{store.root}/parts/lost")
    cells = store.put("k", ["naive"], [0, 1], p)
    assert store.committed("k") == cells and set(cells) == {("naive", 0), ("naive", 1)} and store.committed("other") == {}
    assert store.load(cells, plan.PREDICTION).count() == 6


def test_fingerprints(spark):
    df = daily(spark, 5)
    assert fingerprint(df) == fingerprint(df.repartition(3).select(*reversed(df.columns)))
    assert len({fingerprint(x) for x in (df, df.limit(9), df.withColumn("y", F.lit(None).cast("double")), df.filter("false"))}) == 4


@pytest.mark.parametrize(("mode", "columns"), [("scenario", 5), ("intervals", 5), ("single", 3)])
def test_output_mode(spark, mode, columns):
    run = run_forecast(daily(spark), ForecastConfig(horizon=7, depth="fast", models=("naive",), mode=mode))
    assert run.output.count() == 14 and len(run.output.columns) == columns
    assert ("conservative" in run.output.columns) == (mode == "scenario")
