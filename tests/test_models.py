from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from revcast.operators import baselines, blend, evaluate, features, linear, postprocess, regressive, smoothing, trees
from revcast.plans.forecast import ForecastConfig, run_forecast


def series(spark, n=120, gap=(), name="s", fn=None):
    fn = fn or (lambda i: 100.0 + i + 10 * np.sin(2 * np.pi * i / 7))
    start = dt.date(2025, 1, 1)
    data = [(name, start + dt.timedelta(days=i), float(fn(i))) for i in range(n) if i not in gap]
    return spark.createDataFrame(data, "series_id string, ds date, y double")


def as_train(df):
    return df.withColumn("fold", F.lit(0))


def values(df):
    return [r.yhat for r in df.orderBy("series_id", "step").collect()]


def test_folds_match_the_definition(spark):
    n, h = 130, 14
    df = series(spark, n)
    got = evaluate.make_folds(df, h, "D", "balanced").orderBy("fold").collect()
    least = min(60, max(10, n - 1))
    splits = list(range(least - 1, n - h))
    idx = np.linspace(0, len(splits) - 1, num=5, dtype=int)
    days = sorted(r.ds for r in df.collect())
    assert [(r.train_end, r.test_start, r.test_end) for r in got] == [(days[splits[i]], days[splits[i] + 1], days[splits[i] + h]) for i in idx]
    assert evaluate.make_folds(series(spark, 20), 30, "D", "fast").count() == 0


def test_baselines_on_a_short_series(spark):
    df = as_train(series(spark, 5, fn=lambda i: [1, 2, 3, 4, 9][i]))
    out = baselines.baseline_forecasts(df, 8, "D", ["naive", "trend_drift", "historical_average"])
    by = {m: values(out.filter(F.col("model") == m)) for m in ("naive", "trend_drift", "historical_average")}
    assert by["naive"] == [9.0] * 8
    assert np.allclose(by["historical_average"], 3.8)
    slope = np.polyfit(np.arange(5), [1, 2, 3, 4, 9], 1)[0]
    assert np.allclose(by["trend_drift"], [9 + slope * k for k in range(1, 9)])
    # shorter than a season: not offered
    assert baselines.baseline_forecasts(df, 3, "D", ["seasonal_naive"]).count() == 0


def test_row_lags_ignore_gaps(spark):
    df = features.add_lags(series(spark, 10, gap=(5,)), [1])
    r = {x.ds.day: x for x in df.collect()}
    assert r[7].lag_1 == r[5].y


def test_features_equal_pandas(spark):
    df = series(spark, 60).withColumn("leads", F.when(F.dayofmonth("ds") % 5 != 0, F.col("y") * 2))
    out = features.add_ewm(features.add_series_shape(features.add_rolling(df, [7])), ["leads"]).toPandas().sort_values("ds")
    y, leads = out["y"].reset_index(drop=True), out["leads"].reset_index(drop=True)
    pairs = {
        "rolling_std_7": y.shift(1).rolling(7).std(),
        "expanding_std": y.shift(1).expanding(min_periods=2).std(),
        "growth_rate_seasonal": y.pct_change(7),
        "leads_ewm_7": leads.shift(1).ewm(span=7, adjust=False).mean(),
    }
    for name, want in pairs.items():
        assert np.allclose(out[name].astype(float).to_numpy(), want.to_numpy(dtype=float), equal_nan=True), name


def _holt_winters(y, m, a, b, g, phi=smoothing.DAMPING):
    base = np.mean(y[:m])
    season, level, trend, sse = [v - base for v in y[:m]], base, 0.0, 0.0
    for v in y[m:]:
        s = season[0]
        ahead = level + phi * trend
        e = v - ahead - s
        new = a * (v - s) + (1 - a) * ahead
        trend = b * (new - level) + (1 - b) * phi * trend
        level = new
        season = season[1:] + [g * (v - level) + (1 - g) * s]
        sse += e * e
    return level, trend, season, sse


def test_exponential_smoothing_equals_a_plain_loop(spark):
    df = series(spark, 50)
    y = [r.y for r in df.orderBy("ds").collect()]
    fits = [_holt_winters(y, 7, a, b, g) for a in (0.1, 0.3, 0.6) for b in (0.02, 0.1) for g in (0.05, 0.2)]
    level, trend, season, _ = min(fits, key=lambda f: f[3])
    want = [level + sum(smoothing.DAMPING**i for i in range(1, k + 1)) * trend + season[(k - 1) % 7] for k in range(1, 11)]
    out = smoothing.exponential_smoothing(as_train(df), 10)
    assert np.allclose(values(out), want)
    assert out.filter("yhat_lower > yhat OR yhat_upper < yhat").count() == 0


def test_theta_follows_a_line_and_survives_a_constant(spark):
    flat = values(smoothing.theta(as_train(series(spark, 40, fn=lambda i: 5.0)), 4))
    assert np.allclose(flat, 5.0)
    up = values(smoothing.theta(as_train(series(spark, 60, fn=lambda i: 10.0 + 2 * i)), 5))
    assert all(b > a for a, b in zip(up, up[1:])) and up[0] > 125


@pytest.mark.parametrize("fn", [regressive.autoregression, regressive.trend_fourier])
def test_per_series_regressions(spark, fn):
    two = series(spark, 100).unionByName(series(spark, 100, name="t", fn=lambda i: 50.0))
    out = fn(as_train(two), 7)
    got = {k: values(out.filter(F.col("series_id") == k)) for k in ("s", "t")}
    assert len(got["s"]) == len(got["t"]) == 7
    assert np.allclose(got["t"], 50.0, atol=2.0)
    truth = [100 + i + 10 * np.sin(2 * np.pi * i / 7) for i in range(100, 107)]
    assert np.mean(np.abs(np.array(got["s"]) - truth)) < 6
    assert out.filter("yhat_lower > yhat OR yhat_upper < yhat OR yhat IS NULL").count() == 0


def test_trees_are_repeatable_and_bounded(spark):
    df = as_train(series(spark, 110))
    a, model = trees.tree_forecast(df, [0], 4, "D", "random_forest", trees.TreeSettings("forest", 5, 4, min_leaf=2, band=0.13))
    b, _ = trees.tree_forecast(df, [0], 4, "D", "random_forest", trees.TreeSettings("forest", 5, 4, min_leaf=2, band=0.13))
    assert values(a) == values(b) and len(values(a)) == 4
    assert a.filter("yhat_lower > yhat OR yhat_upper < yhat").count() == 0
    shares = [r.share_pct for r in trees.feature_importance(spark, model).collect()]
    assert abs(sum(shares) - 100) < 1e-6


def test_ranking_ties_and_disjoint_blend(spark):
    m = spark.createDataFrame([("b", 1.0), ("a", 1.0)], "model string, mae double").select(
        "model", "mae", *[F.lit(1.0).alias(c) for c in ("rmse", "smape", "wape", "bias", "recent_accuracy", "stability")], F.lit(None).cast("double").alias("interval_score")
    )
    ranked = blend.rank_models(blend.score_models(m))
    assert [r.model for r in ranked.orderBy("rank").collect()] == ["a", "b"]
    d = dt.date(2026, 1, 1)
    f = spark.createDataFrame(
        [("a", "s", 1, d, 10.0, 9.0, 11.0), ("b", "s", 1, d + dt.timedelta(days=1), 20.0, None, None)],
        "model string, series_id string, step int, ds date, yhat double, yhat_lower double, yhat_upper double",
    )
    got = [(r.yhat, r.yhat_lower) for r in blend.blend(ranked, f).orderBy("ds").collect()]
    assert got == [(10.0, 9.0), (20.0, None)]


def test_blend_keeps_series_apart_and_fills_missing_bounds(spark):
    ranked = spark.createDataFrame([("a", 3.0, 1), ("b", 1.0, 2)], "model string, final_rank_score double, rank int")
    d = dt.date(2026, 1, 1)
    data = [("a", "s", 1, d, 10.0, 8.0, 12.0), ("b", "s", 1, d, 20.0, None, 26.0), ("a", "t", 1, d, 1.0, 1.0, 1.0), ("b", "t", 1, d, 1.0, 1.0, 1.0)]
    f = spark.createDataFrame(data, "model string, series_id string, step int, ds date, yhat double, yhat_lower double, yhat_upper double")
    out = {r.series_id: r for r in blend.blend(ranked, f).collect()}
    assert out["s"].yhat == 12.5 and out["s"].yhat_lower == (8 * 3 + 12.5) / 4 and out["s"].yhat_upper == (12 * 3 + 26) / 4
    assert out["t"].yhat == 1.0


def test_guardrail_lifts_a_flat_forecast(spark):
    hist = series(spark, 180, fn=lambda i: 100.0 + 2 * i)
    d = dt.date(2025, 7, 1)
    flat = spark.createDataFrame([("m", "s", k, d + dt.timedelta(days=k), 300.0, 280.0, 320.0) for k in range(1, 6)],
                                 "model string, series_id string, step int, ds date, yhat double, yhat_lower double, yhat_upper double")
    profile = postprocess.trend_profile(hist)
    p = profile.first()
    got = postprocess.trend_guardrail(flat, profile).orderBy("step").collect()
    assert [round(r.yhat, 6) for r in got] == [round(max(300.0, p.recent_mean + p.slope * k * 0.75), 6) for k in range(1, 6)]
    assert all(r.guarded == 1 and r.yhat_lower <= r.yhat <= r.yhat_upper for r in got)


def test_forecast_run_end_to_end(spark):
    two = series(spark, 150).unionByName(series(spark, 150, name="t", fn=lambda i: 200.0 + 3 * i))
    seen = {}

    def mine(train, folds, horizon, frequency):
        seen["folds"] = folds
        return baselines.baseline_forecasts(train, horizon, frequency, ["naive"]).withColumn("model", F.lit("mine"))

    run = run_forecast(two, ForecastConfig(horizon=14, depth="fast", models=("naive", "trend_drift", "theta", "no_such_model"), custom={"mine": mine}))
    bands = postprocess.scenario_bands(run.display)
    assert bands.count() == 28
    assert bands.filter("conservative > expected OR expected > aggressive OR conservative < 0").count() == 0
    assert [e[0] for e in run.errors] == ["no_such_model"] and seen["folds"] == [0, 1, 2, 3]
    best = run.ranking.filter("rank = 1").first()
    naive = run.ranking.filter("model = 'naive'").first()
    assert best.wape <= naive.wape


def test_sanity_gate_rejects_only_the_bad_model(spark):
    hist = series(spark, 40, fn=lambda i: 1e6)
    d = dt.date(2026, 1, 1)
    f = spark.createDataFrame([("ok", "s", d, 1e6), ("neg", "s", d, -1.0), ("big", "s", d, 2e7)], "model string, series_id string, ds date, yhat double")
    got = {r.model: r.passed for r in blend.sanity_gate(f, hist).collect()}
    assert got == {"ok": 1, "neg": 0, "big": 0}


def test_the_gate_judges_each_series_by_itself(spark):
    hist = series(spark, 40, fn=lambda i: 1e6).unionByName(series(spark, 40, fn=lambda i: 1e6).withColumn("series_id", F.lit("t")))
    d = dt.date(2026, 1, 1)
    f = spark.createDataFrame([("m", "s", d, 1e6), ("m", "t", d, -1.0), ("n", "s", d, 1e6), ("n", "t", d, 1e6)], "model string, series_id string, ds date, yhat double")
    gate = blend.sanity_gate(f, hist)
    assert {(r.model, r.series_id): r.passed for r in gate.collect()} == {("m", "s"): 1, ("m", "t"): 0, ("n", "s"): 1, ("n", "t"): 1}
    assert sorted((r.model, r.series_id) for r in blend.drop_rejected(f, gate).collect()) == [("m", "s"), ("n", "s"), ("n", "t")]


def test_a_series_that_lacks_a_top_model_is_still_blended(spark):
    d = dt.date(2026, 1, 1)
    rows = [(m, s, 1, d, v, None, None) for s, own in (("s", "abc"), ("t", "bc"), ("u", "c")) for m, v in zip("abc", (1.0, 2.0, 4.0)) if m in own]
    f = spark.createDataFrame(rows, "model string, series_id string, step int, ds date, yhat double, yhat_lower double, yhat_upper double")
    ranked = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0), ("c", 3, 1.0)], "model string, rank int, final_rank_score double")
    got = {r.series_id: round(r.yhat, 6) for r in blend.blend(ranked, f).collect()}
    assert got == {"s": round(7 / 3, 6), "t": 3.0, "u": 4.0}
    assert {r.series_id: r.model for r in blend.best_forecast(ranked, f).collect()} == {"s": "a", "t": "b", "u": "c"}


def test_seasonal_naive_is_left_out_only_where_a_series_is_short(spark):
    long = as_train(series(spark, 20))
    short = as_train(series(spark, 4)).withColumn("series_id", F.lit("short"))
    got = baselines.baseline_forecasts(long.unionByName(short), 3, "D", ["naive", "seasonal_naive"])
    assert sorted((r.series_id, r.model) for r in got.select("series_id", "model").distinct().collect()) == [("s", "naive"), ("s", "seasonal_naive"), ("short", "naive")]


def test_rounding_has_no_upper_end(spark):
    from catalog.base import rounded

    df = spark.createDataFrame([(5e15,), (-5e15,), (2.0e30,), (1.23456,), (-1.5,)], "v double")
    assert [r.v for r in rounded(df, 4).collect()] == [5e15, -5e15, 2.0e30, 1.2346, -1.5]


def test_skipped_series_are_reported(spark):
    daily = series(spark, 120).unionByName(series(spark, 5).withColumn("series_id", F.lit("short")))
    run = run_forecast(daily, ForecastConfig(horizon=7, depth="fast", models=("naive", "seasonal_naive")))
    assert [(r.model, r.series_id) for r in run.skipped.collect()] == [("seasonal_naive", "short")]
    assert {r.series_id for r in run.display.select("series_id").distinct().collect()} == {"s", "short"}


def long_series(spark, n=900, seed=3):
    rng = np.random.default_rng(seed)
    noise = rng.normal(0, 4, n)
    return series(spark, n, gap=(40, 41, 300), fn=lambda i: 300 + 0.1 * i + 12 * np.sin(2 * np.pi * i / 7) + 40 * np.cos(2 * np.pi * i / 365) + noise[i])


def brute_parts(y, seasons, passes):
    n = len(y)
    parts = {m: np.zeros(n) for m in seasons}

    def moving(v, m):
        return np.array([v[max(0, i - m // 2) : i + m // 2 + 1].mean() for i in range(n)])

    for _ in range(passes):
        for m in seasons:
            left = y - sum(parts[o] for o in seasons if o != m)
            rest = left - moving(left, m)
            line = np.zeros(n)
            for i in range(n):
                places = [j for j in range(i - 3 * m, i + 3 * m + 1, m) if 0 <= j < n]
                o = np.array([(j - i) // m for j in places], float)
                w = (1 - (np.abs(o) / 4) ** 3) ** 3
                v = rest[places]
                if len(places) > 1:
                    x = np.column_stack([np.ones_like(o), o])
                    line[i] = np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (w * v))[0]
                else:
                    line[i] = v[0]
            parts[m] = line - moving(line, m) if n >= 2 * m else np.zeros(n)
    return parts


@pytest.mark.parametrize("n", [900, 200, 9])
def test_decomposition_equals_a_plain_loop(spark, n):
    df = long_series(spark, n)
    y = np.array([r.y for r in df.orderBy("ds").collect()])
    parts = brute_parts(y, (7, 365), 2)
    got = baselines.seasonal_parts(as_train(df))[0].orderBy("ds").collect()
    for m in (7, 365):
        assert np.allclose([r[f"s_{m}"] for r in got], parts[m], atol=1e-8)
    z = y - parts[7] - parts[365]
    tail = min(max(6, len(y) // 2), len(y))
    slope = np.polyfit(np.arange(len(y) - tail, len(y)), z[-tail:], 1)[0]
    cycles = {m: parts[m][-min(m, len(y)) :] for m in (7, 365)}
    want = [max(0.0, z[-7:].mean() + slope * k + sum(c[(k - 1) % m] if (k - 1) % m < len(c) else 0.0 for m, c in cycles.items())) for k in range(1, 31)]
    assert np.allclose(values(baselines.decomposition_forecast(as_train(df), 30)), want)


@pytest.mark.parametrize("n", [400, 30, 4, 1])
def test_autoregression_equals_the_yule_walker_equations(spark, n):
    rng = np.random.default_rng(n)
    noise = rng.normal(0, 3, n)
    state = [0.0, 0.0]
    path = []
    for e in noise:
        state = [0.6 * state[0] - 0.3 * state[1] + e, state[0]]
        path.append(50 + state[0])
    df = series(spark, n, fn=lambda i: path[i])
    slope, base = np.polyfit(np.arange(n), path, 1) if n > 1 else (0.0, path[0])
    z = np.array(path) - base - slope * np.arange(n)
    most = regressive.lag_count("D")
    r = [float((z[k:] * z[: len(z) - k]).sum()) / n if k < n else 0.0 for k in range(most + 1)]
    best = (n * np.log(max(r[0], 1e-9)) + 2, np.zeros(0), r[0])
    for p in range(1, most + 1):
        if p >= n / 4:
            break
        a = np.linalg.solve(np.array([[r[abs(i - j)] for j in range(p)] for i in range(p)]), r[1 : p + 1])
        e = r[0] - a @ r[1 : p + 1]
        score = n * np.log(max(e, 1e-9)) + 2 * (p + 1)
        if score < best[0]:
            best = (score, a, e)
    fitted = regressive.levinson(regressive.autocovariances(as_train(df), most), most).first()
    assert np.allclose(fitted.a, best[1], atol=1e-9) and abs(fitted.variance - best[2]) < 1e-8 * max(1.0, r[0])
    past, weights, spread, rows = list(z[::-1]) + [0.0] * most, [1.0] + [0.0] * most, 0.0, []
    for _ in range(12):
        spread += weights[0] ** 2
        value, weight = (sum(a * v for a, v in zip(best[1], x)) for x in (past, weights))
        past, weights = [value, *past], [weight, *weights]
        rows.append((value + base + slope * (n + len(rows)), 1.2816 * np.sqrt(max(best[2], 0) * spread)))
    got = regressive.autoregression(as_train(df), 12).orderBy("step").collect()
    assert np.allclose([x.yhat for x in got], [max(v, 0) for v, _ in rows], atol=1e-7)
    assert np.allclose([x.yhat_upper for x in got], [max(v + b, 0) for v, b in rows], atol=1e-6)


@pytest.mark.parametrize("n", [500, 60])
def test_trend_fourier_equals_penalised_least_squares(spark, n):
    df = long_series(spark, n).withColumn("event_flag", (F.dayofmonth("ds") == 5).cast("int")).withColumn("y", F.col("y") + 30 * F.col("event_flag"))
    train = as_train(df).unionByName(as_train(df).filter(f"datediff(ds, date'2025-01-01') < {n - 25}").withColumn("fold", F.lit(1)))
    rows, flags = regressive.fourier_rows(train)
    weights = regressive.fourier_weights(rows)
    assert flags == ["event_flag"] and weights.count() == 2
    assert max(x.gap for x in regressive.normal_equations(rows, weights).collect()) < 1e-9
    for fold in (0, 1):
        frame = train.filter(f"fold = {fold}").toPandas().sort_values("ds")
        day = (pd.to_datetime(frame["ds"]) - pd.Timestamp("1970-01-01")).dt.days.to_numpy(float)
        t0, span = day[0], max(day[-1] - day[0], 1.0)

        def design(x, mark):
            u = (x - t0) / span
            parts = [np.ones_like(u), u] + [np.maximum(u - k, 0) for k in np.linspace(0.1, 0.8, 5)]
            for period, order in ((7.0, 3), (365.25, 5)):
                for k in range(1, order + 1):
                    on = 1.0 if period < 10 or span >= 365 else 0.0
                    parts += [on * np.sin(2 * np.pi * k * x / period), on * np.cos(2 * np.pi * k * x / period)]
            return np.column_stack([*parts, mark])

        x, y = design(day, frame["event_flag"].to_numpy(float)), frame["y"].to_numpy()
        spread = x.std(axis=0)
        penalty = np.where(spread > 1e-6, 1e-3 * len(x) * spread**2, 1.0)
        penalty[0] = 0.0
        beta = np.linalg.solve(x.T @ x + np.diag(penalty), x.T @ y)
        last = frame["ds"].iloc[-1]
        ahead = [last + dt.timedelta(days=k) for k in range(1, 15)]
        mark = np.array([1.0 if d.day == 5 and (fold == 1 and d <= max(df.toPandas()["ds"])) else 0.0 for d in ahead])
        want = np.maximum(design(day[-1] + np.arange(1, 15), mark) @ beta, 0)
        got = regressive.trend_fourier(train, 14).filter(f"fold = {fold}").orderBy("step").collect()
        assert np.allclose([g.yhat for g in got], want, rtol=1e-7)
        assert np.allclose([g.yhat_upper - g.yhat for g in got], 1.2816 * np.std(y - x @ beta), rtol=1e-6)


def test_known_events_reach_the_forecast(spark):
    df = long_series(spark, 120).withColumn("event_flag", (F.dayofmonth("ds") % 5 == 0).cast("int")).withColumn("y", F.col("y") + 100 * F.col("event_flag"))
    last = df.agg(F.max("ds")).first()[0]
    ahead = spark.createDataFrame([("s", last + dt.timedelta(days=2), 1)], "series_id string, ds date, event_flag int")
    with_, without = (values(regressive.trend_fourier(as_train(df), 4, future=f)) for f in (ahead, None))
    assert with_[1] - without[1] > 60 and np.allclose(with_[0], without[0])
