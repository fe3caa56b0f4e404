"""Forecast models, backtests, ranking and blending."""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import functions as F

from catalog.base import Registry, view
from catalog.frames import daily_model, series_daily
from revcast.operators import baselines, blend, evaluate, linear, regressive, smoothing, stepping, trees
from revcast.operators.features import recipe
from revcast.plans.forecast import ALL_MODELS, ForecastConfig, backtest, run_forecast
from revcast.session import checkpoint_dir, cut

REG = Registry()
H = 30

view("fdays", f"""SELECT ds AS train_end, row_number() OVER (ORDER BY ds) - 1 AS i, count(*) OVER () AS n,
  lead(ds, 1) OVER (ORDER BY ds) AS test_start, lead(ds, {H}) OVER (ORDER BY ds) AS test_end FROM (SELECT DISTINCT ds FROM d)""", "d")


def folds_sql(m: int) -> str:
    return f"""SELECT CAST(j + 1 AS INT) AS fold, train_end, test_start, test_end FROM (
      SELECT *, least(60, greatest(10, n - 1)) AS mt, n - {H} - least(60, greatest(10, n - 1)) + 1 AS s FROM fdays),
      (SELECT unnest(range({m})) AS j)
      WHERE CASE WHEN s <= {m} THEN i = mt - 1 + j AND j < s ELSE i = mt - 1 + floor(j * (CAST(s - 1 AS DOUBLE) / {m - 1})) END"""


view("folds", folds_sql(3), "fdays")
view("foldsx", "SELECT fold, train_end FROM folds UNION ALL SELECT 0, max(ds) FROM d", "folds d")
view("train", "SELECT f.fold, d.* FROM d JOIN foldsx f ON d.ds <= f.train_end", "d foldsx")
view("test", "SELECT f.fold, d.* FROM d JOIN folds f ON d.ds BETWEEN f.test_start AND f.test_end", "d folds")
view("bparams", """SELECT fold, series_id, max(ds) AS last_ds, count(*) AS n, max_by(y, ds) AS last_y, avg(y) FILTER (n - idx + 1 <= 30) AS avg_30, avg(y) AS avg_all,
  regr_slope(y, idx) FILTER (n - idx + 1 <= least(greatest(6, n // 2), n)) AS slope, list(y ORDER BY ds) FILTER (n - idx + 1 <= 7) AS tail
  FROM (SELECT *, row_number() OVER (PARTITION BY fold, series_id ORDER BY ds) AS idx, count(*) OVER (PARTITION BY fold, series_id) AS n FROM train)
  GROUP BY 1, 2""", "train")
view("bpred", f"""SELECT m.model, fold, series_id, CAST(s.step AS INT) AS step, CAST(last_ds + s.step AS DATE) AS ds,
    CASE m.model WHEN 'naive' THEN last_y WHEN 'historical_average' THEN avg_30 WHEN 'seasonal_naive' THEN tail[(s.step - 1) % 7 + 1]
      WHEN 'trend_drift' THEN greatest(0, last_y + slope * s.step) ELSE avg_all END AS yhat
  FROM bparams, (SELECT CAST(unnest(range(1, {H + 1})) AS INT) AS step) s,
    (VALUES ('naive'), ('historical_average'), ('seasonal_naive'), ('trend_drift'), ('full_average')) m(model)""", "bparams")
view("bpredi", """SELECT *, CASE WHEN model IN ('naive', 'seasonal_naive') THEN yhat * (1 - 0.08::DOUBLE) END AS yhat_lower,
  CASE WHEN model IN ('naive', 'seasonal_naive') THEN yhat * (1 + 0.08::DOUBLE) END AS yhat_upper FROM bpred""", "bpred")
view("fmetrics", """SELECT *, abs(interval_coverage - 0.8) + 0.1 * interval_width / (lv + 1e-9) AS interval_score FROM (
  SELECT model, p.fold, avg(abs(t.y - yhat)) AS mae, sqrt(avg((t.y - yhat) ** 2)) AS rmse,
    avg(2 * abs(t.y - yhat) / (abs(t.y) + abs(yhat) + 1e-9)) AS smape, avg(abs(t.y - yhat) / (abs(t.y) + 1e-9)) AS mape,
    sum(abs(t.y - yhat)) / (sum(abs(t.y)) + 1e-9) AS wape, avg(yhat - t.y) AS bias, avg(t.y) AS mean_actual, avg(yhat) AS mean_forecast,
    count(*) AS n_obs, avg(CAST(t.y BETWEEN yhat_lower AND yhat_upper AS INT)) FILTER (yhat_lower IS NOT NULL) AS interval_coverage,
    avg(greatest(yhat_upper - yhat_lower, 0)) FILTER (yhat_lower IS NOT NULL) AS interval_width, avg(abs(t.y)) FILTER (yhat_lower IS NOT NULL) AS lv
  FROM bpredi p JOIN test t ON p.fold = t.fold AND p.series_id = t.series_id AND p.ds = t.ds GROUP BY 1, 2)""", "bpredi test")
view("metrics", """SELECT model, avg(mae) AS mae, avg(rmse) AS rmse, avg(smape) AS smape, avg(mape) AS mape, avg(wape) AS wape, avg(bias) AS bias,
  avg(interval_coverage) AS interval_coverage, avg(interval_width) AS interval_width, avg(interval_score) AS interval_score,
  max_by(wape, fold) AS recent_accuracy, stddev_pop(wape) AS stability, avg((mae + rmse + smape + wape) / 4) AS overall_score, count(*) AS n_folds
  FROM fmetrics GROUP BY 1""", "fmetrics")


def _score(name: str, col: str, w: float) -> str:
    return (f"coalesce(CASE WHEN coalesce(min({col}) OVER () = max({col}) OVER (), true) THEN 1 ELSE 1 - ({col} - min({col}) OVER ()) / "
            f"(max({col}) OVER () - min({col}) OVER () + 1e-9) END, 0) * {w}::DOUBLE AS score_{name}")


_PARTS = [("bias_abs", "abs(bias)")] + [(n, n) for n in blend.SCORE_WEIGHTS if n != "bias_abs"]
view("scored", "SELECT *, " + " + ".join(f"score_{n}" for n in blend.SCORE_WEIGHTS) + " AS final_rank_score FROM (SELECT *, abs(bias) AS bias_abs, "
     + ", ".join(_score(n, c, blend.SCORE_WEIGHTS[n]) for n, c in _PARTS) + " FROM metrics)", "metrics")
view("ranked", "SELECT *, row_number() OVER (ORDER BY final_rank_score DESC, model) AS rank FROM scored", "scored")
view("finalf", "SELECT * EXCLUDE (fold) FROM bpredi WHERE fold = 0", "bpredi")
view("blended", """SELECT 'ensemble_blend' AS model, series_id, min(step) AS step, ds, sum(w * yhat) / sum(w) AS yhat,
    (sum(w * coalesce(yhat_lower, m)) FILTER (hb)) / (sum(w) FILTER (hb)) AS yhat_lower, (sum(w * coalesce(yhat_upper, m)) FILTER (hb)) / (sum(w) FILTER (hb)) AS yhat_upper
  FROM (SELECT f.*, CASE WHEN r.final_rank_score <= 0 THEN 1 ELSE r.final_rank_score END AS w, f.model IN ('naive', 'seasonal_naive') AS hb,
      NULL::DOUBLE AS m FROM finalf f JOIN ranked r ON f.model = r.model WHERE r.rank <= 3) GROUP BY series_id, ds""", "finalf ranked")


def folds(spark, d):
    daily = cut(series_daily(spark, d))
    return daily, cut(evaluate.with_final_fold(evaluate.make_folds(daily, H, "D", "fast"), daily))


def train_rows(spark, d):
    daily, f = folds(spark, d)
    return evaluate.training_rows(daily, f)


def tournament(spark, d):
    """Baselines of all folds with their metrics; two of the models carry an interval."""
    daily, f = folds(spark, d)
    p = evaluate.default_intervals(baselines.baseline_forecasts(evaluate.training_rows(daily, f), H))
    has = F.col("model").isin("naive", "seasonal_naive")
    p = cut(p.withColumn("yhat_lower", F.when(has, F.col("yhat_lower"))).withColumn("yhat_upper", F.when(has, F.col("yhat_upper"))))
    per_fold, summary = evaluate.backtest_metrics(daily, f, p)
    return SimpleNamespace(daily=daily, folds=f, predictions=p, final=p.filter("fold = 0").drop("fold"), per_fold=per_fold, summary=summary)


def ranked(t):
    return cut(blend.rank_models(blend.score_models(t.summary)))


PRED = "yhat"


@REG.add("mo01_future_calendar", "train", f"""SELECT fold, series_id, step, CAST(last + step AS DATE) AS ds
  FROM (SELECT fold, series_id, max(ds) AS last FROM train GROUP BY 1, 2), (SELECT CAST(unnest(range(1, {H + 1})) AS INT) AS step)""")
def mo01(spark, d):
    return baselines.future_calendar(train_rows(spark, d), H)


@REG.add("mo01_future_weeks_months", "d", """WITH l AS (SELECT series_id, max(ds) AS a FROM d GROUP BY 1), s AS (SELECT CAST(unnest(range(1, 13)) AS INT) AS step)
  SELECT 'W' AS frequency, series_id, step, CAST(a + CAST((7 - dayofweek(a)) % 7 AS INT) + 7 * step AS DATE) AS ds FROM l, s UNION ALL
  SELECT 'M', series_id, step, last_day(CAST(date_trunc('month', a) + to_months(step) AS DATE)) FROM l, s UNION ALL
  SELECT 'MS', series_id, step, CAST(date_trunc('month', a) + to_months(CAST(step + CASE WHEN day(a) = 1 THEN 0 ELSE 1 END AS INT)) AS DATE) FROM l, s""")
def mo01_other(spark, d):
    daily = series_daily(spark, d)
    parts = [baselines.future_calendar(daily, 12, f, ["series_id"]).withColumn("frequency", F.lit(f)) for f in ("W", "M", "MS")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _baseline(model):
    def run(spark, d):
        return baselines.baseline_forecasts(train_rows(spark, d), H, models=[model]).drop("yhat_lower", "yhat_upper")

    return run


for _i, _m in enumerate(["naive", "historical_average", "seasonal_naive", "trend_drift", "full_average"], start=2):
    REG.add(f"mo0{_i}_{_m}", "bpred", f"SELECT * FROM bpred WHERE model = '{_m}'", rnd=PRED)(_baseline(_m))


@REG.add("mo07_exponential_smoothing")
def mo07(spark, d):
    return smoothing.exponential_smoothing(train_rows(spark, d), H)


@REG.add("mo08_theta")
def mo08(spark, d):
    return smoothing.theta(train_rows(spark, d), H)


def _parts_sql() -> tuple[str, str]:
    """The seasonal parts as common table expressions ``p0`` ... over ``train``, and the name of the last one."""
    seasons = baselines.SEASONS["D"]
    key = "PARTITION BY fold, series_id"
    ctes = [f"p0 AS (SELECT fold, series_id, ds, y, row_number() OVER ({key} ORDER BY ds) - 1 AS idx, count(*) OVER ({key}) AS n, "
            + ", ".join(f"0::DOUBLE AS s_{m}" for m in seasons) + " FROM train)"]
    for k, m in enumerate(seasons * baselines.PASSES):
        frame = f"OVER ({key} ORDER BY idx ROWS BETWEEN {m // 2} PRECEDING AND {m // 2} FOLLOWING)"
        others = "".join(f" - s_{o}" for o in seasons if o != m)
        phase = f"OVER ({key}, idx % {m} ORDER BY idx)"
        c = baselines.CYCLES
        near = ", ".join(f"{'lag' if i < c else 'lead'}(rest, {abs(i - c)}) {phase} AS near_{i}" for i in range(2 * c + 1))
        ctes += [f"q{k} AS (SELECT *, y{others} - avg(y{others}) {frame} AS rest FROM p{k})", f"r{k} AS (SELECT *, {near} FROM q{k})",
                 f"l{k} AS (SELECT *, {baselines.phase_line()} AS line FROM r{k})",
                 f"p{k + 1} AS (SELECT fold, series_id, ds, y, idx, n, " + ", ".join(f"s_{o}" for o in seasons if o != m)
                 + f", CASE WHEN n >= {2 * m} THEN line - avg(line) {frame} ELSE 0 END AS s_{m} FROM l{k})"]
    return ", ".join(ctes), f"p{len(seasons) * baselines.PASSES}"


_PARTS_CTES, _PARTS_LAST = _parts_sql()


@REG.add("mo09_seasonal_parts", "train", f"WITH {_PARTS_CTES} SELECT fold, series_id, ds, s_7, s_365 FROM {_PARTS_LAST}", rnd="s_7 s_365", digits=3)
def mo09_parts(spark, d):
    return baselines.seasonal_parts(train_rows(spark, d))[0].select("fold", "series_id", "ds", "s_7", "s_365")


@REG.add("mo09_decomposition", "train", f"""WITH {_PARTS_CTES}, z AS (SELECT *, y - s_7 - s_365 AS z FROM {_PARTS_LAST}),
  p AS (SELECT fold, series_id, max(ds) AS last_ds, max(n) AS n, avg(z) FILTER (n - idx <= 7) AS level,
    regr_slope(z, idx) FILTER (n - idx <= least(greatest(6, n // 2), n)) AS slope FROM z GROUP BY 1, 2)
  SELECT 'decomposition' AS model, p.fold, p.series_id, step, CAST(last_ds + step AS DATE) AS ds,
    greatest(0, level + slope * step + a.s_7 + coalesce(b.s_365, 0)) AS yhat
  FROM p CROSS JOIN (SELECT CAST(unnest(range(1, {H + 1})) AS INT) AS step) s
  JOIN z a ON p.fold = a.fold AND p.series_id = a.series_id AND a.idx = p.n - 7 + (step - 1) % 7
  LEFT JOIN z b ON p.fold = b.fold AND p.series_id = b.series_id AND b.idx = p.n - least(365, p.n) + (step - 1) % 365""", rnd=PRED, digits=2)
def mo09(spark, d):
    return baselines.decomposition_forecast(train_rows(spark, d), H).drop("yhat_lower", "yhat_upper")


@REG.add("mo10_autoregression")
def mo10(spark, d):
    return regressive.autoregression(train_rows(spark, d), H)


@REG.add("mo11_trend_fourier")
def mo11(spark, d):
    return regressive.trend_fourier(train_rows(spark, d), H)


# the tournament of all families: five folds and the final fit, day and platform with leads and cost
view("folds5", folds_sql(5), "fdays")
view("folds5x", "SELECT fold, train_end FROM folds5 UNION ALL SELECT 0, max(ds) FROM d", "folds5 d")
view("last5", "SELECT f.fold, d.series_id, max(d.ds) AS last_ds FROM d JOIN folds5x f ON d.ds <= f.train_end GROUP BY 1, 2", "d folds5x")
view("entrants", "SELECT unnest([" + ", ".join(f"'{m}'" for m in ALL_MODELS) + "]) AS model")


def settings(spark, models=tuple(ALL_MODELS)) -> ForecastConfig:
    """All queries of the tournament share one store, so a model's fold is fitted once however many of them ask for it."""
    store = f"{checkpoint_dir(spark).rstrip('/')}/tournament"
    return ForecastConfig(horizon=H, depth="balanced", models=models, tree_settings=dict(trees.SMALL), store=store)


def _entrant(model):
    def run(spark, d):
        return backtest(daily_model(spark, d), settings(spark, (model,)))[2]

    return run


for _n, _m in (("mo12_ridge", "ridge"), ("mo12_elasticnet", "elasticnet"), ("mo13_gradient_boosting", "gradient_boosting"),
               ("mo14_gradient_boosting_deep", "gradient_boosting_deep"), ("mo15_random_forest", "random_forest")):
    REG.add(_n)(_entrant(_m))


def _fold_rows(spark, d, model):
    daily = daily_model(spark, d)
    f = evaluate.with_final_fold(evaluate.make_folds(daily, H, "D", "balanced"), daily)
    return cut(stepping.model_rows(evaluate.training_rows(daily, f), recipe(model)))


_INPUTS = ", ".join(f"'{c}'" for c in stepping.recipe_inputs(recipe("ridge"), ["leads", "cost"], []))


def _optimality(model):
    def run(spark, d):
        rows = _fold_rows(spark, d, model)
        return linear.conditions(rows, linear.linear_fits(rows, model), model)

    return run


for _m in linear.MODELS:
    REG.add(f"mo12_{_m}_optimality", "folds5x", f"SELECT fold, feature, 0.0::DOUBLE AS violation FROM folds5x, (SELECT unnest([{_INPUTS}]) AS feature)", rnd="violation")(_optimality(_m))


@REG.add("mo12_training_sums", "folds5x dm", f"""WITH t AS (SELECT f.fold, m.*, row_number() OVER w AS rn, lag(y, 1) OVER w AS lag_1, lag(y, 7) OVER w AS lag_7,
    avg(y) OVER (PARTITION BY fold, series_id ORDER BY ds ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS mean_28 FROM dm m JOIN folds5x f ON m.ds <= f.train_end
    WINDOW w AS (PARTITION BY fold, series_id ORDER BY ds))
  SELECT fold, count(*) AS n, sum(y) AS y, sum(lag_1 * y) / 1e6 AS lag_1_y, sum(lag_7 * mean_28) / 1e6 AS lag_7_mean_28, sum(lag_1 * lag_1) / 1e6 AS lag_1_square FROM t WHERE rn > 28 GROUP BY 1""",
  rnd="y lag_1_y lag_7_mean_28 lag_1_square", digits=1)
def mo12_sums(spark, d):
    """Some cells of the Gram matrices that the linear models are solved from."""
    rows = _fold_rows(spark, d, "ridge")
    names = linear.input_names(rows)
    at = {c: i + 1 for i, c in enumerate([*names, "y"])}
    cells = [("lag_1", "y"), ("lag_7", "rolling_mean_28"), ("lag_1", "lag_1")]
    table = [(f, int(g[0, 0]), float(g[0, at["y"]]), *[float(g[at[a], at[b]]) / 1e6 for a, b in cells]) for f, g in linear.gram(rows, names).items()]
    return spark.createDataFrame(table, "fold int, n long, y double, lag_1_y double, lag_7_mean_28 double, lag_1_square double")


@REG.add("mo11_normal_equations", "train", "SELECT fold, series_id, 0.0::DOUBLE AS gap FROM train GROUP BY 1, 2", rnd="gap")
def mo11_equations(spark, d):
    rows = cut(regressive.fourier_rows(train_rows(spark, d))[0])
    return regressive.normal_equations(rows, regressive.fourier_weights(rows))


@REG.add("mo10_autocovariances", "train", """WITH i AS (SELECT *, CAST(row_number() OVER (PARTITION BY fold, series_id ORDER BY ds) AS DOUBLE) AS i FROM train),
  p AS (SELECT fold, series_id, avg(y) AS my, avg(i) AS mi, regr_slope(y, i) AS b FROM i GROUP BY 1, 2),
  z AS (SELECT i.fold, i.series_id, i, y - my - b * (i - mi) AS z FROM i JOIN p ON i.fold = p.fold AND i.series_id = p.series_id),
  k AS (SELECT CAST(unnest(range(0, 15)) AS INT) AS lag)
  SELECT a.fold, a.series_id, lag, sum(a.z * b.z) / max(n.n) AS covariance FROM z a CROSS JOIN k JOIN z b ON a.fold = b.fold AND a.series_id = b.series_id AND b.i = a.i - lag
  JOIN (SELECT fold, series_id, count(*) AS n FROM z GROUP BY 1, 2) n ON a.fold = n.fold AND a.series_id = n.series_id GROUP BY 1, 2, 3""", rnd="covariance", digits=0)
def mo10_moments(spark, d):
    found = regressive.autocovariances(train_rows(spark, d), regressive.lag_count("D"))
    return found.select("fold", "series_id", F.posexplode("r").alias("lag", "covariance"))


@REG.add("mo10_order_equations", "train", "SELECT fold, series_id, 0.0::DOUBLE AS gap FROM train GROUP BY 1, 2", rnd="gap")
def mo10_equations(spark, d):
    """The Yule-Walker equations of the chosen order, by the plain sums: largest gap as a share of the variance."""
    lags = regressive.lag_count("D")
    fitted = regressive.levinson(regressive.autocovariances(train_rows(spark, d), lags), lags)
    rows = fitted.select("fold", "series_id", "r", "a", F.explode(F.when(F.size("a") > 0, F.sequence(F.lit(1), F.size("a"))).otherwise(F.array(F.lit(0)))).alias("k"))
    each = rows.select("fold", "series_id", "r", "k", F.posexplode_outer("a").alias("j", "w"))
    at = F.element_at("r", F.abs(F.col("k") - F.col("j") - 1) + 1)
    sums = each.groupBy("fold", "series_id", "k").agg(F.sum(F.coalesce(F.col("w") * at, F.lit(0.0))).alias("s"), F.first(F.element_at("r", F.col("k") + 1)).alias("want"), F.first(F.element_at("r", 1)).alias("v"))
    return sums.groupBy("fold", "series_id").agg(F.max(F.when(F.col("k") > 0, F.abs(F.col("s") - F.col("want")) / F.col("v")).otherwise(0.0)).alias("gap"))


@REG.add("mo18_default_intervals", "bpred", """SELECT model, series_id, step, ds, yhat, yhat * 0.92::DOUBLE AS yhat_lower, yhat * 1.08::DOUBLE AS yhat_upper FROM bpred WHERE fold = 0""",
         rnd="yhat yhat_lower yhat_upper")
def mo18(spark, d):
    p = baselines.baseline_forecasts(train_rows(spark, d), H).filter("fold = 0").drop("fold")
    return evaluate.default_intervals(p)


@REG.add("mo19_feature_importance")
def mo19(spark, d):
    rows = _fold_rows(spark, d, "random_forest").where("fold = 0")
    return trees.feature_importance(spark, trees.fit_folds(rows, trees.SMALL["random_forest"])[1])


@REG.add("ev02_backtest_folds", "fdays", folds_sql(5))
def ev02(spark, d):
    return evaluate.make_folds(series_daily(spark, d), H, "D", "balanced")


@REG.add("ev03_train_rows", "train", "SELECT fold, series_id, count(*) AS n, min(ds) AS first_day, max(ds) AS last_day, sum(y) AS y FROM train GROUP BY 1, 2", rnd="y")
def ev03(spark, d):
    return train_rows(spark, d).groupBy("fold", "series_id").agg(
        F.count("*").alias("n"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day"), F.sum("y").alias("y"))


@REG.add("ev03_test_rows", "test", "SELECT fold, series_id, ds, y FROM test", rnd="y")
def ev03_test(spark, d):
    daily, f = folds(spark, d)
    return evaluate.test_rows(daily, f)


@REG.add("ev04_align_predictions", "bpredi test", """SELECT m.model, t.fold, t.series_id, t.ds, t.y, yhat, yhat_lower, yhat_upper
  FROM test t CROSS JOIN (SELECT DISTINCT model FROM bpredi) m LEFT JOIN bpredi p ON p.model = m.model AND p.fold = t.fold AND p.series_id = t.series_id AND p.ds = t.ds""",
  rnd="y yhat yhat_lower yhat_upper")
def ev04(spark, d):
    t = tournament(spark, d)
    return evaluate.align_predictions(evaluate.test_rows(t.daily, t.folds), t.predictions)


ERR = "mae rmse smape mape wape bias interval_coverage interval_width interval_score"


@REG.add("ev05_regression_metrics", "fmetrics", "SELECT model, fold, mae, rmse, smape, mape, wape, bias, mean_actual, mean_forecast, n_obs FROM fmetrics",
         rnd="mae rmse smape mape wape bias mean_actual mean_forecast")
def ev05(spark, d):
    return tournament(spark, d).per_fold.drop("interval_coverage", "interval_width", "interval_score")


@REG.add("ev06_interval_metrics", "fmetrics", "SELECT model, fold, interval_coverage, interval_width, interval_score FROM fmetrics",
         rnd="interval_coverage interval_width interval_score")
def ev06(spark, d):
    return tournament(spark, d).per_fold.select("model", "fold", "interval_coverage", "interval_width", "interval_score")


@REG.add("ev07_fold_summary", "metrics", "SELECT * FROM metrics", rnd=ERR + " recent_accuracy stability overall_score")
def ev07(spark, d):
    return tournament(spark, d).summary


GAPS = "gap_mae gap_rmse gap_smape gap_wape gap_bias"


@REG.add("ev08_backtest_run", "last5 folds5 d entrants", """SELECT model, f.fold, count(*) AS n_obs, avg(d.y) AS mean_actual, 0.0::DOUBLE AS gap_mae, 0.0::DOUBLE AS gap_rmse, 0.0::DOUBLE AS gap_smape,
    0.0::DOUBLE AS gap_wape, 0.0::DOUBLE AS gap_bias FROM folds5 f JOIN d ON d.ds BETWEEN f.test_start AND f.test_end JOIN last5 l ON l.fold = f.fold AND l.series_id = d.series_id AND d.ds <= l.last_ds + 30,
  entrants GROUP BY 1, 2""", rnd=f"mean_actual {GAPS}")
def ev08(spark, d):
    """Every model and fold of the tournament: what was compared, and how far its errors are from those of the stored predictions."""
    daily = daily_model(spark, d)
    _, f, predictions, errors, _ = backtest(daily, settings(spark))
    assert not errors, errors
    per_fold, _ = evaluate.backtest_metrics(daily, f, predictions)
    spark_sql = """SELECT p.model, p.fold, mean(abs(t.y - p.yhat)) AS mae, sqrt(mean(power(t.y - p.yhat, 2))) AS rmse, mean(2 * abs(t.y - p.yhat) / (abs(t.y) + abs(p.yhat) + 1e-9)) AS smape,
        sum(abs(t.y - p.yhat)) / (sum(abs(t.y)) + 1e-9) AS wape, mean(p.yhat) - mean(t.y) AS bias
      FROM {predictions} p JOIN {folds} f ON p.fold = f.fold JOIN {daily} t ON t.series_id = p.series_id AND t.ds = p.ds AND t.ds BETWEEN f.test_start AND f.test_end GROUP BY p.model, p.fold"""
    again = spark.sql(spark_sql, predictions=predictions, folds=f, daily=daily)
    gaps = [((per_fold[c] - again[c]) / F.greatest(F.abs(again[c]), F.lit(1.0))).alias(f"gap_{c}") for c in ("mae", "rmse", "smape", "wape", "bias")]
    return per_fold.join(again, ["model", "fold"]).select("model", "fold", "n_obs", "mean_actual", *gaps)


@REG.add("pp10_tournament_cells", "last5 entrants", f"""SELECT model, fold, series_id, {H} AS steps, CAST(last_ds + 1 AS DATE) AS first_day, CAST(last_ds + {H} AS DATE) AS last_day, 0 AS out_of_order, 0 AS missing
  FROM last5, entrants""")
def tournament_cells(spark, d):
    """What every model, fold and series of the tournament predicted: steps, days, bounds in order, no value missing."""
    p = backtest(daily_model(spark, d), settings(spark))[2]
    wrong = (F.col("yhat") < 0) | (F.col("yhat_lower") > F.col("yhat")) | (F.col("yhat_upper") < F.col("yhat"))
    return p.groupBy("model", "fold", "series_id").agg(
        F.countDistinct("step").alias("steps"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day"),
        F.coalesce(F.sum(wrong.cast("long")), F.lit(0)).alias("out_of_order"), F.sum((F.col("yhat").isNull() | F.isnan("yhat")).cast("long")).alias("missing"),
    )


@REG.add("ev09_score_models", "scored", "SELECT model, bias_abs, " + ", ".join(f"score_{n}" for n in blend.SCORE_WEIGHTS) + ", final_rank_score FROM scored",
         rnd="bias_abs final_rank_score " + " ".join(f"score_{n}" for n in blend.SCORE_WEIGHTS))
def ev09(spark, d):
    scored = blend.score_models(tournament(spark, d).summary)
    return scored.select("model", "bias_abs", *[f"score_{n}" for n in blend.SCORE_WEIGHTS], "final_rank_score")


_ORDER = {p: f"{c} NULLS LAST, " for p, c in blend.PREFERENCES.items()}


@REG.add("ev10_rank_models", "scored", " UNION ALL ".join(
    f"SELECT '{p}' AS preference, model, row_number() OVER (ORDER BY {_ORDER.get(p, '')}final_rank_score DESC, model) AS rank FROM scored" for p in ("balanced", *blend.PREFERENCES)))
def ev10(spark, d):
    scored = blend.score_models(tournament(spark, d).summary)
    parts = [blend.rank_models(scored, p).select(F.lit(p).alias("preference"), "model", "rank") for p in ("balanced", *blend.PREFERENCES)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@REG.add("ev11_weighted_blend", "finalf ranked", """WITH r AS (SELECT f.*, r.final_rank_score AS w, f.model IN ('naive', 'seasonal_naive') AS hb FROM finalf f JOIN ranked r ON f.model = r.model WHERE r.rank <= 3)
  SELECT 'ensemble_blend' AS model, series_id, min(step) AS step, ds, sum(w * yhat) / sum(w) AS yhat,
   (sum(w * yhat_lower) FILTER (hb)) / (sum(w) FILTER (hb)) AS yhat_lower, (sum(w * yhat_upper) FILTER (hb)) / (sum(w) FILTER (hb)) AS yhat_upper
  FROM r GROUP BY series_id, ds""", rnd="yhat yhat_lower yhat_upper")
def ev11(spark, d):
    t = tournament(spark, d)
    return blend.blend(ranked(t), t.final)


@REG.add("ev12_sanity_gate", "finalf d", """WITH h AS (SELECT series_id, avg(y) FILTER (rn <= 30) AS a, max(y) FILTER (rn <= 30) AS m FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS rn FROM d) GROUP BY 1),
  p AS (SELECT model, series_id, min(yhat) AS lo, max(yhat) AS hi FROM finalf GROUP BY 1, 2),
  c AS (SELECT model, series_id, CASE WHEN lo < 0 THEN 2 WHEN hi > greatest(a * 10, m * 5, 1000000) THEN 3 WHEN hi / greatest(a, 1) > 10 THEN 4 ELSE 0 END AS code FROM p JOIN h USING (series_id))
  SELECT model, series_id, CAST(code = 0 AS INT) AS passed, CASE code WHEN 0 THEN 'ok' WHEN 2 THEN 'negative forecast values' WHEN 3 THEN 'forecast exceeds the allowed level' ELSE 'forecast to history ratio is too large' END AS reason FROM c""")
def ev12(spark, d):
    t = tournament(spark, d)
    return blend.sanity_gate(t.final, t.daily)


@REG.add("jn20_common_days", "finalf", """SELECT series_id, ds, count(*) AS models FROM finalf GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT model) FROM finalf g WHERE g.series_id = finalf.series_id)""")
def jn20(spark, d):
    f = tournament(spark, d).final
    k = f.groupBy("series_id").agg(F.countDistinct("model").alias("k"))
    per = f.groupBy("series_id", "ds").agg(F.count("*").alias("models"))
    return per.join(k, "series_id").filter("models = k").drop("k")
