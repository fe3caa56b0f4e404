"""Feature queries; the comparison SQL is generated from the same lists of lags and windows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog.base import Registry
from catalog.frames import company_daily, daily_model, series_daily
from revcast.operators import features as X
from revcast.sources import adapters as A

REG = Registry()
W = "PARTITION BY series_id ORDER BY ds"


def roll(fn: str, c: str, k: int, least: int) -> str:
    frame = f"OVER ({W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({c}) {frame} >= {least} THEN {fn}({c}) {frame} END"


@REG.add("fe01_calendar", "d", """SELECT series_id, ds, isodow(ds) - 1 AS day_of_week, day(ds) AS day_of_month, dayofyear(ds) AS day_of_year,
  weekofyear(ds) AS week_of_year, month(ds) AS month, quarter(ds) AS quarter, year(ds) AS year, CAST(isodow(ds) >= 6 AS INT) AS is_weekend,
  CAST(ds = last_day(ds) AS INT) AS is_month_end, CAST(day(ds) = 1 AS INT) AS is_month_start,
  CAST(ds = last_day(ds) AND month(ds) % 3 = 0 AS INT) AS is_quarter_end, CAST(day(ds) = 1 AND month(ds) % 3 = 1 AS INT) AS is_quarter_start,
  sin(2 * pi() * (isodow(ds) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ds) - 1) / 7) AS dow_cos,
  sin(2 * pi() * month(ds) / 12) AS month_sin, cos(2 * pi() * month(ds) / 12) AS month_cos,
  sin(2 * pi() * dayofyear(ds) / 365.25) AS doy_sin, cos(2 * pi() * dayofyear(ds) / 365.25) AS doy_cos FROM d""",
  rnd="dow_sin dow_cos month_sin month_cos doy_sin doy_cos")
def fe01(spark, d):
    return X.add_calendar(series_daily(spark, d).select("series_id", "ds"))


@REG.add("fe02_lags", "d", "SELECT series_id, ds, y, " + ", ".join(f"lag(y, {k}) OVER ({W}) AS lag_{k}" for k in (1, 7, 14, 28)) + " FROM d",
         rnd="y lag_1 lag_7 lag_14 lag_28")
def fe02(spark, d):
    return X.add_lags(series_daily(spark, d))


_R = [(f"rolling_mean_{k}", roll("avg", "y", k, k)) for k in (7, 14, 28)] + [(f"rolling_std_{k}", roll("stddev_samp", "y", k, k)) for k in (7, 14, 28)]


@REG.add("fe03_rolling", "d", "SELECT series_id, ds, " + ", ".join(f"{e} AS {n}" for n, e in _R) + " FROM d", rnd=" ".join(n for n, _ in _R))
def fe03(spark, d):
    return X.add_rolling(series_daily(spark, d)).drop("y")


@REG.add("fe04_event_columns", "evd", "SELECT ds, outage_flag, 0 AS promo_flag, 0 AS holiday_flag FROM evd")
def fe04(spark, d):
    return X.ensure_event_columns(A.events_daily(spark, d).select("ds", "outage_flag"))


@REG.add("fe05_hierarchy", "d", """SELECT series_id, ds, y, 'company_total' AS top_level, series_id AS bottom_level FROM d""", rnd="y")
def fe05(spark, d):
    return X.add_hierarchy(series_daily(spark, d))


@REG.add("fe05_hierarchy_totals", "d", "SELECT ds, series_id, y FROM d UNION ALL SELECT ds, 'company_total', sum(y) FROM d GROUP BY 1", rnd="y")
def fe05_totals(spark, d):
    return X.hierarchy_totals(series_daily(spark, d))


def _regressor_sql() -> tuple[str, str]:
    cols = []
    for c in ("leads", "cost"):
        cols += [(f"{c}_is_missing", f"CAST({c} IS NULL AS INT)"), (f"{c}_filled", f"coalesce({c}, 0)")]
        cols += [(f"{c}_lag_{k}", f"lag({c}, {k}) OVER ({W})") for k in (1, 2, 3, 7, 14)]
        for k in (3, 7, 14, 28):
            cols += [(f"{c}_roll_{n}_{k}", roll(f, c, k, 3)) for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("sum", "sum"))]
        cols.append((f"{c}_trend_1v7", f"lag({c}, 1) OVER ({W}) - {roll('avg', c, 7, 3)}"))
        cols.append((f"{c}_trend_7v28", f"{roll('avg', c, 7, 3)} - {roll('avg', c, 28, 3)}"))
    cols += [(f"{c}_nonzero", f"CAST(coalesce({c}, 0) > 0 AS INT)") for c in ("leads", "cost")]
    body = ", ".join(f"{e} AS {n}" for n, e in cols)
    sql = f"""WITH q AS (SELECT quantile_cont(leads, 0.995) AS l, quantile_cont(cost, 0.995) AS c FROM dm),
      b AS (SELECT series_id, ds, least(leads, l) AS leads, least(cost, c) AS cost FROM dm, q)
      SELECT series_id, ds, leads, cost, {body} FROM b"""
    doubles = ["leads", "cost"] + [n for n, _ in cols if "missing" not in n and "nonzero" not in n]
    return sql, " ".join(doubles)


_REG_SQL, _REG_RND = _regressor_sql()


@REG.add("fe06_regressor_features", "dm", _REG_SQL, rnd=_REG_RND)
def fe06(spark, d):
    return X.add_regressor_features(daily_model(spark, d).drop("y"))


@REG.add("fe07_ewm", "evd", """WITH RECURSIVE o AS (SELECT *, row_number() OVER (ORDER BY ds) AS rn FROM evd),
  e AS (SELECT rn, ds, NULL::DOUBLE AS leads_ewm_7, NULL::DOUBLE AS leads_ewm_28, leads FROM o WHERE rn = 1
    UNION ALL SELECT o.rn, o.ds, CASE WHEN e.leads_ewm_7 IS NULL THEN e.leads ELSE e.leads_ewm_7 + 2.0::DOUBLE / 8 * (e.leads - e.leads_ewm_7) END,
      CASE WHEN e.leads_ewm_28 IS NULL THEN e.leads ELSE e.leads_ewm_28 + 2.0::DOUBLE / 29 * (e.leads - e.leads_ewm_28) END, o.leads
    FROM e JOIN o ON o.rn = e.rn + 1)
  SELECT ds, leads, leads_ewm_7, leads_ewm_28 FROM e""", rnd="leads leads_ewm_7 leads_ewm_28")
def fe07(spark, d):
    df = A.events_daily(spark, d).select(F.lit("company_total").alias("series_id"), "ds", "leads")
    return X.add_ewm(df, ["leads"]).drop("series_id")


@REG.add("fe07_ewm_series", "dm", """WITH RECURSIVE o AS MATERIALIZED (SELECT series_id, ds, y, leads, cost, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS rn FROM dm),
  e AS (SELECT *, NULL::DOUBLE AS leads_ewm_7, NULL::DOUBLE AS leads_ewm_28, NULL::DOUBLE AS cost_ewm_7, NULL::DOUBLE AS cost_ewm_28 FROM o WHERE rn = 1
    UNION ALL SELECT o.*, coalesce(leads_ewm_7 + (e.leads - leads_ewm_7) * 2.0::DOUBLE / 8, e.leads), coalesce(leads_ewm_28 + (e.leads - leads_ewm_28) * 2.0::DOUBLE / 29, e.leads),
      coalesce(cost_ewm_7 + (e.cost - cost_ewm_7) * 2.0::DOUBLE / 8, e.cost), coalesce(cost_ewm_28 + (e.cost - cost_ewm_28) * 2.0::DOUBLE / 29, e.cost)
    FROM e JOIN o ON o.rn = e.rn + 1 AND o.series_id = e.series_id)
  SELECT * EXCLUDE (rn) FROM e""", rnd="y leads cost leads_ewm_7 leads_ewm_28 cost_ewm_7 cost_ewm_28")
def fe07_series(spark, d):
    return X.add_ewm(daily_model(spark, d))


@REG.add("fe08_ratios", "dm", """WITH r AS (SELECT series_id, ds, greatest(y / (nullif(leads, 0) + 1e-6), 0) AS rev_per_lead, ln(1 + leads) AS log_leads,
    y - cost AS margin_after_cost, greatest(y / (nullif(cost, 0) + 1e-6), 0) AS roas_calc, ln(1 + cost) AS log_cost,
    greatest(cost / (nullif(leads, 0) + 1e-6), 0) AS cost_per_lead, greatest(leads * cost, 0) AS leads_x_cost FROM dm),
  q AS (SELECT quantile_cont(rev_per_lead, 0.995) AS a, quantile_cont(roas_calc, 0.995) AS b, quantile_cont(cost_per_lead, 0.995) AS c,
    quantile_cont(leads_x_cost, 0.995) AS e FROM r)
  SELECT series_id, ds, least(rev_per_lead, a) AS rev_per_lead, log_leads, margin_after_cost, least(roas_calc, b) AS roas_calc, log_cost,
    least(cost_per_lead, c) AS cost_per_lead, least(leads_x_cost, e) AS leads_x_cost FROM r, q""",
  rnd="rev_per_lead log_leads margin_after_cost roas_calc log_cost cost_per_lead leads_x_cost", digits=3)
def fe08(spark, d):
    return X.add_ratios(daily_model(spark, d)).drop("y", "leads", "cost")


@REG.add("fe09_event_interactions", "evd", """SELECT ds, leads, outage_flag, outage_flag * leads AS outage_flag_x_leads,
  outage_flag * coalesce(lag(y) OVER (ORDER BY ds), 0) AS outage_flag_x_lag1 FROM evd""", rnd="leads outage_flag_x_leads outage_flag_x_lag1")
def fe09(spark, d):
    df = A.events_daily(spark, d).select(F.lit("company_total").alias("series_id"), "ds", "y", "leads", "outage_flag")
    return X.add_event_interactions(X.add_lags(df, [1])).drop("series_id", "y", "lag_1")


@REG.add("fe10_series_shape", "d", f"""WITH x AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n,
    lag(y) OVER ({W}) AS p, lag(y, 7) OVER ({W}) AS s, count(y) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c,
    avg(y) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m,
    stddev_samp(y) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sd FROM d)
  SELECT series_id, ds, i AS days_from_series_start, i / greatest(n - 1, 1) AS series_age_frac, CASE WHEN c >= 2 THEN m END AS expanding_mean,
    CASE WHEN c >= 2 THEN sd END AS expanding_std, y - s AS seasonal_diff_1, (y - p) / nullif(p, 0) AS growth_rate_1,
    (y - s) / nullif(s, 0) AS growth_rate_seasonal FROM x""",
  rnd="series_age_frac expanding_mean expanding_std seasonal_diff_1 growth_rate_1 growth_rate_seasonal", digits=3)
def fe10(spark, d):
    return X.add_series_shape(series_daily(spark, d)).drop("y")


@REG.add("fe11_recent_memory", "d", f"""SELECT series_id, ds,
  0.5 * coalesce(lag(y, 1) OVER ({W}), 0) + 0.3 * coalesce(lag(y, 2) OVER ({W}), 0) + 0.2 * coalesce(lag(y, 7) OVER ({W}), 0) AS lag_weighted_recent,
  0.35 * coalesce(lag(y, 1) OVER ({W}), 0) + 0.25 * coalesce(lag(y, 7) OVER ({W}), 0) + 0.2 * coalesce(lag(y, 14) OVER ({W}), 0)
   + 0.2 * coalesce(lag(y, 28) OVER ({W}), 0) AS lag_weighted_extended,
  lag(y) OVER ({W}) - {roll('avg', 'y', 7, 7)} AS trend_vs_7d_avg, lag(y) OVER ({W}) - {roll('avg', 'y', 28, 28)} AS trend_vs_28d_avg FROM d""",
  rnd="lag_weighted_recent lag_weighted_extended trend_vs_7d_avg trend_vs_28d_avg")
def fe11(spark, d):
    return X.add_recent_memory(series_daily(spark, d)).drop("y")


@REG.add("fe12_missing_flags", "d", f"""SELECT series_id, ds, CAST(lag(y, 1) OVER ({W}) IS NULL AS INT) AS lag_1_missing_flag,
  CAST(lag(y, 28) OVER ({W}) IS NULL AS INT) AS lag_28_missing_flag FROM d""")
def fe12(spark, d):
    return X.add_missing_flags(X.add_lags(series_daily(spark, d), [1, 28])).select("series_id", "ds", "lag_1_missing_flag", "lag_28_missing_flag")


def _recipe_sql(r: X.FeatureRecipe) -> tuple[str, str]:
    """A recipe over ``dm``: every column, and the names of the doubles."""
    whole = {  # calendar
        "day_of_week": "isodow(ds) - 1", "day_of_month": "day(ds)", "day_of_year": "dayofyear(ds)", "week_of_year": "weekofyear(ds)", "month": "month(ds)", "quarter": "quarter(ds)",
        "year": "year(ds)", "is_weekend": "CAST(isodow(ds) >= 6 AS INT)", "is_month_end": "CAST(ds = last_day(ds) AS INT)", "is_month_start": "CAST(day(ds) = 1 AS INT)",
        "is_quarter_end": "CAST(ds = last_day(ds) AND month(ds) % 3 = 0 AS INT)", "is_quarter_start": "CAST(day(ds) = 1 AND month(ds) % 3 = 1 AS INT)",
    }
    real = {"leads": "leads", "cost": "cost"}
    for name, value, size in (("dow", "(isodow(ds) - 1)", "7"), ("month", "month(ds)", "12"), ("doy", "dayofyear(ds)", "365.25")):
        real |= {f"{name}_{fn}": f"{fn}(2 * pi() * {value} / {size}::DOUBLE)" for fn in ("sin", "cos")}
    real |= {f"lag_{k}": f"lag(y, {k}) OVER ({W})" for k in r.lags}
    for k in r.windows:
        real |= {f"rolling_mean_{k}": roll("avg", "y", k, k), f"rolling_std_{k}": roll("stddev_samp", "y", k, k)}
    if r.memory:
        mixes = {"recent": {1: 0.5, 2: 0.3, 7: 0.2}, "extended": {1: 0.35, 7: 0.25, 14: 0.2, 28: 0.2}}
        real |= {f"lag_weighted_{n}": " + ".join(f"{w}::DOUBLE * coalesce(lag(y, {k}) OVER ({W}), 0)" for k, w in m.items()) for n, m in mixes.items()}
        real |= {f"trend_vs_{k}d_avg": f"lag(y) OVER ({W}) - {roll('avg', 'y', k, k)}" for k in (7, 28)}
    for c in ("leads", "cost"):
        whole[f"{c}_is_missing"] = f"CAST({c} IS NULL AS INT)"
        real[f"{c}_filled"] = f"coalesce({c}, 0)"
        real |= {f"{c}_lag_{k}": f"lag({c}, {k}) OVER ({W})" for k in X.regressor_lags(r.profile, 7)}
        for k in X.PROFILE_WINDOWS[r.profile]:
            real |= {f"{c}_roll_{n}_{k}": roll(f, c, k, 3) for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("sum", "sum"))}
        real[f"{c}_trend_1v7"] = f"lag({c}, 1) OVER ({W}) - {roll('avg', c, 7, 3)}"
        real[f"{c}_trend_7v28"] = f"{roll('avg', c, 7, 3)} - {roll('avg', c, 28, 3)}"
        whole[f"{c}_nonzero"] = f"CAST(coalesce({c}, 0) > 0 AS INT)"
    for f in ("outage_flag", "promo_flag", "holiday_flag"):
        whole[f] = "0"
        real |= {f"{f}_x_{n}": "0.0::DOUBLE" for n in ("cost", "leads", "lag1")}
    index, y = f"row_number() OVER ({W}) - 1", f"lag(y, 1) OVER ({W})"
    whole["days_from_series_start"] = index
    before, season = f"lag(y, 2) OVER ({W})", f"lag(y, 8) OVER ({W})"
    frame = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    real |= {
        "series_age_frac": f"({index}) / greatest(count(*) OVER (PARTITION BY series_id) - 1, 1)",
        "expanding_mean": f"CASE WHEN count(y) {frame} >= 2 THEN avg(y) {frame} END", "expanding_std": f"CASE WHEN count(y) {frame} >= 2 THEN stddev_samp(y) {frame} END",
        "seasonal_diff_1": f"{y} - {season}", "growth_rate_1": f"({y} - {before}) / nullif({before}, 0)", "growth_rate_seasonal": f"({y} - {season}) / nullif({season}, 0)",
    }
    body = ", ".join(f"{e} AS {n}" for n, e in {**whole, **real}.items() if n not in ("leads", "cost"))
    flags = ", ".join(f"CAST({n} IS NULL AS INT) AS {n}_missing_flag" for n in {**whole, **real})
    sql = f"""WITH q AS (SELECT quantile_cont(leads, 0.995) AS l, quantile_cont(cost, 0.995) AS c FROM dm),
      b AS (SELECT series_id, ds, y, least(leads, l) AS leads, least(cost, c) AS cost FROM dm, q), x AS (SELECT series_id, ds, y, leads, cost, {body} FROM b)
      SELECT *, {flags} FROM x"""
    return sql, " ".join(["y", *real])


_RECIPES = {f"fe13_recipe_{m}{'_' + p if p else ''}": X.recipe(m, lag_profile=p) for m, p in (("gradient_boosting", "standard"), ("ridge", None), ("random_forest", None))}


def _recipe_query(r: X.FeatureRecipe):
    return lambda spark, d: X.build_features(daily_model(spark, d), replace(r, flags=True))


for _name, _r in _RECIPES.items():
    _sql, _rnd = _recipe_sql(_r)
    REG.add(_name if _name != "fe13_recipe_gradient_boosting_standard" else "fe13_recipe_gradient_boosting", "dm", _sql, rnd=_rnd, digits=3)(_recipe_query(_r))


@REG.add("fe14_smoothing", "dc", """SELECT ds, y, avg(y) OVER (ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS y_roll7,
  avg(y) OVER (ORDER BY ds ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS y_roll30 FROM dc""", rnd="y y_roll7 y_roll30")
def fe14(spark, d):
    daily = company_daily(spark, d).select("ds", "y")
    return X.smooth(X.smooth(daily, ["y"], 7, suffix="_roll7"), ["y"], 30, suffix="_roll30")


@REG.add("fe14_risk_bands", "d", f"""WITH b AS (SELECT series_id, ds, y * 0.92 AS c, y AS e, y * 1.08 AS a FROM d)
  SELECT series_id, ds, avg(c) OVER w AS conservative, avg(e) OVER w AS expected, avg(a) OVER w AS aggressive FROM b
  WINDOW w AS ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", rnd="conservative expected aggressive", digits=3)
def fe14_bands(spark, d):
    bands = series_daily(spark, d).select("series_id", "ds", (F.col("y") * 0.92).alias("conservative"), F.col("y").alias("expected"),
                                          (F.col("y") * 1.08).alias("aggressive"))
    return X.risk_bands(bands)
