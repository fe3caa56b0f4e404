"""Post-processing and whole forecast runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog.base import Registry, view
from catalog.frames import daily_model, series_daily
from catalog.model_queries import ranked, settings, tournament
from revcast.operators import blend
from revcast.operators import postprocess as P
from revcast.plans.forecast import CLOSED_FORM, ForecastConfig, run_forecast

REG = Registry()

view("tprofile", """WITH h AS (SELECT series_id, ds, y, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS rn, count(*) OVER (PARTITION BY series_id) AS n,
    ds - lag(ds) OVER (PARTITION BY series_id ORDER BY ds) AS gap FROM d),
  g AS (SELECT series_id, quantile_cont(gap, 0.5)::DOUBLE AS gap FROM h GROUP BY 1),
  t AS (SELECT h.series_id, ds, y, rn, g.gap AS mg, least(n, CASE WHEN g.gap >= 20 THEN 12 ELSE 180 END) AS pts FROM h JOIN g USING (series_id) WHERE n >= 8),
  f AS (SELECT series_id, pts AS points, any_value(mg) AS median_gap_days, regr_slope(y, pts - rn) AS slope, avg(y) FILTER (pts - rn < greatest(2, pts // 3)) AS early_mean,
    avg(y) FILTER (rn <= greatest(2, pts // 3)) AS recent_mean, avg(y) AS mean_y, max_by(y, ds) AS last_value FROM t WHERE rn <= pts GROUP BY 1, 2)
  SELECT series_id, CASE WHEN slope > 0 THEN 1 ELSE -1 END AS direction, slope, recent_mean, last_value,
    (recent_mean - early_mean) / greatest(abs(early_mean), 1) AS total_change, slope * points / greatest(abs(mean_y), 1) AS slope_strength, median_gap_days, points,
    CAST(abs((recent_mean - early_mean) / greatest(abs(early_mean), 1)) >= 0.12 AND abs(slope * points / greatest(abs(mean_y), 1)) >= 0.08 AND mean_y > 0 AS INT) AS clear FROM f""", "d")
# the same profile with a trend that is always clear, so that the guard has something to do
view("steep", """SELECT series_id, CASE WHEN series_id < 'C' THEN 1 ELSE -1 END AS direction, CASE WHEN series_id < 'C' THEN 1000.0 ELSE -1000.0 END::DOUBLE AS slope, recent_mean FROM tprofile""", "tprofile")

view("dfactors", """WITH t AS (SELECT * FROM (SELECT series_id, ds, y, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS rn FROM d) WHERE rn <= 180),
  r AS (SELECT *, avg(y) OVER (PARTITION BY series_id, date_trunc('month', ds)) AS m FROM t),
  q AS (SELECT series_id, day(ds) AS day, avg(y / m) AS raw, count(*) AS samples FROM r GROUP BY 1, 2 HAVING count(*) >= 2),
  s AS (SELECT series_id, day, greatest(0.6, least(1.4, raw / avg(raw) OVER (PARTITION BY series_id))) AS factor FROM q)
  SELECT * FROM (SELECT *, stddev_pop(factor) OVER (PARTITION BY series_id) AS strength FROM s) WHERE strength >= 0.03""", "d")


@REG.add("pp01_trend_profile", "tprofile", "SELECT * FROM tprofile", rnd="slope recent_mean last_value total_change slope_strength median_gap_days")
def pp01(spark, d):
    return P.trend_profile(series_daily(spark, d))


def _steep(spark, d):
    up = F.col("series_id") < "C"
    return P.trend_profile(series_daily(spark, d)).select(
        "series_id", F.when(up, 1).otherwise(-1).alias("direction"), F.when(up, 1000.0).otherwise(-1000.0).alias("slope"), "recent_mean", F.lit(1).alias("clear"))


@REG.add("pp02_trend_guardrail", "finalf steep", """WITH i AS (SELECT *, row_number() OVER (PARTITION BY model, series_id ORDER BY ds) - 1 AS i FROM finalf),
  f AS (SELECT model, series_id, regr_slope(yhat, i) * count(*) / greatest(abs(avg(yhat)), 1) AS ch, avg(yhat) FILTER (i < 3) AS head FROM i GROUP BY 1, 2),
  n AS (SELECT model, f.series_id, direction, slope, recent_mean FROM f JOIN steep s USING (series_id)
    WHERE ch * direction < 0.04 OR (direction > 0 AND head < recent_mean * 0.98) OR (direction < 0 AND head > recent_mean * 1.02)),
  j AS (SELECT i.*, n.direction, CASE WHEN n.direction IS NULL THEN yhat WHEN n.direction > 0 THEN greatest(0, greatest(yhat, recent_mean + slope * (i + 1) * 0.75))
      ELSE greatest(0, least(yhat, recent_mean + slope * (i + 1) * 0.75)) END AS nv FROM i LEFT JOIN n ON i.model = n.model AND i.series_id = n.series_id)
  SELECT model, series_id, step, ds, nv AS yhat,
    CASE WHEN direction IS NULL THEN yhat_lower WHEN abs(yhat) > 1e-9 THEN CASE WHEN yhat_lower IS NOT NULL THEN greatest(0, yhat_lower * nv / yhat) END ELSE greatest(0, nv * 0.92) END AS yhat_lower,
    CASE WHEN direction IS NULL THEN yhat_upper WHEN abs(yhat) > 1e-9 THEN CASE WHEN yhat_upper IS NOT NULL THEN greatest(0, yhat_upper * nv / yhat) END ELSE greatest(0, nv * 1.08) END AS yhat_upper,
    CAST(direction IS NOT NULL AS INT) AS guarded FROM j""", rnd="yhat yhat_lower yhat_upper", digits=3)
def pp02(spark, d):
    return P.trend_guardrail(tournament(spark, d).final, _steep(spark, d))


EDGE = """SELECT {k}, (avg({v}) FILTER (e) - avg({v}) FILTER (m)) / greatest(abs(avg({v}) FILTER (m)), 1) AS {n} FROM (
  SELECT *, day(ds) <= 4 OR day(ds) > day(last_day(ds)) - 4 AS e, day(ds) BETWEEN 11 AND 20 AS m FROM {t}) GROUP BY {k}
  HAVING count(*) >= 28 AND count(*) FILTER (e) >= 6 AND count(*) FILTER (m) >= 6"""


@REG.add("pp03_month_edge_lift", "d", EDGE.format(k="series_id", v="y", t="d", n="edge_lift"), rnd="edge_lift")
def pp03(spark, d):
    return P.month_edge_lift(series_daily(spark, d), "y", ("series_id",))


@REG.add("pp04_display_choice", "d finalf blended ranked", f"""WITH h AS ({EDGE.format(k="series_id", v="y", t="d", n="hist")}),
  bf AS (SELECT * FROM finalf WHERE model = (SELECT model FROM ranked WHERE rank = 1)),
  b AS ({EDGE.format(k="series_id", v="yhat", t="bf", n="best")}), m AS ({EDGE.format(k="series_id", v="yhat", t="blended", n="blend")}),
  r AS (SELECT h.series_id, hist, best, blend, CASE WHEN hist >= 0 THEN 1 ELSE -1 END AS sg, coalesce(blend, 0) AS bl FROM h LEFT JOIN b USING (series_id) LEFT JOIN m USING (series_id))
  SELECT series_id, hist, best, blend, CASE WHEN coalesce(abs(hist) >= 0.05 AND best IS NOT NULL AND abs(best) >= 0.03 AND (blend IS NULL OR abs(blend) < 0.02 OR
    (sg * best > sg * bl + 0.03 AND abs(best - hist) <= CASE WHEN abs(bl - hist) > 0 THEN abs(bl - hist) * 0.9 ELSE abs(best - hist) END)), false)
    THEN 'best' ELSE 'blend' END AS choice FROM r""", rnd="hist best blend")
def pp04(spark, d):
    t = tournament(spark, d)
    r = ranked(t)
    return P.display_choice(blend.best_forecast(r, t.final), blend.blend(r, t.final), t.daily)


@REG.add("pp05_day_of_month_factors", "dfactors", "SELECT series_id, day, factor, strength FROM dfactors", rnd="factor strength")
def pp05(spark, d):
    return P.day_factors(series_daily(spark, d))


@REG.add("pp06_calendar_shape", "finalf dfactors", """WITH j AS (SELECT f.*, coalesce(x.factor, 1) / avg(coalesce(x.factor, 1)) OVER (PARTITION BY model, f.series_id) AS g
    FROM finalf f LEFT JOIN dfactors x ON f.series_id = x.series_id AND day(f.ds) = x.day)
  SELECT model, series_id, step, ds, greatest(0, yhat * g) AS yhat, CASE WHEN yhat_lower IS NOT NULL THEN least(greatest(0, yhat_lower * g), yhat * g) END AS yhat_lower,
    CASE WHEN yhat_upper IS NOT NULL THEN greatest(greatest(0, yhat_upper * g), yhat * g) END AS yhat_upper FROM j""", rnd="yhat yhat_lower yhat_upper", digits=3)
def pp06(spark, d):
    return P.apply_day_factors(tournament(spark, d).final, P.day_factors(series_daily(spark, d)))


BANDS = """SELECT series_id, ds, round(coalesce(least(yhat_lower, yhat), yhat * 0.92::DOUBLE), 2) AS conservative, round(yhat, 2) AS expected,
  round(coalesce(CASE WHEN yhat_upper IS NOT NULL THEN greatest(yhat_upper, yhat) END, yhat * 1.08::DOUBLE), 2) AS aggressive FROM blended"""


@REG.add("pp07_scenario_bands", "finalf ranked", """WITH r AS (SELECT f.*, r.final_rank_score AS w, f.model IN ('naive', 'seasonal_naive') AS hb FROM finalf f JOIN ranked r ON f.model = r.model WHERE r.rank <= 3),
  b AS (SELECT series_id, ds, sum(w * yhat) / sum(w) AS yhat, (sum(w * yhat_lower) FILTER (hb)) / (sum(w) FILTER (hb)) AS lo, (sum(w * yhat_upper) FILTER (hb)) / (sum(w) FILTER (hb)) AS hi FROM r GROUP BY 1, 2)
  SELECT series_id, ds, CASE WHEN lo IS NULL THEN yhat * 0.92::DOUBLE ELSE least(lo, yhat) END AS conservative, yhat AS expected,
    CASE WHEN hi IS NULL THEN yhat * 1.08::DOUBLE ELSE greatest(hi, yhat) END AS aggressive FROM b""", rnd="conservative expected aggressive", digits=0)
def pp07(spark, d):
    t = tournament(spark, d)
    return P.scenario_bands(blend.blend(ranked(t), t.final))


@REG.add("pp08_output_mode_intervals", "finalf", "SELECT series_id, ds, yhat, yhat_lower, yhat_upper FROM finalf WHERE model = 'naive'", rnd="yhat yhat_lower yhat_upper")
def pp08(spark, d):
    return P.output_mode(tournament(spark, d).final.filter("model = 'naive'"), "intervals")


@REG.add("pp09_percentile_frame", "finalf", """SELECT series_id, ds, coalesce(yhat_lower, yhat * 0.92::DOUBLE) AS p10, yhat AS p50, coalesce(yhat_upper, yhat * 1.08::DOUBLE) AS p90 FROM finalf""", rnd="p10 p50 p90")
def pp09(spark, d):
    return P.percentile_frame(tournament(spark, d).final)


def flagship(spark, d):
    """Scenario bands of the display forecast, per platform."""
    return run_forecast(series_daily(spark, d), ForecastConfig(horizon=30, models=tuple(CLOSED_FORM))).output


@REG.add("pp10_forecast_run_all_families")
def pp10_all(spark, d):
    """All families in one tournament over daily series with regressors, as intervals of the display forecast."""
    return run_forecast(daily_model(spark, d), replace(settings(spark), mode="intervals")).output


@REG.add("pp10_forecast_run")
def pp10(spark, d):
    return flagship(spark, d)
