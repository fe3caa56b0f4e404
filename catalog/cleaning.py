"""Cleaning, typing and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Registry
from revcast.functions import scalars as S
from revcast.functions.dates import parse_days, parse_months
from revcast.operators import clean
from revcast.sources import adapters as A
from revcast.sources.readers import HELPER_LIMITS, likely_value_columns, preview

REG = Registry()
SPEC = clean.FixSpec(("Revenue Date",), ("Revenue",), ("Platform", "Campaign"))
AS_OF = "2001-01-31"


def dirty(spark, d):
    return clean.trim_headers(A.dirty_revenue(spark, d))


NULLED = """CASE WHEN lower(trim({c})) IN ('', 'n/a', 'na', 'null', 'none', '-', '--', 'nan') THEN NULL ELSE {c} END"""
MONEY = """TRY_CAST(regexp_replace(regexp_replace(trim("Revenue"), '[$,]', '', 'g'), '\\(([^)]+)\\)', '-\\1', 'g') AS DOUBLE)"""


@REG.add("io02_parquet_scan", sql="""SELECT o_orderkey, o_totalprice FROM orders
  WHERE o_orderdate < TIMESTAMP '1996-01-01'""", rnd="o_totalprice")
def io02(spark, d):
    return A.table(spark, d, "orders").filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")).select(
        "o_orderkey", "o_totalprice")


@REG.add("io05_likely_value_columns", sql="""WITH u AS (
  SELECT 'l_quantity' AS "column", l_quantity AS v FROM lineitem UNION ALL
  SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL
  SELECT 'l_discount', l_discount FROM lineitem UNION ALL
  SELECT 'l_tax', l_tax FROM lineitem UNION ALL
  SELECT 'l_suppkey', l_suppkey FROM lineitem UNION ALL
  SELECT 'l_returnflag', TRY_CAST(l_returnflag AS DOUBLE) FROM lineitem),
  m AS (SELECT "column", count(v) / count(*) AS valid_ratio, quantile_cont(v, 0.5) AS median FROM u GROUP BY 1)
  SELECT "column", valid_ratio, median, valid_ratio * 1000 - abs(median) AS score FROM m
  WHERE valid_ratio >= 0.8 AND median > 0 AND median <= 1e14 ORDER BY score DESC, "column" LIMIT 5""",
  rnd="valid_ratio median score")
def io05(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "l_returnflag"]
    return likely_value_columns(A.table(spark, d, "lineitem").select(*cols), top=5)


@REG.add("io05_likely_helper_columns", sql="""WITH u AS (
  SELECT 'ps_cost' AS "column", p_retailprice AS v FROM part UNION ALL SELECT 'p_size', p_size FROM part UNION ALL SELECT 'p_brand', TRY_CAST(p_brand AS DOUBLE) FROM part),
  m AS (SELECT "column", count(v) / count(*) AS valid_ratio, quantile_cont(v, 0.5) AS median FROM u GROUP BY 1)
  SELECT "column", valid_ratio, median, valid_ratio * 1000 - abs(median) AS score FROM m WHERE valid_ratio >= 0.75 AND median > -1 AND median <= 1e12""",
  rnd="valid_ratio median score")
def io05_helper(spark, d):
    part = A.table(spark, d, "part").select(F.col("p_retailprice").alias("ps_cost"), "p_size", "p_brand")
    return likely_value_columns(part, limits=HELPER_LIMITS)


@REG.add("io06_preview", "ord", "SELECT * FROM ord ORDER BY purchase_id LIMIT 20", rnd="y")
def io06(spark, d):
    return preview(A.revenue_orders(spark, d).orderBy("purchase_id"), 20)


@REG.add("io13_json_ready_records", sql="""SELECT event_id, event_type,
  strftime(ts, '%Y-%m-%d') AS day, CASE WHEN value > 0 THEN ln(value) END AS log_value FROM events""", rnd="log_value")
def io13(spark, d):
    ev = A.table(spark, d, "events")
    return ev.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"),
                     S.finite(F.ln("value")).alias("log_value"))


@REG.add("cl01_trim_headers", "dirty", """SELECT "Revenue Date", "Revenue", "Platform", "Campaign" FROM dirty""")
def cl01(spark, d):
    return dirty(spark, d)


@REG.add("cl02_null_tokens", "dirty", f"""SELECT "Revenue Date", {NULLED.format(c='"Revenue"')} AS "Revenue",
  {NULLED.format(c='"Platform"')} AS "Platform", "Campaign" FROM dirty""")
def cl02(spark, d):
    return clean.standardize_nulls(dirty(spark, d))


@REG.add("cl03_drop_blank_rows", "dirty", f"""SELECT * FROM (SELECT {NULLED.format(c='"Revenue"')} AS "Revenue",
  {NULLED.format(c='"Platform"')} AS "Platform" FROM dirty) WHERE "Revenue" IS NOT NULL OR "Platform" IS NOT NULL""")
def cl03(spark, d):
    return clean.drop_blank_rows(clean.standardize_nulls(dirty(spark, d).select("Revenue", "Platform")))


@REG.add("cl04_drop_duplicates", sql="SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def cl04(spark, d):
    return clean.drop_duplicate_rows(A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@REG.add("cl05_parse_money", "dirty", f"""SELECT "Revenue Date", {MONEY} AS "Revenue" FROM dirty""", rnd='"Revenue"')
def cl05(spark, d):
    return clean.parse_numeric_columns(dirty(spark, d).select("Revenue Date", "Revenue"), ["Revenue"])


@REG.add("cl06_trim_dimensions", "dirty", """SELECT "Revenue Date",
  CASE WHEN trim("Platform") IN ('', 'nan', 'None', 'NaT') THEN NULL ELSE trim("Platform") END AS "Platform",
  trim("Campaign") AS "Campaign" FROM dirty""")
def cl06(spark, d):
    return clean.trim_dimensions(dirty(spark, d).drop("Revenue"), ["Platform", "Campaign"])


@REG.add("cl07_sort_dates", "ord", "SELECT * FROM ord ORDER BY ds, purchase_id", rnd="y")
def cl07(spark, d):
    return A.revenue_orders(spark, d).orderBy("ds", "purchase_id")


@REG.add("cl08_drop_future_dates", "ord", f"SELECT ds, purchase_id FROM ord WHERE ds <= DATE '{AS_OF}'")
def cl08(spark, d):
    return clean.drop_future_dates(A.revenue_orders(spark, d).select("ds", "purchase_id"), "ds", AS_OF)


@REG.add("cl09_apply_fixes", "dirty", f"""SELECT CAST(strptime("Revenue Date", '%m/%d/%Y') AS DATE) AS "Revenue Date",
  {MONEY} AS "Revenue", CASE WHEN upper(trim("Platform")) = 'NULL' THEN NULL ELSE trim("Platform") END AS "Platform", "Campaign"
  FROM (SELECT DISTINCT "Revenue Date", {NULLED.format(c='"Revenue"')} AS "Revenue", {NULLED.format(c='"Platform"')} AS "Platform",
        "Campaign" FROM dirty) WHERE strptime("Revenue Date", '%m/%d/%Y') <= DATE '{AS_OF}'""", rnd='"Revenue"')
def cl09(spark, d):
    return clean.apply_fixes(A.dirty_revenue(spark, d), SPEC, AS_OF)


@REG.add("cl09_fix_audit", "dirty", f"""WITH n AS (SELECT "Revenue Date" AS a, {NULLED.format(c='"Revenue"')} AS r,
    {NULLED.format(c='"Platform"')} AS p, "Campaign" AS c FROM dirty), u AS (SELECT DISTINCT * FROM n),
  f AS (SELECT *, strptime(a, '%m/%d/%Y') > DATE '{AS_OF}' AS future FROM u),
  c AS (SELECT (SELECT count(*) FROM dirty) AS rows_before, (SELECT count(*) FROM u) AS rows_unique,
    (SELECT count(*) FROM f WHERE future) AS fut,
    (SELECT count(*) FILTER (r IS NULL) + count(*) FILTER (p IS NULL) FROM n) AS rep,
    (SELECT count(r) FROM u) AS parsed)
  SELECT rows_before, rows_unique - fut AS rows_after, rep AS values_replaced, 0 AS blank_rows_removed,
    rows_before - rows_unique AS duplicate_rows_removed, fut AS future_rows_removed, parsed AS numbers_parsed,
    (rep > 0)::INT + (rows_before > rows_unique)::INT + (fut > 0)::INT + (parsed > 0)::INT AS effective_fixes FROM c""")
def cl09_audit(spark, d):
    return clean.fix_audit(A.dirty_revenue(spark, d), SPEC, AS_OF)


@REG.add("cl10_smart_date_parse", "dirty", """SELECT "Revenue Date" AS raw,
  CAST(strptime("Revenue Date", '%m/%d/%Y') AS DATE) AS parsed FROM dirty""")
def cl10(spark, d):
    df = dirty(spark, d).select(F.col("Revenue Date").alias("raw"))
    return parse_days(df, "raw", "parsed")


@REG.add("cl10_excel_serial_dates", sql="""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed FROM orders""")
def cl10_excel(spark, d):
    serial = F.datediff("o_orderdate", F.lit("1899-12-30")).cast("double")
    return parse_days(A.table(spark, d, "orders").select("o_orderkey", serial.alias("raw")), "raw", "parsed").drop("raw")


@REG.add("cl10_epoch_millis_dates", sql="""SELECT event_id, CAST(ts AS DATE) AS parsed FROM events""")
def cl10_epoch(spark, d):
    millis = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    return parse_days(A.table(spark, d, "events").select("event_id", millis.alias("raw")), "raw", "parsed").drop("raw")


@REG.add("cl11_normalise_day", sql="SELECT event_id, CAST(ts AS DATE) AS ds FROM events")
def cl11(spark, d):
    return parse_days(A.table(spark, d, "events").select("event_id", F.col("ts").alias("ds")), "ds")


@REG.add("cl12_month_parse", sql="""SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders""")
def cl12(spark, d):
    df = A.table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MMM").alias("month"))
    return parse_months(df, "month")


@REG.add("cl13_merge_duplicate_columns", "ord", """SELECT purchase_id,
  coalesce(CASE WHEN platform = 'BUILDING' THEN NULL ELSE y END, -y) AS amount FROM ord""", rnd="amount")
def cl13(spark, d):
    df = A.revenue_orders(spark, d)
    return clean.merge_duplicate_columns(df.select(
        "purchase_id", F.when(F.col("platform") != "BUILDING", F.col("y")).alias("amount"), (-F.col("y")).alias("amount")))


@REG.add("cl14_enforce_contract", "dirty", f"""SELECT CAST(strptime("Revenue Date", '%m/%d/%Y') AS DATE) AS ds,
  TRY_CAST("Revenue" AS DOUBLE) AS y FROM dirty""", rnd="y")
def cl14(spark, d):
    return clean.enforce_contract(dirty(spark, d).select(F.col("Revenue Date").alias("ds"), F.col("Revenue").alias("y")))


@REG.add("cl15_map_columns", "ord", """SELECT ds, y, platform AS series_id, platform AS category FROM ord""", rnd="y")
def cl15(spark, d):
    return clean.map_columns(A.revenue_orders(spark, d), "ds", "y", "platform")


@REG.add("cl16_timestamp_target_guard", sql="""SELECT quantile_cont(epoch_ns(ts)::DOUBLE, 0.5) / 1e15 AS median_e15,
  avg((epoch_us(ts)::DOUBLE * 1000 = epoch_us(ts)::DOUBLE * 1000)::INT) AS match_ratio,
  CAST(quantile_cont(epoch_ns(ts)::DOUBLE, 0.5) >= 1e14 AS INT) AS looks_like_timestamp FROM events""", rnd="median_e15 match_ratio")
def cl16(spark, d):
    ev = A.table(spark, d, "events").select("ts", (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") * 1000).alias("y"))
    return clean.timestamp_target_facts(ev, "y", "ts").select(
        (F.col("median") / 1e15).alias("median_e15"), "match_ratio", "looks_like_timestamp")


LABEL = "'Platform=' || platform || ' | Affiliate=' || affiliate || ' | Campaign=' || campaign || ' | Ad=' || ad"


@REG.add("cl17_dimension_label", "rev", f"""SELECT {LABEL} AS category, count(*) AS n FROM rev GROUP BY 1""")
def cl17(spark, d):
    rev = A.revenue(spark, d)
    label = S.dimension_label([("Platform", "platform"), ("Affiliate", "affiliate"), ("Campaign", "campaign"), ("Ad", "ad")], "All Sources")
    return rev.groupBy(label.alias("category")).agg(F.count("*").alias("n"))


@REG.add("cl18_compact_label", "rev", f"""SELECT DISTINCT {LABEL} AS category,
  CASE WHEN length(l) <= 26 THEN l ELSE rtrim(substr(l, 1, 25)) || '…' END AS label FROM (
   SELECT *, 'A=' || ad || ' | C=' || campaign || ' | AFF=' || affiliate || ' | P=' || platform AS l FROM rev)""")
def cl18(spark, d):
    return cl17(spark, d).select("category", S.compact_label("category").alias("label"))


@REG.add("cl19_safe_divide", sql="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio,
  CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END AS ratio_or_zero FROM lineitem""", rnd="l_extendedprice ratio ratio_or_zero")
def cl19(spark, d):
    return A.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        S.safe_divide("l_tax", "l_discount").alias("ratio"), S.safe_divide("l_tax", "l_discount", 0.0).alias("ratio_or_zero"))


@REG.add("cl20_cap_outliers_iqr", "ord", """WITH q AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM ord)
  SELECT purchase_id, least(greatest(y, a - 1.5 * (b - a)), b + 1.5 * (b - a)) AS y FROM ord, q""", rnd="y")
def cl20(spark, d):
    return clean.cap_outliers(A.revenue_orders(spark, d).select("purchase_id", "y"))


@REG.add("cl21_winsorise", "dm", """WITH q AS (SELECT quantile_cont(leads, 0.995) AS l, quantile_cont(cost, 0.995) AS c FROM dm)
  SELECT series_id, ds, least(leads, l) AS leads, least(cost, c) AS cost, ln(1 + least(leads, l)) AS leads_log1p,
    ln(1 + least(cost, c)) AS cost_log1p FROM dm, q""", rnd="leads cost leads_log1p cost_log1p")
def cl21(spark, d):
    from catalog.frames import daily_model

    return clean.stabilize_regressors(daily_model(spark, d).select("series_id", "ds", "leads", "cost"))


ADJ = [clean.Adjustment("1996-03-01", "1996-03-20", outage=True),
       clean.Adjustment("1996-11-20", "1996-12-05", promo=True),
       clean.Adjustment("1997-01-01", "1997-01-31", exclude=True)]


@REG.add("cl22_manual_adjustments", "ord", """SELECT ds, purchase_id,
  CAST(ds BETWEEN DATE '1996-03-01' AND DATE '1996-03-20' AS INT) AS outage_flag,
  CAST(ds BETWEEN DATE '1996-11-20' AND DATE '1996-12-05' AS INT) AS promo_flag, 0 AS holiday_flag
  FROM ord WHERE NOT ds BETWEEN DATE '1997-01-01' AND DATE '1997-01-31'""")
def cl22(spark, d):
    return clean.apply_adjustments(A.revenue_orders(spark, d).select("ds", "purchase_id"), ADJ)


@REG.add("cl23_training_window", "ord", """SELECT ds, purchase_id FROM ord
  WHERE ds >= (SELECT max(ds) FROM ord) - 179""")
def cl23(spark, d):
    return clean.training_window(A.revenue_orders(spark, d).select("ds", "purchase_id"), "last_180_days")


@REG.add("cl23_training_window_presets", "ord", """WITH p(mode, span) AS (VALUES ('all_history', 1000000), ('last_90_days', 90),
   ('last_180_days', 180), ('last_365_days', 365)), m AS (SELECT max(ds) AS last FROM ord)
  SELECT mode, min(ds) AS used_start, max(ds) AS used_end, count(*) AS rows, CAST(count(*) >= 60 AS INT) AS enough
  FROM ord, p, m WHERE last - ds < span GROUP BY 1""")
def cl23_presets(spark, d):
    return clean.training_window_presets(A.revenue_orders(spark, d))


@REG.add("cl24_period_labels", "ord", """SELECT DISTINCT ds, strftime(ds, '%Y-%m') AS month, 'Week of ' || strftime(ds, '%Y-%m-%d') AS week,
  strftime(ds, '%Y-%m-%d') AS day, strftime(ds, '%Y-%b') AS cohort_month FROM ord""")
def cl24(spark, d):
    days = A.revenue_orders(spark, d).select("ds").distinct()
    return days.select("ds", S.period_label("ds", "M").alias("month"), S.period_label("ds", "W").alias("week"),
                       S.period_label("ds", "D").alias("day"), S.month_label("ds").alias("cohort_month"))
