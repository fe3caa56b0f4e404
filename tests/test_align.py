from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from revcast.mapping import Mapping, merge_keys, pick_column, regressors, suggest_column
from revcast.operators import align
from revcast.plans.model_table import ModelTableBuilder, Source, build_model_table
from revcast.schema import ContractError

from conftest import rows


def day(s):
    return dt.date.fromisoformat(s)


@pytest.mark.parametrize("month, length", [("2026-02-14", 28), ("2024-02-01", 29), ("2026-04-30", 30), ("2026-01-01", 31)])
def test_month_total_spreads_over_its_days(spark, month, length):
    df = spark.createDataFrame([(day(month), 310.0)], "ds date, cost double")
    out = align.spread_periods(df, ["cost"], [], "M")
    assert out.count() == length
    assert abs(out.agg(F.sum("cost")).first()[0] - 310.0) < 1e-9


def test_overlapping_weeks_add_up(spark):
    df = spark.createDataFrame([(day("2026-01-01"), 7.0), (day("2026-01-04"), 14.0)], "ds date, cost double")
    got = {r.ds: r.cost for r in align.spread_periods(df, ["cost"], [], "W").collect()}
    assert got[day("2026-01-01")] == 1.0 and got[day("2026-01-05")] == 3.0 and got[day("2026-01-10")] == 2.0


def test_interpolation_equals_pandas(spark):
    anchors = {"2026-01-03": 10.0, "2026-01-07": 30.0, "2026-01-08": 5.0}
    df = spark.createDataFrame([(day(k), v) for k, v in anchors.items()], "ds date, v double")
    bounds = spark.createDataFrame([(day("2026-01-01"), day("2026-01-10"))], "first_day date, last_day date")
    got = [r.v for r in align.expand_helper(df, ["v"], [], "M", "interpolate", bounds).orderBy("ds").collect()]
    s = pd.Series(list(anchors.values()), index=pd.to_datetime(list(anchors))).reindex(pd.date_range("2026-01-01", "2026-01-10")).interpolate("time")
    assert [None if pd.isna(v) else round(v, 9) for v in s] == [None if v is None else round(v, 9) for v in got]


def test_fill_can_carry_in_an_earlier_anchor(spark):
    df = spark.createDataFrame([(day("2025-12-01"), 4.0)], "ds date, v double")
    bounds = spark.createDataFrame([(day("2026-01-01"), day("2026-01-02"))], "first_day date, last_day date")
    assert [r.v for r in align.expand_helper(df, ["v"], [], "M", "ffill", bounds).collect()] == [None, None]
    assert [r.v for r in align.expand_helper(df, ["v"], [], "M", "ffill", bounds, carry_in=True).collect()] == [4.0, 4.0]


def test_null_keys_do_not_match(spark):
    revenue = spark.createDataFrame([(day("2026-01-01"), "a"), (day("2026-01-01"), None)], "ds date, p string")
    helper = spark.createDataFrame([(day("2026-01-01"), None, 5.0), (day("2026-01-01"), "a", 2.0)], "ds date, p string, v double")
    out = align.left_join_helper(revenue, align.aggregate_helper(helper, ["ds", "p"], ["v"]), ["ds", "p"])
    assert sorted((r.p or "", r.v) for r in out.collect()) == [("", None), ("a", 2.0)]


def test_cost_goes_to_the_bucket_else_to_the_company(spark):
    d1 = day("2026-01-01")
    revenue = spark.createDataFrame([(d1, "a", 1.0), (d1, "a", 2.0), (d1, "b", 3.0)], "ds date, platform string, y double")
    cost = spark.createDataFrame([(d1, "a", 10.0), (d1, "z", 5.0)], "ds date, platform string, cost double")
    got = sorted((r.y, r.cost, r.cost_bucket) for r in align.allocate_cost(revenue, cost, "platform").collect())
    assert got == [(1.0, 5.0, "a"), (2.0, 5.0, "a"), (3.0, 5.0, "company_total")]
    assert [r.cost for r in align.unallocated_cost(revenue, cost).collect()] == []


def test_hot_key_allocation_keeps_the_total(spark):
    revenue = spark.range(3000).select(
        F.lit("2026-01-01").cast("date").alias("ds"), F.when(F.col("id") % 3 != 0, "hot").otherwise(F.col("id").cast("string")).alias("p")
    )
    helper = revenue.select("ds", "p").distinct().withColumn("v", F.lit(6.0))
    out = align.allocate_helper(revenue, helper, ["ds", "p"], ["v"])
    assert out.count() == 3000
    assert abs(out.agg(F.sum("v")).first()[0] - 6.0 * helper.count()) < 1e-6


@pytest.mark.parametrize("dates, cadence", [(["2026-01-01"], "D"), (["2026-01-01"] * 2, "M"), (["2026-01-01", "2026-01-08", "2026-01-15"], "W"), (["2026-01-01", "2026-02-01"], "M"), (["2026-01-01", "2026-01-02"], "D")])
def test_cadence(spark, dates, cadence):
    df = spark.createDataFrame([(day(x),) for x in dates], "ds date")
    assert align.detect_cadence(df) == cadence


def test_resample_equals_pandas(spark):
    days = ["2026-01-01", "2026-01-02", "2026-01-19", "2026-03-02"]
    df = spark.createDataFrame([("s", day(x), float(i + 1)) for i, x in enumerate(days)], "series_id string, ds date, y double")
    s = pd.Series([1.0, 2.0, 3.0, 4.0], index=pd.to_datetime(days))
    for spark_code, pandas_code in (("D", "D"), ("W", "W"), ("M", "ME"), ("MS", "MS")):
        want = s.resample(pandas_code).sum()
        got = align.resample_target(df, spark_code).orderBy("ds").collect()
        assert [(r.ds, r.y) for r in got] == [(i.date(), v) for i, v in want.items()]


def test_ratios_are_not_summed_in_the_rollup(spark):
    d1 = day("2026-01-01")
    df = spark.createDataFrame([(d1, 10.0, 5.0, 2.0, 0), (d1, 20.0, 5.0, 4.0, 1)], "ds date, y double, cost double, roas double, promo_flag int")
    r = align.daily_rollup(df).first()
    assert (r.y, r.cost, r.roas, r.promo_flag, r.series_id) == (30.0, 10.0, 3.0, 1, "company_total")


def test_model_table_from_text_sheets(spark):
    rev = spark.createDataFrame([("1/5/2026", "10", " Meta"), ("1/6/2026", "30", "Meta"), ("1/6/2026", "5", "X")], "Day string, Amount string, Src string")
    cost = spark.createDataFrame([("2026-Jan", "Meta", "62"), ("2026-Feb", "Meta", "28")], "Month string, Platform string, Cost string")
    table = build_model_table(
        Source(rev, Mapping("revenue", "Day", ("Amount",), {"platform": "Src"})),
        cost=Source(cost, Mapping("cost", "Month", ("Cost",), {"platform": "Platform"})),
    )
    got = sorted((r.ds.day, r.y, r.cost, r.category, r.cost_bucket) for r in table.collect())
    assert got == [(5, 10.0, 2.0, "Platform=Meta", "Meta"), (6, 5.0, 1.0, "Platform=X", "company_total"), (6, 30.0, 2.0, "Platform=Meta", "Meta")]


def test_fallback_is_asked_for(spark):
    rev = spark.createDataFrame([(dt.datetime(2026, 1, 5), 1.7675712e18)], "ds timestamp, y double")
    with pytest.raises(ContractError):
        build_model_table(Source(rev, Mapping("revenue", "ds", ("y",))))


def test_mapping_helpers():
    a = Mapping("revenue", "ds", ("y",), {"platform": "p", "campaign": "c"})
    b = Mapping("leads", "ds", ("n",), {"platform": "src", "ad": "x"})
    assert merge_keys(a, b) == [("p", "src")]
    assert pick_column(["Profile_ID"], ["profile_id"]) == "Profile_ID"
    assert suggest_column(["lead id", "Lead Date", "Revenue"], "target") == "Revenue"
    assert regressors({"leads": b, "cost": a}) == ["leads", "cost", "roas"]


def test_top_groups_keeps_whole_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 9.0), ("c", 0.5)], "k string, v double")
    assert sorted(rows(align.top_groups(df, ["k"], F.sum("v"), 2))) == [("a", 1.0), ("a", 2.0), ("b", 9.0)]


@pytest.mark.parametrize("method", ["ffill", "interpolate"])
@pytest.mark.parametrize("carry_in", [False, True])
def test_fills_equal_pandas_and_answer_only_the_days_asked_for(spark, method, carry_in):
    rng = np.random.default_rng(5)
    days = pd.date_range("2025-12-20", "2026-04-20")
    rows = [(str(g), d.date(), None if rng.random() < 0.3 else float(rng.integers(0, 90)), float(rng.integers(0, 9))) for g in range(6) for d in days[rng.random(len(days)) < 0.07 * (g > 0) + 0.01]]
    rows += [(None, day("2026-01-15"), 3.0, 1.0), ("2", None, 5.0, 5.0), ("1", day("2026-02-02"), 2.0, 1.0), ("1", day("2026-02-02"), 4.0, 1.0)]
    helper = spark.createDataFrame(rows, "g string, ds date, v double, w double")
    bounds = spark.createDataFrame([(day("2026-01-01"), day("2026-03-31"))], "first_day date, last_day date")
    want = {}
    frame = pd.DataFrame(rows, columns=["g", "ds", "v", "w"]).dropna(subset=["ds"])
    calendar = pd.date_range("2025-12-20" if carry_in else "2026-01-01", "2026-03-31")
    for g, own in frame.groupby("g", dropna=False):
        own = own.groupby("ds")[["v", "w"]].sum(min_count=1).reindex(calendar.date)
        own.index = calendar
        full = (own.ffill() if method == "ffill" else own.interpolate("time")).loc["2026-01-01":]
        want |= {(None if pd.isna(g) else g, d.date()): tuple(None if pd.isna(x) else round(x, 9) for x in r) for d, r in zip(full.index, full.itertuples(index=False), strict=True)}

    def answers(days=None):
        out = align.expand_helper(helper, ["v", "w"], ["g"], "M", method, bounds, carry_in=carry_in, days=days).collect()
        found = {(r.g, r.ds): tuple(None if x is None else round(x, 9) for x in (r.v, r.w)) for r in out}
        assert len(found) == len(out)
        return found

    assert answers() == want
    some = [day("2026-01-01"), day("2026-02-14"), day("2026-03-31")]
    asked = spark.createDataFrame([(d,) for d in [*some, some[0], None, day("2027-01-01")]], "ds date")
    assert answers(asked) == {k: v for k, v in want.items() if k[1] in some}
    pairs = [("1", some[1]), ("3", some[2]), (None, some[1]), ("nobody", some[0])]
    assert answers(spark.createDataFrame(pairs, "g string, ds date")) == {k: v for k, v in want.items() if k in pairs}


def test_a_filled_helper_in_the_model_table(spark):
    """A monthly cost that is filled: on days with revenue only, and without revenue in a bucket it counts for the company."""
    rev = spark.createDataFrame([(day("2026-01-05"), 1.0, "a"), (day("2026-01-06"), 2.0, "b"), (day("2026-02-10"), 3.0, "a"), (day("2026-02-11"), 4.0, "a")], "ds date, y double, platform string")
    cost = spark.createDataFrame([(day("2026-01-01"), 10.0, "a"), (day("2026-02-01"), 20.0, "a"), (day("2026-02-01"), 7.0, "c"), (day("2026-01-06"), 5.0, "b")], "ds date, cost double, platform string")
    revenue = Source(rev, Mapping("revenue", "ds", ("y",), {"platform": "platform"}))
    helper = Source(cost, Mapping("cost", "ds", ("cost",), {"platform": "platform"}, frequency="M", fill_method="ffill"))
    builder = ModelTableBuilder(revenue, [helper])
    builder.bounds = spark.createDataFrame([(day("2026-01-01"), day("2026-02-28"))], "first_day date, last_day date")
    out = {r.ds: r.cost for r in builder.add_cost(helper).build().collect()}
    assert out == {day("2026-01-05"): 10.0, day("2026-01-06"): 5.0, day("2026-02-10"): 20.0, day("2026-02-11"): 20.0}
    daily = builder._aligned(helper, ["cost"], ["platform"])
    assert {r.ds for r in daily.collect()} == set(out)
