from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from revcast.functions import scalars as S
from revcast.functions.dates import detect_date_format, parse_days
from revcast.functions.quantiles import exact_quantiles, exact_quantiles_of
from revcast.operators import clean
from revcast.schema import ContractError

from conftest import rows


def test_money_strings(spark):
    texts = ["$1,234.50", "(123)", "-", "n/a", " 7 ", "($1,000.25)", "1e3", "12d", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(S.parse_money("t").alias("v"))
    assert [r[0] for r in rows(df)] == [1234.5, -123.0, None, None, 7.0, -1000.25, 1000.0, None, None, None]


def test_null_tokens_keep_other_text(spark):
    df = spark.createDataFrame([(" NULL ",), ("--",), ("x ",), ("NaN",)], "t string").select(S.null_tokens("t"))
    assert [r[0] for r in rows(df)] == [None, None, "x ", None]


@pytest.mark.parametrize(
    "texts, expected",
    [
        (["2026-Jan", "2026-feb"], dt.date(2026, 1, 1)),
        (["Jan-2026", "Feb-2026"], dt.date(2026, 1, 1)),
        (["January-2026", "February-2026"], dt.date(2026, 1, 1)),
        (["2026-1", "2026-02"], dt.date(2026, 1, 1)),
        (["2026/01", "2026/2"], dt.date(2026, 1, 1)),
        (["202601", "202602"], dt.date(2026, 1, 1)),
        (["2026-01-05", "2026-1-6"], dt.date(2026, 1, 5)),
        (["2026/1/5", "2026/01/06"], dt.date(2026, 1, 5)),
        (["1/5/2026", "12/31/2026"], dt.date(2026, 1, 5)),
        (["1-5-2026", "12-31-2026"], dt.date(2026, 1, 5)),
        (["31/12/2026", "30/12/2026"], dt.date(2026, 12, 31)),
        (["31-12-2026", "30-12-2026"], dt.date(2026, 12, 31)),
        (["5-Jan-2026", "06-Feb-2026"], dt.date(2026, 1, 5)),
        (["5-January-2026", "6-February-2026"], dt.date(2026, 1, 5)),
        (["46027", "46028"], dt.date(2026, 1, 5)),
        (["1767571200", "1767657600"], dt.date(2026, 1, 5)),
        (["1767571200000", "1767657600000"], dt.date(2026, 1, 5)),
        (["1767571200000000000", "1767657600000000000"], dt.date(2026, 1, 5)),
        (["2026-01-05 10:30:00", "2026-01-06T00:00:00"], dt.date(2026, 1, 5)),
        (["20260105", "20260106"], dt.date(2026, 1, 5)),
    ],
)
def test_date_formats(spark, texts, expected):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows(parse_days(df, "t"))[0][0] == expected


def test_few_bad_dates_do_not_change_the_format(spark):
    df = spark.createDataFrame([("1/5/2026",)] * 19 + [("soon",)], "t string")
    assert detect_date_format(df, "t").pattern == "M/d/yyyy"
    assert rows(parse_days(df, "t"))[-1][0] is None


def test_exact_quantiles_equal_numpy(spark):
    rng = random.Random(3)
    values = [round(rng.gauss(0, 50), 1) for _ in range(4000)] + [7.0] * 3000
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.995, 1.0]
    got = rows(exact_quantiles(df, "v", probs, slices=16))[0]
    assert np.allclose(got, np.quantile(values, probs))


def test_quantiles_of_several_columns_and_tiny_input(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (4.0, None)], "a double, b double")
    got = {r[0]: r[1] for r in rows(exact_quantiles_of(df, ["a", "b"], [0.5]))}
    assert got == {"a": 2.0, "b": 5.0}


def test_merge_duplicate_columns_prefers_numbers(spark):
    df = spark.createDataFrame([("x", "5"), (None, "y"), ("7", "8")], "a string, b string").select(
        F.col("a").alias("v"), F.col("b").alias("v")
    )
    assert [r[0] for r in rows(clean.merge_duplicate_columns(df))] == ["5", "y", "7"]


def test_unparsable_numbers_stay_text(spark):
    df = spark.createDataFrame([("a", "$5"), ("b", "x")], "k string, v string")
    out = clean.parse_numeric_columns(df, ["k", "v"])
    assert dict(out.dtypes) == {"k": "string", "v": "double"}


def test_fixes_and_audit(spark):
    data = [(" 1/5/2026", "$10"), ("1/6/2026", "n/a"), ("1/6/2026", "n/a"), (" ", "-"), ("1/9/2026", "(3)")]
    df = spark.createDataFrame(data, ["Day ", "Amount"])
    spec = clean.FixSpec(("Day",), ("Amount",))
    out = rows(clean.apply_fixes(df, spec, "2026-01-08").orderBy("Day"))
    assert out == [(dt.date(2026, 1, 5), 10.0), (dt.date(2026, 1, 6), None)]
    audit = clean.fix_audit(df, spec, "2026-01-08").first()
    assert (audit.rows_before, audit.rows_after, audit.blank_rows_removed, audit.duplicate_rows_removed) == (5, 2, 1, 1)
    assert (audit.future_rows_removed, audit.values_replaced, audit.numbers_parsed) == (1, 4, 2)


def test_timestamp_target_is_rejected(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 5), 1.7675712e18)], "ds timestamp, y double")
    with pytest.raises(ContractError):
        clean.reject_timestamp_target(df, "y", "ds")


def test_labels(spark):
    df = spark.createDataFrame([(" Meta ", None)], "p string, c string")
    label = S.dimension_label([("Platform", "p"), ("Campaign", "c")], "none")
    assert rows(df.select(label))[0][0] == "Platform=Meta | Campaign=Unknown"
    short = df.select(S.compact_label(F.lit("Platform=Meta | Affiliate=AFF-9 | Ad=b")))
    assert rows(short)[0][0] == "A=b | AFF=9 | P=Meta"
    assert rows(df.select(S.compact_label(F.lit(" "))))[0][0] == "Unknown"


def test_adjustments_flag_and_exclude(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, i), i) for i in range(1, 6)], "ds date, y int")
    out = clean.apply_adjustments(
        df, [clean.Adjustment("2026-01-02", "2026-01-03", promo=True), clean.Adjustment("2026-01-05", "2026-01-05", exclude=True)]
    )
    assert [(r.y, r.promo_flag) for r in out.orderBy("ds").collect()] == [(1, 0), (2, 1), (3, 1), (4, 0)]
