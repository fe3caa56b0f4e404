"""Quantiles and ranks of many values, held against numpy and pandas."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from revcast.functions.quantiles import exact_quantiles, exact_quantiles_of, last_slices, median_of
from revcast.functions.ranking import running, shared_rank
from revcast.operators.planning import attribution
from revcast.operators.stats import efficiency_frontier


def test_quantiles_of_a_million_values_order_a_few(spark):
    df = spark.range(1_000_000, numPartitions=4).select((F.pow(F.pmod(F.xxhash64("id"), F.lit(10_000_019)).cast("double"), 1.5) - 5e9).alias("v"))
    rows, held = last_slices(df, "v", [0.25, 0.5, 0.995], most=5_000)
    assert held.count() <= 6 and 3 <= rows.count() <= 5_000
    got = exact_quantiles(df, "v", [0.25, 0.5, 0.995]).first()
    want = np.quantile(df.toPandas()["v"].to_numpy(), [0.25, 0.5, 0.995])
    assert np.allclose([got.q0, got.q1, got.q2], want, rtol=1e-12)


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 7 + [None, float("nan")], [1.0, 1.0, 2.0, 9.0, 9.0], [-1.5, 0.0, 0.0, 4.0]])
@pytest.mark.parametrize("slices", [3, 64])
def test_quantiles_of_few_values(spark, values, slices):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, "v", probs, slices=slices, most=1 if slices == 3 else 50_000).first()
    known = [v for v in values if v is not None and not np.isnan(v)]
    assert np.allclose(list(got), np.quantile(known, probs))


def test_quantiles_by_column_and_of_nothing(spark):
    df = spark.range(500).select((F.col("id") % 17).alias("a"), F.sqrt("id").alias("b"), F.lit(None).cast("double").alias("c"))
    got = {r["column"]: (r.q0, r.q1) for r in exact_quantiles_of(df, ["a", "b", "c"], [0.3, 0.9]).collect()}
    table = df.toPandas()
    assert set(got) == {"a", "b"}
    assert all(np.allclose(got[c], np.quantile(table[c].to_numpy(float), [0.3, 0.9])) for c in got)
    assert median_of(df, "c", "m").count() == 0


def test_running_sums_of_many_rows(spark):
    df = spark.range(200_000, numPartitions=4).select(F.concat(F.lit("k"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("string")).alias("k"), F.xxhash64("id").alias("v"), (F.col("id") % 5).alias("w"))
    got = running(df, ["v"], ["k"], "w", parts=16)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    table = got.toPandas().sort_values(["k", "v"])
    want = table.groupby("k")["w"].cumsum() - table["w"]
    assert (table["before"] == want).all() and (table["whole"] == table.groupby("k")["w"].transform("sum")).all() and len(sizes) >= 1


def test_shared_ranks_with_a_very_common_value(spark):
    df = spark.range(200_000, numPartitions=4).select("id", F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 1000 == 1, None).otherwise((F.col("id") % 40_000).cast("double")).alias("v"))
    table = shared_rank(df, "v", "share").toPandas()
    want = table["v"].rank(method="average", na_option="top", pct=True)
    assert np.allclose(table["share"], want) and len(table) == 200_000


def test_frontier_and_attribution_of_many_categories(spark):
    seg = spark.range(200_000, numPartitions=4).select(F.col("id").cast("string").alias("segment"), (F.col("id") % 977).cast("double").alias("revenue"), F.lit(10.0).alias("cost"))
    out = efficiency_frontier(seg).toPandas()
    assert len(out) == 200_000 and np.allclose(out["efficiency_score"], out["roas"].rank(method="average", pct=True))
    summary = spark.range(50_000).select(F.col("id").cast("string").alias("category"), (F.col("id") * 7919 % 50_021).cast("double").alias("total_revenue"), *[F.lit(1.0).alias(c) for c in ("share_of_revenue", "roas", "recent_roas", "rev_per_lead", "total_cost", "recent_revenue", "recent_cost", "stability_score")])
    ranked = attribution(summary).select("rank", "channel").collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 50_001))
