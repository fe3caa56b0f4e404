"""Model-based layers: explanations, rankings, lead and user scores, response and scenario simulation.

Fitted models see daily or monthly tables, never raw rows, and each is fitted
once and handed on to the layers that need it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revcast.functions.frames import by_series, first_rows, newest_first, rolling
from revcast.functions.quantiles import exact_quantiles, median_of
from revcast.functions.ranking import running, shared_rank
from revcast.functions.scalars import clip, dimension_value, safe_divide
from revcast.operators import heldout
from revcast.session import cut

SEED = 42


@dataclass(frozen=True)
class ModelSize:
    """Rounds, depth and rate of the boosted models; the small one suits tests and many runs."""

    rounds: int = 120
    depth: int = 4
    rate: float = 0.05


FULL, SMALL = ModelSize(), ModelSize(10, 3, 0.2)


# ---- month frames -------------------------------------------------------------------------------


def dimension_months(table: DataFrame, dims: Sequence[str] = ("platform", "affiliate", "campaign")) -> DataFrame:
    """Month x value of each dimension: revenue, leads, cost, what came before and after.

    Rows are combined per month and combination of dimensions before they are
    unpivoted, so the unpivot runs on the reduced table.
    """
    present = [d for d in dims if d in table.columns]
    values = [c for c in ("y", "leads", "cost") if c in table.columns]
    month = F.trunc("ds", "MM").alias("month")
    reduced = table.filter("ds IS NOT NULL").groupBy(month, *[dimension_value(d).alias(d) for d in present]).agg(
        *[F.sum(v).alias(v) for v in values]
    )
    cells = F.array(*[F.struct(F.lit(d).alias("dimension_type"), F.col(d).alias("dimension")) for d in present])
    long = reduced.select("month", *values, F.explode(cells).alias("c")).select("month", *values, "c.*").filter("dimension IS NOT NULL")
    out = long.groupBy("dimension_type", "dimension", "month").agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in values])
    w = by_series("dimension_type", "dimension", order="month")
    extra = {
        "revenue_lag_1": F.lag("y").over(w),
        "revenue_3m_avg": F.avg("y").over(w.rowsBetween(-3, -1)),
        "next_revenue": F.lead("y").over(w),
    }
    if "cost" in values:
        extra["roas_calc"] = safe_divide("y", "cost")
    if "leads" in values:
        extra["rpl_calc"] = safe_divide("y", "leads")
    return out.select("*", *[c.alias(n) for n, c in extra.items()])


MONTH_FEATURES = ("y", "leads", "cost", "revenue_lag_1", "revenue_3m_avg", "roas_calc", "rpl_calc")


def _features(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def _stages(names: list[str], estimator) -> list:
    filled = [f"_{n}" for n in names]
    return [
        Imputer(strategy="median", inputCols=names, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep"),
        estimator,
    ]


def latest_month(frame: DataFrame) -> DataFrame:
    w = Window.partitionBy("dimension_type", "dimension").orderBy(F.desc("month"))
    return frame.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


# ---- opportunity ranking ------------------------------------------------------------------------


def rank_labels(frame: DataFrame) -> DataFrame:
    """Five classes of next month's revenue within each month, 0 the lowest."""
    month = Window.partitionBy("month")
    known = frame.filter("next_revenue IS NOT NULL")
    place = F.row_number().over(month.orderBy("next_revenue", "dimension_type", "dimension"))
    flat = F.min("next_revenue").over(month) == F.max("next_revenue").over(month)
    label = F.when(flat, 0.0).otherwise(F.least(F.lit(4.0), F.floor(place / F.count("*").over(month) * 5).cast("double")))
    return known.withColumn("label", label)


def _recommendation(rank_pct: Column, risk: Column) -> Column:
    return F.when((rank_pct <= 0.2) & (risk <= 0.55), "scale").when(rank_pct <= 0.45, "test").when(risk >= 0.75, "caution").otherwise("monitor")


def risk_scores(frame: DataFrame) -> DataFrame:
    """Volatility of revenue against its latest level, from 0 to 1."""
    spread = frame.groupBy("dimension_type", "dimension").agg(F.stddev_pop("y").alias("volatility"))
    now = latest_month(frame).select("dimension_type", "dimension", "y")
    risk = F.coalesce(clip(safe_divide(F.coalesce("volatility", F.lit(0.0)), F.abs("y")), 0.0, 2.0), F.lit(0.0)) / 2
    return spread.join(now, ["dimension_type", "dimension"]).select("dimension_type", "dimension", "volatility", risk.alias("risk_score"))


def opportunity_ranking(frame: DataFrame, size: ModelSize = FULL) -> tuple[DataFrame, PipelineModel]:
    """(ranked latest month per dimension value, model); ``heldout_ranking`` tells how good such rankings are."""
    names = _features(frame, MONTH_FEATURES)
    train = rank_labels(frame).na.drop(subset=names)
    gbt = GBTRegressor(featuresCol="features", labelCol="label", maxIter=size.rounds, maxDepth=size.depth, stepSize=size.rate, seed=SEED)
    model = Pipeline(stages=_stages(names, gbt)).fit(train)
    scored = model.transform(latest_month(frame)).join(risk_scores(frame), ["dimension_type", "dimension"])
    scored = scored.select("dimension_type", "dimension", "prediction", "risk_score", *names)
    scored = running(scored, [F.desc("prediction"), F.col("dimension")], ["dimension_type"])
    scored = scored.withColumn("rank", (F.col("before") + 1).cast("int")).withColumn("rank_pct", F.col("rank") / F.col("whole"))
    ranked = scored.select(
        "dimension_type", "dimension", "rank", F.col("prediction").alias("ranking_score"), "rank_pct",
        _recommendation(F.col("rank_pct"), F.col("risk_score")).alias("recommendation"), *names, "risk_score",
    )
    return ranked, model


def known_by(frame: DataFrame) -> DataFrame:
    """Add ``next_month``: when the outcome of a row becomes known."""
    return frame.withColumn("next_month", F.lead("month").over(by_series("dimension_type", "dimension", order="month")))


def heldout_ranking(frame: DataFrame, folds: int = 3, size: ModelSize = FULL) -> DataFrame:
    """Stored scores (fold, dimension_type, dimension, label, prediction) of the ranking at the latest months with an outcome.

    The model of a month is fitted on rows whose outcome lies in that month or before it, with classes worked out on those rows
    alone.  A month without such rows is left out.
    """
    names = _features(frame, MONTH_FEATURES)
    dated = cut(known_by(frame))
    gbt = GBTRegressor(featuresCol="features", labelCol="label", maxIter=size.rounds, maxDepth=size.depth, stepSize=size.rate, seed=SEED)
    columns = ["dimension_type", "dimension", "label", "prediction"]

    def scored(month):
        train = rank_labels(dated.filter(F.col("next_month") <= F.lit(month))).na.drop(subset=names)
        rows = rank_labels(dated.filter(F.col("month") == F.lit(month)))
        if train.isEmpty():
            return rows.withColumn("prediction", F.lit(0.0)).select(F.lit(month).alias("fold"), *columns).limit(0)
        return cut(Pipeline(stages=_stages(names, gbt)).fit(train).transform(rows).select(F.lit(month).alias("fold"), *columns))

    months = heldout.origins(dated.filter("next_revenue IS NOT NULL"), "month", folds)
    return heldout.union_all(heldout.side_by_side([lambda m=m: scored(m) for m in months]))


# ---- classifiers --------------------------------------------------------------------------------


def fit_classifier(train: DataFrame, names: list[str], target: str, size: ModelSize = FULL) -> PipelineModel | None:
    """Boosted classifier, or None when only one class occurs."""
    classes = train.agg(F.min(target).alias("a"), F.max(target).alias("b")).first()
    if classes["a"] is None or classes["a"] == classes["b"]:
        return None
    gbt = GBTClassifier(
        featuresCol="features", labelCol=target, predictionCol=f"{target}_pred", maxIter=size.rounds, maxDepth=size.depth,
        stepSize=size.rate, seed=SEED,
    )
    gbt = gbt.setProbabilityCol(f"{target}_prob").setRawPredictionCol(f"{target}_raw")
    return Pipeline(stages=_stages(names, gbt)).fit(train)


def add_probability(df: DataFrame, model: PipelineModel | None, target: str, name: str, fallback: Column) -> DataFrame:
    if model is None:
        return df.withColumn(name, fallback)
    keep = df.columns
    return model.transform(df).withColumn(name, vector_to_array(f"{target}_prob")[1]).select(*keep, name)


def heldout_probabilities(train: DataFrame, rows: DataFrame, names: list[str], target: str, ids: Sequence[str], size: ModelSize = FULL) -> DataFrame:
    """(ids, target, label, probability) of rows that the classifier was not fitted on; the share of the class where it met only one."""
    share = train.agg(F.avg(target)).first()[0]
    out = add_probability(rows, fit_classifier(train, names, target, size), target, "probability", F.lit(share).cast("double"))
    return out.select(*ids, F.lit(target).alias("target"), F.col(target).alias("label"), "probability").filter("probability IS NOT NULL")


def lead_quality_targets(frame: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Known months with: next revenue is positive, next revenue is in the top quarter (of ``frame``, whichever ``rows`` are judged)."""
    known = frame.filter("next_revenue IS NOT NULL")
    q = exact_quantiles(known, "next_revenue", [0.75])
    judged = known if rows is None else rows.filter("next_revenue IS NOT NULL")
    return judged.join(F.broadcast(q), how="left").select(
        *judged.columns, (F.col("next_revenue") > 0).cast("double").alias("conversion_target"),
        (F.col("next_revenue") >= F.col("q0")).cast("double").alias("high_value_target"),
    )


def heldout_lead_quality(frame: DataFrame, folds: int = 3, size: ModelSize = FULL) -> DataFrame:
    """Stored scores (fold, target, dimension_type, dimension, label, probability) at the latest months with an outcome.

    Models and the bound of the top quarter come from rows whose outcome lies in that month or before it.
    """
    names = _features(frame, [n for n in MONTH_FEATURES if n != "y"])
    dated = cut(known_by(frame))

    def scored(month, target):
        past = dated.filter(F.col("next_month") <= F.lit(month))
        train, rows = lead_quality_targets(past), lead_quality_targets(past, dated.filter(F.col("month") == F.lit(month)))
        out = heldout_probabilities(train, rows, names, target, ["dimension_type", "dimension"], size)
        return cut(out.select(F.lit(month).alias("fold"), "*"))

    months = heldout.origins(dated.filter("next_revenue IS NOT NULL"), "month", folds)
    jobs = [lambda m=m, t=t: scored(m, t) for m in months for t in ("conversion_target", "high_value_target")]
    return heldout.union_all(heldout.side_by_side(jobs))


BEHAVIOR_TARGETS = ("cooling_target", "reactivation_target", "drop_target")


def heldout_behavior(table: DataFrame, folds: int = 3, size: ModelSize = FULL, profile: str = "profile_id") -> DataFrame:
    """Stored scores (fold, target, profile_id, label, probability) of the user models at the latest month ends.

    Users are described as they were at a month's end; the model comes from the end of the month before.
    """
    ended = table.select(F.last_day("ds").alias("end"))
    ends = heldout.origins(ended, "end", folds + 1)

    def users_at(end):
        df = behavior_targets(profile_behavior(table.filter(F.col("ds") <= F.lit(end)), profile))
        return cut(df.select(*[F.col(c).cast("double").alias(c) if c in USER_FEATURES else F.col(c) for c in df.columns]))

    at = dict(zip(ends, heldout.side_by_side([lambda e=e: users_at(e) for e in ends])))

    def scored(before, end, target):
        out = heldout_probabilities(at[before], at[end], USER_FEATURES, target, ["profile_id"], size)
        return cut(out.select(F.lit(end).alias("fold"), "*"))

    jobs = [lambda a=a, b=b, t=t: scored(a, b, t) for a, b in zip(ends[:-1], ends[1:]) for t in BEHAVIOR_TARGETS]
    return heldout.union_all(heldout.side_by_side(jobs))


def lead_quality(frame: DataFrame, size: ModelSize = FULL) -> DataFrame:
    """Latest month per dimension value: chances of revenue and of high revenue, bucket and tier."""
    names = _features(frame, [n for n in MONTH_FEATURES if n != "y"])
    train = lead_quality_targets(frame)
    conversion = fit_classifier(train, names, "conversion_target", size)
    value = fit_classifier(train, names, "high_value_target", size)
    none = F.lit(None).cast("double")
    df = add_probability(latest_month(frame), conversion, "conversion_target", "conversion_probability", none)
    df = add_probability(df, value, "high_value_target", "high_value_probability", none)
    df = shared_rank(df.select("dimension_type", "dimension", "y", "conversion_probability", "high_value_probability"), "y", "_level")
    sure = F.coalesce("conversion_probability", "high_value_probability", F.lit(0.0))
    high = F.coalesce("high_value_probability", F.lit(0.0))
    return df.select(
        "dimension_type", "dimension", "conversion_probability", "high_value_probability",
        F.when(sure >= 0.75, "high").when(sure >= 0.45, "medium").otherwise("low").alias("confidence_bucket"),
        F.when((high >= 0.6) | (F.col("_level") >= 0.8), "premium").when((high >= 0.35) | (F.col("_level") >= 0.5), "growth")
        .otherwise("standard").alias("value_tier"),
    )


# ---- explain model ------------------------------------------------------------------------------


def explain_frame(daily: DataFrame) -> DataFrame:
    """Daily series with the inputs of the explain model: helpers of the day, past revenue and yield of leads, calendar."""
    w = by_series()
    extra = {
        "lag_1": F.lag("y", 1).over(w), "lag_7": F.lag("y", 7).over(w), "mean_7": rolling("y", w, 7, "avg", 3),
        "mean_28": rolling("y", w, 28, "avg", 3), "day_of_week": F.weekday("ds").cast("double"),
        "day_of_month": F.dayofmonth("ds").cast("double"), "month_of_year": F.month("ds").cast("double"),
    }
    for c in ("leads", "cost"):
        if c in daily.columns:
            extra[f"{c}_log1p"] = F.log1p(clip(c, 0.0))
    if "leads" in daily.columns:
        month = w.rowsBetween(-28, -1)
        extra["revenue_per_lead"] = safe_divide(F.sum("y").over(month), F.sum("leads").over(month))
    keep = [c for c in ("leads", "cost") if c in daily.columns]
    return daily.filter("y IS NOT NULL").select("series_id", "ds", "y", *keep, *[c.alias(n) for n, c in extra.items()])


def explain_inputs(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c not in ("series_id", "ds", "y")]


@dataclass
class Explained:
    """A fitted revenue model with its inputs and hold-out errors."""

    model: PipelineModel
    names: list[str]
    frame: DataFrame
    metrics: DataFrame


def fit_explain_model(daily: DataFrame, size: ModelSize = FULL, linear: bool = False) -> Explained:
    """Fit on the first 80 % of the days, measure on the rest, then fit on everything."""
    frame = explain_frame(daily)
    names = explain_inputs(frame)
    if linear:
        estimator = LinearRegression(featuresCol="features", labelCol="y", regParam=1.0)
    else:
        estimator = GBTRegressor(featuresCol="features", labelCol="y", maxIter=size.rounds, maxDepth=size.depth, stepSize=size.rate, seed=SEED)
    pipeline = Pipeline(stages=_stages(names, estimator))
    span = frame.agg(F.min("ds").alias("a"), F.max("ds").alias("b")).first()
    split = span["a"] + (span["b"] - span["a"]) * 0.8
    held = pipeline.fit(frame.filter(F.col("ds") <= F.lit(split))).transform(frame.filter(F.col("ds") > F.lit(split)))
    err = F.col("prediction") - F.col("y")
    metrics = held.agg(
        F.count("*").alias("holdout_rows"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (1 - F.try_divide(F.sum(err * err), F.var_pop("y") * F.count("*"))).alias("r2"),
    )
    return Explained(pipeline.fit(frame), names, frame, metrics)


def _filled(e: Explained) -> DataFrame:
    """The frame with missing inputs replaced as the model does it."""
    out = e.model.stages[0].transform(e.frame)
    return out.select("series_id", "ds", "y", *[F.col(f"_{n}").alias(n) for n in e.names])


def contributions(e: Explained) -> DataFrame:
    """Row x input: exact additive share of a linear model's prediction, against the mean input."""
    coefficients = [float(v) for v in e.model.stages[-1].coefficients.toArray()]
    filled = _filled(e)
    means = filled.agg(*[F.avg(n).alias(f"m_{n}") for n in e.names])
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("feature"), ((F.col(n) - F.col(f"m_{n}")) * c).alias("contribution"))
            for n, c in zip(e.names, coefficients)
        ]
    )
    return filled.join(F.broadcast(means), how="left").select("series_id", "ds", "y", F.explode(cells).alias("c")).select("series_id", "ds", "y", "c.*")


def global_explanation(parts: DataFrame, top: int | None = None) -> DataFrame:
    best = parts.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
    best = first_rows(best.orderBy(F.desc("mean_abs_contribution"), "feature"), top)
    total = F.sum("mean_abs_contribution").over(Window.partitionBy(F.lit(1)))
    return best.withColumn("share_pct", F.try_divide("mean_abs_contribution", total) * 100)


def local_explanation(parts: DataFrame, rows: int = 40, top: int = 4) -> DataFrame:
    """The strongest lifts and drags of the latest days of each series."""
    rank = F.dense_rank().over(Window.partitionBy("series_id").orderBy(F.desc("ds")))
    recent = parts.withColumn("_d", rank).filter(F.col("_d") <= rows).withColumn("sign", F.signum("contribution"))
    place = F.row_number().over(Window.partitionBy("series_id", "ds", "sign").orderBy(F.desc(F.abs("contribution")), "feature"))
    return recent.filter("sign <> 0").withColumn("place", place).filter(F.col("place") <= top).select(
        "series_id", "ds", F.when(F.col("sign") > 0, "positive").otherwise("negative").alias("side"), "place", "feature", "contribution"
    )


def explanation_by(parts: DataFrame, key: str) -> DataFrame:
    """Strength and direction of the explanations per series or month (``series_id`` or ``month``)."""
    rows = parts.groupBy("series_id", "ds").agg(F.sum(F.abs("contribution")).alias("strength"), F.sum("contribution").alias("net"))
    name = F.trunc("ds", "MM") if key == "month" else F.col(key)
    return rows.groupBy(name.alias(key)).agg(F.avg("strength").alias("mean_strength"), F.avg("net").alias("mean_net"), F.count("*").alias("days"))


# ---- residual anomalies -------------------------------------------------------------------------


def severity(score: Column) -> Column:
    return F.when(score >= 3.5, "critical").when(score >= 2.5, "notable").when(score >= 1.75, "minor").otherwise("normal")


def residual_anomalies(e: Explained, local: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """The latest days the model misses by much, with the drivers that speak for the miss."""
    scored = e.model.transform(e.frame).select("series_id", "ds", "y", F.col("prediction").alias("predicted_revenue"))
    scored = scored.withColumn("residual", F.col("y") - F.col("predicted_revenue"))
    spread = scored.agg(F.stddev_pop("residual").alias("_sd"))
    scored = scored.join(F.broadcast(spread), how="left").withColumn("anomaly_score", F.abs(safe_divide("residual", "_sd"))).drop("_sd")
    scored = scored.withColumn("severity", severity(F.col("anomaly_score"))).filter("severity <> 'normal'")
    out = first_rows(scored.orderBy(F.desc("ds"), "series_id"), rows)
    if local is None:
        return out.withColumn("likely_drivers", F.lit("mixed model residual"))
    named = local.filter("place <= 3").groupBy("series_id", "ds", "side").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "feature"))), lambda s: s["feature"]), ", ").alias("_names")
    )
    side = F.when(F.col("residual") < 0, "negative").otherwise("positive")
    joined = out.withColumn("side", side).join(named, ["series_id", "ds", "side"], "left")
    return joined.withColumn("likely_drivers", F.coalesce("_names", F.lit("mixed model residual"))).drop("side", "_names")


# ---- users --------------------------------------------------------------------------------------


def profile_behavior(table: DataFrame, profile: str = "profile_id", keep: float = 0.75) -> DataFrame:
    """Profiles of the top quarter by lifetime revenue: level, trend of 60 days, recency, frequency.

    Rows combine to profile and day first; the threshold is an exact quantile
    that works for any number of profiles.
    """
    rows = table.select(dimension_value(profile).alias("profile_id"), "ds", "y").filter("profile_id IS NOT NULL AND ds IS NOT NULL")
    days = rows.groupBy("profile_id", "ds").agg(F.sum("y").alias("y"))
    whole = days.agg(F.max("ds").alias("_last"), F.sum("y").alias("_total"))
    back = F.datediff("_last", "ds")
    zero = F.lit(0.0)
    per = days.join(F.broadcast(whole), how="left").groupBy("profile_id").agg(
        F.coalesce(F.sum("y"), zero).alias("lifetime_revenue"),
        F.coalesce(F.sum(F.when(back <= 60, F.col("y"))), zero).alias("recent_revenue"),
        F.coalesce(F.sum(F.when((back > 60) & (back <= 120), F.col("y"))), zero).alias("prior_revenue"),
        F.min(back).alias("recency_days"),
        F.count("*").alias("purchase_frequency"),
        F.size(F.collect_set(F.trunc("ds", "MM"))).alias("months_active"),
        F.max("_total").alias("_total"),
    )
    trend = (F.col("recent_revenue") - F.col("prior_revenue")) / F.greatest(F.abs("prior_revenue"), F.lit(1.0))
    per = per.withColumn("recent_spend_trend", trend).withColumn("revenue_share", safe_divide("lifetime_revenue", "_total")).drop("_total")
    q = exact_quantiles(per, "lifetime_revenue", [keep])
    return per.join(F.broadcast(q), F.col("lifetime_revenue") >= F.col("q0")).drop("q0")


USER_FEATURES = ["lifetime_revenue", "recent_revenue", "prior_revenue", "recent_spend_trend", "recency_days", "purchase_frequency", "revenue_share", "months_active"]


def behavior_targets(frame: DataFrame) -> DataFrame:
    """Rule targets and the rule label of each profile."""
    t, r = F.col("recent_spend_trend"), F.col("recency_days")
    more_before = F.col("prior_revenue") > F.col("recent_revenue")
    label = (
        F.when((t <= -0.35) | (r >= 60), "at risk")
        .when(t <= -0.12, "cooling")
        .when((t >= 0.25) & (r <= 30), "heating up")
        .when((t > -0.35) & (r <= 45) & more_before, "recoverable")
        .otherwise("stable")
    )
    return frame.select(
        "*", ((t <= -0.15) | (r >= 45)).cast("double").alias("cooling_target"), (more_before & (r <= 90)).cast("double").alias("reactivation_target"),
        (t <= -0.30).cast("double").alias("drop_target"), label.alias("rule_label"),
    )


def whale_prediction(frame: DataFrame, size: ModelSize = FULL) -> DataFrame:
    """Risks per profile by classifier (or by rule where a target has one class), stability and label."""
    df = behavior_targets(frame)
    df = df.select(*[F.col(c).cast("double").alias(c) if c in USER_FEATURES else F.col(c) for c in df.columns])
    scored = df
    for target, name in (("cooling_target", "cooling_risk"), ("reactivation_target", "reactivation_likelihood"), ("drop_target", "revenue_drop_risk")):
        scored = add_probability(scored, fit_classifier(df, USER_FEATURES, target, size), target, name, F.col(target))
    risk = F.greatest("cooling_risk", "revenue_drop_risk")
    label = F.when(risk >= 0.65, "at risk").otherwise(F.col("rule_label"))
    scored = scored.withColumn("_l", label)
    final = F.when((F.col("reactivation_likelihood") >= 0.65) & F.col("_l").isin("at risk", "cooling"), "recoverable").otherwise(F.col("_l"))
    return scored.select(
        "profile_id", final.alias("behavior_label"), "cooling_risk", "reactivation_likelihood", "revenue_drop_risk",
        clip(1 - risk, 0.0, 1.0).alias("stability_score"), "lifetime_revenue", "recent_revenue", "prior_revenue", "recency_days",
        "purchase_frequency", "revenue_share",
    )


# ---- simulation ---------------------------------------------------------------------------------

# Spend multipliers of the response curve and how much leads follow spend.
MULTIPLIERS = (0.70, 0.85, 1.0, 1.10, 1.25, 1.50)
LEADS_FOLLOW = 0.65

# Scenario, multipliers of spend, leads and lead quality.
SIMULATIONS = [
    ("Current baseline", 1.00, 1.00, 1.00),
    ("Spend +10%", 1.10, 1.06, 1.00),
    ("Spend +20% with mix drag", 1.20, 1.08, 0.96),
    ("Lead volume +15%", 1.00, 1.15, 1.02),
    ("Affiliate allocation improvement", 1.05, 1.08, 1.05),
    ("Whale retention lift", 1.00, 1.02, 1.06),
]


def _simulate(e: Explained, cases: list[tuple[str, float, float, float]], rows: int = 30) -> DataFrame:
    """Mean prediction of the latest rows under changed spend, leads and yield of leads, one row per case."""
    latest = newest_first(e.frame, ["series_id"]).filter(F.col("rn_desc") <= rows).drop("rn_desc")
    cells = F.array(*[F.struct(F.lit(n).alias("case"), F.lit(float(s)).alias("sm"), F.lit(float(v)).alias("lm"), F.lit(float(q)).alias("qm")) for n, s, v, q in cases])
    sim = latest.select("*", F.explode(cells).alias("k")).select("*", "k.*").drop("k")
    for c, m in (("cost", "sm"), ("leads", "lm")):
        if c in sim.columns:
            sim = sim.withColumn(c, F.coalesce(c, F.lit(0.0)) * F.col(m)).withColumn(f"{c}_log1p", F.log1p(clip(c, 0.0)))
    if "revenue_per_lead" in sim.columns:
        sim = sim.withColumn("revenue_per_lead", F.coalesce("revenue_per_lead", F.lit(0.0)) * F.col("qm"))
    cost = F.avg("cost") if "cost" in sim.columns else F.lit(None).cast("double")
    return e.model.transform(sim).groupBy("case").agg(
        F.avg(F.greatest("prediction", F.lit(0.0))).alias("projected_revenue"), cost.alias("spend"),
        F.stddev_pop(F.col("y") - F.greatest("prediction", F.lit(0.0))).alias("spread"),
    )


def response_curve(e: Explained) -> DataFrame:
    """Revenue, ROAS and marginal ROAS by change of spend, with zone and label."""
    out = _simulate(e, [(f"{m:.2f}", m, 1 + (m - 1) * LEADS_FOLLOW, 1.0) for m in MULTIPLIERS]).withColumn("multiplier", F.col("case").cast("double"))
    base = out.filter("multiplier = 1.0").select(F.col("projected_revenue").alias("base"), F.col("spend").alias("base_spend"))
    df = out.join(F.broadcast(base), how="left")
    added = F.col("spend") - F.col("base_spend")
    df = df.withColumn("marginal_roas", F.when(F.abs(added) > 1e-9, (F.col("projected_revenue") - F.col("base")) / added))
    df = df.withColumn("projected_roas", F.when(F.col("spend") > 0, F.col("projected_revenue") / F.col("spend")))
    m = F.col("marginal_roas")
    zone = (
        F.when(F.col("multiplier") < 1, F.when(F.col("projected_revenue") >= F.col("base") * 0.9, "efficient zone").otherwise("under-invested"))
        .when(m <= 0.25, "overspend zone")
        .when(m < F.greatest(F.col("projected_roas") * 0.45, F.lit(0.5)), "saturation zone")
        .otherwise("efficient zone")
    )
    df = df.withColumn("zone", zone)
    label = F.when(F.col("zone") == "overspend zone", "overspending").when(F.col("zone") == "saturation zone", "approaching saturation").otherwise("still scalable")
    return df.select(
        ((F.col("multiplier") - 1) * 100).alias("spend_change_pct"), "projected_revenue", "projected_roas", "marginal_roas", "zone", label.alias("business_label")
    )


def scale_headroom(curve: DataFrame) -> DataFrame:
    """One row: largest increase of spend that still scales, and how uneven the curve is."""
    grows = (F.col("business_label") == "still scalable") & (F.col("spend_change_pct") > 0)
    facts = curve.agg(
        F.coalesce(F.max(F.when(grows, F.col("spend_change_pct"))), F.lit(0.0)).alias("scale_headroom_pct"),
        F.max(F.when(F.abs("spend_change_pct") < 1e-9, F.col("projected_revenue"))).alias("current_revenue_baseline"),
        F.stddev_pop("projected_revenue").alias("_sd"),
    )
    return facts.withColumn("risk_label", risk_label(F.col("_sd") / F.greatest("current_revenue_baseline", F.lit(1.0)))).drop("_sd")


def scenario_simulation(e: Explained) -> DataFrame:
    """Projected revenue of each scenario with a band of one residual spread and an interpretation."""
    quality = F.create_map(*[x for n, _, _, q in SIMULATIONS for x in (F.lit(n), F.lit(float(q)))])
    out = _simulate(e, SIMULATIONS)
    base = out.filter(F.col("case") == SIMULATIONS[0][0]).select(F.col("projected_revenue").alias("base"), F.col("spread").alias("sd"))
    p = F.col("projected_revenue")
    return out.join(F.broadcast(base), how="left").select(
        F.col("case").alias("scenario"), p.alias("projected_revenue"), F.when(F.col("spend") > 0, p / F.col("spend")).alias("projected_roas"),
        ((quality[F.col("case")] - 1) * 100).alias("projected_lead_quality_effect"),
        F.greatest(F.lit(0.0), p - F.col("sd")).alias("risk_band_low"), (p + F.col("sd")).alias("risk_band_high"),
        F.when(p > F.col("base") * 1.03, "Upside scenario").when(p < F.col("base") * 0.97, "Downside/neutral scenario").otherwise("Near baseline").alias("interpretation"),
        (p > F.col("base") * 4).cast("int").alias("extreme"),
    )


# ---- affiliates and confidence ------------------------------------------------------------------


def affiliate_quality(frame: DataFrame) -> DataFrame:
    """Score from 0 to 100 out of recent revenue, ROAS, consistency and revenue per lead, with tier and advice."""
    aff = frame.filter("dimension_type = 'affiliate'")
    part = Window.partitionBy("dimension")
    rows = aff.select(
        "dimension", "month", "y", "roas_calc", "rpl_calc", F.row_number().over(part.orderBy(F.desc("month"))).alias("back"),
        F.row_number().over(part.orderBy("month")).alias("idx"), F.count("*").over(part).alias("n"),
    )
    last3 = F.col("back") <= 3
    zero = F.lit(0.0)
    df = rows.groupBy("dimension").agg(
        F.coalesce(F.avg(F.when(last3, F.col("y"))), zero).alias("recent"),
        F.coalesce(F.avg(F.when(F.col("idx") <= F.greatest(F.col("n") - 3, F.lit(1)), F.col("y"))), zero).alias("prior"),
        F.coalesce(F.stddev_pop("y"), zero).alias("volatility"),
        F.coalesce(F.avg(F.when(last3, F.col("roas_calc"))), zero).alias("roas"),
        F.coalesce(F.avg(F.when(last3, F.col("rpl_calc"))), zero).alias("rpl"),
    )
    level = aff.agg(F.coalesce(F.avg("y"), F.lit(1.0)).alias("mean_y"))
    df = df.join(F.broadcast(level), how="left").join(F.broadcast(median_of(aff, "rpl_calc", "mid_rpl")), how="left").fillna(1.0, ["mid_rpl"])
    df = df.withColumn("consistency", F.col("recent") / F.greatest("volatility", F.lit(1.0)))
    df = df.withColumn("trend", (F.col("recent") - F.col("prior")) / F.greatest(F.abs("prior"), F.lit(1.0)))
    score = (
        F.tanh(F.col("recent") / F.greatest("mean_y", F.lit(1.0))) * 35
        + F.tanh("roas") * 25
        + F.tanh(F.col("consistency") / 4) * 25
        + F.tanh(F.col("rpl") / F.greatest("mid_rpl", F.lit(1.0))) * 15
    )
    df = df.withColumn("score", F.greatest(zero, F.least(F.lit(100.0), score)))
    s = F.col("score")
    df = df.withColumn("tier", F.when(s >= 75, "premium").when(s >= 55, "growth").when(s >= 35, "watch").otherwise("weak"))
    brief = (F.col("recent") > F.col("prior") * 1.15) & (F.col("trend") < 0.1) & (F.col("volatility") > F.greatest(F.col("recent") * 0.75, F.lit(1.0)))
    df = df.withColumn("brief", brief)
    advice = (
        F.when((F.col("tier") == "premium") & ~F.col("brief"), "scale")
        .when(F.col("tier") == "growth", "test")
        .when(F.col("brief") | (F.col("tier") == "weak"), "caution")
        .otherwise("monitor")
    )
    return df.select(
        F.col("dimension").alias("affiliate"), s.alias("quality_score"), F.col("tier").alias("quality_tier"), advice.alias("recommendation"),
        F.col("recent").alias("recent_revenue"), (F.col("trend") * 100).alias("trend_pct"), F.col("consistency").alias("consistency_score"),
        F.col("roas").alias("recent_roas"), F.col("rpl").alias("recent_rpl"), F.col("brief").cast("int").alias("short_term_strong_long_term_weak"),
    )


def risk_label(score: Column) -> Column:
    return F.when(score >= 0.7, "high risk").when(score >= 0.4, "moderate risk").otherwise("low risk")


# Surface, risk label and confidence range of the layers without a measure of their own.
LAYER_CONFIDENCE = {
    "ranking": ("rankings", "moderate risk", 0.55, 0.80),
    "simulation": ("simulations", "moderate risk", 0.50, 0.78),
    "returns": ("diminishing returns", "moderate risk", 0.48, 0.76),
}


def confidence_rows(daily: DataFrame, layers: Sequence[str] = (), returns_risk: str | None = None) -> DataFrame:
    """Risk label and confidence range of the revenue model and of the layers that ran."""
    facts = newest_first(daily.filter("y IS NOT NULL"), []).filter("rn_desc <= 30").agg(F.stddev_pop("y").alias("sd"), F.avg("y").alias("m"))
    risk = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("sd") / F.greatest(F.abs("m"), F.lit(1.0)), F.lit(1.0))))
    rows = [
        F.struct(F.lit("forecast / revenue model").alias("surface"), risk_label(risk).alias("risk_label"),
                 F.greatest(F.lit(0.0), 1 - risk - 0.15).alias("confidence_low"), F.greatest(F.lit(0.0), 1 - risk + 0.15).alias("confidence_high"))
    ]
    for layer in layers:
        surface, label, low, high = LAYER_CONFIDENCE[layer]
        if layer == "returns" and returns_risk:
            label = returns_risk
        rows.append(F.struct(F.lit(surface).alias("surface"), F.lit(label).alias("risk_label"), F.lit(low).alias("confidence_low"), F.lit(high).alias("confidence_high")))
    return facts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ---- merging and storing ------------------------------------------------------------------------


def append_new(base: DataFrame, extra: DataFrame, keys: Sequence[str], source: str, top: int | None = None) -> DataFrame:
    """Rows of ``base`` and those of ``extra`` whose key it lacks, marked by source."""
    fresh = extra.join(base.select(*keys).distinct(), list(keys), "left_anti")
    if top is not None:
        fresh = fresh.orderBy(*keys).limit(top)
    return base.withColumn("source", F.lit("history")).unionByName(fresh.withColumn("source", F.lit(source)), allowMissingColumns=True)


def with_user_predictions(users: DataFrame, scores: DataFrame) -> DataFrame:
    """Whale rows beside the predictions for the same profile."""
    cols = ["behavior_label", "cooling_risk", "reactivation_likelihood", "revenue_drop_risk", "stability_score"]
    return users.join(scores.select(F.col("profile_id").alias("whale_id"), *cols), "whale_id", "left")


def save_model(model: PipelineModel, path: str, name: str, names: Sequence[str], metadata: dict | None = None) -> str:
    """Fitted model and one row of metadata beside it."""
    model.write().overwrite().save(f"{path.rstrip('/')}/{name}")
    spark = SparkSession.active()
    row = [(name, ",".join(names), json.dumps(metadata or {}, sort_keys=True))]
    spark.createDataFrame(row, "name string, features string, metadata string").write.mode("overwrite").json(f"{path.rstrip('/')}/{name}_meta")
    return f"{path.rstrip('/')}/{name}"


@dataclass
class Intelligence:
    """Tables of the layers that ran, and why the others did not."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


LAYERS = ("explanations", "ranking", "lead_quality", "anomalies", "whales", "returns", "simulation", "affiliates", "confidence")


def build_intelligence(table: DataFrame, daily: DataFrame, layers: Sequence[str] = LAYERS, size: ModelSize = FULL) -> Intelligence:
    """Run the chosen layers; each one that fails reports its reason and leaves the others alone."""
    out = Intelligence()
    months = dimension_months(table)
    shared: dict[str, object] = {}

    def explained(linear: bool) -> Explained:
        key = "linear" if linear else "tree"
        if key not in shared:
            shared[key] = fit_explain_model(daily, size, linear)
        return shared[key]

    def run_explanations():
        parts = contributions(explained(True))
        out.tables["explanations"] = global_explanation(parts)
        out.tables["local_explanations"] = local_explanation(parts)

    def run_ranking():
        out.tables["ranking"] = opportunity_ranking(months, size)[0]
        out.tables["ranking_quality"] = heldout.ranking_quality(heldout_ranking(months, size=size))

    def run_returns():
        out.tables["returns"] = response_curve(explained(False))
        out.tables["headroom"] = scale_headroom(out.tables["returns"])

    steps = {
        "explanations": run_explanations,
        "ranking": run_ranking,
        "lead_quality": lambda: out.tables.update(lead_quality=lead_quality(months, size)),
        "anomalies": lambda: out.tables.update(anomalies=residual_anomalies(explained(False), out.tables.get("local_explanations"))),
        "whales": lambda: out.tables.update(whales=whale_prediction(profile_behavior(table), size)),
        "returns": run_returns,
        "simulation": lambda: out.tables.update(simulation=scenario_simulation(explained(False))),
        "affiliates": lambda: out.tables.update(affiliates=affiliate_quality(months)),
        "confidence": lambda: out.tables.update(
            confidence=confidence_rows(daily, [n for n in LAYER_CONFIDENCE if n in out.tables])
        ),
    }
    for layer in LAYERS:
        if layer in layers:
            try:
                steps[layer]()
            except Exception as exc:  # noqa: BLE001 - one layer must not stop the others
                out.errors[layer] = str(exc).splitlines()[0]
    return out
