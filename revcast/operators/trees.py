"""Tree ensembles on the recipe's features, forecast step by step.

MLlib fits one ensemble per fold, several folds at a time; its nodes are read back from the stored model as arrays, with
which the steps of all series of a batch are worked out together.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revcast.operators import stepping
from revcast.operators.baselines import KEYS
from revcast.operators.features import recipe
from revcast.session import checkpoint_dir, cut

FITS_AT_ONCE = 4


@dataclass(frozen=True)
class TreeSettings:
    """Size of an ensemble; ``trees`` are boosting rounds for the boosted kinds."""

    kind: str
    trees: int
    depth: int
    rate: float = 0.05
    subsample: float = 0.9
    min_leaf: int = 1
    band: float = 0.10
    seed: int = 42

    def estimator(self):
        common = dict(featuresCol="features", labelCol="y", seed=self.seed, maxDepth=self.depth, minInstancesPerNode=self.min_leaf)
        if self.kind == "forest":
            return RandomForestRegressor(numTrees=self.trees, **common)
        return GBTRegressor(maxIter=self.trees, stepSize=self.rate, subsamplingRate=self.subsample, **common)


# Full-size settings, and the small ones for large grids of runs and for tests.
FULL = {
    "gradient_boosting": TreeSettings("boost", 300, 5),
    "gradient_boosting_deep": TreeSettings("boost", 300, 6),
    "random_forest": TreeSettings("forest", 400, 14, min_leaf=2, band=0.13),
}
SMALL = {
    "gradient_boosting": TreeSettings("boost", 20, 4, rate=0.2),
    "gradient_boosting_deep": TreeSettings("boost", 16, 5, rate=0.2),
    "random_forest": TreeSettings("forest", 20, 8, min_leaf=2, band=0.13),
}


@dataclass
class Ensemble:
    """The nodes of all trees in one table of arrays; a leaf is its own child."""

    names: list[str]
    roots: np.ndarray
    weights: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.value[at] @ self.weights


def load_ensemble(spark: SparkSession, path: str, names: list[str]) -> Ensemble:
    """A stored MLlib ensemble as arrays; its size is that of the settings, however many rows it was fitted on."""
    own = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), own["id"].alias("id"), own["prediction"].alias("value"), own["leftChild"].alias("left"), own["rightChild"].alias("right"),
        own["split"]["featureIndex"].alias("feature"), F.get(own["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
    )
    table = nodes.orderBy("tree", "id").toPandas()
    tree, left = table["tree"].to_numpy(), table["left"].to_numpy()
    meta = spark.read.parquet(f"{path}/treesMetadata")
    weights = np.array([r[0] for r in meta.orderBy(meta.columns[0]).select(meta.columns[2]).collect()])
    if spark.read.text(f"{path}/metadata").where(F.col("value").contains("RandomForest")).count():
        weights = np.full(len(weights), 1.0 / len(weights))
    roots = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
    base = roots[tree]
    inner, here = left >= 0, np.arange(len(tree))
    depth = np.zeros(len(tree), dtype=int)
    for k in np.flatnonzero(inner):  # ids are in preorder: a parent comes before its children
        depth[base[k] + left[k]] = depth[base[k] + table["right"].iat[k]] = depth[k] + 1
    return Ensemble(
        names, roots, weights, np.where(inner, table["feature"], 0).astype(np.int32), np.where(inner, table["threshold"], 0.0).astype(float),
        np.where(inner, base + left, here), np.where(inner, base + table["right"].to_numpy(), here), table["value"].to_numpy(float), int(depth.max(initial=0)),
    )


def fit_trees(rows: DataFrame, names: list[str], settings: TreeSettings) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), settings.estimator()]).fit(rows)


def fit_folds(rows: DataFrame, settings: TreeSettings) -> tuple[dict[int, Ensemble], PipelineModel | None]:
    """An ensemble for every fold that has training rows, and the MLlib model of the last one (fold 0 comes last).

    ``rows`` are a stored table.  Each fold is a job chain of its own, so a few run side by side.
    """
    spark, names = rows.sparkSession, [c for c in rows.columns if c not in (*KEYS, "ds", "y")]
    folds = sorted((r["fold"] for r in rows.select("fold").distinct().collect()), key=lambda f: (f == 0, f))
    root = f"{checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"

    def one(fold: int) -> tuple[Ensemble, PipelineModel]:
        model = fit_trees(rows.where(F.col("fold") == fold), names, settings)
        model.stages[-1].write().overwrite().save(f"{root}/{fold}")
        return load_ensemble(spark, f"{root}/{fold}", names), model

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        fitted = dict(zip(folds, pool.map(one, folds)))
    return {f: e for f, (e, _) in fitted.items()}, fitted[folds[-1]][1] if folds else None


def tree_forecast(
    train: DataFrame, folds: list[int], horizon: int, frequency: str = "D", model: str = "gradient_boosting",
    settings: TreeSettings | None = None, future: DataFrame | None = None, lag_profile: str | None = None, rows: DataFrame | None = None,
) -> tuple[DataFrame | None, PipelineModel | None]:
    """Forecasts of the given folds and the model of the last one; (None, None) if no fold has the rows for a fit.

    ``rows`` are the stored ``stepping.model_rows`` of the folds, if they are there already.
    """
    settings = settings or FULL[model]
    r = recipe("random_forest" if settings.kind == "forest" else model, frequency, lag_profile)
    if rows is None:
        rows = cut(stepping.model_rows(train.where(F.col("fold").isin(*folds)), r))
    ensembles, fitted = fit_folds(rows.where(F.col("fold").isin(*folds)), settings)
    if not ensembles:
        return None, None
    path = stepping.forecast(stepping.states(train, r, horizon, future), r, horizon, ensembles)
    return stepping.banded(path, model, settings.band), fitted


def feature_importance(spark, model: PipelineModel, top: int = 15) -> DataFrame:
    """The most used inputs with their share of the importance among those shown."""
    names = model.stages[0].getInputCols()
    values = model.stages[-1].featureImportances.toArray()
    rows = spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")
    best = rows.orderBy(F.desc("importance"), "feature").limit(top)
    total = F.sum("importance").over(Window.partitionBy(F.lit(1)))
    return best.withColumn("share_pct", F.try_divide(F.col("importance"), total) * 100)
