"""Predictions of a run on shared storage: a part counts once its commit row is written."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "key string, model string, fold int, part string"


def fingerprint(df: DataFrame) -> str:
    """Row count and a sum of row hashes: equal for equal tables whatever the order of rows or columns."""
    columns = sorted(df.columns)
    hashed = F.xxhash64(F.lit("|".join(columns)), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in columns])
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hashed.cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return f"{seen['n']}-{seen['s']}"


class PredictionStore:
    """``put`` writes the rows of one model's folds to a folder of their own, then commits them in another; several may run at once.

    What a failed or lost attempt has written is never read, since no commit row names its folder; a run that starts
    again finds the committed folds and works out the others only.  ``key`` tells runs apart whose data or settings differ.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(COMMIT).parquet(f"{self.root}/commits")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return None
            raise

    def committed(self, key: str) -> dict[tuple[str, int], str]:
        """(model, fold) -> part; of two commits of one cell either is whole, and the smaller name counts."""
        commits = self._commits()
        if commits is None:
            return {}
        rows = commits.where(F.col("key") == key).groupBy("model", "fold").agg(F.min("part").alias("part"))
        return {(r["model"], r["fold"]): r["part"] for r in rows.collect()}

    def put(self, key: str, models: Iterable[str], folds: Iterable[int], df: DataFrame) -> dict[tuple[str, int], str]:
        """Store the rows of ``models`` in ``folds`` and return the cells; one without rows is committed too, as there is nothing to do again."""
        part, models, folds = uuid.uuid4().hex, list(models), list(folds)
        kept = df.where(F.col("model").isin(*models) & F.col("fold").isin(*folds))
        kept.write.partitionBy("model", "fold").parquet(f"{self.root}/parts/{part}")
        cells = [(key, m, f, part) for m in models for f in folds]
        self.spark.createDataFrame(cells, COMMIT).coalesce(1).write.parquet(f"{self.root}/commits/id={part}")
        return {(m, f): part for m in models for f in folds}

    def load(self, cells: dict[tuple[str, int], str], schema: str) -> DataFrame:
        """The rows of the given committed cells."""
        parts = sorted(set(cells.values()))
        frames = [self.spark.read.schema(schema).option("basePath", f"{self.root}/parts/{p}").parquet(f"{self.root}/parts/{p}").withColumn("part", F.lit(p)) for p in parts]
        if not frames:
            return self.spark.createDataFrame([], schema)
        whole = frames[0]
        for frame in frames[1:]:
            whole = whole.unionByName(frame)
        names = self.spark.createDataFrame([(m, f, p) for (m, f), p in cells.items()], "model string, fold int, part string")
        return whole.join(F.broadcast(names), ["model", "fold", "part"], "left_semi").drop("part")
