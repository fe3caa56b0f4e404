"""Writing results and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast.functions.frames import first_rows
from pyspark.sql import types as T

from revcast.functions.scalars import finite


def json_ready(df: DataFrame) -> DataFrame:
    """Non-finite numbers as null, dates as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = finite(c)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_cleaned(df: DataFrame, path: str) -> DataFrame:
    """Store a cleaned source and go on from the stored copy, which readers prefer to the raw upload."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def with_totals(df: DataFrame, key: str, values: list[str], label: str = "Total") -> DataFrame:
    """Rows per key and one row with the totals, out of one roll-up."""
    return (
        df.rollup(key)
        .agg(*[F.sum(v).alias(v) for v in values], F.grouping(key).alias("_g"))
        .select(F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col(key).cast("string")).alias(key), *values)
    )


class RunStore:
    """Result tables of forecast runs: one Parquet table per name, partitioned by run.

    Writing a run again replaces only its own partition.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, run_id: str, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            keyed = df.withColumn("run_id", F.lit(run_id))
            keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(self._path(name))

    def register(self, run_id: str, created_at: str, settings: dict[str, str]) -> None:
        """Settings of a run as key/value rows."""
        rows = [(str(k), str(v), created_at) for k, v in settings.items()]
        self.save(run_id, {"settings": self.spark.createDataFrame(rows, "key string, value string, created_at string")})

    def load(self, table: str, run_id: str | None = None) -> DataFrame:
        df = self.spark.read.option("basePath", self._path(table)).parquet(self._path(table))
        return df.filter(F.col("run_id") == run_id) if run_id is not None else df


def list_runs(settings: DataFrame, recent: int | None = None) -> DataFrame:
    """Runs newest first."""
    runs = settings.groupBy("run_id").agg(F.max("created_at").alias("created_at"))
    return first_rows(runs.orderBy(F.desc("created_at"), F.desc("run_id")), recent)


def bundle(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> dict[str, str]:
    """Every result table in a directory of its own."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{root.rstrip('/')}/{name}"
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).csv(paths[name])
        else:
            writer.parquet(paths[name])
    return paths
