"""Reading sources and looking at them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast.functions.frames import first_rows

from revcast.functions.quantiles import exact_quantiles_of
from revcast.functions.scalars import to_number


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; the cleaning step gives types."""
    return spark.read.csv(path, header=True, multiLine=False, escape='"')


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass
class Sources:
    """Paths per role; a cleaned copy wins over the raw upload."""

    spark: SparkSession
    raw: dict[str, str] = field(default_factory=dict)
    cleaned: dict[str, str] = field(default_factory=dict)

    def path(self, role: str) -> str | None:
        return self.cleaned.get(role) or self.raw.get(role)

    def get(self, role: str) -> DataFrame | None:
        path = self.path(role)
        if path is None:
            return None
        return read_csv(self.spark, path) if path.endswith(".csv") else read_parquet(self.spark, path)


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    return df.limit(rows)


# Limits of the two uses, as (least valid share, lowest median, highest median).
TARGET_LIMITS = (0.8, 0.0, 1e14)
HELPER_LIMITS = (0.75, -1.0, 1e12)


def likely_value_columns(
    df: DataFrame, exclude: Sequence[str] = (), limits: tuple[float, float, float] = TARGET_LIMITS, top: int | None = None
) -> DataFrame:
    """Columns that look like amounts: column, valid_ratio, median, score, best first."""
    least, low, high = limits
    columns = [c for c in df.columns if c not in set(exclude)]
    numbers = df.select(*[to_number(F.col(f"`{c}`")).alias(c) for c in columns])
    shares = numbers.agg(
        F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in columns]
    ).select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.try_divide(F.col(f"`{c}`"), F.col("_rows")).alias("valid_ratio"))
                    for c in columns
                ]
            )
        ).alias("e")
    )
    medians = exact_quantiles_of(numbers, columns, [0.5]).withColumnRenamed("q0", "median")
    kept = (
        shares.select("e.*")
        .join(medians, "column")
        .filter((F.col("valid_ratio") >= least) & (F.col("median") > low) & (F.col("median") <= high))
    )
    score = F.col("valid_ratio") * 1000 - F.abs("median")
    return first_rows(kept.withColumn("score", score).orderBy(F.desc("score"), "column"), top)
