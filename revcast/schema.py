"""Column contracts of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

COMPANY = "company_total"
FLAG_COLUMNS = ("event_flag", "outage_flag", "promo_flag", "holiday_flag")
DIMENSIONS = ("platform", "affiliate", "campaign", "ad", "category")

FORECAST = T.StructType(
    [
        T.StructField("model", T.StringType(), False),
        T.StructField("series_id", T.StringType(), False),
        T.StructField("ds", T.DateType(), False),
        T.StructField("step", T.IntegerType(), False),
        T.StructField("yhat", T.DoubleType()),
        T.StructField("yhat_lower", T.DoubleType()),
        T.StructField("yhat_upper", T.DoubleType()),
    ]
)

COHORT = T.StructType(
    [
        T.StructField("lead_month", T.DateType(), False),
        T.StructField("transaction_month", T.DateType(), False),
        T.StructField("revenue", T.DoubleType()),
        T.StructField("cohort_category", T.StringType(), False),
        T.StructField("cost_match_key", T.StringType(), False),
        T.StructField("cohort_age_month", T.IntegerType(), False),
    ]
)


class ContractError(ValueError):
    """A table lacks the columns an operator needs, or they hold the wrong thing."""


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing required column(s) {missing}; available: {df.columns}")
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
