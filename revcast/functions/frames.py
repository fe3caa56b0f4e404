"""Window frames in the terms the analytics use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from revcast.functions.scalars import col


def by_series(*keys: str, order: str = "ds") -> WindowSpec:
    return Window.partitionBy(*(keys or ("series_id",))).orderBy(order)


def newest_first(df: DataFrame, keys: list[str], order: str = "ds", name: str = "rn_desc") -> DataFrame:
    """Number rows from the latest one; keys may be empty for company-level daily frames."""
    spec = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(1))
    return df.withColumn(name, F.row_number().over(spec.orderBy(F.col(order).desc())))


def guarded(value: Column, source: Column, spec: WindowSpec, min_periods: int) -> Column:
    """A frame aggregate that stays null until the frame holds enough values."""
    return F.when(F.count(source).over(spec) >= min_periods, value)


def rolling(c: str | Column, spec: WindowSpec, rows: int, fn: str, min_periods: int | None = None) -> Column:
    """Aggregate of the ``rows`` rows before the current one."""
    source = col(c)
    frame = spec.rowsBetween(-rows, -1)
    value = getattr(F, fn)(source).over(frame)
    return guarded(value, source, frame, rows if min_periods is None else min_periods)


def expanding(c: str | Column, spec: WindowSpec, fn: str, min_periods: int) -> Column:
    source = col(c)
    frame = spec.rowsBetween(Window.unboundedPreceding, -1)
    return guarded(getattr(F, fn)(source).over(frame), source, frame, min_periods)


def first_rows(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows of an ordered frame, all of them without ``n``."""
    return df if n is None else df.limit(n)
