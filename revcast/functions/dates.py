"""Date parsing that learns a column's format from the column itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revcast.functions.scalars import col, strip, to_number

# Text patterns in the order they are tried. Unpadded numbers are
# accepted, and month names in any case.
TEXT_PATTERNS = [
    "yyyy-MMM",
    "yyyy-MMMM",
    "MMM-yyyy",
    "MMMM-yyyy",
    "yyyy-M",
    "yyyy/M",
    "yyyyMM",
    "yyyy-M-d",
    "yyyy/M/d",
    "M/d/yyyy",
    "M-d-yyyy",
    "d/M/yyyy",
    "d-M-yyyy",
    "d-MMM-yyyy",
    "d-MMMM-yyyy",
]

# Divisor to seconds and least magnitude of each epoch unit, in the order they are tried.
EPOCH_UNITS = {"nanos": (1e9, 1e17), "micros": (1e6, 1e14), "millis": (1e3, 1e11), "seconds": (1.0, 1e8)}

EXCEL_MAX = 100_000.0
_EXCEL_EPOCH_DAYS = 25569  # days from 1899-12-30 to 1970-01-01
_SECONDS_1990, _SECONDS_2101 = 631152000, 4133980800
_SECONDS_LIMIT = 9_223_372_036  # beyond this the instant is out of the supported range
_FALLBACK_PATTERNS = ["yyyyMMdd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "M/d/yy"]


@dataclass(frozen=True)
class DateFormat:
    """How a column's values become timestamps: ``native``, ``excel``, an epoch unit, a pattern or ``generic``."""

    kind: str
    pattern: str | None = None

    def parse(self, c: str | Column) -> Column:
        if self.kind == "native":
            return col(c).cast("timestamp")
        if self.kind == "pattern":
            return F.try_to_timestamp(strip(c), F.lit(self.pattern))
        if self.kind == "generic":
            return _generic(c)
        seconds = _epoch_seconds(c, self.kind)
        return F.when(F.abs(seconds) <= _SECONDS_LIMIT, F.timestamp_micros((seconds * 1_000_000).cast("long")))


def _epoch_seconds(c: str | Column, kind: str) -> Column:
    number = to_number(c)
    if kind == "excel":
        return (number - F.lit(_EXCEL_EPOCH_DAYS)) * 86400
    return number / F.lit(EPOCH_UNITS[kind][0])


def _generic(c: str | Column) -> Column:
    text = strip(c)
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(p)) for p in _FALLBACK_PATTERNS])


def detect_date_format(df: DataFrame, column: str) -> DateFormat:
    """One pass over the column; the answer is a handful of scalars.

    Formats are tried on the distinct values, weighted by their frequency: dates
    repeat, and a failed parse is what costs most here.
    """
    if isinstance(df.schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DateFormat("native")
    values = df.groupBy(F.col(f"`{column}`").cast("string").alias("v")).agg(F.count("*").alias("n"))
    number, text = to_number("v"), strip("v")
    kinds = ["excel", *EPOCH_UNITS]

    def weight(hit: Column) -> Column:
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))

    def sensible(kind: str) -> Column:
        seconds = _epoch_seconds("v", kind)
        parsed = F.when(F.abs(seconds) <= _SECONDS_LIMIT, seconds)
        return F.try_divide(weight(parsed.between(_SECONDS_1990, _SECONDS_2101 - 1)), weight(parsed.isNotNull()))

    facts = values.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.max(F.abs(number)).alias("largest"),
        *[sensible(k).alias(k) for k in kinds],
        *[weight(F.try_to_timestamp(text, F.lit(p)).isNotNull()).alias(f"p{i}") for i, p in enumerate(TEXT_PATTERNS)],
        weight(_generic("v").isNotNull()).alias("generic"),
    ).first()
    return _choose(facts.asDict())


def _choose(facts: dict) -> DateFormat:
    rows, largest = facts["rows"], facts["largest"]
    if largest is not None:
        allowed = {k: largest >= least for k, (_, least) in EPOCH_UNITS.items()} | {"excel": largest <= EXCEL_MAX}
        fits = [k for k in ["excel", *EPOCH_UNITS] if allowed[k] and (facts[k] or 0.0) >= 0.5]
        if fits:
            return DateFormat(max(fits, key=lambda k: facts[k]))
    hits = [facts[f"p{i}"] for i in range(len(TEXT_PATTERNS))]
    for pattern, hit in zip(TEXT_PATTERNS, hits):
        if rows and hit >= 0.9 * rows:
            return DateFormat("pattern", pattern)
    best = max(range(len(hits)), key=lambda i: hits[i])
    if facts["generic"] >= hits[best]:
        return DateFormat("generic")
    return DateFormat("pattern", TEXT_PATTERNS[best])


def parse_dates(df: DataFrame, column: str, into: str | None = None) -> DataFrame:
    """Timestamps by the format the column itself suggests."""
    return df.withColumn(into or column, detect_date_format(df, column).parse(column))


def parse_days(df: DataFrame, column: str, into: str | None = None) -> DataFrame:
    return df.withColumn(into or column, F.to_date(detect_date_format(df, column).parse(column)))


def parse_months(df: DataFrame, column: str, into: str | None = None) -> DataFrame:
    """First day of the month."""
    day = F.to_date(detect_date_format(df, column).parse(column))
    return df.withColumn(into or column, F.trunc(day, "MM"))
