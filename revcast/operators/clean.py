"""Cleaning and typing: every step maps a DataFrame to a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revcast.functions.dates import detect_date_format, parse_days
from revcast.functions.quantiles import exact_quantiles, exact_quantiles_of
from revcast.functions.scalars import clip, dimension_value, null_tokens, parse_money, to_number
from revcast.mapping import Mapping
from revcast.schema import COMPANY, ContractError, require, string_columns


def _q(name: str):
    return F.col(f"`{name}`")


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def standardize_nulls(df: DataFrame) -> DataFrame:
    texts = set(string_columns(df))
    return df.select(*[null_tokens(_q(c)).alias(c) if c in texts else _q(c) for c in df.columns])


def drop_blank_rows(df: DataFrame) -> DataFrame:
    return df.na.drop(how="all")


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def parse_numeric_columns(df: DataFrame, columns: Sequence[str], judge: DataFrame | None = None) -> DataFrame:
    """Money text to doubles; a column in which nothing survives stays text.

    ``judge`` is the table that decides, if another one holds the same values
    and is cheaper to read.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    kept = (df if judge is None else judge).agg(
        *[F.count(_q(c)).alias(f"before_{i}") for i, c in enumerate(columns)],
        *[F.count(parse_money(_q(c))).alias(f"after_{i}") for i, c in enumerate(columns)],
    ).first()
    good = {
        c
        for i, c in enumerate(columns)
        if kept[f"after_{i}"] > 0 or kept[f"after_{i}"] >= 0.5 * kept[f"before_{i}"]
    }
    return df.select(*[parse_money(_q(c)).alias(c) if c in good else _q(c) for c in df.columns])


def trim_dimensions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wanted = set(columns) & set(string_columns(df))
    return df.select(*[dimension_value(_q(c)).alias(c) if c in wanted else _q(c) for c in df.columns])


def drop_future_dates(df: DataFrame, column: str, as_of: str) -> DataFrame:
    """Rows up to ``as_of``; dates nobody could parse are kept."""
    return df.filter(_q(column).isNull() | (_q(column) <= F.lit(as_of).cast("date")))


@dataclass(frozen=True)
class FixSpec:
    """Columns of one source by type, merged over all roles that read it."""

    dates: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = ()

    @classmethod
    def of(cls, *mappings: Mapping) -> FixSpec:
        def unique(values):
            return tuple(dict.fromkeys(values))

        return cls(
            unique(m.date for m in mappings),
            unique(v for m in mappings for v in m.values),
            unique(c for m in mappings for c in m.dimension_columns()),
        )


def apply_fixes(df: DataFrame, spec: FixSpec, as_of: str) -> DataFrame:
    """The safe fixes in order: headers, null tokens, blank rows, duplicates, numbers, labels, dates."""
    # types are judged on the projection, before anything is shuffled
    raw = standardize_nulls(trim_headers(df))
    formats = {c: detect_date_format(raw, c) for c in spec.dates if c in raw.columns}
    out = drop_duplicate_rows(drop_blank_rows(raw))
    out = trim_dimensions(parse_numeric_columns(out, spec.numbers, judge=raw), spec.dimensions)
    for c, fmt in formats.items():
        out = drop_future_dates(out.withColumn(c, F.to_date(fmt.parse(_q(c)))), c, as_of)
    return out


def fix_audit(df: DataFrame, spec: FixSpec, as_of: str) -> DataFrame:
    """One row: what the fixes change. Counts of each step come from one pass over its input."""
    raw = trim_headers(df)
    texts = string_columns(raw)
    nulls = standardize_nulls(raw)
    changed = sum((F.when(_q(c).isNotNull() & null_tokens(_q(c)).isNull(), 1).otherwise(0) for c in texts), F.lit(0))
    blank = F.coalesce(*[null_tokens(_q(c)) if c in texts else _q(c).cast("string") for c in raw.columns]).isNull()
    before = raw.agg(
        F.count("*").alias("rows_before"),
        F.sum(changed).cast("long").alias("values_replaced"),
        F.count(F.when(blank, 1)).alias("blank_rows_removed"),
    )
    unique = drop_duplicate_rows(drop_blank_rows(nulls))
    parsed = [parse_money(_q(c)) for c in spec.numbers if c in unique.columns]
    future = F.lit(False)
    for c in spec.dates:
        if c in unique.columns:
            day = F.to_date(detect_date_format(unique, c).parse(_q(c)))
            future = future | F.coalesce(day > F.lit(as_of).cast("date"), F.lit(False))
    after = unique.agg(
        F.count("*").alias("rows_unique"),
        F.count(F.when(future, 1)).alias("future_rows_removed"),
        F.sum(sum((p.isNotNull().cast("int") for p in parsed), F.lit(0))).cast("long").alias("numbers_parsed"),
    )
    return before.crossJoin(F.broadcast(after)).select(
        "rows_before",
        (F.col("rows_unique") - F.col("future_rows_removed")).alias("rows_after"),
        "values_replaced",
        "blank_rows_removed",
        (F.col("rows_before") - F.col("blank_rows_removed") - F.col("rows_unique")).alias("duplicate_rows_removed"),
        "future_rows_removed",
        "numbers_parsed",
        F.aggregate(
            F.array("values_replaced", "blank_rows_removed",
                    F.col("rows_before") - F.col("blank_rows_removed") - F.col("rows_unique"),
                    "future_rows_removed", "numbers_parsed"),
            F.lit(0),
            lambda acc, n: acc + (n > 0).cast("int"),
        ).alias("effective_fixes"),
    )


def merge_duplicate_columns(df: DataFrame) -> DataFrame:
    """Columns of the same name become one: first number, else first text, in column order."""
    names = df.columns
    positional = df.toDF(*[f"_{i}" for i in range(len(names))])
    out = []
    for name in dict.fromkeys(names):
        at = [f"_{i}" for i, n in enumerate(names) if n == name]
        if len(at) == 1:
            out.append(F.col(at[0]).alias(name))
            continue
        if all(isinstance(positional.schema[a].dataType, T.NumericType) for a in at):
            out.append(F.coalesce(*[F.col(a).cast("double") for a in at]).alias(name))
            continue
        texts = [F.col(a).cast("string") for a in at]
        out.append(F.coalesce(*[F.when(to_number(t).isNotNull(), t) for t in texts], *texts).alias(name))
    return positional.select(*out)


def enforce_contract(df: DataFrame) -> DataFrame:
    """``ds`` as a day and ``y`` as a number; rows without a day go."""
    require(df, "ds", "y")
    return parse_days(df.withColumn("y", to_number("y")), "ds").filter(F.col("ds").isNotNull())


def map_columns(df: DataFrame, date: str, target: str, category: str | None = None) -> DataFrame:
    """Pick and name the columns of a single-table forecast."""
    require(df, date, target, *([category] if category else []))
    label = F.col(category).cast("string") if category else F.lit(COMPANY)
    return df.select(
        F.to_date(date).alias("ds"), F.col(target).cast("double").alias("y"), label.alias("series_id"), label.alias("category")
    )


def timestamp_target_facts(df: DataFrame, target: str, date: str) -> DataFrame:
    """One row: median of the target, share of values equal to the date in nanoseconds, verdict."""
    number = to_number(target)
    nanos = F.unix_micros(F.col(date).cast("timestamp")).cast("double") * 1000
    matched = df.agg(F.avg((number == nanos).cast("int")).alias("match_ratio"))
    median = exact_quantiles(df.select(number.alias("y")), "y", [0.5]).withColumnRenamed("q0", "median")
    looks = (F.col("median") >= 1e14) & ((F.coalesce("match_ratio", F.lit(1.0)) >= 0.75) | (F.col("median") > 1e17))
    return median.crossJoin(F.broadcast(matched)).withColumn("looks_like_timestamp", looks.cast("int"))


def reject_timestamp_target(df: DataFrame, target: str, date: str) -> DataFrame:
    # one cheap pass: the sketch's median decides as well against a bound of 1e14
    number = to_number(target)
    nanos = F.unix_micros(F.col(date).cast("timestamp")).cast("double") * 1000
    facts = df.agg(F.percentile_approx(number, 0.5).alias("median"), F.avg((number == nanos).cast("int")).alias("match")).first()
    median, match = facts["median"], facts["match"]
    if median is not None and median >= 1e14 and ((1.0 if match is None else match) >= 0.75 or median > 1e17):
        raise ContractError(f"column '{target}' holds timestamps, not amounts")
    return df


def cap_outliers(df: DataFrame, column: str = "y") -> DataFrame:
    """Values bounded to 1.5 inter-quartile ranges around the quartiles."""
    q = exact_quantiles(df, column, [0.25, 0.75])
    spread = (F.col("q1") - F.col("q0")) * 1.5
    capped = clip(column, F.col("q0") - spread, F.col("q1") + spread)
    return df.join(F.broadcast(q), how="left").withColumn(column, capped).drop("q0", "q1")


def winsorise(df: DataFrame, columns: Sequence[str], floors: Sequence[str] = (), upper: float = 0.995) -> DataFrame:
    """Bound columns at an upper quantile; those in ``floors`` also at zero from below."""
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    floored = df
    for c in floors:
        if c in df.columns:
            floored = floored.withColumn(c, clip(c, 0.0))
    q = exact_quantiles_of(floored, columns, [upper])
    wide = q.agg(*[F.max(F.when(F.col("column") == c, F.col("q0"))).alias(f"_hi_{c}") for c in columns])
    out = floored.crossJoin(F.broadcast(wide))
    return out.select(
        *[
            F.when(F.col(f"_hi_{c}").isNull(), F.col(c)).otherwise(clip(c, None, F.col(f"_hi_{c}"))).alias(c)
            if c in columns
            else _q(c)
            for c in df.columns
        ]
    )


def stabilize_regressors(df: DataFrame) -> DataFrame:
    """Winsorised leads, cost, roas, with the logarithm of the first two."""
    out = winsorise(df, ["leads", "cost", "roas"], floors=["leads", "cost"])
    for c in ("leads", "cost"):
        if c in out.columns:
            out = out.withColumn(f"{c}_log1p", F.log1p(clip(c, 0.0)))
    return out.withColumn("roas_log1p", F.col("roas")) if "roas" in out.columns else out


@dataclass(frozen=True)
class Adjustment:
    """A date range the user marked; ``exclude`` takes its rows out of training."""

    start: str
    end: str
    outage: bool = False
    promo: bool = False
    holiday: bool = False
    exclude: bool = False


def apply_adjustments(df: DataFrame, adjustments: Sequence[Adjustment]) -> DataFrame:
    """Raise flags inside the ranges and drop excluded days.

    The ranges are a handful of user rows, so they become predicates that Spark
    can push to the scan instead of a range join.
    """
    def inside(items):
        hit = F.lit(False)
        for a in items:
            hit = hit | F.col("ds").between(F.lit(a.start).cast("date"), F.lit(a.end).cast("date"))
        return hit

    out = df
    for name, chosen in (
        ("outage_flag", [a for a in adjustments if a.outage]),
        ("promo_flag", [a for a in adjustments if a.promo]),
        ("holiday_flag", [a for a in adjustments if a.holiday]),
    ):
        current = F.coalesce(F.col(name).cast("int"), F.lit(0)) if name in df.columns else F.lit(0)
        out = out.withColumn(name, F.when(inside(chosen), F.lit(1)).otherwise(current))
    excluded = [a for a in adjustments if a.exclude]
    return out.filter(~inside(excluded)) if excluded else out


# Length in days of the preset training windows.
WINDOW_DAYS = {"last_90_days": 90, "last_180_days": 180, "last_365_days": 365}


def training_window(df: DataFrame, mode: str = "all_history", start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of the chosen window; presets count back from the last day in the data."""
    out = df
    if mode == "custom_range":
        if start:
            out = out.filter(F.col("ds") >= F.lit(start).cast("date"))
        if end:
            out = out.filter(F.col("ds") <= F.lit(end).cast("date"))
        return out
    if mode not in WINDOW_DAYS:
        return out
    last = df.agg(F.date_sub(F.max("ds"), WINDOW_DAYS[mode] - 1).alias("_from"))
    return out.join(F.broadcast(last), F.col("ds") >= F.col("_from")).drop("_from")


def training_window_presets(df: DataFrame, least_rows: int = 60) -> DataFrame:
    """Every preset with the days it would use and whether they suffice; one pass over the distinct days."""
    days = df.filter(F.col("ds").isNotNull()).groupBy("ds").count()
    last = days.agg(F.max("ds").alias("last"))
    presets = [("all_history", 10**6), *WINDOW_DAYS.items()]
    spread = days.crossJoin(F.broadcast(last)).select(
        "ds",
        "count",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(n).alias("span")) for m, n in presets])
        ).alias("p"),
        "last",
    )
    used = spread.filter(F.datediff("last", "ds") < F.col("p.span"))
    return used.groupBy(F.col("p.mode").alias("mode")).agg(
        F.min("ds").alias("used_start"),
        F.max("ds").alias("used_end"),
        F.sum("count").alias("rows"),
        (F.sum("count") >= least_rows).cast("int").alias("enough"),
    )
