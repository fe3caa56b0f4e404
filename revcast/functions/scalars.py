"""Column expressions: text, numbers, labels. All run inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens that mean "missing", compared trimmed and lower-case.
NULL_TOKENS = ["", "n/a", "na", "null", "none", "-", "--", "nan"]

# Text a dimension column may hold for "missing", compared trimmed.
BLANK_LABELS = ["", "nan", "None", "NaT"]

WHITE_SPACE = " \t\n\r\x0b\x0c"

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(col(c).cast("string"), F.lit(WHITE_SPACE))


def null_tokens(c: str | Column) -> Column:
    """Text that stands for "missing" becomes null; other text stays as it is."""
    return F.when(~F.lower(strip(c)).isin(NULL_TOKENS), col(c))


def dimension_value(c: str | Column) -> Column:
    """Trimmed dimension text, blank-like text as null."""
    text = strip(c)
    return F.when(~text.isin(BLANK_LABELS), text)


def to_number(c: str | Column) -> Column:
    """Double, or null where the text is no plain number."""
    text = strip(c)
    return F.when(text.rlike(_NUMBER), text.cast("double"))


def number_column(df: DataFrame, name: str) -> Column:
    """A column as double; only text goes through the text rules."""
    numeric = isinstance(df.schema[name].dataType, T.NumericType)
    return F.col(f"`{name}`").cast("double") if numeric else to_number(name)


def parse_money(c: str | Column) -> Column:
    """``$1,234.50`` -> 1234.5 and ``(123)`` -> -123; anything else not numeric -> null."""
    text = F.regexp_replace(strip(c), r"[$,]", "")
    return to_number(F.regexp_replace(text, r"\(([^)]+)\)", "-$1"))


def finite(c: str | Column) -> Column:
    """NaN and infinities as null."""
    value = col(c).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def safe_divide(num: str | Column, den: str | Column, default: float | None = None) -> Column:
    """Quotient, or ``default`` where the denominator is null or zero."""
    ratio = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return ratio if default is None else F.coalesce(ratio, F.lit(float(default)))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Correlation aggregate over the pairs without nulls; null where either side is constant."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def clip(c: str | Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Bounded value; null stays null (``greatest`` alone would turn it into the bound)."""
    value = col(c)
    out = value
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(value.isNotNull(), out)


def dimension_label(parts: Iterable[tuple[str, str | Column]], default: str) -> Column:
    """``Platform=x | Affiliate=y``; nulls read ``Unknown``; no parts -> ``default``."""
    pieces = [
        F.concat(F.lit(f"{label}="), F.coalesce(dimension_value(c), F.lit("Unknown"))) for label, c in parts
    ]
    return F.concat_ws(" | ", *pieces) if pieces else F.lit(default)


def compact_label(c: str | Column, max_len: int = 26) -> Column:
    """Short display label out of a composed one: ad, campaign, affiliate, platform."""
    text = strip(F.coalesce(col(c).cast("string"), F.lit("")))

    def part(*names: str) -> Column:
        found = F.lit(None).cast("string")
        for name in names:
            value = strip(F.regexp_extract(text, rf"(?i)(?:^|\|)\s*{name}=([^|]*)", 1))
            found = F.coalesce(found, F.when(value != "", value))
        return found

    def tagged(tag: str, value: Column) -> Column:
        return F.concat(F.lit(tag), value)

    affiliate = F.replace(part("affiliate", "aff_param"), F.lit("AFF-"), F.lit(""))
    joined = F.concat_ws(
        " | ",
        tagged("A=", part("ad", "ad name")),
        tagged("C=", part("campaign")),
        tagged("AFF=", affiliate),
        tagged("P=", part("platform")),
    )
    label = F.when(text == "", F.lit("Unknown")).when(joined == "", text).otherwise(joined)
    shortened = F.concat(F.rtrim(F.substring(label, 1, max_len - 1)), F.lit("…"))
    return F.when(F.length(label) <= max_len, label).otherwise(shortened)


def period_label(c: str | Column, frequency: str) -> Column:
    """Axis text of a period: month, week or day."""
    day = col(c)
    code = frequency.upper()[:1]
    if code == "M":
        return F.date_format(day, "yyyy-MM")
    if code == "W":
        return F.concat(F.lit("Week of "), F.date_format(day, "yyyy-MM-dd"))
    return F.date_format(day, "yyyy-MM-dd")


def month_label(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MMM")
