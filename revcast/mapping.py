"""Which columns of a source play which part, and how sources are matched."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame

from revcast.functions.scalars import dimension_label

# Mapped dimension -> label in composed names, in label order.
DIMENSION_LABELS = {
    "platform": "Platform",
    "affiliate": "Affiliate",
    "campaign": "Campaign",
    "ad": "Ad",
    "category": "Group",
}

# Word groups that point to the column of a part, and words that rule a column out.
NAME_PATTERNS = {
    "date": (["date", "day", "ds", "month", "time"], []),
    "target": (["revenue", "amount", "sales", "value", "total"], ["id", "date", "cost", "lead"]),
    "leads": (["lead", "count", "signup"], ["id", "date", "month"]),
    "cost": (["cost", "spend"], ["id", "date"]),
    "platform": (["platform", "source", "channel"], []),
    "campaign": (["campaign"], []),
    "affiliate": (["aff", "affiliate", "partner"], []),
    "ad": (["ad name", "ad_name", "adname", "creative"], []),
    "profile": (["profile", "user", "customer", "member"], []),
}


@dataclass(frozen=True)
class Mapping:
    """Columns of one source: date, values and dimensions, and how a coarse helper is spread."""

    role: str
    date: str
    values: tuple[str, ...] = ()
    dimensions: dict[str, str] = field(default_factory=dict)
    frequency: str = "auto"
    fill_method: str = "distribute"

    def dimension_columns(self, df: DataFrame | None = None) -> list[str]:
        names = [self.dimensions[d] for d in DIMENSION_LABELS if d in self.dimensions]
        unique = list(dict.fromkeys(names))
        return [c for c in unique if df is None or c in df.columns]

    def label(self, df: DataFrame, default: str) -> Column:
        used, parts = set(), []
        for dim, text in DIMENSION_LABELS.items():
            c = self.dimensions.get(dim)
            if c and c in df.columns and c not in used:
                used.add(c)
                parts.append((text, c))
        return dimension_label(parts, default)

    def with_columns(self, **changes) -> Mapping:
        return replace(self, **changes)


def pick_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate that exists, whatever its case."""
    by_name = {c.strip().lower(): c for c in columns}
    return next((by_name[c.lower()] for c in candidates if c.lower() in by_name), None)


def suggest_column(columns: Sequence[str], part: str) -> str | None:
    """Best guess for a part by words in the column names."""
    include, exclude = NAME_PATTERNS[part]
    for word in include:
        for c in columns:
            name = c.strip().lower()
            if word in name and not any(x in name for x in exclude):
                return c
    return None


def merge_keys(revenue: Mapping, helper: Mapping) -> list[tuple[str, str]]:
    """Pairs (revenue column, helper column) of the dimensions both sides map."""
    return [
        (revenue.dimensions[d], helper.dimensions[d])
        for d in ("platform", "affiliate", "campaign", "ad", "category")
        if d in revenue.dimensions and d in helper.dimensions
    ]


def cost_bucket(revenue: Mapping, cost: Mapping) -> tuple[str, str] | None:
    """Widest dimension cost is shared out on: platform, then category, then affiliate."""
    for d in ("platform", "category", "affiliate"):
        if d in revenue.dimensions and d in cost.dimensions:
            return revenue.dimensions[d], cost.dimensions[d]
    return None


def regressors(mappings: dict[str, Mapping]) -> list[str]:
    """Regressor columns a set of mapped sources brings into the modeling table."""
    out: list[str] = []
    for role in ("leads", "cost"):
        if role in mappings and mappings[role].values:
            out.append(role)
    if "cost" in out:
        out.append("roas")
    for role, m in mappings.items():
        if role == "events" or role.startswith("custom"):
            out.extend(m.values)
    return list(dict.fromkeys(out))
