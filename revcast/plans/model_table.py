"""The daily modeling table out of mapped sources."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.functions.dates import parse_days
from revcast.functions.scalars import dimension_value, number_column
from revcast.mapping import Mapping, cost_bucket, merge_keys
from revcast.operators import align, clean
from revcast.schema import COMPANY, ContractError
from revcast.session import cut


@dataclass
class Source:
    frame: DataFrame
    mapping: Mapping


class ModelTableBuilder:
    """Works helpers out on the table of allocation keys, and joins that to revenue once.

    The fact table is read for the counts per allocation key (written to the
    checkpoint folder, as allocation, calendar bounds and cadence all come from
    them) and for the rows; text dates and ``validate`` read it once more each.
    Every helper adds columns to the key table, which has a row per day and
    allocation key.  It is broadcast if its counted rows are few, else the one
    join is a shuffle.
    """

    broadcast_rows = 500_000

    def __init__(self, revenue: Source, helpers: Sequence[Source] = (), validate: bool = True):
        self.revenue = revenue
        self.validate = validate
        m = revenue.mapping
        df = parse_days(revenue.frame, m.date, "ds")
        df = df.withColumn("y", number_column(df, m.values[0]))
        df = df.filter(F.col("ds").isNotNull())
        if validate:
            clean.reject_timestamp_target(df, "y", "ds")
        for c in m.dimension_columns(df):
            df = df.withColumn(c, dimension_value(c))
        if "profile_id" in df.columns:
            df = df.withColumn("profile_id", dimension_value("profile_id"))
        self.table = df
        keys = {left for h in helpers for left, _ in merge_keys(m, h.mapping)}
        grain = ["ds", *sorted(keys & set(df.columns))]
        self.grain = grain
        self.counts = cut(align.key_counts(df, grain)) if helpers else None
        self.keyed = self.counts
        self.bounds = align.day_range(self.counts) if helpers else None

    def _aligned(self, helper: Source, values: Sequence[str], dims: Sequence[str], pairs: Sequence[tuple[str, str]] = ()) -> DataFrame:
        """The helper per day and dimensions; filled only on days (and values of ``pairs``) that the key table has."""
        m = helper.mapping
        df = parse_days(helper.frame, m.date, "ds")
        for v in m.values:
            df = df.withColumn(v, number_column(df, v))
        # one row per date and dimensions, stored: every later step starts from this small table
        df = df.filter(F.col("ds").isNotNull()).groupBy("ds", *[dimension_value(c).alias(c) for c in dims]).agg(
            *[F.sum(v).alias(v) for v in values]
        )
        df = cut(df)
        cadence = align.detect_cadence(df) if m.frequency == "auto" else m.frequency
        if cadence == "D":
            return df.select("ds", *dims, *values)
        if align.COARSENESS[cadence] <= align.COARSENESS[align.detect_cadence(self.counts)]:
            return df.select("ds", *dims, *values)
        if m.fill_method in ("distribute", "avg_monthly"):
            # only days that a period covers; days without cover come back as nulls of the join
            spread = align.spread_periods(df, values, dims, cadence)
            return spread.join(F.broadcast(self.bounds), F.col("ds").between(F.col("first_day"), F.col("last_day"))).drop("first_day", "last_day")
        asked = self.counts.select("ds", *[F.col(left).alias(right) for left, right in pairs if left in self.grain]).distinct()
        return align.expand_helper(df, values, dims, cadence, m.fill_method, self.bounds, days=asked)

    def _renamed(self, df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
        for left, right in pairs:
            df = df.withColumnRenamed(right, left)
        return df

    def add_values(self, helper: Source, values: Sequence[str], allocate: bool) -> ModelTableBuilder:
        """Leads (allocated) or custom regressors (repeated on every row of the key)."""
        pairs = merge_keys(self.revenue.mapping, helper.mapping)
        dims = helper.mapping.dimension_columns(helper.frame)
        keys = ["ds", *[left for left, _ in pairs]]
        daily = self._renamed(self._aligned(helper, values, dims, pairs), pairs)
        reduced = align.aggregate_helper(daily, keys, values)
        detail = self.revenue.mapping.dimension_columns(self.table)
        if allocate and len(pairs) < len(detail):
            self.keyed = align.allocate_helper(self.keyed, reduced, keys, values, self.counts)
        else:
            self.keyed = align.left_join_helper(self.keyed, reduced, keys)
        return self

    def add_leads(self, helper: Source) -> ModelTableBuilder:
        return self.add_values(self._as(helper, "leads"), ["leads"], allocate=True)

    def add_cost(self, helper: Source) -> ModelTableBuilder:
        helper = self._as(helper, "cost")
        pair = cost_bucket(self.revenue.mapping, helper.mapping)
        dims = helper.mapping.dimension_columns(helper.frame)
        # days only: a bucket without revenue on a day still counts in the company's cost of that day
        daily = self._aligned(helper, ["cost"], dims)
        if pair is None:
            self.keyed = align.allocate_cost(self.keyed, daily.select("ds", "cost"), None, self.counts)
        else:
            daily = self._renamed(daily, [pair]).select("ds", pair[0], "cost")
            self.keyed = align.allocate_cost(self.keyed, daily, pair[0], self.counts)
        return self

    def add_events(self, helper: Source, flags: Sequence[str] = ("event_flag", "outage_flag")) -> ModelTableBuilder:
        pairs = merge_keys(self.revenue.mapping, helper.mapping)
        keys = ["ds", *[left for left, _ in pairs]]
        df = self._renamed(parse_days(helper.frame, helper.mapping.date, "ds"), pairs)
        present = [f for f in flags if f in df.columns]
        self.keyed = align.left_join_helper(self.keyed, align.aggregate_helper(df, keys, present, flags=True), keys)
        return self

    @staticmethod
    def _as(helper: Source, name: str) -> Source:
        m = helper.mapping
        frame = helper.frame if m.values[0] == name else helper.frame.withColumnRenamed(m.values[0], name)
        return Source(frame, m.with_columns(values=(name,)))

    def build(self) -> DataFrame:
        if self.keyed is not self.counts:
            # null keys are keys here: such rows still share in the company's cost
            keys = self.keyed.drop("_rows").toDF(*[f"_key_{c}" if c in self.grain else c for c in self.keyed.columns if c != "_rows"])
            if self.counts.count() <= self.broadcast_rows:
                keys = F.broadcast(keys)
            same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in self.grain])
            self.table = self.table.join(keys, same, "left").drop(*[f"_key_{c}" for c in self.grain])
        label = self.revenue.mapping.label(self.table, COMPANY)
        return self.table.withColumn("category", label).withColumn("series_id", F.col("category"))


def revenue_only_table(revenue: Source) -> DataFrame:
    return ModelTableBuilder(revenue).build()


def build_model_table(
    revenue: Source,
    leads: Source | None = None,
    cost: Source | None = None,
    events: Source | None = None,
    custom: Sequence[Source] = (),
    fallback: bool = False,
    validate: bool = True,
) -> DataFrame:
    """The modeling table; with ``fallback`` a helper that cannot be used leaves revenue alone."""
    try:
        helpers = [h for h in (leads, cost, events, *custom) if h is not None]
        b = ModelTableBuilder(revenue, helpers, validate)
        if leads is not None:
            b.add_leads(leads)
        if cost is not None:
            b.add_cost(cost)
        if events is not None:
            b.add_events(events)
        for c in custom:
            b.add_values(c, c.mapping.values, allocate=False)
        return b.build()
    except ContractError:
        if not fallback:
            raise
        return revenue_only_table(revenue)


def normalize_input(
    table: DataFrame,
    series: str | None = None,
    window: str = "all_history",
    start: str | None = None,
    end: str | None = None,
    adjustments: Sequence[clean.Adjustment] = (),
) -> DataFrame:
    """Modeling table -> daily series ready for models: window, roll-up, adjustments, bounded regressors."""
    df = clean.training_window(table, window, start, end)
    df = df.filter(F.col("y").isNotNull())
    if adjustments:
        df = clean.apply_adjustments(df, adjustments)
    # the roll-up is small and read twice from here on (bounds, then rows)
    return clean.stabilize_regressors(cut(align.daily_rollup(df, series)))
