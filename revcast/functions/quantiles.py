"""Exact quantiles of columns of any length.

``percentile`` keeps every distinct value of a group in one task, which suits
daily frames but not raw tables.  Here rows are counted per distinct value and
written; while there are more than a task should order, a mergeable sketch cuts
the value range of each key into slices and only those that hold a wanted rank
go on.  The result equals linear interpolation between the two neighbouring
order statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revcast.session import stored

SLICES, MOST_ORDERED = 64, 50_000


def _refined(rows: DataFrame, held: DataFrame, slices: int) -> tuple[DataFrame, DataFrame]:
    """Cut the slices of ``held`` (k, slice, before, pos) and keep the parts that hold a wanted rank, with their rows.

    ``rows`` (k, slice, v, n) are those of the slices; a slice's parts are numbered on from it, so the order is kept.
    """
    cuts = [i / slices for i in range(1, slices)]
    bounds = rows.groupBy("k", "slice").agg(F.percentile_approx("v", cuts, 10 * slices).alias("bounds"))
    below = F.aggregate("bounds", F.lit(0), lambda acc, b: acc + (b < F.col("v")).cast("int"))
    parts = rows.join(F.broadcast(bounds), ["k", "slice"]).select("k", "slice", (F.col("slice") * slices + below).alias("part"), "v", "n")
    sizes = parts.groupBy("k", "slice", "part").agg(F.sum("n").alias("part_n")).join(F.broadcast(held), ["k", "slice"])
    upto = F.sum("part_n").over(Window.partitionBy("k", "slice").orderBy("part"))
    starts = sizes.select("k", F.col("part").alias("slice"), "part_n", (F.col("before") + upto - F.col("part_n")).alias("before"), "pos")
    end = F.col("before") + F.col("part_n")
    wanted = stored(starts.filter(F.exists("pos", lambda p: (F.floor(p) < end) & (F.ceil(p) >= F.col("before")))).drop("part_n"), "slices")
    left = parts.select("k", F.col("part").alias("slice"), "v", "n").join(F.broadcast(wanted.select("k", "slice")), ["k", "slice"])
    return stored(left, "slice-rows"), wanted


def last_slices(
    df: DataFrame, column: str, probs: Sequence[float], key: str | None = None, slices: int = SLICES, most: int = MOST_ORDERED
) -> tuple[DataFrame, DataFrame]:
    """(rows of the slices to be ordered, the slices): ``most`` distinct values or fewer, unless no slice can be cut further."""
    values = df.select(
        (F.col(key) if key else F.lit("all")).alias("k"), F.col(column).cast("double").alias("v")
    ).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    # everything below works on distinct values, so the input is read once
    rows = stored(values.groupBy("k", "v").agg(F.count("*").alias("n")).select("k", F.lit(0).cast("long").alias("slice"), "v", "n"), "distinct-values")
    pos = F.array(*[F.lit(float(p)) * (F.sum("n") - 1) for p in probs])
    held = rows.groupBy("k", "slice").agg(pos.alias("pos"), F.lit(0).cast("long").alias("before"))
    left = rows.count()
    while left > most:
        rows, held = _refined(rows, held, slices)
        before, left = left, rows.count()
        if left == before:
            break
    return rows, held


def exact_quantiles(
    df: DataFrame, column: str, probs: Sequence[float], key: str | None = None, slices: int = SLICES, most: int = MOST_ORDERED
) -> DataFrame:
    """Columns ``key, q0, q1, …`` in the order of ``probs``; one row per key value that has numbers.

    Keys are few (column names, say): the sketches of each are broadcast.
    """
    rows, held = last_slices(df, column, probs, key, slices, most)
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("k", "slice").orderBy("v"))
    ordered = rows.join(F.broadcast(held), ["k", "slice"]).select("k", "v", "pos", (upto - F.col("n")).alias("lo"), upto.alias("hi"))

    def quantile(i: int):
        pos = F.element_at("pos", i + 1)

        def at(rank):
            return F.max(F.when((rank >= F.col("lo")) & (rank < F.col("hi")), F.col("v")))

        low, high = at(F.floor(pos)), at(F.ceil(pos))
        return (low + (high - low) * F.max(pos - F.floor(pos))).alias(f"q{i}")

    out = ordered.groupBy("k").agg(*[quantile(i) for i in range(len(probs))])
    return out.withColumnRenamed("k", key) if key else out.drop("k")


def median_of(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row with the median of a column, no row if it has no numbers."""
    return exact_quantiles(df, column, [0.5]).withColumnRenamed("q0", name)


def exact_quantiles_of(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The same for several columns in one pass: rows ``column, q0, q1, …``."""
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
        ).alias("e")
    ).select("e.*")
    return exact_quantiles(long, "v", probs, key="column")
