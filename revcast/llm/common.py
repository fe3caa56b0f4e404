"""Shared folder, gapless numbering, connected components and a few column helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revcast.session import checkpoint_dir


def shipped(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers once per session; Spark hands the archive to every executor."""
    context = spark.sparkContext
    if not getattr(context, "_revcast_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "revcast"), "zip", root, "revcast"))
        context._revcast_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the cluster's shared folder and go on from there.

    It cuts the lineage: a lost executor costs the tasks that read the table, not what made it.
    Column names must be unique.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``stored``, with the rows dealt by ``key``: joins and groups by it need no shuffle of this table.

    The files lie in the shared folder; the session's catalog has the table under a name of its own.
    """
    spark = df.sparkSession
    own = f"llm_{name}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(parts, key).write.bucketBy(parts, key).option("compression", "zstd")
    dealt.saveAsTable(own, format="parquet", path=f"{checkpoint_dir(spark).rstrip('/')}/{own}")
    return spark.table(own)


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, rows_per_part: int = 20000) -> DataFrame:
    """Add a gapless number from 0 within ``keys``, in an arbitrary but fixed order.

    A key of any size is cut into parts by a hash of ``order``; rows are numbered inside a part, and
    parts are placed one after another by their counted sizes.  No task holds a whole key.  ``df`` must
    be cheap to read twice (a stored table); ``order`` should tell rows apart.
    """
    parts = max(1, df.count() // rows_per_part)
    cut = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sizes = cut.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    rows = cut.withColumn("_at", F.row_number().over(inside) - 1)
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(starts, same).withColumn(out, (F.col("_start") + F.col("_at")).cast("long")).drop("_part", "_p", "_start", "_at", *[f"_k{i}" for i in range(len(keys))])


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b long): one row (node, label) per node, label the smallest node.

    Alternating star contraction: every round links each node's larger neighbours to its smallest
    one, then does the same among the smaller ones, until nothing changes.  Only minima are
    gathered per node (combined before the shuffle); the joins are plain equi-joins, whose hot nodes
    Spark splits.  Each round is a table in the shared folder, so rounds do not pile up lineage.
    """
    links = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("k", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        tops = both.groupBy("a").agg(F.min("b").alias("m")).where("m < a").select("a", F.col("m").alias("b"))
        links_large = large.unionByName(tops).where("a <> b").distinct()
        below = links_large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        joined = links_large.join(below, F.col("a") == F.col("k"))
        small = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        links = stored(small.where("a <> b").distinct(), name)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if before is not None and now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    leaves = links.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return leaves.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct().join(leaves.select("node"), "node", "left_anti"))
