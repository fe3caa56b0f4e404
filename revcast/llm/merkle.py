"""A Merkle tree over a dataset: a subtree for each source, a tree over their roots, and a proof for each document.

Every level is a table of nodes (key, pos, n, digest) that are numbered within their key.  Lag and lead windows of the
fixed offsets 1 to 15 over a run of 16 nodes give each node its siblings and the run's first node its parent's children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revcast.llm.common import stored

FAN = 16
ROWS_PER_PART = 20_000
STEP = "array<struct<slot:int,others:binary>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest (32 bytes) of a document with ``text`` in place of its own."""
    inputs = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.unhex(F.sha2(F.concat(*[field(c) for c in inputs], field(text)).cast("binary"), 256))


def as_text(digest: Column) -> Column:
    """One or more digests as lower-case hex text."""
    return F.lower(F.hex(digest))


def hashed(digests: Column) -> Column:
    """H of one or more digests, each taken as hex text."""
    return F.unhex(F.sha2(as_text(digests).cast("binary"), 256))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Number ``rows`` from 0 within ``key`` by ``order``: adds pos, and n, the key's number of rows.

    The rows are cut into ranges of (key, order), so a key of any size spreads over many; each range is numbered by itself
    and placed behind the ranges before it by their counted rows.  ``order`` must tell rows apart, and ``rows`` be a stored
    table, as its size is counted first.
    """
    parts = max(1, rows.count() // ROWS_PER_PART)
    ranged = stored(rows.repartitionByRange(parts, "key", *order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    sizes = ranged.groupBy("key", "part").agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("key", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(whole).alias("n"))
    within = ranged.withColumn("at", F.row_number().over(Window.partitionBy("key", "part").orderBy(*order)) - 1)
    return within.join(starts, ["key", "part"]).withColumn("pos", F.col("start") + F.col("at")).drop("part", "start", "at")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Add run, slot, others (the run's other digests, left to right) and, in slot 0, parent to nodes of keys of several nodes.

    The window is one run, so a key of any size spreads over all tasks.  A lag counts where the slot reaches back that far,
    a lead where the run, which the key's last nodes may leave short, is that long.
    """
    run = nodes.where("n > 1").selectExpr("*", f"pos div {FAN} AS run", f"CAST(pos % {FAN} AS INT) AS slot")
    rows = run.selectExpr("*", f"CAST(least({FAN}, n - run * {FAN}) AS INT) AS length")
    over = "OVER (PARTITION BY key, run ORDER BY pos)"
    left = [f"if(slot >= {k}, lag(digest, {k}) {over}, X'')" for k in range(FAN - 1, 0, -1)]
    right = [f"if(slot + {k} < length, lead(digest, {k}) {over}, X'')" for k in range(1, FAN)]
    found = rows.selectExpr("*", f"concat({', '.join(left + right)}) AS others").drop("length")
    return found.withColumn("parent", F.when(F.col("slot") == 0, hashed(F.concat("digest", "others"))))


def levels_of(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The stored tables of nodes from the leaves up; a key's topmost node is alone (n = 1) in its last table."""
    tables = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = with_siblings(tables[-1]).where("slot = 0")
        above = runs.select("key", F.col("run").alias("pos"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), F.col("parent").alias("digest"))
        tables.append(stored(above, name))
        most = -(-most // FAN)
    return tables


def tops(tables: list[DataFrame]) -> DataFrame:
    """The one node that remains of each key: key, digest."""
    found = tables[0].where("n = 1").select("key", "digest")
    for nodes in tables[1:]:
        found = found.unionByName(nodes.where("n = 1").select("key", "digest"))
    return found


def paths(tables: list[DataFrame], ends: DataFrame, name: str) -> DataFrame:
    """The leaf table with ``path`` from each leaf up to its key's top and on along the path in ``ends`` (key, path, subroot).

    From the top down: a node's path is its own step and its parent's path, so a path is worked out once for the 16 nodes
    below it, and only the leaves, at the end, have one each.
    """
    below = None
    for nodes in reversed(tables):
        alone = nodes.where("n = 1").join(ends, "key")
        if below is None:
            here = alone
        else:
            met = with_siblings(nodes).join(below, ["key", "run"]).withColumn("path", F.concat(F.array(F.struct("slot", "others")).cast(STEP), F.col("path")))
            here = met.drop("run", "slot", "others", "parent").unionByName(alone)
        if nodes is tables[0]:
            return here
        below = stored(here.select("key", F.col("pos").alias("run"), "path", "subroot"), name)
    raise AssertionError


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""

    def step(node: Column, at: Column) -> Column:
        cut = 32 * at["slot"]
        return hashed(F.concat(F.substring(at["others"], F.lit(1), cut), node, F.substring(at["others"], cut + 1, F.lit(32 * FAN))))

    return F.aggregate(path, start, step)


def tampered_text() -> Column:
    """The text a forger leaves: A-Z lower-cased where 5 divides the CRC-32 of the decimal doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))


def manifest(docs: DataFrame, changed_text: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves ascend by doc_id within their source, null ids first, rows of one id by their digest; rows that are equal in all
    five columns are leaves of their own with one digest.  A null source is a source by itself, before all others.  Where
    ``changed_text`` differs from the text, ``folded_root`` starts from the changed leaf and ``verified`` is false.  Texts of
    any length, null and empty ones (different leaves) take part.  An empty table gives an empty result; other columns are
    not read.
    """
    own, other = leaf(F.col("text")), leaf(F.col("text") if changed_text is None else changed_text)
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(F.col("doc_id"), key.alias("key"), own.alias("digest"), other.alias("changed"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows.withColumn("changed", F.when(F.col("changed") != F.col("digest"), F.col("changed"))), "merkle-leaves")
    leaves = stored(placed(rows, ["doc_id", "digest", "row"]), "merkle-level")
    sources = levels_of(leaves, "merkle-level")
    heads = stored(tops(sources).select(F.lit("").alias("key"), F.col("key").alias("name"), "digest"), "merkle-heads")
    trunk = levels_of(stored(placed(heads, ["name"]), "merkle-trunk"), "merkle-trunk")
    end = F.lit(None).cast("binary")
    start = tops(trunk).select("key", F.array().cast(STEP).alias("path"), end.alias("subroot"))
    root = tops(trunk).first()
    ends = stored(paths(trunk, start, "merkle-path").select(F.col("name").alias("key"), "path", F.col("digest").alias("subroot")), "merkle-path")
    proved = paths(sources, ends, "merkle-path")
    siblings = F.aggregate("path", F.lit(b""), lambda text, x: F.concat(text, x["others"]))
    out = proved.select(
        "doc_id",
        as_text(F.col("digest")).alias("leaf"),
        as_text(F.col("subroot")).alias("subroot"),
        F.lit(root["digest"].hex() if root else None).cast("string").alias("root"),
        as_text(hashed(siblings)).alias("proof_sha256"),
        as_text(folded(F.coalesce("changed", "digest"), F.col("path"))).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
