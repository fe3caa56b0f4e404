"""Exact duplicates of documents, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.llm.common import stored, whole_text


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Documents are grouped by a 128-bit hash of the text; the largest id of a group stays.  The group's
    smallest and largest text are compared byte by byte, so different texts of one hash are seen;
    such hashes, and only those, are grouped again by hash and text.  Aggregates are combined before
    the shuffle, so a group may hold any share of the rows; the join back moves narrow rows.

    Null text: empty.  Null id: the row takes part, and stays only where its whole group has null ids
    (keep_id null).  Rows that repeat id and text count each and get the same answer;
    ``without_copies`` returns one of them.  An empty table gives an empty result; other columns are
    not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body")).withColumn("hash", F.md5("body"))
    groups = stored(
        rows.groupBy("hash").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), (F.min("body") == F.max("body")).alias("same")), "exact"
    )
    narrow = rows.select("id", "hash", F.sha2("body", 256).alias("text_sha256"))
    sound = groups.where("same").select(F.col("hash").alias("k"), "keep_id", "group_size")
    out = narrow.join(sound, F.col("hash") == F.col("k")).drop("k", "hash")
    if not groups.where("not same").isEmpty():
        clashing = rows.join(groups.where("not same").select("hash"), "hash", "left_semi")
        exact = clashing.groupBy(F.col("hash").alias("k"), F.col("body").alias("b")).agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = clashing.join(exact, (F.col("hash") == F.col("k")) & (F.col("body") == F.col("b")))
        out = out.unionByName(found.select("id", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one row for each different text, with all their columns.

    Grouped by hash and text, so texts of one hash are told apart by their bytes; the row of the
    largest id is carried as a struct (null ids last; between rows of one id the larger row hash
    decides).  One shuffle, combined before it.
    """
    others = [c for c in docs.columns if c != text_col]
    rank = F.struct(F.coalesce(F.col(id_col), F.lit(-(2**63))), F.xxhash64(*[F.col(f"`{c}`") for c in others], text_col))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(text_col).isNull().alias("void"))
    kept = docs.groupBy(F.md5(whole_text(text_col)).alias("_hash"), whole_text(text_col).alias("_body")).agg(F.max_by(row, rank).alias("_row"))
    back = {c: F.col(f"_row.c{i}") for i, c in enumerate(others)} | {text_col: F.when(~F.col("_row.void"), F.col("_body"))}
    return kept.select(*[back[c].alias(c) for c in docs.columns])
