"""Exact duplicates: group by a 128-bit content hash, compare bytes inside groups (operator 4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import first_by_id, fold_ascii, placed, written


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "min",
                     content_hash: Callable[[Column], Column] = F.md5,
                     normalised: Column | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Rows are equal when their normalised texts (default: A-Z lower-cased) are the same bytes.
    Copies collapse inside each map task, by hash *and* text, before anything is shuffled, so a
    group that holds a third of all rows sends one row per task; equality is decided by those
    text bytes, never by the hash alone.  ``keep``: "min" keeps the smallest stable id of a
    group, "max" the largest.  Null text equals empty text; a null id never stays while its
    group has another id; repeated rows of the kept id all count as kept; an empty table gives
    an empty table; further columns are not read.
    """
    norm = fold_ascii(text) if normalised is None else normalised
    rows = docs.select(docs[doc_id].cast("long").alias("_id"), norm.alias("_text")) \
        .withColumn("_hash", content_hash(F.col("_text")))
    stays = {"min": F.min, "max": F.max}[keep]
    by_text = written(rows.groupBy("_hash", "_text").agg(F.count(F.lit(1)).alias("_n"), stays("_id").alias("_keep"))
                      .select("_hash", F.sha2("_text", 256).alias("_sha"), "_n", "_keep"))
    digests = rows.select("_id", "_hash", F.sha2("_text", 256).alias("_sha"))
    clashes = by_text.groupBy("_hash").agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1")
    if clashes.isEmpty():  # the 128-bit hash told all texts apart
        joined = digests.join(by_text.drop("_sha"), "_hash")
    else:  # texts that share a hash: told apart by their own digest as well
        joined = digests.join(by_text, ["_hash", "_sha"])
    return joined.select(F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
                         F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "min") -> DataFrame:
    """One row of each group of equal texts; all columns as they were.

    Each row is judged by its own text: of a group the row with the kept id stays ("min", "max";
    a null id only where the group has no other), and of rows that repeat it the first.  Further
    columns may have any name.  Only (id, number) pairs are compared; texts are not sorted.
    """
    rows, row = placed(docs)
    texts = rows.select(row, rows[doc_id].alias("_id"), fold_ascii(text).alias("_text"))
    stays = texts.groupBy(F.md5("_text").alias("_hash"), "_text").agg(first_by_id(F.col("_id"), row, keep).alias("_stays"))
    gone = written(rows.select(F.col(row).alias(row + "_gone")).join(stays.select("_stays"), F.col(row + "_gone") == F.col("_stays"), "left_anti"))
    return rows.join(gone, F.col(row) == F.col(row + "_gone"), "left_anti").drop(row)
