"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from railspark.session import ensure_checkpoint_dir

#: Rows handed to a Python worker at once; whole texts are long, so few.
BATCH_ROWS = "512"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors' Python workers, once per Spark application."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(spark.sparkContext, "_railspark_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="railspark-"), "railspark_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._railspark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder of spark.checkpoint.dir, read back.

    Cuts the lineage (lost executors re-read the table) and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written with a number of its own for each row, in their present order, and that column's name.

    The name is longer than every column's, so names that start with it clash with none.
    """
    name = max([*docs.columns, ""], key=len) + "_row"
    return written(docs.withColumn(name, F.monotonically_increasing_id())), name


def first_by_id(doc_id: Column, row: str, keep: str = "min") -> Column:
    """Aggregate: the row number with the smallest id ("max": largest), null last, then the smallest number."""
    by = doc_id.cast("long")
    return F.min(F.struct(by.isNull(), by if keep == "min" else F.bitwise_not(by), F.col(row).alias("row")))["row"]


#: Bits of a key filter: at least and at most (16 MB as pages of 4 KB).
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 27


def likely_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in the one column of ``keys``, and a few others: a filter before a join.

    The keys' hashes are set in a bitmap, eight bits apiece up to ``MOST_BITS``, whose pages go to
    every task (at most 16 MB), so rows that meet no key are not shuffled, however many keys there are.
    """
    name = keys.columns[0]
    bits = min(max(LEAST_BITS, 1 << max(0, 8 * keys.count() - 1).bit_length()), MOST_BITS)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits).cast("long"))
    # a position p is bit p mod 32768 of page p div 32768
    pages = keys.select(place(F.col(name)).alias("_p")).groupBy(F.floor(F.col("_p") / 32768).alias("_page")) \
        .agg(F.call_function("bitmap_construct_agg", F.pmod("_p", F.lit(32768).cast("long"))).alias("_bits"))
    at = F.pmod(place(F.col(key)), F.lit(32768).cast("long"))
    byte = F.conv(F.hex(F.col("_bits").substr((F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(pages), F.floor(place(F.col(key)) / 32768) == F.col("_page")) \
        .filter(F.getbit(byte, (at % 8).cast("int")) == 1).drop("_page", "_bits")


def fold_ascii(text: str) -> Column:
    """The text with A-Z lower-cased and every other character as it was; null is empty."""
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)


def bucket_of(doc_id: str, buckets: int) -> Column:
    """crc32 of the id's decimal text modulo ``buckets``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(buckets))


def texts_of(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    """A batch's texts, null as empty."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]
