"""Punctuality cleaning over a file stream.

New monthly files landing in ``src`` are cleaned with the same stateless
projection as the batch job (``etl_punctuality``) and appended as Parquet
partitioned by service date; the checkpoint location makes the job restartable
after executor or driver loss (exactly-once file sink).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railspark.plans.etl import etl_punctuality

RAW_PUNCTUALITY_COLS = ["TRAIN_NO", "PTCAR_NO", "DELAY_ARR", "DELAY_DEP", "RELATION", "TRAIN_SERV", "RELATION_DIRECTION",
                        "LINE_NO_DEP", "LINE_NO_ARR", "PLANNED_DATE_ARR", "PLANNED_DATE_DEP", "REAL_DATE_ARR",
                        "REAL_DATE_DEP", "PLANNED_TIME_ARR", "PLANNED_TIME_DEP", "THOP1_COD"]


def raw_schema(spark: SparkSession, src: str, sep: str = ",") -> T.StructType:
    """The columns that the files' header names, all strings; the known ones while there is no file."""
    found = spark.read.option("sep", sep).option("header", True).csv(src).columns
    return T.StructType([T.StructField(c, T.StringType()) for c in found or RAW_PUNCTUALITY_COLS])


def stream_punctuality(spark: SparkSession, src: str, out: str, checkpoint: str, sep: str = ",",
                       available_now: bool = True):
    """Start the stream; with ``available_now`` it processes the files present and stops.

    Columns are taken by name: the header of the files present says which stands where, a file
    whose header differs from it fails the stream, further columns are ignored and known ones
    that are not there are NULL.
    """
    raw = spark.readStream.schema(raw_schema(spark, src, sep)).option("sep", sep).option("header", True) \
        .option("enforceSchema", False).csv(src)
    raw = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in RAW_PUNCTUALITY_COLS])
    clean = etl_punctuality(raw).withColumn("service_month", F.trunc("REAL_DATE_DEP", "month"))
    w = (clean.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .partitionBy("service_month").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(out)
