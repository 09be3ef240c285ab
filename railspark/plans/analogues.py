"""Railway-shaped tables derived from the supplied test tables.

The supplied tables hold no railway data, so every operator is exercised
through an analogue (each derived by Spark from the whole table):

* stop log   <- ``lineitem``: train = order, service day = ship year, stop =
  supplier, planned departure = ship date (ties: line number, part), delays =
  quantity / discount.
* stations   <- ``supplier``: id, name, nation; coordinates from nation/balance.
* links      <- distinct consecutive supplier pairs of the stop log.
* polylines  <- ``embeddings``: points (e[2i], e[2i+1]) scaled to ~1 km steps.

Each builder has a DuckDB twin in ``railspark.plans.sql_snippets``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railspark.operators.windows import next_and_prev_stop, next_stop
from railspark.operators import trips as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STOP_KEY = ["TRAIN_NO", "REAL_DATE_DEP"]
STOP_ORDER = ["PLANNED_DATETIME_DEP", "SEQ", "STOPPING_PLACE_ID", "PART"]


def stop_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("TRAIN_NO"),
        F.make_date(F.year("l_shipdate"), F.lit(1), F.lit(1)).alias("REAL_DATE_DEP"),
        F.col("l_suppkey").alias("STOPPING_PLACE_ID"),
        F.col("l_shipdate").alias("PLANNED_DATETIME_DEP"),
        F.col("l_linenumber").alias("SEQ"),
        F.col("l_partkey").alias("PART"),
        F.col("l_quantity").cast("int").alias("DELAY_ARR"),
        F.round(F.col("l_discount") * 100).cast("int").alias("DELAY_DEP"),
        F.col("l_extendedprice").alias("PRICE"),
    )


def stop_log_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop log with the next stop of the same train-day (bucketed by ship month)."""
    return next_stop(stop_log(spark, sf_dir), STOP_KEY, STOP_ORDER, "STOPPING_PLACE_ID", "NEXT_STOP",
                     bucket=F.date_trunc("month", F.col("PLANNED_DATETIME_DEP")))


def stop_log_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop log with the next and the previous stop of the same train-day."""
    return next_and_prev_stop(stop_log(spark, sf_dir), STOP_KEY, STOP_ORDER, "STOPPING_PLACE_ID", "NEXT_STOP", "PREV_STOP",
                              bucket=F.date_trunc("month", F.col("PLANNED_DATETIME_DEP")))


def legs(spark: SparkSession, sf_dir: str, start=None) -> DataFrame:
    """Leg rows (train-day, departure, arrival, seconds since ``start``)."""
    start = F.lit(start or "1995-01-01 00:00:00").cast("timestamp_ntz")
    return T.legs(stop_log_next(spark, sf_dir), start=start, stop="STOPPING_PLACE_ID", next_col="NEXT_STOP",
                  time="PLANNED_DATETIME_DEP", key=STOP_KEY, extra=["SEQ", "PART", "PRICE"])


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("ID"),
        F.col("s_name").alias("Name"),
        F.col("s_nationkey").alias("Nation"),
        F.round(F.lit(49.5) + F.col("s_nationkey") * F.lit(0.1), 6).alias("Geo_x"),
        F.round(F.lit(3.0) + F.col("s_acctbal") / F.lit(5000.0), 6).alias("Geo_y"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed station-to-station links with distance (km) and a 2-point polyline [lat, lon]."""
    lg = legs(spark, sf_dir).filter(F.col("arrival_station").isNotNull())
    agg = lg.groupBy(F.col("departure_station").alias("Departure_station_id"),
                     F.col("arrival_station").alias("Arrival_station_id")) \
        .agg((F.max("PRICE") / F.lit(1000.0)).alias("Distance"))
    st = stations(spark, sf_dir).select("ID", "Geo_x", "Geo_y")
    d = st.select(F.col("ID").alias("Departure_station_id"), F.col("Geo_x").alias("dx"), F.col("Geo_y").alias("dy"))
    a = st.select(F.col("ID").alias("Arrival_station_id"), F.col("Geo_x").alias("ax"), F.col("Geo_y").alias("ay"))
    return (agg.join(d, "Departure_station_id", "left").join(a, "Arrival_station_id", "left")
            .select("Departure_station_id", "Arrival_station_id", "Distance",
                    F.array(F.array("dx", "dy"), F.array("ax", "ay")).alias("Coordinates")))


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polyline per embedding: a point ``[50 + e[2i]/50, 4 + e[2i+1]/50]`` per pair of its values."""
    e = table(spark, sf_dir, "embeddings")
    last = F.floor(F.size("embedding") / 2).cast("int") - 1
    pts = F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
                      lambda i: F.array(F.round(F.lit(50.0) + F.get("embedding", 2 * i).cast("double") / 50, 6),
                                        F.round(F.lit(4.0) + F.get("embedding", 2 * i + 1).cast("double") / 50, 6)))
    return e.select(F.col("vec_id").alias("ID"), F.col("label").alias("Label"), pts.alias("Path"))
