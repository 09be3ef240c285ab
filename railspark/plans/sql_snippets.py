"""DuckDB twins of the analogue builders (``railspark.plans.analogues``), used by the oracles."""

STOP_LOG = """stop_log AS (
  SELECT l_orderkey AS TRAIN_NO, make_date(year(l_shipdate), 1, 1) AS REAL_DATE_DEP,
         l_suppkey AS STOPPING_PLACE_ID, l_shipdate AS PLANNED_DATETIME_DEP, l_linenumber AS SEQ,
         l_partkey AS PART, CAST(l_quantity AS INTEGER) AS DELAY_ARR,
         CAST(round(l_discount * 100) AS INTEGER) AS DELAY_DEP, l_extendedprice AS PRICE
  FROM lineitem)"""

STOP_NEXT = STOP_LOG + """,
stop_next AS (
  SELECT *, lead(STOPPING_PLACE_ID) OVER (PARTITION BY TRAIN_NO, REAL_DATE_DEP
            ORDER BY PLANNED_DATETIME_DEP, SEQ, STOPPING_PLACE_ID, PART) AS NEXT_STOP
  FROM stop_log)"""

LEGS = STOP_NEXT + """,
legs AS (
  SELECT TRAIN_NO, REAL_DATE_DEP, STOPPING_PLACE_ID AS departure_station, NEXT_STOP AS arrival_station,
         CAST(date_diff('second', TIMESTAMP '1995-01-01 00:00:00', PLANNED_DATETIME_DEP) AS BIGINT) AS sumo_time,
         SEQ, PART, PRICE
  FROM stop_next)"""

STATIONS = """stations AS (
  SELECT s_suppkey AS ID, s_name AS Name, s_nationkey AS Nation,
         round(CAST(49.5 AS DOUBLE) + s_nationkey * CAST(0.1 AS DOUBLE), 6) AS Geo_x,
         round(CAST(3.0 AS DOUBLE) + s_acctbal / CAST(5000.0 AS DOUBLE), 6) AS Geo_y
  FROM supplier)"""

LINKS = LEGS + """,
links AS (
  SELECT departure_station AS Departure_station_id, arrival_station AS Arrival_station_id,
         max(PRICE) / CAST(1000.0 AS DOUBLE) AS Distance
  FROM legs WHERE arrival_station IS NOT NULL GROUP BY 1, 2)"""

POLYLINES = """polylines AS (
  SELECT vec_id AS ID, label AS Label,
         list_transform(range(0, len(embedding) // 2), lambda i: [round(50.0 + CAST(embedding[2 * i + 1] AS DOUBLE) / 50, 6),
                                            round(4.0 + CAST(embedding[2 * i + 2] AS DOUBLE) / 50, 6)]) AS Path
  FROM embeddings)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
