"""Registered queries: one per operator of SURVEY §2, each over the whole supplied tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (DuckDB SQL over the
same parquet views).  Every computed column is aliased identically on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from railspark.plans import analogues as A
from railspark.plans import sql_snippets as S
from railspark.operators import loops as LO
from railspark.operators import relational as R
from railspark.operators import trips as T
from railspark.operators import windows as W
from railspark.session import discard

QUERIES: dict = {}
ORACLE: dict = {}


def q(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ flagship / minimum slice

@q("link_stats", S.with_(S.LEGS) + """
SELECT departure_station, arrival_station, count(*) AS n_legs, round(sum(PRICE), 2) AS sum_price
FROM legs WHERE arrival_station IS NOT NULL GROUP BY 1, 2""")
def link_stats(spark, sf):
    lg = A.legs(spark, sf).filter(F.col("arrival_station").isNotNull())
    return lg.groupBy("departure_station", "arrival_station").agg(
        F.count(F.lit(1)).alias("n_legs"), F.round(F.sum("PRICE"), 2).alias("sum_price"))


@q("next_stop", S.with_(S.STOP_NEXT) + """
SELECT TRAIN_NO, REAL_DATE_DEP, STOPPING_PLACE_ID, SEQ, PART, NEXT_STOP FROM stop_next""")
def q_next_stop(spark, sf):
    return A.stop_log_next(spark, sf).select("TRAIN_NO", "REAL_DATE_DEP", "STOPPING_PLACE_ID", "SEQ", "PART",
                                             "NEXT_STOP")


@q("prev_stop", S.with_(S.STOP_LOG) + """
SELECT TRAIN_NO, STOPPING_PLACE_ID, SEQ, PART,
       lag(STOPPING_PLACE_ID) OVER (PARTITION BY TRAIN_NO, REAL_DATE_DEP
                                    ORDER BY PLANNED_DATETIME_DEP, SEQ, STOPPING_PLACE_ID, PART) AS PREV_STOP
FROM stop_log""")
def q_prev_stop(spark, sf):
    df = W.prev_stop(A.stop_log(spark, sf), A.STOP_KEY, A.STOP_ORDER, "STOPPING_PLACE_ID", "PREV_STOP",
                     bucket=F.date_trunc("month", "PLANNED_DATETIME_DEP"))
    return df.select("TRAIN_NO", "STOPPING_PLACE_ID", "SEQ", "PART", "PREV_STOP")


@q("legs", S.with_(S.LEGS) + """
SELECT TRAIN_NO, REAL_DATE_DEP, departure_station, arrival_station, sumo_time, SEQ, PART FROM legs""")
def q_legs(spark, sf):
    return A.legs(spark, sf).drop("PRICE")


# ------------------------------------------------------------------ §2.2 projections, filters

from railspark.operators import clean as C  # noqa: E402
from railspark.operators import quality as Q  # noqa: E402
from railspark.functions import scalar as FX  # noqa: E402
from railspark.functions import geo as G  # noqa: E402

SEEDS_SQL = "seeds AS (SELECT s_suppkey AS station FROM supplier WHERE s_nationkey = 3)"
SEEDS2_SQL = "seeds2 AS (SELECT s_suppkey AS station FROM supplier WHERE s_nationkey IN (3, 7, 11))"


def seeds(spark, sf, nations=(3,)):
    return A.table(spark, sf, "supplier").filter(F.col("s_nationkey").isin(list(nations))) \
        .select(F.col("s_suppkey").alias("station"))


@q("cast_columns", """
SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS prio,
       TRY_CAST(o_orderstatus AS INTEGER) AS status_num, TRY_CAST(CAST(o_custkey AS VARCHAR) AS BIGINT) AS custkey
FROM orders""")
def q_cast_columns(spark, sf):
    o = A.table(spark, sf, "orders").select(
        "o_orderkey", F.substring_index("o_orderpriority", "-", 1).alias("prio"),
        F.col("o_orderstatus").alias("status_num"), F.col("o_custkey").cast("string").alias("custkey"))
    return C.cast_columns(o, {"prio": "int", "status_num": "int", "custkey": "bigint"})


@q("rename_columns", "SELECT c_custkey AS ID, c_name AS Name, c_nationkey AS Nation, c_acctbal, c_mktsegment FROM customer")
def q_rename(spark, sf):
    return C.rename_columns(A.table(spark, sf, "customer"),
                            {"c_custkey": "ID", "c_name": "Name", "c_nationkey": "Nation", "absent": "x"})


@q("drop_columns", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def q_drop(spark, sf):
    return C.drop_columns(A.table(spark, sf, "customer"), ["c_acctbal", "c_mktsegment", "not_there"])


@q("select_order", "SELECT c_name, c_custkey, CAST(NULL AS DOUBLE) AS Elevation, c_nationkey FROM customer")
def q_select_order(spark, sf):
    return C.select_order(A.table(spark, sf, "customer"), ["c_name", "c_custkey", "Elevation", "c_nationkey"],
                          {"Elevation": "double"})


@q("blank_to_null", """
SELECT doc_id, NULLIF(text, '') AS text, NULLIF(lang, '') AS lang, NULLIF(source, '') AS source, n_chars
FROM documents""")
def q_blank_to_null(spark, sf):
    return C.blank_to_null(A.table(spark, sf, "documents"))


@q("time_range_filter", S.with_(S.STOP_LOG) + """
SELECT TRAIN_NO, STOPPING_PLACE_ID, SEQ, PART, strftime(PLANNED_DATETIME_DEP, '%Y-%m-%d') AS planned
FROM stop_log WHERE PLANNED_DATETIME_DEP BETWEEN TIMESTAMP '1996-03-01 00:00:00' AND TIMESTAMP '1996-03-06 00:00:00'""")
def q_time_range(spark, sf):
    df = C.time_range_filter(A.stop_log(spark, sf), "PLANNED_DATETIME_DEP", "1996-03-01 00:00:00",
                             "1996-03-06 00:00:00")
    return df.select("TRAIN_NO", "STOPPING_PLACE_ID", "SEQ", "PART",
                     F.date_format("PLANNED_DATETIME_DEP", "yyyy-MM-dd").alias("planned"))


@q("member_filter_any", S.with_(S.LEGS, SEEDS_SQL) + """
SELECT TRAIN_NO, SEQ, PART, departure_station, arrival_station FROM legs
WHERE departure_station IN (SELECT station FROM seeds) OR arrival_station IN (SELECT station FROM seeds)""")
def q_member_any(spark, sf):
    return C.member_filter(A.legs(spark, sf), ["departure_station", "arrival_station"], seeds(spark, sf), "any") \
        .select("TRAIN_NO", "SEQ", "PART", "departure_station", "arrival_station")


@q("member_filter_all", S.with_(S.LEGS, SEEDS2_SQL) + """
SELECT TRAIN_NO, SEQ, PART, departure_station, arrival_station FROM legs
WHERE departure_station IN (SELECT station FROM seeds2) AND arrival_station IN (SELECT station FROM seeds2)""")
def q_member_all(spark, sf):
    return C.member_filter(A.legs(spark, sf), ["departure_station", "arrival_station"],
                           seeds(spark, sf, (3, 7, 11)), "all") \
        .select("TRAIN_NO", "SEQ", "PART", "departure_station", "arrival_station")


@q("link_filter", S.with_(S.STOP_NEXT) + """,
top AS (SELECT STOPPING_PLACE_ID AS a, NEXT_STOP AS b FROM stop_next WHERE NEXT_STOP IS NOT NULL
        GROUP BY 1, 2 ORDER BY count(*) DESC, a, b LIMIT 1)
SELECT TRAIN_NO, SEQ, PART, STOPPING_PLACE_ID, NEXT_STOP, DELAY_ARR FROM stop_next, top
WHERE STOPPING_PLACE_ID = top.a AND NEXT_STOP = top.b""")
def q_link_filter(spark, sf):
    sn = LO.materialise_input(A.stop_log_next(spark, sf).select("TRAIN_NO", "SEQ", "PART", "STOPPING_PLACE_ID", "NEXT_STOP", "DELAY_ARR"))
    # the busiest link (a top-1 report), then the filter on it
    top = (sn.filter(F.col("NEXT_STOP").isNotNull()).groupBy("STOPPING_PLACE_ID", "NEXT_STOP")
           .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "STOPPING_PLACE_ID", "NEXT_STOP").first())
    return C.link_filter(sn, "STOPPING_PLACE_ID", "NEXT_STOP", top and top["STOPPING_PLACE_ID"], top and top["NEXT_STOP"])


@q("dropna_any", S.with_(S.STOP_NEXT) + """
SELECT TRAIN_NO, SEQ, PART, STOPPING_PLACE_ID, NEXT_STOP FROM stop_next WHERE NEXT_STOP IS NOT NULL""")
def q_dropna(spark, sf):
    return C.dropna_any(A.stop_log_next(spark, sf).select("TRAIN_NO", "SEQ", "PART", "STOPPING_PLACE_ID",
                                                          "NEXT_STOP"))


@q("null_inspect", S.with_(S.STOP_NEXT) + """
SELECT TRAIN_NO, REAL_DATE_DEP, STOPPING_PLACE_ID FROM stop_next WHERE NEXT_STOP IS NULL""")
def q_null_inspect(spark, sf):
    return C.null_inspect(A.stop_log_next(spark, sf), ["NEXT_STOP"]).select("TRAIN_NO", "REAL_DATE_DEP",
                                                                          "STOPPING_PLACE_ID")


@q("point_lookup", S.with_(S.LINKS) + """
SELECT Departure_station_id, Arrival_station_id, Distance FROM links
WHERE Departure_station_id = 1 OR Arrival_station_id = 1""")
def q_point_lookup(spark, sf):
    return C.point_lookup(A.links(spark, sf), ["Departure_station_id", "Arrival_station_id"], 1) \
        .select("Departure_station_id", "Arrival_station_id", "Distance")


@q("conditional_update", S.with_(S.STATIONS) + """
SELECT ID, Nation, Geo_x, CASE WHEN Nation = 3 THEN CAST(4.0 AS DOUBLE) ELSE Geo_y END AS Geo_y FROM stations""")
def q_conditional_update(spark, sf):
    st = A.stations(spark, sf).select("ID", "Nation", "Geo_x", "Geo_y")
    return C.conditional_update(st, F.col("Nation") == 3, "Geo_y", 4.0)


# ------------------------------------------------------------------ §2.8 scalar functions

@q("f_unquote_json", """
SELECT event_id, regexp_replace(regexp_replace('"' || replace(props, '"', '""') || '"', '^"|"$', '', 'g'),
                                '""', '"', 'g') AS unquoted FROM events""")
def q_unquote(spark, sf):
    e = A.table(spark, sf, "events")
    quoted = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('""')), F.lit('"'))
    return e.select("event_id", FX.unquote_json(quoted).alias("unquoted"))


@q("f_split_point", """
SELECT s_suppkey, TRY_CAST(trim(split_part(s_nationkey || '.5, ' || s_suppkey, ',', 1)) AS DOUBLE) AS lat,
       TRY_CAST(trim(split_part(s_nationkey || '.5, ' || s_suppkey, ',', 2)) AS DOUBLE) AS lon,
       CAST(NULL AS DOUBLE) AS z FROM supplier""")
def q_split_point(spark, sf):
    s = A.table(spark, sf, "supplier")
    txt = F.concat_ws(", ", F.concat(F.col("s_nationkey").cast("string"), F.lit(".5")), F.col("s_suppkey").cast("string"))
    return s.select("s_suppkey", FX.split_point(txt, 0).alias("lat"), FX.split_point(txt, 1).alias("lon"),
                    FX.split_point(txt, 2).alias("z"))


@q("f_truncate", """
SELECT c_custkey, floor(c_acctbal / 7 * 1000000) / 1000000 AS floored, round(c_acctbal / 7, 6) AS rounded
FROM customer""")
def q_truncate(spark, sf):
    c = A.table(spark, sf, "customer")
    v = F.col("c_acctbal") / 7
    return c.select("c_custkey", FX.truncate(v, 6, "floor").alias("floored"), FX.truncate(v, 6, "round").alias("rounded"))


@q("f_date_reformat", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, strftime(o_orderdate, '%d-%m-%Y') AS order_date_txt
FROM orders""")
def q_date_reformat(spark, sf):
    o = A.table(spark, sf, "orders")
    raw = F.upper(F.date_format("o_orderdate", "ddMMMyyyy"))
    d = FX.parse_ddmmmyyyy(raw)
    return o.select("o_orderkey", d.alias("order_date"), F.date_format(d, "dd-MM-yyyy").alias("order_date_txt"))


@q("f_datetime_merge", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
                      ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS merged FROM events""")
def q_datetime_merge(spark, sf):
    e = A.table(spark, sf, "events")
    d = F.date_format("ts", "dd-MM-yyyy")
    t = F.when(F.col("event_type") != "error", F.date_format("ts", "H:mm:ss"))
    m = FX.datetime_merge(d, t, "dd-MM-yyyy", "H:mm:ss")
    return e.select("event_id", F.date_format(m, "yyyy-MM-dd HH:mm:ss").alias("merged"))


@q("f_case_null", "SELECT event_id, NULLIF(event_type, 'view') AS event_type FROM events")
def q_case_null(spark, sf):
    return A.table(spark, sf, "events").select("event_id", FX.case_null("event_type", "view").alias("event_type"))


@q("f_seconds_since", """
SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 1000000 AS seconds FROM events""")
def q_seconds_since(spark, sf):
    e = A.table(spark, sf, "events")
    return e.select("event_id", FX.seconds_since(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "ts").alias("seconds"))


@q("f_seconds_to_ts", """
SELECT event_id, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(CAST(round(value * 1000000) AS BIGINT)),
                          '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events""")
def q_seconds_to_ts(spark, sf):
    e = A.table(spark, sf, "events")
    t = FX.seconds_to_ts(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("value"))
    return e.select("event_id", F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@q("f_format_date_time", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t FROM events""")
def q_format_dt(spark, sf):
    e = A.table(spark, sf, "events")
    return e.select("event_id", FX.format_date("ts").alias("d"), FX.format_time("ts").alias("t"))


@q("f_parse_iso", """
SELECT event_id, CAST(ts AS DATE) AS d,
       CASE WHEN event_type = 'error' THEN NULL
            WHEN event_type = 'click' THEN hour(ts) * 3600 + minute(ts) * 60
            ELSE hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS INTEGER) END AS secs FROM events""")
def q_parse_iso(spark, sf):
    e = A.table(spark, sf, "events")
    t = (F.when(F.col("event_type") == "error", F.lit("25:61"))
         .when(F.col("event_type") == "click", F.date_format("ts", "HH:mm"))
         .otherwise(F.date_format("ts", "HH:mm:ss")))
    return e.select("event_id", FX.parse_iso_date(F.date_format("ts", "yyyy-MM-dd")).alias("d"),
                    FX.parse_iso_time(t).alias("secs"))


@q("f_to_finite_double", """
SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN NULL
                      ELSE CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) END AS v FROM events""")
def q_to_finite(spark, sf):
    e = A.table(spark, sf, "events")
    raw = (F.when(F.col("event_type") == "error", F.lit("inf")).when(F.col("event_type") == "view", F.lit("  "))
           .otherwise(F.concat(F.lit(" "), F.regexp_extract("props", r"(\d+)", 1), F.lit(" "))))
    return e.select("event_id", FX.to_finite_double(raw).alias("v"))


@q("f_pick_first", """
SELECT event_id, COALESCE(NULLIF(CASE WHEN event_type = 'click' THEN '' ELSE event_type END, ''),
                          NULLIF(props, '')) AS picked FROM events""")
def q_pick_first(spark, sf):
    e = A.table(spark, sf, "events")
    a = F.when(F.col("event_type") == "click", F.lit("")).otherwise(F.col("event_type"))
    return e.select("event_id", FX.pick_first(a, "props").alias("picked"))


@q("f_lane_to_edge", """
SELECT event_id, event_type || '_' || user_id AS edge FROM events""")
def q_lane(spark, sf):
    e = A.table(spark, sf, "events")
    lane = F.concat_ws("_", "event_type", F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string"))
    return e.select("event_id", FX.lane_to_edge(lane).alias("edge"))


@q("f_split_head_tail", """
SELECT event_id, event_type AS head, CAST(event_id AS VARCHAR) || '->x' AS tail FROM events""")
def q_head_tail(spark, sf):
    e = A.table(spark, sf, "events")
    s = F.concat(F.col("event_type"), F.lit("_"), F.col("user_id").cast("string"), F.lit("->"),
                 F.col("event_id").cast("string"), F.lit("->x"))
    return e.select("event_id", FX.split_head(s, "_").alias("head"), FX.split_tail(s, "->").alias("tail"))


@q("f_link_id", S.with_(S.LINKS) + """
SELECT Departure_station_id || '_' || Arrival_station_id AS edge_id,
       Departure_station_id || '->' || Arrival_station_id AS stop_id FROM links""")
def q_link_id(spark, sf):
    lk = A.links(spark, sf)
    return lk.select(FX.link_id("Departure_station_id", "Arrival_station_id", "_").alias("edge_id"),
                     FX.link_id("Departure_station_id", "Arrival_station_id", "->").alias("stop_id"))


@q("f_isclose", """
SELECT c_custkey, coalesce(abs(c_acctbal - (c_acctbal + c_custkey * 0.00001)) <= 1e-8 + 1e-5 * abs(c_acctbal + c_custkey * 0.00001), false) AS close
FROM customer""")
def q_isclose(spark, sf):
    c = A.table(spark, sf, "customer")
    return c.select("c_custkey", FX.isclose(F.col("c_acctbal"), F.col("c_acctbal") + F.col("c_custkey") * 0.00001,
                                             1e-5, 1e-8).alias("close"))


@q("f_eq_false_on_null", S.with_(S.STOP_NEXT) + """
SELECT TRAIN_NO, SEQ, PART, coalesce(STOPPING_PLACE_ID = NEXT_STOP, false) AS same_stop FROM stop_next""")
def q_eq_false(spark, sf):
    return A.stop_log_next(spark, sf).select("TRAIN_NO", "SEQ", "PART",
                                             FX.eq_false_on_null("STOPPING_PLACE_ID", "NEXT_STOP").alias("same_stop"))


@q("f_acos_degrees", """
SELECT event_id, round(degrees(acos(greatest(-1.0, least(1.0, value / 20 - 1)))), 6) AS angle,
       round(sqrt(value * value + user_id * user_id), 6) AS hyp FROM events""")
def q_acos(spark, sf):
    e = A.table(spark, sf, "events")
    return e.select("event_id", F.round(FX.acos_degrees(F.col("value") / 20 - 1), 6).alias("angle"),
                    F.round(F.hypot("value", "user_id"), 6).alias("hyp"))


@q("f_abs", S.with_(S.STOP_LOG) + "SELECT TRAIN_NO, SEQ, PART, abs(DELAY_ARR - 25) AS d FROM stop_log")
def q_abs(spark, sf):
    return A.stop_log(spark, sf).select("TRAIN_NO", "SEQ", "PART", F.abs(F.col("DELAY_ARR") - 25).alias("d"))


@q("f_from_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def q_from_json(spark, sf):
    e = A.table(spark, sf, "events")
    return e.select("event_id", FX.from_json_text("props", "k int")["k"].alias("k"))


@q("f_to_json", """
SELECT event_id, '[[' || user_id || ',' || event_id || '],[' || event_id || ',' || user_id || ']]' AS js FROM events""")
def q_to_json(spark, sf):
    e = A.table(spark, sf, "events")
    arr = F.array(F.array("user_id", "event_id"), F.array("event_id", "user_id"))
    return e.select("event_id", FX.polyline_to_json(arr).alias("js"))


@q("f_parse_polyline", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE 2 END AS n_points,
       CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id AS DOUBLE) END AS lat0 FROM events""")
def q_parse_polyline(spark, sf):
    e = A.table(spark, sf, "events")
    txt = F.when(F.col("event_type") == "error", F.concat(F.lit("[["), F.col("user_id").cast("string"), F.lit("],[2")))\
        .otherwise(F.concat(F.lit("[["), F.col("user_id").cast("string"), F.lit(","), F.regexp_extract("props", r"(\d+)", 1),
                            F.lit("],[1.5,2]]")))
    p = FX.parse_polyline(txt)
    return e.select("event_id", F.when(p.isNotNull(), F.size(p)).alias("n_points"),
                    G.lat_of(p[0]).alias("lat0"))


# ------------------------------------------------------------------ §2.3 joins

@q("join_both_endpoints", S.with_(S.LINKS, S.STATIONS) + """
SELECT l.Departure_station_id, l.Arrival_station_id, d.Geo_x AS dep_Geo_x, d.Geo_y AS dep_Geo_y,
       a.Geo_x AS arr_Geo_x, a.Geo_y AS arr_Geo_y
FROM links l LEFT JOIN stations d ON l.Departure_station_id = d.ID LEFT JOIN stations a ON l.Arrival_station_id = a.ID""")
def q_join_both(spark, sf):
    j = R.join_both_endpoints(A.links(spark, sf).drop("Coordinates"), A.stations(spark, sf))
    return j.select("Departure_station_id", "Arrival_station_id", "dep_Geo_x", "dep_Geo_y", "arr_Geo_x", "arr_Geo_y")


@q("join_next_dim", S.with_(S.STOP_NEXT, S.STATIONS) + """
SELECT n.TRAIN_NO, n.SEQ, n.PART, n.NEXT_STOP, s.Name AS next_Name
FROM stop_next n LEFT JOIN stations s ON n.NEXT_STOP = s.ID""")
def q_join_next(spark, sf):
    j = R.join_next_dim(A.stop_log_next(spark, sf), A.stations(spark, sf), "NEXT_STOP", "ID", ["Name"])
    return j.select("TRAIN_NO", "SEQ", "PART", "NEXT_STOP", "next_Name")


@q("join_lookup_last_wins", """
WITH last AS (SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem
              QUALIFY row_number() OVER (PARTITION BY l_orderkey
                                         ORDER BY l_linenumber DESC, l_suppkey DESC, l_partkey DESC, l_shipdate DESC) = 1)
SELECT o.o_orderkey, last.l_suppkey AS last_supplier, last.l_linenumber AS last_line
FROM orders o LEFT JOIN last ON o.o_orderkey = last.l_orderkey""")
def q_lookup_last(spark, sf):
    li = A.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_shipdate")
    o = A.table(spark, sf, "orders").select("o_orderkey")
    return R.join_lookup_last_wins(o, li, "o_orderkey", "l_orderkey", ["l_linenumber", "l_suppkey", "l_partkey", "l_shipdate"]).select(
        "o_orderkey", F.col("l_suppkey").alias("last_supplier"), F.col("l_linenumber").alias("last_line"))


@q("semi_membership", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_semi(spark, sf):
    c = A.table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    return R.semi_membership(A.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey", "c_custkey")


@q("anti_missing", """
SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""")
def q_anti(spark, sf):
    return R.anti_missing(A.table(spark, sf, "customer").select("c_custkey"), A.table(spark, sf, "orders"),
                          "c_custkey", "o_custkey")


def _edge_table(lk):
    return lk.select(F.concat_ws("_", "Departure_station_id", "Arrival_station_id").alias("id"),
                     F.col("Departure_station_id").alias("from"), F.col("Arrival_station_id").alias("to"),
                     F.col("Distance").alias("ord"))


def _track_table(lk):
    t = lk.select(F.col("Departure_station_id").alias("a"), F.col("Arrival_station_id").alias("b"),
                  "Distance")
    return t.select(F.concat_ws("-", "a", "b").alias("track_id"), "a", "b", "Distance",
                    F.struct(F.col("Distance"), F.col("a"), F.col("b")).alias("ord"))


UNDIRECTED_SQL = S.with_(S.LINKS) + """,
edges AS (SELECT Departure_station_id || '_' || Arrival_station_id AS id, Departure_station_id AS f,
                 Arrival_station_id AS t FROM links),
tracks AS (SELECT Departure_station_id || '-' || Arrival_station_id AS track_id, Departure_station_id AS a,
                  Arrival_station_id AS b, Distance FROM links)
SELECT e.id, tr.track_id, tr.a AS "from", tr.b AS "to", round(tr.Distance, 6) AS length
FROM edges e JOIN tracks tr ON least(e.f, e.t) = least(tr.a, tr.b) AND greatest(e.f, e.t) = greatest(tr.a, tr.b)
QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY tr.Distance, tr.a, tr.b) = 1"""


@q("undirected_pair_join", UNDIRECTED_SQL)
def q_undirected(spark, sf):
    lk = A.links(spark, sf)
    return R.undirected_pair_join(_edge_table(lk), _track_table(lk), t_length="Distance")


@q("array_membership_join", S.with_(S.LINKS) + """,
st AS (SELECT s_nationkey AS Station_ID, list(s_suppkey) AS tracks FROM supplier GROUP BY 1
       UNION ALL SELECT 99 AS Station_ID, [CAST(-1 AS BIGINT)] AS tracks),
ex AS (SELECT Station_ID, unnest(tracks) AS t FROM st),
j AS (SELECT ex.Station_ID, l.Departure_station_id || '_' || l.Arrival_station_id AS e
      FROM ex LEFT JOIN links l ON ex.t = l.Departure_station_id)
SELECT Station_ID, coalesce(string_agg(DISTINCT e, ',' ORDER BY e), '') AS edges FROM j GROUP BY 1""")
def q_array_membership(spark, sf):
    sup = A.table(spark, sf, "supplier")
    st = sup.groupBy(F.col("s_nationkey").alias("Station_ID")).agg(F.collect_list("s_suppkey").alias("tracks"))
    st = st.unionByName(spark.createDataFrame([(99, [-1])], "Station_ID int, tracks array<bigint>"))
    lk = A.links(spark, sf)
    edges = lk.select(F.concat_ws("_", "Departure_station_id", "Arrival_station_id").alias("edge_id"),
                      F.col("Departure_station_id").alias("track"))
    r = R.array_membership_join(st, edges, "Station_ID", "tracks", "edge_id", "track")
    return r.select("Station_ID", F.array_join("edges", ",").alias("edges"))


def _paged_sql(source: str, key: str, value: str, name: str, n: int = 16) -> str:
    """Pages of ``n`` distinct values per key; ``source`` defines d(key, value)."""
    return source + f""",
r AS (SELECT {key}, {value}, (row_number() OVER (PARTITION BY {key} ORDER BY {value}) - 1) // {n} AS page
      FROM (SELECT DISTINCT {key}, {value} FROM d WHERE {value} IS NOT NULL))
SELECT {key}, CAST(page AS BIGINT) AS page, string_agg(CAST({value} AS VARCHAR), ',' ORDER BY {value}) AS {name} FROM r GROUP BY 1, 2"""


@q("membership_pages", _paged_sql(S.with_(S.LINKS) + """,
d AS (SELECT s_nationkey AS Station_ID, l.Departure_station_id || '_' || l.Arrival_station_id AS e
      FROM supplier JOIN links l ON l.Departure_station_id = s_suppkey)""", "Station_ID", "e", "edges") + """
UNION ALL SELECT 99, 0, ''""")
def q_membership_pages(spark, sf):
    st = A.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("Station_ID"), F.col("s_suppkey").alias("track"))
    st = st.unionByName(spark.createDataFrame([(99, -1)], "Station_ID int, track bigint"))
    edges = A.links(spark, sf).select(F.concat_ws("_", "Departure_station_id", "Arrival_station_id").alias("edge_id"), F.col("Departure_station_id").alias("track"))
    return R.membership_pages(st, edges, page_rows=16).withColumn("edges", F.array_join("edges", ","))


@q("self_join_shared_node", S.with_(S.LINKS) + """,
u AS (SELECT DISTINCT least(Departure_station_id, Arrival_station_id) AS a,
                      greatest(Departure_station_id, Arrival_station_id) AS b FROM links
      WHERE Departure_station_id <> Arrival_station_id),
e AS (SELECT a || '-' || b AS id, a, b FROM u),
inc AS (SELECT DISTINCT id AS edge, a AS node FROM e UNION SELECT DISTINCT id, b FROM e),
deg AS (SELECT node, count(*) AS d FROM inc GROUP BY 1)
SELECT inc.edge, CAST(sum(deg.d - 1) AS BIGINT) AS adjacent_edges FROM inc JOIN deg USING (node) GROUP BY 1""")
def q_shared_node(spark, sf):
    lk = A.links(spark, sf).filter(F.col("Departure_station_id") != F.col("Arrival_station_id"))
    u = lk.select(F.least("Departure_station_id", "Arrival_station_id").alias("a"),
                  F.greatest("Departure_station_id", "Arrival_station_id").alias("b")).distinct()
    e = u.select(F.concat_ws("-", "a", "b").alias("id"), "a", "b")
    return R.shared_node_degree(e).select("edge", F.col("adjacent_edges").cast("long").alias("adjacent_edges"))


@q("reverse_edge_join", S.with_(S.LINKS) + """
SELECT l.Departure_station_id AS src, l.Arrival_station_id AS dst, l.Distance,
       r.Distance AS rev_Distance, r.Distance IS NOT NULL AS has_reverse
FROM links l LEFT JOIN links r ON l.Departure_station_id = r.Arrival_station_id
                              AND l.Arrival_station_id = r.Departure_station_id""")
def q_reverse(spark, sf):
    e = A.links(spark, sf).select(F.col("Departure_station_id").alias("src"),
                                  F.col("Arrival_station_id").alias("dst"), "Distance")
    return R.reverse_edge_join(e, cols=("Distance",))


@q("neighbour_expand", S.with_(S.LINKS, SEEDS_SQL) + """
SELECT DISTINCT Arrival_station_id AS station FROM links
WHERE Departure_station_id IN (SELECT station FROM seeds) AND Arrival_station_id NOT IN (SELECT station FROM seeds)""")
def q_neighbour_expand(spark, sf):
    e = A.links(spark, sf).select(F.col("Departure_station_id").alias("src"), F.col("Arrival_station_id").alias("dst"))
    return R.neighbour_expand(e, seeds(spark, sf))


ALIAS_SQL = S.with_(S.LINKS, S.STATIONS) + """,
aliases AS (SELECT 1000 + s_nationkey AS alias, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rank,
                   s_suppkey AS station FROM supplier),
ll AS (SELECT l.TRAIN_NO, l.SEQ, l.PART,
              CASE WHEN d.Nation < 12 THEN 1000 + d.Nation ELSE l.departure_station END AS departure_station,
              CASE WHEN a.Nation >= 12 OR a.Nation % 5 = 0 THEN 1000 + a.Nation ELSE l.arrival_station END AS arrival_station
       FROM legs l LEFT JOIN stations d ON l.departure_station = d.ID LEFT JOIN stations a ON l.arrival_station = a.ID),
pairs AS (SELECT DISTINCT departure_station AS d, arrival_station AS a FROM ll),
cand AS (SELECT p.d, p.a, coalesce(x.rank, 0) AS r1, coalesce(x.station, p.d) AS s1,
                coalesce(y.rank, 0) AS r2, coalesce(y.station, p.a) AS s2
         FROM pairs p LEFT JOIN aliases x ON p.d = x.alias LEFT JOIN aliases y ON p.a = y.alias),
hit AS (SELECT c.* FROM cand c WHERE EXISTS (SELECT 1 FROM links e WHERE e.Departure_station_id = c.s1
                                                                   AND e.Arrival_station_id = c.s2)),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY d, a ORDER BY r1, r2, s1, s2) = 1)
SELECT ll.TRAIN_NO, ll.SEQ, ll.PART, coalesce(b.s1, ll.departure_station) AS departure_station,
       coalesce(b.s2, ll.arrival_station) AS arrival_station
FROM ll LEFT JOIN best b ON ll.departure_station IS NOT DISTINCT FROM b.d AND ll.arrival_station IS NOT DISTINCT FROM b.a"""


def logical_legs(spark, sf):
    """Legs whose stations are partly replaced by logical ids (1000 + nation) with an alias table."""
    st = A.stations(spark, sf).select("ID", "Nation")
    lg = A.legs(spark, sf)
    d = st.select(F.col("ID").alias("_did"), F.col("Nation").alias("_dn"))
    a = st.select(F.col("ID").alias("_aid"), F.col("Nation").alias("_an"))
    j = lg.join(d, F.col("departure_station") == F.col("_did"), "left") \
        .join(a, F.col("arrival_station") == F.col("_aid"), "left")
    return j.select("TRAIN_NO", "SEQ", "PART",
                    F.when(F.col("_dn") < 12, F.col("_dn") + 1000).otherwise(F.col("departure_station"))
                    .cast("long").alias("departure_station"),
                    F.when((F.col("_an") >= 12) | (F.col("_an") % 5 == 0), F.col("_an") + 1000)
                    .otherwise(F.col("arrival_station")).cast("long").alias("arrival_station"))


def alias_table(spark, sf):
    sup = A.table(spark, sf, "supplier")
    from pyspark.sql import Window
    return sup.select((F.col("s_nationkey") + 1000).cast("long").alias("alias"),
                      F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("rank"),
                      F.col("s_suppkey").alias("station"))


@q("alias_resolve", ALIAS_SQL)
def q_alias_resolve(spark, sf):
    e = A.links(spark, sf).select(F.col("Departure_station_id").alias("src"), F.col("Arrival_station_id").alias("dst"))
    return T.alias_resolve(logical_legs(spark, sf), alias_table(spark, sf), e)


# ------------------------------------------------------------------ §2.4 aggregations

@q("group_nunique_having", """
SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1""")
def q_nunique_having(spark, sf):
    return R.group_nunique_having(A.table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", 1)


@q("global_nunique", """
SELECT count(DISTINCT l_orderkey) AS n_l_orderkey, count(DISTINCT l_suppkey) AS n_l_suppkey, count(*) AS n_rows
FROM lineitem""")
def q_global_nunique(spark, sf):
    return R.global_nunique(A.table(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"])


def _profile_sql(metric: str) -> str:
    cols = [("doc_id", False), ("text", True), ("lang", True), ("source", True), ("n_chars", False)]
    parts = []
    for c, is_str in cols:
        expr = {"distinct_count": f"count(DISTINCT {c})", "null_count": f"count(*) FILTER (WHERE {c} IS NULL)",
                "blank_count": (f"count(*) FILTER (WHERE {c} = '')" if is_str else "CAST(NULL AS BIGINT)")}[metric]
        src = "" if (metric == "blank_count" and not is_str) else " FROM documents"
        parts.append(f"SELECT '{c}' AS column_name, {expr} AS {metric}{src}")
    return "\nUNION ALL\n".join(parts)


def _profile(metric):
    def run(spark, sf):
        return Q.profile(A.table(spark, sf, "documents"), metrics=(metric,))
    return run


for _m, _k in (("distinct_count", "profile_distinct"), ("null_count", "profile_nulls"),
               ("blank_count", "profile_blanks")):
    q(_k, _profile_sql(_m))(_profile(_m))


@q("duplicate_rows", """
SELECT *, count(*) AS count FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 50 = 0)
GROUP BY ALL HAVING count(*) > 1""")
def q_duplicate_rows(spark, sf):
    """The order lines, those of some orders delivered a second time."""
    li = A.table(spark, sf, "lineitem")
    return Q.duplicate_rows(li.unionByName(li.filter("l_orderkey % 50 = 0")))


@q("adjacency_sets", S.with_(S.LINKS) + """
SELECT Departure_station_id AS node, string_agg(DISTINCT CAST(Arrival_station_id AS VARCHAR), ','
                                                ORDER BY CAST(Arrival_station_id AS VARCHAR)) AS neighbours
FROM links GROUP BY 1""")
def q_adjacency(spark, sf):
    e = A.links(spark, sf).select(F.col("Departure_station_id").alias("src"), F.col("Arrival_station_id").alias("dst"))
    a = R.adjacency_sets(e)
    return a.select("node", F.array_join(F.array_sort(F.transform("neighbours", lambda x: x.cast("string"))), ",")
                    .alias("neighbours"))


@q("adjacency_pages", _paged_sql(S.with_(S.LINKS) + """,
d AS (SELECT Departure_station_id AS node, Arrival_station_id AS nb FROM links)""", "node", "nb", "neighbours"))
def q_adjacency_pages(spark, sf):
    e = A.links(spark, sf).select(F.col("Departure_station_id").alias("src"), F.col("Arrival_station_id").alias("dst"))
    return R.adjacency_pages(e, page_rows=16).withColumn("neighbours", F.array_join("neighbours", ","))


@q("group_pages", S.with_(S.STATIONS) + """,
r AS (SELECT Nation, ID, (row_number() OVER (PARTITION BY Nation ORDER BY ID) - 1) // 3 AS page, first_value(Name) OVER (PARTITION BY Nation ORDER BY ID) AS Name
      FROM stations)
SELECT Nation, Name, CAST(page AS BIGINT) AS page, string_agg(CAST(ID AS VARCHAR), ',' ORDER BY ID) AS IDs FROM r GROUP BY 1, 2, 3""")
def q_group_pages(spark, sf):
    return R.group_pages(A.stations(spark, sf), "Nation", "Name", "ID", "ID", page_rows=3).withColumn("IDs", F.array_join("IDs", ","))


@q("group_collect", S.with_(S.STATIONS) + """
SELECT Nation, arg_min(Name, ID) AS Name, string_agg(CAST(ID AS VARCHAR), ',' ORDER BY ID) AS IDs
FROM stations GROUP BY 1""")
def q_group_collect(spark, sf):
    g = R.group_collect(A.stations(spark, sf), "Nation", "Name", "ID", "ID")
    return g.select("Nation", "Name", F.array_join("IDs", ",").alias("IDs"))


@q("found_ratio", """
WITH k AS (SELECT DISTINCT c_custkey AS k FROM customer),
     r AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT count(r.k) AS found, count(*) AS total, round(100.0 * count(r.k) / count(*), 4) AS ratio_pct
FROM k LEFT JOIN r USING (k)""")
def q_found_ratio(spark, sf):
    return R.found_ratio(A.table(spark, sf, "customer"), A.table(spark, sf, "orders"), "c_custkey", "o_custkey")


@q("trips_through_station", S.with_(S.LEGS) + """,
ends AS (SELECT TRAIN_NO, REAL_DATE_DEP, departure_station AS station FROM legs
         UNION ALL SELECT TRAIN_NO, REAL_DATE_DEP, arrival_station FROM legs)
SELECT station, count(DISTINCT (TRAIN_NO, REAL_DATE_DEP)) AS trips FROM ends WHERE station IS NOT NULL GROUP BY 1""")
def q_trips_through(spark, sf):
    return R.trips_through_station(A.legs(spark, sf), A.STOP_KEY)


@q("centroid", S.with_(S.POLYLINES) + """,
pts AS (SELECT unnest(Path) AS p FROM polylines)
SELECT round(avg(p[1]), 6) AS mean_lat, round(avg(p[2]), 6) AS mean_lon FROM pts""")
def q_centroid(spark, sf):
    c = R.centroid(A.polylines(spark, sf))
    return c.select(F.round("mean_lat", 6).alias("mean_lat"), F.round("mean_lon", 6).alias("mean_lon"))


@q("neighbour_count_check", S.with_(S.LINKS) + """,
sd AS (SELECT s_suppkey AS station FROM supplier WHERE s_nationkey = 3 UNION SELECT -1),
deg AS (SELECT Departure_station_id AS station, count(DISTINCT Arrival_station_id) AS neighbours FROM links GROUP BY 1)
SELECT sd.station, deg.neighbours,
       CASE WHEN deg.neighbours IS NULL THEN 'unknown' WHEN deg.neighbours <= 2 THEN '<=2' ELSE '>2' END AS status
FROM sd LEFT JOIN deg USING (station)""")
def q_neighbour_count(spark, sf):
    e = A.links(spark, sf).select(F.col("Departure_station_id").alias("src"), F.col("Arrival_station_id").alias("dst"))
    sd = seeds(spark, sf).unionByName(spark.createDataFrame([(-1,)], "station long"))
    return R.neighbour_count_check(e, sd)


# ------------------------------------------------------------------ §2.5 windows

@q("head_per_group", S.with_(S.STOP_LOG) + """
SELECT TRAIN_NO, REAL_DATE_DEP, STOPPING_PLACE_ID, SEQ, PART FROM stop_log
QUALIFY row_number() OVER (PARTITION BY TRAIN_NO, REAL_DATE_DEP
                           ORDER BY PLANNED_DATETIME_DEP, SEQ, STOPPING_PLACE_ID, PART) <= 3""")
def q_head(spark, sf):
    return W.head_per_group(A.stop_log(spark, sf), A.STOP_KEY, A.STOP_ORDER, 3) \
        .select("TRAIN_NO", "REAL_DATE_DEP", "STOPPING_PLACE_ID", "SEQ", "PART")


@q("dense_id_first_seen", S.with_(S.STOP_LOG) + """,
f AS (SELECT STOPPING_PLACE_ID, min((PLANNED_DATETIME_DEP, TRAIN_NO, SEQ, PART)) AS fs FROM stop_log GROUP BY 1)
SELECT STOPPING_PLACE_ID, row_number() OVER (ORDER BY fs, STOPPING_PLACE_ID) - 1 AS id FROM f""")
def q_dense_id(spark, sf):
    return W.dense_id_first_seen(A.stop_log(spark, sf), "STOPPING_PLACE_ID",
                                 ["PLANNED_DATETIME_DEP", "TRAIN_NO", "SEQ", "PART"], "id")


@q("rank_neighbours", S.with_(S.LINKS) + """
SELECT Departure_station_id AS src, Arrival_station_id AS dst,
       CAST(row_number() OVER (PARTITION BY Departure_station_id ORDER BY CAST(Arrival_station_id AS VARCHAR),
                                                                        Arrival_station_id) AS INTEGER) AS rank
FROM links""")
def q_rank_neighbours(spark, sf):
    e = A.links(spark, sf).select(F.col("Departure_station_id").alias("src"), F.col("Arrival_station_id").alias("dst"))
    return W.rank_neighbours(e, as_text=True)


@q("running_schedule", S.with_(S.STOP_LOG) + """
SELECT TRAIN_NO, SEQ, PART, STOPPING_PLACE_ID,
       CAST(sum(DELAY_ARR) OVER (PARTITION BY TRAIN_NO, REAL_DATE_DEP ORDER BY PLANNED_DATETIME_DEP, SEQ,
                                 STOPPING_PLACE_ID, PART ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_delay
FROM stop_log""")
def q_running(spark, sf):
    return W.running_sum(A.stop_log(spark, sf), A.STOP_KEY, A.STOP_ORDER, "DELAY_ARR", "cum_delay",
                         bucket=F.date_trunc("month", "PLANNED_DATETIME_DEP")) \
        .select("TRAIN_NO", "SEQ", "PART", "STOPPING_PLACE_ID", "cum_delay")


# ------------------------------------------------------------------ §2.6 sorts, limits, sampling

@q("sort_multi", S.with_(S.STATIONS) + "SELECT ID, Nation, Name FROM stations ORDER BY Nation DESC, ID")
def q_sort_multi(spark, sf):
    return R.sort_multi(A.stations(spark, sf).select("ID", "Nation", "Name"), F.desc("Nation"), F.asc("ID"))


@q("top_n_preview", S.with_(S.STOP_LOG) + """
SELECT TRAIN_NO, SEQ, PART, STOPPING_PLACE_ID, PRICE FROM stop_log
ORDER BY PRICE DESC, TRAIN_NO, SEQ, PART, STOPPING_PLACE_ID LIMIT 10""")
def q_top_n(spark, sf):
    return R.top_n(A.stop_log(spark, sf).select("TRAIN_NO", "SEQ", "PART", "STOPPING_PLACE_ID", "PRICE"), 10,
                   F.desc("PRICE"), "TRAIN_NO", "SEQ", "PART", "STOPPING_PLACE_ID")


@q("random_sample", "SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) ORDER BY md5('7:' || l_orderkey), l_orderkey LIMIT 5")
def q_random_sample(spark, sf):
    return R.random_sample(A.table(spark, sf, "lineitem"), "l_orderkey", 5, seed=7)


# ------------------------------------------------------------------ §2.7 set operations

@q("union_distinct_endpoints", S.with_(S.LINKS) + """
SELECT Departure_station_id AS station FROM links UNION SELECT Arrival_station_id FROM links""")
def q_union_endpoints(spark, sf):
    return R.union_distinct_endpoints(A.links(spark, sf))


@q("append_rows", S.with_(S.STATIONS) + """
SELECT ID, Name, Geo_x, Geo_y FROM stations
UNION ALL SELECT -1, 'Depot', CAST(50.5 AS DOUBLE), CAST(NULL AS DOUBLE)""")
def q_append(spark, sf):
    extra = spark.createDataFrame([(-1, "Depot", 50.5)], "ID long, Name string, Geo_x double")
    return R.append_rows(A.stations(spark, sf).select("ID", "Name", "Geo_x", "Geo_y"), extra)


@q("union_tagged", S.with_(S.STOP_NEXT) + """
SELECT TRAIN_NO, SEQ, PART, DELAY_ARR, 'nation3' AS source FROM stop_next
WHERE STOPPING_PLACE_ID IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)
UNION ALL
SELECT TRAIN_NO, SEQ, PART, DELAY_ARR, 'nation7' AS source FROM stop_next
WHERE STOPPING_PLACE_ID IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 7)""")
def q_union_tagged(spark, sf):
    sn = A.stop_log_next(spark, sf).select("TRAIN_NO", "SEQ", "PART", "DELAY_ARR", "STOPPING_PLACE_ID")
    frames = {f"nation{n}": R.semi_membership(sn, seeds(spark, sf, (n,)), "STOPPING_PLACE_ID", "station")
              .drop("STOPPING_PLACE_ID") for n in (3, 7)}
    return R.union_tagged(frames)


@q("distinct_rows", S.with_(S.STOP_NEXT) + """,
p AS (SELECT *, lag(STOPPING_PLACE_ID) OVER (PARTITION BY TRAIN_NO, REAL_DATE_DEP
               ORDER BY PLANNED_DATETIME_DEP, SEQ, STOPPING_PLACE_ID, PART) AS PREV_STOP FROM stop_next)
SELECT DISTINCT PREV_STOP, STOPPING_PLACE_ID, NEXT_STOP FROM p""")
def q_distinct_rows(spark, sf):
    return R.distinct_rows(A.stop_log_both(spark, sf), "PREV_STOP", "STOPPING_PLACE_ID", "NEXT_STOP")


@q("intersect_keys", S.with_(S.LINKS) + """
SELECT Departure_station_id AS station FROM links INTERSECT SELECT Arrival_station_id FROM links""")
def q_intersect(spark, sf):
    lk = A.links(spark, sf)
    return R.intersect_keys(lk.select(F.col("Departure_station_id").alias("station")),
                            lk.select(F.col("Arrival_station_id").alias("station")))


# ------------------------------------------------------------------ §2.9 polylines

from railspark.operators import polyline as P  # noqa: E402

R_M = 6371008.8


def hav_sql(p: str, q: str) -> str:
    """DuckDB haversine between two [lat, lon] list expressions (same formula as the Spark side)."""
    la1, lo1, la2, lo2 = f"radians({p}[1])", f"radians({p}[2])", f"radians({q}[1])", f"radians({q}[2])"
    h = f"(pow(sin(({la2} - {la1}) / 2), 2) + cos({la1}) * cos({la2}) * pow(sin(({lo2} - {lo1}) / 2), 2))"
    return f"({2 * R_M!r} * asin(sqrt(least(CAST(1.0 AS DOUBLE), {h}))))"


SPLIT_SQL = "WITH RECURSIVE " + S.POLYLINES + f""",
steps AS (SELECT ID, i, len(Path) AS n, {hav_sql('Path[i - 1]', 'Path[i]')} AS s FROM polylines, unnest(range(2, len(Path) + 1)) t(i)),
rec AS (
  SELECT ID, 2 AS i, 1 AS start, CAST(0.0 AS DOUBLE) AS len, CAST(NULL AS INTEGER) AS cs, CAST(NULL AS INTEGER) AS ce, len(Path) AS n
  FROM polylines
  UNION ALL
  SELECT r.ID, r.i + 1,
         CASE WHEN r.len + s.s <= 800.0 THEN r.start ELSE r.i - 1 END,
         CASE WHEN r.len + s.s <= 800.0 THEN r.len + s.s ELSE s.s END,
         CASE WHEN r.len + s.s > 800.0 AND r.i - 1 - r.start >= 1 THEN r.start END,
         CASE WHEN r.len + s.s > 800.0 AND r.i - 1 - r.start >= 1 THEN r.i - 1 END, r.n
  FROM rec r JOIN steps s ON s.ID = r.ID AND s.i = r.i),
pieces AS (SELECT ID, cs AS s, ce AS e FROM rec WHERE cs IS NOT NULL
           UNION ALL SELECT ID, start, n FROM rec WHERE i = n + 1 AND n - start >= 1),
cut AS (SELECT ID, CAST(row_number() OVER (PARTITION BY ID ORDER BY s) - 1 AS INTEGER) AS piece,
               CAST(s AS INTEGER) AS start_idx, CAST(e AS INTEGER) AS end_idx FROM pieces)
"""
SPLIT_LENGTH_SQL = SPLIT_SQL + """SELECT c.ID, c.piece, c.start_idx, c.end_idx, round(sum(s.s), 3) AS length_m
FROM cut c JOIN steps s ON s.ID = c.ID AND s.i > c.start_idx AND s.i <= c.end_idx GROUP BY ALL"""


@q("polyline_split", SPLIT_LENGTH_SQL)
def q_polyline_split(spark, sf):
    return P.polyline_split(A.polylines(spark, sf), "Path", 800.0).select("ID", "piece", "start_idx", "end_idx", F.round("Length_m", 3).alias("length_m"))


@q("polyline_split_rows", SPLIT_LENGTH_SQL)
def q_polyline_split_rows(spark, sf):
    pieces = P.split_rows(P.vertices(A.polylines(spark, sf)), 800.0)[0]
    return pieces.select("ID", "piece", "start_idx", "end_idx", F.round("Length_m", 3).alias("length_m"))


@q("polyline_split_members", SPLIT_SQL + """SELECT c.ID, c.piece, CAST(i AS INTEGER) AS pos, Path[i][1] AS lat, Path[i][2] AS lon
FROM cut c JOIN polylines p ON p.ID = c.ID, unnest(range(c.start_idx, c.end_idx + 1)) t(i)""")
def q_polyline_split_members(spark, sf):
    members = P.split_rows(P.vertices(A.polylines(spark, sf)), 800.0)[1]
    return members.select("ID", "piece", "pos", F.col("point")[0].alias("lat"), F.col("point")[1].alias("lon"))


@q("oversized_steps", SPLIT_SQL + """SELECT ID, CAST(i - 2 AS INTEGER) AS from_idx, CAST(i - 1 AS INTEGER) AS to_idx, round(s, 3) AS length_m
FROM steps WHERE s > 800.0""")
def q_oversized_steps(spark, sf):
    return P.oversized_steps(A.polylines(spark, sf), "Path", 800.0).withColumn("length_m", F.round("length_m", 3))


@q("segment_length", S.with_(S.POLYLINES) + f"""
SELECT ID, round(sum({hav_sql('Path[i - 1]', 'Path[i]')}), 3) AS length_m FROM polylines, unnest(range(2, len(Path) + 1)) t(i) GROUP BY ID""")
def q_segment_length(spark, sf):
    return A.polylines(spark, sf).select("ID", F.round(P.segment_length("Path"), 3).alias("length_m"))


def _angle_sql():
    k = f"({3.141592653589793 / 180.0!r} * {R_M!r})"

    def xy(p, ref):
        return (f"({p}[2] * cos(radians({ref})) * {k})", f"({p}[1] * {k})")
    ref = "Path[i][1]"
    x0, y0 = xy("Path[i - 1]", ref)
    x1, y1 = xy("Path[i]", ref)
    x2, y2 = xy("Path[i + 1]", ref)
    ax, ay, bx, by = f"({x1} - {x0})", f"({y1} - {y0})", f"({x2} - {x1})", f"({y2} - {y1})"
    na, nb = f"sqrt({ax} * {ax} + {ay} * {ay})", f"sqrt({bx} * {bx} + {by} * {by})"
    return (f"CASE WHEN {na} > 0 AND {nb} > 0 THEN round(degrees(acos(greatest(-1.0, least(1.0, "
            f"({ax} * {bx} + {ay} * {by}) / ({na} * {nb}))))), 4) END")


@q("turning_angle", S.with_(S.POLYLINES) + f"""
SELECT ID, CAST(i AS INTEGER) AS pos, {_angle_sql()} AS angle FROM polylines, unnest(range(2, len(Path))) t(i)""")
def q_turning_angle(spark, sf):
    a = P.vertex_angles(A.polylines(spark, sf))
    return a.select("ID", "pos", F.round("angle", 4).alias("angle"))


@q("polyline_flip", S.with_(S.POLYLINES) + """
SELECT ID, Path[1][2] AS first_a, Path[1][1] AS first_b, len(Path) AS n FROM polylines""")
def q_polyline_flip(spark, sf):
    f = A.polylines(spark, sf).select("ID", P.polyline_flip("Path").alias("F"))
    return f.select("ID", F.col("F")[0][0].alias("first_a"), F.col("F")[0][1].alias("first_b"),
                    F.size("F").cast("bigint").alias("n"))


@q("polyline_endpoints", S.with_(S.POLYLINES) + """
SELECT ID, Path[1][1] AS first_lat, Path[len(Path)][2] AS last_lon FROM polylines""")
def q_polyline_endpoints(spark, sf):
    e = P.polyline_endpoints(A.polylines(spark, sf), "Path")
    return e.select("ID", F.col("first_point")[0].alias("first_lat"), F.col("last_point")[1].alias("last_lon"))


def _quantised(spark, sf):
    """Polylines snapped to a 0.0001-degree grid, so that points repeat within and across lines."""
    pl = A.polylines(spark, sf)
    return pl.select("ID", F.transform("Path", lambda p: F.array(F.floor(p[0] * 10000) / 10000, F.floor(p[1] * 10000) / 10000)).alias("Path"))


QUANT_SQL = S.POLYLINES + """,
quant AS (SELECT ID, list_transform(Path, lambda p: [floor(p[1] * 10000) / 10000, floor(p[2] * 10000) / 10000]) AS Path FROM polylines)"""


@q("polyline_dedupe", S.with_(QUANT_SQL) + "SELECT ID, len(list_distinct(Path)) AS n_distinct FROM quant")
def q_polyline_dedupe(spark, sf):
    return _quantised(spark, sf).select("ID", F.size(P.polyline_dedupe("Path")).cast("bigint").alias("n_distinct"))


@q("point_normalise", S.with_(S.POLYLINES) + """
SELECT ID, round(Path[1][1] * 7, 6) AS lat, round(Path[1][2] * 7, 6) AS lon, CAST(0.0 AS DOUBLE) AS z FROM polylines""")
def q_point_normalise(spark, sf):
    p = A.polylines(spark, sf).select("ID", P.point_normalise(F.array(F.col("Path")[0][0] * 7,
                                                                      F.col("Path")[0][1] * 7)).alias("p"))
    return p.select("ID", F.col("p")[0].alias("lat"), F.col("p")[1].alias("lon"), F.col("p")[2].alias("z"))


def _raw_links(spark, sf):
    lk = A.links(spark, sf)
    d, a = F.col("Coordinates")[0], F.col("Coordinates")[1]
    raw = F.when(F.col("Departure_station_id") % 2 == 0, F.array(F.array(a[1], a[0]), F.array(d[1], d[0]))) \
        .otherwise(F.array(F.array(d[1], d[0]), F.array(a[1], a[0])))
    return lk.select("Departure_station_id", "Arrival_station_id", raw.alias("Shape"),
                     (F.col("Departure_station_id") * 1000 + F.col("Arrival_station_id")).alias("ord"))


ORIENT_SQL = S.with_(S.LINKS, S.STATIONS) + """,
raw AS (SELECT l.Departure_station_id AS dep, l.Arrival_station_id AS arr,
               CASE WHEN l.Departure_station_id % 2 = 0 THEN [[a.Geo_x, a.Geo_y], [d.Geo_x, d.Geo_y]]
                    ELSE [[d.Geo_x, d.Geo_y], [a.Geo_x, a.Geo_y]] END AS sh, d.Geo_x AS sx, d.Geo_y AS sy
        FROM links l LEFT JOIN stations d ON l.Departure_station_id = d.ID
                     LEFT JOIN stations a ON l.Arrival_station_id = a.ID),
dd AS (SELECT *, CASE WHEN sh[1] = sh[2] THEN [sh[1]] ELSE sh END AS s2 FROM raw),
o AS (SELECT dep, arr, CASE WHEN pow(s2[len(s2)][1] - sx, 2) + pow(s2[len(s2)][2] - sy, 2)
                               < pow(s2[1][1] - sx, 2) + pow(s2[1][2] - sy, 2)
                            THEN list_reverse(s2) ELSE s2 END AS c FROM dd)
SELECT dep AS Departure_station_id, arr AS Arrival_station_id, c[1][1] AS first_lat, c[1][2] AS first_lon,
       c[len(c)][1] AS last_lat, len(c) AS n FROM o"""


@q("polyline_orient", ORIENT_SQL)
def q_polyline_orient(spark, sf):
    o = P.polyline_orient(_raw_links(spark, sf), A.stations(spark, sf))
    c = F.col("Coordinates")
    return o.select("Departure_station_id", "Arrival_station_id", c[0][0].alias("first_lat"),
                    c[0][1].alias("first_lon"), F.element_at(c, -1)[0].alias("last_lat"),
                    F.size(c).cast("bigint").alias("n"))


@q("polyline_replace_end", S.with_(S.LINKS, S.STATIONS) + """,
c AS (SELECT l.Departure_station_id AS dep, l.Arrival_station_id AS arr, d.Nation AS dn,
             [[d.Geo_x, d.Geo_y], [a.Geo_x, a.Geo_y]] AS sh
      FROM links l LEFT JOIN stations d ON l.Departure_station_id = d.ID LEFT JOIN stations a ON l.Arrival_station_id = a.ID)
SELECT dep AS Departure_station_id, arr AS Arrival_station_id,
       CASE WHEN dn = 3 THEN CAST(51.0 AS DOUBLE) ELSE sh[1][1] END AS first_lat,
       CASE WHEN dn = 4 THEN CAST(5.0 AS DOUBLE) ELSE sh[2][2] END AS last_lon FROM c""")
def q_replace_end(spark, sf):
    lk = A.links(spark, sf)
    st = A.stations(spark, sf)
    n = st.select(F.col("ID").alias("Departure_station_id"), "Nation")
    corr = lk.join(n, "Departure_station_id").filter(F.col("Nation").isin(3, 4)).select(
        "Departure_station_id", "Arrival_station_id", (F.col("Nation") == 3).alias("first"),
        F.when(F.col("Nation") == 3, F.lit(51.0)).otherwise(F.col("Coordinates")[1][0]).alias("lat"),
        F.when(F.col("Nation") == 3, F.col("Coordinates")[0][1]).otherwise(F.lit(5.0)).alias("lon"))
    r = P.polyline_replace_end(lk, corr)
    c = F.col("Coordinates")
    return r.select("Departure_station_id", "Arrival_station_id", c[0][0].alias("first_lat"),
                    F.element_at(c, -1)[1].alias("last_lon"))


def _assigned(spark, sf):
    return A.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("Station_ID"), F.col("l_partkey").alias("track_id"))


ASSIGNED_SQL = "assigned AS (SELECT l_suppkey AS Station_ID, l_partkey AS track_id FROM lineitem)"


@q("group_nunique_tracks", S.with_(ASSIGNED_SQL) + """
SELECT track_id, count(DISTINCT Station_ID) AS n FROM assigned GROUP BY 1 HAVING count(DISTINCT Station_ID) > 1""")
def q_group_nunique_tracks(spark, sf):
    return R.group_nunique_having(_assigned(spark, sf), "track_id", "Station_ID", 1)


MULTI_SQL = SPLIT_SQL + """,
""" + ASSIGNED_SQL + """,
multi AS (SELECT track_id FROM assigned GROUP BY 1 HAVING count(DISTINCT Station_ID) > 1),
part AS (SELECT c.ID, c.piece, c.start_idx AS s, c.end_idx AS e, Path FROM cut c JOIN polylines p ON p.ID = c.ID WHERE c.ID IN (SELECT track_id FROM multi)
         UNION ALL SELECT ID, 0, 1, len(Path), Path FROM polylines WHERE len(Path) >= 2 AND ID NOT IN (SELECT track_id FROM multi)),
num AS (SELECT *, row_number() OVER (ORDER BY ID, piece) - 1 AS k, [round(Path[s][1], 6), round(Path[s][2], 6)] AS f,
               [round(Path[e][1], 6), round(Path[e][2], 6)] AS t FROM part),
seen AS (SELECT pt, min(o) AS o FROM (SELECT f AS pt, 2 * k AS o FROM num UNION ALL SELECT t, 2 * k + 1 FROM num) GROUP BY pt),
swi AS (SELECT pt, row_number() OVER (ORDER BY o) - 1 AS SID FROM seen)
"""


@q("split_multi_station_switches", MULTI_SQL + "SELECT SID AS ID, pt[1] AS X, pt[2] AS Y FROM swi")
def q_split_multi_switches(spark, sf):
    return P.split_multi_station_tracks(A.polylines(spark, sf), _assigned(spark, sf), 800.0)[0]


@q("split_multi_station_tracks", MULTI_SQL + f"""SELECT k AS ID, a.SID AS Departure_switch, b.SID AS Arrival_switch, CAST(e - s + 1 AS INTEGER) AS n_points,
       round(list_sum(list_transform(range(s + 1, e + 1), lambda i: {hav_sql('Path[i - 1]', 'Path[i]')})), 3) AS Length_m
FROM num JOIN swi a ON a.pt = f JOIN swi b ON b.pt = t""")
def q_split_multi(spark, sf):
    sw, tr = P.split_multi_station_tracks(A.polylines(spark, sf), _assigned(spark, sf), 800.0)
    return tr.select("ID", "Departure_switch", "Arrival_switch", F.size("Path").alias("n_points"),
                     F.round("Length_m", 3).alias("Length_m"))


# ------------------------------------------------------------------ §2.10 data quality

def _perturbed_links(spark, sf):
    lk = A.links(spark, sf)
    c = F.col("Coordinates")
    first = F.array(c[0][0] + (F.col("Departure_station_id") % 3) * F.lit(0.001), c[0][1])
    return lk.withColumn("Coordinates", F.array(first, c[1]))


PERTURBED_SQL = S.LINKS + ",\n" + S.STATIONS + """,
pl AS (SELECT l.Departure_station_id, l.Arrival_station_id,
              d.Geo_x AS dx, d.Geo_y AS dy, a.Geo_x AS ax, a.Geo_y AS ay,
              d.Geo_x + (l.Departure_station_id % 3) * CAST(0.001 AS DOUBLE) AS p1x, d.Geo_y AS p1y,
              a.Geo_x AS p2x, a.Geo_y AS p2y
       FROM links l LEFT JOIN stations d ON l.Departure_station_id = d.ID
                    LEFT JOIN stations a ON l.Arrival_station_id = a.ID)"""


def _close(a, b, exact):
    return f"coalesce({a} = {b}, false)" if exact else f"coalesce(abs({a} - {b}) <= 1e-6 + 1e-5 * abs({b}), false)"


def _flags_sql(exact):
    def at(x, y, px, py):
        return f"({_close(x, px, exact)} AND {_close(y, py, exact)})"
    dep = f"({at('dx', 'dy', 'p1x', 'p1y')} OR {at('dx', 'dy', 'p2x', 'p2y')})"
    arr = f"({at('ax', 'ay', 'p1x', 'p1y')} OR {at('ax', 'ay', 'p2x', 'p2y')})"
    return f"flags AS (SELECT Departure_station_id, Arrival_station_id, {dep} AS dep_ok, {arr} AS arr_ok FROM pl)"


def _check_sql(exact):
    return (S.with_(PERTURBED_SQL, _flags_sql(exact)) +
            "SELECT count(*) AS links, count(*) FILTER (WHERE dep_ok) AS dep_ok, count(*) FILTER (WHERE arr_ok) AS arr_ok, "
            "count(*) FILTER (WHERE dep_ok AND arr_ok) AS both_ok FROM flags")


@q("check_endpoints_exact", _check_sql(True))
def q_check_exact(spark, sf):
    return Q.check_endpoints(_perturbed_links(spark, sf), A.stations(spark, sf))


@q("check_endpoints_close", _check_sql(False))
def q_check_close(spark, sf):
    return Q.check_endpoints(_perturbed_links(spark, sf), A.stations(spark, sf), atol=1e-6, rtol=1e-5)


@q("failing_endpoints", S.with_(PERTURBED_SQL, _flags_sql(False)) + """
SELECT Departure_station_id, Arrival_station_id FROM flags WHERE NOT (dep_ok AND arr_ok)""")
def q_failing(spark, sf):
    return Q.failing_endpoints(_perturbed_links(spark, sf), A.stations(spark, sf), atol=1e-6, rtol=1e-5) \
        .select("Departure_station_id", "Arrival_station_id")


def _known_stations(spark, sf):
    return A.stations(spark, sf).filter(F.col("Nation") < 20)


@q("check_station_ids", S.with_(S.LINKS, S.STATIONS) + """,
ends AS (SELECT Departure_station_id AS station FROM links UNION SELECT Arrival_station_id FROM links)
SELECT count(*) FILTER (WHERE station IN (SELECT ID FROM stations WHERE Nation < 20)) AS found, count(*) AS total,
       round(100.0 * count(*) FILTER (WHERE station IN (SELECT ID FROM stations WHERE Nation < 20)) / count(*), 4) AS ratio_pct
FROM ends""")
def q_check_ids(spark, sf):
    ratio, _ = Q.check_station_ids(A.links(spark, sf), _known_stations(spark, sf))
    return ratio


@q("missing_station_ids", S.with_(S.LINKS, S.STATIONS) + """
SELECT station FROM (SELECT Departure_station_id AS station FROM links UNION SELECT Arrival_station_id FROM links)
WHERE station NOT IN (SELECT ID FROM stations WHERE Nation < 20)""")
def q_missing_ids(spark, sf):
    _, missing = Q.check_station_ids(A.links(spark, sf), _known_stations(spark, sf))
    return missing


@q("correct_stations", S.with_(S.STATIONS) + """
SELECT CAST(ID AS INTEGER) AS ID, Name, CASE WHEN Name = 'Supplier#000000001' THEN 'FIXED' ELSE 'C' || ID END AS Code
FROM stations UNION ALL SELECT -2, 'Yard', 'CY'""")
def q_correct_stations(spark, sf):
    st = A.stations(spark, sf).select("ID", "Name", F.concat(F.lit("C"), F.col("ID").cast("string")).alias("Code"))
    new = spark.createDataFrame([(-1, "Depot", None), (-2, "Yard", "CY")], "ID long, Name string, Code string")
    fixes = spark.createDataFrame([("Supplier#000000001", "FIXED")], "Name string, Code string")
    return Q.correct_stations(st, new, fixes, "Name", "Code", "ID")


@q("station_directory", S.with_(S.LINKS, S.STATIONS) + """
SELECT DISTINCT e.ID, s.Name FROM (SELECT Departure_station_id AS ID FROM links UNION SELECT Arrival_station_id FROM links) e
LEFT JOIN (SELECT ID, Name FROM stations WHERE Nation < 20) s USING (ID)""")
def q_station_directory(spark, sf):
    return Q.station_directory(A.links(spark, sf), _known_stations(spark, sf))


@q("duplicate_keys", S.with_(S.STATIONS) + """
SELECT ID, count(*) AS count FROM (SELECT ID FROM stations UNION ALL SELECT ID FROM stations WHERE Nation = 3)
GROUP BY 1 HAVING count(*) > 1""")
def q_duplicate_keys(spark, sf):
    st = A.stations(spark, sf)
    return Q.duplicate_keys(st.select("ID").unionByName(st.filter(F.col("Nation") == 3).select("ID")))


# ------------------------------------------------------------------ §2.12 trips, timetables, delays

TRIPS_SQL = S.LEGS + """,
tl AS (SELECT TRAIN_NO, REAL_DATE_DEP, sumo_time AS t, SEQ, departure_station AS dep, arrival_station AS arr FROM legs),
tk AS (SELECT TRAIN_NO, REAL_DATE_DEP, min(t) AS t0 FROM tl GROUP BY 1, 2 HAVING count(*) >= 2),
trips AS (SELECT TRAIN_NO, REAL_DATE_DEP, t0, row_number() OVER (ORDER BY t0, TRAIN_NO, REAL_DATE_DEP) - 1 AS trip_id
          FROM tk),
tlegs AS (SELECT tr.trip_id, tl.*, row_number() OVER (PARTITION BY tr.trip_id ORDER BY tl.t, tl.SEQ, tl.dep, tl.arr) AS p
          FROM tl JOIN trips tr USING (TRAIN_NO, REAL_DATE_DEP))"""


def leg_str_sql(alias=""):
    a = f"{alias}." if alias else ""
    return f"coalesce(CAST({a}dep AS VARCHAR), 'null') || '-' || coalesce(CAST({a}arr AS VARCHAR), 'null') || '@' || {a}t"


def legs_str(col="legs"):
    return F.array_join(F.transform(col, lambda x: F.concat(
        F.coalesce(x["dep"].cast("string"), F.lit("null")), F.lit("-"),
        F.coalesce(x["arr"].cast("string"), F.lit("null")), F.lit("@"), x["t"].cast("string"))), " ")


def trips_df(spark, sf):
    return T.build_trips(A.legs(spark, sf), A.STOP_KEY, tie=("SEQ",))


@q("build_trips", S.with_(TRIPS_SQL) + f"""
SELECT TRAIN_NO, REAL_DATE_DEP, trip_id, string_agg({leg_str_sql()}, ' ' ORDER BY p) AS legs
FROM tlegs GROUP BY 1, 2, 3""")
def q_build_trips(spark, sf):
    return trips_df(spark, sf).select("TRAIN_NO", "REAL_DATE_DEP", "trip_id", legs_str().alias("legs"))


@q("group_change_trips", S.with_(S.LEGS) + """
SELECT TRAIN_NO, REAL_DATE_DEP, count(*) AS n_legs FROM legs GROUP BY 1, 2 HAVING count(*) >= 2""")
def q_group_change(spark, sf):
    t = trips_df(spark, sf)
    return t.select("TRAIN_NO", "REAL_DATE_DEP", F.size("legs").cast("long").alias("n_legs"))


@q("sort_legs", S.with_(TRIPS_SQL) + "SELECT trip_id, t0 FROM trips ORDER BY t0")
def q_sort_legs(spark, sf):
    return trips_df(spark, sf).select("trip_id", F.col("legs")[0]["t"].alias("t0")).orderBy("t0", "trip_id")


ALLOWED_SQL = "allowed AS (SELECT s_suppkey AS station FROM supplier WHERE s_nationkey < 12)"

CLEAN_SQL = "WITH RECURSIVE " + TRIPS_SQL + ",\n" + ALLOWED_SQL + """,
fl AS (SELECT trip_id, t, SEQ, dep, arr, row_number() OVER (PARTITION BY trip_id ORDER BY p) AS p FROM tlegs
       WHERE dep IN (SELECT station FROM allowed) AND arr IN (SELECT station FROM allowed)),
rec AS (SELECT trip_id, p, dep AS ld, arr AS la, true AS kept, dep, arr, t FROM fl WHERE p = 1
        UNION ALL
        SELECT r.trip_id, f.p,
               CASE WHEN r.ld <> f.dep AND r.la <> f.arr AND r.la = f.dep THEN f.dep ELSE r.ld END,
               CASE WHEN r.ld <> f.dep AND r.la <> f.arr AND r.la = f.dep THEN f.arr ELSE r.la END,
               r.ld <> f.dep AND r.la <> f.arr AND r.la = f.dep, f.dep, f.arr, f.t
        FROM rec r JOIN fl f ON f.trip_id = r.trip_id AND f.p = r.p + 1),
cleaned AS (SELECT trip_id, p, dep, arr, t FROM rec WHERE kept)"""


def cleaned_trips(spark, sf):
    allowed = A.table(spark, sf, "supplier").filter(F.col("s_nationkey") < 12).select(F.col("s_suppkey").alias("ID"))
    return T.clean_legs(trips_df(spark, sf), allowed, "ID")


def cleaned_rows(spark, sf):
    """The cleaned legs in rows, written once."""
    allowed = A.table(spark, sf, "supplier").filter(F.col("s_nationkey") < 12).select(F.col("s_suppkey").alias("ID"))
    return GR.materialise_input(T.clean_legs_long(trip_legs_df(spark, sf), allowed))


@q("clean_legs", CLEAN_SQL + f"""
SELECT trip_id, string_agg({leg_str_sql()}, ' ' ORDER BY p) AS legs FROM cleaned GROUP BY 1""")
def q_clean_legs(spark, sf):
    return cleaned_trips(spark, sf).select("trip_id", legs_str().alias("legs"))


MEAN_SQL = "WITH RECURSIVE " + TRIPS_SQL + """,
ml AS (SELECT trip_id, CAST(t AS DOUBLE) AS t, dep, arr, row_number() OVER (PARTITION BY trip_id ORDER BY p) AS p
       FROM tlegs WHERE dep IS NOT NULL AND arr IS NOT NULL),
rec AS (SELECT trip_id, p, t, dep, arr, 1 AS grp FROM ml WHERE p = 1
        UNION ALL
        SELECT r.trip_id, f.p, CASE WHEN r.dep = f.dep OR r.arr = f.arr THEN (r.t + f.t) / 2 ELSE f.t END,
               CASE WHEN r.dep = f.dep OR r.arr = f.arr THEN r.dep ELSE f.dep END,
               CASE WHEN r.dep = f.dep OR r.arr = f.arr THEN r.arr ELSE f.arr END,
               r.grp + CASE WHEN r.dep = f.dep OR r.arr = f.arr THEN 0 ELSE 1 END
        FROM rec r JOIN ml f ON f.trip_id = r.trip_id AND f.p = r.p + 1),
merged AS (SELECT trip_id, grp, dep, arr, arg_max(t, p) AS t FROM rec GROUP BY 1, 2, 3, 4)
"""


@q("merge_legs_long", MEAN_SQL + "SELECT trip_id, round(t, 6) AS t, dep, arr FROM merged")
def q_merge_legs_long(spark, sf):
    return T.merge_legs_long(trip_legs_df(spark, sf)).select("trip_id", F.round("t", 6).alias("t"), "dep", "arr")


@q("clean_legs_mean", MEAN_SQL + """SELECT trip_id, CAST(count(*) AS INTEGER) AS n_legs, arg_min(t, grp) AS t0 FROM merged GROUP BY 1""")
def q_clean_legs_mean(spark, sf):
    c = T.clean_legs(trips_df(spark, sf), None, merge="mean")
    return c.select("trip_id", F.size("legs").alias("n_legs"), F.col("legs")[0]["t"].alias("t0"))


@q("od_per_trip", CLEAN_SQL + """,
ends AS (SELECT trip_id, arg_min(t, p) AS depart, arg_min(dep || '_' || arr, p) AS from_edge,
                arg_max(dep || '_' || arr, p) AS to_edge FROM cleaned GROUP BY 1)
SELECT 'trip_' || (row_number() OVER (ORDER BY depart, trip_id) - 1) AS id, depart, from_edge, to_edge, trip_id
FROM ends""")
def q_od(spark, sf):
    return T.od_rows(cleaned_rows(spark, sf))


@q("route_edges", CLEAN_SQL + """
SELECT trip_id, CAST(arg_min(t, p) AS DOUBLE) AS depart, string_agg(dep || '_' || arr, ' ' ORDER BY p) AS edges,
       coalesce(string_agg(CASE WHEN p > 1 THEN dep || '->' || arr END, ' ' ORDER BY p), '') AS stops
FROM (SELECT trip_id, dep, arr, t, row_number() OVER (PARTITION BY trip_id ORDER BY p) AS p FROM cleaned) GROUP BY 1""")
def q_route_edges(spark, sf):
    r = T.gather_routes(T.route_rows(cleaned_rows(spark, sf)))
    return r.select("trip_id", "depart", "edges",
                    F.array_join(F.transform("stops", lambda s: s["trainStop"]), " ").alias("stops"))


def _subnetwork(spark, sf):
    sn = A.stop_log_next(spark, sf).withColumnRenamed("NEXT_STOP", "NEXT_STOPPING_PLACE_ID")
    return T.select_subnetwork(A.stations(spark, sf), A.links(spark, sf), sn, seeds(spark, sf),
                               "1996-01-01 00:00:00", "1996-01-06 00:00:00")


@q("select_subnetwork", S.with_(S.STOP_NEXT, SEEDS_SQL) + """
SELECT TRAIN_NO, SEQ, PART, STOPPING_PLACE_ID FROM stop_next
WHERE PLANNED_DATETIME_DEP BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-01-06 00:00:00'
  AND (STOPPING_PLACE_ID IN (SELECT station FROM seeds) OR NEXT_STOP IN (SELECT station FROM seeds))""")
def q_subnetwork(spark, sf):
    return _subnetwork(spark, sf)[2].select("TRAIN_NO", "SEQ", "PART", "STOPPING_PLACE_ID")


@q("subnetwork_stations", S.with_(S.LINKS, S.STATIONS, SEEDS_SQL) + """
SELECT ID FROM stations WHERE ID IN (SELECT station FROM seeds)
   OR ID IN (SELECT Arrival_station_id FROM links WHERE Departure_station_id IN (SELECT station FROM seeds))""")
def q_subnetwork_stations(spark, sf):
    return _subnetwork(spark, sf)[0].select("ID")


@q("subnetwork_links", S.with_(S.LINKS, SEEDS_SQL) + """
SELECT Departure_station_id, Arrival_station_id FROM links
WHERE Departure_station_id IN (SELECT station FROM seeds) OR Arrival_station_id IN (SELECT station FROM seeds)""")
def q_subnetwork_links(spark, sf):
    return _subnetwork(spark, sf)[1].select("Departure_station_id", "Arrival_station_id")


RELSEQ_SQL = S.STOP_LOG + """,
s AS (SELECT o_custkey AS relation, STOPPING_PLACE_ID AS stop, TRAIN_NO, REAL_DATE_DEP, PLANNED_DATETIME_DEP, SEQ, PART
      FROM stop_log JOIN orders ON TRAIN_NO = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY TRAIN_NO, REAL_DATE_DEP, PLANNED_DATETIME_DEP, SEQ,
                                                                   stop, PART) AS rn FROM s),
f AS (SELECT relation, stop, min(rn) AS frn FROM r GROUP BY 1, 2),
cut AS (SELECT r.relation, min(r.rn) AS c FROM r JOIN f USING (relation, stop) WHERE r.rn > f.frn GROUP BY 1),
seq AS (SELECT f.relation, CAST(row_number() OVER (PARTITION BY f.relation ORDER BY f.frn) AS INTEGER) AS pos, f.stop
        FROM f LEFT JOIN cut USING (relation) WHERE cut.c IS NULL OR f.frn < cut.c)"""


def relation_stops(spark, sf):
    sl = A.stop_log(spark, sf)
    o = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("TRAIN_NO"), F.col("o_custkey").alias("RELATION"))
    return sl.join(o, "TRAIN_NO")


def relation_seq(spark, sf):
    return T.relation_stop_sequence(relation_stops(spark, sf), "RELATION", "STOPPING_PLACE_ID",
                                    ("TRAIN_NO", "REAL_DATE_DEP", "PLANNED_DATETIME_DEP", "SEQ", "STOPPING_PLACE_ID",
                                     "PART"))


@q("relation_stop_sequence", S.with_(RELSEQ_SQL) + "SELECT relation, pos, stop FROM seq")
def q_relation_seq(spark, sf):
    return relation_seq(spark, sf)


@q("restrict_stop_sequence", S.with_(RELSEQ_SQL, ALLOWED_SQL) + """,
k AS (SELECT relation, stop, CAST(row_number() OVER (PARTITION BY relation ORDER BY pos) AS INTEGER) AS pos FROM seq
      WHERE stop IN (SELECT station FROM allowed))
SELECT relation, pos, stop FROM k WHERE relation IN (SELECT relation FROM k GROUP BY 1 HAVING count(*) >= 2)""")
def q_restrict_seq(spark, sf):
    keep = A.table(spark, sf, "supplier").filter(F.col("s_nationkey") < 12).select(F.col("s_suppkey").alias("Station_ID"))
    return T.restrict_stop_sequence(relation_seq(spark, sf), keep)


@q("station_pair_requests", S.with_(RELSEQ_SQL) + """,
net AS (SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey, make_date(year(l_shipdate), 1, 1)
                                                     ORDER BY l_shipdate, l_linenumber, l_suppkey, l_partkey) AS b FROM lineitem),
lk AS (SELECT s.stop AS a, n.stop AS b FROM seq s JOIN seq n ON s.relation = n.relation AND n.pos = s.pos + 1
       UNION ALL SELECT a, b FROM net WHERE b IS NOT NULL AND a IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)),
p AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk)
SELECT DISTINCT a, b FROM p""")
def q_pair_requests(spark, sf):
    """Neighbours by the links from one country's stations and by the relations' stop sequences."""
    links = A.links(spark, sf).join(seeds(spark, sf).withColumnRenamed("station", "Departure_station_id"), "Departure_station_id", "left_semi")
    return T.station_pair_requests(links, relation_seq(spark, sf))


@q("periodic_trips", """
WITH pairs AS (SELECT n_nationkey AS src, n_regionkey AS dst, n_nationkey * 250 AS "offset" FROM nation),
g AS (SELECT src, dst, "offset", unnest(generate_series(CAST("offset" AS BIGINT), CAST(5000 AS BIGINT), CAST(1000 AS BIGINT))) AS depart
      FROM pairs WHERE "offset" <= 5000)
SELECT src AS from_station, dst AS to_station, depart, row_number() OVER (ORDER BY src, dst, "offset", depart) AS trip_id
FROM g""")
def q_periodic(spark, sf):
    n = A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"),
                                            (F.col("n_nationkey") * 250).alias("offset"))
    return T.periodic_trips(n, end=10000, headway=1000, tail=5000)


SCHED_SQL = CLEAN_SQL + """,
routes AS (SELECT trip_id AS vehicle, arg_min(t, p) AS depart, list(dep || '_' || arr ORDER BY p) AS edges
           FROM cleaned GROUP BY 1),
ex AS (SELECT vehicle, depart, unnest(edges) AS edge, unnest(range(0, len(edges))) AS pos FROM routes),
e AS (SELECT Departure_station_id || '_' || Arrival_station_id AS edge, Distance * 1000 AS len,
             CAST(10 + Departure_station_id % 20 AS DOUBLE) AS spd FROM links),
j AS (SELECT ex.*, CASE WHEN pos > 0 AND e.len IS NOT NULL THEN floor(e.len / least(e.spd, 25.0)) ELSE 0 END AS tr
      FROM ex LEFT JOIN e USING (edge))
SELECT vehicle, CAST(pos AS INTEGER) AS pos, edge,
       depart + 60 * (pos + 1) + sum(tr) OVER (PARTITION BY vehicle ORDER BY pos
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS departure FROM j"""


def _sched_sql(columns: str, join: str = "") -> str:
    sql = SCHED_SQL.replace("WITH RECURSIVE " + S.LEGS, "WITH RECURSIVE " + S.LINKS, 1)
    head, tail = sql.rsplit("SELECT vehicle,", 1)
    return head.rstrip() + ",\nsched AS (SELECT vehicle," + tail + f")\nSELECT {columns} FROM sched{join}"


@q("schedule_rows", _sched_sql("vehicle, pos, sched.edge, split_part(sched.edge, '_', 1) || '_platform_' || k AS platform, departure", """
JOIN (SELECT Departure_station_id || '_' || Arrival_station_id AS edge, row_number() OVER (PARTITION BY Departure_station_id
             ORDER BY CAST(Arrival_station_id AS VARCHAR), Arrival_station_id) AS k FROM links) USING (edge)"""))
def q_schedule_rows(spark, sf):
    edges = A.links(spark, sf).select(F.col("Departure_station_id").alias("src"), F.col("Arrival_station_id").alias("dst"), (F.col("Distance") * 1000).alias("length"),
                                      (F.lit(10) + F.col("Departure_station_id") % 20).cast("double").alias("speed"))
    r = T.schedule_rows(cleaned_rows(spark, sf), edges, vmax=25.0)
    return r.withColumnRenamed("trip_id", "vehicle").withColumn("pos", F.col("pos").cast("int"))


@q("schedule_propagate", SCHED_SQL.replace("WITH RECURSIVE " + S.LEGS, "WITH RECURSIVE " + S.LINKS, 1))
def q_schedule(spark, sf):
    routes = T.gather_routes(T.route_rows(cleaned_rows(spark, sf))).withColumnRenamed("trip_id", "vehicle")
    lk = A.links(spark, sf)
    edges = lk.select(F.concat_ws("_", "Departure_station_id", "Arrival_station_id").alias("id"),
                      (F.col("Distance") * 1000).alias("length"),
                      (F.lit(10) + F.col("Departure_station_id") % 20).cast("double").alias("speed"))
    return T.schedule_propagate(routes, edges, vmax=25.0)


@q("chain_delay_series", S.with_(S.STOP_NEXT, S.STATIONS) + """,
chain AS (SELECT CAST(row_number() OVER (ORDER BY ID) AS INTEGER) AS pos, ID AS station, Name FROM stations WHERE Nation = 3),
cl AS (SELECT c.pos, c.station AS a, n.station AS b, c.Name || ' - ' || n.Name AS link FROM chain c JOIN chain n ON n.pos = c.pos + 1)
SELECT cl.pos AS link_pos, cl.link, strftime(s.PLANNED_DATETIME_DEP, '%Y-%m-%d') AS scheduled_arrival_time,
       s.DELAY_ARR AS delay_arrival
FROM stop_next s JOIN cl ON s.STOPPING_PLACE_ID = cl.a AND s.NEXT_STOP = cl.b""")
def q_chain_delay(spark, sf):
    from pyspark.sql import Window
    st = A.stations(spark, sf)
    chain = st.filter(F.col("Nation") == 3).select(F.row_number().over(Window.orderBy("ID")).alias("pos"),
                                                   F.col("ID").alias("station"))
    sn = A.stop_log_next(spark, sf).select(
        F.col("STOPPING_PLACE_ID").alias("station"), F.col("NEXT_STOP").alias("next_station"),
        F.date_format("PLANNED_DATETIME_DEP", "yyyy-MM-dd").alias("scheduled_arrival_time"),
        F.col("DELAY_ARR").alias("delay_arrival"))
    return T.chain_delay_series(sn, st, chain)


# ------------------------------------------------------------------ §2.11 graphs

from railspark.operators import graph as GR  # noqa: E402


def _qgraph(spark, sf):
    return GR.polyline_graph(_quantised(spark, sf), "Path")


QEDGES_SQL = QUANT_SQL + """,
qp AS (SELECT ID, i, Path[i] AS a, Path[i + 1] AS b FROM quant, unnest(range(1, len(Path))) t(i)),
qe AS (SELECT DISTINCT CAST(round(a[1] * 1000000) AS BIGINT) AS ulat, CAST(round(a[2] * 1000000) AS BIGINT) AS ulon,
                       CAST(round(b[1] * 1000000) AS BIGINT) AS vlat, CAST(round(b[2] * 1000000) AS BIGINT) AS vlon
       FROM qp WHERE a <> b),
gedges AS (SELECT ulat, ulon, vlat, vlon FROM qe UNION SELECT vlat, vlon, ulat, ulon FROM qe)"""


def _edge_cols(e):
    return e.select(F.col("u.klat").alias("ulat"), F.col("u.klon").alias("ulon"), F.col("v.klat").alias("vlat"),
                    F.col("v.klon").alias("vlon"))


@q("polyline_graph", S.with_(QEDGES_SQL) + "SELECT * FROM gedges")
def q_polyline_graph(spark, sf):
    return _edge_cols(_qgraph(spark, sf)[0])


@q("endpoint_graph", S.with_(S.POLYLINES) + """,
ee AS (SELECT CAST(round(round(Path[1][1], 6) * 1000000) AS BIGINT) AS ulat,
              CAST(round(round(Path[1][2], 6) * 1000000) AS BIGINT) AS ulon,
              CAST(round(round(Path[len(Path)][1], 6) * 1000000) AS BIGINT) AS vlat,
              CAST(round(round(Path[len(Path)][2], 6) * 1000000) AS BIGINT) AS vlon FROM polylines)
SELECT DISTINCT * FROM (SELECT * FROM ee UNION ALL SELECT vlat, vlon, ulat, ulon FROM ee)""")
def q_endpoint_graph(spark, sf):
    return _edge_cols(GR.endpoint_graph(A.polylines(spark, sf), "Path"))


@q("node_degree", S.with_(QEDGES_SQL) + """
SELECT ulat, ulon, count(DISTINCT (vlat, vlon)) AS degree FROM gedges GROUP BY 1, 2""")
def q_node_degree(spark, sf):
    d = GR.node_degree(_qgraph(spark, sf)[0])
    return d.select(F.col("node.klat").alias("ulat"), F.col("node.klon").alias("ulon"), "degree")


@q("degree_histogram", S.with_(QEDGES_SQL) + """,
deg AS (SELECT ulat, ulon, count(DISTINCT (vlat, vlon)) AS degree FROM gedges GROUP BY 1, 2),
b AS (SELECT CASE WHEN degree > 4 THEN '>4' ELSE CAST(degree AS VARCHAR) END AS bucket, count(*) AS nodes FROM deg GROUP BY 1),
labels AS (SELECT * FROM (VALUES ('0', 0), ('1', 1), ('2', 2), ('3', 3), ('4', 4), ('>4', 5)) t(bucket, bucket_order))
SELECT labels.bucket, CAST(labels.bucket_order AS INTEGER) AS bucket_order, CAST(coalesce(b.nodes, 0) AS BIGINT) AS nodes,
       round(100.0 * coalesce(b.nodes, 0) / sum(coalesce(b.nodes, 0)) OVER (), 4) AS pct
FROM labels LEFT JOIN b USING (bucket)""")
def q_degree_histogram(spark, sf):
    return R.degree_histogram(GR.node_degree(_qgraph(spark, sf)[0]))


def _node_txt(c):
    return F.concat_ws(":", F.col(c)["klat"].cast("string"), F.col(c)["klon"].cast("string"))


def _turn_sql(p0: str, p1: str, p2: str) -> str:
    """DuckDB twin of ``turning_angle`` on [lat, lon] list expressions."""
    k = f"({3.141592653589793 / 180.0!r} * {R_M!r})"
    ref = f"{p1}[1]"

    def xy(p):
        return (f"({p}[2] * cos(radians({ref})) * {k})", f"({p}[1] * {k})")
    (x0, y0), (x1, y1), (x2, y2) = xy(p0), xy(p1), xy(p2)
    ax, ay, bx, by = f"({x1} - {x0})", f"({y1} - {y0})", f"({x2} - {x1})", f"({y2} - {y1})"
    na, nb = f"sqrt({ax} * {ax} + {ay} * {ay})", f"sqrt({bx} * {bx} + {by} * {by})"
    return (f"CASE WHEN {na} > 0 AND {nb} > 0 THEN degrees(acos(greatest(-1.0, least(1.0, "
            f"({ax} * {bx} + {ay} * {by}) / ({na} * {nb}))))) END")


CHAINS_SQL = "WITH RECURSIVE " + QUANT_SQL + """,
qp AS (SELECT Path[i] AS a, Path[i + 1] AS b FROM quant, unnest(range(1, len(Path))) t(i)),
pts AS (SELECT [round(a[1], 6), round(a[2], 6)] AS pa, [round(b[1], 6), round(b[2], 6)] AS pb FROM qp),
ke AS (SELECT CAST(round(pa[1] * 1000000) AS BIGINT) AS ulat, CAST(round(pa[2] * 1000000) AS BIGINT) AS ulon, pa,
              CAST(round(pb[1] * 1000000) AS BIGINT) AS vlat, CAST(round(pb[2] * 1000000) AS BIGINT) AS vlon, pb
       FROM pts WHERE pa <> pb),
e1 AS (SELECT ulat, ulon, vlat, vlon FROM ke UNION SELECT vlat, vlon, ulat, ulon FROM ke),
nodes AS (SELECT klat, klon, min(p) AS p FROM (SELECT ulat AS klat, ulon AS klon, pa AS p FROM ke
                                               UNION ALL SELECT vlat, vlon, pb FROM ke) GROUP BY 1, 2),
deg AS (SELECT ulat, ulon, count(*) AS degree, min((vlat, vlon)) AS n1, max((vlat, vlon)) AS n2 FROM e1 GROUP BY 1, 2),
info AS (SELECT d.ulat, d.ulon, d.degree, d.n1, d.n2,
                d.degree <> 2 OR coalesce(""" + _turn_sql("a.p", "c.p", "b.p") + """ > 45.0, true) AS cut
         FROM deg d JOIN nodes c ON c.klat = d.ulat AND c.klon = d.ulon
                    JOIN nodes a ON a.klat = d.n1[1] AND a.klon = d.n1[2]
                    JOIN nodes b ON b.klat = d.n2[1] AND b.klon = d.n2[2]),
walk AS (
  SELECT e.ulat AS slat, e.ulon AS slon, e.ulat AS plat, e.ulon AS plon, e.vlat AS clat, e.vlon AS clon, 1 AS n,
         [(e.ulat, e.ulon), (e.vlat, e.vlon)] AS path
  FROM e1 e JOIN info i ON i.ulat = e.ulat AND i.ulon = e.ulon WHERE i.cut
  UNION ALL
  SELECT w.slat, w.slon, w.clat, w.clon,
         CASE WHEN i.n1 = (w.plat, w.plon) THEN i.n2[1] ELSE i.n1[1] END,
         CASE WHEN i.n1 = (w.plat, w.plon) THEN i.n2[2] ELSE i.n1[2] END, w.n + 1,
         list_append(w.path, CASE WHEN i.n1 = (w.plat, w.plon) THEN i.n2 ELSE i.n1 END)
  FROM walk w JOIN info i ON i.ulat = w.clat AND i.ulon = w.clon WHERE NOT i.cut),
chains AS (SELECT w.* FROM walk w JOIN info i ON i.ulat = w.clat AND i.ulon = w.clon WHERE i.cut),
canon AS (SELECT (slat, slon) AS s, (clat, clon) AS e, n, path FROM chains
          WHERE (slat, slon) < (clat, clon) OR ((slat, slon) = (clat, clon) AND path[2] <= path[len(path) - 1]))
"""


def _pt(x: str) -> str:
    """A point key as text in DuckDB."""
    return f"{x}[1] || ':' || {x}[2]"


@q("contract_chains", CHAINS_SQL + f"""SELECT {_pt('path[1]')} AS start, {_pt('path[2]')} AS first, CAST(i - 1 AS BIGINT) AS pos, {_pt('path[i]')} AS node
FROM canon, unnest(range(1, len(path) + 1)) t(i)""")
def q_contract_chains(spark, sf):
    e, n = _qgraph(spark, sf)
    return GR.contract_chains(e, n, 45.0)[1].select(_node_txt("start").alias("start"), _node_txt("first").alias("first"), "pos",
                                                    _node_txt("node").alias("node"))


@q("contract_chains_ends", CHAINS_SQL + f"""SELECT {_pt('s')} AS start, {_pt('path[2]')} AS first, {_pt('e')} AS "end", {_pt('path[len(path) - 1]')} AS last,
       CAST(n AS BIGINT) AS n_edges FROM canon""")
def q_contract_chains_ends(spark, sf):
    e, n = _qgraph(spark, sf)
    return GR.contract_chains(e, n, 45.0)[0].select(*[_node_txt(c).alias(c) for c in ("start", "first", "end", "last")], "n_edges")


CIRCULAR_SQL = S.with_(S.POLYLINES) + """,
r AS (SELECT ID, i, ID * 1000 + (i * 13) % 997 AS node, len(Path) AS n FROM polylines, unnest(range(0, len(Path))) t(i) WHERE Label <> 0),
m AS (SELECT ID, min(node) AS cycle, arg_min(i, node) AS k FROM r GROUP BY ID),
d AS (SELECT m.*, a.node < b.node AS up FROM m JOIN r a ON a.ID = m.ID AND a.i = (m.k + 1) % a.n
                                                 JOIN r b ON b.ID = m.ID AND b.i = (m.k + b.n - 1) % b.n)
SELECT cycle, CASE WHEN up THEN (i - k + n) % n ELSE (k - i + n) % n END AS pos, node FROM r JOIN d USING (ID)"""


@q("pure_cycles", CIRCULAR_SQL)
def q_pure_cycles(spark, sf):
    """Every polyline as a line of stops; those with a label other than 0 run in a circle."""
    p = A.polylines(spark, sf).select("ID", "Label", F.size("Path").alias("n"))
    node = lambda i: F.col("ID") * 1000 + (i * 13) % 997
    e = p.select("ID", "Label", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")) \
        .filter((F.col("i") < F.col("n") - 1) | (F.col("Label") != 0)) \
        .select(node(F.col("i")).alias("u"), node((F.col("i") + 1) % F.col("n")).alias("v"))
    return GR.pure_cycles(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))


@q("pure_cycles_snapped")
def q_pure_cycles_snapped(spark, sf):
    e, _ = _qgraph(spark, sf)
    return GR.pure_cycles(e).select(_node_txt("cycle").alias("cycle"), "pos", _node_txt("node").alias("node"))


SIMPLIFIED_SQL = CHAINS_SQL + """,
tr AS (SELECT *, row_number() OVER (ORDER BY s, e, path[2]) - 1 AS ID FROM canon WHERE s <> e),
ends AS (SELECT s AS node, ID, 0 AS side FROM tr UNION ALL SELECT e, ID, 1 FROM tr),
sw AS (SELECT node, row_number() OVER (ORDER BY min((ID, side))) - 1 AS SID FROM ends GROUP BY node)
"""


@q("simplified_graph", SIMPLIFIED_SQL + f"""SELECT tr.ID, a.SID AS Departure_switch, b.SID AS Arrival_switch, CAST(tr.n AS BIGINT) AS n_edges,
       {_pt('s')} AS start, {_pt('path[2]')} AS first
FROM tr JOIN sw a ON a.node = tr.s JOIN sw b ON b.node = tr.e""")
def q_simplified_graph(spark, sf):
    e, n = _qgraph(spark, sf)
    tracks = GR.simplified_graph(GR.contract_chains(e, n, 45.0)[0], n)[1]
    return tracks.withColumns({c: _node_txt(c) for c in ("start", "first")})


@q("simplified_switches", SIMPLIFIED_SQL + f"""SELECT SID AS ID, p[1] AS X, p[2] AS Y, {_pt('node')} AS node
FROM sw JOIN nodes ON klat = node[1] AND klon = node[2]""")
def q_simplified_switches(spark, sf):
    e, n = _qgraph(spark, sf)
    return GR.simplified_graph(GR.contract_chains(e, n, 45.0)[0], n)[0].withColumn("node", _node_txt("node"))


@q("line_graph", S.with_(S.LINKS) + """,
u AS (SELECT least(Departure_station_id, Arrival_station_id) AS a, greatest(Departure_station_id, Arrival_station_id) AS b,
             min(Distance) AS length FROM links GROUP BY 1, 2)
SELECT DISTINCT edge, node, weight FROM (
  SELECT a || '-' || b AS edge, a AS node, length AS weight FROM u
  UNION ALL SELECT a || '-' || b, b, length FROM u)""")
def q_line_graph(spark, sf):
    lk = A.links(spark, sf)
    u = lk.groupBy(F.least("Departure_station_id", "Arrival_station_id").alias("a"),
                   F.greatest("Departure_station_id", "Arrival_station_id").alias("b")) \
        .agg(F.min("Distance").alias("length")).withColumn("id", F.concat_ws("-", "a", "b"))
    return GR.line_graph(u)


SP_SQL = S.LINKS + """,
e AS (SELECT Departure_station_id AS src, Arrival_station_id AS dst, Distance AS w FROM links),
srcs AS (SELECT s_suppkey AS station FROM supplier WHERE s_nationkey = 3)"""


SP_SEARCH_SQL = "WITH RECURSIVE " + SP_SQL + """,
sp(source, node, cost, hops, pred) USING KEY (source, node) AS (
  SELECT station, station, CAST(0.0 AS DOUBLE), 0, CAST(NULL AS BIGINT) FROM srcs
  UNION
  (SELECT c.source, c.node, c.cost, c.hops, c.pred FROM (
     SELECT sp.source, e.dst AS node, arg_min(sp.cost + e.w, (sp.cost + e.w, sp.hops + 1, sp.node)) AS cost,
            arg_min(sp.hops + 1, (sp.cost + e.w, sp.hops + 1, sp.node)) AS hops,
            arg_min(sp.node, (sp.cost + e.w, sp.hops + 1, sp.node)) AS pred
     FROM sp JOIN e ON e.src = sp.node GROUP BY 1, 2) c
   LEFT JOIN recurring.sp cur ON cur.source = c.source AND cur.node = c.node
   WHERE cur.node IS NULL OR (c.cost, c.hops, c.pred) < (cur.cost, cur.hops, cur.pred)))"""


#: Stations of one country where a train starts, with the stations of another where it ends.
OD_SQL = """od AS (SELECT DISTINCT o.ID AS a, d.ID AS b FROM (
         SELECT arg_min(STOPPING_PLACE_ID, (PLANNED_DATETIME_DEP, SEQ, STOPPING_PLACE_ID, PART)) AS f,
                arg_max(STOPPING_PLACE_ID, (PLANNED_DATETIME_DEP, SEQ, STOPPING_PLACE_ID, PART)) AS t
         FROM stop_log GROUP BY TRAIN_NO, REAL_DATE_DEP) x
       JOIN stations o ON o.ID = f AND o.Nation = 3 JOIN stations d ON d.ID = t AND d.Nation = 8)"""


def _od_requests(spark, sf):
    order = F.struct(*A.STOP_ORDER)
    od = A.stop_log(spark, sf).groupBy(*A.STOP_KEY).agg(F.min_by("STOPPING_PLACE_ID", order).alias("a"), F.max_by("STOPPING_PLACE_ID", order).alias("b"))
    st = A.stations(spark, sf).select("ID", "Nation")
    return od.join(st.filter("Nation = 3").select(F.col("ID").alias("a")), "a", "left_semi") \
        .join(st.filter("Nation = 8").select(F.col("ID").alias("b")), "b", "left_semi").select("a", "b").distinct()


def _network(spark, sf):
    return A.links(spark, sf).select(F.col("Departure_station_id").alias("src"), F.col("Arrival_station_id").alias("dst"),
                                     F.col("Distance").alias("w"))


@q("shortest_paths", SP_SEARCH_SQL + """
SELECT source, node, round(cost, 6) AS cost, CAST(hops AS INTEGER) AS hops, pred FROM sp""")
def q_shortest_paths(spark, sf):
    b = GR.shortest_paths(_network(spark, sf), seeds(spark, sf))
    return b.select("source", "node", F.round("cost", 6).alias("cost"), "hops", "pred")


@q("shortest_path_pairs", SP_SEARCH_SQL + """,
""" + S.STATIONS + """,
""" + OD_SQL + """,
req AS (SELECT a AS source, b AS node FROM od),
walk AS (SELECT r.source, r.node, r.node AS pos, [r.node] AS path FROM req r
         UNION ALL SELECT w.source, w.node, sp.pred, list_prepend(sp.pred, w.path)
         FROM walk w JOIN sp ON sp.source = w.source AND sp.node = w.pos WHERE sp.pred IS NOT NULL)
SELECT sp.source AS a, sp.node AS b, round(sp.cost, 6) AS cost, CAST(sp.hops AS INTEGER) AS hops, array_to_string(w.path, ',') AS path
FROM sp JOIN walk w ON w.source = sp.source AND w.node = sp.node AND w.pos = sp.source""")
def q_shortest_path_pairs(spark, sf):
    r = GR.shortest_path_pairs(_network(spark, sf), _od_requests(spark, sf))
    return r.select("a", "b", F.round("cost", 6).alias("cost"), "hops", F.array_join("path", ",").alias("path"))


@q("platform_paths", "WITH RECURSIVE " + S.LINKS + ",\n" + S.STATIONS + """,
u AS (SELECT least(d.ID, r.ID) AS a, greatest(d.ID, r.ID) AS b, CAST(round(min(Distance) * 1000) AS BIGINT) AS length
      FROM links l JOIN stations d ON d.ID = l.Departure_station_id JOIN stations r ON r.ID = l.Arrival_station_id
      WHERE abs(d.Nation - r.Nation) <= 1 AND d.ID <> r.ID GROUP BY 1, 2),
inc AS (SELECT a || '-' || b AS edge, a AS node, length AS weight FROM u UNION ALL SELECT a || '-' || b, b, length FROM u),
adj AS (SELECT x.edge, y.edge AS nxt, min(y.weight) AS weight FROM inc x JOIN inc y ON x.node = y.node AND x.edge <> y.edge GROUP BY 1, 2),
plat AS (SELECT node AS station, edge AS track FROM (SELECT node, edge, row_number() OVER (PARTITION BY node ORDER BY edge) AS k FROM inc)
         WHERE k <= 2 AND edge IN (SELECT edge FROM adj)),
""" + OD_SQL + """,
pairs AS (SELECT p.a, p.b, x.track AS source, y.track AS target
          FROM od p JOIN plat x ON x.station = p.a JOIN plat y ON y.station = p.b),
sp(source, edge, cost, hops, pred) USING KEY (source, edge) AS (
  SELECT DISTINCT source, source, CAST(0 AS BIGINT), 0, CAST(NULL AS VARCHAR) FROM pairs
  UNION
  (SELECT c.source, c.edge, c.cost, c.hops, c.pred FROM (
     SELECT sp.source, e.nxt AS edge, arg_min(sp.cost + e.weight, (sp.cost + e.weight, sp.hops + 1, sp.edge)) AS cost,
            arg_min(sp.hops + 1, (sp.cost + e.weight, sp.hops + 1, sp.edge)) AS hops,
            arg_min(sp.edge, (sp.cost + e.weight, sp.hops + 1, sp.edge)) AS pred
     FROM sp JOIN adj e ON e.edge = sp.edge GROUP BY 1, 2) c
   LEFT JOIN recurring.sp cur ON cur.source = c.source AND cur.edge = c.edge
   WHERE cur.edge IS NULL OR (c.cost, c.hops, c.pred) < (cur.cost, cur.hops, cur.pred))),
walk AS (SELECT DISTINCT source, target, target AS pos, target AS path FROM pairs
         UNION ALL SELECT w.source, w.target, sp.pred, sp.pred || ',' || w.path
         FROM walk w JOIN sp ON sp.source = w.source AND sp.edge = w.pos WHERE sp.pred IS NOT NULL)
SELECT p.a, p.b, p.source AS track_a, p.target AS track_b, sp.cost, CAST(sp.hops AS INTEGER) AS hops, w.path
FROM pairs p JOIN sp ON sp.source = p.source AND sp.edge = p.target
JOIN walk w ON w.source = p.source AND w.target = p.target AND w.pos = p.source""")
def q_platform_paths(spark, sf):
    """Tracks run within a country and to its neighbours; a station's platforms are its first two tracks."""
    st = A.stations(spark, sf).select("ID", "Nation")
    ends = A.links(spark, sf).join(st.toDF("Departure_station_id", "_d"), "Departure_station_id") \
        .join(st.toDF("Arrival_station_id", "_a"), "Arrival_station_id") \
        .filter((F.abs(F.col("_d") - F.col("_a")) <= 1) & (F.col("Departure_station_id") != F.col("Arrival_station_id")))
    tracks = ends.groupBy(F.least("Departure_station_id", "Arrival_station_id").alias("a"),
                          F.greatest("Departure_station_id", "Arrival_station_id").alias("b")) \
        .agg(F.round(F.min("Distance") * 1000).cast("long").alias("length")).withColumn("id", F.concat_ws("-", "a", "b"))
    tracks = GR.materialise_input(tracks)
    inc = GR.line_graph(tracks)
    platforms = W.head_per_group(inc, ["node"], ["edge"], 2).select("node", "edge")
    r = GR.platform_paths(tracks, platforms, _od_requests(spark, sf), delta=250000)
    return r.withColumn("path", F.array_join("path", ","))


MISSING_SQL = S.STOP_NEXT + ",\n" + S.LINKS.split(",\nlinks AS", 1)[0].split(S.STOP_NEXT, 1)[1].lstrip(",\n") + """,
links AS (SELECT departure_station AS Departure_station_id, arrival_station AS Arrival_station_id
          FROM legs WHERE arrival_station IS NOT NULL GROUP BY 1, 2),
base AS (SELECT l.* FROM links l JOIN supplier d ON d.s_suppkey = l.Departure_station_id
                                 JOIN supplier a ON a.s_suppkey = l.Arrival_station_id
         WHERE d.s_nationkey < 20 AND a.s_nationkey < 20),
known AS (SELECT DISTINCT Departure_station_id AS k FROM base),
tr AS (SELECT DISTINCT lag(STOPPING_PLACE_ID) OVER (PARTITION BY TRAIN_NO, REAL_DATE_DEP
                         ORDER BY PLANNED_DATETIME_DEP, SEQ, STOPPING_PLACE_ID, PART) AS p,
              STOPPING_PLACE_ID AS s, NEXT_STOP AS n FROM stop_next),
t AS (SELECT * FROM tr WHERE p IS NOT NULL AND s IS NOT NULL AND n IS NOT NULL AND p <> s AND s <> n
        AND (p NOT IN (SELECT k FROM known) OR s NOT IN (SELECT k FROM known) OR n NOT IN (SELECT k FROM known))),
medges AS (SELECT p AS src, s AS dst FROM t UNION SELECT s, n FROM t),
unknown AS (SELECT p AS node FROM t WHERE p NOT IN (SELECT k FROM known)
            UNION SELECT s FROM t WHERE s NOT IN (SELECT k FROM known)
            UNION SELECT n FROM t WHERE n NOT IN (SELECT k FROM known))"""


def _missing(spark, sf):
    tri = A.stop_log_both(spark, sf).select(F.col("PREV_STOP").alias("prev"), F.col("STOPPING_PLACE_ID").alias("stop"),
                    F.col("NEXT_STOP").alias("next"))
    st = A.stations(spark, sf)
    lk = A.links(spark, sf)
    ok = st.filter(F.col("Nation") < 20).select("ID")
    base = lk.join(ok.withColumnRenamed("ID", "Departure_station_id"), "Departure_station_id", "left_semi") \
        .join(ok.withColumnRenamed("ID", "Arrival_station_id"), "Arrival_station_id", "left_semi") \
        .select(F.col("Departure_station_id").alias("src"), F.col("Arrival_station_id").alias("dst"))
    edges, unknown = GR.missing_graph(GR.materialise_input(tri.distinct()), GR.materialise_input(base))
    return base, edges, unknown


@q("missing_graph", S.with_(MISSING_SQL) + "SELECT src, dst FROM medges")
def q_missing_graph(spark, sf):
    return _missing(spark, sf)[1]


@q("missing_nodes", S.with_(MISSING_SQL) + "SELECT node FROM unknown")
def q_missing_nodes(spark, sf):
    return _missing(spark, sf)[2]


ANCHOR_SQL = "WITH RECURSIVE " + MISSING_SQL + """,
anchors AS (SELECT DISTINCT Departure_station_id AS node FROM base INTERSECT SELECT DISTINCT src FROM medges),
bfs(node, dist, anchors) USING KEY (node) AS (
  SELECT node, 0, [node] FROM anchors
  UNION
  (SELECT c.node, c.dist, c.anchors FROM (
     SELECT e.dst AS node, min(b.dist) + 1 AS dist, list_sort(list_distinct(flatten(list(b.anchors)))) AS anchors
     FROM bfs b JOIN medges e ON e.src = b.node GROUP BY e.dst) c
   LEFT JOIN recurring.bfs r ON r.node = c.node WHERE r.node IS NULL))"""


@q("closest_anchors", ANCHOR_SQL + """
SELECT u.node, CAST(b.dist AS INTEGER) AS distance, coalesce(array_to_string(b.anchors, ','), '') AS anchors
FROM unknown u LEFT JOIN bfs b USING (node)""")
def q_closest_anchors(spark, sf):
    base, edges, unknown = _missing(spark, sf)
    r = GR.closest_anchors(base, edges, unknown)
    return r.select("node", "distance", F.array_join("anchors", ",").alias("anchors"))


@q("anchors_valid", ANCHOR_SQL + """
SELECT DISTINCT a AS anchor FROM (SELECT unnest(anchors) AS a FROM bfs)
WHERE a NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10)""")
def q_anchors_valid(spark, sf):
    base, edges, unknown = _missing(spark, sf)
    r = GR.closest_anchors(base, edges, unknown)
    return Q.anchors_valid(r, A.stations(spark, sf).filter("Nation < 10").select(F.col("ID").alias("node")))


# ------------------------------------------------------------------ §2.1 sources and sinks (write -> read back)

from railspark.sources import files as IO  # noqa: E402

LINKS_RT_SQL = S.with_(S.LINKS, S.STATIONS) + """
SELECT l.Departure_station_id, l.Arrival_station_id, l.Distance, d.Geo_x AS first_lat, a.Geo_y AS last_lon
FROM links l LEFT JOIN stations d ON l.Departure_station_id = d.ID LEFT JOIN stations a ON l.Arrival_station_id = a.ID"""

LINK_CSV_SCHEMA = "Departure_station_id long, Arrival_station_id long, Distance double, Coordinates string"


def _links_roundtrip(spark, sf):
    out = IO.scratch_path(spark, "links-csv")
    IO.sink_csv(A.links(spark, sf), out, sep=";")
    back = IO.scan_csv(spark, out, LINK_CSV_SCHEMA, sep=";")
    c = F.from_json("Coordinates", "array<array<double>>")
    return back.select("Departure_station_id", "Arrival_station_id", "Distance", c[0][0].alias("first_lat"),
                       F.element_at(c, -1)[1].alias("last_lon"))


q("sink_csv", LINKS_RT_SQL)(_links_roundtrip)
q("scan_csv", LINKS_RT_SQL)(_links_roundtrip)


@q("f_unquote_json_csv", S.with_(S.STATIONS) + "SELECT ID, Name, Geo_x FROM stations")
def q_csv_quoted(spark, sf):
    """CSV cells holding quoted JSON survive the write/scan round trip."""
    st = A.stations(spark, sf).select("ID", "Name", F.to_json(F.struct("Geo_x")).alias("js"))
    out = IO.scratch_path(spark, "stations-csv")
    IO.sink_csv(st, out, sep=";")
    back = IO.scan_csv(spark, out, "ID long, Name string, js string", sep=";")
    return back.select("ID", "Name", F.from_json("js", "Geo_x double")["Geo_x"].alias("Geo_x"))


@q("sink_xml_nodes", S.with_(S.STATIONS) + """
SELECT CAST(ID AS VARCHAR) AS id, Geo_y AS x, Geo_x AS y, 'priority' AS type FROM stations""")
def q_xml_nodes(spark, sf):
    out = IO.scratch_path(spark, "nodes-xml")
    IO.sink_xml(IO.xml_nodes(A.stations(spark, sf)), out, "nodes", "node")
    back = IO.scan_xml(spark, out, "node", ["id", "x", "y", "type"])
    return back.select(F.col("_id").alias("id"), F.col("_x").try_cast("double").alias("x"),
                       F.col("_y").try_cast("double").alias("y"), F.col("_type").alias("type"))


q("scan_xml", S.with_(S.STATIONS) + """
SELECT CAST(ID AS VARCHAR) AS id, Geo_y AS x, Geo_x AS y, 'priority' AS type FROM stations""")(q_xml_nodes)


@q("sink_xml_edges", S.with_(S.LINKS, S.STATIONS) + """,
part AS (SELECT * FROM stations WHERE Nation < 12)
SELECT l.Departure_station_id || '_' || l.Arrival_station_id AS id, CAST(l.Departure_station_id AS VARCHAR) AS "from",
       CAST(l.Arrival_station_id AS VARCHAR) AS "to", l.Distance * 1000 AS length, d.Geo_y AS x1, d.Geo_x AS y1, a.Geo_y AS x2, a.Geo_x AS y2,
       '2' AS priority, '1' AS lanes, CAST(27.0 AS DOUBLE) AS speed, 'rail' AS allow
FROM links l JOIN part d ON d.ID = l.Departure_station_id JOIN part a ON a.ID = l.Arrival_station_id""")
def q_xml_edges(spark, sf):
    """The links between the stations of some countries, with every attribute of the file."""
    out = IO.scratch_path(spark, "edges-xml")
    IO.sink_xml(IO.xml_edges(A.links(spark, sf), A.stations(spark, sf).filter("Nation < 12")), out, "edges", "edge")
    back = IO.scan_xml(spark, out, "edge", ["id", "from", "to", "length", "shape", "priority", "numLanes", "speed", "allow"])
    number = lambda k, j: F.split(F.split("_shape", " ")[k], ",")[j].cast("double")
    return back.select(F.col("_id").alias("id"), F.col("_from").alias("from"), F.col("_to").alias("to"),
                       F.col("_length").try_cast("double").alias("length"), number(0, 0).alias("x1"), number(0, 1).alias("y1"),
                       number(1, 0).alias("x2"), number(1, 1).alias("y2"), F.col("_priority").alias("priority"), F.col("_numLanes").alias("lanes"),
                       F.col("_speed").cast("double").alias("speed"), F.col("_allow").alias("allow"))


@q("sink_xml_platforms", S.with_(S.LINKS, S.STATIONS) + """
SELECT l.Departure_station_id || '->' || l.Arrival_station_id AS id,
       l.Departure_station_id || '_' || l.Arrival_station_id || '_0' AS lane, d.Name || ' to ' || s.Name || ' platform' AS name,
       '80' AS startPos, '300' AS endPos
FROM links l JOIN stations d ON l.Departure_station_id = d.ID JOIN stations s ON l.Arrival_station_id = s.ID""")
def q_xml_platforms(spark, sf):
    out = IO.scratch_path(spark, "platforms-xml")
    IO.sink_xml(IO.xml_platforms(A.links(spark, sf), A.stations(spark, sf)), out, "additional", "trainStop")
    back = IO.scan_xml(spark, out, "trainStop", ["id", "lane", "name", "startPos", "endPos"])
    return back.select(*[F.col("_" + c).alias(c) for c in ("id", "lane", "name", "startPos", "endPos")])


@q("sink_xml_trips", CLEAN_SQL + """,
ends AS (SELECT trip_id, arg_min(t, p) AS depart, arg_min(dep || '_' || arr, p) AS from_edge,
                arg_max(dep || '_' || arr, p) AS to_edge FROM cleaned GROUP BY 1)
SELECT 'trip_' || (row_number() OVER (ORDER BY depart, trip_id) - 1) AS id, CAST(depart AS VARCHAR) AS depart,
       from_edge AS "from", to_edge AS "to", 'myTrain' AS type FROM ends""")
def q_xml_trips(spark, sf):
    out = IO.scratch_path(spark, "trips-xml")
    IO.sink_xml(IO.xml_trips(T.od_rows(cleaned_rows(spark, sf))), out, "routes", "trip")
    back = IO.scan_xml(spark, out, "trip", ["id", "depart", "from", "to", "type"])
    return back.select(F.col("_id").alias("id"), F.col("_depart").alias("depart"), F.col("_from").alias("from"),
                       F.col("_to").alias("to"), F.col("_type").alias("type"))


@q("sink_xml_routes", CLEAN_SQL + """
SELECT 'train_' || trip_id AS id, string_agg(dep || '_' || arr, ' ' ORDER BY p) AS edges, CAST(count(*) - 1 AS INTEGER) AS n_stops,
       coalesce(string_agg(dep || '->' || arr || '@' || CAST(t AS BIGINT) || '+30', ' ' ORDER BY p) FILTER (WHERE p > 1), '') AS stops,
       'myTrain' AS type
FROM (SELECT trip_id, dep, arr, t, row_number() OVER (PARTITION BY trip_id ORDER BY p) AS p FROM cleaned) GROUP BY trip_id""")
def q_xml_routes(spark, sf):
    out = IO.scratch_path(spark, "routes-xml")
    IO.sink_xml(IO.xml_routes(T.gather_routes(T.route_rows(cleaned_rows(spark, sf)))), out, "routes", "vehicle")
    schema = ("_id string, _type string, _depart string, route struct<_edges:string>, "
              "stop array<struct<_trainStop:string,_until:string,_duration:string>>")
    back = IO.scan_xml(spark, out, "vehicle", schema=schema)
    stops = F.transform("stop", lambda x: F.concat(x["_trainStop"], F.lit("@"), x["_until"].cast("double").cast("long").cast("string"),
                                                   F.lit("+"), x["_duration"]))
    return back.select(F.col("_id").alias("id"), F.col("route._edges").alias("edges"),
                       F.coalesce(F.size("stop"), F.lit(0)).alias("n_stops"), F.coalesce(F.array_join(stops, " "), F.lit("")).alias("stops"),
                       F.col("_type").alias("type"))


@q("sink_geojson", S.with_(S.POLYLINES) + """
SELECT ID AS id, Path[1][1] AS start_lat, Path[len(Path)][2] AS end_lon, Path[1][2] AS first_x, len(Path) AS n FROM polylines""")
def q_geojson(spark, sf):
    out = IO.scratch_path(spark, "tracks-geojson")
    IO.sink_geojson(A.polylines(spark, sf), out, "Path", "ID")
    back = IO.scan_geojson(spark, out)
    return back.select(F.col("properties.id").alias("id"), F.col("properties.start_lat").alias("start_lat"),
                       F.col("properties.end_lon").alias("end_lon"),
                       F.col("geometry.coordinates")[0][0].alias("first_x"),
                       F.size("geometry.coordinates").cast("bigint").alias("n"))


@q("base_date_from_xml", "SELECT CAST(min(ts) AS DATE) AS base_date FROM events")
def q_base_date(spark, sf):
    ev = A.table(spark, sf, "events")
    days = ev.select(F.to_date("ts").alias("d")).distinct()
    root = ev.agg(F.min(F.to_date("ts")).alias("d")).select(
        F.lit(1).alias("k"), F.concat(F.lit('<summary begin="'), F.col("d").cast("string"), F.lit('" version="1">')).alias("value"))
    steps = days.select(F.lit(2).alias("k"), F.concat(F.lit('  <step time="0" date="'), F.col("d").cast("string"),
                                                      F.lit('"/>')).alias("value"))
    head = ev.sparkSession.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?>'), (3, "</summary>")],
                                           "k int, value string")
    out = IO.scratch_path(spark, "summary-xml")
    # the summary document is one small file (one line per simulated day)
    head.unionByName(root).unionByName(steps).orderBy("k", "value").coalesce(1).select("value") \
        .write.mode("overwrite").text(out)
    return IO.base_date_from_xml(spark, out)


# ------------------------------------------------------------------ ETL pipelines on raw-shaped analogues

from railspark.plans import etl as ETL  # noqa: E402


def raw_operational_points(spark, sf):
    st = A.stations(spark, sf)
    return st.select(F.col("ID").cast("string").alias("PTCAR ID"),
                     F.concat_ws(",", F.col("Geo_x").cast("string"), F.col("Geo_y").cast("string")).alias("Geo Point"),
                     F.concat(F.lit("TAF"), F.col("Nation").cast("string")).alias("Code TAF/TAP"),
                     F.lit("station").alias("Classification EN"), F.col("Name").alias("Nom symbolique"),
                     F.col("Name").alias("Nom FR court"), F.col("Name").alias("Nom FR complet"),
                     F.col("Name").alias("Nom NL court"), F.lit("shape").alias("Geo shape"))


@q("etl_stations", S.with_(S.STATIONS) + """
SELECT CAST(ID AS INTEGER) AS ID, Geo_x, Geo_y, 'TAF' || Nation AS Code_TAF_TAP, 'station' AS Classification,
       Name AS Symbolic_name, Name AS Name_FR_short, Name AS Name_FR_full FROM stations""")
def q_etl_stations(spark, sf):
    return ETL.etl_stations(raw_operational_points(spark, sf))


def raw_punctuality(spark, sf):
    li = A.table(spark, sf, "lineitem")
    d = F.upper(F.date_format("l_shipdate", "ddMMMyyyy"))
    return li.select(
        F.col("l_orderkey").cast("string").alias("TRAIN_NO"), F.col("l_suppkey").cast("string").alias("PTCAR_NO"),
        F.col("l_quantity").cast("int").cast("string").alias("DELAY_ARR"),
        F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(F.col("l_linenumber").cast("string")).alias("DELAY_DEP"),
        F.concat("l_returnflag", "l_linestatus").alias("RELATION"), F.lit("").alias("TRAIN_SERV"),
        F.col("l_linestatus").alias("RELATION_DIRECTION"), F.lit("L1").alias("LINE_NO_DEP"), F.lit("").alias("LINE_NO_ARR"),
        F.when(F.col("l_linenumber") > 1, d).alias("PLANNED_DATE_ARR"), d.alias("PLANNED_DATE_DEP"),
        F.when(F.col("l_linenumber") > 1, d).alias("REAL_DATE_ARR"), d.alias("REAL_DATE_DEP"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit(":05:00")).alias("PLANNED_TIME_ARR"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit(":10:00")).alias("PLANNED_TIME_DEP"),
        F.lit("x").alias("THOP1_COD"))


@q("etl_punctuality", """
SELECT CAST(l_orderkey AS INTEGER) AS TRAIN_NO, l_returnflag || l_linestatus AS RELATION, CAST(NULL AS VARCHAR) AS TRAIN_SERV,
       CAST(l_suppkey AS INTEGER) AS STOPPING_PLACE_ID, 'L1' AS LINE_NO_DEP, CAST(l_quantity AS INTEGER) AS DELAY_ARR,
       CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_linenumber END AS DELAY_DEP, l_linestatus AS RELATION_DIRECTION,
       CAST(NULL AS VARCHAR) AS LINE_NO_ARR,
       CASE WHEN l_linenumber > 1 THEN CAST(l_shipdate AS DATE) END AS REAL_DATE_ARR, CAST(l_shipdate AS DATE) AS REAL_DATE_DEP,
       CASE WHEN l_linenumber > 1 THEN strftime(l_shipdate + to_minutes(l_linenumber * 60 + 5), '%Y-%m-%d %H:%M:%S') END
         AS PLANNED_DATETIME_ARR,
       strftime(l_shipdate + to_minutes(l_linenumber * 60 + 10), '%Y-%m-%d %H:%M:%S') AS PLANNED_DATETIME_DEP
FROM lineitem""")
def q_etl_punctuality(spark, sf):
    p = ETL.etl_punctuality(raw_punctuality(spark, sf))
    return p.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("PLANNED_DATETIME_ARR", "PLANNED_DATETIME_DEP")})


@q("etl_tracks", S.with_(S.LINKS, S.STATIONS) + """
SELECT CAST(l.Departure_station_id AS INTEGER) AS Departure_station_id, CAST(l.Arrival_station_id AS INTEGER) AS Arrival_station_id,
       d.Geo_x, d.Geo_y, round(l.Distance, 6) AS Distance, a.Geo_x AS last_lat, 2 AS n
FROM links l LEFT JOIN stations d ON l.Departure_station_id = d.ID LEFT JOIN stations a ON l.Arrival_station_id = a.ID""")
def q_etl_tracks(spark, sf):
    lk = A.links(spark, sf)
    c = F.col("Coordinates")
    shape = F.to_json(F.struct(F.transform(c, lambda p: F.array(p[1], p[0])).alias("coordinates"),
                               F.lit("LineString").alias("type")))
    raw = lk.select(F.col("Departure_station_id").cast("string").alias("Gare de départ (id)"),
                    F.col("Arrival_station_id").cast("string").alias("Gare d'arrivée (id)"),
                    F.lit("A").alias("Gare de départ"), F.lit("B").alias("Gare d'arrivée"),
                    F.concat_ws(",", c[0][0].cast("string"), c[0][1].cast("string")).alias("geo_point_2d"),
                    "Distance", F.concat(F.lit('"'), F.replace(shape, F.lit('"'), F.lit('""')), F.lit('"')).alias("Geo Shape"))
    t = ETL.etl_tracks(raw)
    return t.select("Departure_station_id", "Arrival_station_id", "Geo_x", "Geo_y", "Distance",
                    F.element_at("Coordinates", -1)[0].alias("last_lat"), F.size("Coordinates").alias("n"))


@q("etl_platforms", S.with_(S.STATIONS) + """
SELECT CAST(ID AS INTEGER) AS ID, CAST(ID AS INTEGER) AS Station_ID, Name AS Station_name,
       CASE WHEN Nation < 5 THEN NULL ELSE 'main' END AS Platform_type, Geo_x AS X, Geo_y AS Y FROM stations""")
def q_etl_platforms(spark, sf):
    st = A.stations(spark, sf)
    raw = st.select(F.col("ID").cast("string").alias("ID quai"), F.col("ID").cast("string").alias("PTCAR ID"),
                    F.col("Name").alias("Nom du point d'arrêt"),
                    F.when(F.col("Nation") >= 5, F.lit("main")).alias("Platform type"),
                    F.concat_ws(",", F.col("Geo_x").cast("string"), F.col("Geo_y").cast("string")).alias("Geo Point"),
                    F.lit("1").alias("Numéro du quai"))
    return ETL.etl_platforms(raw)


@q("etl_line_segments", S.with_(S.POLYLINES) + """
SELECT CAST(ID AS VARCHAR) AS ID, Path[1][1] AS first_lat, Path[1][2] AS first_lon, len(Path) AS n FROM polylines""")
def q_etl_segments(spark, sf):
    pl = A.polylines(spark, sf)
    shape = F.to_json(F.struct(F.transform("Path", lambda p: F.array(p[1], p[0], F.lit(0.0))).alias("coordinates"),
                               F.lit("LineString").alias("type")))
    raw = pl.select(F.col("ID").cast("string").alias("ID du segment"), shape.alias("Geo Shape"))
    s = ETL.etl_line_segments(raw)
    return s.select("ID", F.col("Coordinates")[0][0].alias("first_lat"), F.col("Coordinates")[0][1].alias("first_lon"),
                    F.size("Coordinates").cast("bigint").alias("n"))


@q("run_job", S.with_(S.STATIONS) + """
SELECT CAST(ID AS INTEGER) AS ID, Geo_x, Geo_y, 'TAF' || Nation AS Code_TAF_TAP, 'station' AS Classification,
       Name AS Symbolic_name, Name AS Name_FR_short, Name AS Name_FR_full FROM stations""")
def q_run_job(spark, sf):
    """The command-line job end to end: raw CSV in, cleaned Parquet out, read back."""
    from railspark.plans.jobs import run_job
    src, out = IO.scratch_path(spark, "raw-points"), IO.scratch_path(spark, "clean-points")
    IO.sink_csv(raw_operational_points(spark, sf), src, sep=";")
    run_job(spark, "stations", src, out, sep=";")
    return spark.read.parquet(out)


# ------------------------------------------------------------------ commands with several inputs and outputs

def _file(spark, df, name):
    path = IO.scratch_path(spark, name)
    IO.sink_csv(df, path, sep=";")
    return path


def _command(spark, command, inputs, **params):
    from railspark.plans.jobs import run_command
    out = IO.scratch_path(spark, command)
    run_command(spark, command, inputs, out, **params)
    return out


@q("job_correct_coordinates", S.with_(S.LINKS, S.STATIONS) + """,
st AS (SELECT ID, Nation, CASE WHEN Name = 'Supplier#000000001' THEN 'FIXED' ELSE Name END AS Name FROM stations UNION ALL SELECT 0, 99, 'Depot'),
k AS (SELECT l.*, s.Name AS name, s.Nation AS n FROM links l JOIN st s ON s.ID = l.Departure_station_id
      WHERE l.Arrival_station_id IN (SELECT ID FROM st))
SELECT k.Departure_station_id AS dep, k.Arrival_station_id AS arr, k.Distance AS distance, k.name,
       CASE WHEN k.n = 3 THEN 50.5 ELSE d.Geo_x END AS first_lat, CASE WHEN k.n = 3 THEN 4.25 ELSE d.Geo_y END AS first_lon, a.Geo_x AS last_lat
FROM k JOIN stations d ON d.ID = k.Departure_station_id JOIN stations a ON a.ID = k.Arrival_station_id""")
def q_job_correct(spark, sf):
    from railspark.plans.jobs import published
    st, links = A.stations(spark, sf), LO.materialise_input(A.links(spark, sf))  # two of the files come from the links
    st = st.withColumnRenamed("Name", "Code").withColumn("Name", F.col("Code"))
    new = spark.createDataFrame([(0, "Depot", 99, 50.0, 4.0, "Depot")], "ID long, Code string, Nation int, Geo_x double, Geo_y double, Name string")
    fixes = spark.createDataFrame([("Supplier#000000001", "FIXED")], "Name string, Code string")
    ends = links.join(st.filter("Nation = 3").select(F.col("ID").alias("Departure_station_id")), "Departure_station_id", "left_semi") \
        .select("Departure_station_id", "Arrival_station_id", F.lit(True).alias("first"), F.lit(50.5).alias("lat"), F.lit(4.25).alias("lon"))
    out = _command(spark, "correct_coordinates", {k: _file(spark, d, k) for k, d in (
        ("stations", st), ("links", links), ("new_stations", new), ("fixes", fixes), ("ends", ends))})
    k, s = published(spark, out, "links"), published(spark, out, "stations")
    c = F.from_json("Coordinates", "array<array<double>>")
    k = k.select(F.col("Departure_station_id").cast("long").alias("dep"), F.col("Arrival_station_id").cast("long").alias("arr"),
                 F.col("Distance").cast("double").alias("distance"), c[0][0].alias("first_lat"), c[0][1].alias("first_lon"), c[1][0].alias("last_lat"))
    return k.join(s.select(F.col("ID").cast("long").alias("dep"), F.col("Code").alias("name")), "dep") \
        .join(s.select(F.col("ID").cast("long").alias("arr")), "arr", "left_semi")


@q("job_simplify_tracks", SIMPLIFIED_SQL + """SELECT tr.ID, a.SID AS Departure_switch, b.SID AS Arrival_switch, nd.p[1] AS X, nd.p[2] AS Y,
       array_to_string(list_transform(path, lambda x: x[1] || ':' || x[2]), ' ') AS path
FROM tr JOIN sw a ON a.node = tr.s JOIN sw b ON b.node = tr.e JOIN nodes nd ON nd.klat = tr.s[1] AND nd.klon = tr.s[2]""")
def q_job_simplify(spark, sf):
    from railspark.plans.jobs import published
    lines = _quantised(spark, sf).select("ID", F.col("Path").alias("Coordinates"))
    out = _command(spark, "simplify_tracks", {"lines": _file(spark, lines, "lines")})
    t, s = published(spark, out, "tracks"), published(spark, out, "switches")
    key = lambda x: F.round(x * 1000000).cast("long").cast("string")
    path = F.transform(F.from_json("Path", "array<array<double>>"), lambda p: F.concat(key(p[0]), F.lit(":"), key(p[1])))
    s = s.select(F.col("ID").alias("Departure_switch"), F.col("X").cast("double").alias("X"), F.col("Y").cast("double").alias("Y"))
    t = t.select("ID", "Departure_switch", "Arrival_switch", F.array_join(path, " ").alias("path")).join(s, "Departure_switch")
    return t.withColumns({c: F.col(c).cast("long") for c in ("ID", "Departure_switch", "Arrival_switch")})


@q("job_split_tracks", MULTI_SQL + """SELECT k AS ID, f[1] AS X1, f[2] AS Y1, t[1] AS X2, t[2] AS Y2, CAST(e - s + 1 AS INTEGER) AS n_points FROM num""")
def q_job_split(spark, sf):
    from railspark.plans.jobs import published
    tracks = A.polylines(spark, sf).select("ID", F.col("Path").alias("Coordinates"))
    out = _command(spark, "split_tracks", {"tracks": _file(spark, tracks, "tracks"), "assigned": _file(spark, _assigned(spark, sf), "assigned")})
    s = published(spark, out, "switches")
    t = published(spark, out, "tracks")
    for k, end in (("1", "Departure_switch"), ("2", "Arrival_switch")):
        t = t.join(s.select(F.col("ID").alias(end), F.col("X").cast("double").alias("X" + k), F.col("Y").cast("double").alias("Y" + k)), end)
    return t.select(F.col("ID").cast("long").alias("ID"), "X1", "Y1", "X2", "Y2", F.size(F.from_json("Path", "array<array<double>>")).alias("n_points"))


GENERATED_SQL = S.with_(S.LINKS, S.STATIONS) + """,
seeds AS (SELECT unnest([1, 5]) AS station),
sel AS (SELECT station FROM seeds UNION SELECT Arrival_station_id FROM links WHERE Departure_station_id IN (SELECT station FROM seeds))
SELECT Departure_station_id || '_' || Arrival_station_id AS id, CAST(Departure_station_id AS VARCHAR) AS "from", CAST(Arrival_station_id AS VARCHAR) AS "to",
       round(Distance * 1000, 3) AS length FROM links
WHERE (Departure_station_id IN (SELECT station FROM seeds) OR Arrival_station_id IN (SELECT station FROM seeds))
  AND Departure_station_id IN (SELECT station FROM sel) AND Arrival_station_id IN (SELECT station FROM sel)"""


@q("job_generate_simulation", GENERATED_SQL)
def q_job_generate(spark, sf):
    """The network and timetable files of two stations and their neighbours; the edges, read back."""
    from railspark.plans.jobs import published
    stops = A.stop_log(spark, sf).select("TRAIN_NO", "REAL_DATE_DEP", "STOPPING_PLACE_ID", "PLANNED_DATETIME_DEP")
    out = _command(spark, "generate_simulation", {"stations": _file(spark, A.stations(spark, sf), "stations"), "links": _file(spark, A.links(spark, sf), "links"),
                                                  "stops": _file(spark, stops, "stops")}, sim_stations="1,5", start="1995-01-01 00:00:00", days=30)
    e = published(spark, out, "edges", ["id", "from", "to", "length"])
    return e.select(F.col("_id").alias("id"), F.col("_from").alias("from"), F.col("_to").alias("to"), F.round(F.col("_length").cast("double"), 3).alias("length"))


@q("stream_punctuality", """
SELECT CAST(l_orderkey AS INTEGER) AS TRAIN_NO, CAST(l_suppkey AS INTEGER) AS STOPPING_PLACE_ID,
       CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_linenumber END AS DELAY_DEP,
       strftime(l_shipdate + to_minutes(l_linenumber * 60 + 10), '%Y-%m-%d %H:%M:%S') AS PLANNED_DATETIME_DEP
FROM lineitem""")
def q_stream_punctuality(spark, sf):
    """Raw punctuality files consumed by the Structured Streaming job (available-now trigger)."""
    from railspark.streaming.punctuality import stream_punctuality
    src, out, ck = (IO.scratch_path(spark, n) for n in ("raw-punct", "clean-punct", "stream-ckpt"))
    IO.sink_csv(raw_punctuality(spark, sf), src, sep=",")
    stream_punctuality(spark, src, out, ck).awaitTermination()
    p = spark.read.parquet(out)
    return p.select("TRAIN_NO", "STOPPING_PLACE_ID", "DELAY_DEP",
                    F.date_format("PLANNED_DATETIME_DEP", "yyyy-MM-dd HH:mm:ss").alias("PLANNED_DATETIME_DEP"))


# ------------------------------------------------------------------ simulator output (card T8)

from railspark.operators import simout as SO  # noqa: E402

from railspark.plans.jobs import STOPINFO_ATTRS, TRIPINFO_ATTRS  # noqa: E402


def _tripinfo_rows(spark, sf):
    o = A.table(spark, sf, "orders")
    return o.select(F.concat(F.lit("trip_"), F.col("o_orderkey").cast("string")).alias("_id"),
                 (F.col("o_custkey") * 10).cast("string").alias("_depart"),
                 (F.col("o_custkey") * 10 + 3600).cast("string").alias("_arrival"),
                 F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise((F.col("o_orderkey") % 120).cast("string"))
                 .alias("_departDelay"),
                 F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("_line"),
                 F.col("o_orderkey").cast("string").alias("_trainNumber"),
                 F.concat(F.lit("E"), F.col("o_custkey").cast("string"), F.lit("_1")).alias("_departLane"),
                 F.concat(F.lit("E"), F.col("o_orderkey").cast("string"), F.lit("_0")).alias("_arrivalLane"),
                 F.col("o_orderkey").alias("_pos"))


def _tripinfo(spark, sf):
    out = IO.scratch_path(spark, "tripinfo-xml")
    IO.sink_xml(_tripinfo_rows(spark, sf), out, "tripinfos", "tripinfo")
    back = IO.scan_xml_records(spark, out, "tripinfo", TRIPINFO_ATTRS + ["pos"])
    return back.withColumn("_pos", F.col("_pos").try_cast("long"))


def _stopinfo_rows(spark, sf):
    li = A.table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("trip_"), F.col("l_orderkey").cast("string")).alias("_id"),
                  F.concat(F.col("l_suppkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("_stopID"),
                  (F.col("l_partkey") * 7).cast("string").alias("_started"),
                  (F.col("l_partkey") * 7 + 60 + F.col("l_linenumber")).cast("string").alias("_ended"))


def _stopinfo(spark, sf):
    out = IO.scratch_path(spark, "stopinfo-xml")
    IO.sink_xml(_stopinfo_rows(spark, sf), out, "stops", "stopinfo")
    return IO.scan_xml_records(spark, out, "stopinfo", STOPINFO_ATTRS)


TRIPS_T8_SQL = """trips AS (
  SELECT 'trip_' || o_orderkey AS trip_id, CAST(o_custkey * 10 AS DOUBLE) AS real_depart,
         CAST(o_custkey * 10 + 3600 AS DOUBLE) AS real_arrive,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderkey % 120 AS DOUBLE) END AS depart_delay,
         CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE CAST(o_orderkey AS VARCHAR) END AS train_number,
         'E' || o_custkey || '->' || 'E' || o_orderkey AS relation, 'E' || o_orderkey AS relation_direction
  FROM orders)"""

EVENTS_T8_SQL = TRIPS_T8_SQL + """,
ev AS (SELECT 'trip_' || l_orderkey AS trip_id, CAST(l_suppkey AS VARCHAR) AS station,
              CAST(l_partkey * 7 AS DOUBLE) AS started, CAST(l_partkey * 7 + 60 + l_linenumber AS DOUBLE) AS ended FROM lineitem),
events AS (SELECT ev.trip_id, ev.station, started AS realtime_arrival, ended AS realtime_departure,
                  coalesce(t.depart_delay, 0.0) AS delay_arrival,
                  abs(started + 30 - ended + coalesce(t.depart_delay, 0.0)) AS delay_departure,
                  started - coalesce(t.depart_delay, 0.0) AS scheduled_arrival,
                  ended - abs(started + 30 - ended + coalesce(t.depart_delay, 0.0)) AS scheduled_departure
           FROM ev LEFT JOIN trips t USING (trip_id))"""


@q("trip_times", S.with_(TRIPS_T8_SQL) + """
SELECT trip_id, real_depart, real_arrive, depart_delay, train_number, relation,
       real_depart - depart_delay AS scheduled_depart, real_arrive - depart_delay AS scheduled_arrive, relation_direction
FROM trips""")
def q_trip_times(spark, sf):
    return SO.trip_times(_tripinfo(spark, sf))


@q("stop_events", S.with_(EVENTS_T8_SQL) + "SELECT * FROM events")
def q_stop_events(spark, sf):
    return SO.stop_events(_stopinfo(spark, sf), SO.trip_times(_tripinfo(spark, sf)))


def _t8_sql_cols():
    b = "TIMESTAMP '2025-01-01 00:00:00'"
    cols = ["strftime(coalesce(" + ", ".join(f"{b} + to_microseconds(CAST(round({k} * 1000000) AS BIGINT))" for k in (
        "realtime_arrival", "realtime_departure", "scheduled_arrival", "scheduled_departure")) + "), '%Y-%m-%d') AS date",
        "t.train_number", "e.trip_id AS train_id", "t.relation"]
    for k in ("realtime_arrival", "realtime_departure", "scheduled_arrival", "scheduled_departure"):
        ts = f"{b} + to_microseconds(CAST(round({k} * 1000000) AS BIGINT))"
        cols += [f"strftime({ts}, '%H:%M:%S') AS {k}_time", f"strftime({ts}, '%Y-%m-%d') AS {k}_date"]
    cols += ["t.relation_direction", "e.delay_departure", "e.delay_arrival", "e.station"]
    return ", ".join(cols)


@q("punctuality_table", S.with_(EVENTS_T8_SQL) + f"SELECT {_t8_sql_cols()} FROM events e LEFT JOIN trips t USING (trip_id)")
def q_punctuality_table(spark, sf):
    tt = SO.trip_times(_tripinfo(spark, sf))
    ev = SO.stop_events(_stopinfo(spark, sf), tt)
    return SO.punctuality_table(ev, tt, F.lit("2025-01-01 00:00:00").cast("timestamp"))


@q("job_simulation_punctuality", S.with_(EVENTS_T8_SQL) + f"SELECT {_t8_sql_cols()} FROM events e LEFT JOIN trips t USING (trip_id)")
def q_job_simulation(spark, sf):
    from railspark.plans.jobs import published
    trips, stops = IO.scratch_path(spark, "tripinfo-in"), IO.scratch_path(spark, "stopinfo-in")
    IO.sink_xml(_tripinfo_rows(spark, sf).drop("_pos"), trips, "tripinfos", "tripinfo", compression="lz4")
    IO.sink_xml(_stopinfo_rows(spark, sf), stops, "stops", "stopinfo", compression="lz4")
    out = _command(spark, "simulation_punctuality", {"tripinfo": trips, "stopinfo": stops}, start_date="2025-01-01", compression="gzip")
    for path in (trips, stops):
        discard(spark, path)
    return published(spark, out, "punctuality").withColumns({c: F.col(c).cast("double") for c in ("delay_departure", "delay_arrival")})


# ------------------------------------------------------------------ long-format trips (hot train-days split over tasks)

def trip_legs_df(spark, sf):
    return T.trip_legs(A.legs(spark, sf), A.STOP_KEY, tie=("SEQ",))


@q("trip_legs", S.with_(TRIPS_SQL) + "SELECT trip_id, t, SEQ, dep, arr FROM tlegs")
def q_trip_legs(spark, sf):
    return trip_legs_df(spark, sf).select("trip_id", "t", F.col("ord.SEQ").alias("SEQ"), "dep", "arr")


@q("clean_legs_long", CLEAN_SQL + "\nSELECT trip_id, t, dep, arr FROM cleaned")
def q_clean_legs_long(spark, sf):
    allowed = A.table(spark, sf, "supplier").filter(F.col("s_nationkey") < 12).select(F.col("s_suppkey").alias("ID"))
    return T.clean_legs_long(trip_legs_df(spark, sf), allowed).select("trip_id", "t", "dep", "arr")
