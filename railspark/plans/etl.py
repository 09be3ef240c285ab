"""Cleaning pipelines for the five raw inputs: convert -> rename -> drop -> reorder.

Each is a chain of pure functions applied with ``DataFrame.transform``; every step is a single
projection, and parsing uses ``try_`` forms so malformed text becomes NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railspark.functions.scalar import GEOJSON_LINE_TYPE, datetime_merge, parse_ddmmmyyyy, split_point, truncate, unquote_json
from railspark.operators.clean import blank_to_null, cast_columns, drop_columns, rename_columns, select_order
from railspark.operators.polyline import polyline_flip

STATIONS_COLS = ["ID", "Geo_x", "Geo_y", "Code_TAF_TAP", "Classification", "Symbolic_name", "Name_FR_short",
                 "Name_FR_full"]
TRACKS_COLS = ["Departure_station_id", "Arrival_station_id", "Geo_x", "Geo_y", "Distance", "Coordinates"]
PLATFORMS_COLS = ["ID", "Station_ID", "Station_name", "Platform_type", "X", "Y"]
SEGMENTS_COLS = ["ID", "Coordinates"]
PUNCTUALITY_COLS = ["TRAIN_NO", "RELATION", "TRAIN_SERV", "STOPPING_PLACE_ID", "LINE_NO_DEP", "DELAY_ARR", "DELAY_DEP",
                    "RELATION_DIRECTION", "LINE_NO_ARR", "REAL_DATE_ARR", "REAL_DATE_DEP", "PLANNED_DATETIME_ARR",
                    "PLANNED_DATETIME_DEP"]


def etl_stations(raw: DataFrame, n: int = 6) -> DataFrame:
    conv = raw.withColumns({"Geo_x": truncate(split_point("Geo Point", 0), n), "Geo_y": truncate(split_point("Geo Point", 1), n),
                            "PTCAR ID": F.col("PTCAR ID").try_cast("int")})
    ren = rename_columns(conv, {"PTCAR ID": "ID", "Code TAF/TAP": "Code_TAF_TAP", "Classification EN": "Classification",
                                "Nom symbolique": "Symbolic_name", "Nom FR court": "Name_FR_short",
                                "Nom FR complet": "Name_FR_full", "Nom NL court": "Name_NL_short",
                                "Nom NL complet": "Name_NL_full"})
    return select_order(drop_columns(ren, ["Geo Point", "Geo shape"]), STATIONS_COLS)


def etl_tracks(raw: DataFrame, n: int = 6) -> DataFrame:
    shape = F.from_json(unquote_json("Geo Shape"), GEOJSON_LINE_TYPE)
    conv = raw.withColumns({"Coordinates": polyline_flip(shape["coordinates"], n),
                            "Geo_x": truncate(split_point("geo_point_2d", 0), n),
                            "Geo_y": truncate(split_point("geo_point_2d", 1), n),
                            "Distance": truncate(F.col("Distance"), n)})
    ren = rename_columns(conv, {"Gare de départ (id)": "Departure_station_id", "Gare d'arrivée (id)": "Arrival_station_id"})
    ren = cast_columns(ren, {"Departure_station_id": "int", "Arrival_station_id": "int"})
    return select_order(drop_columns(ren, ["Gare de départ", "Gare d'arrivée", "Geo Shape", "geo_point_2d"]), TRACKS_COLS)


def etl_platforms(raw: DataFrame, n: int = 6) -> DataFrame:
    conv = raw.withColumns({"X": truncate(split_point("Geo Point", 0), n), "Y": truncate(split_point("Geo Point", 1), n)})
    ren = rename_columns(conv, {"ID quai": "ID", "PTCAR ID": "Station_ID", "Nom du point d'arrêt": "Station_name",
                                "Platform type": "Platform_type"})
    ren = cast_columns(ren, {"ID": "int", "Station_ID": "int"})
    return select_order(ren, PLATFORMS_COLS)


def etl_line_segments(raw: DataFrame, n: int = 6) -> DataFrame:
    shape = F.from_json(unquote_json("Geo Shape"), GEOJSON_LINE_TYPE)
    conv = raw.withColumn("Coordinates", polyline_flip(shape["coordinates"], n))
    ren = rename_columns(conv, {"ID du segment": "ID"})
    return select_order(ren, SEGMENTS_COLS)


def etl_punctuality(raw: DataFrame) -> DataFrame:
    """Merge date+time text to timestamps, blank -> NULL (after merging, before casts), cast, rename."""
    merged = raw.withColumns({
        "PLANNED_DATETIME_ARR": datetime_merge(parse_ddmmmyyyy("PLANNED_DATE_ARR"), "PLANNED_TIME_ARR"),
        "PLANNED_DATETIME_DEP": datetime_merge(parse_ddmmmyyyy("PLANNED_DATE_DEP"), "PLANNED_TIME_DEP"),
        "REAL_DATE_ARR": parse_ddmmmyyyy("REAL_DATE_ARR"), "REAL_DATE_DEP": parse_ddmmmyyyy("REAL_DATE_DEP")})
    merged = blank_to_null(merged)
    typed = cast_columns(merged, {"TRAIN_NO": "int", "PTCAR_NO": "int", "DELAY_ARR": "int", "DELAY_DEP": "int"})
    ren = rename_columns(typed, {"PTCAR_NO": "STOPPING_PLACE_ID"})
    return select_order(ren, PUNCTUALITY_COLS, {"REAL_DATE_ARR": "date", "REAL_DATE_DEP": "date"})
