"""Delimited text, XML and GeoJSON connectors.

Scans take explicit schemas (no inference pass over the data); sinks write in
parallel (one part file per task) and serialise nested columns as JSON only at
the text edge.  XML uses Spark's built-in ``xml`` source with attributes as
``_name`` columns, read as strings and converted with ``try_cast``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railspark.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint directory (shared storage on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ CSV


def scan_csv(spark: SparkSession, path: str, schema=None, sep: str = ";", header: bool = True) -> DataFrame:
    """Delimited scan; ``escape='"'`` un-doubles quotes inside quoted JSON cells.

    Without a schema every column is read as string (no inference job)."""
    r = spark.read.option("sep", sep).option("header", header).option("escape", '"').option("quote", '"') \
        .option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def sink_csv(df: DataFrame, path: str, sep: str = ";", header: bool = True, mode: str = "overwrite",
             partition_by=None, compression: str | None = None) -> None:
    """Parallel delimited write; array/struct columns become JSON text.  ``compression``: of the files, None: plain."""
    cols = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
            else F.col(f.name) for f in df.schema.fields]
    w = df.select(*cols).write.mode(mode).option("sep", sep).option("header", header).option("escape", '"')
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


# ------------------------------------------------------------------ XML


def scan_xml(spark: SparkSession, path: str, row_tag: str, attrs=None, schema=None,
             multi_line: bool = True) -> DataFrame:
    """Repeated ``row_tag`` elements; attributes become ``_name`` columns, all read as strings.

    ``attrs`` declares the attribute names (missing ones come back as NULL columns)."""
    if schema is None and attrs is not None:
        schema = T.StructType([T.StructField(f"_{a}", T.StringType()) for a in attrs])
    r = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_") \
        .option("multiLine", multi_line)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", False)
    return r.load(path)


#: A start tag's remainder that plain text functions read as an XML parser does: printable ASCII attributes in double
#: quotes, no entity, no ``>`` in a value, no blank around one (a parser's option trims it), nothing inside the element.
PLAIN_TAG = r"""^((?: [A-Za-z_][A-Za-z0-9_.-]*+="(?! )[ !#-%'-;=?-~]*+(?<! )")++) ?/>"""


def scan_xml_records(spark: SparkSession, path: str, row_tag: str, attrs=None, schema=None) -> DataFrame:
    """``scan_xml`` for large documents: one file is read by as many tasks as it has splits.

    The text source splits at every ``<row_tag``, which no task has to look for from the file's
    start; what follows is one element, self-closing or up to its end tag.  Elements of plain
    attributes (``PLAIN_TAG``) are cut up as text when only ``attrs`` are asked for, all others are
    parsed by ``from_xml`` with the declared schema, which takes several times as long.  Quoted
    attribute values may hold ``>`` and ``/>``.  Elements inside one of the same name are not found,
    nor are comments told apart from elements.  Text before the first and after the last element is
    left out; malformed elements give NULLs.
    """
    rest = spark.read.option("lineSep", f"<{row_tag}").text(path)
    plain_only, at = schema is None, F.col
    if plain_only:
        schema = T.StructType([T.StructField(f"_{a}", T.StringType()) for a in attrs])
    # a NULL, then names and values in turn
    rest = rest.withColumn("_plain", F.regexp_extract("value", PLAIN_TAG, 1) if plain_only else F.lit(""))
    rest = rest.withColumn("_cut", F.when(at("_plain") != "", F.concat(F.array(F.lit(None).cast("string")), F.split("_plain", '"'))))
    names = F.filter("_cut", lambda x, i: i % 2 == 1)
    rest = rest.select("value", F.when(F.size(F.array_distinct(names)) == F.size(names), at("_cut")).alias("_cut"))
    # the start tag's remainder: blanks and quoted values, so neither a longer name nor the prolog fits
    start = F.regexp_extract("value", r"""^((?:\s(?:[^"'<>]|"[^"]*"|'[^']*')*)?>)""", 1)
    rest = rest.withColumn("_start", F.when(at("_cut").isNull(), start))
    body = F.when(at("_start").endswith("/>"), at("_start")) \
        .otherwise(F.concat(F.regexp_extract("value", rf"(?s)^(.*?)</{row_tag}\s*>", 1), F.lit(f"</{row_tag}>")))
    parsed = F.from_xml(F.concat(F.lit(f"<{row_tag}"), body), schema, {"rowTag": row_tag, "attributePrefix": "_"})
    if not plain_only:
        return rest.filter(at("_start") != "").select(parsed.alias("_e")).select("_e.*")
    # one array of values either way: a name that is absent is at place 0, where the NULL is
    values = F.array(*[F.get("_cut", F.array_position("_cut", F.lit(f" {a}=")).cast("int")) for a in attrs])
    rest = rest.select("value", "_start", F.when(at("_cut").isNotNull(), values).alias("_values"))
    other = F.transform(F.array(parsed), lambda e: F.array(*[e[f.name] for f in schema]))[0]
    values = F.coalesce("_values", F.when(at("_start") != "", other))
    # a generated row: filters on values stay behind it, so that an element is parsed once however many of them they name
    return rest.select(F.explode(F.array(values)).alias("_v")).filter("_v is not null") \
        .select(*[F.get("_v", F.lit(i)).alias(f.name) for i, f in enumerate(schema)])


def sink_xml(df: DataFrame, path: str, root_tag: str, row_tag: str, mode: str = "overwrite", compression: str | None = None) -> None:
    """Columns named ``_attr`` become attributes; struct / array-of-struct columns nested elements.

    ``compression``: of the files, None: plain.  One task reads a compressed file, so these hold a million elements at most."""
    w = df.write.mode(mode).format("xml").option("rootTag", root_tag).option("rowTag", row_tag).option("attributePrefix", "_")
    if compression:
        w = w.option("compression", compression).option("maxRecordsPerFile", 1_000_000)
    w.save(path)


def xml_nodes(stations: DataFrame, station_id: str = "ID", lat: str = "Geo_x", lon: str = "Geo_y",
              node_type: str = "priority") -> DataFrame:
    """``<node id x y type>``: x = longitude, y = latitude (the exporter swaps the axes)."""
    return stations.select(F.col(station_id).cast("string").alias("_id"), F.col(lon).alias("_x"),
                           F.col(lat).alias("_y"), F.lit(node_type).alias("_type"))


def both_ends_in(links: DataFrame, stations: DataFrame, dep: str = "Departure_station_id",
                 arr: str = "Arrival_station_id", station_id: str = "ID") -> DataFrame:
    """Links of which both ends are among the selected ``stations``."""
    chosen = stations.select(F.col(station_id).alias("_sid")).distinct()
    for end in (dep, arr):
        links = links.join(chosen, F.col(end) == F.col("_sid"), "left_semi")
    return links


def xml_edges(links: DataFrame, stations: DataFrame | None = None, dep: str = "Departure_station_id",
              arr: str = "Arrival_station_id", distance_km: str = "Distance", shape: str = "Coordinates",
              speed: float = 27.0, station_id: str = "ID") -> DataFrame:
    """``<edge id="a_b" from to priority numLanes length(m) speed allow shape="x,y ...">``.

    With ``stations`` only links of which both ends are selected."""
    if stations is not None:
        links = both_ends_in(links, stations, dep, arr, station_id)
    pts = F.transform(F.col(shape), lambda p: F.concat_ws(",", p[1].cast("string"), p[0].cast("string")))
    return links.select(F.concat_ws("_", dep, arr).alias("_id"), F.col(dep).cast("string").alias("_from"),
                        F.col(arr).cast("string").alias("_to"), F.lit(2).alias("_priority"),
                        F.lit(1).alias("_numLanes"), (F.col(distance_km) * 1000).alias("_length"),
                        F.lit(speed).alias("_speed"), F.lit("rail").alias("_allow"),
                        F.array_join(pts, " ").alias("_shape"))


def xml_platforms(links: DataFrame, stations: DataFrame, dep: str = "Departure_station_id",
                  arr: str = "Arrival_station_id", station_id: str = "ID", name: str = "Name") -> DataFrame:
    """``<trainStop id="a->b" lane="a_b_0" name="A to B platform" startPos endPos>`` per link of which
    both ends are among ``stations``."""
    j = links
    for end, n in ((dep, "_dn"), (arr, "_an")):
        nm = stations.select(F.col(station_id).alias(n + "_id"), F.coalesce(F.col(name).cast("string"), F.lit("")).alias(n))
        j = j.join(nm, F.col(end) == F.col(n + "_id"))
    j = j.withColumn("_name", F.concat("_dn", F.lit(" to "), "_an", F.lit(" platform")))
    return j.select(F.concat_ws("->", dep, arr).alias("_id"), F.concat(F.concat_ws("_", dep, arr), F.lit("_0")).alias("_lane"),
                    "_name", F.lit(80).alias("_startPos"), F.lit(300).alias("_endPos"))


def xml_trips(od: DataFrame, vtype: str = "myTrain") -> DataFrame:
    """``<trip id depart from to type>`` from ``od_per_trip``."""
    return od.select(F.col("id").alias("_id"), F.col("depart").alias("_depart"), F.col("from_edge").alias("_from"),
                     F.col("to_edge").alias("_to"), F.lit(vtype).alias("_type"))


def xml_routes(routes: DataFrame, vtype: str = "myTrain") -> DataFrame:
    """``<vehicle id type depart><route edges/><stop trainStop until duration/>...`` from ``route_edges``."""
    return routes.select(F.concat(F.lit("train_"), F.col("trip_id").cast("string")).alias("_id"),
                         F.lit(vtype).alias("_type"), F.col("depart").alias("_depart"),
                         F.struct(F.col("edges").alias("_edges")).alias("route"),
                         F.transform("stops", lambda s: F.struct(s["trainStop"].alias("_trainStop"),
                                                                 s["until"].alias("_until"),
                                                                 s["duration"].alias("_duration"))).alias("stop"))


def base_date_from_xml(spark: SparkSession, path: str) -> DataFrame:
    """First ``YYYY-MM-DD`` in the root element's start tag, else in the last ``<step`` tag; one row.

    The text is cut at every ``<``, so a start tag may run over any number of lines; tags are told
    by their place in the file.  A comment or declaration is no element.
    """
    t = spark.read.option("lineSep", "<").text(path).withColumn("_pos", F.monotonically_increasing_id())
    tag = F.regexp_extract("value", r"""^([A-Za-z_](?:[^"'<>]|"[^"]*"|'[^']*')*)""", 1)
    t = t.select("_pos", tag.alias("_tag")).filter(F.col("_tag") != "") \
        .withColumns({"_d": F.nullif(F.regexp_extract("_tag", r"\b(\d{4}-\d{2}-\d{2})\b", 1), F.lit("")),
                      "_step": F.col("_tag").rlike(r"^step(\s|/|$)")})
    agg = t.agg(F.min_by("_d", "_pos").alias("_r"), F.max_by("_d", F.when(F.col("_step"), F.col("_pos"))).alias("_s"))
    return agg.select(F.try_to_date(F.coalesce("_r", "_s"), "yyyy-MM-dd").alias("base_date"))


# ------------------------------------------------------------------ GeoJSON lines


def geojson_features(df: DataFrame, path: str = "Path", id_col: str = "ID") -> DataFrame:
    """One LineString Feature per row (``[lon, lat]`` coordinates); rows with < 2 points skipped."""
    p = F.col(path)
    feat = F.struct(F.lit("Feature").alias("type"),
                    F.struct(F.col(id_col).alias("id"), p[0][0].alias("start_lat"), p[0][1].alias("start_lon"),
                             F.element_at(p, -1)[0].alias("end_lat"), F.element_at(p, -1)[1].alias("end_lon"))
                    .alias("properties"),
                    F.struct(F.lit("LineString").alias("type"),
                             F.transform(p, lambda q: F.array(q[1], q[0])).alias("coordinates")).alias("geometry"))
    return df.filter(F.size(path) >= 2).select(F.to_json(feat).alias("value"))


def sink_geojson(df: DataFrame, out: str, path: str = "Path", id_col: str = "ID") -> None:
    geojson_features(df, path, id_col).write.mode("overwrite").text(out)


GEOJSON_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.StructType([T.StructField("id", T.LongType()),
                                              T.StructField("start_lat", T.DoubleType()),
                                              T.StructField("start_lon", T.DoubleType()),
                                              T.StructField("end_lat", T.DoubleType()),
                                              T.StructField("end_lon", T.DoubleType())])),
    T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()),
                                            T.StructField("coordinates", T.ArrayType(T.ArrayType(T.DoubleType())))])),
])


def scan_geojson(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", GEOJSON_SCHEMA).alias("f")).select("f.*")
