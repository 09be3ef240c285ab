"""Profiles and data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railspark.functions.geo import lat_of, lon_of
from railspark.functions.scalar import isclose
from railspark.operators.loops import materialise
from railspark.operators.relational import join_both_endpoints, union_distinct_endpoints, found_ratio


METRICS = ("distinct_count", "null_count", "blank_count")


def _steady(f: T.StructField, c: Column | None = None) -> Column:
    """The column with -0.0 as 0.0, which grouping treats as equal and hashing does not."""
    c = F.col(f"`{f.name}`") if c is None else c
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return c + F.lit(0.0).cast(f.dataType)
    if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType)):
        return F.transform(c, lambda x: x + F.lit(0.0).cast(f.dataType.elementType))
    return c


def _digests(df: DataFrame) -> DataFrame:
    """``(column, h1, h2)``: a 128-bit digest of every value that is not NULL."""
    cells = [F.when(F.col(f"`{f.name}`").isNotNull(),
                    F.struct(F.lit(i).alias("column"), F.xxhash64(_steady(f)).alias("h1"), F.xxhash64(F.lit(i), F.lit("second"), _steady(f)).alias("h2")))
             for i, f in enumerate(df.schema.fields)]
    return df.select(F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))


def profile(df: DataFrame, approx: bool = False, metrics=METRICS) -> DataFrame:
    """One row per column: distinct (NULL not counted), null and blank counts.

    Null and blank counts are one aggregation of one scan.  Distinct values are counted by their
    128-bit digests in rows (column, digest), first within each task and then by digest, so no
    text is shuffled and columns do not multiply the aggregation.  ``approx=True`` estimates them
    from mergeable sketches (``profile_sketches``).
    """
    names = [f.name for f in df.schema.fields]
    counted = [m for m in metrics if m != "distinct_count"]
    out = df.sparkSession.createDataFrame(list(enumerate(names)), "column int, column_name string")
    if counted:
        aggs = []
        for i, f in enumerate(df.schema.fields):
            c = F.col(f"`{f.name}`")
            made = {"null_count": F.count_if(c.isNull()),
                    "blank_count": F.count_if(c == "") if isinstance(f.dataType, T.StringType) else F.lit(None).cast("long")}
            aggs += [made[m].alias(f"{m}_{i}") for m in counted]
        stack = ", ".join(", ".join([str(i), *(f"{m}_{i}" for m in counted)]) for i in range(len(names)))
        out = out.join(df.agg(*aggs).selectExpr(f"stack({len(names)}, {stack}) AS (column, {', '.join(counted)})"), "column")
    if "distinct_count" in metrics:
        if approx:
            per = profile_sketches(df).select("column", F.hll_sketch_estimate("sketch").alias("distinct_count"))
        else:
            per = _digests(df).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
        out = out.join(per, "column", "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0).cast("long")))
    return out.select("column_name", *metrics)


def profile_sketches(df: DataFrame) -> DataFrame:
    """``(column, column_name, sketch)``: a distinct-count sketch per column, to be stored and merged."""
    names = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "column int, column_name string")
    return _digests(df).groupBy("column").agg(F.hll_sketch_agg("h1").alias("sketch")).join(names, "column")


def merge_sketches(stored: DataFrame) -> DataFrame:
    """``(column_name, distinct_count)`` of stored sketches of any number of tables with these columns."""
    return stored.groupBy("column_name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count"))


#: Bits of the fingerprint filter: at least and at most (16 MB as pages of 4 KB).
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 27


def duplicate_rows(df: DataFrame, cols=None) -> DataFrame:
    """Groups of fully equal rows that occur more than once, with their count.

    A first pass counts 64-bit fingerprints of the rows.  Those seen twice or more are set in a
    bitmap, eight bits apiece up to ``MOST_BITS``, whose pages go to every task (at most 16 MB);
    only rows that hit a set bit are grouped by all their columns, so unique rows are hardly ever
    shuffled, and equality is by the values themselves.
    """
    cols = list(cols or df.columns)
    fields = {f.name: f for f in df.schema.fields}
    mark = F.xxhash64(*[_steady(fields[c]) for c in cols])
    twice = materialise(df.select(mark.alias("_m")).groupBy("_m").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_m"))
    bits = min(max(LEAST_BITS, 1 << max(0, (8 * twice.count()) - 1).bit_length()), MOST_BITS)
    place = lambda c: F.pmod(c, F.lit(bits).cast("long"))
    # a position p is bit p mod 32768 of page p div 32768
    pages = twice.select(place(F.col("_m")).alias("_p")).groupBy(F.floor(F.col("_p") / 32768).alias("_page")) \
        .agg(F.call_function("bitmap_construct_agg", F.pmod("_p", F.lit(32768).cast("long"))).alias("_bits"))
    rows = df.select(*cols).withColumn("_p", place(mark))
    rows = rows.join(F.broadcast(pages), F.floor(F.col("_p") / 32768) == F.col("_page"))
    at = F.pmod("_p", F.lit(32768).cast("long"))
    byte = F.conv(F.hex(F.col("_bits").substr((F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = rows.filter(F.getbit(byte, (at % 8).cast("int")) == 1)
    return rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


def check_station_ids(links: DataFrame, stations: DataFrame, dep: str = "Departure_station_id",
                      arr: str = "Arrival_station_id", station_id: str = "ID") -> tuple[DataFrame, DataFrame]:
    """Link endpoints present in stations: (found/total/ratio row, missing ids)."""
    ends = union_distinct_endpoints(links, dep, arr, "station")
    ratio = found_ratio(ends, stations, "station", station_id)
    missing = ends.filter(F.col("station").isNotNull()).join(
        stations.select(F.col(station_id).alias("station")), "station", "left_anti")
    return ratio, missing


def endpoint_flags(links: DataFrame, stations: DataFrame, path: str = "Coordinates", atol: float | None = None,
                   rtol: float = 1e-5, dep: str = "Departure_station_id", arr: str = "Arrival_station_id",
                   station_id: str = "ID", lat: str = "Geo_x", lon: str = "Geo_y") -> DataFrame:
    """Per link: does the departure (arrival) station coordinate equal the line's start OR end point.

    ``atol=None`` -> exact equality; else numpy-style ``isclose`` with ``rtol`` (card F3).
    """
    j = join_both_endpoints(links, stations, dep, arr, station_id, (lat, lon))
    first, last = F.try_element_at(path, F.lit(1)), F.try_element_at(path, F.lit(-1))

    def eq(a, b):
        if atol is None:
            return F.coalesce(a == b, F.lit(False))
        return isclose(a, b, rtol, atol)

    def at(prefix, p):
        return eq(F.col(prefix + lat), lat_of(p)) & eq(F.col(prefix + lon), lon_of(p))

    return j.withColumns({"dep_ok": at("dep_", first) | at("dep_", last),
                          "arr_ok": at("arr_", first) | at("arr_", last)}) \
        .withColumn("both_ok", F.col("dep_ok") & F.col("arr_ok"))


def check_endpoints(links: DataFrame, stations: DataFrame, **kw) -> DataFrame:
    """Counts of links whose departure / arrival / both endpoints match the polyline ends."""
    f = endpoint_flags(links, stations, **kw)
    return f.agg(F.count(F.lit(1)).alias("links"), F.count_if("dep_ok").alias("dep_ok"),
                 F.count_if("arr_ok").alias("arr_ok"), F.count_if("both_ok").alias("both_ok"))


def failing_endpoints(links: DataFrame, stations: DataFrame, **kw) -> DataFrame:
    return endpoint_flags(links, stations, **kw).filter(~F.col("both_ok"))


def correct_stations(stations: DataFrame, new_rows: DataFrame | None = None, fixes: DataFrame | None = None,
                     fix_key: str = "Name", fix_col: str = "Code", id_col: str = "ID") -> DataFrame:
    """Append rows, fix a column by key (corrections table), drop rows holding NULLs, id to int."""
    from railspark.operators.clean import apply_corrections, dropna_any
    out = stations if new_rows is None else stations.unionByName(new_rows, allowMissingColumns=True)
    if fixes is not None:
        out = apply_corrections(out, fixes, fix_key, [fix_col])
    out = dropna_any(out)
    return out.withColumn(id_col, F.col(id_col).try_cast("int"))


def station_directory(links: DataFrame, stations: DataFrame, dep: str = "Departure_station_id",
                      arr: str = "Arrival_station_id", station_id: str = "ID", cols=("Name",)) -> DataFrame:
    """Distinct stations used by links, with their attributes (NULL when unknown)."""
    ends = union_distinct_endpoints(links, dep, arr, station_id).filter(F.col(station_id).isNotNull())
    s = stations.select(station_id, *cols)
    return ends.join(s, station_id, "left").distinct()


def duplicate_keys(df: DataFrame, key: str = "ID") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


def anchors_valid(anchors: DataFrame, base_nodes: DataFrame, node: str = "node", anchor_list: str = "anchors",
                  base_col: str = "node") -> DataFrame:
    """Anchors that are NOT nodes of the base graph (must be empty)."""
    ex = anchors.select(F.explode(anchor_list).alias("anchor")).distinct()
    return ex.join(base_nodes.select(F.col(base_col).alias("anchor")), "anchor", "left_anti")
