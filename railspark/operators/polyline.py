"""Array / polyline operators.

Polylines are ``array<array<double>>`` of ``[lat, lon(, z)]``.  Order-dependent
folds use the built-in ``aggregate`` higher-order function over point indices,
so a polyline is processed inside one row without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspark.functions.geo import flip_point, lat_of, lon_of, point_distance_m, path_length_m, turning_angle, z_of
from railspark.functions.scalar import col_of
from railspark.operators.loops import chain_from, materialise_input
from railspark.operators.windows import number_rows, running_sum


def polyline_flip(path, n: int | None = 6) -> Column:
    """``[lon, lat(, z)]`` points -> ``[lat, lon(, z)]`` (rounded to ``n`` decimals)."""
    return F.transform(col_of(path), lambda p: flip_point(p, n))


def polyline_endpoints(df: DataFrame, path: str, first: str = "first_point", last: str = "last_point") -> DataFrame:
    return df.withColumns({first: F.try_element_at(path, F.lit(1)), last: F.try_element_at(path, F.lit(-1))})


def polyline_dedupe(path) -> Column:
    """Remove repeated points, keeping the first occurrence order."""
    return F.array_distinct(col_of(path))


def point_normalise(p) -> Column:
    """lat/lon rounded to 6 decimals, z to 2 (0.0 when absent)."""
    p = col_of(p)
    return F.array(F.round(lat_of(p), 6), F.round(lon_of(p), 6), F.round(F.coalesce(z_of(p), F.lit(0.0)), 2))


def segment_length(path) -> Column:
    return path_length_m(path)


def split_bounds(path, max_m: float = 800.0) -> Column:
    """Card G5 fold on indices: pieces as ``array<struct<s, e>>`` (1-based inclusive point indices).

    Append the next point while the running length stays <= ``max_m``; otherwise close the
    current piece (if it has >= 2 points) and restart with ``[prev, cur]``.
    """
    path = col_of(path)
    n = F.size(path)
    mx = F.lit(float(max_m))
    init = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("pieces"), F.lit(1).alias("start"),
                    F.lit(0.0).alias("len"))

    def step(acc, i):  # i: 1-based index of the step's end point (2..n)
        s = point_distance_m(F.get(path, i - 2), F.get(path, i - 1))
        fits = acc["len"] + s <= mx
        closed = F.when(i - 1 - acc["start"] >= 1,
                        F.concat(acc["pieces"], F.array(F.struct(acc["start"].alias("s"), (i - 1).alias("e")))))\
            .otherwise(acc["pieces"])
        return F.when(fits, F.struct(acc["pieces"].alias("pieces"), acc["start"].alias("start"),
                                     (acc["len"] + s).alias("len"))) \
            .otherwise(F.struct(closed.alias("pieces"), (i - 1).alias("start"), s.alias("len")))

    def finish(acc):
        return F.when(n - acc["start"] >= 1,
                      F.concat(acc["pieces"], F.array(F.struct(acc["start"].alias("s"), n.alias("e"))))) \
            .otherwise(acc["pieces"])

    return F.when(n >= 2, F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), init, step, finish)) \
        .otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def polyline_split(df: DataFrame, path: str = "Path", max_m: float = 800.0, id_col: str = "ID") -> DataFrame:
    """One row per piece: ``id, piece, start_idx, end_idx, Path, Length_m``; paths with < 2 points dropped."""
    b = df.filter(F.size(path) >= 2).select(id_col, path, F.posexplode(split_bounds(path, max_m)).alias("piece", "b"))
    piece = F.slice(F.col(path), F.col("b.s"), F.col("b.e") - F.col("b.s") + 1)
    return b.select(id_col, "piece", F.col("b.s").alias("start_idx"), F.col("b.e").alias("end_idx"),
                    piece.alias(path)).withColumn("Length_m", path_length_m(path))


def oversized_steps(df: DataFrame, path: str = "Path", max_m: float = 800.0, id_col: str = "ID") -> DataFrame:
    """Steps longer than ``max_m``: ``id, from_idx, to_idx (0-based), length_m``."""
    p = F.col(path)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))),
                        lambda i: F.struct((i - 1).alias("from_idx"), i.alias("to_idx"),
                                           point_distance_m(F.get(p, i - 1), F.get(p, i)).alias("length_m")))
    return df.filter(F.size(path) >= 2).select(id_col, F.inline(F.filter(steps, lambda s: s["length_m"] > max_m)))


def vertices(df: DataFrame, path: str = "Path", id_col: str = "ID") -> DataFrame:
    """Polylines as rows: ``id, pos (from 1), point``."""
    return df.select(id_col, F.posexplode(path).alias("pos", "point")).withColumn("pos", F.col("pos") + 1)


def split_rows(points: DataFrame, max_m: float = 800.0, id_col: str = "ID", pos: str = "pos", point: str = "point",
               bucket_rows: int = 1 << 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Card G5 on vertex rows, for lines of any length.

    A piece from vertex k reaches the furthest vertex within ``max_m`` along the line, and one
    step at least; the next starts where it ends.  Lengths are prefix sums, in buckets of
    ``bucket_rows`` vertices; the furthest vertex is looked up among those of the same ``max_m``
    cell of the line and, as of the limit, of the next cell; the pieces' starts are the chain of
    these pointers from every line's first vertex.  Vertices keep the order of ``pos``.

    Returns ``pieces(id, piece, start_idx, end_idx, Length_m)`` (1-based indices), their
    vertices ``members(id, piece, pos, point)`` with the shared ends in both pieces, and
    ``oversized(id, from_idx, to_idx, length_m)`` (0-based), the single steps above ``max_m``.
    Lines with fewer than two vertices have no pieces.
    """
    v = materialise_input(number_rows(points.select(F.col(id_col).alias("_id"), F.col(pos).alias("_pos"), F.col(point).alias("_p")), ["_id", "_pos"], "_g"))
    before = v.select((F.col("_g") + 1).alias("_g"), F.col("_id").alias("_bid"), F.col("_p").alias("_bp"))
    v = v.join(before, "_g", "left").withColumn("_step", F.when(F.col("_bid") == F.col("_id"), point_distance_m("_bp", "_p")))
    first = v.groupBy("_id").agg(F.min("_g").alias("_first"), F.max("_g").alias("_last"))
    v = running_sum(v.drop("_bid", "_bp"), ["_id"], ["_g"], F.coalesce("_step", F.lit(0.0)), "_at", F.floor(F.col("_g") / bucket_rows))
    v = materialise_input(v.join(first, "_id").withColumn("_cell", F.floor(F.col("_at") / max_m)))
    ask = v.select("_id", (F.col("_cell") + 1).alias("_cell"), (F.col("_at") + max_m).alias("_x"), F.col("_g").alias("_q"), F.lit(None).cast("long").alias("_c"))
    have = v.select("_id", "_cell", F.col("_at").alias("_x"), F.lit(None).cast("long").alias("_q"), F.col("_g").alias("_c"))
    upto = Window.partitionBy("_id", "_cell").orderBy("_x", F.col("_c").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = ask.unionByName(have).withColumn("_to", F.max("_c").over(upto)).filter("_q is not null").select(F.col("_q").alias("_g"), "_to")
    near = v.groupBy("_id", "_cell").agg(F.max("_g").alias("_near"))
    reach = v.join(ahead, "_g").join(near, ["_id", "_cell"]).filter(F.col("_g") < F.col("_last")) \
        .select("_g", F.greatest(F.coalesce("_to", "_near"), F.col("_g") + 1).alias("_to"))
    reach = materialise_input(reach)
    starts = chain_from(first.select(F.col("_first").alias("_g")), reach).withColumn("_start", F.lit(1).cast("long"))
    numbered = running_sum(v.join(starts, "_g", "left"), ["_id"], ["_g"], F.coalesce("_start", F.lit(0).cast("long")), "_piece", F.floor(F.col("_g") / bucket_rows))
    numbered = materialise_input(numbered.withColumn("_piece", (F.col("_piece") - 1).cast("int")))
    ends = numbered.select(F.col("_g").alias("_to"), F.col("_pos").alias("_epos"), F.col("_at").alias("_eat"))
    pieces = numbered.filter("_start = 1").join(reach, "_g").join(ends, "_to") \
        .select(F.col("_id").alias(id_col), F.col("_piece").alias("piece"), F.col("_pos").alias("start_idx"), F.col("_epos").alias("end_idx"),
                (F.col("_eat") - F.col("_at")).alias("Length_m"))
    several = F.col("_last") > F.col("_first")
    # a line's last vertex starts nothing: the chain ends there, and it belongs to the piece before
    own = numbered.filter(several & (F.col("_start").isNull() | (F.col("_g") < F.col("_last")))).select("_id", "_piece", "_pos", "_p")
    shared = numbered.filter(several & (F.col("_start") == 1) & (F.col("_g") > F.col("_first"))).select("_id", (F.col("_piece") - 1).alias("_piece"), "_pos", "_p")
    members = own.unionByName(shared).toDF(id_col, "piece", pos, point)
    oversized = v.filter(F.col("_step") > max_m).select(F.col("_id").alias(id_col), (F.col("_pos") - 2).alias("from_idx"), (F.col("_pos") - 1).alias("to_idx"),
                                                       F.col("_step").alias("length_m"))
    return pieces, members, oversized


def vertex_angles(df: DataFrame, path: str = "Path", id_col: str = "ID") -> DataFrame:
    """Card G6: deviation angle at every interior vertex (``pos`` 1-based), NULL for zero-length sides."""
    p = F.col(path)
    ang = F.transform(F.sequence(F.lit(2), F.greatest(F.size(p) - 1, F.lit(2))),
                      lambda i: F.struct(i.alias("pos"), turning_angle(F.get(p, i - 2), F.get(p, i - 1), F.get(p, i))
                                         .alias("angle")))
    return df.filter(F.size(path) >= 3).select(id_col, F.inline(ang))


def polyline_replace_end(df: DataFrame, corrections: DataFrame, dep: str = "Departure_station_id",
                         arr: str = "Arrival_station_id", path: str = "Coordinates") -> DataFrame:
    """Replace the first (``first``=true) or last point of the listed links' polylines.

    ``corrections(dep, arr, first, lat, lon)``; at most one correction per (link, end).
    """
    c = corrections.select(F.col(dep).alias("_cd"), F.col(arr).alias("_ca"), F.col("first").alias("_first"),
                           F.array(F.col("lat").cast("double"), F.col("lon").cast("double")).alias("_p"))
    cf = c.filter("_first").select("_cd", "_ca", F.col("_p").alias("_pf"))
    cl = c.filter(~F.col("_first")).select("_cd", "_ca", F.col("_p").alias("_pl"))
    out = df
    for t in (cf, cl):
        out = out.join(t, (F.col(dep) == F.col("_cd")) & (F.col(arr) == F.col("_ca")), "left").drop("_cd", "_ca")
    a = F.col(path)
    n = F.size(a)
    with_first = F.when(F.col("_pf").isNotNull() & (n >= 1),
                        F.concat(F.array("_pf"), F.slice(a, 2, F.greatest(n - 1, F.lit(0))))).otherwise(a)
    res = out.withColumn(path, with_first)
    a = F.col(path)
    n = F.size(a)
    res = res.withColumn(path, F.when(F.col("_pl").isNotNull() & (n >= 1),
                                      F.concat(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), F.array("_pl"))).otherwise(a))
    return res.drop("_pf", "_pl")


def polyline_orient(links: DataFrame, stations: DataFrame, raw: str = "Shape", order: str = "ord",
                    dep: str = "Departure_station_id", arr: str = "Arrival_station_id", station_id: str = "ID",
                    lat: str = "Geo_x", lon: str = "Geo_y", out: str = "Coordinates") -> DataFrame:
    """Card G3.  Shape from ``[lon, lat]`` -> deduplicated ``[lat, lon]``; a link whose reverse twin
    (b, a) comes earlier in ``order`` reuses the twin's reversed shape; finally a shape is reversed
    only when its last point is closer (squared degrees) to the departure station than its first (FIX).
    """
    st = stations.select(F.col(station_id).alias("_sid"), F.col(lat).alias("_slat"), F.col(lon).alias("_slon"))

    def orient(df, shape_col):
        j = df.join(st, F.col(dep) == F.col("_sid"), "left")
        a = F.col(shape_col)
        first, last = F.try_element_at(a, F.lit(1)), F.try_element_at(a, F.lit(-1))

        def d2(p):
            return F.pow(lat_of(p) - F.col("_slat"), 2) + F.pow(lon_of(p) - F.col("_slon"), 2)
        flip = F.coalesce(d2(last) < d2(first), F.lit(False))
        return j.withColumn(shape_col, F.when(flip, F.reverse(a)).otherwise(a)).drop("_sid", "_slat", "_slon")

    own = orient(links.withColumn("_own", polyline_dedupe(polyline_flip(raw))), "_own")
    twin = own.select(F.col(dep).alias("_td"), F.col(arr).alias("_ta"), F.col(order).alias("_to"),
                      F.reverse("_own").alias("_tw"))
    j = own.join(twin, (F.col(dep) == F.col("_ta")) & (F.col(arr) == F.col("_td")) & (F.col("_to") < F.col(order)),
                 "left")
    j = j.withColumn(out, F.coalesce("_tw", "_own")).drop("_td", "_ta", "_to", "_tw", "_own")
    return orient(j, out)


def split_multi_station_tracks(tracks: DataFrame, assigned: DataFrame, max_m: float = 800.0,
                               id_col: str = "ID", path: str = "Path", order: str = "ID",
                               station: str = "Station_ID", track: str = "track_id") -> tuple[DataFrame, DataFrame]:
    """Split only the tracks serving more than one station; pass the others through whole.

    Returns ``(switches(ID, X, Y), tracks(ID, Departure_switch, Arrival_switch, Path, Length_m))``;
    switch and track ids are numbered in first-seen order (track order, piece, start before end).
    """
    multi = assigned.groupBy(F.col(track).alias("_tid")).agg(F.count_distinct(station).alias("_ns")) \
        .filter(F.col("_ns") > 1).select("_tid", F.lit(True).alias("_multi"))
    t = tracks.filter(F.size(path) >= 2).join(multi, F.col(id_col) == F.col("_tid"), "left")
    bounds = F.when(F.coalesce("_multi", F.lit(False)), split_bounds(path, max_m)) \
        .otherwise(F.array(F.struct(F.lit(1).alias("s"), F.size(path).alias("e"))))
    pieces = t.select(F.col(order).alias("_ord"), path, F.posexplode(bounds).alias("_piece", "_b"))
    pieces = pieces.select("_ord", "_piece", F.slice(F.col(path), F.col("_b.s"), F.col("_b.e") - F.col("_b.s") + 1)
                           .alias("Path"))
    pieces = pieces.withColumns({"_start": point_normalise(F.col("Path")[0]),
                                 "_end": point_normalise(F.element_at("Path", -1))})
    ends = pieces.select("_ord", "_piece", F.lit(0).alias("_side"), F.col("_start").alias("_pt")).unionByName(
        pieces.select("_ord", "_piece", F.lit(1).alias("_side"), F.col("_end").alias("_pt")))
    first_seen = ends.groupBy("_pt").agg(F.min(F.struct("_ord", "_piece", "_side")).alias("_fs"))
    switches = number_rows(first_seen, ["_fs"], "ID")
    sw = switches.select(F.col("_pt"), F.col("ID"))
    numbered = number_rows(pieces, ["_ord", "_piece"], "ID")
    tr = (numbered.join(sw.withColumnRenamed("_pt", "_start").withColumnRenamed("ID", "Departure_switch"), "_start")
          .join(sw.withColumnRenamed("_pt", "_end").withColumnRenamed("ID", "Arrival_switch"), "_end")
          .select("ID", "Departure_switch", "Arrival_switch", "Path", path_length_m("Path").alias("Length_m")))
    return switches.select("ID", F.col("_pt")[0].alias("X"), F.col("_pt")[1].alias("Y")), tr
