"""Joins, aggregations, sorts and set operations.

No join asks for a broadcast: the engine picks one from real byte sizes, at planning or
(AQE) at run time, and no job runs while a plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspark.operators.loops import materialise_input
from railspark.functions.scalar import col_of

# ---------------------------------------------------------------- joins (§2.3)


def join_both_endpoints(links: DataFrame, stations: DataFrame, dep: str = "Departure_station_id",
                        arr: str = "Arrival_station_id", station_id: str = "ID", cols=("Geo_x", "Geo_y"),
                        prefixes=("dep_", "arr_")) -> DataFrame:
    """Left-join station attributes twice, once per endpoint, with prefixed column names."""
    out = links
    for key, pre in zip((dep, arr), prefixes):
        d = stations.select(F.col(station_id).alias(f"{pre}{station_id}"), *[F.col(c).alias(pre + c) for c in cols])
        out = out.join(d, F.col(key) == F.col(f"{pre}{station_id}"), "left").drop(f"{pre}{station_id}")
    return out


def join_next_dim(df: DataFrame, dim: DataFrame, next_col: str, dim_id: str, cols, prefix: str = "next_") -> DataFrame:
    d = dim.select(F.col(dim_id).alias("_nid"), *[F.col(c).alias(prefix + c) for c in cols])
    return df.join(d, F.col(next_col) == F.col("_nid"), "left").drop("_nid")


def last_wins(df: DataFrame, key, order) -> DataFrame:
    """One row per key: the last one along ``order`` (dict built from rows, later rows overwrite)."""
    keys = [key] if isinstance(key, str) else list(key)
    o = F.struct(*[col_of(c) for c in ([order] if isinstance(order, (str, Column)) else order)])
    cols = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), o).alias("_r"))
    return g.select(*keys, *[F.col("_r")[c].alias(c) for c in cols])


def join_lookup_last_wins(df: DataFrame, lookup: DataFrame, left_key: str, key: str, order) -> DataFrame:
    lk = last_wins(lookup, key, order)
    return df.join(lk, df[left_key] == lk[key], "left")


def semi_membership(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    o = other.select(F.col(right).alias("_k"))
    return df.join(o, F.col(left) == F.col("_k"), "left_semi")


def anti_missing(keys: DataFrame, ref: DataFrame, left: str, right: str) -> DataFrame:
    o = ref.select(F.col(right).alias("_k"))
    return keys.join(o, F.col(left) == F.col("_k"), "left_anti")


def found_ratio(keys: DataFrame, ref: DataFrame, left: str, right: str) -> DataFrame:
    """found / total / percentage of distinct ``left`` keys present in ``ref``."""
    k = keys.select(F.col(left).alias("_k")).filter(F.col("_k").isNotNull()).distinct()
    r = ref.select(F.col(right).alias("_k"), F.lit(True).alias("_hit")).distinct()
    j = k.join(r, "_k", "left")
    return j.agg(F.count_if(F.col("_hit").isNotNull()).alias("found"), F.count(F.lit(1)).alias("total")) \
        .withColumn("ratio_pct", F.round(F.lit(100.0) * F.col("found") / F.col("total"), 4))


def undirected_pair_join(edges: DataFrame, tracks: DataFrame, edge_id: str = "id", e_from: str = "from",
                         e_to: str = "to", e_order: str = "ord", track_id: str = "track_id",
                         t_a: str = "a", t_b: str = "b", t_order: str = "ord", t_length: str | None = None) -> DataFrame:
    """Card J4: for each edge the first track (input order) joining the same two nodes in either
    direction; from/to are the track's own start/end, length its length rounded to 6 decimals.
    Duplicate edge ids: the last edge row (input order) that matched a track wins."""
    e = edges.select(F.col(edge_id), F.col(e_order).alias("_eo"),
                     F.least(e_from, e_to).alias("_lo"), F.greatest(e_from, e_to).alias("_hi"))
    length = F.round(F.col(t_length).cast("double"), 6) if t_length else F.lit(None).cast("double")
    t = tracks.select(F.col(track_id).alias("_tid"), F.col(t_a).alias("_ta"), F.col(t_b).alias("_tb"),
                      F.col(t_order).alias("_to"), length.alias("_len"),
                      F.least(t_a, t_b).alias("_lo"), F.greatest(t_a, t_b).alias("_hi"))
    j = e.join(t, ["_lo", "_hi"])
    per_row = j.groupBy(edge_id, "_eo").agg(F.min_by(F.struct("_tid", "_ta", "_tb", "_len"), "_to").alias("_m"))
    best = per_row.groupBy(edge_id).agg(F.max_by("_m", "_eo").alias("_m"))
    return best.select(edge_id, F.col("_m._tid").alias("track_id"), F.col("_m._ta").alias("from"),
                       F.col("_m._tb").alias("to"), F.col("_m._len").alias("length"))


def array_membership_join(station_tracks: DataFrame, edges: DataFrame, station: str = "Station_ID",
                          tracks: str = "tracks", edge_id: str = "edge_id", edge_track: str = "track") -> DataFrame:
    """Edges whose track is in the station's track list -> sorted edge list per station; stations
    without a match keep an empty list."""
    ex = station_tracks.select(station, F.explode_outer(tracks).alias("_t"))
    e = edges.select(F.col(edge_track).alias("_t"), F.col(edge_id).alias("_e"))
    j = ex.join(e, "_t", "left")
    return j.groupBy(station).agg(F.array_sort(F.collect_set("_e")).alias("edges"))


def edge_incidence(edges: DataFrame, edge_id: str = "id", a: str = "a", b: str = "b") -> DataFrame:
    """(edge, node) incidence rows: the line graph's adjacency without materialising pairs.

    Two edges are adjacent iff they share a ``node`` row.  Emitting all ordered pairs per node
    would grow with the square of the node degree, so operators walk this table instead.
    """
    return (edges.select(F.col(edge_id).alias("edge"), F.col(a).alias("node"))
            .unionByName(edges.select(F.col(edge_id).alias("edge"), F.col(b).alias("node"))).distinct())


def shared_node_degree(edges: DataFrame, edge_id: str = "id", a: str = "a", b: str = "b") -> DataFrame:
    """Number of other edges sharing a node with each edge (line-graph degree), from node degrees."""
    inc = edge_incidence(edges, edge_id, a, b)
    deg = inc.groupBy("node").agg(F.count(F.lit(1)).alias("_deg"))
    j = inc.join(deg, "node")
    return j.groupBy("edge").agg(F.sum(F.col("_deg") - 1).alias("adjacent_edges"))


def reverse_edge_join(edges: DataFrame, src: str = "src", dst: str = "dst", cols=()) -> DataFrame:
    """Attach the attributes of the reverse edge (b, a) to each edge (a, b); NULL when absent."""
    r = edges.select(F.col(src).alias("_rd"), F.col(dst).alias("_rs"), F.lit(True).alias("has_reverse"),
                     *[F.col(c).alias("rev_" + c) for c in cols])
    j = edges.join(r, (F.col(src) == F.col("_rs")) & (F.col(dst) == F.col("_rd")), "left").drop("_rs", "_rd")
    return j.withColumn("has_reverse", F.coalesce("has_reverse", F.lit(False)))


def neighbour_expand(edges: DataFrame, seeds: DataFrame, keep_seeds: bool = False,
                     src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct one-hop (outgoing) neighbours of the seed set, seeds excluded unless ``keep_seeds``."""
    s = seeds.select(F.col(seeds.columns[0]).alias("station")).distinct()
    hop = edges.join(s, F.col(src) == F.col("station"), "left_semi").select(F.col(dst).alias("station")) \
        .filter(F.col("station").isNotNull()).distinct()
    return hop.unionByName(s).distinct() if keep_seeds else hop.join(s, "station", "left_anti")


# ---------------------------------------------------------------- aggregations (§2.4)


def group_nunique_having(df: DataFrame, key: str, value: str, more_than: int = 1, out: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(value).alias(out)).filter(F.col(out) > more_than)


def global_nunique(df: DataFrame, cols) -> DataFrame:
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in cols], F.count(F.lit(1)).alias("n_rows"))


def adjacency_sets(edges: DataFrame, src: str = "src", dst: str = "dst", undirected: bool = False) -> DataFrame:
    e = edges.select(F.col(src).alias("node"), F.col(dst).alias("nb"))
    if undirected:
        e = e.unionByName(e.select(F.col("nb").alias("node"), F.col("node").alias("nb")))
    e = e.filter(F.col("nb").isNotNull())
    return e.groupBy("node").agg(F.array_sort(F.collect_set("nb")).alias("neighbours"))


def group_collect(df: DataFrame, key: str, name: str, value: str, order: str) -> DataFrame:
    """Per key: the name of its first row along ``order`` and the sorted list of values."""
    return df.groupBy(key).agg(F.min_by(name, F.struct(order, name)).alias(name),
                               F.array_sort(F.collect_list(value)).alias(value + "s"))


def paged_lists(df: DataFrame, key: str, value: str, page_rows: int = 1024) -> DataFrame:
    """``key, page, values``: each key's distinct values in order, ``page_rows`` to a page (from 0).

    Values get consecutive numbers over ranges of (key, value), so a hub's values are dealt to
    many tasks; a page is all that ever meets.  NULL values are left out, a key with none has
    one empty page.
    """
    from railspark.operators.windows import number_rows
    # read twice below: written once, so that what they come from is not computed again
    rows = materialise_input(df.select(F.col(key).alias("_k"), F.col(value).alias("_v")).distinct())
    n = number_rows(rows.filter(F.col("_v").isNotNull()), ["_k", "_v"], "_g")
    n = materialise_input(n)
    first = n.groupBy(F.col("_k").alias("_of")).agg(F.min("_g").alias("_first"))
    pages = n.join(first, F.col("_k").eqNullSafe(F.col("_of"))).select("_k", "_v", F.floor((F.col("_g") - F.col("_first")) / page_rows).alias("page")) \
        .groupBy("_k", "page").agg(F.array_sort(F.collect_list("_v")).alias("values"))
    kind = rows.schema["_v"].dataType.simpleString()
    none = rows.groupBy("_k").agg(F.count("_v").alias("_n")).filter("_n = 0") \
        .select("_k", F.lit(0).cast("long").alias("page"), F.array().cast(f"array<{kind}>").alias("values"))
    return pages.unionByName(none).withColumnRenamed("_k", key)


def adjacency_pages(edges: DataFrame, src: str = "src", dst: str = "dst", undirected: bool = False, page_rows: int = 1024) -> DataFrame:
    """``adjacency_sets`` in pages: ``node, page, neighbours``."""
    e = edges.select(F.col(src).alias("node"), F.col(dst).alias("nb"))
    if undirected:
        e = e.unionByName(e.select(F.col("nb").alias("node"), F.col("node").alias("nb")))
    return paged_lists(e.filter(F.col("nb").isNotNull()), "node", "nb", page_rows).withColumnRenamed("values", "neighbours")


def group_pages(df: DataFrame, key: str, name: str, value: str, order: str, page_rows: int = 1024) -> DataFrame:
    """``group_collect`` in pages of distinct values: ``key, name, page, values``."""
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(name, F.struct(order, name)).alias(name))
    pages = paged_lists(df, key, value, page_rows)
    return pages.join(first, F.col(key).eqNullSafe(F.col("_key"))).select(key, name, "page", F.col("values").alias(value + "s"))


def membership_pages(station_tracks: DataFrame, edges: DataFrame, station: str = "Station_ID", track: str = "track", edge_id: str = "edge_id",
                     edge_track: str = "track", page_rows: int = 1024) -> DataFrame:
    """``array_membership_join`` on rows ``station_tracks(station, track)``, in pages: ``station, page, edges``;
    a station without a match has one empty page."""
    e = edges.select(F.col(edge_track).alias("_t"), F.col(edge_id).alias("_e"))
    j = station_tracks.select(station, F.col(track).alias("_t")).join(e, "_t", "left")
    return paged_lists(j, station, "_e", page_rows).withColumnRenamed("values", "edges")


def node_degree(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct neighbours per node of an undirected edge list."""
    e = edges.select(F.col(src).alias("node"), F.col(dst).alias("nb"))
    e = e.unionByName(e.select(F.col("nb").alias("node"), F.col("node").alias("nb"))) \
        .filter(F.col("nb").isNotNull() & (F.col("node") != F.col("nb")))
    return e.groupBy("node").agg(F.count_distinct("nb").alias("degree"))


def degree_histogram(degrees: DataFrame, max_bucket: int = 4, degree: str = "degree") -> DataFrame:
    """Nodes per degree bucket 0..max_bucket and '>max_bucket', with percentages (all buckets listed)."""
    b = F.when(F.col(degree) > max_bucket, F.lit(f">{max_bucket}")).otherwise(F.col(degree).cast("string"))
    counts = degrees.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("nodes"))
    spark = degrees.sparkSession
    labels = spark.createDataFrame([(str(i), i) for i in range(max_bucket + 1)] + [(f">{max_bucket}", max_bucket + 1)],
                                   "bucket string, bucket_order int")
    j = labels.join(counts, "bucket", "left").withColumn("nodes", F.coalesce("nodes", F.lit(0)).cast("long"))
    total = F.sum("nodes").over(Window.partitionBy(F.lit(1)))
    return j.withColumn("pct", F.round(F.lit(100.0) * F.col("nodes") / total, 4))


def trips_through_station(legs_df: DataFrame, trip_key, dep: str = "departure_station",
                          arr: str = "arrival_station") -> DataFrame:
    keys = [trip_key] if isinstance(trip_key, str) else list(trip_key)
    t = F.struct(*keys)
    ends = legs_df.select(t.alias("_t"), F.col(dep).alias("station")).unionByName(
        legs_df.select(t.alias("_t"), F.col(arr).alias("station"))).filter(F.col("station").isNotNull())
    return ends.groupBy("station").agg(F.count_distinct("_t").alias("trips"))


def centroid(paths: DataFrame, path: str = "Path") -> DataFrame:
    pts = paths.select(F.explode(path).alias("p"))
    return pts.agg(F.avg(F.get("p", 0)).alias("mean_lat"), F.avg(F.get("p", 1)).alias("mean_lon"))


def neighbour_count_check(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Outgoing-neighbour count of each seed, flagged '<=2', '>2' or 'unknown' (no outgoing link)."""
    s = seeds.select(F.col(seeds.columns[0]).alias("station")).distinct()
    deg = edges.filter(F.col(dst).isNotNull()).groupBy(F.col(src).alias("station")) \
        .agg(F.count_distinct(dst).alias("neighbours"))
    j = s.join(deg, "station", "left")
    return j.withColumn("status", F.when(F.col("neighbours").isNull(), "unknown")
                        .when(F.col("neighbours") <= 2, "<=2").otherwise(">2"))


# ---------------------------------------------------------------- sorts, sampling, sets (§2.6-2.7)


def sort_multi(df: DataFrame, *order) -> DataFrame:
    return df.orderBy(*order)


def top_n(df: DataFrame, n: int, *order) -> DataFrame:
    """``orderBy(...).limit(n)``: planned as TakeOrderedAndProject (per-task top-n, then merge)."""
    return df.orderBy(*order).limit(n)


def random_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k distinct keys chosen by a seeded hash (MD5 of seed and key, the same in any engine):
    deterministic, and planned as a top-k."""
    keys = df.select(key).distinct()
    return keys.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), F.col(key)).limit(k)


def union_distinct_endpoints(links: DataFrame, dep: str = "Departure_station_id",
                             arr: str = "Arrival_station_id", out: str = "station") -> DataFrame:
    return links.select(F.col(dep).alias(out)).unionByName(links.select(F.col(arr).alias(out))).distinct()


def append_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


def union_tagged(frames: dict, tag: str = "source") -> DataFrame:
    out = None
    for name, f in frames.items():
        f = f.withColumn(tag, F.lit(name))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_rows(df: DataFrame, *cols) -> DataFrame:
    return (df.select(*cols) if cols else df).distinct()


def intersect_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)
