"""Trip, timetable and delay operators (cards T1-T9).

Legs are rows; trips are ``array<struct<t, dep, arr>>`` per train-day, a group
whose size is bounded by the stops one train makes in a day.  Operators that
group over keys which can be hot at scale (relations, stations, links) stay in
long format and use partial aggregation instead of per-group arrays.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspark.functions.scalar import col_of, seconds_since
from railspark.operators.relational import neighbour_expand
from railspark.operators.loops import chain_from, materialise, materialise_input
from railspark.operators.windows import number_rows, rank_neighbours, running_sum, _cols
from railspark.session import ensure_checkpoint_dir

LEG = "struct<t:bigint,dep:bigint,arr:bigint>"


def legs(stops: DataFrame, start, stop: str = "STOPPING_PLACE_ID", next_col: str = "NEXT_STOPPING_PLACE_ID",
         time: str = "PLANNED_DATETIME_DEP", key=("TRAIN_NO", "REAL_DATE_DEP"), extra=()) -> DataFrame:
    """Stop rows -> leg rows ``(key..., departure_station, arrival_station, sumo_time, extra...)``.

    ``sumo_time`` = whole seconds from ``start`` to the planned departure, truncated toward zero.
    """
    start = F.lit(start) if not isinstance(start, Column) else start
    return stops.select(*key, F.col(stop).alias("departure_station"), F.col(next_col).alias("arrival_station"),
                        seconds_since(start, F.col(time)).alias("sumo_time"), *extra)


def build_trips(legs_df: DataFrame, key=("TRAIN_NO", "REAL_DATE_DEP"), tie=(), min_legs: int = 2) -> DataFrame:
    """Group legs per train-day, keep trips with ``>= min_legs`` legs (card T1, FIX: plain group).

    Legs are sorted by ``(sumo_time, tie...)``; trips get ``trip_id`` 0.. in order of their
    first leg time.  Output: ``key..., trip_id, legs array<struct<t, dep, arr>>``.
    """
    item = F.struct(F.col("sumo_time").cast("long").alias("t"), *[F.col(c) for c in tie],
                    F.col("departure_station").cast("long").alias("dep"),
                    F.col("arrival_station").cast("long").alias("arr"))
    g = (legs_df.groupBy(*key)
         .agg(F.array_sort(F.collect_list(item)).alias("_items"), F.count(F.lit(1)).alias("_n"))
         .filter(F.col("_n") >= min_legs))
    g = g.withColumn("legs", F.transform("_items", lambda x: F.struct(x["t"].alias("t"), x["dep"].alias("dep"),
                                                                        x["arr"].alias("arr"))))
    g = g.withColumn("_t0", F.col("legs")[0]["t"]).drop("_items", "_n")
    return number_rows(g, ["_t0", *key], "trip_id").drop("_t0")


def _keep_connected(acc, x):
    last = acc["last"]
    keep = (last["dep"] != x["dep"]) & (last["arr"] != x["arr"]) & (last["arr"] == x["dep"])
    return F.when(F.coalesce(keep, F.lit(False)),
                  F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), x.alias("last"))).otherwise(acc)


def _merge_mean(acc, x):
    last = acc["last"]
    same = (last["dep"] == x["dep"]) | (last["arr"] == x["arr"])
    merged = F.struct(((last["t"] + x["t"]) / 2).alias("t"), last["dep"].alias("dep"), last["arr"].alias("arr"))
    kept_wo_last = F.slice(acc["kept"], 1, F.size(acc["kept"]) - 1)
    return F.when(F.coalesce(same, F.lit(False)),
                  F.struct(F.concat(kept_wo_last, F.array(merged)).alias("kept"), merged.alias("last"))) \
        .otherwise(F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), x.alias("last")))


def clean_legs(trips: DataFrame, allowed: DataFrame | None = None, station: str = "ID",
               merge: str = "drop", legs_col: str = "legs") -> DataFrame:
    """Card T3.  Step 1: drop legs with a NULL end or an end outside ``allowed``.
    Step 2: left fold; the first leg is kept; leg x after the last kept leg y is kept iff
    ``y.dep != x.dep and y.arr != x.arr and y.arr == x.dep`` (``merge="drop"``), or with
    ``merge="mean"`` x is merged into y (mean time) when dep or arr are equal.
    Trips left empty are dropped.
    """
    src = trips
    if allowed is not None:
        ids = allowed.select(F.col(station).cast("long").alias("_sid")).distinct()
        ex = src.select("*", F.posexplode(legs_col).alias("_pos", "_leg")).drop(legs_col)
        rest = [c for c in trips.columns if c != legs_col]
        ex = (ex.join(ids.withColumnRenamed("_sid", "_d"), F.col("_leg.dep") == F.col("_d"), "left_semi")
              .join(ids.withColumnRenamed("_sid", "_a"), F.col("_leg.arr") == F.col("_a"), "left_semi"))
        src = ex.groupBy(*rest).agg(F.array_sort(F.collect_list(F.struct("_pos", "_leg"))).alias("_l")) \
            .withColumn(legs_col, F.transform("_l", lambda x: x["_leg"])).drop("_l")
    else:
        src = src.withColumn(legs_col, F.filter(legs_col, lambda x: x["dep"].isNotNull() & x["arr"].isNotNull()))
    a = F.col(legs_col)
    if merge == "mean":
        a = F.transform(a, lambda x: F.struct(x["t"].cast("double").alias("t"), x["dep"].alias("dep"),
                                              x["arr"].alias("arr")))
        step = _merge_mean
    elif merge == "drop":
        step = _keep_connected
    else:
        raise ValueError(merge)
    init = F.struct(F.array(a[0]).alias("kept"), a[0].alias("last"))
    folded = F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(1))), init, step, lambda acc: acc["kept"])
    return src.filter(F.size(legs_col) > 0).withColumn(
        legs_col, F.when(F.size(a) == 1, F.array(a[0])).otherwise(folded))


def od_per_trip(trips: DataFrame, legs_col: str = "legs", order_col: str = "trip_id") -> DataFrame:
    """``trip id="trip_{n}" depart from to``: first / last leg edge, n by start order."""
    a = F.col(legs_col)
    first, last = a[0], F.element_at(a, -1)
    base = trips.select(order_col, first["t"].alias("depart"),
                        F.concat_ws("_", first["dep"], first["arr"]).alias("from_edge"),
                        F.concat_ws("_", last["dep"], last["arr"]).alias("to_edge"))
    n = number_rows(base, ["depart", order_col], "_n")
    return n.select(F.concat(F.lit("trip_"), F.col("_n").cast("string")).alias("id"), "depart", "from_edge",
                    "to_edge", order_col)


def route_edges(trips: DataFrame, legs_col: str = "legs", dwell: int = 30) -> DataFrame:
    """Edge-id string (``"a_b b_c"``) and the stop list (legs from the 2nd on) per trip."""
    a = F.col(legs_col)
    return trips.select(
        "trip_id", a[0]["t"].cast("double").alias("depart"),
        F.array_join(F.transform(a, lambda x: F.concat_ws("_", x["dep"], x["arr"])), " ").alias("edges"),
        F.transform(F.filter(a, lambda x, i: i > 0),
                    lambda x: F.struct(F.concat_ws("->", x["dep"], x["arr"]).alias("trainStop"),
                                       x["t"].cast("double").alias("until"),
                                       F.lit(dwell).alias("duration"))).alias("stops"))


def select_subnetwork(stations: DataFrame, links: DataFrame, stops: DataFrame, seeds: DataFrame,
                      start, end, station_id: str = "ID", dep: str = "Departure_station_id",
                      arr: str = "Arrival_station_id", stop: str = "STOPPING_PLACE_ID",
                      next_col: str = "NEXT_STOPPING_PLACE_ID", time: str = "PLANNED_DATETIME_DEP"):
    """Seeds + one-hop (outgoing) neighbours; returns ``(stations, links, stops, allowed)``.

    stations: id in seeds or neighbours; links: either end in seeds; stops: planned departure in
    ``[start, end]`` and stop or next stop in seeds.  ``seeds`` has one column ``station``.
    """
    seeds = seeds.select(F.col(seeds.columns[0]).alias("station")).distinct()
    nb = neighbour_expand(links.select(F.col(dep).alias("src"), F.col(arr).alias("dst")), seeds)
    allowed = seeds.unionByName(nb).distinct()
    st = stations.join(allowed.withColumnRenamed("station", station_id), station_id, "left_semi")
    sd = seeds.withColumn("_in", F.lit(True))
    lk = (links.join(sd.withColumnRenamed("station", "_d").withColumnRenamed("_in", "_din"),
                     F.col(dep) == F.col("_d"), "left")
          .join(sd.withColumnRenamed("station", "_a").withColumnRenamed("_in", "_ain"), F.col(arr) == F.col("_a"), "left")
          .filter(F.col("_din").isNotNull() | F.col("_ain").isNotNull()).drop("_d", "_a", "_din", "_ain"))
    sp = stops.filter(F.col(time).between(F.lit(start).cast(stops.schema[time].dataType),
                                          F.lit(end).cast(stops.schema[time].dataType)))
    sp = (sp.join(sd.withColumnRenamed("station", "_s").withColumnRenamed("_in", "_sin"), F.col(stop) == F.col("_s"), "left")
          .join(sd.withColumnRenamed("station", "_n").withColumnRenamed("_in", "_nin"), F.col(next_col) == F.col("_n"), "left")
          .filter(F.col("_sin").isNotNull() | F.col("_nin").isNotNull()).drop("_s", "_n", "_sin", "_nin"))
    return st, lk, sp, allowed


def alias_resolve(legs_df: DataFrame, aliases: DataFrame, edges: DataFrame,
                  dep: str = "departure_station", arr: str = "arrival_station") -> DataFrame:
    """Card T2 (FIX: intended pair search).  Replace logical stop ids by the first alias
    (by rank) that is adjacent to the other end; unchanged when nothing matches.

    ``aliases(alias, rank, station)``, ``edges(src, dst)``.  Resolution depends only on the
    ``(dep, arr)`` pair and starts from the edges: each end of an edge is turned back into the ids
    that stand for it, and of the edges from one id to one station only the best departure goes
    on.  Two alias lists are never multiplied with each other, whatever their lengths.
    """
    legs_df = materialise_input(legs_df)
    al = aliases.select(F.col("alias").alias("_al"), F.coalesce("rank", F.lit(0)).alias("_r"), F.coalesce("station", "alias").alias("_s"))

    def stands_for(end: str, n: str) -> DataFrame:
        """(id, rank, station): what the ids at one end of the legs can be resolved to."""
        ids = legs_df.select(F.col(end).alias(f"_id{n}")).filter(F.col(end).isNotNull()).distinct()
        return ids.join(al, F.col(f"_id{n}") == F.col("_al"), "left").select(
            f"_id{n}", F.coalesce("_r", F.lit(0)).alias(f"_r{n}"), F.coalesce("_s", f"_id{n}").alias(f"_s{n}"))

    e = edges.select(F.col("src").alias("_s1"), F.col("dst").alias("_s2")).distinct()
    near = e.join(stands_for(dep, "1"), "_s1").groupBy("_id1", "_s2").agg(F.min(F.struct("_r1", "_s1")).alias("_n"))
    best = near.join(stands_for(arr, "2"), "_s2").groupBy("_id1", "_id2") \
        .agg(F.min(F.struct(F.col("_n._r1").alias("_r1"), "_r2", F.col("_n._s1").alias("_s1"), "_s2")).alias("_b"))
    res = legs_df.join(best, (F.col(dep) == F.col("_id1")) & (F.col(arr) == F.col("_id2")), "left")
    return res.withColumn(dep, F.coalesce(F.col("_b._s1"), F.col(dep))) \
        .withColumn(arr, F.coalesce(F.col("_b._s2"), F.col(arr))).drop("_id1", "_id2", "_b")


def relation_stop_sequence(stops: DataFrame, relation: str = "RELATION", stop: str = "STOPPING_PLACE_ID",
                           order=("TRAIN_NO", "REAL_DATE_DEP", "PLANNED_DATETIME_DEP")) -> DataFrame:
    """Card T5: per relation, stops in order up to (excluding) the first repeated stop.

    Long format ``(relation, pos, stop)``, pos from 1.  No per-relation array: the cut is the
    earliest row whose stop was already seen, found by a join with each stop's first row and
    a partial ``min`` per relation, so a hot relation never lands in one task.
    """
    o = F.struct(*_cols(order))
    s = stops.filter(F.col(relation).isNotNull() & F.col(stop).isNotNull()) \
        .select(F.col(relation).alias("relation"), F.col(stop).alias("stop"), o.alias("_o"))
    first = s.groupBy("relation", "stop").agg(F.min("_o").alias("_f"))
    cut = (s.join(first, ["relation", "stop"]).filter(F.col("_o") > F.col("_f"))
           .groupBy("relation").agg(F.min("_o").alias("_cut")))
    seq = first.join(cut, "relation", "left").filter(F.col("_cut").isNull() | (F.col("_f") < F.col("_cut")))
    w = Window.partitionBy("relation").orderBy("_f")
    return seq.select("relation", F.row_number().over(w).alias("pos"), "stop")


def restrict_stop_sequence(seq: DataFrame, keep: DataFrame, station: str = "Station_ID", min_len: int = 2) -> DataFrame:
    """Keep stops present in ``keep`` (e.g. stations with platforms), renumber, keep sequences >= ``min_len``."""
    k = keep.select(F.col(station).alias("stop")).distinct()
    r = seq.join(k, "stop", "left_semi")
    w = Window.partitionBy("relation").orderBy("pos")
    r = r.withColumn("pos", F.row_number().over(w)).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy("relation")))
    return r.filter(F.col("_n") >= min_len).select("relation", "pos", "stop")


def station_pair_requests(links: DataFrame, seq: DataFrame | None = None, dep: str = "Departure_station_id",
                          arr: str = "Arrival_station_id") -> DataFrame:
    """Adjacent station pairs from links and from stop sequences, in both directions, distinct."""
    p = links.select(F.col(dep).alias("a"), F.col(arr).alias("b"))
    if seq is not None:
        s2 = seq.select("relation", F.col("pos") - 1, "stop").toDF("relation", "pos", "b")
        p = p.unionByName(seq.join(s2, ["relation", "pos"]).select(F.col("stop").alias("a"), "b"))
    p = p.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    return p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def periodic_trips(pairs: DataFrame, end: int, headway: int = 1000, tail: int = 5000,
                   src: str = "src", dst: str = "dst", offset: str = "offset", pair_order=None,
                   first_id: int = 1) -> DataFrame:
    """Card T6: departures offset, offset+headway, ... <= end-tail for every OD pair.

    ids ``first_id..`` in generation order (pair order, time); sorted output is by ``depart``.
    """
    stop = F.lit(end - tail)
    po = _cols(pair_order) if pair_order else [F.col(src), F.col(dst), F.col(offset)]
    g = pairs.filter(F.col(offset) <= stop).select(
        *po, F.col(src).alias("from_station"), F.col(dst).alias("to_station"),
        F.explode(F.sequence(F.col(offset).cast("long"), stop.cast("long"), F.lit(headway).cast("long"))).alias("depart"))
    g = g.select(F.struct(*po).alias("_po"), "from_station", "to_station", "depart")
    return number_rows(g, ["_po", "depart"], "trip_id").drop("_po").withColumn("trip_id", F.col("trip_id") + F.lit(first_id))


def schedule_propagate(routes: DataFrame, edges: DataFrame, vmax: float, dwell: int = 60,
                       vehicle: str = "vehicle", depart: str = "depart", route: str = "edges") -> DataFrame:
    """Card T7: departure time at each stop of a route.

    dep_0 = depart + dwell; dep_i = dep_{i-1} + floor(len_i / min(speed_i, vmax)) + dwell; edge 0's
    travel is not counted; an edge id missing from ``edges(id, length, speed)`` adds 0.
    """
    ex = routes.select(vehicle, F.col(depart).cast("double").alias("_dep"),
                       F.posexplode(F.split(F.trim(F.col(route)), r"\s+")).alias("pos", "edge"))
    e = edges.select(F.col("id").alias("edge"), F.col("length").cast("double").alias("_len"),
                     F.col("speed").cast("double").alias("_spd"))
    j = ex.join(e, "edge", "left")
    travel = F.when((F.col("pos") > 0) & F.col("_len").isNotNull(),
                    F.floor(F.col("_len") / F.least(F.col("_spd"), F.lit(float(vmax))))).otherwise(F.lit(0))
    w = Window.partitionBy(vehicle).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return j.select(vehicle, "pos", "edge",
                    (F.col("_dep") + F.lit(dwell) * (F.col("pos") + 1) + F.sum(travel).over(w)).alias("departure"))


def chain_delay_series(df: DataFrame, stations: DataFrame, chain: DataFrame, station: str = "station",
                       next_col: str = "next_station", time: str = "scheduled_arrival_time",
                       value: str = "delay_arrival", station_id: str = "ID", name: str = "Name") -> DataFrame:
    """Card T9: delays along consecutive links of a station chain ``chain(pos, station)``.

    Rows whose (station, next) is a chain link, labelled ``"name(a) - name(b)"``.
    """
    c = chain.select(F.col("pos"), F.col("station").alias("_a"))
    c2 = c.select((F.col("pos") - 1).alias("pos"), F.col("_a").alias("_b"))
    links = c.join(c2, "pos")
    nm = stations.select(F.col(station_id).alias("_id"), F.col(name).alias("_nm"))
    lab = (links.join(nm.withColumnRenamed("_id", "_a").withColumnRenamed("_nm", "_na"), "_a", "left")
           .join(nm.withColumnRenamed("_id", "_b").withColumnRenamed("_nm", "_nb"), "_b", "left")
           .select("pos", "_a", "_b", F.concat_ws(" - ", "_na", "_nb").alias("link")))
    j = df.join(lab, (F.col(station) == F.col("_a")) & (F.col(next_col) == F.col("_b")))
    return j.select(F.col("pos").alias("link_pos"), "link", F.col(time), F.col(value)).drop("_a", "_b")


# ------------------------------------------------------------------ long-format trips (no per-trip arrays)


def trip_legs(legs_df: DataFrame, key=("TRAIN_NO", "REAL_DATE_DEP"), tie=(), min_legs: int = 2) -> DataFrame:
    """Long-format ``build_trips``: one row per leg with ``trip_id`` and a total order ``ord``.

    Leg counts and first leg times per trip come from partial aggregations, so a train-day
    holding a large share of all legs never has to fit one task.  Output:
    ``key..., trip_id, ord struct<t, tie..., dep, arr>, t, dep, arr``.
    """
    ord_ = F.struct(F.col("sumo_time").cast("long").alias("t"), *[F.col(c) for c in tie],
                    F.col("departure_station").cast("long").alias("dep"),
                    F.col("arrival_station").cast("long").alias("arr"))
    lg = legs_df.select(*key, ord_.alias("ord"))
    per = lg.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("ord.t").alias("_t0")) \
        .filter(F.col("_n") >= min_legs)
    ids = number_rows(per, ["_t0", *key], "trip_id").select(*key, "trip_id")
    j = lg.join(ids, list(key))
    return j.select(*key, "trip_id", "ord", F.col("ord.t").alias("t"), F.col("ord.dep").alias("dep"),
                    F.col("ord.arr").alias("arr"))


def clean_legs_long(legs: DataFrame, allowed: DataFrame | None = None, station: str = "ID",
                    trip: str = "trip_id") -> DataFrame:
    """Card T3 fold, distributed and exact for trips of any length (long format in and out).

    After step 1 (NULL ends / ends outside ``allowed`` dropped), the kept legs are the first leg
    and its chain of successors, where succ(y) is the first later leg x with ``x.dep = y.arr`` and
    ``x.dep != x.arr`` (defined only when ``y.dep != y.arr``) - the same legs the left fold keeps.
    succ comes from an as-of lookup per (trip, station); the chain from the first leg is marked
    with pointer doubling: jump tables J_k = succ^(2^k), then marked |= J_k(marked) for k = K..0.
    """
    lg = legs.filter(F.col("dep").isNotNull() & F.col("arr").isNotNull())
    if allowed is not None:
        ids = allowed.select(F.col(station).cast("long").alias("_sid")).distinct()
        lg = (lg.join(ids.withColumnRenamed("_sid", "dep"), "dep", "left_semi")
              .join(ids.withColumnRenamed("_sid", "arr"), "arr", "left_semi"))
    # equal legs share one ``ord``; the fold keeps the first of them and never the next
    lg = _ckpt(lg.dropDuplicates([trip, "ord"]))
    # as-of successor: queries at y.arr, candidates at x.dep (non-self-loop x), per (trip, station)
    qy = lg.filter(F.col("dep") != F.col("arr")).select(trip, F.col("arr").alias("_st"), "ord",
                                                      F.lit(0).alias("_kind"))
    cx = lg.filter(F.col("dep") != F.col("arr")).select(trip, F.col("dep").alias("_st"), "ord",
                                                      F.lit(1).alias("_kind"))
    w = Window.partitionBy(trip, "_st").orderBy("ord", "_kind").rowsBetween(1, Window.unboundedFollowing)
    u = qy.unionByName(cx).withColumn("_next", F.first(F.when(F.col("_kind") == 1, F.col("ord")), ignorenulls=True)
                                      .over(w))
    jump = _ckpt(u.filter((F.col("_kind") == 0) & F.col("_next").isNotNull()).select(trip, "ord", F.col("_next").alias("nxt")))
    n_max = lg.groupBy(trip).count().agg(F.max("count")).first()[0] or 1
    levels = [jump]
    for _ in range(max(1, math.ceil(math.log2(max(n_max, 2))))):
        j = levels[-1]
        j2 = j.join(j.select(trip, F.col("ord").alias("nxt"), F.col("nxt").alias("_n2")), [trip, "nxt"]) \
            .select(trip, "ord", F.col("_n2").alias("nxt"))
        levels.append(_ckpt(j2))
    heads = lg.groupBy(trip).agg(F.min("ord").alias("ord"))
    marked = heads
    for j in reversed(levels):
        marked = _ckpt(marked.unionByName(marked.join(j, [trip, "ord"]).select(trip, F.col("nxt").alias("ord")))
                       .distinct())
    return lg.join(marked, [trip, "ord"], "left_semi")


def _ckpt(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def merge_legs_long(legs: DataFrame, trip: str = "trip_id", bucket_rows: int = 1 << 16) -> DataFrame:
    """Averaging fold (``clean_legs(merge="mean")``) in rows, for trips of any length.

    A kept leg takes in the following legs that share an end with it, each time halving the sum of
    both times; the next kept leg is the first that differs in both ends.  Legs get consecutive
    numbers by (trip, ord); a leg looks for its successor by skipping the run of equal departures
    or of equal arrivals that it stands before, all legs at once, until no search is open.  The
    kept legs are the chain of successors from each trip's first leg (doubling).  A running count
    of kept legs names the group of every leg, and the halvings compose to powers of two, so a
    group's time is one sum.  Output: ``trip, ord, t (double), dep, arr`` of the kept legs.
    """
    lg = legs.filter(F.col("dep").isNotNull() & F.col("arr").isNotNull()) \
        .select(F.col(trip).alias("_trip"), "ord", F.col("t").cast("double").alias("t"), "dep", "arr")
    lg = materialise_input(number_rows(lg, ["_trip", "ord"], "_g"))
    bucket, every = F.floor(F.col("_g") / bucket_rows), F.lit(0)
    before = lg.select((F.col("_g") + 1).alias("_g"), F.col("_trip").alias("_pt"), F.col("dep").alias("_pd"), F.col("arr").alias("_pa"))
    rows = lg.join(before, "_g", "left")
    other = F.col("_pt").isNull() | (F.col("_pt") != F.col("_trip"))
    for end, prev in (("dep", "_pd"), ("arr", "_pa")):
        rows = rows.withColumn(f"_new_{end}", (other | (F.col(end) != F.col(prev))).cast("long"))
        rows = running_sum(rows, [every], ["_g"], f"_new_{end}", f"_run_{end}", bucket)
    rows = materialise_input(rows.drop("_pt", "_pd", "_pa"))
    for end in ("dep", "arr"):  # where the next run of another departure (arrival) starts
        nxt = rows.filter(f"_new_{end} = 1").select((F.col(f"_run_{end}") - 1).alias(f"_run_{end}"), F.col("_g").alias(f"_next_{end}"))
        rows = rows.join(nxt, f"_run_{end}", "left")
    rows = materialise_input(rows.select("_g", "_trip", "ord", "t", "dep", "arr", "_next_dep", "_next_arr"))
    at = rows.select(F.col("_g").alias("_p"), F.col("_trip").alias("_at"), F.col("dep").alias("_d"), F.col("arr").alias("_a"), "_next_dep", "_next_arr")
    search = rows.select("_g", "_trip", "dep", "arr", (F.col("_g") + 1).alias("_p"))
    found = []
    while True:
        step = materialise(search.join(at, "_p").filter(F.col("_at") == F.col("_trip")))
        found.append(step.filter((F.col("_d") != F.col("dep")) & (F.col("_a") != F.col("arr"))).select("_g", F.col("_p").alias("_to")))
        search = step.filter((F.col("_d") == F.col("dep")) | (F.col("_a") == F.col("arr"))).select(
            "_g", "_trip", "dep", "arr", F.when(F.col("_d") == F.col("dep"), F.col("_next_dep")).otherwise(F.col("_next_arr")).alias("_p"))
        if search.isEmpty():
            break
    kept = chain_from(rows.groupBy("_trip").agg(F.min("_g").alias("_g")), reduce(DataFrame.unionByName, found))
    marked = rows.join(kept.withColumn("_kept", F.lit(1).cast("long")), "_g", "left").withColumn("_kept", F.coalesce("_kept", F.lit(0).cast("long")))
    grouped = materialise_input(running_sum(marked, [every], ["_g"], "_kept", "_group", bucket))
    size = grouped.groupBy("_group").agg(F.min("_g").alias("_head"), (F.count(F.lit(1)) - 1).alias("_k"))
    step = F.col("_g") - F.col("_head")
    half = F.col("_k") - step + F.when(step > 0, F.lit(1)).otherwise(F.lit(0))
    head = F.struct(F.col("_trip").alias(trip), "ord", "dep", "arr")
    return grouped.join(size, "_group").groupBy("_group").agg(
        F.sum(F.col("t") * F.pow(F.lit(2.0), -half)).alias("t"), F.max(F.when(step == 0, head)).alias("_head")) \
        .select("_head.*", "t").select(trip, "ord", "t", "dep", "arr")


def od_rows(legs: DataFrame, trip: str = "trip_id") -> DataFrame:
    """``od_per_trip`` from leg rows (``clean_legs_long``): only a minimum and a maximum per trip meet."""
    leg = F.struct("ord", F.col("t").alias("t"), F.col("dep").alias("dep"), F.col("arr").alias("arr"))
    ends = legs.groupBy(trip).agg(F.min(leg).alias("_a"), F.max(leg).alias("_b"))
    base = ends.select(trip, F.col("_a.t").alias("depart"), F.concat_ws("_", "_a.dep", "_a.arr").alias("from_edge"),
                       F.concat_ws("_", "_b.dep", "_b.arr").alias("to_edge"))
    n = number_rows(base, ["depart", trip], "_n")
    return n.select(F.concat(F.lit("trip_"), F.col("_n").cast("string")).alias("id"), "depart", "from_edge", "to_edge", trip)


def route_rows(legs: DataFrame, dwell: int = 30, trip: str = "trip_id") -> DataFrame:
    """``trip, ord, depart, edge, stop`` per leg: the edge travelled and, from a trip's second leg on, its stop."""
    first = legs.groupBy(trip).agg(F.min(F.struct("ord", "t")).alias("_f")) \
        .select(trip, F.col("_f.ord").alias("_first"), F.col("_f.t").cast("double").alias("depart"))
    stop = F.struct(F.concat_ws("->", "dep", "arr").alias("trainStop"), F.col("t").cast("double").alias("until"), F.lit(dwell).alias("duration"))
    return legs.join(first, trip).select(trip, "ord", "depart", F.concat_ws("_", "dep", "arr").alias("edge"),
                                         F.when(F.col("ord") != F.col("_first"), stop).alias("stop"))


def gather_routes(rows: DataFrame, trip: str = "trip_id") -> DataFrame:
    """``route_rows`` put together for the route file, whose format has one element per trip."""
    leg = F.struct("ord", "edge", "stop")
    g = rows.groupBy(trip).agg(F.min("depart").alias("depart"), F.array_sort(F.collect_list(leg)).alias("_l"))
    return g.select(trip, "depart", F.array_join(F.transform("_l", lambda x: x["edge"]), " ").alias("edges"),
                    F.filter(F.transform("_l", lambda x: x["stop"]), lambda x: x.isNotNull()).alias("stops"))


def schedule_rows(legs: DataFrame, edges: DataFrame, vmax: float, dwell: int = 60, trip: str = "trip_id", bucket_rows: int = 1 << 16) -> DataFrame:
    """``schedule_propagate`` on leg rows ``trip, ord, t, dep, arr`` with the platform of every stop.

    Output: ``trip, pos (from 0), edge, platform, departure``.  dep_0 = t_0 + dwell; dep_i = dep_{i-1}
    + floor(len_i / min(speed_i, vmax)) + dwell; the first edge's travel is not counted, an edge
    missing from ``edges(src, dst, length, speed)`` adds 0.  A stop's platform is
    ``src_platform_rank``, the rank of the next station among the station's neighbours sorted as
    text.  The running sums are bucketed, so a long trip is spread over tasks.
    """
    e = rank_neighbours(edges, "src", "dst", "_rank", as_text=True).select(
        F.col("src").alias("dep"), F.col("dst").alias("arr"), "_rank", F.floor(F.col("length") / F.least(F.col("speed"), F.lit(float(vmax)))).alias("_travel"))
    lg = materialise_input(number_rows(legs.select(F.col(trip).alias("_trip"), "ord", "t", "dep", "arr"), ["_trip", "ord"], "_g"))
    first = lg.groupBy("_trip").agg(F.min(F.struct("_g", "t")).alias("_f")).select("_trip", F.col("_f._g").alias("_first"), F.col("_f.t").alias("_t0"))
    rows = lg.join(first, "_trip").join(e, ["dep", "arr"], "left").withColumn("pos", F.col("_g") - F.col("_first"))
    travel = F.when(F.col("pos") > 0, F.coalesce("_travel", F.lit(0))).otherwise(F.lit(0)).cast("double")
    rows = running_sum(rows, ["_trip"], ["_g"], travel, "_sum", F.floor(F.col("_g") / bucket_rows))
    return rows.select(F.col("_trip").alias(trip), "pos", F.concat_ws("_", "dep", "arr").alias("edge"),
                       F.concat(F.col("dep").cast("string"), F.lit("_platform_"), F.col("_rank").cast("string")).alias("platform"),
                       (F.col("_t0") + F.lit(dwell) * (F.col("pos") + 1) + F.col("_sum")).alias("departure"))
