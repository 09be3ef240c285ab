"""Graph operators as iterated DataFrame joins.

Nodes of point graphs are integer point keys (coordinates scaled to longs), never raw doubles.
Iterative operators (list contraction, level-synchronous BFS) run join rounds until a round
changes nothing, and cut lineage with ``checkpoint()`` into the session's checkpoint directory
(a shared folder on a cluster).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railspark.functions.geo import point_key, turning_angle
from railspark.operators.loops import materialise as _materialise, materialise_input
from railspark.operators.paths import line_graph, path_of, path_rows, platform_paths, shortest_path_pairs, shortest_paths  # noqa: F401
from railspark.operators.polyline import point_normalise
from railspark.operators.windows import number_rows

# ------------------------------------------------------------------ building graphs


def polyline_graph(df: DataFrame, path: str = "Coordinates") -> tuple[DataFrame, DataFrame]:
    """Undirected unit edges between consecutive normalised points (self-loops dropped).

    Returns ``(edges(u, v) in both directions, nodes(node, lat, lon))``.
    """
    # the points are named a fixed number of times: inside a lambda over places they would all be made anew at every place
    pts = F.transform(F.col(path), lambda p: point_normalise(p))
    n = F.greatest(F.size(path) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(pts, F.lit(1), n), F.slice(pts, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    ex = df.filter(F.size(path) >= 2).select(F.inline(pairs)).filter(F.col("a") != F.col("b"))
    ex = ex.select(point_key("a").alias("u"), point_key("b").alias("v"), "a", "b")
    edges = ex.select("u", "v").unionByName(ex.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    nodes = ex.select(F.col("u").alias("node"), F.col("a").alias("p")).unionByName(
        ex.select(F.col("v").alias("node"), F.col("b").alias("p"))) \
        .groupBy("node").agg(F.min("p").alias("p")) \
        .select("node", F.col("p")[0].alias("lat"), F.col("p")[1].alias("lon"))
    return edges, nodes


def endpoint_graph(df: DataFrame, path: str = "Path", drop_loops: bool = False) -> DataFrame:
    """Undirected edges between the first and last normalised point of every polyline.

    A closed polyline links its end node to itself (counted in its degree), as in the reference."""
    e = df.filter(F.size(path) >= 2).select(point_key(point_normalise(F.col(path)[0])).alias("u"),
                                            point_key(point_normalise(F.element_at(path, -1))).alias("v"))
    if drop_loops:
        e = e.filter(F.col("u") != F.col("v"))
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def node_degree(edges: DataFrame) -> DataFrame:
    """Distinct neighbours per node of a symmetric edge list ``(u, v)``."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.count_distinct("v").alias("degree"))


# ------------------------------------------------------------------ list contraction


def _with_angles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degree and (for degree-2 nodes) the turn angle through the node: ``(node, degree, n1, n2, angle)``."""
    nb = _neighbours(edges)
    xy = nodes.select("node", F.array("lat", "lon").alias("p"))
    j = (nb.join(xy, "node", "left")
         .join(xy.select(F.col("node").alias("n1"), F.col("p").alias("p1")), "n1", "left")
         .join(xy.select(F.col("node").alias("n2"), F.col("p").alias("p2")), "n2", "left"))
    return j.select("node", "degree", "n1", "n2",
                    F.when(F.col("degree") == 2, turning_angle("p1", "p", "p2")).alias("angle"))


def _neighbours(edges: DataFrame) -> DataFrame:
    """``(node, degree, n1, n2)`` of a symmetric edge list: distinct neighbours, the smallest and the largest."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.count_distinct("v").alias("degree"),
                                                       F.min("v").alias("n1"), F.max("v").alias("n2"))


def contract_lists(edges: DataFrame, info: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Randomised list contraction of every run of uncut nodes.

    ``info(node, n1, n2, cut)``: an uncut node has exactly the neighbours n1 and n2 (edges from a
    node to itself are left out).  A *port* (node, neighbour) is one side of a node; a chain runs
    from a port of a cut node to another.  Each round takes out the uncut nodes whose random
    number of that round is smaller than those of their uncut neighbours (about a third of a long
    run) and links their neighbours directly, so tables shrink geometrically.  On the way back
    each node finds its place from one of the two ports that it was taken out between.

    Returns ``chains(start, first, end, last, n_edges)`` oriented so that (start, first) <= (end,
    last), ``rings(ring, n_edges)`` of runs without a cut node, named by the node that was left,
    and ``places(start, first, pos, node)`` of all nodes but the chains' ends (a ring's: start =
    ring, first NULL).
    """
    i = info.select("node", "n1", "n2", "cut")
    ends = edges.filter(F.col("u") != F.col("v")).select("u", "v").distinct() \
        .join(i.select(F.col("node").alias("v"), F.col("cut").alias("_cut")), "v") \
        .join(i.select(F.col("node").alias("u"), F.col("cut").alias("_own"), "n1"), "u")
    ends = materialise_input(ends)
    key = ends.schema["u"].dataType
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def link(port, to, back, w, cut):
        """A way out of a port: to the node ``to`` and its port ``back``, ``w`` edges away."""
        return F.struct(port.alias("port"), to.alias("to"), back.alias("back"), w.alias("w"), cut.alias("cut"))

    u, v = F.col("u"), F.col("v")
    first = link(v, v, u, one, F.col("_cut"))
    live = _materialise(ends.filter(~F.col("_own")).groupBy(u.alias("x")).agg(
        F.max(F.when(v == F.col("n1"), first)).alias("a"), F.max(F.when(v != F.col("n1"), first)).alias("b")))
    finished = [ends.filter(F.col("_own") & F.col("_cut") & (u < v)).select(u.alias("s"), v.alias("f"), v.alias("e"), u.alias("l"), one.alias("n"))]
    none = F.lit(None).cast(live.schema["a"].dataType)
    rings, rounds = [], []
    alone, w = F.col("a.to") == F.col("x"), F.col("a.w") + F.col("b.w")  # alone: a ring of one node, its two ports linked
    while not live.isEmpty():
        number = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))), c)
        free = lambda side: F.col(f"{side}.cut") | (number(F.col("x")) < number(F.col(f"{side}.to")))
        go = ~alone & free("a") & free("b")
        out = live.filter(go)
        rings.append(live.filter(alone).select(F.col("x").alias("ring"), F.col("a.port").alias("p1"), F.col("b.port").alias("p2"), F.col("a.w").alias("n")))
        finished.append(out.filter(F.col("a.cut") & F.col("b.cut")).select(
            F.col("a.to").alias("s"), F.col("a.back").alias("f"), F.col("b.to").alias("e"), F.col("b.back").alias("l"), w.alias("n")))
        # both neighbours get a link past the node; those that are cut have no row to change
        new = [F.struct(F.col(f"{p}.to").alias("x"), link(F.col(f"{p}.back"), F.col(f"{o}.to"), F.col(f"{o}.back"), w, F.col(f"{o}.cut")).alias("_new"),
                        F.col(f"{p}.cut").alias("_end")) for p, o in ("ab", "ba")]
        new = out.select(F.inline(F.array(*new))).filter(~F.col("_end")).select("x", none.alias("a"), none.alias("b"), "_new")
        both = live.filter(~go & ~alone).select("x", "a", "b", none.alias("_new")).unionByName(new).groupBy("x") \
            .agg(F.max("a").alias("a"), F.max("b").alias("b"), F.min("_new").alias("_lo"), F.max("_new").alias("_hi"))
        pick = lambda side: F.when(F.col("_lo.port") == F.col(f"{side}.port"), F.col("_lo")) \
            .when(F.col("_hi.port") == F.col(f"{side}.port"), F.col("_hi")).otherwise(F.col(side)).alias(side)
        rounds.append(out)
        live = _materialise(both.select("x", pick("a"), pick("b")))

    chains = _materialise(reduce(DataFrame.unionByName, finished))
    near, far = F.struct("s", "f"), F.struct("e", "l")
    turned = [F.when(near <= far, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in
              (("s", "e", "start"), ("f", "l", "first"), ("e", "s", "end"), ("l", "f", "last"))]
    chains = chains.select(*turned, F.col("n").alias("n_edges"))
    ring = chains.select(F.col("start").alias("ring"), F.col("first").alias("p1"), F.col("last").alias("p2"), F.col("n_edges").alias("n")).limit(0)
    ring = _materialise(reduce(DataFrame.unionByName, rings, ring))
    # the place of a port: its chain, the position there, and whether its way out goes up or down
    port = lambda df, to, back, start, first, pos, dir: df.select(
        F.col(to).alias("to"), F.col(back).alias("back"), F.col(start).alias("start"), first.alias("first"), pos.alias("pos"), F.lit(dir).alias("dir"))
    nil = F.lit(None).cast(key)
    at = _materialise(port(chains, "start", "first", "start", F.col("first"), zero, 1)
                      .unionByName(port(chains, "end", "last", "start", F.col("first"), F.col("n_edges"), -1))
                      .unionByName(port(ring, "ring", "p1", "ring", nil, zero, 1)).unionByName(port(ring, "ring", "p2", "ring", nil, F.col("n"), -1)))
    for out in reversed(rounds):
        pos, way = F.col("pos") + F.col("dir") * F.col("a.w"), F.col("dir")
        side = lambda name, d: F.struct(F.col("x").alias("to"), F.col(f"{name}.port").alias("back"), "start", "first", pos.alias("pos"), d.alias("dir"))  # noqa: E731, B023
        found = out.select("x", "a", "b", F.col("a.to").alias("to"), F.col("a.back").alias("back")).join(at, ["to", "back"]) \
            .select(F.inline(F.array(side("a", -way), side("b", way))))
        at = _materialise(at.unionByName(found))
    # every node but a chain's end has one port whose way goes up
    return chains, ring.select("ring", F.col("n").alias("n_edges")), at.filter("dir = 1").select("start", "first", "pos", F.col("to").alias("node"))


def contract_chains(edges: DataFrame, nodes: DataFrame, max_angle: float = 45.0, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Card G12: maximal chains between cut nodes (degree != 2, or degree 2 with a turn above
    ``max_angle`` or undefined).  Each chain once, oriented so that its first node key is the
    smaller end (a loop: its second node the smaller neighbour).  ``compat=True`` keeps only
    chains with an end of degree != 2.

    Returns ``chains(start, first, end, last, n_edges)`` and their nodes in rows, ``points(start,
    first, pos, node)``: a chain is named by its first two nodes, its end nodes included.  No
    chain is ever gathered, whatever its length.
    """
    info = _with_angles(edges, nodes)
    info = materialise_input(info.withColumn("cut", (F.col("degree") != 2) | F.col("angle").isNull() | (F.col("angle") > max_angle)))
    chains, _, places = contract_lists(edges, info)
    if compat:
        d = info.filter("degree <> 2").select("node")
        chains = chains.join(d.withColumn("_s", F.lit(True)), F.col("start") == F.col("node"), "left").drop("node") \
            .join(d.withColumn("_e", F.lit(True)), F.col("end") == F.col("node"), "left").drop("node").filter("_s or _e").drop("_s", "_e")
    points = places.join(chains.select("start", "first"), ["start", "first"], "left_semi") \
        .unionByName(chains.select("start", "first", F.col("n_edges").alias("pos"), F.col("end").alias("node")))
    return chains, points


def pure_cycles(edges: DataFrame) -> DataFrame:
    """Card G13: components whose nodes all have degree 2 (no angle test).

    Output ``cycle (smallest node), pos (0..), node``: the cycle starts at its smallest node and
    walks first towards the smaller of its two neighbours.  Rings contract to one node each
    (``contract_lists``), whichever that is; the positions are then turned and mirrored.
    """
    info = materialise_input(_neighbours(edges).withColumn("cut", F.col("degree") != 2))
    _, rings, places = contract_lists(edges, info)
    ring = places.filter("first is null").select(F.col("start").alias("ring"), "pos", "node")
    small = ring.join(info.select("node", "n1"), "node").groupBy("ring") \
        .agg(F.min(F.struct("node", F.col("pos").alias("p0"), "n1")).alias("_m")).select("ring", "_m.node", "_m.p0", "_m.n1") \
        .withColumnRenamed("node", "cycle").join(rings, "ring")
    # which way the smaller neighbour lies of the smallest node
    side = ring.join(small.select("ring", F.col("n1").alias("node"), "p0", "n_edges"), ["ring", "node"]) \
        .select("ring", (F.pmod(F.col("pos") - F.col("p0"), F.col("n_edges")) == 1).alias("_up"))
    return ring.join(small, "ring").join(side, "ring").select(
        "cycle", F.pmod(F.when(F.col("_up"), F.col("pos") - F.col("p0")).otherwise(F.col("p0") - F.col("pos")), F.col("n_edges")).alias("pos"), "node")


def simplified_graph(chains: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains with distinct ends -> ``(switches(ID, X, Y, node), tracks(ID, Departure_switch, Arrival_switch, n_edges,
    start, first))``.

    Switches are the chain end nodes numbered by first appearance (chain order = (start, end,
    first)); several chains between one node pair are all kept.  A track's points are the rows of
    its (start, first) in ``contract_chains``."""
    c = chains.filter(F.col("start") != F.col("end"))
    c = number_rows(c, ["start", "end", "first"], "ID")
    ends = c.select(F.col("start").alias("node"), F.col("ID").alias("_o"), F.lit(0).alias("_s")).unionByName(
        c.select(F.col("end").alias("node"), F.col("ID").alias("_o"), F.lit(1).alias("_s")))
    fs = ends.groupBy("node").agg(F.min(F.struct("_o", "_s")).alias("_fs"))
    sw = number_rows(fs, ["_fs"], "SID")
    switches = sw.join(nodes, "node", "left").select(F.col("SID").alias("ID"), F.col("lat").alias("X"),
                                                     F.col("lon").alias("Y"), "node")
    s = sw.select("node", "SID")
    tracks = (c.join(s.withColumnRenamed("node", "start").withColumnRenamed("SID", "Departure_switch"), "start")
              .join(s.withColumnRenamed("node", "end").withColumnRenamed("SID", "Arrival_switch"), "end")
              .select("ID", "Departure_switch", "Arrival_switch", "n_edges", "start", "first"))
    return switches, tracks


# ------------------------------------------------------------------ line graph, paths, anchors


def missing_graph(triples: DataFrame, base: DataFrame, prev: str = "prev", stop: str = "stop", nxt: str = "next",
                  src: str = "src") -> tuple[DataFrame, DataFrame]:
    """Card G18 (FIX: triples read as (prev, stop, next)).  A node is known when it has an outgoing
    link in ``base``.  Triples with all ends set, prev != stop != next and at least one unknown end
    give edges prev -> stop and stop -> next.  Returns ``(edges(src, dst), unknown nodes)``."""
    known = base.select(F.col(src).alias("_k")).distinct().withColumn("_known", F.lit(True))
    t = triples.select(F.col(prev).alias("p"), F.col(stop).alias("s"), F.col(nxt).alias("n")) \
        .filter(F.col("p").isNotNull() & F.col("s").isNotNull() & F.col("n").isNotNull()
                & (F.col("p") != F.col("s")) & (F.col("s") != F.col("n"))).distinct()
    for c in ("p", "s", "n"):
        t = t.join(known.withColumnRenamed("_k", c).withColumnRenamed("_known", f"_k{c}"), c, "left")
    t = t.filter(F.col("_kp").isNull() | F.col("_ks").isNull() | F.col("_kn").isNull())
    pair = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))
    edges = t.select(F.explode(F.array(pair("p", "s"), pair("s", "n"))).alias("e")).select("e.*").distinct()
    unknown = t.select(F.explode(F.array(*[F.when(F.col(f"_k{c}").isNull(), F.col(c)) for c in ("p", "s", "n")])).alias("node")) \
        .filter(F.col("node").isNotNull()).distinct()
    return edges, unknown


def closest_anchors(base: DataFrame, graph: DataFrame, nodes: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Card G18: ``closest_anchor_rows`` with each node's sorted anchors as one array (empty when
    unreachable).  Output ``node, distance, anchors``."""
    rows = closest_anchor_rows(base, graph, nodes, max_hops)
    kind = rows.schema["anchor"].dataType.simpleString()
    return rows.groupBy("node").agg(F.min("distance").alias("distance"), F.array_sort(F.collect_list("anchor")).alias("anchors")) \
        .withColumn("anchors", F.coalesce("anchors", F.array().cast(f"array<{kind}>")))


def closest_anchor_rows(base: DataFrame, graph: DataFrame, nodes: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Card G18 in rows: ``node, distance, anchor`` for all anchors at minimal hop distance of each
    node of ``nodes`` (NULL, NULL when unreachable).

    Anchors are the nodes with outgoing edges in both ``base`` and ``graph``; a search from all of
    them at once follows ``graph``'s outgoing edges level by level.  Anchors are numbered, and a
    node's set is a few bitmap pages of 32768 anchors each, merged bitwise in the aggregation of
    a level (partially before the shuffle), so a node that many anchors reach costs its pages and
    not a row per anchor.  Only the pages of the asked nodes are opened again.
    """
    e = materialise_input(graph.select(F.col("src").alias("node"), F.col("dst").alias("_to")).distinct())
    starts = base.select(F.col("src").alias("node")).distinct().join(e.select("node").distinct(), "node", "left_semi")
    anchors = materialise_input(number_rows(starts, ["node"], "_k", start=1))
    page, bit = F.call_function("bitmap_bucket_number", F.col("_k")), F.call_function("bitmap_bit_position", F.col("_k"))
    reached = _materialise(anchors.groupBy("node", page.alias("_page")).agg(F.call_function("bitmap_construct_agg", bit).alias("_bits"))
                           .withColumn("distance", F.lit(0)))
    frontier, level = reached, 0
    while max_hops is None or level < max_hops:
        level += 1
        new = frontier.join(e, "node").select(F.col("_to").alias("node"), "_page", "_bits") \
            .join(reached.select("node").distinct(), "node", "left_anti") \
            .groupBy("node", "_page").agg(F.call_function("bitmap_or_agg", F.col("_bits")).alias("_bits"))
        frontier = _materialise(new.withColumn("distance", F.lit(level)))
        if frontier.isEmpty():
            break
        reached = _materialise(reached.unionByName(frontier))
    asked = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    # set bits: bytes that are not nil, then the bits of each
    at = F.explode(F.filter(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.expr("_bits").substr(i + 1, F.lit(1)) != F.lit(b"\x00")))
    found = asked.join(reached, "node").select("node", "distance", "_page", "_bits", at.alias("_byte"))
    value = F.conv(F.hex(F.col("_bits").substr(F.col("_byte") + 1, F.lit(1))), 16, 10).cast("int")
    bits = F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.getbit(F.col("_value"), i) == 1))
    found = found.select("node", "distance", "_page", "_byte", value.alias("_value")).select("node", "distance", "_page", "_byte", bits.alias("_bit"))
    k = (F.col("_page") - 1) * 32768 + F.col("_byte") * 8 + F.col("_bit") + 1
    found = found.select("node", "distance", k.alias("_k")).join(anchors.select("_k", F.col("node").alias("anchor")), "_k").drop("_k")
    return asked.join(found, "node", "left").select("node", "distance", "anchor")
