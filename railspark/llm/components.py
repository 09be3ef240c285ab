"""Connected components by contraction: every round points each node at its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable.  ``edges``: u, v (long).

    Each round maps every node to the smallest id among itself and its neighbours, rewrites
    the edges with those ids and drops loops, so the graph shrinks by half at least; the
    maps of the rounds are then applied one after another.  Hubs are aggregated map-side
    and met by joins on plain keys, which split a hub's rows.
    """
    live = written(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct())
    maps = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("to"))
        # two pointer jumps at once: u -> to(u) -> to(to(u)); ids only go down, so no cycles
        first = written(nearest)
        hop = first.select(F.col("u").alias("_u"), F.col("to").alias("_to"))
        maps.append(written(first.join(hop, F.col("to") == F.col("_u")).select("u", F.col("_to").alias("to"))))
        m = maps[-1]
        live = written(live.join(m, "u").select(F.col("to").alias("a"), "v")
                       .join(m.withColumnRenamed("u", "v"), "v").select(F.col("a").alias("u"), F.col("to").alias("v"))
                       .filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if not maps:
        return live.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = maps[0].select(F.col("u").alias("node"), F.col("to").alias("at"))
    for m in maps[1:]:
        nxt = m.select(F.col("u").alias("_u"), F.col("to").alias("_to"))
        out = out.join(nxt, F.col("at") == F.col("_u"), "left").select("node", F.coalesce("_to", "at").alias("at"))
    return out.select("node", F.col("at").alias("component"))
