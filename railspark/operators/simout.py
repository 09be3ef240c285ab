"""Simulator output -> punctuality table (card T8), all column expressions and joins.

Inputs are the attribute tables of ``tripinfo`` and ``stopinfo`` elements read with
``scan_xml`` (strings).  FIX vs the reference: delays are not swapped on output, the
realtime arrival date appears once, NULL times propagate instead of failing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railspark.functions.scalar import lane_to_edge, pick_first, seconds_to_ts, split_head, split_tail, to_finite_double
from railspark.operators.relational import last_wins


def trip_times(tripinfo: DataFrame, order: str = "_pos") -> DataFrame:
    """Per trip: real/scheduled depart and arrive seconds, train number, relation, direction.

    scheduled = real - departDelay for both ends; duplicate ids: last row (``order``) wins."""
    t = tripinfo.select(
        pick_first("_id", "_tripId", "_name").alias("trip_id"), F.col(order),
        to_finite_double("_depart").alias("real_depart"), to_finite_double("_arrival").alias("real_arrive"),
        to_finite_double("_departDelay").alias("depart_delay"),
        pick_first("_line", "_trainNumber", "_number", "_name", "_id").alias("train_number"),
        pick_first("_from", "_fromEdge", "_fromTaz").alias("_f"), pick_first("_to", "_toEdge", "_toTaz").alias("_t"),
        *[F.nullif(lane_to_edge(c), F.lit("")).alias(n) for c, n in (("_departLane", "_fl"), ("_arrivalLane", "_tl"))])
    t = t.filter(F.col("trip_id").isNotNull())
    rel = F.when(F.col("_f").isNotNull() & F.col("_t").isNotNull(), F.concat_ws("->", "_f", "_t")) \
        .when(F.col("_fl").isNotNull() & F.col("_tl").isNotNull(), F.concat_ws("->", "_fl", "_tl"))
    t = t.select("trip_id", F.col(order), "real_depart", "real_arrive", "depart_delay", "train_number",
                 rel.alias("relation"))
    t = t.withColumns({"scheduled_depart": F.col("real_depart") - F.col("depart_delay"),
                       "scheduled_arrive": F.col("real_arrive") - F.col("depart_delay"),
                       "relation_direction": split_tail("relation", "->")})
    return last_wins(t, "trip_id", order).drop(order)


def stop_events(stopinfo: DataFrame, trips: DataFrame) -> DataFrame:
    """Per stop: station, real and scheduled seconds and delays (unknown trip delay -> 0)."""
    s = stopinfo.select(pick_first("_id", "_tripId", "_name").alias("trip_id"),
                        split_head(pick_first("_stopID", "_busStop", "_trainStop", "_station", "_stop"), "_").alias("station"),
                        to_finite_double("_started").alias("started"), to_finite_double("_ended").alias("ended"))
    s = s.filter(F.col("trip_id").isNotNull())  # stops of no trip are skipped
    j = s.join(trips.select("trip_id", "depart_delay"), "trip_id", "left")
    d = F.coalesce(F.col("depart_delay"), F.lit(0.0))
    dd = F.abs(F.col("started") + 30 - F.col("ended") + d)
    return j.select("trip_id", "station", F.col("started").alias("realtime_arrival"),
                    F.col("ended").alias("realtime_departure"), d.alias("delay_arrival"), dd.alias("delay_departure"),
                    (F.col("started") - d).alias("scheduled_arrival"), (F.col("ended") - dd).alias("scheduled_departure"))


def punctuality_table(events: DataFrame, trips: DataFrame, base) -> DataFrame:
    """Stop events + trips -> calendar columns (dates ``yyyy-MM-dd``, times ``HH:mm:ss``) from ``base``."""
    j = events.join(trips.select("trip_id", "train_number", "relation", "relation_direction"), "trip_id", "left")
    ts = {k: seconds_to_ts(base, F.col(k)) for k in ("realtime_arrival", "realtime_departure", "scheduled_arrival",
                                                     "scheduled_departure")}
    # one text per timestamp, cut into date and time; a plain cast writes the same text for these years and takes less time
    first, last = (F.lit(x).cast("timestamp") for x in ("0001-01-03", "9999-12-29"))
    text = {k: F.when(v.between(first, last), v.cast("string")).otherwise(F.date_format(v, "yyyy-MM-dd HH:mm:ss")) for k, v in ts.items()}
    j = j.select("trip_id", "train_number", "relation", "relation_direction", "delay_departure", "delay_arrival", "station",
                 *[v.alias(f"_{k}") for k, v in text.items()])
    dates = {k: F.substring_index(f"_{k}", " ", 1) for k in ts}
    out = {"date": F.coalesce(*dates.values()),
           "train_number": F.col("train_number"), "train_id": F.col("trip_id"), "relation": F.col("relation")}
    for k in ts:
        kind, what = k.split("_")
        out[f"{kind}_{what}_time"] = F.substring(F.substring_index(f"_{k}", " ", -1), 1, 8)
        out[f"{kind}_{what}_date"] = dates[k]
    out.update({"relation_direction": F.col("relation_direction"), "delay_departure": F.col("delay_departure"),
                "delay_arrival": F.col("delay_arrival"), "station": F.col("station")})
    return j.select(*[c.alias(n) for n, c in out.items()])
