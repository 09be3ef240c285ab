"""Command-line jobs for spark-submit.

Cleaning: ``python -m railspark.plans.jobs [clean] <job> --in PATH --out PATH`` reads delimited text,
runs one cleaning pipeline and writes Parquet (or CSV with ``--csv``) in parallel.

Commands with several inputs and outputs: ``python -m railspark.plans.jobs [run] <command> --in
name=PATH ... --set name=value ... --out FOLDER``.  All outputs of a run are first written into a
folder of their own; then one manifest row per output is appended in a single commit.  Readers
go by the manifest (``published``), so a run that fails half-way is never seen, and the outputs
of one run are always seen together.
"""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railspark.operators import graph as GR
from railspark.operators import polyline as P
from railspark.operators import quality as Q
from railspark.operators import simout as SO
from railspark.operators import trips as T
from railspark.operators.windows import next_stop
from railspark.plans import etl as ETL
from railspark.session import ensure_checkpoint_dir, shuffles_dropped, tune
from railspark.sources import files as IO
from railspark.sources.files import scan_csv, sink_csv

JOBS = {"stations": ETL.etl_stations, "tracks": ETL.etl_tracks, "platforms": ETL.etl_platforms,
        "line_segments": ETL.etl_line_segments, "punctuality": ETL.etl_punctuality}

#: Attribute names of the simulator's output elements, fixed by its format.
TRIPINFO_ATTRS = ["id", "tripId", "name", "depart", "arrival", "departDelay", "line", "trainNumber", "number", "from",
                  "fromEdge", "fromTaz", "to", "toEdge", "toTaz", "departLane", "arrivalLane"]
STOPINFO_ATTRS = ["id", "tripId", "name", "stopID", "busStop", "trainStop", "station", "stop", "started", "ended"]
POINTS = "array<array<double>>"


def run_job(spark: SparkSession, job: str, src: str, out: str, sep: str = ";", decimals: int = 6,
            csv: bool = False) -> None:
    raw = scan_csv(spark, src, None, sep=sep)
    fn = JOBS[job]
    df = fn(raw) if job == "punctuality" else fn(raw, decimals)
    if csv:
        sink_csv(df, out, sep=sep)
    elif job == "punctuality":
        # one folder per service month: date filters prune whole folders at scan time
        df.withColumn("service_month", F.trunc("REAL_DATE_DEP", "month")) \
            .write.mode("overwrite").partitionBy("service_month").parquet(out)
    else:
        df.write.mode("overwrite").parquet(out)


# ------------------------------------------------------------------ several inputs and outputs


def _stations(spark: SparkSession, path: str, sep: str) -> DataFrame:
    s = scan_csv(spark, path, None, sep=sep)
    return s.withColumns({"ID": F.col("ID").try_cast("int"), **{c: F.col(c).try_cast("double") for c in ("Geo_x", "Geo_y")}})


def _links(spark: SparkSession, path: str, sep: str) -> DataFrame:
    k = scan_csv(spark, path, None, sep=sep)
    ids = {c: F.col(c).try_cast("int") for c in ("Departure_station_id", "Arrival_station_id")}
    return k.withColumns({**ids, "Distance": F.col("Distance").try_cast("double"), "Coordinates": F.from_json("Coordinates", POINTS)})


def correct_coordinates(spark: SparkSession, inputs: dict, sep: str = ";", fix_key: str = "Name", fix_col: str = "Code") -> dict:
    """``stations``, ``links`` and, optionally, ``new_stations``, ``fixes`` (fix_key, fix_col) and ``ends``
    (Departure_station_id, Arrival_station_id, first, lat, lon): corrected stations and links, and
    a report of ids and line ends that match, before and after."""
    st, links = _stations(spark, inputs["stations"], sep), _links(spark, inputs["links"], sep)
    new = _stations(spark, inputs["new_stations"], sep) if "new_stations" in inputs else None
    fixes = scan_csv(spark, inputs["fixes"], None, sep=sep) if "fixes" in inputs else None
    fixed = Q.correct_stations(st, new, fixes, fix_key, fix_col, "ID")
    moved = links
    if "ends" in inputs:
        ends = scan_csv(spark, inputs["ends"], None, sep=sep)
        moved = P.polyline_replace_end(links, ends.withColumns({"Departure_station_id": F.col("Departure_station_id").try_cast("int"),
                                                                "Arrival_station_id": F.col("Arrival_station_id").try_cast("int"),
                                                                "first": F.col("first").try_cast("boolean")}))
    reports = [Q.check_station_ids(k, s)[0].withColumn("state", F.lit(name)).join(
        Q.check_endpoints(k, s).withColumn("state", F.lit(name)), "state") for name, k, s in (("before", links, st), ("after", moved, fixed))]
    return {"stations": fixed, "links": moved, "report": reports[0].unionByName(reports[1])}


def simplify_tracks(spark: SparkSession, inputs: dict, sep: str = ";", max_angle: float = 45.0) -> dict:
    """``lines`` (ID, Coordinates): switches and main tracks between them."""
    lines = scan_csv(spark, inputs["lines"], None, sep=sep).withColumn("Coordinates", F.from_json("Coordinates", POINTS))
    edges, nodes = (GR.materialise_input(x) for x in GR.polyline_graph(lines, "Coordinates"))
    chains, points = GR.contract_chains(edges, nodes, float(max_angle))
    switches, tracks = GR.simplified_graph(chains, nodes)
    tracks = GR.materialise_input(tracks)
    # the file has a track's points in one cell, so they meet here and not before
    paths = points.join(tracks.select("start", "first", "ID"), ["start", "first"]).join(nodes, "node") \
        .groupBy("ID").agg(F.array_sort(F.collect_list(F.struct("pos", F.array("lat", "lon").alias("p")))).alias("_l")) \
        .select("ID", F.transform("_l", lambda x: x["p"]).alias("Path"))
    return {"switches": switches.select("ID", "X", "Y"), "tracks": tracks.join(paths, "ID").select("ID", "Departure_switch", "Arrival_switch", "Path")}


def split_tracks(spark: SparkSession, inputs: dict, sep: str = ";", max_m: float = 800.0) -> dict:
    """``tracks`` (ID, Coordinates) and ``assigned`` (Station_ID, track_id): tracks of several stations in pieces."""
    tracks = scan_csv(spark, inputs["tracks"], None, sep=sep) \
        .select(F.col("ID").try_cast("long").alias("ID"), F.from_json("Coordinates", POINTS).alias("Path"))
    assigned = scan_csv(spark, inputs["assigned"], None, sep=sep) \
        .select(*[F.col(c).try_cast("long").alias(c) for c in ("Station_ID", "track_id")])
    switches, pieces = P.split_multi_station_tracks(tracks, assigned, float(max_m))
    return {"switches": switches, "tracks": pieces}


def simulation_punctuality(spark: SparkSession, inputs: dict, start_date: str | None = None, start_time: str = "00:00:00") -> dict:
    """``tripinfo`` and ``stopinfo`` documents (and ``summary`` for the date): the punctuality table."""
    if start_date is None and "summary" in inputs:
        start_date = IO.base_date_from_xml(spark, inputs["summary"]).first()["base_date"]
    base = F.lit(f"{start_date} {start_time}").cast("timestamp") if start_date else F.lit(None).cast("timestamp")
    trips = IO.scan_xml_records(spark, inputs["tripinfo"], "tripinfo", TRIPINFO_ATTRS).withColumn("_pos", F.monotonically_increasing_id())
    trips = GR.materialise_input(SO.trip_times(trips))
    events = SO.stop_events(IO.scan_xml_records(spark, inputs["stopinfo"], "stopinfo", STOPINFO_ATTRS), trips)
    return {"punctuality": SO.punctuality_table(events, trips, base)}


def generate_simulation(spark: SparkSession, inputs: dict, sim_stations: str, start: str = "2025-01-01 06:00:00", days: int = 5, speed: float = 33.33,
                        sep: str = ";") -> dict:
    """``stations``, ``links`` and ``stops`` (cleaned punctuality data): the network and timetable files
    of the stations listed in ``sim_stations`` (comma-separated) and their neighbours."""
    st, links = _stations(spark, inputs["stations"], sep), _links(spark, inputs["links"], sep)
    stops = scan_csv(spark, inputs["stops"], None, sep=sep).withColumns({
        "STOPPING_PLACE_ID": F.col("STOPPING_PLACE_ID").try_cast("int"), "PLANNED_DATETIME_DEP": F.col("PLANNED_DATETIME_DEP").try_cast("timestamp")})
    stops = next_stop(stops, ["TRAIN_NO", "REAL_DATE_DEP"], ["PLANNED_DATETIME_DEP", "STOPPING_PLACE_ID"], "STOPPING_PLACE_ID", "NEXT_STOPPING_PLACE_ID",
                      bucket=F.date_trunc("month", "PLANNED_DATETIME_DEP"))
    seeds = spark.createDataFrame([(int(x),) for x in sim_stations.split(",")], "station int")
    end = F.timestamp_add("DAY", F.lit(int(days)), F.lit(start).cast("timestamp"))
    st, links, stops, allowed = T.select_subnetwork(st, links, stops, seeds, F.lit(start).cast("timestamp"), end)
    legs = T.trip_legs(T.legs(stops, F.lit(start).cast("timestamp")))
    kept = GR.materialise_input(T.clean_legs_long(legs, allowed.withColumnRenamed("station", "ID")))
    return {"nodes": (IO.xml_nodes(st), "nodes", "node"), "edges": (IO.xml_edges(links, st, speed=float(speed)), "edges", "edge"),
            "platforms": (IO.xml_platforms(links, st), "additional", "trainStop"),
            "trips": (IO.xml_trips(T.od_rows(kept)), "routes", "trip"), "routes": (IO.xml_routes(T.gather_routes(T.route_rows(kept))), "routes", "vehicle")}


COMMANDS = {f.__name__: f for f in (correct_coordinates, simplify_tracks, split_tracks, simulation_punctuality, generate_simulation)}
MANIFEST = "run string, name string, format string, row_tag string, published timestamp"


def run_command(spark: SparkSession, command: str, inputs: dict, out: str, sep: str = ";", compression: str | None = None, **params) -> str:
    """Runs a command and publishes all its outputs under ``out`` at once; returns the run's name.

    ``compression``: of the published files (``gzip`` ...), None: plain; ``published`` reads either."""
    if command != "simulation_punctuality":
        params["sep"] = sep
    outputs, run, rows = COMMANDS[command](spark, inputs, **params), uuid.uuid4().hex, []
    for name, made in outputs.items():
        where = f"{out.rstrip('/')}/runs/{run}/{name}"
        with shuffles_dropped(spark):
            if isinstance(made, tuple):
                IO.sink_xml(made[0], where, made[1], made[2], compression=compression)
                rows.append((run, name, "xml", made[2]))
            else:
                sink_csv(made, where, sep=sep, compression=compression)
                rows.append((run, name, "csv", sep))
    manifest = spark.createDataFrame(rows, "run string, name string, format string, row_tag string").withColumn("published", F.current_timestamp())
    manifest.coalesce(1).write.mode("append").parquet(f"{out.rstrip('/')}/manifest")
    return run


def published(spark: SparkSession, out: str, name: str, attrs=None) -> DataFrame:
    """An output of the latest published run (strings, as in the file; XML by its attributes)."""
    rows = spark.read.schema(MANIFEST).parquet(f"{out.rstrip('/')}/manifest").filter(F.col("name") == name)
    last = rows.orderBy(F.desc("published"), F.desc("run")).first()
    if last is None:
        raise FileNotFoundError(f"no run under {out} has published {name}")
    where = f"{out.rstrip('/')}/runs/{last['run']}/{name}"
    return IO.scan_xml_records(spark, where, last["row_tag"], attrs) if last["format"] == "xml" else scan_csv(spark, where, None, sep=last["row_tag"])


def main(argv=None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="kind", required=True)
    c = sub.add_parser("clean")
    c.add_argument("job", choices=sorted(JOBS))
    c.add_argument("--in", dest="src", required=True)
    c.add_argument("--decimals", type=int, default=6)
    c.add_argument("--csv", action="store_true")
    r = sub.add_parser("run")
    r.add_argument("job", choices=sorted(COMMANDS))
    r.add_argument("--in", dest="src", action="append", required=True, metavar="NAME=PATH")
    r.add_argument("--set", dest="params", action="append", default=[], metavar="NAME=VALUE")
    for x in (c, r):
        x.add_argument("--out", required=True)
        x.add_argument("--sep", default=";")
    given = list(sys.argv[1:] if argv is None else argv)
    if given and given[0] in {**JOBS, **COMMANDS}:  # the job's name alone says which kind it is
        given.insert(0, "clean" if given[0] in JOBS else "run")
    a = p.parse_args(given)
    spark = SparkSession.builder.appName(f"railspark-{a.job}").getOrCreate()
    tune(spark)
    ensure_checkpoint_dir(spark)
    if a.kind == "clean":
        run_job(spark, a.job, a.src, a.out, a.sep, a.decimals, a.csv)
    else:
        run_command(spark, a.job, dict(x.split("=", 1) for x in a.src), a.out, a.sep, **dict(x.split("=", 1) for x in a.params))


if __name__ == "__main__":
    main()
