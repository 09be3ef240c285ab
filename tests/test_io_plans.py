import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from railspark.sources import files as IO

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def test_csv_and_xml_round_trip(spark):
    df = spark.createDataFrame([(1, "a;b", [[50.0, 4.0], [51.0, 5.0]]), (2, 'q"x', [[1.0, 2.0]])],
                               "ID long, Name string, Coordinates array<array<double>>")
    out = IO.scratch_path(spark, "t-csv")
    IO.sink_csv(df, out)
    back = IO.scan_csv(spark, out, "ID long, Name string, Coordinates string") \
        .withColumn("Coordinates", F.from_json("Coordinates", "array<array<double>>"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    st = spark.createDataFrame([(1, 50.5, 4.25), (2, 51.0, 5.0)], "ID long, Geo_x double, Geo_y double")
    out = IO.scratch_path(spark, "t-xml")
    IO.sink_xml(IO.xml_nodes(st), out, "nodes", "node")
    got = sorted((r._id, float(r._x), float(r._y)) for r in IO.scan_xml(spark, out, "node", ["id", "x", "y"]).collect())
    assert got == [("1", 4.25, 50.5), ("2", 5.0, 51.0)]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["departure_station", "arrival_station", "n_legs", "sum_price"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["link_stats", "build_trips", "clean_legs", "alias_resolve", "polyline_split",
                                  "relation_stop_sequence", "shortest_paths", "closest_anchors", "profile_blanks"])
def test_oracle_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()

    def norm(cols, rows):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        fix = lambda v: round(v, 6) if isinstance(v, float) else (str(v) if v is not None and not isinstance(v, int) else v)
        return sorted(repr(tuple(fix(r[i]) for i in order)) for r in rows)
    assert sorted(sdf.columns) == sorted(dcols)
    assert norm(sdf.columns, [tuple(r) for r in sdf.collect()]) == norm(dcols, drows)


def test_no_python_udfs_in_plans(spark):
    qs = entry.queries()
    for name in ["link_stats", "clean_legs", "polyline_split", "turning_angle", "profile_distinct", "alias_resolve",
                 "check_endpoints_close", "relation_stop_sequence"]:
        plan = qs[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_every_query_has_oracle_or_is_listed():
    no_oracle = set(entry.QUERIES) - set(entry.ORACLE)
    assert no_oracle == {"pure_cycles_snapped"}


def test_profile_is_one_scan_and_filters_reach_the_scan(spark):
    plan = entry.queries()["profile_distinct"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    tr = entry.queries()["time_range_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scan = [l for l in tr.split("\n") if "FileScan" in l][0]
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in scan
    assert "l_tax" not in scan and "l_returnflag" not in scan


def test_edges_and_platforms_need_both_ends(spark):
    links = spark.createDataFrame([(1, 2, 1.5, [[50.0, 4.0], [51.0, 5.0]]), (1, 9, 2.0, [[50.0, 4.0]]), (9, 2, 2.0, [[50.0, 4.0]])],
                                  "Departure_station_id long, Arrival_station_id long, Distance double, Coordinates array<array<double>>")
    chosen = spark.createDataFrame([(1, "A"), (2, "B")], "ID long, Name string")
    e = IO.xml_edges(links, chosen).collect()
    assert [(r._id, r._priority, r._length) for r in e] == [("1_2", 2, 1500.0)]
    assert IO.xml_edges(links).count() == 3
    p = IO.xml_platforms(links, chosen).collect()
    assert [(r._id, r._name) for r in p] == [("1->2", "A to B platform")]


def test_base_date_reads_the_root_alone_then_the_last_step(spark):
    for lines, want in ((['<?xml version="1.0"?>', '<a begin="2024-01-05">', '<step d="2024-02-01"/>'], "2024-01-05"),
                        (['<a>', '<b d="2024-01-01"/>', '<step d="2024-02-01"/>', '<step d="2024-03-01"/>', '</a>'], "2024-03-01"),
                        (['<a>', '<b d="2024-01-01"/>', '</a>'], "None")):
        out = IO.scratch_path(spark, "t-base")
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(out)
        assert str(IO.base_date_from_xml(spark, out).first()[0]) == want


def test_null_and_blank_profiles_have_no_row_expansion(spark):
    for name in ("profile_nulls", "profile_blanks"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and plan.count("FileScan") == 1


def test_large_xml_is_read_in_splits(spark, tmp_path):
    """One file, many partitions, every element once; odd but legal attribute values and nested elements."""
    odd = ['a="1/>2"', "a='x > \"y\"'", 'a="&lt;trip"', 'a="é ü"', 'b="only b"', ""]
    rows = [f'<trip id="{k}"\n   {odd[k % 6]}' + ("/>" if k % 3 else f'><leg n="{k}"/><leg n="{-k}"/></trip >') + "\n  " for k in range(3000)]
    path = tmp_path / "one.xml"
    path.write_text('<?xml version="1.0"?>\n<trips made="2024-05-06">\n <tripinfo id="no"/>' + "".join(rows) + "</trips>\n", encoding="utf-8")
    schema = "_id string, _a string, _b string, leg array<struct<_n: string>>"
    from pyspark.sql.types import StructType
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = IO.scan_xml_records(spark, str(path), "trip", schema=StructType.fromDDL(schema))
        assert df.rdd.getNumPartitions() > 4
        got = sorted(((int(r["_id"]), r["_a"], r["_b"], [x["_n"] for x in r["leg"] or []]) for r in df.collect()), key=lambda r: r[0])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = ["1/>2", 'x > "y"', "<trip", "é ü", None, None]
    assert got == [(k, a[k % 6], "only b" if k % 6 == 4 else None, [] if k % 3 else [str(k), str(-k)]) for k in range(3000)]


def test_base_date_of_a_tag_over_several_lines(spark, tmp_path):
    cases = {'<?xml version="1.0"?>\n<!-- 1999-01-01 -->\n<summary\n   note="a > b"\n   made="x 2025-02-03 y">\n<step t="2020-01-01"/></summary>': "2025-02-03",
             '<summary>\n<step\n time="2021-01-01"/>\n<step time="2022-03-04"\n/><other d="2023-01-01"/></summary>': "2022-03-04",
             "<summary><other/></summary>": "None"}
    for k, (text, want) in enumerate(cases.items()):
        path = tmp_path / f"{k}.xml"
        path.write_text(text)
        assert str(IO.base_date_from_xml(spark, str(path)).first()["base_date"]) == want


def test_commands_publish_all_outputs_at_once(spark, tmp_path):
    """A run that fails leaves the last published one in place; generated files hold the timetable."""
    from railspark.plans import jobs
    src, out = str(tmp_path), str(tmp_path / "out")
    stations = spark.createDataFrame([(1, "A", 50.0, 4.0), (2, "B", 50.1, 4.1), (3, "C", 50.2, 4.2), (9, "far", 51.0, 5.0)], "ID int, Name string, Geo_x double, Geo_y double")
    links = spark.createDataFrame([(1, 2, 10.0, "[[50.0,4.0],[50.1,4.1]]"), (2, 3, 12.0, "[[50.1,4.1],[50.2,4.2]]"), (9, 3, 99.0, "broken")],
                                  "Departure_station_id int, Arrival_station_id int, Distance double, Coordinates string")
    stops = spark.createDataFrame([("T1", "d", 1, "2025-01-01 06:10:00"), ("T1", "d", 2, "2025-01-01 06:20:00"), ("T1", "d", 3, "2025-01-01 06:30:00"),
                                   ("T2", "d", 1, "2025-01-01 07:00:00"), ("T2", "d", 2, "2025-02-01 07:30:00")],
                                  "TRAIN_NO string, REAL_DATE_DEP string, STOPPING_PLACE_ID int, PLANNED_DATETIME_DEP string")
    inputs = {}
    for name, df in (("stations", stations), ("links", links), ("stops", stops)):
        inputs[name] = f"{src}/{name}"
        IO.sink_csv(df, inputs[name], sep=";")
    arguments = [x for k, v in inputs.items() for x in ("--in", f"{k}={v}")]
    jobs.main(["generate_simulation", *arguments, "--set", "sim_stations=1,2", "--out", out])
    assert sorted(tuple(r) for r in jobs.published(spark, out, "trips", ["id", "depart", "from", "to"]).collect()) == [("trip_0", "600", "1_2", "2_3")]
    assert {r["_id"] for r in jobs.published(spark, out, "edges", ["id"]).collect()} == {"1_2", "2_3"}
    assert jobs.published(spark, out, "routes", ["id", "depart"]).count() == 1 and jobs.published(spark, out, "platforms", ["id"]).count() == 2
    before = jobs.published(spark, out, "nodes", ["id"]).inputFiles()
    with pytest.raises(Exception):
        jobs.run_command(spark, "generate_simulation", {**inputs, "stops": f"{src}/none"}, out, sim_stations="1,2")
    broken = dict(jobs.COMMANDS)
    jobs.COMMANDS["generate_simulation"] = lambda spark, inputs, **kw: {
        "nodes": (IO.xml_nodes(stations), "nodes", "node"), "edges": stations.select(F.raise_error(F.lit("lost")).cast("string").alias("x"))}
    try:
        with pytest.raises(Exception, match="lost"):
            jobs.run_command(spark, "generate_simulation", inputs, out)
    finally:
        jobs.COMMANDS.update(broken)
    assert jobs.published(spark, out, "nodes", ["id"]).inputFiles() == before
    with pytest.raises(FileNotFoundError):
        jobs.published(spark, out, "nothing")
    jobs.run_command(spark, "correct_coordinates", {k: inputs[k] for k in ("stations", "links")}, out)
    report = {r["state"]: r for r in jobs.published(spark, out, "report").collect()}
    assert report["before"]["links"] == report["after"]["links"] == "3" and report["after"]["both_ok"] == "2"
    assert jobs.published(spark, out, "nodes", ["id"]).inputFiles() == before


def test_stream_takes_columns_by_name(spark, tmp_path):
    from railspark.streaming.punctuality import stream_punctuality
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.csv").write_text("EXTRA,PTCAR_NO,TRAIN_NO,DELAY_DEP,REAL_DATE_DEP,PLANNED_DATE_DEP,PLANNED_TIME_DEP\nzzzzzzzzzzzzzzzzzzzz,88,17,,03JAN2025,03JAN2025,06:10:00\n")
    stream_punctuality(spark, str(src), out, str(tmp_path / "ck")).awaitTermination()
    (r,) = spark.read.parquet(out).collect()
    assert (r["TRAIN_NO"], r["STOPPING_PLACE_ID"], r["DELAY_DEP"], str(r["REAL_DATE_DEP"]), r["RELATION"]) == (17, 88, None, "2025-01-03", None)
    (src / "b.csv").write_text("PTCAR_NO,TRAIN_NO,EXTRA,DELAY_DEP,REAL_DATE_DEP,PLANNED_DATE_DEP,PLANNED_TIME_DEP\n88,17,zz,,03JAN2025,03JAN2025,06:10:00\n")
    with pytest.raises(Exception):  # its header differs
        stream_punctuality(spark, str(src), out, str(tmp_path / "ck")).awaitTermination()


def test_platform_file_has_the_links_of_every_country(spark, tmp_path):
    import datetime
    from railspark.plans.queries import QUERIES
    spark.createDataFrame([(1, "a", 3, 0.0), (2, "b", 14, 0.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double") \
        .write.parquet(f"{tmp_path}/supplier.parquet")
    day = datetime.datetime(1995, 3, 1)
    spark.createDataFrame([(7, 1, 1, 5, day, 1.0, 0.0, 900.0), (7, 2, 2, 5, day, 1.0, 0.0, 900.0)],
                          "l_orderkey long, l_suppkey long, l_linenumber int, l_partkey long, l_shipdate timestamp_ntz, "
                          "l_quantity double, l_discount double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = QUERIES["sink_xml_platforms"](spark, str(tmp_path)).collect()
    assert [(r.id, r.lane, r.name) for r in rows] == [("1->2", "1_2_0", "a to b platform")]


def test_xml_records_of_plain_attributes_are_cut_as_text(spark, tmp_path):
    """Plain and odd elements read alike, and no filter on an element's fields parses it once more."""
    from railspark.operators import simout as SO
    from railspark.plans.jobs import STOPINFO_ATTRS
    els = ['id="1" a="x"/>', 'id="" a=""/>', 'id="2" id="3"/>', 'id="4" z="1" z="2"/>', "id='5' a='b'/>", 'id="6 " a=" x"/>', 'id="7" a="x &amp; y"/>',
           'a="w id=" id="9"/>', 'id="10" a="1/>2"/>', 'id="11"></stopinfo>', 'id="12" a="x">text</stopinfo>', 'id="14" a="é"/>', 'x-id="k" id="25" a="="/>', '/>', 'id="13"a="x"/>']
    path = tmp_path / "t.xml"
    path.write_text('<stops id="root">\n' + "".join(f"<stopinfo {e}\n" for e in els) + "</stops>")
    got = [tuple(r) for r in IO.scan_xml_records(spark, str(path), "stopinfo", ["id", "a", "absent"]).collect()]
    bad = (None, None, None)
    assert got == [("1", "x", None), ("", "", None), bad, bad, ("5", "b", None), ("6", "x", None), ("7", "x & y", None), ("9", "w id=", None), ("10", "1/>2", None),
                   ("11", None, None), ("12", "x", None), ("14", "é", None), ("25", "=", None), bad, bad]
    trips = spark.createDataFrame([("1", 2.0)], "trip_id string, depart_delay double")
    events = SO.stop_events(IO.scan_xml_records(spark, str(path), "stopinfo", STOPINFO_ATTRS), trips)
    assert events._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1
    assert sorted(r["trip_id"] for r in events.collect()) == sorted(["1", "5", "6", "7", "9", "10", "11", "12", "14", "25"])


def test_punctuality_dates_far_away(spark):
    from railspark.operators import simout as SO
    events = spark.createDataFrame([("a", "s", 59.5, None, -62135683201.0 - 1735689600.0, 253402300800.0 - 1735689600.0, 0.0, 0.0)],
                                   "trip_id string, station string, realtime_arrival double, realtime_departure double, scheduled_arrival double, "
                                   "scheduled_departure double, delay_arrival double, delay_departure double")
    trips = spark.createDataFrame([("a", "7", "x->y", "y")], "trip_id string, train_number string, relation string, relation_direction string")
    r = SO.punctuality_table(events, trips, F.lit("2025-01-01 00:00:00").cast("timestamp")).first()
    assert (r["date"], r["realtime_arrival_date"], r["realtime_arrival_time"], r["realtime_departure_date"]) == ("2025-01-01", "2025-01-01", "00:00:59", None)
    assert (r["scheduled_arrival_date"], r["scheduled_departure_date"]) == ("0000-12-30", "+10000-01-01")


def test_punctuality_job_keeps_its_files_small(spark, tmp_path):
    """The documents that the query makes are gone once the table is published, and what is published is compressed."""
    from datetime import datetime
    from pathlib import Path

    from railspark.plans.queries import QUERIES
    from railspark.session import ensure_checkpoint_dir
    orders = [(k, 7 * k, "FOP"[k % 3], f"{k % 5 + 1}-HIGH") for k in range(40)] + [(None, 1, "F", "x")]
    lines = [(k % 45, 11 * k, 5 + k % 9, k % 4) for k in range(200)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string") \
        .withColumn("o_orderdate", F.lit(datetime(2025, 1, 1))).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    io = Path(ensure_checkpoint_dir(spark).removeprefix("file:")) / "io"
    before = {*io.iterdir()} if io.exists() else set()
    got = QUERIES["job_simulation_punctuality"](spark, str(tmp_path))
    plain = QUERIES["punctuality_table"](spark, str(tmp_path))
    made = {*io.iterdir()} - before
    assert sorted(x.name.split("-")[0] for x in made) == ["simulation_punctuality", "stopinfo", "tripinfo"]  # the last two are punctuality_table's
    assert not [x for x in made if x.name.startswith(("tripinfo-in", "stopinfo-in"))]
    job = next(x for x in made if x.name.startswith("simulation"))
    assert {x.suffix for x in job.glob("runs/*/punctuality/part-*")} == {".gz"}
    cols = sorted(got.columns)
    assert cols == sorted(plain.columns) and got.count() == 200
    assert sorted(map(repr, got.select(*cols).collect())) == sorted(map(repr, plain.select(*cols).collect()))
