from pyspark.sql import functions as F

from railspark.operators import trips as T

LEG_SCHEMA = "TRAIN_NO int, REAL_DATE_DEP string, departure_station long, arrival_station long, sumo_time long"


def test_build_trips_keeps_trains_after_single_leg(spark):
    legs = spark.createDataFrame([
        (1, "d", 10, 11, 0), (1, "d", 11, 12, 60),
        (2, "d", 20, None, 30),                        # one-leg train between two longer ones
        (3, "d", 30, 31, 90), (3, "d", 31, None, 120)], LEG_SCHEMA)
    trips = T.build_trips(legs).orderBy("trip_id").collect()
    assert [(r.TRAIN_NO, r.trip_id) for r in trips] == [(1, 0), (3, 1)]
    assert [(x.dep, x.arr) for x in trips[1].legs] == [(30, 31), (31, None)]


def test_clean_legs_fold(spark):
    legs = spark.createDataFrame([
        (1, "d", 1, 2, 0), (1, "d", 1, 3, 1), (1, "d", 2, 3, 2), (1, "d", 5, 3, 3), (1, "d", 3, 4, 4),
        (1, "d", 9, 9, 5),
        (2, "d", 7, 8, 0), (2, "d", 8, 7, 1),
        (3, "d", 6, None, 0), (3, "d", 6, 7, 1)], LEG_SCHEMA)
    trips = T.build_trips(legs)
    allowed = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 9)], "ID long")
    got = {r.TRAIN_NO: [(x.dep, x.arr) for x in r.legs] for r in T.clean_legs(trips, allowed).collect()}
    # equal departure, then connected, disconnected, connected; trip 2/3 emptied -> dropped
    assert got == {1: [(1, 2), (2, 3), (3, 4)]}
    nofilter = {r.TRAIN_NO: [(x.dep, x.arr) for x in r.legs] for r in T.clean_legs(trips).collect()}
    assert nofilter[3] == [(6, 7)] and nofilter[2] == [(7, 8), (8, 7)]


def test_alias_resolve_cases(spark):
    legs = spark.createDataFrame([(100, 200), (100, 5), (5, 200), (100, 300), (7, 8), (None, 200)],
                                 "departure_station long, arrival_station long")
    aliases = spark.createDataFrame([(100, 1, 1), (100, 2, 2), (200, 1, 21), (200, 2, 22)],
                                    "alias long, rank int, station long")
    edges = spark.createDataFrame([(2, 22), (1, 22), (2, 5), (5, 22)], "src long, dst long")
    got = {(r.departure_station, r.arrival_station) for r in T.alias_resolve(legs, aliases, edges).collect()}
    assert (1, 22) in got          # both aliased: first pair in rank order that is adjacent
    assert (2, 5) in got           # dep aliased only: match at second rank
    assert (5, 22) in got          # arr aliased only
    assert (100, 300) in got       # no match: unchanged
    assert (7, 8) in got and (None, 200) in got


def test_relation_stop_sequence(spark):
    rows = [("R1", 1, "d", 0, 10), ("R1", 1, "d", 1, 11), ("R1", 1, "d", 2, 10), ("R1", 2, "d", 0, 12),
            ("R2", 3, "d", 0, 5), ("R2", 3, "d", 1, 6), (None, 4, "d", 0, 9)]
    df = spark.createDataFrame(rows, "RELATION string, TRAIN_NO int, REAL_DATE_DEP string, PLANNED_DATETIME_DEP int, "
                                     "STOPPING_PLACE_ID int")
    got = sorted(tuple(r) for r in T.relation_stop_sequence(df).collect())
    assert got == [("R1", 1, 10), ("R1", 2, 11), ("R2", 1, 5), ("R2", 2, 6)]


def test_periodic_trips_and_schedule(spark):
    pairs = spark.createDataFrame([(1, 2, 0), (3, 4, 5000), (5, 6, 6000), (7, 8, 0)], "src int, dst int, offset int")
    t = T.periodic_trips(pairs, end=10000, headway=2500, tail=5000).orderBy("trip_id").collect()
    assert [(r.from_station, r.depart) for r in t] == [(1, 0), (1, 2500), (1, 5000), (3, 5000), (7, 0), (7, 2500), (7, 5000)]
    assert [r.trip_id for r in t] == [1, 2, 3, 4, 5, 6, 7]
    routes = spark.createDataFrame([("v", 100.0, "e0 e1 eX e2")], "vehicle string, depart double, edges string")
    edges = spark.createDataFrame([("e0", 1000.0, 10.0), ("e1", 1000.0, 10.0), ("e2", 1000.0, 50.0)],
                                  "id string, length double, speed double")
    s = [r.departure for r in T.schedule_propagate(routes, edges, vmax=20.0).orderBy("pos").collect()]
    assert s == [160.0, 320.0, 380.0, 490.0]


def test_clean_legs_long_matches_fold(spark):
    import random
    rnd = random.Random(9)
    rows = []
    for train in range(40):
        for i in range(rnd.randint(1, 14)):
            dep = rnd.choice([1, 2, 3, 4, None]) if rnd.random() < 0.95 else None
            rows.append((train, "d", dep, rnd.choice([1, 2, 3, 4, 5]), i * 10))
    legs = spark.createDataFrame(rows, LEG_SCHEMA)
    allowed = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "ID long")
    arrays = {r.TRAIN_NO: [(x.t, x.dep, x.arr) for x in r.legs]
              for r in T.clean_legs(T.build_trips(legs, min_legs=2), allowed).collect()}
    long = {}
    for r in T.clean_legs_long(T.trip_legs(legs, min_legs=2), allowed).collect():
        long.setdefault(r.TRAIN_NO, []).append((r.t, r.dep, r.arr))
    assert {k: sorted(v) for k, v in long.items()} == {k: sorted(v) for k, v in arrays.items()}


def test_merge_legs_long_matches_fold(spark):
    """Random trips with many shared ends, equal legs and one long trip that alternates between runs."""
    import random
    rnd = random.Random(21)
    rows = []
    for train in range(40):
        for i in range(rnd.randint(1, 14)):
            rows.append((train, "d", rnd.choice([1, 2, 3, None]) if rnd.random() < 0.9 else 4, rnd.choice([1, 2, 3]), rnd.randint(0, 9) * 60))
    for i in range(120):
        rows.append((99, "d", 1 if i // 3 % 2 else 10 + i // 3, 20 + i if i // 3 % 2 else 2, i * 30))
    legs = spark.createDataFrame(rows, LEG_SCHEMA)
    fold = {r.TRAIN_NO: [(x.t, x.dep, x.arr) for x in r.legs] for r in T.clean_legs(T.build_trips(legs, min_legs=2), merge="mean").collect()}
    long = {}
    trips = T.trip_legs(legs, min_legs=2)
    names = {r["trip_id"]: r["TRAIN_NO"] for r in trips.select("trip_id", "TRAIN_NO").distinct().collect()}
    for r in T.merge_legs_long(trips, bucket_rows=16).orderBy("trip_id", "ord").collect():
        long.setdefault(names[r["trip_id"]], []).append((r["t"], r["dep"], r["arr"]))
    assert long.keys() == fold.keys()
    for k, kept in fold.items():
        assert [x[1:] for x in long[k]] == [x[1:] for x in kept]
        assert all(abs(a[0] - b[0]) < 1e-6 for a, b in zip(long[k], kept))


def test_simulator_output_cases(spark):
    from railspark.operators import simout as SO
    trips = spark.createDataFrame([
        ("t1", None, None, "100", "400", "20", "IC1", None, None, "a", None, None, "b", None, None, None, None, 0),
        ("t1", None, None, "110", "410", "30", "IC1", None, None, "a", None, None, "b", None, None, None, None, 1),
        (None, None, "t2", "", "500", "x", None, None, None, None, None, None, None, None, None, "e1_0", "e2_3", 2)],
        ", ".join(f"_{c} string" for c in ["id", "tripId", "name", "depart", "arrival", "departDelay", "line",
                                          "trainNumber", "number", "from", "fromEdge", "fromTaz", "to", "toEdge",
                                          "toTaz", "departLane", "arrivalLane"]) + ", _pos int")
    tt = {r.trip_id: r for r in SO.trip_times(trips).collect()}
    assert tt["t1"].real_depart == 110.0 and tt["t1"].scheduled_depart == 80.0   # duplicate id: last wins
    assert tt["t1"].relation == "a->b" and tt["t1"].relation_direction == "b"
    assert tt["t2"].real_depart is None and tt["t2"].depart_delay is None and tt["t2"].relation == "e1->e2"
    stops = spark.createDataFrame([("t1", "S1_0", "200", "260"), ("t9", "S2", "100", "130"), ("t2", "S3_1", "50", "90")],
                                  "_id string, _stopID string, _started string, _ended string") \
        .withColumns({c: __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("string")
                      for c in ["_tripId", "_name", "_busStop", "_trainStop", "_station", "_stop"]})
    ev = {r.trip_id: r for r in SO.stop_events(stops, SO.trip_times(trips)).collect()}
    assert (ev["t1"].station, ev["t1"].delay_arrival, ev["t1"].delay_departure) == ("S1", 30.0, 0.0)
    assert ev["t9"].delay_arrival == 0.0 and ev["t9"].scheduled_arrival == 100.0     # unknown trip
    assert ev["t2"].delay_arrival == 0.0                                              # delay missing
    table = SO.punctuality_table(SO.stop_events(stops, SO.trip_times(trips)), SO.trip_times(trips),
                                 F.lit("2025-01-01 23:59:00").cast("timestamp")).collect()
    r = [x for x in table if x.train_id == "t1"][0]
    assert (r.date, r.realtime_arrival_time, r.realtime_departure_date) == ("2025-01-02", "00:02:20", "2025-01-02")


def test_alias_resolve_matches_a_pair_search(spark):
    import random
    rnd = random.Random(11)
    legs = [(i, rnd.choice([None, 1, 2, 3, 4, 5, 100, 101]), rnd.choice([None, 1, 2, 3, 4, 5, 100, 101, 102])) for i in range(150)]
    aliases = [(100, 1, 3), (100, 2, 1), (100, 2, 5), (101, None, 2), (101, 4, None), (102, 1, 4), (3, 1, 2)]
    edges = [(a, b) for a in range(1, 6) for b in range(1, 6) if rnd.random() < 0.3] + [(101, 4), (2, 101)]
    got = {r.id: (r.departure_station, r.arrival_station) for r in T.alias_resolve(
        spark.createDataFrame(legs, "id int, departure_station long, arrival_station long"),
        spark.createDataFrame(aliases, "alias long, rank int, station long"), spark.createDataFrame(edges, "src long, dst long")).collect()}

    def options(x):
        return [(r or 0, s or a) for a, r, s in aliases if a == x] or [(0, x)]

    for i, d, a in legs:
        hits = [(r1, r2, s1, s2) for r1, s1 in options(d) for r2, s2 in options(a) if (s1, s2) in edges]
        assert got[i] == (min(hits)[2:] if hits else (d, a))


def test_alias_resolve_of_long_lists_makes_no_product(spark):
    # 30,000 x 30,000 members of two aliases: 900 million pairs, one edge
    al = spark.range(60000).selectExpr("CAST(1000000 + id % 2 AS BIGINT) AS alias", "CAST(id AS INT) AS rank", "id AS station")
    legs = spark.createDataFrame([(1000000, 1000001)], "departure_station long, arrival_station long")
    r = T.alias_resolve(legs, al, spark.createDataFrame([(58, 77)], "src long, dst long"))
    assert [tuple(x) for x in r.collect()] == [(58, 77)]
