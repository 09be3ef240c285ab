from railspark.operators import quality as Q
from railspark.operators import relational as R


def test_profile_and_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("", 1), (None, 2), ("a", 1)], "s string, n int")
    p = {r.column_name: (r.distinct_count, r.null_count, r.blank_count) for r in Q.profile(df).collect()}
    assert p == {"s": (2, 1, 1), "n": (2, 0, None)}
    d = [tuple(r) for r in Q.duplicate_rows(df).collect()]
    assert d == [("a", 1, 2)]


def test_undirected_pair_join_cases(spark):
    edges = spark.createDataFrame([("e1", 1, 2, 0), ("e2", 3, 2, 1), ("e3", 5, 6, 2), ("e1", 2, 1, 3),
                                   ("e2", 8, 9, 4)], "id string, from long, to long, ord int")
    tracks = spark.createDataFrame([("t1", 1, 2, 5, 10.1234567), ("t0", 2, 1, 1, 7.0), ("t2", 2, 3, 0, 3.0)],
                                   "track_id string, a long, b long, ord int, len double")
    got = {r.id: (r.track_id, r["from"], r["to"], r.length)
           for r in R.undirected_pair_join(edges, tracks, t_length="len").collect()}
    # forward/backward match, first track in input order wins, from/to are the track's own ends;
    # a later duplicate edge id that matches nothing does not replace an earlier match
    assert got == {"e1": ("t0", 2, 1, 7.0), "e2": ("t2", 2, 3, 3.0)}


def test_neighbour_expand_and_degree_histogram(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (3,)], "station long")
    assert sorted(r.station for r in R.neighbour_expand(e, seeds).collect()) == [2]
    deg = R.node_degree(e)
    h = {r.bucket: r.nodes for r in R.degree_histogram(deg).collect()}
    assert h == {"0": 0, "1": 2, "2": 2, "3": 0, "4": 0, ">4": 0}


def test_check_endpoints_cases(spark):
    st = spark.createDataFrame([(1, 50.0, 4.0), (2, 51.0, 5.0), (3, 52.0, 6.0)], "ID long, Geo_x double, Geo_y double")
    links = spark.createDataFrame([
        (1, 2, [[50.0, 4.0], [51.0, 5.0]]),            # exact
        (2, 3, [[51.0000004, 5.0], [52.0, 6.0]]),      # within tolerance only
        (1, 3, [[50.01, 4.0], [52.0, 6.0]]),           # outside
        (1, 9, [[50.0, 4.0], [53.0, 7.0]])],           # missing arrival station
        "Departure_station_id long, Arrival_station_id long, Coordinates array<array<double>>")
    exact = Q.check_endpoints(links, st).first()
    close = Q.check_endpoints(links, st, atol=1e-6, rtol=1e-5).first()
    assert (exact.links, exact.dep_ok, exact.arr_ok, exact.both_ok) == (4, 2, 3, 1)
    assert (close.dep_ok, close.arr_ok, close.both_ok) == (3, 3, 2)
    ratio, missing = Q.check_station_ids(links, st)
    r = ratio.first()
    assert (r.found, r.total) == (3, 4) and [m.station for m in missing.collect()] == [9]


def test_next_stop_edge_cases(spark):
    from pyspark.sql import functions as F
    from railspark.operators.windows import next_stop
    rows = [(1, "d", 10, 1, 100), (1, "d", 10, 2, 101), (1, "d", 20, 1, 102),   # tie in time -> tie-break column
            (2, "d", 5, 1, 200),                                               # one-stop train
            (3, None, 7, 1, 300), (3, "d", None, 1, 301), (3, "d", 9, 1, 302)]  # null date, null time
    df = spark.createDataFrame(rows, "TRAIN_NO int, D string, T int, SEQ int, STOP int")
    got = {r.STOP: r.NEXT for r in next_stop(df, ["TRAIN_NO", "D"], ["T", "SEQ"], "STOP", "NEXT").collect()}
    assert got[100] == 101 and got[101] == 102 and got[102] is None
    assert got[200] is None and got[300] is None
    assert got[301] == 302 and got[302] is None   # NULL time sorts first (Spark ascending)


def test_duplicate_rows_by_fingerprint(spark):
    """Against a plain count: NULLs, signed zeros, arrays, and a filter far too small for its suspects."""
    import random
    from collections import Counter
    rnd = random.Random(3)
    rows = [(rnd.choice([None, "a", "b", ""]), rnd.choice([0.0, -0.0, 1.5, None]), [rnd.choice([0.0, -0.0])], k % 400) for k in range(3000)]
    df = spark.createDataFrame(rows, "s string, d double, v array<double>, k long")
    want = Counter((s, None if d is None else d + 0.0, (v[0] + 0.0,), k) for s, d, v, k in rows)
    got = {(r["s"], r["d"], tuple(r["v"]), r["k"]): r["count"] for r in Q.duplicate_rows(df).collect()}
    assert got == {k: n for k, n in want.items() if n > 1} and len(got) > 100
    least, most = Q.LEAST_BITS, Q.MOST_BITS
    try:
        Q.LEAST_BITS = Q.MOST_BITS = 64
        assert {(r["s"], r["d"], tuple(r["v"]), r["k"]): r["count"] for r in Q.duplicate_rows(df).collect()} == got
    finally:
        Q.LEAST_BITS, Q.MOST_BITS = least, most
    assert Q.duplicate_rows(df.select("k").distinct()).count() == 0


def test_profile_counts_digests_and_merges_sketches(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS seven", "if(id % 2 = 0, cast(0 as double), -cast(0 as double)) AS zero",
                                      "if(id % 3 = 0, null, if(id % 3 = 1, '', 'x')) AS t", "cast(null as string) AS none")
    got = {r["column_name"]: tuple(r)[1:] for r in Q.profile(df).collect()}
    assert got == {"id": (5000, 0, None), "seven": (7, 0, None), "zero": (1, 0, None), "t": (2, 1667, 1667), "none": (0, 5000, 0)}
    assert "Expand" not in Q.profile(df)._jdf.queryExecution().executedPlan().toString()
    merged = Q.merge_sketches(Q.profile_sketches(df.filter("id < 3000")).unionByName(Q.profile_sketches(df.filter("id >= 2000"))))
    est = {r["column_name"]: r["distinct_count"] for r in merged.collect()}
    assert abs(est["id"] - 5000) < 250 and est["seven"] == 7 and est["t"] == 2
    approx = {r["column_name"]: r["distinct_count"] for r in Q.profile(df, approx=True, metrics=("distinct_count",)).collect()}
    assert abs(approx["id"] - 5000) < 250 and approx["none"] == 0


def test_paged_lists_of_hubs_and_empty_keys(spark):
    df = spark.range(5000).selectExpr("if(id < 4000, 1, if(id < 4990, 2, null)) AS k", "4999 - id AS v").unionByName(
        spark.createDataFrame([(1, 7), (1, 7), (3, None), (4, None), (4, 1)], "k int, v long"))
    pages = R.paged_lists(df, "k", "v", page_rows=300).collect()
    want = {1: [7] + list(range(1000, 5000)), 2: list(range(10, 1000)), None: list(range(10)), 3: [], 4: [1]}
    got = {}
    for r in sorted(pages, key=lambda r: r["page"]):
        assert len(r["values"]) <= 300 and r["page"] == len(got.get(r["k"], [])) // 300
        got.setdefault(r["k"], []).extend(r["values"])
    assert got == want


def test_paged_lists_compute_their_rows_once(spark):
    df = spark.range(50).selectExpr("id % 3 AS k", "id AS v")
    assert "Range (" not in R.paged_lists(df, "k", "v", page_rows=4)._jdf.queryExecution().optimizedPlan().toString()


def test_correct_coordinates_query_computes_its_links_once(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from railspark.plans import queries
    stops = [(1, p, s, n, datetime(2020, 1, n)) for n, (p, s) in enumerate([(5, 1), (6, 2), (7, 1), (8, 3)], 1)]
    li = spark.createDataFrame(stops, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp_ntz")
    li.selectExpr("*", "1D AS l_quantity", "0.1D AS l_discount", "2000D AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "Supplier#000000001", 3, 10.0), (2, "Two", 4, 20.0), (3, "Three", 5, 30.0)],
                          "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    plans, file = {}, queries._file

    def noted(spark, df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return file(spark, df, name)

    monkeypatch.setattr(queries, "_file", noted)
    got = {(r.dep, r.arr): (r.name, r.distance, r.first_lat, r.first_lon) for r in queries.QUERIES["job_correct_coordinates"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2): ("FIXED", 2.0, 50.5, 4.25), (2, 1): ("Two", 2.0, 49.9, 3.004), (1, 3): ("FIXED", 2.0, 50.5, 4.25)}
    assert not any("Window" in plans[name] for name in ("links", "ends"))


def test_anti_missing_reads_every_order(spark, tmp_path):
    from railspark.plans.queries import QUERIES
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(2, "5-LOW", "O"), (3, "1-URGENT", "F")], "o_custkey long, o_orderpriority string, o_orderstatus string") \
        .write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.c_custkey for r in QUERIES["anti_missing"](spark, str(tmp_path)).collect()] == [1]
