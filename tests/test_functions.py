from pyspark.sql import functions as F

from railspark.functions import scalar as FX
from railspark.functions import geo as G


def one(spark, exprs, data, schema):
    return spark.createDataFrame(data, schema).select(*exprs).collect()


def test_truncate_round_and_floor(spark):
    rows = one(spark, [FX.truncate("x", 6, "round").alias("r"), FX.truncate("x", 6, "floor").alias("f")],
               [("50.779471",), ("1.001",), ("-2.0000005",), (None,), ("abc",)], "x string")
    assert rows[0].r == 50.779471 and rows[0].f == 50.779471
    assert rows[1].f == 1.000999  # floor drifts below decimal literals (card F1)
    assert rows[2].r == -2.000001 and rows[2].f == -2.000001
    assert rows[3].r is None and rows[4].r is None and rows[4].f is None


def test_datetime_merge_cases(spark):
    rows = one(spark, [F.date_format(FX.datetime_merge("d", "t", "dd-MM-yyyy", "H:mm:ss"), "yyyy-MM-dd HH:mm:ss").alias("m")],
               [("01-02-2025", "6:05:00"), ("01-02-2025", None), (None, "6:05:00"), (None, None),
                ("xx", "6:05:00"), ("31-01-2025", "23:59:59")], "d string, t string")
    assert [r.m for r in rows] == ["2025-02-01 06:05:00", None, None, None, None, "2025-01-31 23:59:59"]


def test_parse_ddmmmyyyy_and_iso(spark):
    rows = one(spark, [FX.parse_ddmmmyyyy("a").cast("string").alias("d"), FX.parse_iso_time("b").alias("s")],
               [("01JAN2025", "01:02:03"), ("31dec2024", "01:02"), ("bad", "x")], "a string, b string")
    assert [(r.d, r.s) for r in rows] == [("2025-01-01", 3723), ("2024-12-31", 3720), (None, None)]


def test_small_helpers(spark):
    rows = one(spark, [FX.to_finite_double("v").alias("v"), FX.pick_first("a", "b").alias("p"),
                       FX.lane_to_edge("l").alias("e"), FX.split_tail("r").alias("t"),
                       FX.isclose("x", "y").alias("c"), FX.unquote_json("q").alias("u")],
               [(" 1.5 ", "", "z", "a_b_12", "x->y->z", 50.0, 50.0004, '"{""k"": 1}"'),
                ("inf", None, None, "ab", "none", None, 1.0, '"x"')],
               "v string, a string, b string, l string, r string, x double, y double, q string")
    assert rows[0].v == 1.5 and rows[0].p == "z" and rows[0].e == "a_b" and rows[0].t == "y->z"
    assert rows[0].c is True and rows[0].u == '{"k": 1}'
    assert rows[1].v is None and rows[1].p is None and rows[1].e == "ab" and rows[1].t is None
    assert rows[1].c is False


def test_haversine_and_angle(spark):
    rows = one(spark, [G.haversine_m(F.lit(50.0), F.lit(4.0), F.lit(50.0), F.lit(4.01)).alias("d"),
                       G.turning_angle(F.array(F.lit(50.0), F.lit(4.0)), F.array(F.lit(50.0), F.lit(4.001)),
                                       F.array(F.lit(50.001), F.lit(4.001))).alias("a"),
                       G.turning_angle(F.array(F.lit(50.0), F.lit(4.0)), F.array(F.lit(50.0), F.lit(4.0)),
                                       F.array(F.lit(50.001), F.lit(4.001))).alias("z")],
               [(1,)], "k int")
    assert abs(rows[0].d - 715.0) < 5
    assert abs(rows[0].a - 90.0) < 1e-6
    assert rows[0].z is None
