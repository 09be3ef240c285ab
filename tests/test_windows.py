import random

from pyspark.sql import functions as F

from railspark.operators import windows as W


def test_bucketed_lead_lag_equals_plain(spark):
    rnd = random.Random(3)
    data = [(rnd.randint(1, 5), rnd.randint(0, 500), i, rnd.randint(1, 9)) for i in range(400)]
    df = spark.createDataFrame(data, "k int, t int, tie int, stop int")
    for off in (1, -1):
        plain = W.lead_lag(df, "k", ["t", "tie"], "stop", "o", off).collect()
        bucket = W.lead_lag(df, "k", ["t", "tie"], "stop", "o", off, bucket=F.floor(F.col("t") / 37)).collect()
        key = lambda r: (r.k, r.t, r.tie)
        assert sorted(plain, key=key) == sorted(bucket, key=key)


def test_bucketed_windows_treat_null_keys_and_buckets_as_values(spark):
    data = [(1, None, 0, 10), (1, 5, 1, 20), (1, 45, 2, 30), (None, 3, 3, 1), (None, 50, 4, 2), (2, 9, 5, None), (2, 99, 6, 7)]
    df = spark.createDataFrame(data, "k int, t int, tie int, stop int")
    bucket = F.floor(F.col("t") / 37)
    for off in (1, -1):
        a = W.lead_lag(df, "k", ["t", "tie"], "stop", "o", off).collect()
        b = W.lead_lag(df, "k", ["t", "tie"], "stop", "o", off, bucket=bucket).collect()
        assert {r.tie: r.o for r in a} == {r.tie: r.o for r in b}
    a = W.running_sum(df, "k", ["t", "tie"], "stop", "o").collect()
    b = W.running_sum(df, "k", ["t", "tie"], "stop", "o", bucket=bucket).collect()
    assert {r.tie: r.o for r in a} == {r.tie: r.o for r in b}


def test_number_rows_consecutive(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("x"))
    rows = W.number_rows(df, ["x"], "n", start=5, partitions=7).collect()
    assert sorted((r.x, r.n) for r in rows) == [(x, x + 5) for x in range(1000)]


def test_dense_id_first_seen(spark):
    df = spark.createDataFrame([("b", 3), ("a", 1), ("b", 0), ("c", 2), ("a", 5)], "v string, pos int")
    got = {r.v: r.id for r in W.dense_id_first_seen(df, "v", ["pos"], "id").collect()}
    assert got == {"b": 0, "a": 1, "c": 2}


def test_head_per_group_and_running_sum(spark):
    df = spark.createDataFrame([(1, i, i) for i in range(5)] + [(2, 0, 10)], "k int, o int, v int")
    assert W.head_per_group(df, "k", "o", 2).count() == 3
    rs = {(r.k, r.o): r.s for r in W.running_sum(df, "k", "o", "v", "s").collect()}
    assert rs[(1, 4)] == 10 and rs[(2, 0)] == 10


def test_bucketed_running_sum_equals_plain(spark):
    import random
    rnd = random.Random(4)
    df = spark.createDataFrame([(rnd.randint(1, 4), i, rnd.randint(-5, 9)) for i in range(300)], "k int, o int, v int")
    plain = {(r.k, r.o): r.s for r in W.running_sum(df, "k", "o", "v", "s").collect()}
    buck = {(r.k, r.o): r.s for r in W.running_sum(df, "k", "o", "v", "s", bucket=F.floor(F.col("o") / 23)).collect()}
    assert plain == buck


def test_lead_lag_splits_hot_keys_only(spark):
    rnd = random.Random(5)
    data = [(rnd.choice([None, 1, 1, 1, 1, 2, 3]), rnd.choice([None, *range(300)]), i, rnd.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "k int, t int, tie int, stop int")
    bucket = F.floor(F.col("t") / 37)
    for off in (1, -1):
        plain = {r.tie: r.o for r in W.lead_lag(df, "k", ["t", "tie"], "stop", "o", off).collect()}
        for hot in (0, 120, 10 ** 6):
            assert plain == {r.tie: r.o for r in W.lead_lag(df, "k", ["t", "tie"], "stop", "o", off, bucket=bucket, hot_rows=hot).collect()}


def test_lead_lag_shuffles_keys_that_are_not_hot_once(spark):
    # the window of the many keys reads one exchange of the rows; the per-bucket table belongs to hot slots only
    df = spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias("t"), F.col("id").alias("stop"))
    plan = W.lead_lag(df, "k", ["t"], "stop", "o", bucket=F.floor(F.col("t") / 37))._jdf.queryExecution().optimizedPlan().toString()
    cold = plan[plan.index("LeftAnti") - 2000 if plan.index("LeftAnti") > 2000 else 0:plan.index("LeftAnti")]
    assert "LeftOuter" not in cold and "min_by" not in cold


def test_next_and_prev_stop_equal_plain_windows(spark):
    rnd = random.Random(6)
    data = [(rnd.choice([None, 1, 1, 1, 1, 2, 3]), rnd.choice([None, *range(300)]), i, rnd.choice([None, *range(9)])) for i in range(500)]
    df = spark.createDataFrame(data, "k int, t int, tie int, stop int")
    plain = W.lead_lag(W.lead_lag(df, "k", ["t", "tie"], "stop", "n", 1), "k", ["t", "tie"], "stop", "p", -1)
    want = sorted(plain.collect(), key=lambda r: r.tie)
    assert want == sorted(W.next_and_prev_stop(df, "k", ["t", "tie"], "stop", "n", "p").collect(), key=lambda r: r.tie)
    for hot in (0, 120, 10 ** 6):
        got = W.next_and_prev_stop(df, "k", ["t", "tie"], "stop", "n", "p", bucket=F.floor(F.col("t") / 37), hot_rows=hot)
        assert got.columns == plain.columns
        assert want == sorted(got.collect(), key=lambda r: r.tie)


def test_distinct_rows_shuffles_a_stop_once_for_both_neighbours(spark, tmp_path):
    from datetime import datetime

    from railspark.plans.queries import QUERIES
    data = [(1, p, s, n, datetime(2020, 1, n)) for n, (p, s) in enumerate([(5, 1), (6, 2), (7, 3), (8, 2)], 1)]
    li = spark.createDataFrame(data, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp_ntz")
    li.selectExpr("*", "1D AS l_quantity", "0.1D AS l_discount", "2D AS l_extendedprice").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES["distinct_rows"](spark, str(tmp_path))
    assert sorted((r[0] or 0, r[1], r[2] or 0) for r in got.collect()) == [(0, 1, 2), (1, 2, 3), (2, 3, 2), (3, 2, 0)]
    # keys that are not hot: one window; hot keys: one in the buckets and one over the per-bucket table
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 3
