"""Joins and running sums for hot keys: the same results at thresholds that make everything hot."""

import random

from pyspark.sql import functions as F

from tidewell.operators import skew


def _rows(n=2000, seed=1):
    r = random.Random(seed)
    return [(i, "hot" if r.random() < 0.5 else r.choice(["a", "b", None]), float(r.randint(0, 300)), r.randint(0, 9)) for i in range(n)]


def test_lookup_equals_join(spark):
    left = spark.createDataFrame(_rows(), "id long, k string, t double, v long")
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "k string, w long")
    for how, hot in (("left", ["hot"]), ("inner", ["hot", "z"]), ("left", ())):
        want = sorted((r.id, r.w) for r in left.join(right, "k", how).collect() if True)
        got = sorted((r.id, r.w) for r in skew.lookup(left, right, "k", how, hot=hot, salts=4).collect())
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_blocks_running_and_previous(spark):
    rows = _rows()
    df = skew.with_blocks(spark.createDataFrame(rows, "id long, k string, t double, v long"), ["k"], "t", rows=100, cuts=16)
    assert df.select("_block").distinct().count() > 4
    run = {r.id: r.s for r in skew.running(df, ["k"], ["t", "id"], {"s": F.col("v")}).collect()}
    prev = {r.id: r._prev.id if r._prev else None for r in skew.previous(df, ["k"], ["t", "id"], ["id"]).collect()}
    by = {}
    for i, k, t, v in sorted(rows, key=lambda r: (repr(r[1]), r[2], r[0])):
        total, last = by.get(k, (0, None))
        assert run[i] == total + v
        assert prev[i] == last
        by[k] = (total + v, i)


def test_one_block_reads_once(spark, data):
    """No group is large: no totals, no joins, one scan."""
    from tidewell.sources.tables import table

    df = skew.with_blocks(table(spark, data, "messages", "id", "session_id", "timestamp"), ["session_id"], "timestamp")
    for d in (skew.running(df, ["session_id"], ["timestamp", "id"], {"n": F.lit(1)}), skew.previous(df, ["session_id"], ["timestamp", "id"], ["id"])):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Join" not in plan


def test_previous_where(spark):
    rows = _rows()
    for n in (100, 10**6):
        df = skew.with_blocks(spark.createDataFrame(rows, "id long, k string, t double, v long"), ["k"], "t", rows=n, cuts=16)
        got = {r.id: r._prev.id if r._prev else None for r in skew.previous(df, ["k"], ["t", "id"], ["id"], where=F.col("v") > 5).collect()}
        last = {}
        for i, k, t, v in sorted(rows, key=lambda r: (repr(r[1]), r[2], r[0])):
            assert got[i] == last.get(k)
            if v > 5:
                last[k] = i


def test_empty(spark):
    e = spark.createDataFrame([], "id long, k string, t double, v long")
    b = skew.with_blocks(e, ["k"], "t")
    assert skew.running(b, ["k"], ["t", "id"], {"s": F.col("v")}).count() == 0
    assert skew.lookup(e, spark.createDataFrame([], "k string, w long"), "k").count() == 0


def test_cut_and_clear(spark):
    from tidewell import session

    session.clear(spark)
    df = session.cut(spark.range(10).selectExpr("id", "id % 3 AS k"), "t")
    assert df.count() == 10
    assert session.clear(spark) == 1 and session.clear(spark) == 0
