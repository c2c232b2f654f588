"""Orphan references: match semantics, nulls, repeats, clashing names, empty tables."""

from tidewell.operators import orphans as O

LOG = "log_id long, episode_id string, access_count long, first_accessed double, extra string"


def test_states(spark):
    log = spark.createDataFrame(
        [(1, " EP_1\n", 1, 100.0, "x"), (1, " EP_1\n", 1, 100.0, "x"), (2, "ep_2", 1, 5.0, None), (3, "ep_3", 1, 5.0, None), (4, "", 1, 5.0, None), (5, None, 1, 5.0, None), (6, "ep_9", 1, 1.0, None), (7, "ep_1", 1, None, None), (8, "ep_4", 2, 10.0, None)], LOG
    )
    eps = spark.createDataFrame([("ep_1", 50.0, 1), ("ep_2", 9.0, 1), ("ep_2", 3.0, 1), ("Ep_4", 10.5, 1), (None, 1.0, 1)], "id string, timestamp double, log_id long")
    cold = spark.createDataFrame([("ep_3",), ("ep_1",), (None,)], "id string")
    assert {(r.log_id, r.state) for r in O.found(log, eps, cold).collect()} == {(3, "deleted"), (6, "missing"), (8, "late")}
    assert O.found(log, eps, cold).count() == 3
    assert O.found(log.limit(0), eps, cold).count() == 0
    assert {r.state for r in O.found(log, eps.limit(0), cold.limit(0)).collect()} == {"missing"}


def test_composite_masks(spark):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, "y"), (4, None, None), (5, "b", "x"), (6, "q", None), (7, "a|", "x")], "id long, p string, q string")
    parents = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "|x"), (None, "x")], "p string, q string")
    got = lambda m: {r.id: r._found for r in O.orphans(refs, ["p", "q"], parents, ["p", "q"], m).collect()}
    assert got("simple") == {1: True, 2: None, 3: None, 4: None, 5: False, 6: None, 7: False}
    assert got("partial") == {1: True, 2: True, 3: True, 4: None, 5: False, 6: False, 7: False}
    assert got("full") == {1: True, 2: False, 3: False, 4: None, 5: False, 6: False, 7: False}


def test_hot_key(spark):
    log = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", 1, 1.0, "") for i in range(900)], LOG)
    eps = spark.createDataFrame([("hot", 0.0)], "id string, timestamp double")
    cold = spark.createDataFrame([], "id string")
    assert O.found(log, eps, cold).count() == 300
