"""Small cases of core operators: ties, nulls, empty tables, recall, round trips."""

import json

import numpy as np
from pyspark.sql import functions as F

from tidewell.operators import export, extraction, graph, lexical, records, reporting, retrieval, vectors, working
from tidewell.streaming import bus, neural

TURNS = "id long, session_id string, role string, content string, tokens long, ts double"


def _turns(spark):
    return spark.createDataFrame([(1, "s", "user", "hi", 5, 1.0), (2, "s", "assistant", "yo", 5, 1.0), (3, "s", "system", "x", 50, 2.0), (4, "s", "user", None, None, 3.0), (5, None, "user", "lone", 2, 1.0)], TURNS)


def test_working(spark):
    t = _turns(spark)
    assert {r.id for r in working.context_window(t, 10, False).collect()} == {1, 2, 4, 5}
    assert {r.id for r in working.context_window(t, 5, False).collect()} == {2, 4, 5}
    assert {r.id for r in working.evicted(t, 52).collect()} == {1, 2}
    assert [r.paired for r in working.with_question(t).collect()] == ["User: hi\nAssistant: yo"]
    assert working.recent(t.limit(0), 3).count() == 0


def test_export(spark, tmp_path):
    runs = export.merged(_turns(spark))
    p = export.records(export.pairs(runs), min_chars=1, min_pair=1)
    r = p.collect()
    assert len(r) == 1 and json.loads(r[0].openai)["messages"][1] == {"role": "assistant", "content": "yo"}
    assert export.write(p, str(tmp_path / "o")) == 1
    assert json.loads(spark.read.text(str(tmp_path / "o")).first().value)["messages"][0]["content"] == "hi"


def test_bm25_edges(spark):
    docs = spark.createDataFrame([("a", "red fox"), ("b", None), ("c", ""), ("d", "red red hen")], "id string, text string")
    q = spark.createDataFrame([(0, "red hen"), (1, ""), (2, "?!")], "query_id long, query string")
    got = lexical.bm25(docs, q).collect()
    assert {(r.query_id, r.id) for r in got} == {(0, "a"), (0, "d")}
    assert max(got, key=lambda r: r.bm25).id == "d"
    assert lexical.bm25(docs.limit(0), q).count() == 0


def test_index_recall(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.filter("id % 50 = 0")
    exact = {(r.query_id, r.id) for r in vectors.nearest(v, q, 10, chunk=100, block=3).collect()}
    near = {(r.query_id, r.id) for r in vectors.nearest_indexed(v, q, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_vectors_edges(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (None, [1.0, 1.0]), (4, None)], "id long, vector array<float>")
    got = {(r.query_id, r.id): r.similarity for r in vectors.nearest(v, v, 5).collect()}
    assert got[2, 3] == 1.0 and got[1, 2] == 0.0 and (4, 2) not in got
    assert {r.id for r in vectors.superseded(v).collect()} == {2}


def test_graph(spark):
    e = graph.both_ways(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d"), (None, "q")], "a string, b string"))
    s = spark.createDataFrame([("a",)], "seed string")
    assert {(r.node, r.hop) for r in graph.reachable(e, s, 2).collect()} == {("b", 1), ("x", 1), ("c", 2), ("d", 2)}
    assert graph.shortest(e, "a", "d").first().path == "a>x>d"
    assert graph.shortest(e, "a", "nowhere").count() == 0


def test_relations(spark):
    docs = spark.createDataFrame([("1", "I prefer pytest over unittest. I use PyCharm as my primary IDE."), ("2", "I use it over all the time."), ("3", None)], "id string, text string")
    prefs = spark.createDataFrame([("p1", "Pytest")], "id string, value string")
    assert {(r.subject, r.relation, r.object) for r in extraction.relations(docs, prefs).collect()} == {("p1", "PREFERS", "pytest"), ("root", "USES", "pycharm")}


def test_similar_exists_equals_brute_force(spark):
    import itertools
    import random

    r = random.Random(3)
    base = [" ".join(r.choice("abcdefghijkl") * 3 + str(r.randint(0, 3)) for _ in range(12)) for _ in range(30)]
    rows = [(str(i), b) for i, b in enumerate(base)] + [(f"x{i}", b + " tail") for i, b in enumerate(base[:10])]
    df = spark.createDataFrame(rows, "id string, content string")
    tok = {i: set(c.split()) for i, c in rows}
    want = {a for a, b in itertools.permutations(tok, 2) if len(tok[a] & tok[b]) / len(tok[a] | tok[b]) >= 0.9}
    assert {x.id for x in records.similar_exists(df, df).collect()} == want


def test_select_is_greedy(spark):
    rows = [(0, "a", "episodic", "alpha beta gamma delta", 5, 0.9), (0, "b", "episodic", "alpha beta gamma delta", 5, 0.8), (0, "c", "semantic", "other words here", 500, 0.7), (0, "d", "cold", "last one", 3, 0.1), (0, "e", "cold", " ", 1, 0.5)]
    c = spark.createDataFrame(rows, "query_id long, id string, layer string, text string, tokens int, score double")
    assert [r.id for r in retrieval.select(c, 1000).orderBy("place").collect()] == ["a", "d"]


def test_spearman_and_ema(spark):
    rows = [(1, "k", float(i), float(i % 7), float((i * 5) % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "run_id long, k string, ts double, a double, b double")
    import pandas as pd

    p = pd.DataFrame(rows, columns=["run_id", "k", "ts", "a", "b"])
    assert abs(reporting.spearman(df, "a", "b").first().spearman - p["a"].rank().corr(p["b"].rank())) < 1e-9
    e = None
    for x in p["a"]:
        e = x if e is None else 0.05 * x + 0.95 * e
    assert abs(reporting.ema(df, ["k"], ["ts", "run_id"], "a").first().ema - e) < 1e-9


def test_bus():
    b = bus.Bus(2)
    assert b.put(bus.Turn(0.5, 1, text="a")) and b.put(bus.Turn(0.9, 2, text="b"))
    assert not b.put(bus.Turn(0.1, 3)) and b.put(bus.Turn(0.6, 4, text="c", ts=9.0))
    head = b.get()
    assert (head.text, head.importance, head.merged, b.dropped) == ("b\nc", 0.9, True, 1)


def test_ingest_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "user", "Please remember this important decision about the plan for the deploy.", "s", 1.0), (2, "user", "ok", "s", 2.0)], "id long, role string, content string, session_id string, ts double").write.parquet(src)
    bus.ingest(bus.files(spark, src, "id long, role string, content string, session_id string, ts double"), out, str(tmp_path / "cp")).awaitTermination()
    assert [r.id for r in spark.read.parquet(out).collect()] == [1]
    seen = []
    bus.every(bus.files(spark, src, "id long"), 2, seen.append, str(tmp_path / "cp2")).awaitTermination()
    assert seen == [2]


def test_windows_stream(spark, data, tmp_path):
    from tidewell.plans.streams import QUERIES

    assert QUERIES["r_tumbling"][0](spark, data).count() > 0


def test_net_learns():
    net = neural.Net(neural.Settings(keys=16, values=8, hidden=16))
    r = np.random.default_rng(0)
    k, v = r.normal(size=16) / 4, r.normal(size=8) / 4
    s = [net.step(k, v) for _ in range(300)]
    assert s[0][0] == s[0][1]
    assert np.mean([x[0] for x in s[-20:]]) < s[0][0] / 2


def test_surprise_per_key_is_independent(spark):
    rows = [(k, i, float(i), "user" if i % 2 else "assistant", f"text {i} {k}") for k in ("a", "b") for i in range(12)]
    df = spark.createDataFrame(rows, "k string, id long, ts double, role string, content string")
    both = {(r.k, r.id): r.surprise for r in neural.surprises(df, "k").collect()}
    one = {(r.k, r.id): r.surprise for r in neural.surprises(df.filter("k = 'b'"), "k").collect()}
    assert len(both) == 24 and all(abs(both[x] - y) < 1e-12 for x, y in one.items())
