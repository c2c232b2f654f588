"""Semantic layer, write path, prompts, catalogue, policies and JSON lines: edges that the tables lack."""

import json

import pytest
from pyspark.sql import functions as F

from tidewell import policies
from tidewell.operators import catalog, extraction, graph, ingestion, prompts, records, reporting, retrieval, semantic, writes
from tidewell.sources import jsonl

FACT = "id string, content string, confidence double, source string, ts double"
PREF = "id string, category string, value string, strength double, ts double"
EVENT = "id string, summary string, detail string, importance double, ts double"
QUERY = "query_id long, query string"


def _layer(spark):
    f = spark.createDataFrame([("f1", "the build tool is ninja", 0.9, "chat", 1.0), ("f2", None, None, None, None), ("f3", "unrelated words", 0.1, None, 2.0)], FACT)
    p = spark.createDataFrame([("p1", "build", "ninja files", 0.5, 1.0), ("p2", "Build", "cmake files", 0.9, 2.0), ("p3", None, None, None, None)], PREF)
    e = spark.createDataFrame([("e1", "the build broke", None, 0.0, 3.0), ("e2", "", "", None, None)], EVENT)
    return f, p, e


def test_best_preference_per_category(spark):
    f, p, e = _layer(spark)
    q = spark.createDataFrame([(0, "build tool ninja"), (1, ""), (2, None)], QUERY)
    got = [(r.query_id, r.type, r.id) for r in semantic.candidates(f, p, e, q, 10.0).collect()]
    assert (0, "fact", "f1") in got and (0, "event", "e1") in got and not any(i == "f3" for _, _, i in got)
    assert sum(t == "preference" for k, t, _ in got if k == 0) == 1
    assert not any(k in (1, 2) for k, _, _ in got)


def test_affinity_only_helps(spark):
    f, p, e = _layer(spark)
    q = spark.createDataFrame([(0, "build tool ninja")], QUERY)
    up = spark.createDataFrame([(0, "f1", 1.0), (0, "e1", -1.0)], "query_id long, id string, affinity double")
    a = {r.id: r.score for r in semantic.candidates(f, p, e, q, 10.0).collect()}
    b = {r.id: r.score for r in semantic.candidates(f, p, e, q, 10.0, affinity=up).collect()}
    assert abs(b["f1"] - a["f1"] - 0.08) < 1e-9 and b["e1"] == a["e1"]
    eps = spark.createDataFrame([("x", "build tool", 0.0, None), ("y", "build", 0.9, 5.0)], "id string, text string, importance double, ts double")
    s = {r.id: r.score for r in retrieval.episodic(eps, q, 10.0).collect()}
    t = {r.id: r.score for r in retrieval.episodic(eps, q, 10.0, affinity=spark.createDataFrame([(0, "x", 0.5)], "query_id long, id string, affinity double")).collect()}
    assert abs(t["x"] - s["x"] - 0.04) < 1e-9 and t["y"] == s["y"]
    ranked = spark.createDataFrame([(0, "y", 3)], "query_id long, id string, rank int")
    assert [r.id for r in retrieval.episodic(eps, q, 10.0, ranked=ranked).collect()] == ["y"]


def test_empty_layers(spark):
    f, p, e = (x.limit(0) for x in _layer(spark))
    q = spark.createDataFrame([(0, "build")], QUERY)
    assert semantic.candidates(f, p, e, q, 1.0).count() == 0 and semantic.search_preferences(p, q).count() == 0
    edges = spark.createDataFrame([], "subject string, relation string, subject_text string, entity_text string, confidence double")
    assert semantic.search_all(f, p, e, edges, q).count() == 0


def test_working_window_is_off_the_budget(spark):
    f, p, e = _layer(spark)
    q = spark.createDataFrame([(0, "build tool ninja", "s"), (1, "", "s"), (2, "build", None)], "query_id long, query string, session_id string")
    turns = spark.createDataFrame([(i, "s", "user", "x" * 40, 10, float(i)) for i in range(5)], "id long, session_id string, role string, content string, tokens long, ts double")
    eps = spark.createDataFrame([("x", "build tool ninja again", 0.9, 5.0)], "id string, text string, importance double, ts double")
    cold = spark.createDataFrame([], "id string, text string, ts double, metadata_json string")
    got = retrieval.retrieve(eps, f, cold, q, 10.0, 53, p, e, turns).collect()
    assert sum(r.layer == "working" for r in got if r.query_id == 0) == 5 and sum(r.layer == "working" for r in got if r.query_id == 1) == 5
    assert sum(r.tokens for r in got if r.query_id == 0) <= 53 and all(r.layer == "working" for r in got if r.query_id == 1)
    assert not any(r.layer == "working" for r in got if r.query_id == 2)


def test_append_and_evict(spark):
    t = "id long, session_id string, role string, content string, tokens long, ts double"
    kept, gone = writes.append(spark.createDataFrame([(1, "s", "user", "a" * 40, 10, 1.0)], t), spark.createDataFrame([(2, "s", "user", "b" * 40, None, 2.0), (3, None, None, None, None, None)], t), 12)
    assert {r.id for r in kept.collect()} == {2, 3} and {r.id for r in gone.collect()} == {1}


def test_new_episodes_are_the_same_twice(spark):
    t = spark.createDataFrame([("a", None, None, None, 1.0), ("a", None, None, None, 1.0), (" \n", "s", "p", 0.1, 2.0), (None, "s", "p", 0.1, 2.0)], "text string, session_id string, project_id string, importance double, ts double")
    one, two = (sorted(map(tuple, writes.new_episodes(x).collect())) for x in (t, t.unionByName(t)))
    assert one == two and len(one) == 1 and one[0][1:4] == ("unknown", "default", 0.5)


def test_forget_gate(spark):
    s = spark.createDataFrame([(f"e{i}", "p", "t", 0.1, float(i), 30.0, 0, 0.1) for i in range(60)], "id string, project_id string, text string, importance double, ts double, age_days double, hits long, score double")
    e = s.select("id", "text", "ts")
    report, rows, left = writes.forget(s, e, most=10)
    assert tuple(report.first()) == ("ok", 60, 60, 10, 10) and rows.count() == 10 and left.count() == 50
    report, rows, left = writes.forget(s, e, least=61)
    assert report.first().status == "skipped" and rows.count() == 0 and left.count() == 60
    report, rows, left = writes.forget(s, e, dry_run=True)
    assert report.first().status == "dry_run" and report.first().would_archive == 60 and rows.count() == 0 and left.count() == 60


def test_consolidation_and_store(spark):
    a = spark.createDataFrame([("x", 0.2), ("x", 0.3), ("y", 0.9), ("z", 0.1), ("z", 0.1)], "id string, affinity double")
    assert [(r.id, r.hits) for r in writes.consolidation_ids(a).collect()] == [("x", 2)]
    n = spark.createDataFrame([("n1", "Same  text", 0.5, 1.0), ("n2", "same text", None, 2.0), ("n3", "low", 0.1, 3.0)], "id string, text string, importance double, ts double")
    o = spark.createDataFrame([("o1", "SAME TEXT"), ("o2", "other")], "id string, text string")
    new, gone = writes.store(n, o, 0.3)
    assert [r.id for r in new.collect()] == ["n2"] and [r.id for r in gone.collect()] == ["o1"]
    new, _ = writes.store(n, o, 0.0, surprising=spark.createDataFrame([("n3",)], "id string"))
    assert [r.id for r in new.collect()] == ["n3"]


def test_decisions(spark):
    t = spark.createDataFrame(
        [(1, "user", "x", '{"ephemeral": true}', None), (2, "user", "keep this in mind please, whatever comes", '{"remember": true}', None), (3, "user", " ", None, None), (4, "user", "hi", '{"importance": 0.9}', "User: hi\nAssistant: a long enough text"), (5, "user", "i prefer ninja and remember the decided plan", "{broken", None), (6, "user", None, None, None)],
        "id long, role string, content string, metadata string, paired string",
    )
    e = spark.createDataFrame([("I PREFER ninja and  remember the decided plan",)], "text string")
    got = {r.id: r for r in ingestion.decisions(t, episodes=e).collect()}
    assert got[1].reasons == "ephemeral_signal" and got[3].reasons == "empty_content" == got[6].reasons
    assert got[2].store and "explicit_memory_signal" in got[2].reasons and got[4].store and got[4].episode_text.startswith("User: hi")
    assert not got[5].store and got[5].reasons.endswith("duplicate_episode") and got[5].preference


def test_statement_families(spark):
    t = spark.createDataFrame([(1, "We decided to wait. The über worker depends on the queue. We switched to poetry for builds and more."), (2, "short text decided"), (3, None)], "id long, text string")
    got = {(r.relation, r.subject, r.object) for r in extraction.statements(t).collect()}
    assert {("DECIDED", "wait", None), ("USES", "poetry", None)} <= got and any(r == "DEPENDS_ON" and o == "the queue" for r, _, o in got)
    texts = {r.content for r in extraction.payloads(extraction.statements(t)).collect()}
    assert "[DECIDED] wait" in texts and any(" → the queue" in x for x in texts)


@pytest.mark.parametrize(("given", "want"), [("<think>a</think> b </think> c", "b </think> c"), ("<think>a</think>", "[reasoning removed]"), ("x Answer: one Final answer: two", "two"), ("Reasoning: a\n\nanalysis b", "[reasoning removed]"), ("let me think\n\nIt is 4.", "It is 4."), ("plain", "plain"), ("", ""), (None, "")])
def test_answers(spark, given, want):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(prompts.answer(F.col("t"))).first()[0] == want


def test_json_in_text(spark):
    rows = [('```json\n{"a": 1}\n```', '{"a": 1}'), ('bad { then {"a": "}"} more', '{"a": "}"}'), ("none", None), (None, None), ("7", "7"), ("[1, 2] x", "[1, 2]")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r[0] for r in df.select(prompts.json_in(F.col("t"))).collect()] == [w for _, w in rows]
    assert spark.createDataFrame([('{"k": "x"}',)], "t string").select(prompts.valid(F.col("t"), "k string, w double")).first()[0] is None


def test_prompt_parts(spark):
    df = spark.createDataFrame([("", None, "hello")], "a string, b string, u string")
    assert df.select(prompts.assembled(F.col("b"), prompts.wrapped(F.col("a")), F.col("u"))).first()[0] == "User: hello\nAssistant:"
    assert df.select(prompts.hint(F.lit(60), F.lit(3.0), F.lit(1.5))).first()[0].startswith("This appears to be a novel topic or unusual framing (surprise: 2.0x")
    assert df.select(prompts.hint(F.lit(10), F.lit(3.0), F.lit(1.5))).first()[0] == ""
    p = df.select(prompts.fitted(F.lit("u" * 4000), F.lit("w" * 400), F.lit("s" * 40), F.lit("e" * 400), F.lit("c" * 40), F.lit("n"), 100, 10)).first()[0]
    assert len(p.user) <= 363 and p.cold == "" and p.neural == "" and p.episodic == "" and p.semantic == "s" * 40 and 0 < len(p.working) < 400


def test_catalog(spark):
    s = "a string, b string"
    df = spark.createDataFrame([("Org/Model-7B-AWQ", "model-7b"), ("org/a", "org/b"), ("", "x"), ("a_b", "A-B")], s)
    assert [r[0] for r in df.select(catalog.same_model(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]
    assert [r[0] for r in df.select(catalog.size_b(F.col("a"))).collect()] == [7.0, None, None, None]
    calls = spark.createDataFrame([("k", i, float(i), i != 3) for i in range(8)], "k string, id long, ts double, failed boolean")
    assert [(r.id, r.until) for r in catalog.trips(calls, "k").orderBy("id").collect()] == [(2, 32.0), (6, 36.0)]


def test_policies(spark):
    assert policies.Ingestion.of("Programming").threshold == 0.6 and policies.Ingestion.of("nobody").longest == 1400 and policies.Ingestion.of("general").threshold == 0.35
    runner = policies.Strategies()
    runner.register("exact", policies.exact_match)
    runner.register("any", policies.pass_through)
    df = spark.createDataFrame([("k", 1, " ok ", "ok"), ("k", 2, None, "ok")], "key string, idx long, output string, expected string")
    assert runner.available() == ["any", "exact"] and [r.passed for r in runner.run("exact", df).orderBy("idx").collect()] == [True, False]
    with pytest.raises(KeyError):
        runner.run("none", df)
    vec = policies.embedder(lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert [list(r[0]) for r in df.select(vec(F.col("output"))).collect()] == [[4.0, 1.0], [0.0, 1.0]]
    lp = policies.log_probabilities(lambda texts: [-float(len(t)) for t in texts])
    assert [r[0] for r in df.select(policies.surprising(lp(F.col("output")), 10.0)).collect()] == [True, False]
    none = policies.log_probabilities(None)
    assert all(r[0] for r in df.select(policies.surprising(none(F.col("output")), 10.0)).collect())


def test_json_lines(spark, tmp_path):
    ev = spark.createDataFrame([("a", "m", 1.0, json.dumps({"x": 1})), ("b", None, None, None)], "kind string, message string, ts double, payload string")
    path = str(tmp_path / "t")
    jsonl.emit(ev, path)
    spark.createDataFrame([("{oops",), ("",)], "value string").write.mode("append").text(path)
    got = {(r.kind, r.message) for r in jsonl.read(spark, path).collect()}
    assert got == {("a", "m"), ("b", None), ("parse_error", "{oops")}


def test_graph_writes(spark):
    n = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 1.0)], "id string, name string, ts double")
    assert {(r.id, r.name) for r in graph.upsert_nodes(n, spark.createDataFrame([("a", "z", 2.0), ("b", "old", 0.5)], "id string, name string, ts double")).collect()} == {("a", "z"), ("b", "y")}
    pairs = graph.similar_pairs(spark.createDataFrame([(2, 1, 0.9), (1, 2, 0.8), (1, 1, 1.0), (3, 1, 0.1)], "a long, b long, similarity double"), 0.5).collect()
    assert [(r.a, r.b, r.similarity) for r in pairs] == [(1, 2, 0.9)]


def test_order_statistics(spark):
    vals = [3.0, 1.0, 1.0, None, 2.0, 9.0]
    df = spark.createDataFrame([(v, "g") for v in vals], "x double, g string")
    r = reporting.order_statistics(df, "x", {"first": F.lit(0), "mid": F.floor(F.col("n") / 2), "last": F.col("n") - 1}).first()
    assert (r.n, r.first, r.mid, r.last) == (5, 1.0, 2.0, 9.0)
    assert reporting.order_statistics(df.limit(0), "x", {"a": F.lit(0)}, "g").count() == 0
    c = reporting.calibration(df, "x").first()
    assert (c.n, c.p50, round(c.p90, 9)) == (5, 2.0, 6.6)
    assert reporting.calibration(df.limit(0), "x").first().p50 is None


def test_adaptive_over_pieces(spark):
    rows = [(("k", "l")[i % 2], i, float((i * 37) % 101)) for i in range(2600)]
    got = {r.i: r.threshold for r in reporting.adaptive(spark.createDataFrame(rows, "k string, i long, x double"), "k", ["i"], "x", 20.0).collect()}
    for k in ("k", "l"):
        t, seen = 20.0, []
        for _, i, x in [r for r in rows if r[0] == k]:
            seen.append(x)
            if len(seen) >= 10:
                t = 0.9 * t + 0.1 * sum(seen[-100:]) / len(seen[-100:])
            assert abs(got[i] - t) < 1e-9


def test_similar_rows_by_class(spark):
    old = [(f"o{i}", "one two three four five six seven eight nine ten") for i in range(50)] + [("z", "nothing alike"), ("n", None)]
    new = [("o1", "one two three four five six seven eight nine ten"), ("q", "Ten nine eight seven six five four three two one eleven"), ("z", "nothing alike"), ("e", "")]
    s = "id string, content string"
    assert {r.id for r in records.similar_exists(spark.createDataFrame(new, s), spark.createDataFrame(old, s)).collect()} == {"o1", "q"}


def test_few_scans(spark, data):
    """What is read twice is read from few scans, not from one per helper call."""
    from tidewell.plans import registry

    for name in ("l2_retention", "w1_evicted", "g41_spearman", "g39_merged"):
        plan = registry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= 4, (name, plan.count("FileScan"))
