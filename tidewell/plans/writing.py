"""Queries of the write path, graphs, evaluation and catalogues, with their SQL twins."""

from pyspark.sql import functions as F

from .. import policies
from ..functions import text as T
from ..operators import catalog, extraction, graph, ingestion, lexical, lifecycle, prompts, records, reporting, vectors, working, writes
from ..session import cut, shared_dir
from ..sources import jsonl
from ..sources import logical as L
from ..sources.tables import table
from .kernels import AS_OF
from .knowledge import _COO, _TERMS
from .memory import _COS, _SCORE, QSQL, _vec, bm25_sql, queries_df

_N = r"regexp_replace(lower(regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"


def _decisions(s, d):
    return table(s, d, "ingestion_decisions", "decision_id", "should_store_episode", "episode_text", "episode_importance", "session_id", "semantic_writes", F.col("timestamp").alias("ts")).distinct()


_DEC = L.SQL + ", dec AS (SELECT DISTINCT decision_id, should_store_episode, episode_text, episode_importance, session_id, semantic_writes, \"timestamp\" AS ts FROM ingestion_decisions)"
_EPS = r"""SELECT id, min(text) AS text, min(session_id) AS session_id, min(project_id) AS project_id, min(importance) AS importance FROM (SELECT 'ep_' || substr(sha256(episode_text || chr(0) || coalesce(session_id, 'unknown') || chr(0) || 'default' || chr(0) || coalesce(ts::DECIMAL(20,3)::VARCHAR, '')), 1, 16) AS id, episode_text AS text, coalesce(session_id, 'unknown') AS session_id, 'default' AS project_id, coalesce(episode_importance, 0.5) AS importance FROM dec WHERE {w} regexp_replace(coalesce(episode_text, ''), '\s+', '', 'g') <> '') GROUP BY 1"""


def _export_turns(s, d):
    return table(s, d, "turns", F.col("turn_id").alias("id"), "session_id", "role", "content", F.lit(None).cast("bigint").alias("tokens"), F.col("timestamp").alias("ts")).distinct()


_APP = L.SQL + ", nw AS (SELECT DISTINCT turn_id AS id, session_id, content, \"timestamp\" AS ts FROM turns), un AS (SELECT id, session_id, tokens, ts FROM working UNION ALL SELECT id, session_id, length(coalesce(content, '')) // 4, ts FROM nw), ev AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) - tokens AS before, sum(tokens) OVER (PARTITION BY session_id) AS total FROM un)"


def _score(s, d):
    return lifecycle.scored(L.episodes(s, d), table(s, d, "access_log"), AS_OF)


def _with_meta(s, d):
    m = table(s, d, "messages", "id", "metadata")
    w = L.working(s, d)
    return w.join(working.with_question(w).select("id", "paired"), "id", "left").join(m, "id").select("id", "role", "content", "metadata", "paired")


def _telemetry(s, d):
    r = L.runs(s, d)
    path = f"{shared_dir(s)}/telemetry-{hash(d) & 0xFFFFFFFF:x}"
    jsonl.emit(r.select(F.col("strategy").alias("kind"), F.coalesce("failure_mode", F.lit("done")).alias("message"), "ts", F.to_json(F.struct("run_id", "duration")).alias("payload")), path, "overwrite")
    # two lines that no sink of this kind writes
    s.createDataFrame([("{broken",), ('{"no": "kind"}',)], "value string").coalesce(1).write.mode("append").text(path)
    return jsonl.read(s, path).groupBy("kind").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"), F.sum(F.get_json_object("payload", "$.run_id").cast("bigint")).alias("ids"))


def _calibration(s, d):
    c = reporting.calibration(L.runs(s, d), "duration").select("n", *[F.round(x, 6).alias(x) for x in ("mean", "std", "p50", "p95")])
    path = f"{shared_dir(s)}/calibration-{hash(d) & 0xFFFFFFFF:x}"
    jsonl.save_state(c, path)
    return jsonl.load_state(s, path, "n bigint, mean double, std double, p50 double, p95 double")


def _listings(s, d):
    p = table(s, d, "part")
    low = F.lower("p_type")
    return p.select(
        F.concat(F.lower("p_brand"), F.lit("/"), F.regexp_replace("p_name", " ", "-")).alias("repo_id"), F.col("p_partkey").alias("seen"), F.col("p_size").cast("bigint").alias("downloads"), (F.col("p_partkey") % 97).alias("likes"),
        F.when(F.col("p_partkey") % 2 == 0, "text-generation").alias("pipeline_tag"), F.array(low, F.concat(F.lit("s"), F.col("p_size").cast("string"))).alias("tags"),
        (F.col("p_size") % 5 == 0).alias("has_gguf"), F.lit(True).alias("has_safetensors"), (F.col("p_size") % 7 == 0).alias("has_awq"), F.lit(False).alias("has_gptq"), F.lit(False).alias("has_exl2"),
    )


_LIST = """WITH p AS (SELECT lower(p_brand) || '/' || replace(p_name, ' ', '-') AS repo_id, p_partkey AS seen, p_size::BIGINT AS downloads, p_partkey % 97 AS likes, CASE WHEN p_partkey % 2 = 0 THEN 'text-generation' END AS pipeline_tag, [lower(p_type), 's' || p_size] AS tags, p_size % 5 = 0 AS g, p_size % 7 = 0 AS a FROM part),
tg AS (SELECT repo_id, t, min(seen * 10 + i) AS o FROM (SELECT repo_id, seen, unnest(tags) AS t, unnest([0, 1]) AS i FROM p) GROUP BY 1, 2), ta AS (SELECT repo_id, list(t ORDER BY o) AS tags FROM tg GROUP BY 1),
m AS (SELECT repo_id, max(downloads) AS downloads, max(likes) AS likes, arg_min(pipeline_tag, seen) FILTER (pipeline_tag <> '') AS pipeline_tag, bool_or(g) AS g, bool_or(a) AS a FROM p GROUP BY 1)"""

#: A stated table of fixtures: phrases that the five best cold texts of a query should and should not hold.
FIXTURES = [(0, "worker pool error", ["worker pool"], ["broken prompt"]), (1, "retry queue times out", ["retry queue", "no such phrase"], ["retry"]), (2, "photo sorter rows", [], ["photo"]), (3, "no term of these", ["nothing"], [])]


def _fixtures(s, d):
    f = s.createDataFrame(FIXTURES, "fixture bigint, query string, expected array<string>, forbidden array<string>")
    q = f.select(F.col("fixture").alias("query_id"), "query")
    best = lexical.top(lexical.bm25(L.cold(s, d), q).withColumn("bm25", F.round("bm25", 9)), 5, "bm25").join(L.cold(s, d).select("id", "text"), "id")
    ctx = best.groupBy(F.col("query_id").alias("fixture")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("context"))
    return reporting.fixtures(ctx, f.drop("query"))


_FIX = (
    L.SQL + ", q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t, _, _ in FIXTURES) + ") AS v(query_id, query))" + bm25_sql("coldm", "text")
    + ", fx AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {e}::VARCHAR[], {n}::VARCHAR[])" for i, _, e, n in FIXTURES) + ") AS v(fixture, expected, forbidden)), cx AS (SELECT query_id, lower(string_agg(text, chr(10) ORDER BY rank)) AS c FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rank FROM bm) JOIN coldm USING (id) WHERE rank <= 5 GROUP BY 1)"
    + ", fr AS (SELECT fixture::BIGINT AS fixture, CASE WHEN len(expected) = 0 THEN 1.0 ELSE len(list_filter(expected, lambda p: contains(coalesce(c, ''), lower(p)))) / len(expected) END AS recall, CASE WHEN len(forbidden) = 0 THEN 0.0 ELSE len(list_filter(forbidden, lambda p: contains(coalesce(c, ''), lower(p)))) / len(forbidden) END AS penalty FROM fx LEFT JOIN cx ON query_id = fixture)"
)


def _revisions(s, d):
    return table(s, d, "documents", F.col("rev_id").alias("src"), F.col("parent_rev_id").alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def _judgments(s, d):
    r = L.runs(s, d)
    return r.select((F.col("task") % 6).alias("trial"), F.when(F.col("run_id") % 2 == 0, "direct").otherwise("paraphrase").alias("kind"), (F.col("status") == "done").alias("found"))


_JG = L.SQL + ", jg AS (SELECT task % 6 AS trial, CASE WHEN run_id % 2 = 0 THEN 'direct' ELSE 'paraphrase' END AS kind, status = 'done' AS found FROM runs)"


def _x3(s, d):
    p = policies.Ingestion.of("programming")
    return ingestion.decisions(_with_meta(s, d), p.threshold, p.longest, p.profile, p.task, L.episodes(s, d)).select("id", "ephemeral", F.round("score", 6).alias("score"), "reasons", F.length("episode_text").alias("chars"), "store")


def _true_sql(n):
    return f"coalesce(json_extract_string(metadata, '$.{n}') NOT IN ('', 'false', '0', '0.0', 'null', '[]', '{{}}'), false)"


def _x3_sql():
    from .analytics import _I, _or, _sql_first

    p = policies.Ingestion.of("programming")
    strip = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    either = lambda w: _or(list(w))
    return (
        L.SQL
        + f""", pr AS (SELECT id, 'User: ' || pc || chr(10) || 'Assistant: ' || content AS paired FROM (SELECT *, lag(role) OVER w AS pr, lag(content) OVER w AS pc FROM working WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)) WHERE role = 'assistant' AND pr = 'user'),
    w0 AS (SELECT working.id, working.role AS role, {strip.format(c='working.content')} AS content, metadata, paired FROM working JOIN messages m ON m.id = working.id LEFT JOIN pr ON pr.id = working.id),
    x AS (SELECT *, lower(content) AS low, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) AS w, {_sql_first(_I.PREFERENCES)} AS p0, {_sql_first(_I.FACTS)} AS f0 FROM w0),
    y AS (SELECT *, {_true_sql('ephemeral')} OR (contains(low, 'test') AND contains(low, 'message') AND w <= 8) OR regexp_matches(low, '{_or(_I.EPHEMERAL)}') AS ephemeral, {_true_sql('remember')} OR coalesce(try_cast(json_extract_string(metadata, '$.importance') AS DOUBLE) >= 0.8, false) AS told,
      regexp_matches(low, '{_or(_I.MEMORY)}') AS m, regexp_matches(low, '{either([*_I.PROFILE, *p.profile])}') AS p, regexp_matches(low, '{either([*_I.TASK, *p.task])}') AS t, role = 'assistant' AS a, (role <> 'assistant' AND p0 IS NOT NULL)::INT + (role <> 'assistant' AND f0 IS NOT NULL)::INT AS n FROM x),
    z AS (SELECT *, round(least(1.0, 0.05 + CASE WHEN told THEN 0.55 ELSE 0 END + CASE WHEN m THEN 0.28 ELSE 0 END + CASE WHEN p THEN 0.22 ELSE 0 END + CASE WHEN t THEN 0.16 ELSE 0 END + CASE WHEN a THEN 0.2 ELSE 0 END + least(0.12, w / 200.0)) + least(0.18, 0.06 * n), 9) AS score, {strip.format(c=f"substr(coalesce(nullif(paired, ''), nullif(content, ''), ''), 1, {p.longest})")} AS et FROM y),
    k AS (SELECT *, content <> '' AND NOT ephemeral AND score >= {p.threshold} AND length(et) >= 24 AS ok, {_N.format(c='et')} IN (SELECT {_N.format(c='text')} FROM eps) AS dup FROM z)
    SELECT id, ephemeral, CASE WHEN content = '' OR ephemeral THEN 0.0 ELSE round(score, 6) END AS score, CASE WHEN content = '' THEN 'empty_content' WHEN ephemeral THEN 'ephemeral_signal' ELSE array_to_string(list_filter([CASE WHEN told THEN 'explicit_memory_signal' END, CASE WHEN m THEN 'memory_language' END, CASE WHEN p THEN 'user_profile_signal' END, CASE WHEN t THEN 'task_state_signal' END, CASE WHEN a THEN 'assistant_turn_summary' END, CASE WHEN w >= 20 THEN 'substantive_turn' END, CASE WHEN n > 0 THEN 'semantic_candidates' END, CASE WHEN ok AND dup THEN 'duplicate_episode' END], lambda r: r IS NOT NULL), ',') END AS reasons,
      CASE WHEN content = '' OR ephemeral THEN 0 ELSE length(et) END::INT AS chars, ok AND NOT dup AS store FROM k"""
    )


#: Texts of every shape that a model's answer takes, around an episode's text {t}.
SHAPES = ["{t}", "<think>{t}</think> done </think> twice", "<think>{t}</think>", "Reasoning: {t}\n\nThinking on\n\nIt is {t}", "let me think\n\nanalysis of {t}", "{t} Answer: a Response: b answer: {t}", "Final answer: Output: {t}"]


def _answers(s, d):
    e = L.episodes(s, d).select("id", T.text("text").alias("t")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(SHAPES) - 1))))
    shaped = F.coalesce(*[F.when(F.col("i") == i, F.replace(F.lit(x), F.lit("{t}"), F.col("t"))) for i, x in enumerate(SHAPES)])
    return e.select("id", "i", prompts.answer(shaped).alias("answer"))


def _answers_sql():
    strip = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    q = lambda x: "'" + x.replace("'", "''") + "'"
    shaped = "CASE " + " ".join(f"WHEN i = {i} THEN replace({q(x)}, '{{t}}', t)" for i, x in enumerate(SHAPES)) + " END"
    mark = " ".join(f"WHEN contains(low, '{m.lower()}') AND {strip.format(c=_after(m))} <> '' THEN {strip.format(c=_after(m))}" for m in prompts.FINAL)
    paras = r"list_filter(list_transform(string_split(s, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(?:" + "|".join(prompts.REASONING) + ")'))"
    return (
        L.SQL
        + f", x AS (SELECT id, coalesce(text, '') AS t, unnest(range(0, {len(SHAPES)}))::INT AS i FROM eps), y AS (SELECT id, i, {strip.format(c=shaped)} AS s FROM x), z AS (SELECT *, lower(s) AS low, {paras} AS pp, {strip.format(c=chr(115) + '[instr(s, ' + chr(39) + '</think>' + chr(39) + ') + 8:]')} AS th FROM y)"
        + f" SELECT id, i, CASE WHEN contains(s, '</think>') THEN CASE WHEN th <> '' THEN th ELSE '[reasoning removed]' END {mark} WHEN regexp_matches(low, '{prompts.MARKS}') THEN CASE WHEN len(pp) > 0 THEN pp[-1] ELSE '[reasoning removed]' END ELSE s END AS answer FROM z"
    )


def _after(m):
    return f"right(s, length(string_split(low, '{m.lower()}')[-1]))"


#: JSON in text: fenced, with words around it, with braces in strings, broken, none.
WRAPS = ["Sure: ```json\n{j}\n``` ok", "result {not json} then {j} and more }", "{j}", "no json here", "[1, 2"]


def _json(s, d):
    e = L.episodes(s, d).select("id", F.to_json(F.struct(F.col("id").alias("k"), F.lit("a } b").alias("v"), F.col("importance").alias("w")), {"ignoreNullFields": "false"}).alias("j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(WRAPS) - 1))))
    made = F.coalesce(*[F.when(F.col("i") == i, F.replace(F.lit(x), F.lit("{j}"), F.col("j"))) for i, x in enumerate(WRAPS)])
    got = e.select("id", "i", prompts.json_in(made).alias("json"))
    return got.select("id", "i", F.get_json_object("json", "$.k").alias("k"), F.get_json_object("json", "$.v").alias("v"), prompts.valid(F.col("json"), "k string, w double").isNotNull().alias("valid"))


QUERIES = {
    "a2_t3_page": (lambda s, d: writes.page(L.cold(s, d), 2, 100, 1.0e9).select("id", "ts"), L.SQL + "SELECT id, ts FROM coldm WHERE ts > 1.0e9 ORDER BY ts, id LIMIT 100 OFFSET 200"),
    "a9_appended": (lambda s, d: writes.append(L.working(s, d), _export_turns(s, d), 300)[0].groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("tokens").alias("tokens")), _APP + " SELECT session_id, count(*) AS turns, sum(tokens)::BIGINT AS tokens FROM ev WHERE NOT (total > 300 AND before < total - 300) GROUP BY 1"),
    "a9_evicted": (lambda s, d: writes.append(L.working(s, d), _export_turns(s, d), 300)[1], _APP + " SELECT session_id, id FROM ev WHERE total > 300 AND before < total - 300"),
    "a10_new_episodes": (lambda s, d: writes.new_episodes(_decisions(s, d).select(F.col("episode_text").alias("text"), "session_id", F.lit(None).cast("string").alias("project_id"), F.col("episode_importance").alias("importance"), "ts")).select("id", "text", "session_id", "project_id"), _DEC + " SELECT id, text, session_id, project_id FROM (" + _EPS.format(w="") + ")"),
    "a11_upserted_preferences": (
        lambda s, d: records.upsert(L.preferences(s, d).drop("user_id"), L.preferences(s, d).drop("user_id").filter("strength < 0.7").withColumn("ts", F.col("ts") + 1).withColumn("strength", F.lit(0.9)), "id", "ts").select("id", "category", "strength", "ts"),
        L.SQL + "SELECT id, category, CASE WHEN strength < 0.7 THEN 0.9 ELSE strength END::DOUBLE AS strength, CASE WHEN strength < 0.7 THEN ts + 1 ELSE ts END AS ts FROM prefs",
    ),
    "a15_u7_telemetry": (_telemetry, L.SQL + "SELECT strategy AS kind, count(*) AS events, max(ts) AS last_ts, sum(run_id)::BIGINT AS ids FROM runs GROUP BY 1 UNION ALL SELECT 'parse_error', 2, NULL, NULL"),
    "a17_calibration": (_calibration, L.SQL + "SELECT count(duration) AS n, round(avg(duration), 6) AS mean, round(stddev_pop(duration), 6) AS std, round(quantile_cont(duration, 0.5), 6) AS p50, round(quantile_cont(duration, 0.95), 6) AS p95 FROM runs"),
    "x5_semantic_writes": (
        lambda s, d: writes.apply(_decisions(s, d), L.facts(s, d), L.preferences(s, d))[1].select("kind", "id", "value", "confidence"),
        _DEC + f""", wr AS (SELECT decision_id, json_extract_string(w, '$.kind') AS kind, coalesce(json_extract_string(w, '$.payload.value'), json_extract_string(w, '$.payload.content')) AS value, json_extract_string(w, '$.payload.confidence')::DOUBLE AS confidence FROM (SELECT decision_id, unnest(from_json(semantic_writes, '["JSON"]')) AS w FROM dec)),
        nn AS (SELECT *, {_N.format(c='value')} AS n FROM wr WHERE kind IN ('fact', 'preference') AND value IS NOT NULL), fr AS (SELECT * FROM nn WHERE NOT EXISTS (SELECT 1 FROM fcts WHERE kind = 'fact' AND {_N.format(c='content')} = n) AND NOT EXISTS (SELECT 1 FROM prefs WHERE kind = 'preference' AND {_N.format(c='prefs.value')} = n))
        SELECT kind, CASE WHEN kind = 'fact' THEN 'fact_' ELSE 'pref_' END || substr(sha256(n), 1, 16) AS id, value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY kind, n ORDER BY decision_id, value) AS rn FROM fr) WHERE rn = 1""",
    ),
    "x5_episodes": (lambda s, d: writes.apply(_decisions(s, d), L.facts(s, d), L.preferences(s, d))[0].select("id", "text", "session_id"), _DEC + " SELECT id, text, session_id FROM (" + _EPS.format(w="should_store_episode AND") + ")"),
    "x1_x3_decisions": (_x3, None),
    "l3_report": (lambda s, d: writes.forget(_score(s, d), L.episodes(s, d), below=0.4)[0], L.SQL + _SCORE + "SELECT 'ok' AS status, count(*) AS total_scored, sum((score < 0.4 AND age_days >= 7)::INT)::BIGINT AS below_threshold, least(100, sum((score < 0.4 AND age_days >= 7)::INT))::BIGINT AS would_archive, least(100, sum((score < 0.4 AND age_days >= 7)::INT))::BIGINT AS archived FROM sc"),
    "l3_dry_run": (lambda s, d: writes.forget(_score(s, d), L.episodes(s, d), least=10_000_000, dry_run=True)[0], L.SQL + _SCORE + "SELECT 'skipped' AS status, count(*) AS total_scored, 0::BIGINT AS below_threshold, 0::BIGINT AS would_archive, 0::BIGINT AS archived FROM sc"),
    "l3_remaining": (lambda s, d: writes.forget(_score(s, d), L.episodes(s, d), below=0.4)[2].select("id", "ts"), L.SQL + _SCORE + "SELECT id, ts FROM eps WHERE id NOT IN (SELECT id FROM sc WHERE score < 0.4 AND age_days >= 7 ORDER BY score, id LIMIT 100)"),
    "l7_stored": (
        lambda s, d: writes.store(L.episodes(s, d).select("id", "text", "importance", "ts"), L.cold(s, d).select("id", "text"), 0.4)[0].select("id", "ts"),
        L.SQL + f"SELECT id, ts FROM (SELECT id, ts, row_number() OVER (PARTITION BY {_N.format(c='text')} ORDER BY ts DESC, id DESC) AS rn FROM eps WHERE coalesce(importance, 0.5) >= 0.4) WHERE rn = 1",
    ),
    "l7_superseded": (lambda s, d: writes.store(L.episodes(s, d).select("id", "text", "importance", "ts"), L.cold(s, d).select("id", "text"), 0.4)[1], L.SQL + f"SELECT DISTINCT id FROM coldm WHERE {_N.format(c='text')} IN (SELECT {_N.format(c='text')} FROM eps WHERE coalesce(importance, 0.5) >= 0.4)"),
    "l8_health": (
        lambda s, d: writes.health({"working": L.working(s, d), "episodic": L.episodes(s, d), "semantic": L.facts(s, d), "cold": L.cold(s, d)}, {"working": "content", "episodic": "text", "semantic": "content", "cold": "text"}),
        L.SQL + " UNION ALL ".join(rf"SELECT '{n}' AS layer, count(*) AS rows, count(*) FILTER (regexp_replace(coalesce({c}, ''), '\s+', '', 'g') = '') AS blank, max(ts) AS newest, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status FROM {t}" for n, c, t in (("working", "content", "working"), ("episodic", "text", "eps"), ("semantic", "content", "fcts"), ("cold", "text", "coldm"))),
    ),
    "g43_lifecycle": (
        lambda s, d: writes.lifecycle_report(lifecycle.promotions(L.episodes(s, d), 0.6), lifecycle.to_forget(_score(s, d), 0.4), lifecycle.to_forget(_score(s, d), 0.4)),
        L.SQL + _SCORE + f""", pe AS (SELECT DISTINCT {_N.format(c='text')} AS n FROM eps WHERE importance >= 0.6), pf AS (SELECT DISTINCT {_N.format(c='text')} AS n FROM eps WHERE importance >= 0.6 AND regexp_matches(lower(text), 'i use |i prefer |we decided|the plan is|remember that')), fo AS (SELECT id FROM sc WHERE score < 0.4 AND age_days >= 7 ORDER BY score, id LIMIT 100)
        SELECT (SELECT count(*) FROM pe) AS promoted_events, (SELECT count(*) FROM pf) AS promoted_facts, (SELECT count(*) FROM fo) AS archived_episodes, (SELECT count(*) FROM fo) AS deleted_episodes""",
    ),
    "z2_turn_windows": (lambda s, d: writes.turn_window(L.working(s, d)), L.SQL + ", x AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS rank FROM working) SELECT session_id, string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || content, chr(10) ORDER BY rank) AS text FROM x WHERE rank <= 5 GROUP BY 1"),
    "z13_project_types": (lambda s, d: L.episodes(s, d).select("id", policies.project_types(F.col("project_id")).alias("type")), L.SQL + "SELECT id, CASE " + " ".join(f"WHEN lower(trim(coalesce(project_id, ''))) = '{k}' THEN '{v}'" for k, v in policies.ALIASES.items()) + " ELSE 'programming_assistant' END AS type FROM eps"),
    "u6_z11_strategies": (
        lambda s, d: reporting.best_candidates(policies.exact_match(L.working(s, d).select(F.col("session_id").alias("key"), F.col("id").alias("idx"), F.col("content").alias("output"), F.lit("ok").alias("expected"), F.length("content").alias("length")).filter("key IS NOT NULL")), "key").select("key", "idx", "passed"),
        L.SQL + r", x AS (SELECT session_id AS key, id AS idx, regexp_replace(content, '^\s+|\s+$', '', 'g') = 'ok' AS passed, length(content) AS n FROM working WHERE session_id IS NOT NULL) SELECT key, idx, passed FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY passed DESC, n DESC, idx) AS rn FROM x) WHERE rn = 1",
    ),
    "g4_prerequisites": (
        lambda s, d: graph.reachable(cut(_revisions(s, d), "revisions"), _revisions(s, d).filter("src % 50 = 0").select(F.col("src").alias("seed")).distinct(), 3),
        "WITH e AS (SELECT DISTINCT rev_id AS src, parent_rev_id AS dst FROM documents WHERE rev_id IS NOT NULL AND parent_rev_id IS NOT NULL), h1 AS (SELECT src AS seed, dst AS node, 1 AS hop FROM e WHERE src % 50 = 0 AND dst <> src), h2 AS (SELECT seed, dst AS node, 2 AS hop FROM h1 JOIN e ON src = node), h3 AS (SELECT seed, dst AS node, 3 AS hop FROM h2 JOIN e ON src = node) SELECT seed, node, min(hop)::INT AS hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) WHERE node <> seed GROUP BY 1, 2",
    ),
    "g6_similar_messages": (
        lambda s, d: graph.by_first_word(L.working(s, d).select(F.col("content").alias("message")), queries_df(s)).withColumn("rank", F.col("rank").cast("int")),
        L.SQL + QSQL + r", m AS (SELECT content AS message, count(*) AS frequency FROM working GROUP BY 1), x AS (SELECT query_id::BIGINT AS query_id, message, frequency, row_number() OVER (PARTITION BY query_id ORDER BY frequency DESC, message)::INT AS rank FROM q JOIN m ON contains(message, regexp_split_to_array(trim(query), '\s+')[1]) WHERE trim(query) <> '') SELECT * FROM x WHERE rank <= 5",
    ),
    "j9_similar_pairs": (
        lambda s, d: graph.similar_pairs(vectors.nearest(_vec(s, d), _vec(s, d).filter("id % 50 = 0"), 5, 0.3).select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.round("similarity", 6).alias("similarity")), 0.35),
        L.SQL + _COS.format(on="AND a.id % 50 = 0") + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims WHERE similarity >= 0.3) SELECT least(query_id, id) AS a, greatest(query_id, id) AS b, max(round(similarity, 6)) AS similarity FROM r WHERE rank <= 5 AND round(similarity, 6) >= 0.35 GROUP BY 1, 2",
    ),
    "j10_unmastered": (
        lambda s, d: graph.without(table(s, d, "subjects", "subject"), table(s, d, "subject_labels", "subject", "annotator").filter("annotator = 'ann_2'"), "subject", 20),
        "SELECT subject FROM subjects WHERE NOT EXISTS (SELECT 1 FROM subject_labels l WHERE l.subject = subjects.subject AND annotator = 'ann_2') ORDER BY 1 LIMIT 20",
    ),
    "j11_by_editor": (
        lambda s, d: graph.through(table(s, d, "documents", "editor", "doc_id"), table(s, d, "documents", "doc_id", "rev_ts"), "editor", "doc_id", "rev_ts", 3).select("editor", "doc_id", F.col("rank").cast("int").alias("rank")),
        "SELECT editor, doc_id, rank FROM (SELECT editor, doc_id, row_number() OVER (PARTITION BY editor ORDER BY rev_ts DESC NULLS LAST, doc_id)::INT AS rank FROM documents WHERE editor IS NOT NULL) WHERE rank <= 3",
    ),
    "g10_entity_edges": (
        lambda s, d: graph.upsert_edges(*[extraction.cooccurrences(extraction.tfidf(L.facts(s, d).select("id", F.col("content").alias("text"))), 2).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("RELATED").alias("kind"), (F.col("count") * k).cast("double").alias("weight")) for k in (1, 2)]),
        _TERMS + _COO + " SELECT a AS src, b AS dst, 'RELATED' AS kind, (2 * count)::DOUBLE AS weight FROM co WHERE count >= 2",
    ),
    "g31_forgetting": (
        lambda s, d: reporting.index_to_first(_judgments(s, d).filter("kind = 'direct'").groupBy("trial").agg(F.avg(F.col("found").cast("double")).alias("recall")), "trial", "recall").select("trial", F.round("recall", 9).alias("recall"), F.round("ratio", 9).alias("ratio")),
        _JG + ", c AS (SELECT trial, avg(found::INT) AS recall FROM jg WHERE kind = 'direct' GROUP BY 1) SELECT trial, round(recall, 9) AS recall, round(recall / nullif((SELECT recall FROM c WHERE trial = 0), 0), 9) AS ratio FROM c",
    ),
    "g32_recall": (lambda s, d: reporting.recall_by_kind(_judgments(s, d)).select("kind", F.round("recall", 9).alias("recall"), "n"), _JG + " SELECT kind, round(avg(found::INT), 9) AS recall, count(*) AS n FROM jg GROUP BY 1"),
    "g34_fixtures": (lambda s, d: _fixtures(s, d), _FIX + " SELECT fixture, recall, penalty, recall >= 1 AND penalty = 0 AS passed FROM fr"),
    "g34_summary": (lambda s, d: reporting.fixture_summary(_fixtures(s, d)), _FIX + " SELECT count(*) AS fixtures, round(avg(recall), 3) AS recall, round(avg(penalty), 3) AS penalty, round(avg((recall >= 1 AND penalty = 0)::INT), 3) AS pass_rate FROM fr"),
    "g42_merged": (lambda s, d: catalog.merged(_listings(s, d)).select("repo_id", "downloads", "likes", "pipeline_tag", F.array_join("tags", ",").alias("tags"), catalog.artifact(F.col("has_gguf"), F.col("has_awq"), F.col("has_gptq"), F.col("has_exl2")).alias("artifact")), _LIST + " SELECT repo_id, downloads, likes, pipeline_tag, array_to_string(tags, ',') AS tags, CASE WHEN g AND a THEN 'mixed' WHEN g THEN 'gguf' WHEN a THEN 'transformers_quantized' ELSE 'base' END AS artifact FROM m JOIN ta USING (repo_id)"),
    "z14_ranked": (
        lambda s, d: catalog.ranked(_listings(s, d), "small widget brand#2", 30).select("repo_id", "score"),
        _LIST + ", sc AS (SELECT repo_id, round(" + " + ".join(f"CASE WHEN repo_id = '{t}' OR string_split(repo_id, '/')[-1] = '{t}' THEN 60 WHEN contains(repo_id, '{t}') THEN 20 WHEN contains(lower(repo_id || ' ' || array_to_string(tags, ' ') || coalesce(' ' || pipeline_tag, '')), '{t}') THEN 8 ELSE 0 END" for t in ("small", "widget", "brand", "2"))
        + f" + least(log10(downloads + 1) * 6, 30) + least(log10(likes + 1) * 4, 16) + CASE WHEN g OR a OR regexp_matches(lower(repo_id || ' ' || array_to_string(tags, ' ') || coalesce(' ' || pipeline_tag, '')), '{'|'.join(catalog.QUANTIZED)}') THEN 8 ELSE 0 END + CASE WHEN pipeline_tag = 'text-generation' THEN 6 ELSE 0 END, 6) AS score FROM m JOIN ta USING (repo_id)) SELECT repo_id, score FROM sc ORDER BY score DESC, repo_id LIMIT 30",
    ),
    "x32_fit": (
        lambda s, d: table(s, d, "part").select("p_partkey", catalog.fit(F.element_at(F.array(*map(F.lit, ["gguf", "awq", "gptq", "other"])), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_size").cast("double"), F.when(F.col("p_partkey") % 7 > 0, F.lit(24.0)), F.when(F.col("p_partkey") % 3 == 0, F.lit(4.0)), F.when(F.col("p_partkey") % 11 == 0, "OpenAI")).alias("fit")),
        """WITH p AS (SELECT p_partkey, ['gguf', 'awq', 'gptq', 'other'][p_partkey % 4 + 1] AS f, p_size AS s, p_partkey % 7 > 0 AS known, p_partkey % 3 = 0 AS busy, p_partkey % 11 = 0 AS far FROM part), b AS (SELECT *, CASE WHEN f = 'other' THEN 'unknown' WHEN s <= 16 THEN 'good' WHEN s <= 24 THEN 'borderline' WHEN s <= 32 THEN 'better_ollama' ELSE 'likely_oom' END AS a FROM p)
        SELECT p_partkey, CASE WHEN far THEN 'remote' WHEN f = 'gguf' THEN 'good' WHEN NOT known THEN 'unknown' WHEN a IN ('good', 'borderline') AND busy THEN 'blocked_now' WHEN f = 'gptq' AND s >= 30 AND a IN ('good', 'borderline') THEN 'better_ollama' ELSE a END AS fit FROM b""",
    ),
    "r9_breaker": (
        lambda s, d: catalog.trips(L.runs(s, d).select("task", F.col("run_id").alias("id"), "ts", (F.col("status") == "failed").alias("failed")), "task", 2),
        L.SQL + ", x AS (SELECT task, run_id AS id, ts, status = 'failed' AS f, count(*) FILTER (status <> 'failed') OVER (PARTITION BY task ORDER BY ts, run_id ROWS UNBOUNDED PRECEDING) AS r FROM runs), y AS (SELECT *, row_number() OVER (PARTITION BY task, r ORDER BY ts, id) AS n FROM x WHERE f) SELECT task, id, ts AS opened, ts + 30 AS until FROM y WHERE n = 2",
    ),
    "x29_answers": (_answers, _answers_sql()),
    "x28_z9_json": (_json, L.SQL + f", x AS (SELECT id, importance, unnest(range(0, {len(WRAPS)}))::INT AS i FROM eps) SELECT id, i, CASE WHEN i < 3 THEN id END AS k, CASE WHEN i < 3 THEN 'a }} b' END AS v, i < 3 AND id IS NOT NULL AND importance IS NOT NULL AS valid FROM x"),
}
QUERIES["x1_x3_decisions"] = (_x3, _x3_sql())
