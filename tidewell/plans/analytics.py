"""Queries of export, reports, calibration and ingestion."""

from pyspark.sql import functions as F

from ..operators import export, ingestion, reporting
from ..sources import logical as L
from ..sources.tables import table


def _turns(s, d):
    """Working memory with its role spellings joined."""
    r = F.col("role")
    return L.working(s, d).withColumn("role", F.when(r.isin("user", "human"), "user").when(r.isin("assistant", "ai", "bot", "model"), "assistant").otherwise(r))


_T = L.SQL + """, tr AS (SELECT id, session_id, ts, tokens, content, CASE WHEN role IN ('user', 'human') THEN 'user' WHEN role IN ('assistant', 'ai', 'bot', 'model') THEN 'assistant' ELSE role END AS role FROM working WHERE role <> 'system'),
m0 AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS n FROM tr WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)),
m1 AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM m0),
mr AS (SELECT session_id, run, role, string_agg(content, chr(10) ORDER BY ts, id) AS content, max(ts) AS ts, count(*) AS turns FROM m1 GROUP BY 1, 2, 3),
pr AS (SELECT u.session_id, u.run, u.content AS question, a.content AS answer, sha256(u.content || chr(0) || a.content) AS hash FROM mr u JOIN mr a ON a.session_id = u.session_id AND a.run = u.run + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def _or(words):
    return "|".join(w.replace("'", "''") for w in words)


def _sql_first(patterns):
    return "coalesce(" + ", ".join(f"nullif(regexp_replace(regexp_extract(content, '(?i){p.replace(chr(39), chr(39) * 2)}', 1), '^[ .,!\\n\\t]+|[ .,!\\n\\t]+$', '', 'g'), '')" for p in patterns) + ")"


_I = ingestion
_JUDGED = (
    L.SQL
    + f""", x AS (SELECT id, role, content, lower(content) AS low, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) AS w, {_sql_first(_I.PREFERENCES)} AS p0, {_sql_first(_I.FACTS)} AS f0 FROM working),
    y AS (SELECT *, (contains(low, 'test') AND contains(low, 'message') AND w <= 8) OR regexp_matches(low, '{_or(_I.EPHEMERAL)}') AS ephemeral, regexp_matches(low, '{_or(_I.MEMORY)}') AS m, regexp_matches(low, '{_or(_I.PROFILE)}') AS p, regexp_matches(low, '{_or(_I.TASK)}') AS t, role = 'assistant' AS a,
      CASE WHEN role <> 'assistant' THEN substr(p0, 1, 240) END AS preference, CASE WHEN role <> 'assistant' THEN substr(f0, 1, 320) END AS fact FROM x),
    z AS (SELECT *, round(least(1.0, 0.05 + CASE WHEN m THEN 0.28 ELSE 0 END + CASE WHEN p THEN 0.22 ELSE 0 END + CASE WHEN t THEN 0.16 ELSE 0 END + CASE WHEN a THEN 0.2 ELSE 0 END + least(0.12, w / 200.0)) + least(0.18, 0.06 * ((preference IS NOT NULL)::INT + (fact IS NOT NULL)::INT)), 9) AS score FROM y)
    SELECT id, ephemeral, score, array_to_string(list_filter([CASE WHEN m THEN 'memory_language' END, CASE WHEN p THEN 'user_profile_signal' END, CASE WHEN t THEN 'task_state_signal' END, CASE WHEN a THEN 'assistant_turn_summary' END, CASE WHEN w >= 20 THEN 'substantive_turn' END], lambda r: r IS NOT NULL), ',') AS reasons,
      preference, CASE WHEN preference IS NOT NULL THEN CASE WHEN regexp_matches(low, 'don''t like|do not like|no me gusta') THEN 0.68 ELSE 0.75 END END::DOUBLE AS strength, fact, NOT ephemeral AND score >= 0.35 AND length(substr(content, 1, 1200)) >= 24 AS store FROM z"""
)


def _judged_items(s, d):
    """Judgments made from events: found, relevance and contamination per user and type."""
    r = L.runs(s, d)
    return r.select((F.col("task") % 6).alias("grp"), F.col("strategy").alias("kind"), (F.col("status") == "done").alias("found"), (F.col("candidates") % 6).alias("relevance"), (F.col("candidates") % 10 == 0).alias("contaminated"))


QUERIES = {
    "g39_merged": (lambda s, d: export.merged(_turns(s, d)), _T + "SELECT session_id, run, role, content, ts, turns FROM mr"),
    "w13_pairs": (lambda s, d: export.pairs(export.merged(_turns(s, d))), _T + "SELECT session_id, run, question, answer, hash FROM pr"),
    "w14_first_pairs": (lambda s, d: export.first_of_each(export.pairs(export.merged(_turns(s, d)))).select("hash", "session_id", "run"), _T + "SELECT hash, session_id, run FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY session_id, run) AS rn FROM pr) WHERE rn = 1"),
    "x30_records": (
        lambda s, d: export.records(export.pairs(export.merged(_turns(s, d)))).select("hash", "session_id", "run", "raw", F.get_json_object("openai", "$.messages[1].content").alias("reply"), F.get_json_object("alpaca", "$.instruction").alias("instruction")),
        _T + r""", z AS (SELECT hash, session_id, run, regexp_replace(question, '^\s+|\s+$', '', 'g') AS q0, regexp_replace(answer, '^\s+|\s+$', '', 'g') AS a0 FROM pr), y AS (SELECT hash, session_id, run, CASE WHEN length(q0) >= 10 THEN q0 END AS q, CASE WHEN length(a0) >= 10 THEN a0 END AS a FROM z)
        SELECT hash, session_id, run, CASE WHEN coalesce(q, a) IS NOT NULL THEN concat_ws(chr(10), 'User: ' || q, 'Assistant: ' || a) END AS raw, CASE WHEN q IS NOT NULL THEN a END AS reply, CASE WHEN a IS NOT NULL AND length(q) + length(a) >= 20 THEN q END AS instruction FROM y""",
    ),
    "g40_export_stats": (
        lambda s, d: export.stats(export.merged(_turns(s, d))),
        _T + "SELECT sum(turns)::BIGINT AS turns, count(DISTINCT session_id) AS sessions, count(*) AS runs, (SELECT count(*) FROM pr) AS pairs, count(*) - 2 * (SELECT count(*) FROM pr) AS unpaired FROM mr",
    ),
    "t7_distinct_turns": (
        lambda s, d: export.tool_turns(table(s, d, "turns", "turn_id", "content", "source", "timestamp")).select("hash", "turn_id"),
        "SELECT hash, turn_id FROM (SELECT sha256(coalesce(content, '')) AS hash, turn_id, row_number() OVER (PARTITION BY sha256(coalesce(content, '')) ORDER BY CASE source WHEN 'episodic' THEN 0 WHEN 'cold' THEN 1 ELSE 2 END, \"timestamp\", turn_id) AS rn FROM turns) WHERE rn = 1",
    ),
    "g26_strategies": (
        lambda s, d: reporting.strategies(L.runs(s, d)).withColumn("duration", F.round("duration", 6)),
        L.SQL + "SELECT coalesce(strategy, '<unknown>') AS strategy, count(*) AS runs, sum((failure_mode IS NOT NULL OR status = 'failed')::INT)::BIGINT AS failures, sum((NOT (failure_mode IS NOT NULL OR status = 'failed'))::INT)::BIGINT AS successes, round(sum(coalesce(duration, 0)) / count(*), 6) AS duration, sum(coalesce(candidates, 0)) / count(*) AS candidates FROM runs GROUP BY 1",
    ),
    "f4_f5_failures": (
        lambda s, d: reporting.select_runs(L.runs(s, d).filter("failure_mode IS NOT NULL"), strategy="error", n=40).select("run_id", "failure_mode"),
        L.SQL + "SELECT run_id, failure_mode FROM runs WHERE failure_mode IS NOT NULL AND strategy = 'error' ORDER BY ts DESC, run_id DESC LIMIT 40",
    ),
    "g27_kinds": (lambda s, d: reporting.kinds(L.runs(s, d)), L.SQL + "SELECT coalesce(strategy, 'unknown') AS kind, count(*) AS events, max(ts) AS last_ts, count(*) / sum(count(*)) OVER () AS share FROM runs GROUP BY 1"),
    "g28_calibration": (
        lambda s, d: reporting.calibration(L.runs(s, d), "duration").select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p50", "p80", "p90", "p95")]),
        L.SQL + "SELECT count(duration) AS n, round(avg(duration), 6) AS mean, round(stddev_pop(duration), 6) AS std, round(quantile_cont(duration, 0.5), 6) AS p50, round(quantile_cont(duration, 0.8), 6) AS p80, round(quantile_cont(duration, 0.9), 6) AS p90, round(quantile_cont(duration, 0.95), 6) AS p95 FROM runs",
    ),
    "g29_filter_stats": (
        lambda s, d: reporting.filter_stats(L.runs(s, d), "duration", 60.0).select("seen", "stored", "rate", F.round("stored_mean", 6).alias("stored_mean"), F.round("skipped_mean", 6).alias("skipped_mean")),
        L.SQL + "SELECT count(*) AS seen, sum((duration > 60)::INT)::BIGINT AS stored, sum((duration > 60)::INT) / count(*) AS rate, round(avg(duration) FILTER (duration > 60), 6) AS stored_mean, round(avg(duration) FILTER (NOT duration > 60), 6) AS skipped_mean FROM runs",
    ),
    "g41_spearman": (
        lambda s, d: reporting.spearman(L.runs(s, d), "duration", "candidates").select(F.round("spearman", 6).alias("spearman"), "n"),
        L.SQL + ", r AS (SELECT rank() OVER (ORDER BY duration) + (count(*) OVER (PARTITION BY duration) - 1) / 2 AS x, rank() OVER (ORDER BY candidates) + (count(*) OVER (PARTITION BY candidates) - 1) / 2 AS y FROM runs WHERE duration IS NOT NULL AND candidates IS NOT NULL) SELECT round(corr(x, y), 6) AS spearman, count(*) AS n FROM r",
    ),
    "w10_ema": (
        lambda s, d: reporting.ema(L.runs(s, d), ["task"], ["ts", "run_id"], "duration").select("task", "n", F.round("ema", 6).alias("ema")),
        L.SQL + "SELECT task, count(*) AS n, round(list_reduce(list(duration ORDER BY ts, run_id), lambda e, x: 0.05 * x + 0.95 * e), 6) AS ema FROM runs WHERE duration IS NOT NULL GROUP BY 1",
    ),
    "w11_adaptive": (
        lambda s, d: reporting.adaptive(L.runs(s, d), "task", ["ts", "run_id"], "duration", 20.0).select("run_id", F.round("threshold", 6).alias("threshold"), "stored"),
        L.SQL + """, p AS (SELECT *, row_number() OVER w AS pos, avg(duration) OVER (w ROWS 99 PRECEDING) AS m, stddev_pop(duration) OVER (w ROWS 99 PRECEDING) AS sd FROM runs WINDOW w AS (PARTITION BY task ORDER BY ts, run_id)),
        r AS (WITH RECURSIVE f AS (SELECT task, pos, run_id, duration, m, sd, CASE WHEN pos >= 10 THEN 0.9 * 20.0 + 0.1 * m ELSE 20.0 END::DOUBLE AS t FROM p WHERE pos = 1 UNION ALL SELECT p.task, p.pos, p.run_id, p.duration, p.m, p.sd, (CASE WHEN p.pos >= 10 THEN 0.9 * f.t + 0.1 * p.m ELSE f.t END)::DOUBLE FROM f JOIN p ON p.task = f.task AND p.pos = f.pos + 1) SELECT * FROM f)
        SELECT run_id, round(t, 6) AS threshold, duration > t AND duration <= m + 3 * sd AS stored FROM r""",
    ),
    "g30_recall": (
        lambda s, d: reporting.recall(_judged_items(s, d)),
        L.SQL + "SELECT task % 6 AS grp, strategy AS kind, count(*) AS n, avg((status = 'done')::INT) AS recall, avg((candidates % 6)::DOUBLE) AS relevance, avg((candidates % 10 = 0)::INT) AS contamination FROM runs GROUP BY 1, 2",
    ),
    "w12_candidates": (
        lambda s, d: reporting.best_candidates(L.runs(s, d).select("task", F.col("run_id").alias("idx"), (F.col("status") == "done").alias("passed"), F.col("duration").alias("score"), F.col("candidates").alias("length")), "task"),
        L.SQL + "SELECT task, idx, passed, score, length FROM (SELECT task, run_id AS idx, status = 'done' AS passed, duration AS score, candidates AS length, row_number() OVER (PARTITION BY task ORDER BY status = 'done' DESC, duration DESC, candidates DESC, run_id) AS rn FROM runs) WHERE rn = 1",
    ),
    "f11_errors": (
        lambda s, d: L.working(s, d).select("id", reporting.classify_errors(F.col("content")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
        L.SQL + "SELECT CASE WHEN regexp_matches(lower(content), 'context length|maximum context|too many tokens') THEN 'context' WHEN regexp_matches(lower(content), 'out of memory|oom') THEN 'oom' WHEN regexp_matches(lower(content), 'timed out|timeout|connection|unreachable') THEN 'transient' ELSE 'other' END AS kind, count(*) AS n FROM working GROUP BY 1",
    ),
    "x1_x4_judged": (lambda s, d: ingestion.judged(L.working(s, d)), _JUDGED),
}
