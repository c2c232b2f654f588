"""Queries of scans, upserts, lookups, predicates and prompt texts."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import orphans as O
from ..operators import prompts
from ..operators import records as R
from ..sources import logical as L
from ..sources.tables import table
from .kernels import AS_OF, tok

def _prompt():
    return F.concat(F.lit("Sys\n\n"), F.lit(R.BEGIN), F.lit("\n"), T.text("text"), F.lit("\n"), F.lit(R.END), F.lit("\n\nUser: hi"))


_PSQL = f"'Sys' || chr(10) || chr(10) || '{R.BEGIN}' || chr(10) || coalesce(text, '') || chr(10) || '{R.END}' || chr(10) || chr(10) || 'User: hi'"


def _profile(s, d):
    e, a = L.episodes(s, d), L.cold(s, d)
    p = lambda df, name: df.agg(F.lit(name).alias("layer"), F.count(F.lit(1)).alias("n"), F.count_distinct("project_id").alias("projects"), F.count_distinct("session_id").alias("sessions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return p(e, "episodic").unionByName(p(a, "cold"))


def _fit(s, d):
    """Every layer from whole columns of an episode, fitted into 200 tokens with 50 held back."""
    t = lambda c: F.coalesce(c, F.lit(""))
    e = L.episodes(s, d).select("id", prompts.fitted(F.col("text"), F.col("metadata"), F.concat(t("session_id"), F.lit(" "), t("project_id")), F.concat(t("text"), t("metadata")), F.concat(t("metadata"), t("text")), F.lit("hint"), 200, 50).alias("p"))
    return e.select("id", *[F.length(f"p.{x}").alias(x) for x in ("user", "working", "semantic", "episodic", "cold", "neural")])


QUERIES = {
    "a1_sessions_scan": (
        lambda s, d: L.working(s, d).filter("ts >= 1706700000").select("session_id", "id", "role", "ts"),
        L.SQL + "SELECT session_id, id, role, ts FROM working WHERE ts >= 1706700000",
    ),
    "a3_recent_archive": (
        lambda s, d: R.newest(L.cold(s, d), 10_000).filter("project_id LIKE 'proj%'").select("id", "project_id"),
        L.SQL + "SELECT id, project_id FROM (SELECT * FROM coldm ORDER BY ts DESC, id LIMIT 10000) WHERE project_id LIKE 'proj%'",
    ),
    "a4_episode_roles": (
        lambda s, d: L.episodes(s, d).filter("importance >= 0.4").select("id", F.coalesce(F.get_json_object("metadata", "$.role"), F.lit("user")).alias("role"), F.lower(F.get_json_object("metadata", "$.source")).alias("channel")),
        L.SQL + "SELECT id, coalesce(json_extract_string(metadata, '$.role'), 'user') AS role, lower(json_extract_string(metadata, '$.source')) AS channel FROM eps WHERE importance >= 0.4",
    ),
    "a5_metadata_scan": (lambda s, d: L.episodes(s, d).select("id", "ts", "importance", "session_id"), L.SQL + "SELECT id, ts, importance, session_id FROM eps"),
    "a6_by_ids": (
        lambda s, d: R.lookup_ids(L.episodes(s, d).withColumn("key", O.plain_key(F.col("id"))), table(s, d, "access_log", "episode_id").select(O.plain_key(F.col("episode_id")).alias("key")), "key").select("id", "importance"),
        L.SQL + r"SELECT id, importance FROM eps WHERE lower(trim(id)) IN (SELECT lower(regexp_replace(episode_id, '^\s+|\s+$', '', 'g')) FROM access_log WHERE episode_id IS NOT NULL)",
    ),
    "a7_newest_facts": (lambda s, d: R.newest(L.facts(s, d), 100).select("id", "ts"), L.SQL + "SELECT id, ts FROM fcts ORDER BY ts DESC, id LIMIT 100"),
    "a8_t5_all_rows": (
        lambda s, d: R.tagged_union(fact=L.facts(s, d).select("id", F.col("content").alias("text"), "confidence", "ts"), cold=L.cold(s, d).select("id", "text", "ts"), episode=L.episodes(s, d).select("id", "text", "importance", "ts")).select("type", "id", "confidence", "importance", "ts"),
        L.SQL + "SELECT 'fact' AS type, id, confidence, NULL::DOUBLE AS importance, ts FROM fcts UNION ALL SELECT 'cold', id, NULL, NULL, ts FROM coldm UNION ALL SELECT 'episode', id, NULL, importance, ts FROM eps",
    ),
    "a11_upserted_facts": (
        lambda s, d: R.latest(table(s, d, "facts", "id", "content", "confidence", "timestamp"), "id", "timestamp").select("id", "content", "timestamp"),
        "SELECT id, content, \"timestamp\" FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY \"timestamp\" DESC) AS rn FROM facts) WHERE rn = 1",
    ),
    "a13_delete_old": (
        lambda s, d: R.delete(L.episodes(s, d), L.episodes(s, d).filter(f"ts < {AS_OF} - 20 * 86400 AND importance < 0.5"), "id").select("id"),
        L.SQL + f"SELECT id FROM eps WHERE NOT coalesce(ts < {AS_OF} - 20 * 86400 AND importance < 0.5, false)",
    ),
    "a14_run_log": (
        lambda s, d: R.latest(L.runs(s, d).select("run_id", "status", "ts").unionByName(L.runs(s, d).select("run_id", F.lit("started").alias("status"), (F.col("ts") - 5).alias("ts"))), "run_id", "ts").groupBy("status").agg(F.count(F.lit(1)).alias("n")),
        L.SQL + "SELECT status, count(*) AS n FROM runs GROUP BY 1",
    ),
    "a19_cache_misses": (
        lambda s, d: R.cached_vectors(L.facts(s, d).select("id", F.col("content").alias("text")), L.cold(s, d).select(F.sha2(T.text("text"), 256).alias("key")).distinct().withColumn("vector", F.lit(0.0)))[1].select("id", "key"),
        L.SQL + "SELECT id, sha256(content) AS key FROM fcts WHERE sha256(content) NOT IN (SELECT sha256(coalesce(text, '')) FROM coldm)",
    ),
    "f3_vector_predicate": (
        lambda s, d: L.episodes(s, d).filter(f"project_id = 'atlas-notes' AND importance >= 0.3 AND ts >= {AS_OF} - 45 * 86400").select("id", "importance", "ts"),
        L.SQL + f"SELECT id, importance, ts FROM eps WHERE project_id = 'atlas-notes' AND importance >= 0.3 AND ts >= {AS_OF} - 45 * 86400",
    ),
    "f7_like_fallback": (
        lambda s, d: R.newest(L.cold(s, d).filter(F.contains(F.lower("text"), F.lit("retry queue"))), 25).select("id", "ts"),
        L.SQL + "SELECT id, ts FROM coldm WHERE contains(lower(text), 'retry queue') ORDER BY ts DESC, id LIMIT 25",
    ),
    "f9_char_limits": (
        lambda s, d: L.episodes(s, d).filter("length(text) >= 100").select("id", F.substring("text", 1, 160).alias("text")),
        L.SQL + "SELECT id, substr(text, 1, 160) AS text FROM eps WHERE length(text) >= 100",
    ),
    "f10_json_paths": (
        lambda s, d: L.cold(s, d).select("id", F.get_json_object("metadata_json", "$.archive_reason").alias("reason"), F.expr("try_cast(get_json_object(metadata_json, '$.importance') AS DOUBLE)").alias("importance")),
        L.SQL + "SELECT id, json_extract_string(metadata_json, '$.archive_reason') AS reason, try_cast(json_extract_string(metadata_json, '$.importance') AS DOUBLE) AS importance FROM coldm",
    ),
    "f12_first_text": (
        lambda s, d: table(s, d, "ingestion_decisions", "decision_id", "episode_text", "source_text").distinct().select("decision_id", T.first_nonempty(F.col("episode_text"), F.col("source_text"), F.lit("none")).alias("text")),
        "SELECT DISTINCT decision_id, coalesce(nullif(episode_text, ''), nullif(source_text, ''), 'none') AS text FROM (SELECT DISTINCT decision_id, episode_text, source_text FROM ingestion_decisions)",
    ),
    "g22_collection_stats": (
        _profile,
        L.SQL + "SELECT 'episodic' AS layer, count(*) AS n, count(DISTINCT project_id) AS projects, count(DISTINCT session_id) AS sessions, min(ts) AS first_ts, max(ts) AS last_ts FROM eps UNION ALL SELECT 'cold', count(*), count(DISTINCT project_id), count(DISTINCT session_id), min(ts), max(ts) FROM coldm",
    ),
    "g23_access_stats": (
        lambda s, d: table(s, d, "access_log").distinct().agg(F.count_distinct("episode_id").alias("episodes"), F.coalesce(F.sum("access_count"), F.lit(0)).alias("hits"), F.coalesce(F.max("access_count"), F.lit(0)).alias("most")),
        "SELECT count(DISTINCT episode_id) AS episodes, coalesce(sum(access_count), 0)::BIGINT AS hits, coalesce(max(access_count), 0) AS most FROM (SELECT DISTINCT * FROM access_log)",
    ),
    "g36_store_rate": (
        lambda s, d: table(s, d, "ingestion_decisions", "decision_id", "source", "should_store_episode").distinct().groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("should_store_episode").cast("double")).alias("rate")),
        "SELECT lower(trim(source)) AS source, count(*) AS n, avg(should_store_episode::INT) AS rate FROM (SELECT DISTINCT decision_id, source, should_store_episode FROM ingestion_decisions) GROUP BY 1",
    ),
    "g43_reasons": (
        lambda s, d: table(s, d, "ingestion_decisions", "decision_id", "reasons").distinct().select("decision_id", F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
        "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM (SELECT DISTINCT decision_id, reasons FROM ingestion_decisions)) GROUP BY 1",
    ),
    "j3_not_archived": (
        lambda s, d: L.episodes(s, d).join(L.cold(s, d).select("id"), "id", "left_anti").select("id"),
        L.SQL + "SELECT id FROM eps WHERE id NOT IN (SELECT id FROM coldm)",
    ),
    "j4_similar_exists": (
        lambda s, d: R.similar_exists(L.facts(s, d).select("id", "content"), L.facts(s, d).select("id", "content"), 0.9),
        L.SQL + f", t AS (SELECT id, list_distinct({tok('content')}) AS t FROM fcts) SELECT DISTINCT a.id FROM t a JOIN t b ON a.id <> b.id AND len(a.t) > 0 AND len(b.t) > 0 WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.9",
    ),
    "w6_best_per_user": (
        lambda s, d: R.best_per_group(L.facts(s, d).select("user_id", "confidence", "id"), "user_id", "confidence", "id"),
        L.SQL + "SELECT user_id, confidence, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, id) AS rn FROM fcts) WHERE rn = 1",
    ),
    "w7_keep_best": (
        lambda s, d: R.best_per_group(L.facts(s, d).select(F.lower("content").alias("text"), "confidence", "id"), "text", "confidence", "id"),
        L.SQL + "SELECT text, confidence, id FROM (SELECT lower(content) AS text, confidence, id, row_number() OVER (PARTITION BY lower(content) ORDER BY confidence DESC, id) AS rn FROM fcts) WHERE rn = 1",
    ),
    "v7_recent_episodes": (lambda s, d: R.newest(L.episodes(s, d), 50).select("id", "ts"), L.SQL + "SELECT id, ts FROM eps ORDER BY ts DESC, id LIMIT 50"),
    "x8_json_relations": (
        lambda s, d: R.relations_from_json(L.facts(s, d).select("id", F.concat(F.lit("Here:\n```json\n[{\"type\": \"uses\", \"subject\": \""), F.col("source"), F.lit("\", \"object\": \""), F.col("user_id"), F.lit("\", \"confidence\": "), F.col("confidence").cast("string"), F.lit("}]\n```")).alias("json")), ["USES", "FIXED"], 0.7),
        L.SQL + "SELECT id, 'USES' AS type, substr(source, 1, 160) AS subject, substr(user_id, 1, 80) AS object, confidence FROM fcts WHERE source IS NOT NULL AND user_id IS NOT NULL AND confidence >= 0.7",
    ),
    "x26_fit_prompt": (
        _fit,
        L.SQL + """, p AS (SELECT id, coalesce(text, '') AS u, coalesce(metadata, '') AS w, coalesce(session_id, '') || ' ' || coalesce(project_id, '') AS s, coalesce(text, '') || coalesce(metadata, '') AS e, coalesce(metadata, '') || coalesce(text, '') AS c, 'hint' AS n FROM eps),
        q AS (SELECT id, CASE WHEN length(u) // 4 > 150 THEN substr(u, 1, 603) ELSE u END AS u, w, s, e, c, n, length(w) // 4 AS tw, length(s) // 4 AS ts, length(e) // 4 AS te, length(c) // 4 AS tc, length(n) // 4 AS tn FROM p), r AS (SELECT *, greatest(32, 150 - length(u) // 4) AS x FROM q)
        SELECT id, length(u)::INT AS user, CASE WHEN tw + ts < x OR tw + ts + te <= x THEN length(w) WHEN ts < x THEN least(length(w), 4 * (x - ts) + 3) ELSE 0 END::INT AS working, CASE WHEN ts <= x THEN length(s) ELSE least(length(s), 4 * x + 3) END::INT AS semantic,
          CASE WHEN tw + ts + te <= x THEN length(e) WHEN tw + ts < x THEN least(length(e), 4 * (x - tw - ts) + 3) ELSE 0 END::INT AS episodic, CASE WHEN tw + ts + te + tc + tn <= x THEN length(c) ELSE 0 END::INT AS cold, CASE WHEN tw + ts + te + tn <= x THEN length(n) ELSE 0 END::INT AS neural FROM r""",
    ),
    "x27_without_memory": (
        lambda s, d: L.episodes(s, d).select("id", R.without_memory(_prompt()).alias("stripped"), R.without_memory(_prompt(), 80).alias("summarised")),
        L.SQL + rf""", p AS (SELECT id, {_PSQL} AS p, regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS core FROM eps)
        SELECT id, 'Sys' || chr(10) || chr(10) || chr(10) || chr(10) || 'User: hi' AS stripped, 'Sys' || chr(10) || chr(10) || 'Retrieved memory summary (minimized for cloud).' || chr(10) || CASE WHEN length(core) <= 80 THEN core ELSE substr(core, 1, 77) || '...' END || chr(10) || chr(10) || chr(10) || 'User: hi' AS summarised FROM p""",
    ),
    "x28_x29_answers": (
        lambda s, d: L.working(s, d).select("id", R.without_reasoning(F.concat(F.lit("<think>hm\n</think>\n"), "content")).alias("answer"), R.json_in_text(F.concat(F.lit("see ```json\n{\"id\": "), F.col("id").cast("string"), F.lit("}\n``` ok"))).alias("json")),
        L.SQL + r"""SELECT id, regexp_replace(content, '^\s+|\s+$', '', 'g') AS answer, '{"id": ' || id || '}' AS json FROM working""",
    ),
    "x31_summaries": (
        lambda s, d: L.runs(s, d).select("run_id", F.concat_ws("  ", F.concat(F.lit("[Strategy: "), "strategy", F.lit("]")), F.concat(F.lit("Q: "), F.col("task").cast("string")), F.concat(F.lit("A: "), "failure_mode")).alias("summary"), F.when(F.col("status") == "failed", 0.65).otherwise(0.35).alias("importance")),
        L.SQL + "SELECT run_id, concat_ws('  ', '[Strategy: ' || strategy || ']', 'Q: ' || task, 'A: ' || failure_mode) AS summary, CASE WHEN status = 'failed' THEN 0.65 ELSE 0.35 END::DOUBLE AS importance FROM runs",
    ),
}
