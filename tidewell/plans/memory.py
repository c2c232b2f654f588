"""Queries of working memory, search, vectors and retention."""

from pyspark.sql import functions as F

from ..operators import lexical, lifecycle, vectors, working
from ..sources import logical as L
from ..sources.tables import table
from .kernels import AS_OF, longs

QUERY_TEXTS = ["worker pool error", "retry queue times out", "preferred language", "what did we decide about the session store", "photo sorter rows", "le planificateur et le cache local", "", "?!"]


def queries_df(s):
    return s.createDataFrame(list(enumerate(QUERY_TEXTS)), "query_id bigint, query string")


QSQL = ", q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(QUERY_TEXTS)) + ") AS v(query_id, query))"


def bm25_sql(src, text):
    return f""", tok AS (SELECT id, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9_]+')) AS term, len(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9_]+')) AS dl FROM {src}),
    post AS (SELECT term, id, dl, count(*) AS tf FROM tok GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    size AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9_]+'))) AS mean FROM {src}),
    qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9_]+')) AS term FROM q),
    bm AS (SELECT query_id, id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS bm25 FROM post JOIN dfs USING (term) JOIN qt USING (term) CROSS JOIN size GROUP BY 1, 2)"""


def _vec(s, d):
    return table(s, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


_COS = """, v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), sims AS (SELECT a.id AS query_id, b.id AS id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 9) AS similarity FROM v a JOIN v b ON a.id <> b.id {on})"""

_SCORE = f""", acc AS (SELECT episode_id, sum(access_count) AS hits, min(first_accessed) AS first_accessed, max(last_accessed) AS last_accessed FROM (SELECT DISTINCT * FROM access_log) WHERE episode_id IS NOT NULL GROUP BY 1),
e0 AS (SELECT id, project_id, text, metadata, ts, coalesce(importance, 0.5) AS importance, coalesce(hits, 0)::BIGINT AS hits, greatest(0.0, ({AS_OF} - ts) / 86400.0) AS a FROM eps LEFT JOIN acc ON acc.episode_id = eps.id),
e1 AS (SELECT *, max(hits) OVER (PARTITION BY project_id) AS most, coalesce(try_cast(json_extract_string(metadata, '$.neural_surprise') AS DOUBLE), 0.0) AS sur FROM e0),
sc AS (SELECT id, project_id, text, importance, ts, round(a, 9) AS age_days, hits, round(0.35 * exp(-ln(2) / 30.0 * a) + 0.30 * least(1.0, greatest(0.0, importance)) + 0.25 * CASE WHEN hits > 0 THEN ln(1 + hits) / ln(1 + greatest(most, 1)) WHEN a < 7 THEN 0.3 ELSE 0.0 END + 0.10 * least(1.0, greatest(0.0, sur)), 9) AS score FROM e1)"""

_RECENT = "row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC)"

QUERIES = {
    "w1_evicted": (
        lambda s, d: working.evicted(L.working(s, d), 300).select("id", "session_id", "tokens"),
        L.SQL + ", x AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) - tokens AS before, sum(tokens) OVER (PARTITION BY session_id) AS total FROM working) SELECT id, session_id, tokens FROM x WHERE total > 300 AND before < total - 300",
    ),
    "w2_context_window": (
        lambda s, d: working.context_window(L.working(s, d), 400, False).select("session_id", "id", "role", "tokens", "rank", "used"),
        L.SQL + f", x AS (SELECT *, {_RECENT}::INT AS rank FROM working WHERE role <> 'system'), y AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM x WHERE rank <= 532) SELECT session_id, id, role, tokens, rank, used FROM y WHERE used <= 400",
    ),
    "w3_recent": (lambda s, d: working.recent(L.working(s, d), 5).select("session_id", "id", "rank"), L.SQL + f", x AS (SELECT *, {_RECENT}::INT AS rank FROM working) SELECT session_id, id, rank FROM x WHERE rank <= 5"),
    "w4_paired": (
        lambda s, d: working.with_question(L.working(s, d)),
        L.SQL + ", x AS (SELECT *, lag(role) OVER w AS pr, lag(content) OVER w AS pc FROM working WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)) SELECT id, session_id, 'User: ' || pc || chr(10) || 'Assistant: ' || content AS paired FROM x WHERE role = 'assistant' AND pr = 'user'",
    ),
    "g20_session_stats": (
        lambda s, d: working.session_stats(L.working(s, d), 1000),
        L.SQL + "SELECT session_id, count(*) AS messages, coalesce(sum(tokens), 0)::BIGINT AS tokens, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT role) AS roles, coalesce(sum(tokens), 0) / 1000 AS utilization, max(ts) - min(ts) AS duration FROM working GROUP BY 1",
    ),
    "g21_counts": (lambda s, d: L.working(s, d).groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.sum("tokens").alias("tokens")), L.SQL + "SELECT role, count(*) AS messages, sum(tokens)::BIGINT AS tokens FROM working GROUP BY 1"),
    "f1_f8_isolation": (
        lambda s, d: L.working(s, d).filter("session_id = 'sess-main-console' AND role NOT IN ('system', 'tool')").select("id", "role", "ts"),
        L.SQL + "SELECT id, role, ts FROM working WHERE session_id = 'sess-main-console' AND role NOT IN ('system', 'tool')",
    ),
    "f2_search": (lambda s, d: working.search(L.working(s, d), "Worker Pool", 50, "user").select("id", "ts"), L.SQL + "SELECT id, ts FROM working WHERE content ILIKE '%Worker Pool%' AND role = 'user' ORDER BY ts DESC, id DESC LIMIT 50"),
    "x14_bm25": (
        lambda s, d: lexical.top(lexical.bm25(L.cold(s, d), queries_df(s)).withColumn("bm25", F.round("bm25", 9)), 20, "bm25").select("query_id", "id", "rank", F.round("bm25", 6).alias("bm25")),
        L.SQL + QSQL + bm25_sql("coldm", "text") + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id)::INT AS rank FROM bm) SELECT query_id::BIGINT AS query_id, id, rank, round(bm25, 6) AS bm25 FROM r WHERE rank <= 20",
    ),
    "x15_retrieve_cold": (
        lambda s, d: lexical.retrieve_cold(L.cold(s, d), queries_df(s), AS_OF).select("query_id", "id", "rank", F.round("score", 6).alias("score")),
        L.SQL + QSQL + bm25_sql("coldm", "text")
        + f""", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rk FROM bm), c AS (SELECT query_id, id, round(1.0 + 0.35 * pow(0.5, greatest(0.0, ({AS_OF} - ts) / 86400.0) / 30.0) + 0.20 * least(1.0, greatest(0.0, coalesce(nullif(try_cast(json_extract_string(metadata_json, '$.importance') AS DOUBLE), 0), 0.5))), 9) AS score FROM r JOIN coldm USING (id) WHERE rk <= 100),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM c) SELECT query_id::BIGINT AS query_id, id, rank, round(score, 6) AS score FROM t WHERE rank <= 10""",
    ),
    "x16_semantic_live": (
        lambda s, d: lexical.semantic_live(L.facts(s, d), queries_df(s)).select("query_id", "id", "rank", F.round("score", 6).alias("score")),
        L.SQL + QSQL + bm25_sql("fcts", "content")
        + f""", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rk FROM bm), b AS (SELECT *, max(bm25) OVER (PARTITION BY query_id) AS top FROM r WHERE rk <= 20),
        c AS (SELECT query_id, id, bm25, top, list_distinct({longs('query')}) AS qs, list_distinct({longs('content')}) AS cs FROM b JOIN fcts USING (id) JOIN q USING (query_id)),
        t AS (SELECT query_id, id, round(least(1.0, 0.6 * bm25 / top + 0.4 * CASE WHEN len(qs) > 0 AND len(cs) > 0 THEN len(list_intersect(qs, cs)) / len(qs) ELSE 0 END), 9) AS score FROM c),
        u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM t) SELECT query_id::BIGINT AS query_id, id, rank, round(score, 6) AS score FROM u WHERE rank <= 8""",
    ),
    "f6_contains_any": (
        lambda s, d: lexical.contains_any(L.facts(s, d), queries_df(s), "content", 15).select("query_id", "id", "rank", F.round("score", 6).alias("score")),
        L.SQL + QSQL
        + f""", z AS (SELECT query_id, list_distinct({longs('query')}) AS qs FROM q), c AS (SELECT query_id, id, qs, list_distinct({longs('content')}) AS cs, content FROM z JOIN fcts ON len(list_filter(qs, lambda w: contains(lower(content), w))) > 0),
        t AS (SELECT query_id, id, round(least(1.0, 0.7 * len(list_intersect(qs, cs)) / len(qs) + 0.3 * len(list_intersect(qs, cs)) / greatest(1, len(cs))), 9) AS score FROM c WHERE len(list_intersect(qs, cs)) > 0),
        u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM t) SELECT query_id::BIGINT AS query_id, id, rank, round(score, 6) AS score FROM u WHERE rank <= 15""",
    ),
    "v1_nearest": (
        lambda s, d: vectors.nearest(_vec(s, d), _vec(s, d).filter("id % 50 = 0"), 10).select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity")),
        L.SQL + _COS.format(on="AND a.id % 50 = 0") + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM sims) SELECT query_id, id, rank, round(similarity, 6) AS similarity FROM r WHERE rank <= 10",
    ),
    "v1_nearest_indexed": (lambda s, d: vectors.nearest_indexed(_vec(s, d), _vec(s, d).filter("id % 50 = 0"), 10), None),
    "v2_similar": (
        lambda s, d: vectors.nearest(_vec(s, d), _vec(s, d).filter("id % 50 = 0"), 5, 0.3).select("query_id", "id", "rank"),
        L.SQL + _COS.format(on="AND a.id % 50 = 0") + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM sims WHERE similarity >= 0.3) SELECT query_id, id, rank FROM r WHERE rank <= 5",
    ),
    "v3_superseded": (
        lambda s, d: vectors.superseded(_vec(s, d), 0.4),
        L.SQL + _COS.format(on="AND b.id < a.id") + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims WHERE similarity >= 0.4) SELECT DISTINCT id FROM r WHERE rank <= 5",
    ),
    "v4_projected": (lambda s, d: vectors.projected(_vec(s, d), 16), None),
    "l2_retention": (lambda s, d: lifecycle.scored(L.episodes(s, d), table(s, d, "access_log"), AS_OF).drop("text"), L.SQL + _SCORE + "SELECT id, project_id, importance, ts, age_days, hits, score FROM sc"),
    "l3_forget": (
        lambda s, d: lifecycle.archive_rows(lifecycle.to_forget(lifecycle.scored(L.episodes(s, d), table(s, d, "access_log"), AS_OF), 0.4), "forgetting_policy"),
        L.SQL + _SCORE + "SELECT id, project_id, text, ts, importance, 'forgetting_policy' AS reason, sha256(coalesce(project_id, '') || ':' || coalesce(text, '')) AS content_hash FROM sc WHERE score < 0.4 AND age_days >= 7 ORDER BY score, id LIMIT 100",
    ),
    "g24_access": (lambda s, d: lifecycle.access(table(s, d, "access_log")), L.SQL + _SCORE + "SELECT episode_id, hits::BIGINT AS hits, first_accessed, last_accessed FROM acc"),
    "g25_distribution": (
        lambda s, d: lifecycle.distribution(lifecycle.scored(L.episodes(s, d), table(s, d, "access_log"), AS_OF)),
        L.SQL + _SCORE + "SELECT count(*) AS count, round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(score), 6) AS mean, list_sort(list(score))[count(*) // 2 + 1] AS upper_median, sum((score < 0.3)::INT)::BIGINT AS below_03, sum((score < 0.5)::INT)::BIGINT AS below_05 FROM sc",
    ),
    "a12_archive_new": (
        lambda s, d: lifecycle.new_to_archive(L.episodes(s, d), L.cold(s, d)).select("id", "project_id", "hash"),
        L.SQL + ", b AS (SELECT *, sha256(coalesce(text, '')) AS hash FROM eps), k AS (SELECT *, CASE WHEN project_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY project_id, hash ORDER BY ts, id) END AS rn FROM b) SELECT id, project_id, hash FROM k WHERE rn = 1 AND id NOT IN (SELECT id FROM coldm) AND NOT EXISTS (SELECT 1 FROM coldm c WHERE c.project_id = k.project_id AND sha256(coalesce(c.text, '')) = k.hash)",
    ),
    "l5_promotions": (
        lambda s, d: lifecycle.promotions(L.episodes(s, d), 0.6).select("digest", "kind", "id", "weight"),
        L.SQL + r""", e AS (SELECT *, sha256(regexp_replace(lower(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')) AS digest FROM eps WHERE importance >= 0.6),
        u AS (SELECT digest, 'event' AS kind, id, ts, greatest(0.5, importance) AS weight FROM e UNION ALL SELECT digest, 'fact', id, ts, least(0.95, greatest(0.55, importance)) FROM e WHERE regexp_matches(lower(text), 'i use |i prefer |we decided|the plan is|remember that')),
        r AS (SELECT *, row_number() OVER (PARTITION BY digest, kind ORDER BY ts, id) AS rn FROM u) SELECT digest, kind, id, weight FROM r WHERE rn = 1""",
    ),
}
