"""Queries of the training-text operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..sources.tables import table
from . import answers, conversations, leaks, mixing, neardup, personal, subjects, truncation


def _messages(s, d):
    return table(s, d, "messages", "id", "session_id", "role", "content", "metadata", "timestamp")


def _texts(s, d):
    """id and text of episodes, cold_memories and facts taken together."""
    return (
        table(s, d, "episodes", "id", "text")
        .unionByName(table(s, d, "cold_memories", "id", "text"))
        .unionByName(table(s, d, "facts", "id", F.col("content").alias("text")))
    )


def _subject_tables(s, d):
    return table(s, d, "documents", "doc_id", "page_id", "namespace", "text"), table(s, d, "subject_labels"), table(s, d, "subjects")


def _cut_tables(s, d):
    return table(s, d, "episodes", "id", "text", "metadata"), table(s, d, "ingestion_decisions", "decision_id", "source", "episode_text", "source_text")


def _pair_tables(s, d):
    return table(s, d, "messages", "id", "session_id", "role", "content", "timestamp"), table(s, d, "turns", "turn_id", "session_id", "role", "content", "timestamp")


def _free_text(s, d):
    return personal.records(table(s, d, "messages", "id", "content"), table(s, d, "cold_memories", "id", "text"), table(s, d, "facts", "id", "content"), table(s, d, "episodes", "id", "text"))


def _mix_tables(s, d):
    return table(s, d, "documents", "doc_id", "source", "text"), table(s, d, "mix_targets")


_INVISIBLE = r"[\s\p{Z}\p{C}\x{115f}\x{1160}\x{2800}\x{3164}]+"
_P1 = rf"""
WITH a AS (
  SELECT session_id, id, content, regexp_replace(coalesce(content, ''), '^{_INVISIBLE}|{_INVISIBLE}$', '', 'g') AS c, lower(regexp_replace(coalesce(role, ''), '^{_INVISIBLE}|{_INVISIBLE}$', '', 'g')) AS r,
    CASE WHEN "timestamp" > 1e11 THEN "timestamp" / 1000 ELSE "timestamp" END AS ts, try_cast(json_extract_string(metadata, '$.turn') AS BIGINT) AS turn FROM messages
), b AS (
  SELECT *, NOT (c = '' OR regexp_matches(c, '^[\p{{Pd}}_.·•…*~/\\\s?]+$') AND NOT regexp_matches(c, '^\s*\?+\s*$') OR lower(c) IN ({", ".join("'" + w + "'" for w in conversations.NOTHING)})) AS said,
    CASE {" ".join(f"WHEN r IN ({', '.join(repr(x) for x in w)}) THEN '{n}'" for n, w in conversations.ROLES.items())} END AS sp FROM a
), b2 AS (
  SELECT *, id = min(id) OVER (PARTITION BY session_id, sp, ts, content) AS once FROM b
), s AS (
  SELECT session_id, count(*) AS rows, coalesce(bool_or(said AND sp IN ('user', 'assistant')), false) AS any_said, coalesce(bool_or(said AND sp IS NULL), false) AS stranger, coalesce(bool_or(NOT said AND sp = 'assistant'), false) AS blank_reply,
    arg_min(sp, (ts, id)) FILTER (once AND said AND sp IN ('user', 'assistant')) AS first, arg_max(sp, (ts, id)) FILTER (once AND said AND sp IN ('user', 'assistant')) AS last,
    count(DISTINCT turn) AS n, min(turn) AS lo, max(turn) AS hi FROM b2 GROUP BY 1
), v AS (
  SELECT session_id, rows, CASE WHEN session_id IS NULL THEN 'no session' WHEN NOT any_said THEN 'empty' WHEN stranger THEN 'unknown speaker' WHEN blank_reply THEN 'blank reply' WHEN first <> 'user' THEN 'no opening' WHEN last <> 'assistant' THEN 'no reply' WHEN n > 0 AND (lo <> 0 OR hi - lo + 1 <> n) THEN 'rows missing' END AS reason FROM s
)
"""
_P1_TURNS = _P1.rstrip() + """, gp AS (
  SELECT 4 * quantile_disc(g, 0.99) AS longest FROM (SELECT ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, id) AS g FROM b WHERE ts IS NOT NULL)
), k AS (
  SELECT b2.*, lag(sp) OVER w AS psp, lag(ts) OVER w AS pts FROM b2 JOIN v USING (session_id) WHERE reason IS NULL AND once AND said AND sp IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)
), j AS (
  SELECT *, coalesce(ts - pts > (SELECT longest FROM gp), false) AS gap FROM k
), n AS (
  SELECT *, sum(gap::INT) OVER w AS segment, sum((psp IS NULL OR psp <> sp OR gap)::INT) OVER w - 1 AS tn FROM j WINDOW w AS (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)
) SELECT session_id, segment::BIGINT AS segment, tn::BIGINT AS turn, sp AS speaker, min(ts) AS seconds, count(*) AS rows, string_agg(content, chr(10) ORDER BY ts, id) AS content FROM n GROUP BY 1, 2, 3, 4
"""
_P4 = r"""
WITH r AS (SELECT row_number() OVER () AS k, id, text FROM (SELECT id, text FROM episodes UNION SELECT id, text FROM cold_memories UNION SELECT id, content FROM facts) WHERE id IS NOT NULL AND text IS NOT NULL),
c AS (SELECT k, id, w, count(*) AS c FROM (SELECT k, id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM r) GROUP BY ALL), n AS (SELECT k, sum(c) AS n FROM c GROUP BY 1),
p AS (SELECT a.k AS ka, b.k AS kb, a.id AS id_a, b.id AS id_b, sum(least(a.c, b.c)) AS s FROM c a JOIN c b ON a.w = b.w AND a.id < b.id GROUP BY ALL)
SELECT DISTINCT id_a, id_b FROM p JOIN n x ON x.k = ka JOIN n y ON y.k = kb WHERE s / (x.n + y.n - s) >= 0.8
"""

_P4_GROUPS = r"""
WITH RECURSIVE r AS (SELECT row_number() OVER () AS k, id, text FROM (SELECT id, text FROM episodes UNION SELECT id, text FROM cold_memories UNION SELECT id, content FROM facts) WHERE id IS NOT NULL AND text IS NOT NULL),
t AS (SELECT k, id, list_sort(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS bag FROM r), u AS (SELECT * FROM t WHERE len(bag) > 0),
cls AS (SELECT bag, row_number() OVER () AS cls FROM (SELECT DISTINCT bag FROM u)), m AS (SELECT DISTINCT id, cls FROM u JOIN cls USING (bag)),
c AS (SELECT cls, w, count(*) AS c FROM (SELECT cls, unnest(bag) AS w FROM cls) GROUP BY ALL), n AS (SELECT cls, sum(c) AS n FROM c GROUP BY 1),
p AS (SELECT a.cls AS x, b.cls AS y, sum(least(a.c, b.c)) AS s FROM c a JOIN c b ON a.w = b.w AND a.cls <> b.cls GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.cls = x JOIN n b ON b.cls = y WHERE s / (a.n + b.n - s) >= 0.8),
e AS (SELECT a.id AS x, b.id AS y FROM l JOIN m a ON a.cls = x JOIN m b ON b.cls = y UNION SELECT a.id, b.id FROM m a JOIN m b USING (cls)),
g AS (SELECT x AS id, y FROM e UNION SELECT g.id, e.y FROM g JOIN e ON e.x = g.y),
deg AS (SELECT x AS cls, count(*) AS links FROM l GROUP BY 1), cop AS (SELECT cls, count(*) AS copies FROM m GROUP BY 1)
SELECT m.id, min(q.group_id) AS group_id, max(copies)::BIGINT AS copies, max(coalesce(links, 0))::BIGINT AS links
FROM m JOIN (SELECT id, min(y) AS group_id FROM g GROUP BY 1) q ON q.id = m.id JOIN cop USING (cls) LEFT JOIN deg USING (cls) GROUP BY 1
"""

QUERIES: dict[str, tuple[Callable, str | None]] = {
    "p1_found": (lambda s, d: conversations.found(_messages(s, d)), _P1 + "SELECT DISTINCT session_id FROM v WHERE reason IS NOT NULL"),
    "p1_conversations": (lambda s, d: conversations.conversations(_messages(s, d)), _P1_TURNS),
    "p1_report": (lambda s, d: conversations.report(_messages(s, d)), _P1 + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS sessions, sum(rows)::BIGINT AS rows FROM v GROUP BY 1"),
    "p2_found": (lambda s, d: truncation.found(*_cut_tables(s, d)), None),
    "p2_report": (lambda s, d: truncation.report(*_cut_tables(s, d)), None),
    "p4_found": (lambda s, d: neardup.similar_pairs(_texts(s, d)), _P4),
    "p5_found": (lambda s, d: answers.found(*_pair_tables(s, d)), None),
    "p5_report": (lambda s, d: answers.report(*_pair_tables(s, d)), None),
    "p6_found": (lambda s, d: personal.found(_free_text(s, d)), None),
    "p6_redacted": (lambda s, d: personal.redact(_free_text(s, d)), None),
    "p7_found": (lambda s, d: leaks.found(table(s, d, "documents", "doc_id", "text"), table(s, d, "eval_items", "item_id", "text")), None),
    "p7_report": (lambda s, d: leaks.report(table(s, d, "documents", "doc_id", "text"), table(s, d, "eval_items", "item_id", "text")), None),
    "p8_mix": (lambda s, d: mixing.mix(*_mix_tables(s, d)), None),
    "p8_report": (lambda s, d: mixing.report(*_mix_tables(s, d)), None),
    "p9_found": (lambda s, d: subjects.found(*_subject_tables(s, d)), None),
    "p9_composition": (lambda s, d: subjects.composition(*_subject_tables(s, d)), None),
    "p4_groups": (lambda s, d: neardup.groups(_texts(s, d)), _P4_GROUPS),
}


def queries() -> dict[str, Callable]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
