"""Queries about references to records that do not exist."""

from ..operators import orphans
from ..sources.tables import table


def _tables(spark, d):
    return (
        table(spark, d, "access_log", "log_id", "episode_id", "first_accessed"),
        table(spark, d, "episodes", "id", "timestamp"),
        table(spark, d, "cold_memories", "id"),
    )


_STATES = r"""
WITH k AS (
  SELECT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS k, min("timestamp") AS born FROM episodes GROUP BY 1
), c AS (
  SELECT DISTINCT lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS k FROM cold_memories
), a AS (
  SELECT DISTINCT log_id, lower(regexp_replace(episode_id, '^\s+|\s+$', '', 'g')) AS k, first_accessed AS seen FROM access_log
), s AS (
  SELECT log_id, a.k AS ref, seen,
    CASE WHEN k.k IS NULL AND c.k IS NULL THEN 'missing' WHEN k.k IS NULL THEN 'deleted' WHEN born > seen THEN 'late' ELSE 'ok' END AS state
  FROM a LEFT JOIN k ON k.k = a.k LEFT JOIN c ON c.k = a.k WHERE a.k <> ''
)
"""

QUERIES = {
    "p3_found": (lambda s, d: orphans.found(*_tables(s, d)), _STATES + "SELECT DISTINCT log_id, state FROM s WHERE state <> 'ok'"),
    "p3_report": (
        lambda s, d: orphans.report(*_tables(s, d)),
        _STATES
        + "SELECT 'access_log' AS table_name, strftime(make_timestamp((seen * 1e6)::BIGINT), '%Y-%m') AS month, state, count(*) AS refs, count(DISTINCT ref) AS keys FROM s GROUP BY 2, 3",
    ),
}
