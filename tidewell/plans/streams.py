"""Batch forms of the streaming operators: the same plans over whole tables."""

from pyspark.sql import functions as F

from ..sources import logical as L
from ..sources.tables import table
from ..streaming import bus, neural


def _events(s, d):
    # times are UTC in the file; a session in another zone must not shift the windows
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(s, d, "events", "event_id", "user_id", "event_type", "value", "ts").withColumn("ts", F.timestamp_micros(micros))


def _seconds(c):
    return (F.unix_micros(c) / 1e6).alias(c)


def _tumbling(s, d):
    return bus.tumbling(_events(s, d)).select(_seconds("start"), "event_type", "events", F.round("mean", 6).alias("mean"))


def _sessions(s, d):
    return bus.sessions(_events(s, d)).select("user_id", _seconds("start"), F.round(F.unix_micros("stop") / 1e6, 6).alias("stop"), "events")


def _surprise(s, d):
    t = L.working(s, d)
    r = F.when(F.col("role").isin("human", "user"), "user").when(F.col("role").isin("ai", "bot", "model", "assistant"), "assistant").otherwise(F.col("role"))
    return neural.surprises(t.withColumn("role", r), "session_id")


QUERIES = {
    "r_tumbling": (_tumbling, "SELECT epoch(date_trunc('hour', ts))::DOUBLE AS start, event_type, count(*) AS events, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2"),
    "r10_sessions": (
        _sessions,
        """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events),
        y AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM x) SELECT user_id, min(epoch_us(ts)) / 1e6 AS start, round((max(epoch_us(ts)) + 1800000000) / 1e6, 6) AS stop, count(*) AS events FROM y GROUP BY user_id, g""",
    ),
    "r3_surprises": (_surprise, None),
}
