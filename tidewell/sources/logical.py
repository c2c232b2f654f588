"""The logical tables the operators work on, from the tables of a folder.

turns of working memory: one row per message, times in seconds, roles in lower case, tokens
estimated where unknown. episodes, facts and cold rows: repeated rows once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import table


def working(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("timestamp")
    return table(spark, d, "messages", "id", "session_id", "role", "content", "token_count", "timestamp").select(
        "id", "session_id", F.lower(F.trim(F.coalesce("role", F.lit("")))).alias("role"), T.text("content").alias("content"),
        F.coalesce("token_count", T.tokens_estimate(F.col("content")).cast("bigint")).alias("tokens"), F.when(t > 1e11, t / 1000).otherwise(t).alias("ts"),
    )


def episodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "episodes", "id", "text", "metadata", "session_id", "project_id", "importance", "timestamp").distinct().withColumnRenamed("timestamp", "ts")


def cold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cold_memories", "id", "text", "project_id", "session_id", "metadata_json", "content_hash", "timestamp").withColumnRenamed("timestamp", "ts")


def facts(spark: SparkSession, d: str) -> DataFrame:
    """The last writing of each fact."""
    f = table(spark, d, "facts", "id", "content", "confidence", "source", "metadata", "user_id", "timestamp")
    return f.groupBy("id").agg(F.max_by(F.struct("content", "confidence", "source", "user_id", F.col("timestamp").alias("ts")), "timestamp").alias("r")).select("id", "r.*")


def preferences(spark: SparkSession, d: str) -> DataFrame:
    """Facts that name their source, read as preferences of that category."""
    return facts(spark, d).filter("source IS NOT NULL").select(F.concat(F.lit("pref_"), "id").alias("id"), F.col("source").alias("category"), F.col("content").alias("value"), F.col("confidence").alias("strength"), "user_id", "ts")


def notes(spark: SparkSession, d: str, least: float = 0.8) -> DataFrame:
    """Important episodes, read as semantic events."""
    return episodes(spark, d).filter(F.col("importance") >= least).select(F.concat(F.lit("evt_"), "id").alias("id"), F.col("text").alias("summary"), F.lit("").alias("detail"), "importance", "ts")


def runs(spark: SparkSession, d: str) -> DataFrame:
    """A run log made from events: strategy, status, failure, duration, user."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    return e.select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("task"), F.col("event_type").alias("strategy"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("failure_mode"), F.col("value").alias("duration"), F.get_json_object("props", "$.k").cast("bigint").alias("candidates"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6).alias("ts"),
    )


#: The same tables in SQL, as common table expressions.
SQL = """
WITH working AS (
  SELECT id, session_id, lower(trim(coalesce(role, ''))) AS role, coalesce(content, '') AS content,
    coalesce(token_count, length(coalesce(content, '')) // 4) AS tokens, CASE WHEN "timestamp" > 1e11 THEN "timestamp" / 1000 ELSE "timestamp" END AS ts FROM messages
), eps AS (
  SELECT DISTINCT id, text, metadata, session_id, project_id, importance, "timestamp" AS ts FROM episodes
), coldm AS (
  SELECT id, text, project_id, session_id, metadata_json, content_hash, "timestamp" AS ts FROM cold_memories
), fcts AS (
  SELECT id, content, confidence, source, user_id, "timestamp" AS ts FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "timestamp" DESC) AS rn FROM facts) WHERE rn = 1
), prefs AS (
  SELECT 'pref_' || id AS id, source AS category, content AS value, confidence AS strength, user_id, ts FROM fcts WHERE source IS NOT NULL
), notes AS (
  SELECT 'evt_' || id AS id, text AS summary, '' AS detail, importance, ts FROM eps WHERE importance >= 0.8
), runs AS (
  SELECT event_id AS run_id, user_id AS task, event_type AS strategy, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status,
    CASE WHEN event_type = 'error' THEN 'k' || json_extract_string(props, '$.k') END AS failure_mode, value AS duration, json_extract_string(props, '$.k')::BIGINT AS candidates, epoch_us(ts) / 1e6 AS ts FROM events
)
"""
