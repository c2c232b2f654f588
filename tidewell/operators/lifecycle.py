"""Retention: access counts, scores, what to archive and what to promote.

Plans are returned as DataFrames and written by nobody here. `as_of` is the time in seconds.
Null importance is .5, unknown use is none; ids are compared as given; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from . import reporting, skew


def access(log: DataFrame) -> DataFrame:
    """Per episode id: hits, first and last access. Rows repeated under one log_id count once."""
    once = log.select("log_id", "episode_id", "access_count", "first_accessed", "last_accessed").distinct()
    return once.filter("episode_id IS NOT NULL").groupBy("episode_id").agg(F.sum("access_count").alias("hits"), F.min("first_accessed").alias("first_accessed"), F.max("last_accessed").alias("last_accessed"))


def scored(episodes: DataFrame, log: DataFrame, as_of: float) -> DataFrame:
    """id, project_id, importance, ts, age_days, hits, score (9 decimals) of every episode."""
    a = access(log).select(F.col("episode_id").alias("id"), "hits")
    e = skew.lookup(episodes.select("id", "project_id", "text", "ts", "metadata", F.coalesce("importance", F.lit(0.5)).alias("importance")), a, "id").withColumn("hits", F.coalesce("hits", F.lit(0)))
    # the most hits of a project, pre-aggregated; rows of a hot project meet it spread over tasks
    e = e.withColumn("_p", F.coalesce("project_id", F.lit("\x00")))
    e = skew.lookup(e, e.groupBy("_p").agg(F.max("hits").alias("_most")), "_p")
    age = S.age_days(as_of, F.col("ts"))
    surprise = F.expr("try_cast(get_json_object(metadata, '$.neural_surprise') AS DOUBLE)")
    score = S.retention(age, F.col("importance"), F.col("hits"), F.col("_most"), surprise)
    return e.select("id", "project_id", "text", "importance", "ts", F.round(age, 9).alias("age_days"), "hits", F.round(score, 9).alias("score"))


def to_forget(score: DataFrame, below: float = 0.3, min_age_days: float = 7.0, most: int = 100) -> DataFrame:
    """The `most` episodes with the lowest scores below the threshold, old enough."""
    return score.filter((F.col("score") < below) & (F.col("age_days") >= min_age_days)).orderBy("score", "id").limit(most)


def archive_rows(score: DataFrame, reason: str) -> DataFrame:
    """What forgetting writes to the archive."""
    return score.select("id", "project_id", "text", "ts", F.col("importance"), F.lit(reason).alias("reason"), T.digest(F.concat(F.coalesce("project_id", F.lit("")), F.lit(":"), T.text("text"))).alias("content_hash"))


def new_to_archive(batch: DataFrame, archive: DataFrame) -> DataFrame:
    """Insert-or-ignore: the first row of each id and of each (project, hash) that the archive
    lacks; rows without a project are never duplicates by hash. batch: id, project_id, text, ts."""
    h = F.sha2(T.text("text"), 256)
    b = batch.select("id", "project_id", "text", "ts", h.alias("hash")).groupBy("id").agg(F.min_by(F.struct("project_id", "text", "ts", "hash"), F.struct("ts", "hash")).alias("r")).select("id", "r.*")
    keyed = b.filter("project_id IS NOT NULL").groupBy("project_id", "hash").agg(F.min_by(F.struct("id", "text", "ts"), F.struct("ts", "id")).alias("r")).select("r.id", "project_id", "r.text", "r.ts", "hash")
    x = keyed.unionByName(b.filter("project_id IS NULL"))
    seen = archive.select("id")
    same = archive.filter("project_id IS NOT NULL").select("project_id", h.alias("hash")).distinct()
    return x.join(seen, "id", "left_anti").join(same, ["project_id", "hash"], "left_anti")


def distribution(score: DataFrame) -> DataFrame:
    """Rows, range, mean, upper median and rows below .3 and .5 of a score."""
    n = F.count("score")
    stats = score.agg(n.alias("count"), F.min("score").alias("min"), F.max("score").alias("max"), F.avg("score").alias("mean"), F.sum((F.col("score") < 0.3).cast("int")).alias("below_03"), F.sum((F.col("score") < 0.5).cast("int")).alias("below_05"))
    # the upper median is the element at n // 2
    mid = reporting.order_statistics(score, "score", {"upper_median": F.floor(F.col("n") / 2)}).select("upper_median")
    return stats.join(F.broadcast(mid), F.lit(True), "left").select("count", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), F.round("mean", 6).alias("mean"), "upper_median", "below_03", "below_05")


def promotions(episodes: DataFrame, least: float = 0.8) -> DataFrame:
    """Important episodes as events, and as facts where they read like one: one row per digest and kind."""
    e = episodes.filter(F.col("importance") >= least).select("id", "ts", "text", "importance", F.sha2(T.normal(F.col("text")), 256).alias("digest"))
    events = e.select("id", "ts", "digest", F.lit("event").alias("kind"), T.summary(F.col("text"), 36).alias("summary"), F.greatest(F.lit(0.5), F.col("importance")).alias("weight"))
    facts = e.filter(T.looks_like_fact(F.col("text"))).select("id", "ts", "digest", F.lit("fact").alias("kind"), T.summary(F.col("text"), 28).alias("summary"), F.least(F.lit(0.95), F.greatest(F.lit(0.55), F.col("importance"))).alias("weight"))
    u = events.unionByName(facts)
    return u.groupBy("digest", "kind").agg(F.min_by(F.struct("id", "summary", "weight"), F.struct("ts", "id")).alias("r")).select("digest", "kind", "r.*")


def actions(episodes: DataFrame, as_of: float, promote: float = 0.8, old_days: float = 45.0, dull: float = 0.55) -> DataFrame:
    """id, action: promote what is important, archive what is old and dull, keep the rest."""
    x = episodes.select("id", S.age_days(as_of, F.col("ts")).alias("age"), F.coalesce("importance", F.lit(0.5)).alias("importance"))
    return x.select("id", F.when(F.col("importance") >= promote, "promote").when((F.col("age") >= old_days) & (F.col("importance") <= dull), "archive").otherwise("keep").alias("action"))
