"""The write path in batch form: what a write adds, removes and reports.

Every function returns DataFrames and writes nothing; `streaming.bus` and `sources.jsonl` are the
sinks. Null texts are blank; ties go by id; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import lifecycle, records, working


def page(rows: DataFrame, number: int, size: int = 500, after: float = 0.0, ts: str = "ts", key: str = "id") -> DataFrame:
    """Page `number` (from 0) of the rows younger than `after`, oldest first."""
    return rows.filter(F.col(ts) > after).orderBy(ts, key).offset(number * size).limit(size)


def append(turns: DataFrame, new: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """(kept, evicted) after new turns are appended: tokens are counted where they are missing, then the
    oldest turns of a session go until it fits the budget."""
    cols = ["id", "session_id", "role", "content", "tokens", "ts"]
    counted = new.withColumn("tokens", F.coalesce("tokens", T.tokens_estimate(F.col("content")).cast("bigint")))
    every = turns.select(*cols).unionByName(counted.select(*cols))
    gone = working.evicted(every, budget).select("session_id", "id")
    return every.join(gone, ["session_id", "id"], "left_anti"), gone


def new_episodes(texts: DataFrame) -> DataFrame:
    """Rows of episodes out of texts(text, session_id, project_id, importance, ts): blank texts are
    refused; the id is a digest of what is stored, so a write done twice is one row."""
    t = texts.filter(F.regexp_replace(T.text("text"), r"\s+", "") != "")
    full = t.select("text", F.coalesce("session_id", F.lit("unknown")).alias("session_id"), F.coalesce("project_id", F.lit("default")).alias("project_id"), F.coalesce("importance", F.lit(0.5)).alias("importance"), "ts")
    key = F.concat_ws("\x00", "text", "session_id", "project_id", F.coalesce(F.col("ts").cast("decimal(20,3)").cast("string"), F.lit("")))
    return full.withColumn("id", F.concat(F.lit("ep_"), T.digest(key, 16))).dropDuplicates(["id"])


def store(new: DataFrame, episodes: DataFrame, floor: float = 0.0, surprising: DataFrame | None = None, similar: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(inserted, superseded ids): new episodes that pass the filter (`surprising`: id; none given means
    all do) and the floor of importance. Of equal texts the newest survives; with `similar`, older
    episodes whose token sets are at least that alike are superseded too."""
    n = new if surprising is None else records.lookup_ids(new, surprising, "id")
    n = n.filter(F.coalesce("importance", F.lit(0.5)) >= floor).withColumn("_n", T.normal(F.col("text")))
    n = n.groupBy("_n").agg(F.max_by(F.struct(*[c for c in new.columns]), F.struct("ts", "id")).alias("r")).select("_n", "r.*")
    old = episodes.select("id", T.normal(F.col("text")).alias("_n"), F.col("text").alias("content"))
    gone = old.join(n.select("_n").distinct(), "_n", "left_semi").select("id")
    if similar is not None:
        gone = gone.unionByName(records.similar_exists(old.select("id", "content"), n.select("id", F.col("text").alias("content")), similar))
    return n.drop("_n"), gone.distinct()


def semantic_writes(decisions: DataFrame) -> DataFrame:
    """decision_id, kind, value, confidence of the semantic writes in decisions(decision_id,
    semantic_writes: JSON list of {kind, payload}). Bad JSON writes nothing."""
    kind = "array<struct<kind:string,payload:struct<value:string,content:string,confidence:double>>>"
    x = decisions.select("decision_id", F.explode(F.from_json("semantic_writes", kind)).alias("w"))
    return x.select("decision_id", "w.kind", F.coalesce("w.payload.value", "w.payload.content").alias("value"), F.col("w.payload.confidence").alias("confidence")).filter("kind IN ('fact', 'preference') AND value IS NOT NULL")


def apply(decisions: DataFrame, facts: DataFrame, preferences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(episodes to add, semantic rows to add) of decisions(decision_id, should_store_episode,
    episode_text, episode_importance, session_id, semantic_writes, ts). A semantic row that is there
    already, by its normal text and kind, is not written; of equal writes the first decision's is."""
    once = decisions.distinct()
    eps = new_episodes(once.filter("should_store_episode").select(F.col("episode_text").alias("text"), "session_id", F.lit(None).cast("string").alias("project_id"), F.col("episode_importance").alias("importance"), "ts"))
    w = semantic_writes(once).withColumn("_n", T.normal(F.col("value")))
    known = facts.select(F.lit("fact").alias("kind"), T.normal(F.col("content")).alias("_n")).unionByName(preferences.select(F.lit("preference").alias("kind"), T.normal(F.col("value")).alias("_n"))).distinct()
    fresh = w.join(known, ["kind", "_n"], "left_anti").groupBy("kind", "_n").agg(F.min_by(F.struct("decision_id", "value", "confidence"), F.struct("decision_id", "value")).alias("r"))
    return eps, fresh.select("kind", "r.*", F.concat(F.when(F.col("kind") == "fact", "fact_").otherwise("pref_"), T.digest(F.col("_n"), 16)).alias("id"))


def forget(score: DataFrame, episodes: DataFrame, least: int = 50, below: float = 0.3, min_age_days: float = 7.0, most: int = 100, dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, archive rows, episodes that stay) of a run of the forgetting policy. With fewer than
    `least` episodes nothing happens and the status says so; a dry run only reports."""
    cand = (F.col("score") < below) & (F.col("age_days") >= min_age_days)
    n = F.count(F.lit(1))
    report = score.agg(n.alias("total_scored"), F.coalesce(F.sum(cand.cast("bigint")), F.lit(0)).alias("below_threshold"))
    enough = F.col("total_scored") >= least
    would = F.least(F.col("below_threshold"), F.lit(most))
    report = report.select(
        F.when(~enough, "skipped").when(F.lit(dry_run), "dry_run").otherwise("ok").alias("status"), "total_scored",
        F.when(enough, F.col("below_threshold")).otherwise(F.lit(0)).alias("below_threshold"), F.when(enough, would).otherwise(F.lit(0)).cast("bigint").alias("would_archive"), F.when(enough & F.lit(not dry_run), would).otherwise(F.lit(0)).cast("bigint").alias("archived"),
    )
    gate = score.agg((n >= least).alias("_go")).filter("_go")
    rows = lifecycle.to_forget(score, below, min_age_days, most).crossJoin(F.broadcast(gate)).drop("_go")  # one row decides over all
    rows = rows if not dry_run else rows.limit(0)
    return report, lifecycle.archive_rows(rows, "forgetting_policy"), episodes.join(rows.select("id"), "id", "left_anti")


def consolidation_ids(affinities: DataFrame, least: float = 0.15, hits: int = 2) -> DataFrame:
    """id, hits: rows selected with an affinity of at least `least`, at least `hits` times."""
    return affinities.filter(F.col("affinity") >= least).groupBy("id").agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= hits)


def consolidate(episodes: DataFrame, affinities: DataFrame, floor: float = 0.7) -> DataFrame:
    """Promotions of the episodes that retrieval keeps coming back to."""
    return lifecycle.promotions(records.lookup_ids(episodes, consolidation_ids(affinities), "id"), floor)


def lifecycle_report(promoted: DataFrame, archived: DataFrame, deleted: DataFrame) -> DataFrame:
    """One row: promoted_events, promoted_facts, archived_episodes, deleted_episodes."""
    p = promoted.agg(F.count(F.when(F.col("kind") == "event", 1)).alias("promoted_events"), F.count(F.when(F.col("kind") == "fact", 1)).alias("promoted_facts"))
    return p.withColumn("archived_episodes", archived.agg(F.count(F.lit(1)).alias("n")).scalar()).withColumn("deleted_episodes", deleted.agg(F.count(F.lit(1)).alias("n")).scalar())


def health(layers: dict[str, DataFrame], text: dict[str, str], ts: str = "ts") -> DataFrame:
    """Per layer: rows, blank texts, newest time, and whether it holds anything."""
    out = None
    for name, df in layers.items():
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.regexp_replace(T.text(text[name]), r"\s+", "") == "", 1)).alias("blank"), F.max(ts).alias("newest"))
        one = one.select(F.lit(name).alias("layer"), "rows", "blank", "newest", F.when(F.col("rows") > 0, "ok").otherwise("empty").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


def maintenance(episodes: DataFrame, log: DataFrame, as_of: float, dry_run: bool = False) -> dict[str, DataFrame]:
    """Everything a maintenance run yields: forgetting report, archive rows, what stays, promotions."""
    score = lifecycle.scored(episodes, log, as_of)
    report, rows, left = forget(score, episodes, dry_run=dry_run)
    return {"report": report, "archive": rows, "episodes": left, "promotions": lifecycle.promotions(episodes)}


def turn_window(turns: DataFrame, n: int = 5) -> DataFrame:
    """session_id, text: the newest n turns of each session as "Role: content" lines, newest first."""
    r = working.recent(turns, n)
    line = F.concat(F.initcap("role"), F.lit(": "), T.text("content"))
    return r.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("p")).select("session_id", F.array_join(F.transform("p", lambda p: p["line"]), "\n").alias("text"))
