"""Turns to training records: merging runs of one role, pairing, records, statistics.

Runs and pairs are found in blocks of time per session, so no session is one task. Ties in time go
by id. Null content is empty; an empty table gives no rows. System turns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import skew


def merged(turns: DataFrame) -> DataFrame:
    """Successive turns of one role in a session as one: session_id, run, role, content (joined by
    line breaks), ts (the last) and turns merged."""
    t = skew.with_blocks(turns.filter("role <> 'system'"), ["session_id"], "ts")
    t = skew.previous(t, ["session_id"], ["ts", "id"], ["role"])
    new = (F.col("_prev").isNull() | (F.col("_prev.role") != F.col("role"))).cast("long")
    t = skew.running(t, ["session_id"], ["ts", "id"], {"run": new})
    parts = F.array_sort(F.collect_list(F.struct("ts", "id", "content")))
    return t.groupBy("session_id", "run", "role").agg(parts.alias("_p"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("turns")).select("session_id", "run", "role", F.array_join(F.transform("_p", lambda p: p["content"]), "\n").alias("content"), "ts", "turns")


def pairs(runs: DataFrame) -> DataFrame:
    """A user run and the assistant run after it: session_id, run, question, answer, hash. The two
    meet by an equi-join on (session, run + 1)."""
    u = runs.filter("role = 'user'").select("session_id", "run", F.col("content").alias("question"))
    a = runs.filter("role = 'assistant'").select("session_id", (F.col("run") - 1).alias("run"), F.col("content").alias("answer"))
    return u.join(a, ["session_id", "run"]).withColumn("hash", T.pair_digest(F.col("question"), F.col("answer")))


def first_of_each(pair: DataFrame) -> DataFrame:
    """One pair per hash, the first by session and position."""
    return pair.groupBy("hash").agg(F.min_by(F.struct("session_id", "run", "question", "answer"), F.struct("session_id", "run")).alias("r")).select("hash", "r.*")


def records(pair: DataFrame, min_chars: int = 10, max_chars: int = 0, min_pair: int = 20, system: str | None = None) -> DataFrame:
    """hash, openai, alpaca and raw (JSON lines and text; null where the pair is too short for one)."""
    strip = lambda c: F.regexp_replace(T.text(c), r"^\s+|\s+$", "")
    cut = (lambda c: F.substring(c, 1, max_chars)) if max_chars > 0 else (lambda c: c)
    fit = lambda c: F.when(F.length(strip(c)) >= min_chars, cut(strip(c)))
    p = pair.select("hash", "session_id", "run", fit("question").alias("q"), fit("answer").alias("a"))
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    turns = ([turn("system", F.lit(system))] if system else []) + [turn("user", F.col("q")), turn("assistant", F.col("a"))]
    whole = F.col("q").isNotNull() & F.col("a").isNotNull()
    return p.select(
        "hash", "session_id", "run",
        F.when(whole, F.to_json(F.struct(F.array(*turns).alias("messages")))).alias("openai"),
        F.when(whole & (F.length("q") + F.length("a") >= min_pair), F.to_json(F.struct(F.col("q").alias("instruction"), F.lit("").alias("input"), F.col("a").alias("output")))).alias("alpaca"),
        F.when(F.coalesce("q", "a").isNotNull(), F.concat_ws("\n", F.concat(F.lit("User: "), "q"), F.concat(F.lit("Assistant: "), "a"))).alias("raw"),
    )


def stats(runs: DataFrame) -> DataFrame:
    """Turns, sessions, complete pairs and runs without a partner."""
    p = pairs(runs)
    r = runs.agg(F.sum("turns").alias("turns"), F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("runs"))
    return r.withColumn("pairs", p.agg(F.count(F.lit(1)).alias("n")).scalar()).withColumn("unpaired", F.col("runs") - 2 * F.col("pairs"))


def write(records_df: DataFrame, path: str, column: str = "openai", one_file: bool = False) -> int:
    """Writes one record a line and says how many; one_file is for small exports only."""
    lines = records_df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    n = lines.count()
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").text(path)
    return n


def tool_turns(turns: DataFrame) -> DataFrame:
    """The first of turns with equal content: source order episodic, cold, working, then time and id."""
    rank = F.when(F.col("source") == "episodic", 0).when(F.col("source") == "cold", 1).otherwise(2)
    w = Window.partitionBy("hash").orderBy(rank, "timestamp", "turn_id")
    return turns.withColumn("hash", F.sha2(T.text("content"), 256)).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
