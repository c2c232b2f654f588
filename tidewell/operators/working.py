"""Working memory: budgets, windows and counts per session.

Input turns have id, session_id, role, content, tokens and ts. Ties in time go by id. Null session
ids are a session of their own; null tokens count as 0; an empty table gives an empty result.
Whatever needs only the newest rows limits them before the shuffle (row_number <= n); whatever
needs all rows of a session runs in blocks of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import skew


def recent(turns: DataFrame, n: int) -> DataFrame:
    """The newest n turns of each session with `rank` (1 is the newest)."""
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("id"))
    return turns.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def context_window(turns: DataFrame, budget: int, with_system: bool = True) -> DataFrame:
    """Per session the longest run of newest turns whose tokens fit the budget, with their running
    total `used`; at most max(200, budget // 3 * 4) turns are looked at."""
    rows = turns if with_system else turns.filter("role <> 'system'")
    r = recent(rows, max(200, budget // 3 * 4))
    w = Window.partitionBy("session_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("used", F.sum(F.coalesce("tokens", F.lit(0))).over(w)).filter(F.col("used") <= budget)


def evicted(turns: DataFrame, budget: int) -> DataFrame:
    """The turns that first-in-first-out eviction to the budget removes: those before which less than
    the excess has been removed."""
    t = skew.with_blocks(turns.withColumn("tokens", F.coalesce("tokens", F.lit(0))), ["session_id"], "ts")
    totals = t.groupBy("session_id").agg(F.sum("tokens").alias("total"))
    r = skew.running(t, ["session_id"], ["ts", "id"], {"upto": F.col("tokens")})
    return skew.lookup(r, totals.filter(F.col("total") > budget), "session_id", "inner").filter(F.col("upto") - F.col("tokens") < F.col("total") - budget).drop("_block")


def with_question(turns: DataFrame) -> DataFrame:
    """Assistant turns whose predecessor is a user turn, with both as one text."""
    t = skew.previous(skew.with_blocks(turns, ["session_id"], "ts"), ["session_id"], ["ts", "id"], ["role", "content"])
    return t.filter((F.col("role") == "assistant") & (F.col("_prev.role") == "user")).select("id", "session_id", F.concat(F.lit("User: "), F.col("_prev.content"), F.lit("\nAssistant: "), F.col("content")).alias("paired"))


def session_stats(turns: DataFrame, budget: int) -> DataFrame:
    """Rows, tokens, times, roles, use of the budget and duration per session."""
    return turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("role").alias("roles"),
        (F.coalesce(F.sum("tokens"), F.lit(0)) / budget).alias("utilization"), (F.max("ts") - F.min("ts")).alias("duration"),
    )


def search(turns: DataFrame, needle: str, n: int, role: str | None = None) -> DataFrame:
    """The newest n turns that contain needle, any case; % and _ are wildcards."""
    hit = turns.filter(F.col("content").ilike(f"%{needle}%"))
    return (hit if role is None else hit.filter(F.col("role") == role)).orderBy(F.desc("ts"), F.desc("id")).limit(n)
