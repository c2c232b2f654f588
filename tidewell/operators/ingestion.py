"""What of a turn is worth keeping: ephemeral turns, a score with reasons, preferences and facts.

All rules are expressions over one row; nothing is shuffled. Null text is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Marks of a turn that is not to be kept.
EPHEMERAL = [r"\bignore this\b", r"\bdo not remember\b", r"\bfor this message only\b", r"\btemporary note\b", r"\bnot for long[- ]term memory\b", r"\bephemeral\b", r"\bmensaje temporal\b", r"\bno recuerdes esto\b"]
#: What introduces a preference; group 1 is its value.
PREFERENCES = [r"\bi prefer\s+(.+)", r"\bi like\s+(.+)", r"\bi (?:do not|don't) like\s+(.+)", r"\bmy favorite\s+\w+\s+is\s+(.+)", r"\bprefiero\s+(.+)", r"\bme gusta\s+(.+)"]
#: What introduces a fact; group 1 is its value.
FACTS = [r"\bi am\s+(.+)", r"\bi work on\s+(.+)", r"\bi use\s+(.+)", r"\bwe decided to\s+(.+)", r"\bthe plan is to\s+(.+)", r"\bestoy\s+(.+)", r"\buso\s+(.+)", r"\bdecidimos\s+(.+)"]
#: Words about a person, and about the state of a task.
PROFILE = ["prefer", "favorite", "i like", "i don't like", "i am", "i use", "i work on", "prefiero", "me gusta", "uso", "trabajo en"]
TASK = ["decided", "plan", "implemented", "fixed", "bug", "issue", "todo", "next step", "resolved", "decision", "milestone", "deadline", "decidimos", "error"]
MEMORY = ["remember", "important", "recuerda"]


def _any(c: Column, words: list[str]) -> Column:
    return F.lower(T.text(c)).rlike("|".join(words))


def is_ephemeral(c: Column, metadata: Column | None = None) -> Column:
    """A mark in the text, a short test message, or a true `ephemeral` in the metadata (JSON)."""
    low = F.lower(T.text(c))
    flag = F.lit(False) if metadata is None else _true(metadata, "ephemeral")
    return flag | (F.contains(low, F.lit("test")) & F.contains(low, F.lit("message")) & (T.words(c) <= 8)) | low.rlike("|".join(EPHEMERAL))


def _true(metadata: Column, name: str) -> Column:
    """A JSON field that is neither missing, false, 0, null nor empty."""
    v = F.get_json_object(metadata, f"$.{name}")
    return F.coalesce(~v.isin("", "false", "0", "0.0", "null", "[]", "{}"), F.lit(False))


def decisions(turns: DataFrame, threshold: float = 0.35, longest: int = 1200, profile: Sequence[str] = (), task: Sequence[str] = (), episodes: DataFrame | None = None) -> DataFrame:
    """The whole decision on turns(id, role, content, metadata, paired): id, ephemeral, score, reasons,
    preference, fact, episode_text, importance, store. A true `remember` or an importance of at least
    .8 in the metadata counts .55; paired (a question with its answer) is what is stored if given;
    a text that equals one of episodes(text) but for case and white space is not stored again."""
    m = F.col("metadata")
    told = _true(m, "remember") | F.coalesce(F.expr("try_cast(get_json_object(metadata, '$.importance') AS DOUBLE)") >= 0.8, F.lit(False))
    t = turns.withColumn("_c", F.regexp_replace(T.text("content"), r"^\s+|\s+$", ""))
    j = judged(t.select("id", "role", F.col("_c").alias("content"), told.alias("_told"), is_ephemeral(F.col("_c"), m).alias("_eph")), threshold, longest, profile, task).drop("store", "strength")
    text = F.regexp_replace(F.substring(T.first_nonempty(F.col("paired"), F.col("_c")), 1, longest), r"^\s+|\s+$", "")
    x = j.join(t.select("id", F.coalesce(text, F.lit("")).alias("episode_text"), (F.col("_c") == "").alias("_empty")), "id")
    x = x.withColumn("store", ~F.col("_empty") & ~F.col("ephemeral") & (F.col("score") >= threshold) & (F.length("episode_text") >= 24))
    if episodes is not None:
        seen = episodes.select(T.normal(F.col("text")).alias("_n")).distinct().withColumn("_seen", F.lit(True))
        x = x.withColumn("_n", T.normal(F.col("episode_text"))).join(seen, "_n", "left")
        dup = F.col("store") & F.coalesce("_seen", F.lit(False))
        x = x.withColumn("reasons", F.when(dup, F.concat_ws(",", F.when(F.col("reasons") != "", F.col("reasons")), F.lit("duplicate_episode"))).otherwise(F.col("reasons"))).withColumn("store", F.col("store") & ~dup)
    quiet = F.when(F.col("_empty"), "empty_content").when(F.col("ephemeral"), "ephemeral_signal")
    return x.select("id", "ephemeral", F.when(quiet.isNull(), F.col("score")).otherwise(0.0).alias("score"), F.coalesce(quiet, F.col("reasons")).alias("reasons"), F.when(quiet.isNull(), F.col("preference")).alias("preference"), F.when(quiet.isNull(), F.col("fact")).alias("fact"), F.when(quiet.isNull(), F.col("episode_text")).otherwise("").alias("episode_text"), F.when(quiet.isNull(), F.least(F.lit(1.0), F.col("score"))).otherwise(0.0).alias("importance"), "store")


def _first(c: Column, patterns: list[str]) -> Column:
    """The value of the first pattern that gives one, without stops and blanks at its ends."""
    strip = lambda v: F.regexp_replace(v, r"^[ .,!\n\t]+|[ .,!\n\t]+$", "")
    return T.first_nonempty(*[strip(F.regexp_extract(T.text(c), "(?i)(?d)" + p, 1)) for p in patterns])


def preference(c: Column) -> Column:
    return F.substring(_first(c, PREFERENCES), 1, 240)


def fact(c: Column) -> Column:
    return F.substring(_first(c, FACTS), 1, 320)


def judged(turns: DataFrame, threshold: float = 0.35, longest: int = 1200, profile: Sequence[str] = (), task: Sequence[str] = ()) -> DataFrame:
    """id, ephemeral, score (9 decimals), reasons, preference, strength, fact, store of turns(id, role,
    content). Only user and system turns yield preferences and facts."""
    c = F.col("content")
    own = F.col("role") != "assistant"
    words = T.words(c)
    told = F.col("_told") if "_told" in turns.columns else F.lit(False)
    hits = [(told, 0.55, "explicit_memory_signal"), (_any(c, MEMORY), 0.28, "memory_language"), (_any(c, [*PROFILE, *profile]), 0.22, "user_profile_signal"), (_any(c, [*TASK, *task]), 0.16, "task_state_signal"), (~own, 0.20, "assistant_turn_summary")]
    score = F.lit(0.05)
    for cond, w, _ in hits:
        score = score + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
    score = F.least(F.lit(1.0), score + F.least(F.lit(0.12), words / 200.0))
    reasons = F.array_compact(F.array(*[F.when(cond, name) for cond, _, name in hits], F.when(words >= 20, "substantive_turn")))
    t = turns.select("id", (F.col("_eph") if "_eph" in turns.columns else is_ephemeral(c)).alias("ephemeral"), score.alias("_s"), reasons.alias("reasons"), F.when(own, preference(c)).alias("preference"), F.when(own, fact(c)).alias("fact"), F.length(F.substring(T.text(c), 1, longest)).alias("chars"), F.when(_any(c, ["don't like", "do not like", "no me gusta"]), 0.68).otherwise(0.75).alias("strength"))
    writes = F.col("preference").isNotNull().cast("int") + F.col("fact").isNotNull().cast("int")
    reasons = F.when(writes > 0, F.concat(F.col("reasons"), F.array(F.lit("semantic_candidates")))).otherwise(F.col("reasons")) if "_told" in turns.columns else F.col("reasons")
    s = F.round(F.col("_s") + F.least(F.lit(0.18), 0.06 * writes), 9)
    return t.select("id", "ephemeral", s.alias("score"), F.array_join(reasons, ",").alias("reasons"), "preference", F.when(F.col("preference").isNotNull(), F.col("strength")).alias("strength"), "fact", (~F.col("ephemeral") & (s >= threshold) & (F.col("chars") >= 24)).alias("store"))
