"""Rebuilding conversations from message rows.

Rows are sessionised by `session_id`: times are brought to one unit, second deliveries dropped,
roles inferred from their spellings, and rows ordered by (time, id). Within a session, segments
end at inactivity gaps longer than a calibrated threshold. Sessions that are empty, broken or
without a reply are left out, and `session_verdicts` says why.

The verdicts need no window: first and last speaker are min_by/max_by, numbering is a count of
distinct numbers after pre-aggregation, so a session of any size is folded map-side; second
deliveries are dropped before, by a key that spreads a session over its contents. Turns of one
session are numbered in blocks of time (skew.with_blocks), so a session that holds a third of all
rows is not one task either.

Null or unknown roles, null contents, null times and null metadata are all allowed: a null time
sorts first, null content is blank. Rows without a session_id cannot be told apart by session: they
are reported and left out as one session with the reason `no session`. An empty table
gives no rows. Columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import skew

#: Spellings of the speakers, compared in lower case without blanks.
ROLES = {
    "user": ["user", "human", "customer", "prompter", "usr"],
    "assistant": ["assistant", "ai", "bot", "model", "gpt", "agent", "chatbot"],
    "system": ["system", "developer"],
    "tool": ["tool", "function", "tool_call", "tool_result"],
}
#: Words that stand for nothing.
NOTHING = ["null", "none", "n/a", "na", "nil", "nan", "undefined", "n.a.", "n. a.", "(null)", "(none)", "<null>", "<none>", "[null]", "(empty)", "<empty>", "empty", "k.a.", "s/o", "ninguno", "nulo", "nul", "néant", "keine", "vacío", "vide", "leer", "#n/a"]
#: Times above this are milliseconds.
MILLIS_FROM = 1e11


def clean(c: Column) -> Column:
    """Content without white, control and invisible characters at its ends."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^[\s\p{Z}\p{C}\x{115f}\x{1160}\x{2800}\x{3164}]+|[\s\p{Z}\p{C}\x{115f}\x{1160}\x{2800}\x{3164}]+$", "")


def is_blank(c: Column) -> Column:
    """Nothing but white or invisible characters, or a placeholder for nothing."""
    s = clean(c)
    return (s == "") | s.rlike(r"^[\p{Pd}_.·•…*~/\\\s?]+$") & ~s.rlike(r"^\s*\?+\s*$") | F.lower(s).isin(*NOTHING)


def speaker(c: Column) -> Column:
    """user, assistant, system, tool or null for an unknown spelling."""
    r = F.lower(clean(c))
    out = F.lit(None).cast("string")
    for name, spellings in ROLES.items():
        out = F.when(r.isin(*spellings), name).otherwise(out)
    return out


def rows(messages: DataFrame) -> DataFrame:
    """The rows with speaker, said, seconds and number (the client's own, if it numbers)."""
    t = F.col("timestamp").cast("double")
    return messages.select(
        "session_id",
        "id",
        speaker(F.col("role")).alias("speaker"),
        (~is_blank(F.col("content"))).alias("said"),
        F.when(t > MILLIS_FROM, t / 1000).otherwise(t).alias("seconds"),
        F.expr("try_cast(get_json_object(metadata, '$.turn') AS BIGINT)").alias("number"),
        "content",
    )


def _content_key() -> Column:
    return F.struct(F.xxhash64("content"), F.xxhash64(F.reverse("content")), F.length("content"))


def session_verdicts(messages: DataFrame) -> DataFrame:
    """One row per session: rows (second deliveries too), why it is left out (null if it is kept),
    and its times. First and last speaker are those of the rows that `once` keeps: a row delivered
    again within its second doesn't come after the answer of that second."""
    r = rows(messages).withColumn("_c", _content_key()).groupBy("session_id", "speaker", "seconds", "_c").agg(
        F.count(F.lit(1)).alias("_n"), F.min("id").alias("id"), F.max("said").alias("said"), F.collect_set("number").alias("_numbers")
    )
    # a row for each number of the copies, in the first of which they are counted
    r = r.select("session_id", "speaker", "seconds", "id", "said", "_n", F.posexplode_outer("_numbers").alias("_pos", "number"))
    turn = F.col("speaker").isin("user", "assistant")
    says = F.col("said") & turn
    # pre-aggregated by (session, number): what is then shuffled per session is its distinct numbers
    partial = r.groupBy("session_id", "number").agg(
        F.sum(F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_n")).otherwise(0)).alias("n"),
        F.min("seconds").alias("t0"),
        F.max("seconds").alias("t1"),
        F.coalesce(F.max(says), F.lit(False)).alias("any_said"),
        F.max(~F.col("said") & (F.col("speaker") == "assistant")).alias("blank_reply"),
        F.max(F.col("said") & F.col("speaker").isNull()).alias("stranger"),
        F.min(F.when(says, F.struct("seconds", "id", "speaker"))).alias("first"),
        F.max(F.when(says, F.struct("seconds", "id", "speaker"))).alias("last"),
    )
    s = partial.groupBy("session_id").agg(
        F.sum("n").alias("rows"),
        F.min("t0").alias("started"),
        F.max("t1").alias("ended"),
        F.max("any_said").alias("any_said"),
        F.max("blank_reply").alias("blank_reply"),
        F.max("stranger").alias("stranger"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.count("number").alias("numbers"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
    )
    why = (
        F.when(F.col("session_id").isNull(), "no session")
        .when(~F.col("any_said"), "empty")
        .when(F.coalesce("stranger", F.lit(False)), "unknown speaker")
        .when(F.coalesce("blank_reply", F.lit(False)), "blank reply")
        .when(F.col("first.speaker") != "user", "no opening")
        .when(F.col("last.speaker") != "assistant", "no reply")
        .when((F.col("numbers") > 0) & ((F.col("low") != 0) | (F.col("high") - F.col("low") + 1 != F.col("numbers"))), "rows missing")
    )
    return s.select("session_id", "rows", "started", "ended", why.alias("reason"))


def found(messages: DataFrame) -> DataFrame:
    """p1_found: the sessions to be left out."""
    return session_verdicts(messages).filter("reason IS NOT NULL").select("session_id").distinct()


def once(messages: DataFrame) -> DataFrame:
    """Rows without second deliveries: of rows with the same session, speaker, time and content,
    the one with the smallest id stays. The content enters the key as a 128-bit hash, so a hot
    session is spread by its contents."""
    r = rows(messages)
    return (
        r.withColumn("_c", _content_key())
        .groupBy("session_id", "speaker", "seconds", "_c")
        .agg(F.min_by(F.struct("id", "said", "number", "content"), "id").alias("r"))
        .select("session_id", "speaker", "seconds", "r.*")
    )


def gap_threshold(messages: DataFrame, quantile: float = 0.99, factor: float = 4.0) -> DataFrame:
    """The calibrated inactivity gap in seconds, one row: `factor` times the `quantile` of the gaps
    between successive rows of a session, over all rows. Gaps are taken within blocks of time."""
    r = skew.with_blocks(rows(messages).filter("seconds IS NOT NULL").select("session_id", "id", "seconds"), ["session_id"], "seconds")
    w = Window.partitionBy("session_id", "_block").orderBy("seconds", "id")
    return r.withColumn("gap", F.col("seconds") - F.lag("seconds").over(w)).agg((F.percentile_approx("gap", quantile, 10_000) * factor).alias("gap_seconds"))


def conversations(messages: DataFrame, quantile: float = 0.99, factor: float = 4.0) -> DataFrame:
    """The kept sessions, one row per turn: session_id, segment, turn (from 0), speaker, seconds,
    rows (merged) and content. Successive rows of one speaker within a segment are one turn,
    joined by a line break; blank rows and system and tool rows are no turns. segment counts the
    gaps above the calibrated threshold; all segments of a session stay one conversation."""
    keep = session_verdicts(messages).filter("reason IS NULL AND session_id IS NOT NULL").select("session_id")
    # the verdict of a session is one row; the rows of a hot session meet it spread over tasks
    r = once(messages).filter("said AND speaker IN ('user', 'assistant')")
    r = skew.lookup(r, keep.withColumn("_keep", F.lit(True)), "session_id", "inner").drop("_keep")
    b = skew.with_blocks(r, ["session_id"], "seconds")
    w = Window.partitionBy("session_id", "_block").orderBy("seconds", "id")
    edges = b.groupBy("session_id", "_block").agg(F.max(F.struct("seconds", "id", "speaker")).alias("_end"))
    ew = Window.partitionBy("session_id").orderBy("_block")
    prior = edges.select(F.col("session_id").alias("_s"), F.col("_block").alias("_b"), F.lag("_end").over(ew).alias("_prior")).filter("_prior IS NOT NULL")
    x = b.withColumn("_before", F.lag(F.struct("seconds", "id", "speaker")).over(w))
    x = x.join(F.broadcast(prior), (x.session_id == prior._s) & (x._block == prior._b), "left").drop("_s", "_b")
    x = x.withColumn("_before", F.coalesce("_before", "_prior")).drop("_prior")
    longest = gap_threshold(messages, quantile, factor).scalar()  # an aggregate without keys: one value
    x = x.withColumn("_gap", F.coalesce((F.col("seconds") - F.col("_before.seconds")) > longest, F.lit(False)))
    gap = F.col("_gap")
    new = F.col("_before").isNull() | (F.col("_before.speaker") != F.col("speaker")) | gap
    x = skew.running(x, ["session_id"], ["seconds", "id"], {"segment": gap.cast("long"), "turn": new.cast("long")})
    return (
        x.groupBy("session_id", "segment", "turn", "speaker")
        .agg(F.min("seconds").alias("seconds"), F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_list(F.struct("seconds", "id", "content"))).alias("_c"))
        .select("session_id", "segment", (F.col("turn") - 1).alias("turn"), "speaker", "seconds", "rows", F.array_join(F.transform("_c", lambda c: c["content"]), "\n").alias("content"))
    )


def report(messages: DataFrame) -> DataFrame:
    """Sessions and rows by reason."""
    return session_verdicts(messages).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("rows").cast("long").alias("rows"))
