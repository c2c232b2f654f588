"""Text cut off by field limits.

Lengths: per source and per unit (characters, UTF-8 bytes), the hazard of a length is the number of
texts that end at it without a stop, out of all texts at least as long; window functions give it
together with the hazards of the neighbouring lengths. A Poisson test of each hazard against its
neighbours, with the false discovery rate controlled over all lengths (Benjamini and Hochberg),
leaves the lengths at which a source truncates.

A record is cut off if it ends without a stop (or with the mark of a cut) and, in this order,
- limit: its length is significant for its source;
- and by a second operator for cuts away from any field limit, such as transfers that broke off:
  source text: the text it was made from goes on (see `evidence`), be it another record's with the
  same text; open: a bracket, quote or code fence is left open; ending: its tail is one after which
  sentences go on (terminal contexts, see endings).
`by` says which of these a record was flagged for; `report` counts them apart.

A whole text without a final stop ends where sentences end, so none of the four holds; one that
trails off on purpose ("and so on…") ends where others trail off. Null and empty texts are whole.
Rows repeated under one id give one row. A null source is a source of its own. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import skew
from ..session import cut
from . import endings

#: Lengths on either side that count as neighbours.
NEAR = 12
FDR = 0.001
#: What a record is flagged for, the first that holds.
BY = ("limit", "source text", "open", "ending")


def records(episodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """table_name, row_id, source, text and, for decisions, the text it was made from."""
    source = lambda c: F.lower(F.trim(c))
    e = episodes.select(F.lit("episodes").alias("table_name"), F.col("id").cast("string").alias("row_id"), source(F.get_json_object("metadata", "$.source")).alias("source"), F.col("text"), F.lit(None).cast("string").alias("made_from"))
    d = decisions.select(F.lit("ingestion_decisions").alias("table_name"), F.col("decision_id").cast("string").alias("row_id"), source(F.col("source")).alias("source"), F.col("episode_text").alias("text"), F.col("source_text").alias("made_from"))
    return e.unionByName(d).filter("row_id IS NOT NULL AND text IS NOT NULL AND trim(text) <> ''")


#: A mark of a cut at the end of a text.
MARK = r"\s*(?:\[(?:\.\.\.|…|truncated|cut)\]|\.\.\.|…)\s*$"


def evidence(bare: str, made_from: str) -> Column:
    """The column `made_from` begins with the column `bare` and goes on with letters or digits."""
    rest = F.expr(f"substring({made_from}, length({bare}) + 1)")
    return F.coalesce(F.startswith(F.col(made_from), F.col(bare)) & (F.length(bare) >= 20) & rest.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def limits(lengths: DataFrame, near: int = NEAR, fdr: float = FDR) -> DataFrame:
    """lengths(source, unit, length, ended) -> source, unit, length, n, at_risk, hazard, around
    (the hazard of the neighbours), p: the significant ones. One row per source, unit and length
    enters the windows, so their size is bounded by the number of lengths, not of texts."""
    h = lengths.groupBy("source", "unit", "length").agg(F.sum(F.when(~F.col("ended"), 1).otherwise(0)).alias("n"), F.count(F.lit(1)).alias("all"))
    w = Window.partitionBy("source", "unit").orderBy(F.col("length"))
    h = h.withColumn("at_risk", F.sum("all").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    around = w.rangeBetween(-near, near)
    h = h.withColumn("n_near", F.sum("n").over(around) - F.col("n")).withColumn("risk_near", F.col("at_risk") * 2 * near)
    # the neighbours' own deaths, with half a death for what was never seen; at_risk hardly changes over so few lengths
    h = h.withColumn("hazard", F.col("n") / F.col("at_risk")).withColumn("around", (F.col("n_near") + 0.5) / F.col("risk_near"))
    mean = F.col("at_risk") * F.col("around")
    # upper tail of Poisson(mean) at n by its first term times a geometric bound on the rest
    log_first = -mean + F.col("n") * F.log(mean) - (F.col("n") * F.log("n") - F.col("n") + 0.5 * F.log(2 * 3.141592653589793 * F.col("n")))
    p = F.when((F.col("n") > mean) & (F.col("n") >= 3), F.least(F.lit(1.0), F.exp(log_first) / (1 - mean / (F.col("n") + 1)))).otherwise(1.0)
    h = h.withColumn("p", p)
    tests = Window.partitionBy("unit")
    h = h.withColumn("rank", F.row_number().over(Window.partitionBy("unit").orderBy("p", "source", "length"))).withColumn("tests", F.count(F.lit(1)).over(tests))
    last = F.max(F.when(F.col("p") <= fdr * F.col("rank") / F.col("tests"), F.col("rank"))).over(tests)
    return h.withColumn("_last", last).filter(F.col("rank") <= F.col("_last")).select("source", "unit", "length", "n", "at_risk", "hazard", "around", "p")


def judged(episodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per table_name and row_id: source, truncated, by (the first of limit, source text, open and
    ending that holds; null for a whole text), at_limit (its length is significant), ended."""
    r = records(episodes, decisions).withColumn("_bare", F.regexp_replace("text", MARK, ""))
    words = endings.vocabulary(r.select("text"))
    proof = evidence("_bare", "made_from")
    keyed = r.select("table_name", "row_id", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text", F.length("text")).alias("same"), proof.alias("proof"), "text")
    keys = ["table_name", "row_id", "source", "chars", "bytes", "same", "proof"]
    t = cut(endings.tails(keyed, keys, words), "tails")
    # a text teaches its tail once, however often it is repeated: finals count different texts
    counts = endings.contexts(r.select("text").distinct(), words)
    # copies of one text say nothing new about a limit
    lengths = t.select("source", "same", "chars", "bytes", "ended").distinct().select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("u"), "ended").select("source", "u.unit", "u.length", "ended")
    significant = cut(limits(lengths), "limits")
    small = F.broadcast if significant.count() <= 10_000 else (lambda x: x)
    one = lambda unit: small(significant.filter(F.col("unit") == unit).select(F.col("source").alias(f"_s_{unit}"), F.col("length").alias(f"_l_{unit}")))
    for unit in ("chars", "bytes"):
        t = t.join(one(unit), F.col("source").eqNullSafe(F.col(f"_s_{unit}")) & (F.col(unit) == F.col(f"_l_{unit}")), "left")
    t = t.withColumn("at_limit", F.col("_l_chars").isNotNull() | F.col("_l_bytes").isNotNull()).drop("_s_chars", "_l_chars", "_s_bytes", "_l_bytes")
    proven = t.filter("proof").select("same").distinct().withColumn("proven", F.lit(True))
    t = skew.lookup(t, proven, "same")
    t = endings.end_chance(t, counts)
    by = F.when(F.col("at_limit"), 0).when(F.coalesce("proven", F.lit(False)), 1).when(F.col("open"), 2).when(F.col("chance") < endings.UNFINISHED, 3)
    t = t.withColumn("_by", F.when(~F.col("ended"), by))
    return (
        t.withColumn("truncated", F.col("_by").isNotNull())
        .groupBy("table_name", "row_id")
        .agg(F.min("source").alias("source"), F.max("truncated").alias("truncated"), F.min("_by").alias("_by"), F.max("at_limit").alias("at_limit"), F.min("ended").alias("ended"), F.min("chance").alias("chance"), F.max("chars").alias("chars"))
        .withColumn("by", F.coalesce(*[F.when(F.col("_by") == i, x) for i, x in enumerate(BY)])).drop("_by")
    )


def found(episodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """p2_found: distinct (table_name, row_id) of the records cut off."""
    return judged(episodes, decisions).filter("truncated").select("table_name", "row_id").distinct()


def report(episodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Records, records cut off, their share, and how many were flagged for what, per table and source."""
    return judged(episodes, decisions).groupBy("table_name", "source").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.col("truncated").cast("int")).alias("cut_off"), F.avg(F.col("truncated").cast("double")).alias("share"), *[F.count(F.when(F.col("by") == x, 1)).alias(f"by_{x.replace(' ', '_')}") for x in BY]
    )
