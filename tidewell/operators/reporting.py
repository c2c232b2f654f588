"""Run reports, telemetry, calibration, evaluation metrics. Null strategies are '<unknown>';
an empty table gives no groups; ties go by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import skew

#: Rows of a piece of a recursion.
PIECE = 500


def order_statistics(values: DataFrame, column: str, at: dict[str, Column], by: str | None = None) -> DataFrame:
    """The values at given places (from 0, columns over `n`, the number of values) of the sorted
    non-null values of a column, per `by` or over all: n and one column per place. Values are counted
    first; the running count of the distinct ones, in blocks, tells which holds a place: no task
    sorts all rows."""
    keys = [by] if by else ["_all"]
    v = values.filter(F.col(column).isNotNull()).withColumn("_all", F.lit(1))
    g = v.groupBy(*keys, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    n = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # counted on the rows, of which there are at least as many as distinct values
    r = skew.running(skew.with_blocks(g, keys, "_v", of=v.withColumn("_v", F.col(column))), keys, ["_v"], {"_upto": F.col("_c")})
    j = r.join(F.broadcast(n), keys) if not by else skew.lookup(r, n, by, "inner")
    out = j.groupBy(*keys, "n").agg(*[F.min(F.when(F.col("_upto") > place, F.col("_v"))).alias(name) for name, place in at.items()])
    return out.drop("_all")



def strategies(runs: DataFrame, latest: int | None = None) -> DataFrame:
    """Per strategy: runs, failures, successes, mean duration and candidates over all runs (a null counts as 0)."""
    r = runs if latest is None else runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(latest)
    failed = (F.col("failure_mode").isNotNull() | (F.col("status") == "failed")).cast("int")
    n = F.count(F.lit(1))
    return r.groupBy(F.coalesce("strategy", F.lit("<unknown>")).alias("strategy")).agg(n.alias("runs"), F.sum(failed).alias("failures"), F.sum(1 - failed).alias("successes"), (F.sum(F.coalesce("duration", F.lit(0.0))) / n).alias("duration"), (F.sum(F.coalesce("candidates", F.lit(0))) / n).alias("candidates"))


def select_runs(runs: DataFrame, strategy: str | None = None, failure_mode: str | None = None, n: int = 50) -> DataFrame:
    """The newest n runs that meet every given condition."""
    for name, v in (("strategy", strategy), ("failure_mode", failure_mode)):
        if v is not None:
            runs = runs.filter(F.col(name) == v)
    return runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(n)


def kinds(events: DataFrame) -> DataFrame:
    """Events per kind, the last time and the share of all."""
    g = events.groupBy(F.coalesce("strategy", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"))
    return g.withColumn("share", F.col("events") / F.sum("events").over(Window.partitionBy(F.lit(1))))  # one row a kind


def calibration(values: DataFrame, column: str) -> DataFrame:
    """Mean, population deviation and the percentiles 50, 80, 90 and 95 (linear) of a column."""
    at = {}
    for q in (50, 80, 90, 95):
        spot = (F.col("n") - 1) * (q / 100)
        at[f"_a{q}"], at[f"_b{q}"] = F.floor(F.round(spot, 9)), F.ceil(F.round(spot, 9))
    places = order_statistics(values, column, at)
    share = lambda q: (F.col("n") - 1) * (q / 100) - F.floor(F.round((F.col("n") - 1) * (q / 100), 9))
    lines = places.select("n", *[(F.col(f"_a{q}") + (F.col(f"_b{q}") - F.col(f"_a{q}")) * share(q)).alias(f"p{q}") for q in (50, 80, 90, 95)])
    whole = values.agg(F.count(column).alias("_n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    return whole.join(F.broadcast(lines.drop("n")), F.lit(True), "left").select(F.col("_n").alias("n"), "mean", "std", "p50", "p80", "p90", "p95")


def filter_stats(rows: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows above a threshold, their share, and the mean of both classes."""
    above = F.col(column) > threshold
    return rows.agg(F.count(F.lit(1)).alias("seen"), F.sum(above.cast("int")).alias("stored"), (F.sum(above.cast("int")) / F.count(F.lit(1))).alias("rate"), F.avg(F.when(above, F.col(column))).alias("stored_mean"), F.avg(F.when(~above, F.col(column))).alias("skipped_mean"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with mean ranks for ties. Ranks are cumulative counts of distinct values, so
    what goes through one window is one row per distinct value."""
    def ranks(c: str, name: str) -> DataFrame:
        g = rows.filter(f"{x} IS NOT NULL AND {y} IS NOT NULL").groupBy(F.col(c).alias(f"_{name}")).agg(F.count(F.lit(1)).alias("n"))
        b = skew.with_blocks(g.withColumn("_all", F.lit(1)), ["_all"], f"_{name}")
        r = skew.running(b, ["_all"], [f"_{name}"], {"upto": F.col("n")})
        return r.select(f"_{name}", (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias(name))

    j = skew.lookup(skew.lookup(rows.select(F.col(x).alias("_rx"), F.col(y).alias("_ry")), ranks(x, "rx"), "_rx", "inner"), ranks(y, "ry"), "_ry", "inner")
    return j.agg(F.corr("rx", "ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def ema(rows: DataFrame, keys: list[str], order: list[str], column: str, alpha: float = 0.05) -> DataFrame:
    """Per key the exponential mean after the last row, e = alpha x + (1 - alpha) e, from e1 = x1. The
    weight of a row is a power of (1 - alpha) by its distance from the end, so the fold is a sum."""
    t = skew.running(skew.with_blocks(rows.filter(F.col(column).isNotNull()), keys, order[0]), keys, order, {"pos": F.lit(1)})
    n = t.groupBy(*keys).agg(F.max("pos").alias("n"))
    j = skew.lookup(t, n, keys[0], "inner") if len(keys) == 1 else t.join(n, keys)
    weight = F.pow(F.lit(1 - alpha), F.col("n") - F.col("pos")) * F.when(F.col("pos") == 1, F.lit(1.0)).otherwise(F.lit(alpha))
    return j.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(weight * F.col(column)).alias("ema"))


def adaptive(rows: DataFrame, key: str, order: list[str], column: str, start: float, deviations: float = 3.0, buffer: int = 100, warm: int = 10) -> DataFrame:
    """Storing by an adaptive threshold, per key in order: from the `warm`-th row on the threshold is
    .9 of itself and .1 of the mean of the last `buffer` values; a value is stored above it and at
    most `deviations` population deviations above that mean. The recursion is linear, so it is a sum
    with weights that are powers of .9, taken in blocks of PIECE rows plus the value at the end of
    the block before; what lies further back weighs less than 1e-22. No key is held as an array."""
    w = Window.partitionBy(key).orderBy(*order)
    near = w.rowsBetween(-(buffer - 1), 0)
    t = rows.select(key, *order, F.col(column).alias("_x"), F.row_number().over(w).alias("_pos"), F.avg(column).over(near).alias("_m"), F.stddev_pop(column).over(near).alias("_sd"))
    t = t.withColumn("_b", F.floor(F.col("_pos") / PIECE)).withColumn("_r", F.col("_pos") % PIECE)
    fade = lambda n: F.pow(F.lit(0.9), n)
    part = F.when(F.col("_pos") >= warm, F.col("_m") * fade(-F.col("_r"))).otherwise(F.lit(0.0))
    inside = Window.partitionBy(key, "_b").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_l", 0.1 * fade(F.col("_r")) * F.sum(part).over(inside))
    ends = t.filter(F.col("_r") == PIECE - 1).select(F.col(key).alias("_k"), (F.col("_b") + 1).alias("_kb"), F.col("_l").alias("_e"))
    t = t.join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")), "left")
    late = F.greatest(F.lit(0), F.col("_pos") - (warm - 1))
    threshold = F.col("_l") + fade(F.col("_r") + 1) * F.coalesce("_e", F.lit(0.0)) + fade(late) * start
    x = t.withColumn("threshold", threshold)
    return x.select(key, *order, "threshold", ((F.col("_x") > F.col("threshold")) & (F.col("_x") <= F.col("_m") + deviations * F.col("_sd"))).alias("stored"))


def recall(judged: DataFrame) -> DataFrame:
    """Per group: share found, mean relevance, share contaminated. judged: grp, kind, found, relevance, contaminated."""
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return judged.groupBy("grp", "kind").agg(F.count(F.lit(1)).alias("n"), mean("found").alias("recall"), mean("relevance").alias("relevance"), mean("contaminated").alias("contamination"))


def best_candidates(rows: DataFrame, key: str) -> DataFrame:
    """Per key the candidate with the greatest (passed, score, length), the first of equals. rows: key, idx, passed, score, length."""
    return rows.groupBy(key).agg(F.max_by(F.struct("idx", "passed", "score", "length"), F.struct("passed", "score", "length", -F.col("idx"))).alias("r")).select(key, "r.*")


def classify_errors(c):
    """context, oom, transient or other, by substring in this order."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.rlike("context length|maximum context|too many tokens"), "context").when(low.rlike("out of memory|oom"), "oom").when(low.rlike("timed out|timeout|connection|unreachable"), "transient").otherwise("other")


def recall_by_kind(judged: DataFrame) -> DataFrame:
    """Per kind the share of judgments that are right."""
    return judged.groupBy("kind").agg(F.avg(F.col("found").cast("double")).alias("recall"), F.count(F.lit(1)).alias("n"))


def index_to_first(curve: DataFrame, trial: str, value: str) -> DataFrame:
    """The curve with `ratio` to its first trial (null unless that is above 0): the last ratio is the
    index of what was kept. One row a trial."""
    base = curve.filter(F.col(trial) == 0).select(F.col(value).alias("_b")).scalar()
    return curve.withColumn("ratio", F.when(base > 0, F.col(value) / base))


def fixtures(contexts: DataFrame, expected: DataFrame) -> DataFrame:
    """Per fixture: recall (hits of its expected phrases), penalty (hits of forbidden ones), passed.
    contexts: fixture, context; expected: fixture, expected, forbidden (arrays)."""
    x = expected.join(contexts, "fixture", "left").withColumn("_c", F.lower(F.coalesce("context", F.lit(""))))
    share = lambda c, none: F.when(F.size(c) == 0, F.lit(none)).otherwise(F.size(F.filter(c, lambda p: F.contains(F.col("_c"), F.lower(p)))) / F.size(c))
    y = x.select("fixture", share("expected", 1.0).alias("recall"), share("forbidden", 0.0).alias("penalty"))
    return y.withColumn("passed", (F.col("recall") >= 1.0) & (F.col("penalty") == 0.0))


def fixture_summary(results: DataFrame) -> DataFrame:
    """One row: fixtures, mean recall and penalty, share passed (3 decimals)."""
    r = lambda c: F.round(F.avg(c), 3)
    return results.agg(F.count(F.lit(1)).alias("fixtures"), r("recall").alias("recall"), r("penalty").alias("penalty"), r(F.col("passed").cast("double")).alias("pass_rate"))


def clusters(rows: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Per key its rows and their first and last time."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def trials(facts: DataFrame, most: int, kinds: list[str]) -> DataFrame:
    """Every fact asked in every trial in every kind: bounded by two parameters per fact."""
    x = facts.select("id", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("trial"))
    return x.select("id", "trial", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
