"""References to records that do not exist.

`orphans` classes every reference of a table against one or more parent tables. Keys may be
composite and partly null: references are grouped by their null mask, and each mask is
anti-joined on its non-null columns only, under declared match semantics:

- simple:  a reference with any null column refers to nothing and is never an orphan,
- partial: a reference matches a parent that agrees on its non-null columns,
- full:    a reference with some but not all columns null is an orphan by itself.

A reference whose columns are all null (or, with `empty_is_null`, empty) is no case in any of
the three. Parents are reduced to their distinct keys before any join; references are joined
with `skew.lookup`, so one hot key is spread over many tasks.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import skew


def plain_key(c: Column) -> Column:
    """A key without the blanks around it and in lower case; an empty one is null."""
    k = F.lower(F.regexp_replace(c.cast("string"), r"(?U)^[\s\x{200b}\x{feff}]+|[\s\x{200b}\x{feff}]+$", ""))
    return F.when(k != "", k)


def _mask(cols: list[str]) -> Column:
    return F.concat(*[F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.lit("1")) for c in cols])


def orphans(refs: DataFrame, ref_cols: list[str], parents: DataFrame, key_cols: list[str], match: str = "simple", born: str | None = None) -> DataFrame:
    """refs plus `_found` (boolean: a parent exists; null where the reference refers to nothing)
    and, where `born` names a column of parents, `_born` (the earliest value of the matching
    parents). Repeated rows of refs stay repeated; clashing names in parents do no harm, since
    only the key columns are read from there. An empty parents table makes every reference an orphan."""
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"match must be simple, partial or full, not {match!r}")
    n = len(ref_cols)
    ones, zeros = "1" * n, "0" * n
    # the masks under which a reference refers to something that can be looked up
    masks = ["".join(m) for m in product("01", repeat=n) if "1" in m] if match == "partial" else [ones]

    def key(mask: Column, cols: list[Column]) -> Column:
        # to_json of the parts is one-to-one, so unlike a plain concatenation it merges no two keys
        return cols[0].cast("string") if n == 1 else F.concat(mask, F.to_json(F.array(*[c.cast("string") for c in cols])))

    seen = parents.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(key_cols)], (F.col(born) if born else F.lit(None).cast("double")).alias("_b"))

    def under(mask: str) -> Column:
        """A parent's key under a mask, null if it lacks a column of it."""
        some = [i for i in range(n) if mask[i] == "1"]
        whole = F.lit(True)
        for i in some:
            whole = whole & F.col(f"_p{i}").isNotNull()
        return F.when(whole, key(F.lit(mask), [F.col(f"_p{i}") if i in some else F.lit(None).cast("string") for i in range(n)]))

    # one pass over either side: each parent once under every mask (at most 2^n - 1), each reference under its own
    side = seen.select(F.explode(F.array(*[under(m) for m in masks])).alias("_key"), "_b").filter("_key IS NOT NULL")
    side = side.groupBy("_key").agg(F.min("_b").cast("double").alias("_born"), F.lit(True).alias("_hit"))
    keyed = refs.withColumn("_mask", _mask(ref_cols))
    keyed = keyed.withColumn("_key", F.when(F.col("_mask").isin(*masks), key(F.col("_mask"), [F.col(c) for c in ref_cols])))
    mask = F.col("_mask")
    found = F.when(mask == zeros, F.lit(None).cast("boolean"))
    if match != "partial":
        found = found.when(mask != ones, F.lit(None).cast("boolean") if match == "simple" else F.lit(False))
    return skew.lookup(keyed, side, "_key").select(*refs.columns, found.otherwise(F.coalesce("_hit", F.lit(False))).alias("_found"), "_born")


def reference_states(log: DataFrame, episodes: DataFrame, archive: DataFrame) -> DataFrame:
    """Each distinct row of the access log with `state`: missing, deleted, late or ok; rows
    without an id are left out. Ids are compared without blanks around them and case. `late` means
    that the earliest row of the episode is younger than the first access; an unknown time on
    either side is not late. deleted: the id is in the archive only."""
    refs = log.select("log_id", plain_key(F.col("episode_id")).alias("ref"), F.col("first_accessed").cast("double").alias("at")).distinct()
    keys = episodes.select(plain_key(F.col("id")).alias("k"), F.col("timestamp").cast("double").alias("born"), F.lit(1).alias("live")).unionByName(
        archive.select(plain_key(F.col("id")).alias("k"), F.lit(None).cast("double").alias("born"), F.lit(0).alias("live"))
    )
    # one pass over both parents: the key is live if any of its rows is
    one = keys.filter("k IS NOT NULL").groupBy("k").agg(F.max("live").alias("live"), F.min("born").alias("born"))
    parents = one.select("k", F.when(F.col("live") == 1, F.coalesce("born", F.lit(float("-inf")))).otherwise(F.lit(float("inf"))).alias("born"))
    got = orphans(refs, ["ref"], parents, ["k"], born="born").filter(F.col("_found").isNotNull())
    state = (
        F.when(~F.col("_found"), "missing")
        .when(F.col("_born") == float("inf"), "deleted")
        .when(F.col("_born") > F.col("at"), "late")
        .otherwise("ok")
    )
    return got.select("log_id", "ref", "at", state.alias("state"))


def found(log: DataFrame, episodes: DataFrame, archive: DataFrame) -> DataFrame:
    """p3_found: distinct (log_id, state) of the references that are missing, deleted or late."""
    return reference_states(log, episodes, archive).filter("state <> 'ok'").select("log_id", "state").distinct()


def report(log: DataFrame, episodes: DataFrame, archive: DataFrame, table: str = "access_log") -> DataFrame:
    """Orphan references per table, month of first access (UTC; null where unknown) and state."""
    month = F.substring(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, at)").cast("string"), 1, 7)
    return (
        reference_states(log, episodes, archive)
        .groupBy(F.lit(table).alias("table_name"), month.alias("month"), "state")
        .agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("ref").alias("keys"))
    )


__all__ = ["orphans", "plain_key", "reference_states", "found", "report"]
