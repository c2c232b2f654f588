"""Joins and ordered numbering that survive a key holding a third of all rows.

Nothing here reads its input twice within a plan. Whether any group needs cutting is found by one
count over the key columns when the plan is built (pass `of`, the table a derived frame comes from,
to keep that count a pruned scan); in the usual case that none does, plain windows remain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: At most so many keys are treated as hot: what is broadcast or replicated for them has a proven bound.
HOT_KEYS = 1000
#: A hot key's rows go to so many tasks.
SALTS = 32


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot: Sequence = (), salts: int = SALTS) -> DataFrame:
    """left JOIN right USING (key), right unique by key, left of any skew: the skew join of adaptive
    execution splits what outgrows its task, null keys included, since right brings at most one row
    a key. Keys known beforehand to be hot can be named (HOT_KEYS at most): their rows are spread
    over `salts` tasks and their few right rows repeated for each."""
    if not len(hot):
        return left.join(right, key, how)
    if len(hot) > HOT_KEYS:
        raise ValueError(f"at most {HOT_KEYS} hot keys")
    is_hot = F.coalesce(F.col(key).isin(list(hot)), F.lit(False))
    over = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    l2 = left.withColumn("_salt", F.when(is_hot | F.col(key).isNull(), over).otherwise(F.lit(0)))
    r2 = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return l2.join(r2, [key, "_salt"], how).drop("_salt")


def with_blocks(df: DataFrame, keys: list[str], order: str, rows: int = 100_000, cuts: int = 512, of: DataFrame | None = None) -> DataFrame:
    """Adds _block: a number that never falls along `order` within keys, so that one long group
    becomes up to `cuts` windows of about equal size. Groups of at most `rows` rows have one block;
    so have those beyond the HOT_KEYS largest, each of which holds less than 1/HOT_KEYS of the rows.
    Rows with equal `order` share a block; the cuts are approximate, the order over them exact."""
    base = (df if of is None else of).select(*keys, order)
    large = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows).orderBy(F.desc("_n"), *keys).limit(HOT_KEYS).select(*keys).collect()
    if not large:
        return df.withColumn("_block", F.lit(0).alias("_block", metadata={"single": True}))
    spark = df.sparkSession
    kinds = T.StructType([T.StructField(f"_k{i}", base.schema[k].dataType) for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    named = [f"_k{i}" for i in range(len(keys))]
    some = base.join(F.broadcast(spark.createDataFrame([tuple(r) for r in large], kinds)), same)
    # HOT_KEYS x cuts numbers at most
    found = some.groupBy(*named).agg(F.percentile_approx(order, [i / cuts for i in range(1, cuts)], 2 * cuts).alias("_cuts")).collect()
    at = spark.createDataFrame([tuple(r) for r in found], T.StructType([*kinds.fields, T.StructField("_cuts", T.ArrayType(base.schema[order].dataType))]))
    below = F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col(order)))
    return df.join(F.broadcast(at), same, "left").withColumn("_block", F.when(F.col("_cuts").isNull() | F.col(order).isNull(), F.lit(0)).otherwise(below)).drop("_cuts", *named)


def _single(df: DataFrame) -> bool:
    """No group was cut."""
    return bool(df.schema["_block"].metadata.get("single"))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums of `sums` along `order` within keys over rows that carry _block (see
    with_blocks): windows within each block, plus the sums of the blocks before it."""
    if _single(df):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).cast(T.LongType()).alias(n) for n, c in sums.items()])
    inner = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = df
    for name, c in sums.items():
        part = part.withColumn(f"_v_{name}", c)
    totals = part.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # one row a block: at most `cuts` rows a key; a key of one block needs no totals
    offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_kb"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]).filter(F.col("_kb") > 0)
    cond = F.col("_block") == F.col("_kb")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = part
    for n in sums:
        out = out.withColumn(n, F.sum(f"_v_{n}").over(inner))
    out = out.join(F.broadcast(offsets), cond, "left")
    for n in sums:
        out = out.withColumn(n, (F.col(n) + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).cast(T.LongType()))
    return out.drop("_kb", *[f"_k{i}" for i in range(len(keys))], *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str = "_prev", where: Column | None = None) -> DataFrame:
    """Adds `name`: a struct of `columns` of the row before along `order` within keys (of the last one
    that meets `where`, if given), over rows that carry _block (see with_blocks); the last such row
    of each block is handed to the next one."""
    value = F.struct(*columns) if where is None else F.when(where, F.struct(*columns))
    take = (lambda w: F.lag(value).over(w)) if where is None else (lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    if _single(df):
        return df.withColumn(name, take(Window.partitionBy(*keys).orderBy(*order)))
    ends = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_kb")).agg(F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("_v")))).alias("_e"))
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)
    # one row a block of the keys that with_blocks cut: a bounded number
    carried = ends.withColumn("_carry", F.last("_e._v", ignorenulls=True).over(before)).filter("_kb > 0").drop("_e")
    cond = F.col("_block") == F.col("_kb")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = df.withColumn(name, take(Window.partitionBy(*keys, "_block").orderBy(*order))).join(F.broadcast(carried), cond, "left")
    return out.withColumn(name, F.coalesce(name, "_carry")).drop("_carry", "_kb", *[f"_k{i}" for i in range(len(keys))])
