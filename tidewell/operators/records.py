"""Row-level operators over the logical tables: scans, point lookups, upserts, deletes, JSON paths,
prompt texts. All of them are narrow or keyed; nulls pass through; empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.window import Window

from ..functions import text as T
from . import skew

#: Markers of the memory block in a prompt.
BEGIN, END = "----- BEGIN RETRIEVED MEMORY -----", "----- END RETRIEVED MEMORY -----"


def latest(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """The last writing of each key. Pre-aggregated map-side; equal times keep the largest row."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(ts, *[c for c in rest if c != ts])).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])


def upsert(table: DataFrame, changes: DataFrame, key: str, ts: str) -> DataFrame:
    """The table after the changes: the latest of both per key."""
    return latest(table.unionByName(changes, allowMissingColumns=True), key, ts)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def lookup_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_semi")


def newest(rows: DataFrame, n: int, ts: str = "ts", key: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(ts), key).limit(n)


def tagged_union(**tables: DataFrame) -> DataFrame:
    """All tables as one with a `type` column; columns that one lacks are null there."""
    out = None
    for name, df in tables.items():
        t = df.withColumn("type", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def cached_vectors(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of texts(id, text) against cache(key, vector), keyed by the SHA-256 of the text."""
    keyed = texts.withColumn("key", F.sha2(T.text("text"), 256))
    return keyed.join(cache, "key"), keyed.join(cache.select("key"), "key", "left_anti")


def similar_exists(new: DataFrame, old: DataFrame, least: float = 0.9) -> DataFrame:
    """new(id, content) with a row of another id in old(id, content) that is equal in tokens or whose
    sets of tokens have a Jaccard similarity of at least `least`. Rows of equal sets are one class and
    meet by its key; only classes are compared. Tokens are ordered from the rarest; two sets this
    similar share one of the first ceil-bounded (1 - least) n + 1 of them, so the equi-join on these
    prefixes loses none and never meets on a frequent token first."""
    def sets(df: DataFrame) -> DataFrame:
        t = df.filter("id IS NOT NULL").select("id", F.array_sort(F.array_distinct(T.raw_tokens(F.col("content")))).alias("_t")).filter(F.size("_t") > 0)
        return t.select("id", F.sha2(F.array_join("_t", "\x00"), 256).alias("_c"), "_t")

    n, o = sets(new), sets(old)
    holders = o.groupBy("_c").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"))
    other = (F.col("_lo") != F.col("id")) | (F.col("_hi") != F.col("id"))
    same = n.select("id", "_c").join(holders, "_c").filter(other).select("id")
    nc, oc = n.select("_c", "_t").dropDuplicates(["_c"]), o.select("_c", "_t").dropDuplicates(["_c"])
    flat = lambda c: c.select("_c", F.explode("_t").alias("_w"))
    freq = flat(nc).unionByName(flat(oc)).groupBy("_w").agg(F.count(F.lit(1)).alias("_f"))

    def prefix(c: DataFrame, name: str, key: str) -> DataFrame:
        packed = skew.lookup(flat(c), freq, "_w", "inner").groupBy("_c").agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "_w"))), lambda x: x["_w"]).alias(name))
        k = (F.size(name) - F.ceil(F.size(name) * F.lit(least)) + 1).cast("int")
        return packed.withColumnRenamed("_c", key).withColumn("_p", F.explode(F.slice(name, F.lit(1), k)))

    near = prefix(nc, "_x", "_c").join(prefix(oc, "_y", "_d"), "_p").filter((F.col("_c") != F.col("_d")) & (F.size("_x") >= least * F.size("_y")) & (F.size("_y") >= least * F.size("_x"))).filter(T.jaccard(F.col("_x"), F.col("_y")) >= least)
    pairs = near.select("_c", "_d").distinct().join(holders.withColumnRenamed("_c", "_d"), "_d")
    return same.unionByName(n.select("id", "_c").join(pairs, "_c").filter(other).select("id")).distinct()


def best_per_group(rows: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """The row of the greatest score per group, the smallest key of equals."""
    win = Window.partitionBy(group).orderBy(F.desc(score), key)
    return rows.withColumn("_n", F.row_number().over(win)).filter("_n = 1").drop("_n")


def relations_from_json(rows: DataFrame, types: list[str], least: float = 0.6) -> DataFrame:
    """id, type, subject, object, confidence out of JSON arrays in `json`, fences and text around them
    removed; bad JSON gives no rows."""
    s = Ty.ArrayType(Ty.StructType([Ty.StructField("type", Ty.StringType()), Ty.StructField("subject", Ty.StringType()), Ty.StructField("object", Ty.StringType()), Ty.StructField("confidence", Ty.DoubleType())]))
    core = F.regexp_extract(F.regexp_replace(T.text("json"), r"```(?:json)?", ""), r"(?s)(\[.*\])", 1)
    x = rows.select("id", F.explode(F.from_json(core, s)).alias("r")).select("id", "r.*")
    return x.filter(F.upper("type").isin(*types) & (F.col("confidence") >= least)).select("id", F.upper("type").alias("type"), F.substring("subject", 1, 160).alias("subject"), F.substring("object", 1, 80).alias("object"), "confidence")


def memory_block(c: Column) -> tuple[Column, Column, Column]:
    """(before, block, after) of a prompt; a block that is never closed runs to the end."""
    a, b = F.instr(c, BEGIN), F.instr(c, END)
    stop = F.when(b == 0, F.length(c) + 1).otherwise(b + len(END))
    ok = (a > 0) & ((b == 0) | (b >= a))
    return F.when(ok, F.substring(c, F.lit(1), a - 1)).otherwise(c), F.when(ok, F.substring(c, a, stop - a)).otherwise(""), F.when(ok & (b > 0), F.substring(c, stop, F.length(c))).otherwise("")


def without_memory(c: Column, summary: int | None = None) -> Column:
    """A prompt without its memory block, or with the block cut to a summary of so many characters."""
    before, block, after = memory_block(c)
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    if summary is None:
        return F.when(block == "", c).otherwise(strip(F.concat(before, after)))
    core = strip(F.regexp_replace(F.replace(F.replace(block, F.lit(BEGIN), F.lit("")), F.lit(END), F.lit("")), r"\s+", " "))
    short = F.when(F.length(core) <= summary, core).otherwise(F.concat(F.substring(core, 1, summary - 3), F.lit("...")))
    return F.when(block == "", c).otherwise(strip(F.concat(before, F.lit("Retrieved memory summary (minimized for cloud).\n"), short, F.lit("\n"), after)))


def without_reasoning(c: Column) -> Column:
    """What follows the first closing mark of a reasoning block, or the whole text (see prompts.answer for the whole rule)."""
    return F.regexp_replace(F.regexp_replace(T.text(c), r"(?s)\A.*?</think>", ""), r"^\s+|\s+$", "")


def json_in_text(c: Column) -> Column:
    """The content of the first code fence, or from the first brace or bracket to the last."""
    fence = F.regexp_extract(T.text(c), r"(?s)```(?:json)?\s*(.*?)```", 1)
    return T.first_nonempty(F.regexp_replace(fence, r"^\s+|\s+$", ""), F.regexp_extract(T.text(c), r"(?s)([\[{].*[\]}])", 1))


def fit_prompt(user: Column, working: Column, semantic: Column, episodic: Column, cold: Column, cap: int) -> Column:
    """The parts of a prompt under a cap of tokens: cold goes first, then episodic is cut, then
    working; semantic stays. An expression of estimated tokens, no model is asked."""
    tok = T.tokens_estimate
    rest = F.greatest(F.lit(32), F.lit(cap) - tok(user) - tok(semantic))
    whole = tok(working) + tok(episodic) + tok(cold) <= rest
    no_cold = tok(working) + tok(episodic) <= rest
    cut_epi = F.when(tok(working) < rest, T.within_tokens(episodic, (rest - tok(working)).cast("int"))).otherwise(F.lit(""))
    cut_work = T.within_tokens(working, rest.cast("int"))
    return F.struct(F.when(whole, cold).otherwise("").alias("cold"), F.when(no_cold, episodic).otherwise(cut_epi).alias("episodic"), F.when(no_cold | (tok(working) < rest), working).otherwise(cut_work).alias("working"), semantic.alias("semantic"))
