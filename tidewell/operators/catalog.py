"""Listings of models: duplicates merged, ranked, matched and rated; and a breaker over call logs.

Listings have repo_id, seen (order of arrival), downloads, likes, pipeline_tag, tags and has_* flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

FLAGS = ["has_gguf", "has_safetensors", "has_awq", "has_gptq", "has_exl2"]
#: Words by which a name tells that weights are quantized, pipelines of text models, remote backends.
QUANTIZED = ["gguf", "awq", "gptq", "exl2", "int4", "int8", "4bit", "8bit", "q4", "q5", "q8"]
PIPELINES = ["text-generation", "text2text-generation", "conversational"]
REMOTE = ["anthropic", "claude", "openai", "openai-compatible", "openai_compatible"]


def merged(listings: DataFrame) -> DataFrame:
    """One row per repo_id: the most downloads and likes, the first pipeline, any flag, the union of
    the tags in the order they were first seen. Equal tags of one repository are few."""
    g = listings.groupBy("repo_id").agg(
        F.max(F.coalesce("downloads", F.lit(0))).alias("downloads"), F.max(F.coalesce("likes", F.lit(0))).alias("likes"),
        F.min_by("pipeline_tag", F.when(F.col("pipeline_tag") != "", F.col("seen"))).alias("pipeline_tag"), *[F.max(F.coalesce(x, F.lit(False))).alias(x) for x in FLAGS],
    )
    t = listings.select("repo_id", "seen", F.posexplode("tags").alias("_i", "_t")).groupBy("repo_id", "_t").agg(F.min(F.struct("seen", "_i")).alias("_o"))
    tags = t.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("_o", "_t"))).alias("_a")).select("repo_id", F.transform("_a", lambda x: x["_t"]).alias("tags"))
    return g.join(tags, "repo_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def artifact(gguf: Column, awq: Column, gptq: Column, exl2: Column) -> Column:
    """gguf, transformers_quantized, mixed or base."""
    other = awq | gptq | exl2
    return F.when(gguf & other, "mixed").when(gguf, "gguf").when(other, "transformers_quantized").otherwise("base")


def score(query: str, prefer_quantized: bool = False) -> Column:
    """How well a merged row answers a search: its terms in the name, popularity, format, pipeline."""
    name = F.lower("repo_id")
    blob = F.lower(F.concat_ws(" ", "repo_id", F.array_join("tags", " "), "pipeline_tag"))
    out = F.lit(0.0)
    for t in [t for t in "".join(c if c.isascii() and (c.isalnum() or c == ".") else " " for c in query.lower()).split() if t]:
        out = out + F.when((name == t) | (F.element_at(F.split(name, "/"), -1) == t), 60.0).when(F.contains(name, F.lit(t)), 20.0).when(F.contains(blob, F.lit(t)), 8.0).otherwise(0.0)
    quantized = F.col("has_gguf") | F.col("has_awq") | F.col("has_gptq") | F.col("has_exl2") | blob.rlike("|".join(QUANTIZED))
    return (
        out + F.least(F.log10(F.col("downloads") + 1) * 6, F.lit(30.0)) + F.least(F.log10(F.col("likes") + 1) * 4, F.lit(16.0))
        + F.when(quantized, 16.0 if prefer_quantized else 8.0).otherwise(0.0) + F.when(F.col("pipeline_tag").isin(*PIPELINES), 6.0).otherwise(0.0)
    )


def ranked(listings: DataFrame, query: str, n: int, prefer_quantized: bool = False) -> DataFrame:
    """The n best merged listings of a search."""
    return merged(listings).withColumn("score", F.round(score(query, prefer_quantized), 6)).orderBy(F.desc("score"), "repo_id").limit(n)


def size_b(c: Column) -> Column:
    """Billions of parameters that a name tells, null if none."""
    return F.nullif(F.regexp_extract(F.lower(T.text(c)), r"(\d+(?:\.\d+)?)\s*b", 1), F.lit("")).cast("double")


def fit(family: Column, size: Column, total_gb: Column, free_gb: Column, backend: Column) -> Column:
    """Whether a model runs here: remote, good, borderline, better_ollama, likely_oom, blocked_now, unknown."""
    s = F.coalesce(size, F.lit(0.0))
    by_size = F.when(s <= 16, "good").when(s <= 24, "borderline").when(s <= 32, "better_ollama").otherwise("likely_oom")
    base = F.when(family.isin("awq", "gptq", "exl2", "unknown"), by_size).otherwise("unknown")
    tight = F.when(free_gb.isNotNull() & (free_gb < 8) & base.isin("good", "borderline"), "blocked_now").otherwise(base)
    large = F.when((family == "gptq") & (s >= 30) & tight.isin("good", "borderline"), "better_ollama").otherwise(tight)
    return F.when(F.lower(F.trim(T.text(backend))).isin(*REMOTE), "remote").when(family == "gguf", "good").when(total_gb.isNull(), "unknown").otherwise(large)


def aliases(c: Column) -> Column:
    """Names a model goes by: as written, without organisation, tag, -awq or -instruct, with dashes."""
    raw = F.lower(F.trim(T.text(c)))
    strip = lambda x: F.regexp_replace(x, "^/+|/+$", "")
    every = F.array(raw, F.element_at(F.split(raw, "/"), -1), F.element_at(F.split(raw, ":"), -1), F.replace(raw, F.lit("-awq"), F.lit("")), F.replace(raw, F.lit("-instruct"), F.lit("")), F.replace(raw, F.lit("_"), F.lit("-")))
    return F.array_distinct(F.filter(F.transform(every, strip), lambda x: x != ""))


def same_model(a: Column, b: Column) -> Column:
    """Two names share an alias, or an alias of one ends with one of the other."""
    x, y = aliases(a), aliases(b)
    suffix = F.exists(x, lambda p: F.exists(y, lambda q: F.endswith(p, q) | F.endswith(q, p)))
    return (F.size(x) > 0) & (F.size(y) > 0) & (F.arrays_overlap(x, y) | suffix)


def trips(calls: DataFrame, key: str, failures: int = 3, cooldown: float = 30.0) -> DataFrame:
    """When a breaker opens per backend: the calls(key, id, ts, failed) at which the run of failures
    reaches `failures`, with the time until which it stays open. A success ends a run."""
    w = Window.partitionBy(key).orderBy("ts", "id")
    run = F.count(F.when(~F.col("failed"), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = calls.withColumn("_run", run).filter("failed")
    n = F.row_number().over(Window.partitionBy(key, "_run").orderBy("ts", "id"))
    return x.withColumn("_n", n).filter(F.col("_n") == failures).select(key, "id", F.col("ts").alias("opened"), (F.col("ts") + cooldown).alias("until"))
