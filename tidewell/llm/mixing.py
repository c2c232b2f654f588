"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer. The weights are the target shares of the sources that have
any text, as whole multiples of 1/GRAIN. Each source's documents are laid end to end in a fixed
random order, pass after pass up to its max_repeats, and cut into blocks of `block` tokens. Block j
of a source with weight w is released at floor((j-1)/w) and due by ceil(j/w) (Pfair windows); in
every slot the released block that is due first runs, so at no time is a source a whole block ahead
of or behind its share.

With weights in multiples of 1/GRAIN the schedule repeats every GRAIN slots: one period is worked
out (`period`), and the slot of every block follows from it in closed form, so the interleave of any
size is a join with at most GRAIN rows. Documents are numbered by running sums in blocks
(skew.running); a source that holds most of the rows is not one task.

The total is the largest for which no source must repeat a document more than max_repeats times,
unless `total` is given; then a source that runs out gives what it has. Sources are compared in
plain spelling. A null or unknown source, null or empty text and null doc_id take no part; repeated
rows are separate documents only if their doc_id differs; sources without text are reported with 0.
An empty documents table gives an empty mix.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import skew
from ..session import cut, spread

#: Weights are whole multiples of 1/GRAIN.
GRAIN = 10_000
#: The vocabulary that sizes are counted in, and its pattern for pieces.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("sizes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def plain(c: Column) -> Column:
    """A source name in lower case, with single underscores for blanks and dashes."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")
    return F.when(s != "", s)


def sized(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """documents(doc_id, source, text) -> doc_id, source (plain), tokens; one row per doc_id."""

    # the vocabulary travels with the job: only the driver needs the file
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            e = _encoding(SparkFiles.get(name), pattern)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": np.array([len(e.encode_ordinary(t)) for t in pdf["text"]], np.int64)})

    rows = documents.select(F.col("doc_id").cast("bigint"), plain(F.col("source")).alias("source"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND source IS NOT NULL AND text <> ''")
    return spread(rows).mapInPandas(run, "doc_id bigint, source string, tokens bigint").groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"))


def weights(shares: dict[str, float], grain: int = GRAIN) -> dict[str, int]:
    """Shares as multiples of 1/grain that sum to grain (largest remainders)."""
    whole = sum(shares.values())
    exact = {s: v / whole * grain for s, v in shares.items() if v > 0}
    out = {s: max(1, int(v)) for s, v in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s)):
        if sum(out.values()) >= grain:
            break
        out[s] += 1
    while sum(out.values()) > grain:
        out[max(out, key=lambda s: (out[s], s))] -= 1
    return out


def period(parts: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block from 1, slot from 0) of one period of the schedule: in each slot the released
    block with the earliest deadline, then the heavier source, then by name."""
    grain = sum(parts.values())
    done = dict.fromkeys(parts, 0)
    out = []
    for slot in range(grain):
        ready = [(-(-(done[s] + 1) * grain // p), -p, s) for s, p in parts.items() if done[s] < p and done[s] * grain // p <= slot]
        if not ready:
            continue
        due, _, s = min(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        done[s] += 1
        out.append((s, done[s], slot))
    return out


def _plan(docs: DataFrame, targets: DataFrame, total: int | None) -> tuple[list[dict], dict[str, int]]:
    """What each source has, may give and shall give; the weights. One row per target source."""
    have = {r.source: r.tokens for r in docs.groupBy("source").agg(F.sum("tokens").alias("tokens")).join(F.broadcast(targets.select(plain(F.col("source")).alias("source")).distinct()), "source").collect()}
    rows = [r.asDict() for r in targets.filter("source IS NOT NULL AND target_share > 0").select(plain(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()]
    for r in rows:
        r["tokens"] = int(have.get(r["source"], 0) or 0)
        r["most"] = r["tokens"] * max(0, r["max_repeats"] if r["max_repeats"] is not None else 1)
    live = {r["source"]: r["target_share"] for r in rows if r["most"] > 0}
    parts = weights(live) if live else {}
    grain = sum(parts.values())
    size = total if total is not None else min((r["most"] * grain // parts[r["source"]] for r in rows if r["source"] in parts), default=0)
    for r in rows:
        r["need"] = min(r["most"], size * parts.get(r["source"], 0) // grain if grain else 0)
    return rows, parts


def mix(documents: DataFrame, targets: DataFrame, block: int = 4096, total: int | None = None, seed: int = 0, tokenizer: str = TOKENIZER) -> DataFrame:
    """slot, source, place (of the document's use within its source), doc_id, use (from 1), tokens:
    reading by slot and place gives the interleaved mix."""
    docs = cut(sized(documents, tokenizer), "sized")
    spark = docs.sparkSession
    rows, parts = _plan(docs, targets, total)
    grain = max(1, sum(parts.values()))
    plan = F.broadcast(spark.createDataFrame([(r["source"], r["tokens"], r["need"], parts.get(r["source"], 0)) for r in rows], "source string, _all bigint, _need bigint, _part bigint"))
    slots = F.broadcast(spark.createDataFrame(period(parts), "source string, _block_in bigint, _slot bigint") if parts else spark.createDataFrame([], "source string, _block_in bigint, _slot bigint"))
    d = docs.filter("tokens > 0").join(plan, "source").filter("_need > 0").withColumn("_order", F.xxhash64(F.lit(seed), "doc_id"))
    d = skew.with_blocks(d, ["source"], "_order")
    d = skew.running(d, ["source"], ["_order", "doc_id"], {"_end": F.col("tokens")}).withColumn("_start", F.col("_end") - F.col("tokens"))
    # a document is used in each pass that still begins it before the source's need is met
    uses = F.ceil((F.col("_need") - F.col("_start")) / F.col("_all"))
    d = d.filter("_start < _need").withColumn("use", F.explode(F.sequence(F.lit(1), uses.cast("int"))))
    d = d.withColumn("place", F.col("_start") + (F.col("use") - 1) * F.col("_all"))
    j = (F.col("place") / F.lit(block)).cast("bigint")
    d = d.withColumn("_block_in", j % F.col("_part") + 1).withColumn("_round", (j / F.col("_part")).cast("bigint"))
    return d.join(slots, ["source", "_block_in"]).select((F.col("_round") * grain + F.col("_slot")).alias("slot"), "source", "place", "doc_id", "use", "tokens")


def report(documents: DataFrame, targets: DataFrame, **how) -> DataFrame:
    """Per target source: target_share, max_repeats, tokens it has, documents and tokens used, the
    most uses of one document, and the share reached."""
    m = mix(documents, targets, **how)
    used = m.groupBy("source").agg(F.count_distinct("doc_id").alias("documents"), F.sum("tokens").alias("used_tokens"), F.max("use").cast("int").alias("most_uses"))
    whole = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))  # one row per target source
    t = targets.filter("source IS NOT NULL").select(plain(F.col("source")).alias("source"), "target_share", "max_repeats")
    return t.join(used, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce(F.col("used_tokens") / whole, F.lit(0.0)).alias("reached_share"))
