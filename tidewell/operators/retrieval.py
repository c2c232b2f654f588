"""Unified retrieval: candidates of the episodic, semantic and cold layers, a fallback gate, and
greedy selection under budgets. Everything runs for many queries at once.

Queries are a stated set (query_id, query); candidates of each layer are limited per query before
they are scored, so what the greedy fold sees is bounded. Null texts score 0; ties go
by layer and id; a query without terms selects by importance and recency alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..session import cut
from . import lexical, working
from . import semantic as layer

#: Tokens per layer.
CAPS = {"working": 1000, "episodic": 800, "semantic": 400, "cold": 400}


def _terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "query", T.expanded(T.split_tokens(F.col("query"))).alias("terms"))


def episodic(episodes: DataFrame, queries: DataFrame, as_of: float, n: int = 5, affinity: DataFrame | None = None, ranked: DataFrame | None = None) -> DataFrame:
    """query_id, id, layer, text, tokens, score. `ranked` (query_id, id, rank from 1) is the vector
    search's answer; without it the max(3 n, n + 5) best by BM25 stand for it. The rank counts against
    the score; affinity (query_id, id, affinity) for it, weighted .08 where positive."""
    cand = ranked.select("query_id", "id", "rank") if ranked is not None else lexical.top(lexical.bm25(episodes, queries).withColumn("bm25", F.round("bm25", 9)), max(3 * n, n + 5), "bm25")
    x = cand.join(episodes.select("id", "text", "importance", "ts"), "id").join(_terms(queries), "query_id")
    lex, dens = T.overlap(F.col("terms"), T.split_tokens(F.col("text"))), T.density(F.col("terms"), F.col("text"))
    score = 0.50 * lex + 0.28 * S.or_default(F.col("importance"), 0.5) + 0.16 * S.two_scale(S.age_days(as_of, F.col("ts"))) + 0.06 * dens - 0.02 * (F.col("rank") - 1)
    if affinity is not None:
        x = x.join(affinity.select("query_id", "id", "affinity"), ["query_id", "id"], "left")
        score = score + 0.08 * F.greatest(F.lit(0.0), F.coalesce("affinity", F.lit(0.0)))
    return x.select("query_id", "id", F.lit("episodic").alias("layer"), "text", F.greatest(F.lit(1), T.tokens_estimate(F.col("text"))).alias("tokens"), F.round(score, 9).alias("score"))


def semantic(facts: DataFrame, queries: DataFrame, as_of: float, n: int = 8, least: float = 0.08) -> DataFrame:
    """Facts by overlap (or their search score), confidence, recency and density."""
    m = lexical.semantic_live(facts, queries, max(3 * n, 12)).select("query_id", "id", F.col("score").alias("match"))
    x = m.join(facts.select("id", F.col("content").alias("text"), "confidence", "ts"), "id").join(_terms(queries), "query_id")
    lex = F.greatest(T.overlap(F.col("terms"), T.split_tokens(F.col("text"))), F.col("match"))
    score = 0.52 * lex + 0.28 * S.or_default(F.col("confidence"), 0.62) + 0.12 * S.linear(S.age_days(as_of, F.col("ts")), 180.0) + 0.08 * T.density(F.col("terms"), F.col("text"))
    y = x.filter(lex >= least).select("query_id", "id", F.lit("semantic").alias("layer"), "text", F.greatest(F.lit(1), T.tokens_estimate(F.col("text"))).alias("tokens"), F.round(score, 9).alias("score"))
    return lexical.top(y, n).drop("rank")


def cold(archive: DataFrame, queries: DataFrame, as_of: float, n: int = 5) -> DataFrame:
    """Archived texts by overlap, recency over a year and density, from a base of .10."""
    c = lexical.retrieve_cold(archive, queries, as_of, n).select("query_id", "id")
    x = c.join(archive.select("id", "text", "ts"), "id").join(_terms(queries), "query_id")
    score = 0.42 * T.overlap(F.col("terms"), T.split_tokens(F.col("text"))) + 0.10 * S.linear(S.age_days(as_of, F.col("ts")), 365.0) + 0.08 * T.density(F.col("terms"), F.col("text")) + 0.10
    return x.select("query_id", "id", F.lit("cold").alias("layer"), "text", F.greatest(F.lit(1), T.tokens_estimate(F.col("text"))).alias("tokens"), F.round(score, 9).alias("score"))


def needs_cold(candidates: DataFrame, queries: DataFrame, budget: int, working: int = 1000, fill: float = 0.2) -> DataFrame:
    """The query_ids without semantic candidates whose episodic tokens fall short."""
    est = min(CAPS["episodic"], max(0, budget - working))
    g = candidates.groupBy("query_id").agg(F.sum((F.col("layer") == "semantic").cast("int")).alias("sem"), F.coalesce(F.sum(F.when(F.col("layer") == "episodic", F.col("tokens"))), F.lit(0)).alias("tok"))
    q = queries.select("query_id").join(g, "query_id", "left").fillna(0, ["sem", "tok"])
    return q.filter((F.col("sem") == 0) & ((F.col("tok") == 0) | ((F.lit(est) > 0) & (F.col("tok") < int(est * fill))))).select("query_id")


def select(candidates: DataFrame, budget: int, duplicate: float = 0.84, similar: float = 0.45, penalty: float = 0.08, most_penalty: float = 0.18) -> DataFrame:
    """Greedy choice per query: in order of score a candidate is taken unless it is blank, equal or
    nearly equal to one taken, over its layer's cap or the budget, or worth nothing after the penalty
    for its likeness to what was taken. A fold over the candidates of a query, whose number the
    limits of their layers bound; a column _budget gives a query a budget of its own."""
    order = F.when(F.col("layer") == "episodic", 0).when(F.col("layer") == "semantic", 1).otherwise(2)
    c = candidates.withColumn("_o", order).withColumn("_n", T.normal(F.col("text"))).withColumn("_t", T.split_tokens(F.col("text")))
    own = F.max("_budget") if "_budget" in candidates.columns else F.lit(budget)
    packed = c.groupBy("query_id").agg(own.cast("int").alias("_left"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "_o", "id", "layer", "tokens", "_n", "_t"))).alias("c"))
    kind = "struct<id:string,layer:string,tokens:int,_n:string,_t:array<string>,adjusted:double>"
    init = F.struct(F.array().cast(f"array<{kind}>").alias("took"), F.col("_left").alias("left"))

    def used(took: Column, layer: Column) -> Column:
        return F.aggregate(F.filter(took, lambda t: t["layer"] == layer), F.lit(0), lambda a, t: a + t["tokens"])

    def step(acc: Column, x: Column) -> Column:
        cap = F.when(x["layer"] == "episodic", CAPS["episodic"]).when(x["layer"] == "semantic", CAPS["semantic"]).otherwise(CAPS["cold"])
        best = F.coalesce(F.array_max(F.transform(acc["took"], lambda t: T.jaccard(t["_t"], x["_t"]))), F.lit(0.0))
        # a one-element array binds the likeness once
        def decide(b: Column) -> Column:
            adjusted = -x["s"] - F.when(b < similar, F.lit(0.0)).otherwise(F.least(F.lit(most_penalty), b * penalty))
            ok = (x["_n"] != "") & ~F.exists(acc["took"], lambda t: t["_n"] == x["_n"]) & ((b < duplicate) | (F.size(acc["took"]) == 0)) & (used(acc["took"], x["layer"]) + x["tokens"] <= cap) & (x["tokens"] <= acc["left"]) & (adjusted > 0)
            one = F.struct(x["id"].alias("id"), x["layer"].alias("layer"), x["tokens"].alias("tokens"), x["_n"].alias("_n"), x["_t"].alias("_t"), adjusted.alias("adjusted"))
            return F.when(ok, F.struct(F.concat(acc["took"], F.array(one)).alias("took"), (acc["left"] - x["tokens"]).cast("int").alias("left"))).otherwise(acc)

        return F.element_at(F.transform(F.array(best), decide), 1)

    fold = F.aggregate("c", init, step)
    return packed.select("query_id", F.posexplode(fold["took"]).alias("place", "t")).select("query_id", "place", "t.id", "t.layer", "t.tokens", F.round("t.adjusted", 9).alias("score"))


def retrieve(episodes: DataFrame, facts: DataFrame, archive: DataFrame, queries: DataFrame, as_of: float, budget: int = 1600, preferences: DataFrame | None = None, events: DataFrame | None = None, turns: DataFrame | None = None, affinity: DataFrame | None = None) -> DataFrame:
    """The whole: query_id, place, id, layer, tokens, score. If queries have a session_id and turns are
    given, the working window of the session comes first (at most CAPS of it, its score null) and
    what it uses is off the budget; then episodic and semantic candidates, cold ones for the queries
    that need them, are selected. An empty query gets the working window alone."""
    asked = queries.filter(T.text("query") != "")
    sem = semantic(facts, asked, as_of) if preferences is None or events is None else layer.candidates(facts, preferences, events, asked, as_of, affinity=affinity).drop("type")
    # read by the gate and by the selection
    warm = cut(episodic(episodes, asked, as_of, affinity=affinity).unionByName(sem), "warm")
    more = cold(archive, asked, as_of).join(needs_cold(warm, asked, budget), "query_id", "left_semi")
    found = warm.unionByName(more)
    if turns is None or "session_id" not in queries.columns:
        return select(found, budget)
    window = working.context_window(turns, min(CAPS["working"], budget))
    mine = cut(queries.select("query_id", "session_id").join(window, "session_id"), "window")
    used = mine.groupBy("query_id").agg(F.max("used").alias("_used"))
    chosen = select(found.join(used, "query_id", "left").withColumn("_budget", F.greatest(F.lit(0), F.lit(budget) - F.coalesce("_used", F.lit(0)))).drop("_used"), budget)
    first = mine.select("query_id", (F.col("rank") - 1).alias("place"), F.col("id").cast("string").alias("id"), F.lit("working").alias("layer"), F.col("tokens").cast("int").alias("tokens"), F.lit(None).cast("double").alias("score"))
    return first.unionByName(chosen.select("query_id", "place", F.col("id").cast("string").alias("id"), "layer", F.col("tokens").cast("int").alias("tokens"), "score"))
