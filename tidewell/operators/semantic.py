"""The semantic layer: facts, preferences, events and typed relations, searched together.

Facts have id, content, confidence, source, ts; preferences id, category, value, strength, ts; events
id, summary, detail, importance, ts. Null texts are empty and match nothing; ties go by type, then
id. What is set against every query (the newest rows of a type) has a bound that is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as S
from ..functions import text as T
from . import lexical, records

#: The order of the types where scores are equal.
ORDER = {"fact": 0, "preference": 1, "event": 2, "typed_relation": 3, "graph_context": 4}


def _rows(df: DataFrame, kind: str) -> DataFrame:
    """The common shape of a type: type, id, text (what is searched), said (what is shown), category, quality, ts."""
    none = F.lit(None).cast("string")
    if kind == "fact":
        text, said, category, quality = T.text("content"), T.text("content"), none, S.or_default(F.col("confidence"), 0.62)
    elif kind == "preference":
        text = F.concat(T.text("category"), F.lit(" "), T.text("value"))
        said = F.concat(F.lit("Preference ("), F.coalesce("category", F.lit("general")), F.lit("): "), T.text("value"))
        category, quality = F.lower(F.coalesce("category", F.lit("general"))), S.or_default(F.col("strength"), 0.5)
    else:
        text = F.concat(T.text("summary"), F.lit(" "), T.text("detail"))
        said, category, quality = F.coalesce(T.first_nonempty(F.col("summary"), F.col("detail")), F.lit("")), none, S.or_default(F.col("importance"), 0.6)
    return df.select(F.lit(kind).alias("type"), "id", text.alias("text"), F.regexp_replace(said, r"^\s+|\s+$", "").alias("said"), category.alias("category"), quality.cast("double").alias("quality"), "ts")


def _newest_overlap(df: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """Each of the `most` newest rows with its overlap for each stated query; zeros are kept."""
    newest = F.broadcast(df.orderBy(F.desc("ts"), "id").limit(most))
    # `most` rows against the stated queries: bounded on both sides
    both = queries.select("query_id", T.long_set(F.col("query")).alias("_q")).crossJoin(newest)
    return both.withColumn("match", F.round(F.round(T.overlap(F.col("_q"), T.long_set(F.col("text"))), 9), 4)).drop("_q")


def top(scored: DataFrame, n: int, score: str = "match") -> DataFrame:
    """The n best of each query over all types, with `rank`."""
    order = F.coalesce(*[F.when(F.col("type") == k, i) for k, i in ORDER.items()])
    w = Window.partitionBy("query_id").orderBy(F.desc(score), order, "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def search_preferences(preferences: DataFrame, queries: DataFrame, n: int = 20, most: int = 100) -> DataFrame:
    """The newest `most` preferences by overlap with category and value; zeros are kept."""
    return top(_newest_overlap(_rows(preferences, "preference"), queries, most), n)


def search(facts: DataFrame, preferences: DataFrame, events: DataFrame, queries: DataFrame, n: int = 20, per_type: int = 60) -> DataFrame:
    """query_id, type, id, match (4 decimals), said, category, quality, ts, rank. Facts by .6 of their
    BM25 relative to the query's best plus .4 of the overlap; preferences and events, the newest
    `per_type`, by overlap, zeros kept."""
    fact = _rows(facts, "fact")
    live = lexical.semantic_live(facts, queries, per_type, per_type).select("query_id", "id", F.round("score", 4).alias("match"))
    found = live.join(fact, "id").unionByName(_newest_overlap(_rows(preferences, "preference"), queries, per_type)).unionByName(_newest_overlap(_rows(events, "event"), queries, per_type))
    return top(found, n)


def mentions_category(terms: Column, category: Column) -> Column:
    """A query's terms name the category."""
    return F.size(F.array_intersect(terms, T.split_tokens(category))) > 0


def candidates(facts: DataFrame, preferences: DataFrame, events: DataFrame, queries: DataFrame, as_of: float, n: int = 8, per_type: int = 60, least: float = 0.08, affinity: DataFrame | None = None) -> DataFrame:
    """query_id, id, type, layer, text, tokens, score of the semantic layer. Facts and events below the
    least overlap are dropped; a preference stays if its category is named, which adds .04, and only
    the best of a category stays. affinity: query_id, id, affinity, weighted .08 where positive."""
    x = search(facts, preferences, events, queries, max(3 * n, 12), per_type)
    x = x.join(queries.select("query_id", T.expanded(T.split_tokens(F.col("query"))).alias("_q")), "query_id")
    if affinity is not None:
        x = x.join(affinity.select("query_id", "id", "affinity"), ["query_id", "id"], "left")
    else:
        x = x.withColumn("affinity", F.lit(0.0))
    lex = F.greatest(T.overlap(F.col("_q"), T.split_tokens(F.col("said"))), F.col("match"))
    preference = F.col("type") == "preference"
    named = preference & mentions_category(F.col("_q"), F.col("category"))
    score = (
        0.52 * lex + 0.28 * F.col("quality") + 0.12 * S.linear(S.age_days(as_of, F.col("ts")), 180.0) + 0.08 * T.density(F.col("_q"), F.col("said"))
        + 0.08 * F.greatest(F.lit(0.0), F.coalesce("affinity", F.lit(0.0))) + F.when(named, 0.04).otherwise(0.0)
    )
    y = x.filter((lex >= least) | named).withColumn("score", F.round(score, 9))
    best = y.filter(preference).withColumn("_k", F.concat_ws("\x00", F.col("query_id").cast("string"), "category")).withColumn("_r", F.format_string("%06d", F.col("rank")))
    one = records.best_per_group(best, "_k", "score", "_r").drop("_k", "_r")
    kept = top(y.filter(~preference).unionByName(one).drop("rank"), max(n, 1), "score")
    return kept.select("query_id", "id", "type", F.lit("semantic").alias("layer"), F.col("said").alias("text"), F.greatest(F.lit(1), T.tokens_estimate(F.col("said"))).alias("tokens"), "score")


def typed_edges(relations: DataFrame, preferences: DataFrame, facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations joined to both their ends: relation, subject_text, entity_text, confidence.
    relations: subject (a preference or fact id), relation, object_id, confidence; entities: object_id, object."""
    e = entities.select("object_id", F.col("object").alias("entity_text")).groupBy("object_id").agg(F.min("entity_text").alias("entity_text"))
    ends = preferences.select(F.col("id").alias("subject"), F.lit("PREFERS").alias("_of"), F.col("value").alias("subject_text")).unionByName(facts.select(F.col("id").alias("subject"), F.lit("other").alias("_of"), F.col("content").alias("subject_text")))
    r = relations.select("subject", "relation", "object_id", "confidence").withColumn("_of", F.when(F.col("relation") == "PREFERS", "PREFERS").otherwise("other"))
    return r.join(ends, ["subject", "_of"]).join(e, "object_id").select("subject", "relation", "subject_text", "entity_text", "confidence")


def search_edges(edges: DataFrame, queries: DataFrame, n: int = 20) -> DataFrame:
    """query_id, type, id, match, said, rank: typed edges by coverage of the query's long words times
    confidence. Words meet in an equi-join; what shares no word is never scored."""
    said = F.when(F.col("relation") == "PREFERS", F.concat(F.lit("Prefers "), T.text("subject_text"), F.lit(" (related to "), "entity_text", F.lit(")"))).when(F.col("relation") == "USES", F.concat(F.lit("Uses: "), "entity_text")).otherwise(F.concat(F.lit("Knows about: "), "entity_text"))
    own = T.long_set(F.concat_ws(" ", "subject_text", "entity_text"))
    e = edges.withColumn("id", F.concat_ws(":", "subject", "relation", "entity_text")).withColumn("said", said)
    words = e.select("id", "said", "confidence", F.explode(own).alias("term"), F.size(own).alias("_t"))
    q = queries.select("query_id", F.explode(T.long_set(F.col("query"))).alias("term"), F.size(T.long_set(F.col("query"))).alias("_q"))
    hit = words.join(q, "term").groupBy("query_id", "id", "said", "confidence").agg(F.count(F.lit(1)).alias("h"), F.max("_q").alias("_q"), F.max("_t").alias("_t"))
    score = F.least(F.lit(1.0), 0.7 * F.col("h") / F.col("_q") + 0.3 * F.col("h") / F.col("_t")) * F.col("confidence")
    return top(hit.select("query_id", F.lit("typed_relation").alias("type"), "id", "said", F.round(score, 9).alias("match")), n)


def search_all(facts: DataFrame, preferences: DataFrame, events: DataFrame, edges: DataFrame, queries: DataFrame, n: int = 20, context: DataFrame | None = None) -> DataFrame:
    """The graph search: every type by substring, coverage and density (zeros dropped), typed edges, and
    graph context (query_id, sentences, context), as one ranking; a text told twice counts once."""
    parts = [
        lexical.contains_any(_rows(df, kind), queries, "text", max(n, 8)).select("query_id", "id", F.col("score").alias("match")).join(_rows(df, kind).select("id", "type", "said"), "id")
        for df, kind in ((preferences, "preference"), (events, "event"), (facts, "fact"))
    ]
    parts.append(search_edges(edges, queries, max(n, 8)).drop("rank"))
    if context is not None:
        parts.append(context.select("query_id", F.lit("graph_context").alias("type"), F.lit("graph").alias("id"), F.col("context").alias("said"), F.lit(0.5).alias("match")))
    out = parts[0].select("query_id", "type", "id", "said", "match")
    for p in parts[1:]:
        out = out.unionByName(p.select("query_id", "type", "id", "said", "match"))
    out = out.withColumn("_k", F.concat_ws("\x00", F.col("query_id").cast("string"), T.normal(F.col("said")))).withColumn("_t", F.concat_ws(":", F.coalesce(*[F.when(F.col("type") == k, F.lit(i)) for k, i in ORDER.items()]).cast("string"), "id"))
    return top(records.best_per_group(out, "_k", "match", "_t").drop("_k", "_t"), n)
