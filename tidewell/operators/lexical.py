"""Lexical search: postings, BM25, and the re-rankings on top of it.

Postings are one row per term and document, made in one pass; document counts and the mean length
are aggregates. Queries are a small table (query_id, query); its terms are broadcast, since their
number has the bound MAX_QUERY_TERMS, checked before. Null texts are empty documents; documents and
queries without terms match nothing; ties go by id; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as S
from ..functions import text as T

K1, B = 1.2, 0.75
MAX_QUERY_TERMS = 100_000


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, id, tf, dl of docs(id, text)."""
    words = F.regexp_extract_all(F.lower(T.text(text)), F.lit("[a-z0-9_]+"), F.lit(0))
    return docs.select("id", F.size(words).alias("dl"), F.explode(words).alias("term")).groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: the distinct words of each query."""
    return queries.select("query_id", F.explode(T.match_terms(F.col("query"))).alias("term"))


def bm25(docs: DataFrame, queries: DataFrame, text: str = "text") -> DataFrame:
    """query_id, id, bm25 (positive; larger is better) of every document that holds a query term.
    Only postings of query terms leave the scan: the broadcast join comes before the shuffle."""
    terms = query_terms(queries)
    # what has at most one row per query term is broadcast only while there are few of them
    small = F.broadcast if terms.limit(MAX_QUERY_TERMS + 1).count() <= MAX_QUERY_TERMS else (lambda x: x)
    words = F.regexp_extract_all(F.lower(T.text(text)), F.lit("[a-z0-9_]+"), F.lit(0))
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(words)).alias("mean"))
    flat = docs.select("id", F.size(words).alias("dl"), F.explode(words).alias("term")).join(small(terms.select("term").distinct()), "term", "left_semi")
    p = flat.groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, mean = size.select("n").scalar(), size.select("mean").scalar()
    idf = F.greatest(F.lit(1e-6), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    s = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
    return p.join(small(df), "term").join(small(terms), "term").groupBy("query_id", "id").agg(F.sum(s).alias("bm25"))


def top(scored: DataFrame, n: int, score: str = "score", key: str = "query_id") -> DataFrame:
    """The n best rows of each query, with `rank` from 1; ties by id."""
    w = Window.partitionBy(key).orderBy(F.desc(score), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def retrieve_cold(docs: DataFrame, queries: DataFrame, as_of: float, n: int = 10, half_life_days: float = 30.0) -> DataFrame:
    """The archive searched: the max(50, 10 n) best by BM25 are candidates, ranked by 1 + .35 recency
    + .20 importance. docs: id, text, ts, metadata_json."""
    cand = top(bm25(docs, queries), max(50, 10 * n), "bm25").select("query_id", "id", F.round("bm25", 9).alias("bm25"))
    imp = S.unit(S.or_default(F.expr("try_cast(get_json_object(metadata_json, '$.importance') AS DOUBLE)"), 0.5))
    score = 1.0 + 0.35 * S.half_life(S.age_days(as_of, F.col("ts")), half_life_days) + 0.20 * imp
    return top(cand.join(docs.select("id", F.round(score, 9).alias("score")), "id"), n)


def semantic_live(facts: DataFrame, queries: DataFrame, n: int = 8, per_type: int = 20) -> DataFrame:
    """Facts by .6 of their BM25 relative to the query's best plus .4 of the overlap, at most 1."""
    best = top(bm25(facts, queries, "content").withColumn("bm25", F.round("bm25", 9)), per_type, "bm25").withColumn("top", F.max("bm25").over(Window.partitionBy("query_id"))).drop("rank")
    x = best.join(facts.select("id", "content"), "id").join(queries, "query_id")
    s = F.least(F.lit(1.0), 0.6 * F.col("bm25") / F.col("top") + 0.4 * T.overlap(T.long_set(F.col("query")), T.long_set(F.col("content"))))
    return top(x.select("query_id", "id", F.round(s, 9).alias("score")), n)


def contains_any(docs: DataFrame, queries: DataFrame, text: str, n: int) -> DataFrame:
    """Documents that contain any of a query's long words as a substring, scored by coverage and
    density of the words; score 0 is dropped. A word made of token characters occurs in a text only
    within one of its tokens, so words are tested against the distinct tokens alone (a stated query
    set against the vocabulary), and the tokens that hold one lead back to their documents by key."""
    q = queries.select("query_id", F.array_distinct(T.long_tokens(F.col("query"))).alias("_qw")).filter(F.size("_qw") > 0)
    tokens = docs.select("id", F.explode(F.array_distinct(T.raw_tokens(F.col(text)))).alias("_tok"))
    words = q.select("query_id", F.explode("_qw").alias("_w"))
    few = words.limit(MAX_QUERY_TERMS + 1).count() <= MAX_QUERY_TERMS
    held = tokens.select("_tok").distinct().join(F.broadcast(words) if few else words, F.contains("_tok", F.col("_w"))).select("query_id", "_tok").distinct()
    hit = tokens.join(held, "_tok").select("query_id", "id").distinct()
    x = hit.join(docs.select("id", F.col(text).alias("_text")), "id").join(q, "query_id")
    return top(x.withColumn("score", F.round(T.coverage_score(F.col("_qw"), T.long_tokens(F.col("_text"))), 9)).filter("score > 0").select("query_id", "id", "score"), n)


def by_overlap(docs: DataFrame, queries: DataFrame, text: str, n: int) -> DataFrame:
    """The n documents of each query that hold the largest share of its long words (none held: no
    row). Words meet in an equi-join, so no document is set against a query it shares nothing with."""
    q = queries.select("query_id", F.explode(T.long_set(F.col("query"))).alias("term")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    d = docs.select("id", F.explode(T.long_set(F.col(text))).alias("term"))
    x = d.join(F.broadcast(q.limit(MAX_QUERY_TERMS)), "term") if q.limit(MAX_QUERY_TERMS + 1).count() <= MAX_QUERY_TERMS else d.join(q, "term")
    return top(x.groupBy("query_id", "id").agg(F.round(F.count(F.lit(1)) / F.max("_n"), 9).alias("score")), n)
