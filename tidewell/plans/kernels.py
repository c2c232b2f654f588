"""Queries of the scalar kernels, over whole tables."""

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..sources import logical as L

AS_OF = 1708800000.0
_TOK = "regexp_extract_all(lower({c}), '[a-z0-9_./-]+')"
_LONG = "list_filter(" + _TOK + ", lambda x: length(x) > 2)"
_SPLIT = "list_distinct(list_filter(list_concat(" + _TOK + ", flatten(list_transform(" + _TOK + ", lambda x: regexp_split_to_array(x, '[._/-]+')))), lambda x: length(x) > 2))"
Q = "what did we decide about the session-store bug and python/asyncio retry queue?"


def tok(c):
    return _TOK.format(c=c)


def longs(c):
    return _LONG.format(c=c)


def split(c):
    return _SPLIT.format(c=c)


def _q(f):
    return lambda: f(F.lit(Q))


def k_tokens(s, d):
    c = F.col("content")
    return L.working(s, d).select("id", T.tokens_estimate(c).alias("estimate"), F.greatest(F.lit(1), T.tokens_estimate(c)).alias("at_least_one"), F.size(T.raw_tokens(c)).alias("raw"), F.size(T.long_tokens(c)).alias("long"), F.size(T.split_tokens(c)).alias("split"), T.words(c).alias("words"))


def k_overlap(s, d):
    c, q = F.col("content"), T.split_tokens(F.lit(Q))
    return L.working(s, d).select(
        "id", F.round(T.overlap(q, T.split_tokens(c)), 9).alias("overlap"), F.round(T.density(q, c), 9).alias("density"), F.round(T.jaccard(q, T.split_tokens(c)), 9).alias("jaccard"),
        F.round(T.jaccard(F.array_distinct(T.raw_tokens(F.lit(Q))), F.array_distinct(T.raw_tokens(c))), 9).alias("jaccard_raw"), F.round(T.coverage_score(T.long_tokens(F.lit(Q)), T.long_tokens(c)), 9).alias("coverage"),
    )


_N = r"regexp_replace(lower(regexp_replace(content, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"
_E = rf"""regexp_replace({_N}, '^[.,;:!?"''()-]+|[.,;:!?"''()-]+$', '', 'g')"""


def k_normal(s, d):
    c = F.col("content")
    e = T.entity(c)
    return L.working(s, d).select(
        "id", T.normal(c).alias("normal"), e.alias("entity"), T.is_entity(e).alias("is_entity"), T.digest(c, 16).alias("short_id"), T.pair_digest(F.col("role"), c).alias("pair"), T.category(c).alias("category"),
        T.looks_like_fact(c).alias("factlike"), T.within_tokens(c, 12).alias("head"), T.summary(c, 12).alias("summary"),
    )


def k_expand(s, d):
    c = F.col("content")
    return L.facts(s, d).select("id", F.array_join(F.array_sort(T.expanded(T.split_tokens(c))), " ").alias("terms"), T.expanded_query(F.concat(c, F.lit(" bug in python asyncio"))).alias("query"), F.array_join(F.array_sort(T.match_terms(c, 2)), " ").alias("match"))


def _syn(x):
    out = x
    for w, more in T.SYNONYMS.items():
        out = f"CASE WHEN list_contains(s, '{w}') THEN list_distinct(list_concat({out}, [{', '.join(repr(m) for m in more)}])) ELSE {out} END"
    return out


def k_recency(s, d):
    a = S.age_days(AS_OF, F.col("ts"))
    return L.episodes(s, d).select("id", "ts", F.round(S.two_scale(a), 9).alias("two_scale"), F.round(S.linear(a, 180.0), 9).alias("half_year"), F.round(S.linear(a, 365.0), 9).alias("year"), F.round(S.half_life(a, 30.0), 9).alias("half_life"), F.round(S.decay(a), 9).alias("decay"))


def k_prompt(s, d):
    e = L.episodes(s, d)
    block = F.concat(F.lit("----- BEGIN RETRIEVED MEMORY -----\n"), F.regexp_replace("text", r"^\s+|\s+$", ""), F.lit("\n----- END RETRIEVED MEMORY -----"))
    block = F.when(T.text("text") == "", F.lit("")).otherwise(block)
    return e.select("id", F.concat_ws("\n\n", F.when(block != "", block), F.lit("User: hello\nAssistant:")).alias("prompt"))


def k_perplexity(s, d):
    r = L.runs(s, d)
    return r.groupBy("task").agg(F.round(F.exp(-F.avg(-F.col("duration") / 100)), 9).alias("perplexity"), F.round(F.avg(-F.col("duration") / 100), 9).alias("mean_logprob"))


QUERIES = {
    "k1_k4_tokens": (k_tokens, L.SQL + f"SELECT id, (length(content) // 4)::INT AS estimate, greatest(1, length(content) // 4)::INT AS at_least_one, len({tok('content')})::INT AS raw, len({longs('content')})::INT AS long, len({split('content')})::INT AS split, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> ''))::INT AS words FROM working"),
    "k5_k8_overlap": (
        k_overlap,
        L.SQL
        + f""", x AS (SELECT id, {tok('content')} AS r, {longs('content')} AS l, {split('content')} AS s, {split(repr(Q))} AS q, {longs(repr(Q))} AS ql, {tok(repr(Q))} AS qr FROM working),
        y AS (SELECT *, list_distinct(l) AS dl, list_distinct(ql) AS dq, len(list_intersect(list_distinct(ql), list_distinct(l))) AS h FROM x)
        SELECT id, round(CASE WHEN len(q) > 0 AND len(s) > 0 THEN len(list_intersect(q, s)) / greatest(1, len(q)) ELSE 0.0 END, 9) AS overlap,
          round(CASE WHEN len(r) > 0 THEN len(list_filter(r, lambda t: list_contains(q, t))) / len(r) ELSE 0.0 END, 9) AS density,
          round(len(list_intersect(q, s)) / len(list_distinct(list_concat(q, s))), 9) AS jaccard, round(len(list_intersect(qr, r)) / len(list_distinct(list_concat(qr, r))), 9) AS jaccard_raw,
          round(CASE WHEN h > 0 THEN least(1.0, 0.7 * h / len(dq) + 0.3 * h / len(dl)) ELSE 0.0 END, 9) AS coverage FROM y""",
    ),
    "k9_k22_normal": (
        k_normal,
        L.SQL
        + f""", x AS (SELECT *, {_N} AS n, {_E} AS e, list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '') AS w FROM working)
        SELECT id, n AS normal, e AS entity, length(e) BETWEEN 2 AND 80 AND e NOT IN ({', '.join(repr(x) for x in T.STOP_ENTITIES)}) AND NOT regexp_matches(regexp_replace(e, '[.,]', '', 'g'), '^[0-9]+$') AS is_entity,
          substr(sha256(content), 1, 16) AS short_id, sha256(role || chr(0) || content) AS pair,
          CASE WHEN regexp_matches(lower(content), '{'|'.join(T.LANGUAGES)}') THEN 'language' WHEN regexp_matches(lower(content), '{'|'.join(T.TOOLS)}') THEN 'tooling' ELSE 'general' END AS category,
          regexp_matches(lower(content), '{'|'.join(T.FACT_PHRASES)}') AS factlike, substr(content, 1, 51) AS head,
          CASE WHEN len(w) <= 12 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:12], ' ') || ' ...' END AS summary FROM x""",
    ),
    "k13_k16_expand": (
        k_expand,
        L.SQL
        + f""", x AS (SELECT id, content, {split('content')} AS s, {split("content || ' bug in python asyncio'")} AS p FROM fcts), y AS (SELECT *, {_syn('s')} AS e FROM x), z AS (SELECT id, content, e, p AS s FROM y), w AS (SELECT *, {_syn('s')} AS pe FROM z)
        SELECT id, array_to_string(list_sort(e), ' ') AS terms, content || ' bug in python asyncio ' || array_to_string(list_sort(list_filter(pe, lambda t: NOT list_contains(s, t))), ' ') AS query,
        array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(content), '[a-z0-9_]+'), lambda t: length(t) >= 2))), ' ') AS match FROM w""",
    ),
    "k15_recency": (
        k_recency,
        L.SQL
        + f""", x AS (SELECT id, ts, greatest(0.0, ({AS_OF} - ts) / 86400.0) AS a FROM eps) SELECT id, ts, round(CASE WHEN a < 1 THEN greatest(0.0, 1 - a) ELSE greatest(0.0, 1 - least(a / 30.0, 1.0)) END, 9) AS two_scale,
        round(greatest(0.0, 1 - least(a / 180.0, 1.0)), 9) AS half_year, round(greatest(0.0, 1 - least(a / 365.0, 1.0)), 9) AS year, round(pow(0.5, a / 30.0), 9) AS half_life, round(exp(-ln(2) / 30.0 * a), 9) AS decay FROM x""",
    ),
    "k19_prompt": (k_prompt, L.SQL + r"SELECT id, CASE WHEN coalesce(text, '') = '' THEN '' ELSE '----- BEGIN RETRIEVED MEMORY -----' || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || '----- END RETRIEVED MEMORY -----' || chr(10) || chr(10) END || 'User: hello' || chr(10) || 'Assistant:' AS prompt FROM eps"),
    "k21_perplexity": (k_perplexity, L.SQL + "SELECT task, round(exp(-avg(-duration / 100)), 9) AS perplexity, round(avg(-duration / 100), 9) AS mean_logprob FROM runs GROUP BY 1"),
}
