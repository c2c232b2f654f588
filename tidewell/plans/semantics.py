"""Queries of the semantic layer, selection and prompts."""

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import extraction as E
from ..operators import lexical, prompts, records, retrieval, semantic, working
from ..sources import logical as L
from ..sources.tables import table
from .kernels import AS_OF, longs, split, tok
from .knowledge import _ENT, _REL, _TERMS, _is_entity
from .memory import QSQL, bm25_sql, queries_df

_SYN = "s"
for _w, _more in T.SYNONYMS.items():
    _SYN = f"CASE WHEN list_contains(s, '{_w}') THEN list_distinct(list_concat({_SYN}, [{', '.join(repr(m) for m in _more)}])) ELSE {_SYN} END"
_OV = "CASE WHEN len({q}) > 0 AND len({t}) > 0 THEN len(list_intersect({q}, {t})) / len({q}) ELSE 0.0 END"
_TEXTS = """, sm AS (SELECT 'preference' AS type, id, category || ' ' || coalesce(value, '') AS text, 'Preference (' || category || '): ' || coalesce(value, '') AS said, lower(category) AS category, coalesce(nullif(strength, 0), 0.5) AS quality, ts, 1 AS o FROM (SELECT * FROM prefs ORDER BY ts DESC, id LIMIT {n})
UNION ALL SELECT 'event', id, coalesce(summary, '') || ' ' || coalesce(detail, ''), coalesce(summary, ''), NULL, coalesce(nullif(importance, 0), 0.6), ts, 2 FROM (SELECT * FROM notes ORDER BY ts DESC, id LIMIT {n}))"""
_X16 = (
    L.SQL + QSQL + bm25_sql("fcts", "content")
    + _TEXTS.format(n=60)
    + f""", bb AS (SELECT *, max(bm25) OVER (PARTITION BY query_id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rk FROM bm) WHERE rk <= 60),
    fm AS (SELECT query_id, 'fact' AS type, id, 0 AS o, round(round(least(1.0, 0.6 * bm25 / top + 0.4 * {_OV.format(q='qs', t='cs')}), 9), 4) AS match FROM (SELECT *, list_distinct({longs('query')}) AS qs, list_distinct({longs('content')}) AS cs FROM bb JOIN fcts USING (id) JOIN q USING (query_id))),
    om AS (SELECT query_id, type, id, o, round(round({_OV.format(q='qs', t='cs')}, 9), 4) AS match FROM (SELECT query_id, type, id, o, list_distinct({longs('query')}) AS qs, list_distinct({longs('text')}) AS cs FROM q CROSS JOIN sm)),
    x16 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match DESC, o, id)::INT AS rank FROM (SELECT query_id, type, id, o, match FROM fm UNION ALL SELECT * FROM om))"""
)
_X21 = (
    _X16
    + rf""", rows AS (SELECT x16.query_id, x16.type, x16.id, x16.o, match, rank, coalesce(said, regexp_replace(content, '^\s+|\s+$', '', 'g')) AS said, sm.category, coalesce(sm.quality, nullif(fcts.confidence, 0), 0.62) AS quality, coalesce(sm.ts, fcts.ts) AS ts FROM x16 LEFT JOIN sm ON sm.id = x16.id AND sm.type = x16.type LEFT JOIN fcts ON fcts.id = x16.id AND x16.type = 'fact' WHERE rank <= 24),
    r1 AS (SELECT rows.*, {split('query')} AS s, {split('said')} AS ss, regexp_extract_all(lower(said), '[a-z0-9_./-]+') AS raw, {split("coalesce(category, '')")} AS cs FROM rows JOIN q USING (query_id)),
    r2 AS (SELECT *, {_SYN} AS qq FROM r1), r3 AS (SELECT *, greatest({_OV.format(q='qq', t='ss')}, match) AS lex, type = 'preference' AND len(list_intersect(qq, cs)) > 0 AS named FROM r2),
    r4 AS (SELECT *, round(0.52 * lex + 0.28 * quality + 0.12 * greatest(0.0, 1 - least(greatest(0.0, ({AS_OF} - ts) / 86400.0) / 180.0, 1.0)) + 0.08 * CASE WHEN len(raw) > 0 THEN len(list_filter(raw, lambda t: list_contains(qq, t))) / len(raw) ELSE 0 END + CASE WHEN named THEN 0.04 ELSE 0 END, 9) AS score FROM r3 WHERE lex >= 0.08 OR named),
    r5 AS (SELECT *, CASE WHEN type = 'preference' THEN row_number() OVER (PARTITION BY query_id, type, category ORDER BY score DESC, rank) ELSE 1 END AS best FROM r4),
    x21 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, id)::INT AS place FROM r5 WHERE best = 1)"""
)


def _mixed(s, d):
    """Facts and cold texts by their BM25 relative to the best, as candidates of two layers."""
    def part(df, text, layer):
        x = lexical.top(lexical.bm25(df, queries_df(s), text).withColumn("bm25", F.round("bm25", 9)), 15, "bm25").join(df.select("id", F.col(text).alias("text")), "id")
        return x.select("query_id", "id", F.lit(layer).alias("layer"), "text", F.greatest(F.lit(1), T.tokens_estimate(F.col("text"))).alias("tokens"), F.round(F.col("bm25") / 100, 9).alias("score"))

    return part(L.facts(s, d), "content", "semantic").unionByName(part(L.cold(s, d), "text", "cold"))


def _mixed_sql(src, text, layer, order):
    inner = bm25_sql(src, text).lstrip(", ")
    return f"(WITH {inner} SELECT query_id::BIGINT AS query_id, id, '{layer}' AS layer, {order} AS o, {text} AS text, greatest(1, length(coalesce({text}, '')) // 4)::INT AS tokens, round(bm25 / 100, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rk FROM bm) JOIN {src} USING (id) WHERE rk <= 15)"


_W5 = (
    L.SQL.replace("WITH working", "WITH RECURSIVE working", 1) + QSQL
    + f", cd AS (SELECT * FROM {_mixed_sql('fcts', 'content', 'semantic', 1)} UNION ALL SELECT * FROM {_mixed_sql('coldm', 'text', 'cold', 2)})"
    + rf""", cn AS (SELECT *, regexp_replace(lower(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS n, {split("coalesce(text, '')")} AS t, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, id) AS i FROM cd),
    fold AS (
      SELECT DISTINCT query_id, 0::BIGINT AS i, []::STRUCT(id VARCHAR, layer VARCHAR, tokens INT, n VARCHAR, t VARCHAR[], adj DOUBLE)[] AS took, 600 AS budget FROM cd
      UNION ALL
      SELECT query_id, i, CASE WHEN ok THEN list_append(took, {{'id': id, 'layer': layer, 'tokens': tokens, 'n': n, 't': t, 'adj': adj}}) ELSE took END, CASE WHEN ok THEN budget - tokens ELSE budget END FROM (
        SELECT *, n <> '' AND len(list_filter(took, lambda x: x.n = n)) = 0 AND (best < 0.84 OR len(took) = 0) AND coalesce(list_sum(list_transform(list_filter(took, lambda x: x.layer = layer), lambda x: x.tokens)), 0) + tokens <= 400 AND tokens <= budget AND adj > 0 AS ok FROM (
          SELECT *, score - CASE WHEN best < 0.45 THEN 0.0 ELSE least(0.18, best * 0.08) END AS adj FROM (
            SELECT f.query_id, c.i, f.took, f.budget, c.id, c.layer, c.tokens, c.n, c.t, c.score, coalesce(list_max(list_transform(f.took, lambda x: CASE WHEN len(list_distinct(list_concat(x.t, c.t))) > 0 THEN len(list_intersect(x.t, c.t)) / len(list_distinct(list_concat(x.t, c.t))) ELSE 0.0 END)), 0.0) AS best
            FROM fold f JOIN cn c ON c.query_id = f.query_id AND c.i = f.i + 1))))
    SELECT query_id, x.id AS id, x.layer AS layer, x.tokens AS tokens, round(x.adj, 6) AS score FROM (SELECT query_id, unnest(took) AS x FROM fold f WHERE i = (SELECT max(i) FROM cn c WHERE c.query_id = f.query_id))"""
)

_PRE = prompts.PREAMBLE.rstrip("\n").replace("'", "''")


def _window_prompt(s, d):
    w = working.context_window(L.working(s, d), 400)
    chosen = w.select(F.col("session_id").alias("query_id"), F.lit("working").alias("layer"), (F.col("rank") - 1).alias("place"), "id")
    lines = L.working(s, d).select(F.lit("working").alias("layer"), "id", F.concat("role", F.lit(": "), "content").alias("line"))
    x = prompts.sections(chosen, lines)
    none = F.lit("")
    return x.select(F.col("query_id").alias("session_id"), prompts.formatted(F.lit("hello"), F.lit(" You help. "), none, F.col("working"), F.col("episodic"), F.col("semantic"), F.col("cold")).alias("prompt"))


def _edges(s, d):
    rel = E.relations(L.facts(s, d).select("id", F.col("content").alias("text")))
    first = L.facts(s, d).agg(F.min("id").alias("id")).withColumn("root", F.lit("root"))
    r = rel.join(F.broadcast(first), rel.subject == first.root).select(F.col("id").alias("subject"), "relation", "object_id", "object", "confidence")
    return semantic.typed_edges(r, L.preferences(s, d), L.facts(s, d), r.select("object_id", "object"))


def _asked(s, d):
    """The questions of eval_items as a table of queries."""
    return table(s, d, "eval_items", F.col("item_id").alias("query_id"), F.coalesce("question", F.lit("")).alias("query"))


QUERIES = {
    "a7_newest_preferences": (lambda s, d: records.newest(L.preferences(s, d), 100).select("id", "category", "ts"), L.SQL + "SELECT id, category, ts FROM prefs ORDER BY ts DESC, id LIMIT 100"),
    "a7_newest_events": (lambda s, d: records.newest(L.notes(s, d), 100).select("id", "importance", "ts"), L.SQL + "SELECT id, importance, ts FROM notes ORDER BY ts DESC, id LIMIT 100"),
    "x16_semantic_search": (lambda s, d: semantic.search(L.facts(s, d), L.preferences(s, d), L.notes(s, d), queries_df(s)).select("query_id", "type", "id", "match", "rank"), _X16 + " SELECT query_id::BIGINT AS query_id, type, id, match, rank FROM x16 WHERE rank <= 20"),
    "x17_preferences": (
        lambda s, d: semantic.search_preferences(L.preferences(s, d), queries_df(s)).select("query_id", "id", "match", "rank"),
        L.SQL + QSQL + _TEXTS.format(n=100) + f", om AS (SELECT query_id, id, round(round({_OV.format(q='qs', t='cs')}, 9), 4) AS match FROM (SELECT query_id, id, list_distinct({longs('query')}) AS qs, list_distinct({longs('text')}) AS cs FROM q CROSS JOIN sm WHERE type = 'preference')), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match DESC, id)::INT AS rank FROM om) SELECT query_id::BIGINT AS query_id, id, match, rank FROM r WHERE rank <= 20",
    ),
    "x21_w6_candidates": (
        lambda s, d: semantic.candidates(L.facts(s, d), L.preferences(s, d), L.notes(s, d), queries_df(s), AS_OF).select("query_id", "type", "id", "tokens", F.round("score", 6).alias("score")),
        _X21 + " SELECT query_id::BIGINT AS query_id, type, id, greatest(1, length(said) // 4)::INT AS tokens, round(score, 6) AS score FROM x21 WHERE place <= 8",
    ),
    "w5_selected": (lambda s, d: retrieval.select(_mixed(s, d), 600).select("query_id", "id", "layer", "tokens", F.round("score", 6).alias("score")), _W5),
    "x24_context": (
        lambda s, d: retrieval.retrieve(L.episodes(s, d), L.facts(s, d), L.cold(s, d), queries_df(s).withColumn("session_id", F.lit("sess-main-console")), AS_OF, 2600, L.preferences(s, d), L.notes(s, d), L.working(s, d)),
        None,
    ),
    "x25_k19_prompts": (
        _window_prompt,
        L.SQL
        + f""", x AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS rank FROM working), y AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM x WHERE rank <= 532),
        z AS (SELECT session_id, string_agg(role || ': ' || content, chr(10) ORDER BY rank DESC) AS w FROM y WHERE used <= 400 AND session_id IS NOT NULL GROUP BY 1)
        SELECT session_id, 'You help.' || chr(10) || chr(10) || '{_PRE}' || chr(10) || '----- BEGIN RETRIEVED MEMORY -----' || chr(10) || regexp_replace('[WORKING]' || chr(10) || w, '^\\s+|\\s+$', '', 'g') || chr(10) || '----- END RETRIEVED MEMORY -----' || chr(10) || chr(10) || 'User: hello' || chr(10) || 'Assistant:' AS prompt FROM z""",
    ),
    "x25_semantic_lines": (
        lambda s, d: L.facts(s, d).select("id", prompts.key_values(id=F.col("id"), content=F.col("content"), source=F.col("source"), user_id=F.col("user_id")).alias("line")),
        L.SQL + "SELECT id, concat_ws('; ', 'id: ' || nullif(id, ''), 'content: ' || nullif(content, ''), 'source: ' || nullif(source, ''), 'user_id: ' || nullif(user_id, '')) AS line FROM fcts",
    ),
    "x31_experiments": (
        lambda s, d: L.runs(s, d).withColumn("e", prompts.experiment(F.col("strategy"), F.when(F.col("task") % 3 == 0, F.concat(F.lit("d"), F.col("task").cast("string"))), F.concat(F.lit("q"), F.col("run_id").cast("string")), F.col("status"), F.col("status") == "done")).select("run_id", "e.text", "e.importance"),
        L.SQL + "SELECT run_id, concat_ws('  ', '[Strategy: ' || strategy || ']', CASE WHEN task % 3 = 0 THEN '[Domain: d' || task || ']' END, 'Q: q' || run_id, 'A: ' || status) AS text, CASE WHEN status = 'done' THEN 0.65 ELSE 0.35 END::DOUBLE AS importance FROM runs",
    ),
    "x27_policies": (
        lambda s, d: L.episodes(s, d).withColumn("p", F.concat(F.lit("a\n"), prompts.wrapped(F.col("text")), F.lit("\nb"))).select("id", prompts.for_cloud(F.col("p"), "keep").alias("kept"), (prompts.for_cloud(F.col("p"), "no such") == prompts.for_cloud(F.col("p"), "strip")).alias("unknown_strips")),
        L.SQL + rf"""SELECT id, 'a' || chr(10) || CASE WHEN coalesce(text, '') = '' THEN '' ELSE '{_PRE}' || chr(10) || '----- BEGIN RETRIEVED MEMORY -----' || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || '----- END RETRIEVED MEMORY -----' END || chr(10) || 'b' AS kept, true AS unknown_strips FROM eps""",
    ),
    "u8_compressed": (lambda s, d: L.working(s, d).select("id", prompts.compressed(F.col("content"), 10).alias("tail"), prompts.compressed(F.col("content"), 10, "start").alias("head")), L.SQL + ", x AS (SELECT id, content, length(content) // 4 AS t, (length(content) * 10 / greatest(1, length(content) // 4))::DOUBLE AS k FROM working) SELECT id, CASE WHEN t <= 10 THEN content ELSE right(content, floor(k)::INT) END AS tail, CASE WHEN t <= 10 THEN content ELSE left(content, floor(k)::INT) END AS head FROM x"),
    "x13_indexed": (
        lambda s, d: E.index(L.facts(s, d).select("id", F.col("content").alias("text")))["stats"],
        _TERMS + f""", wp AS (SELECT id, sent, term FROM ti WHERE NOT EXISTS (SELECT 1 FROM ti b WHERE b.id = ti.id AND contains(b.term, ' ') AND list_contains(string_split(b.term, ' '), ti.term))),
        mn AS (SELECT DISTINCT id, sent, e FROM (SELECT id, sent, {_ENT.format(c='term')} AS e FROM wp) WHERE {_is_entity('e')}), pm AS (SELECT id, count(DISTINCT e) AS entities, count(*) AS mentions FROM mn GROUP BY 1)
        SELECT s.id, s.sentences, coalesce(entities, 0) AS entities, coalesce(mentions, 0) AS mentions FROM (SELECT id, count(*) AS sentences FROM sents GROUP BY 1) s LEFT JOIN pm ON pm.id = s.id""",
    ),
    "k21_logprobs": (
        lambda s, d: L.working(s, d).withColumn("lp", F.transform(T.raw_tokens(F.col("content")), lambda t: -F.length(t) / 10)).select("id", F.round(S.perplexity(F.col("lp")), 9).alias("perplexity"), F.round(S.mean_logprob(F.col("lp")), 9).alias("mean_logprob")),
        L.SQL + f", x AS (SELECT id, list_transform({tok('content')}, lambda t: -length(t) / 10) AS lp FROM working) SELECT id, CASE WHEN len(lp) > 0 THEN round(exp(-list_sum(lp) / len(lp)), 9) ELSE 1.0 END AS perplexity, CASE WHEN len(lp) > 0 THEN round(list_sum(lp) / len(lp), 9) ELSE 0.0 END AS mean_logprob FROM x",
    ),
    "k22_mentions_category": (
        lambda s, d: L.preferences(s, d).select("id", *[semantic.mentions_category(T.expanded(T.split_tokens(F.lit(q))), F.col("category")).alias(f"q{i}") for i, q in enumerate(["in the chat or by hand", "import of tools"])]),
        L.SQL + f", x AS (SELECT id, {split('category')} AS c FROM prefs) SELECT id, len(list_intersect(c, {split(repr('in the chat or by hand'))})) > 0 AS q0, len(list_intersect(c, {split(repr('import of tools'))})) > 0 AS q1 FROM x",
    ),
    "x15_many_queries": (
        lambda s, d: lexical.retrieve_cold(L.cold(s, d), _asked(s, d), AS_OF).select("query_id", "id", "rank", F.round("score", 6).alias("score")),
        L.SQL + ", q AS (SELECT item_id AS query_id, coalesce(question, '') AS query FROM eval_items)" + bm25_sql("coldm", "text")
        + f""", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rk FROM bm), c AS (SELECT query_id, id, round(1.0 + 0.35 * pow(0.5, greatest(0.0, ({AS_OF} - ts) / 86400.0) / 30.0) + 0.20 * least(1.0, greatest(0.0, coalesce(nullif(try_cast(json_extract_string(metadata_json, '$.importance') AS DOUBLE), 0), 0.5))), 9) AS score FROM r JOIN coldm USING (id) WHERE rk <= 100),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM c) SELECT query_id, id, rank, round(score, 6) AS score FROM t WHERE rank <= 10""",
    ),
    "x24_many_queries": (lambda s, d: retrieval.retrieve(L.episodes(s, d), L.facts(s, d), L.cold(s, d), _asked(s, d), AS_OF, 1600, L.preferences(s, d), L.notes(s, d)), None),
    "j7_typed_edges": (lambda s, d: _edges(s, d).select("relation", "subject_text", "entity_text", "confidence"), L.SQL + f", rl AS ({_REL}) SELECT relation, f.content AS subject_text, object AS entity_text, rl.confidence AS confidence FROM rl, fcts f WHERE f.id = (SELECT min(id) FROM fcts)"),
    "x18_graph_search": (lambda s, d: semantic.search_all(L.facts(s, d), L.preferences(s, d), L.notes(s, d), _edges(s, d), queries_df(s)).select("query_id", "type", "id", F.round("match", 6).alias("match"), "rank"), None),
}
