"""Queries of extraction, graphs and unified retrieval."""

from pyspark.sql import functions as F

from ..operators import extraction as E
from ..operators import graph as G
from ..operators import lexical, reporting, retrieval
from ..sources import logical as L
from ..sources.tables import table
from .kernels import AS_OF, longs, split
from .memory import QSQL, bm25_sql, queries_df


def _docs(s, d):
    return L.facts(s, d).select("id", F.col("content").alias("text"))


_SENT = (
    L.SQL
    + r""", sents AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY i) - 1)::INT AS sent, s AS sentence FROM (SELECT id, generate_subscripts(p, 1) AS i, regexp_replace(unnest(p), '^\s+|\s+$', '', 'g') AS s FROM
      (SELECT id, string_split(regexp_replace(regexp_replace(content, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '\n\s*\n', chr(1), 'g'), chr(1)) AS p FROM fcts)) WHERE length(s) >= 10)"""
)
_STOPL = "[" + ", ".join(f"'{w}'" for w in E.STOP_WORDS) + "]"
_TERMS = (
    _SENT
    + f""", wd AS (SELECT id, sent, list_filter(regexp_extract_all(lower(sentence), '[a-z0-9_]{{2,}}'), lambda x: NOT list_contains({_STOPL}, x)) AS w FROM sents),
    tm AS (SELECT id, sent, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM wd), tf AS (SELECT id, sent, term, count(*) AS tf FROM tm GROUP BY ALL),
    ns AS (SELECT id, count(*) AS n FROM sents GROUP BY 1), dfq AS (SELECT id, term, count(*) AS df FROM tf GROUP BY 1, 2),
    vv AS (SELECT id, sent, term, tf * (ln((1 + n) / (1 + df)) + 1) AS v FROM tf JOIN dfq USING (id, term) JOIN ns USING (id) WHERE df <= 0.85 * n OR n = 1),
    sc AS (SELECT id, sent, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY id, sent)), 9) AS score FROM vv),
    ti AS (SELECT id, sent, term, score FROM (SELECT *, row_number() OVER (PARTITION BY id, sent ORDER BY score DESC, term) AS rn FROM sc WHERE score >= 0.2) WHERE rn <= 15)"""
)
_ENT = r"""regexp_replace(regexp_replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), '^[.,;:!?"''()-]+|[.,;:!?"''()-]+$', '', 'g')"""


def _is_entity(c):
    from ..functions.text import STOP_ENTITIES

    return f"length({c}) BETWEEN 2 AND 80 AND {c} NOT IN ({', '.join(repr(x) for x in STOP_ENTITIES)}) AND NOT regexp_matches(regexp_replace({c}, '[.,]', '', 'g'), '^[0-9]+$')"


def _cap(patterns):
    got = "coalesce(" + ", ".join(f"nullif(regexp_extract(sentence, '(?i){p}', 1), '')" for p in patterns) + ")"
    trail = ", ".join(f"'{w}'" for w in E.TRAILING)
    return f"(CASE WHEN len(regexp_split_to_array({got}, '\\s+')) > 1 AND lower(regexp_split_to_array({got}, '\\s+')[-1]) IN ({trail}) THEN regexp_split_to_array({got}, '\\s+')[1] ELSE {got} END)"


_REL = (
    _SENT
    + f""", rr AS (SELECT id, sent, 'PREFERS' AS relation, {_ENT.format(c=_cap(E.PREFERS))} AS object, 0.80 AS confidence FROM sents UNION ALL SELECT id, sent, 'USES', {_ENT.format(c=_cap(E.USES))}, 0.75 FROM sents UNION ALL SELECT id, sent, 'KNOWS_ABOUT', {_ENT.format(c=_cap(E.KNOWS))}, 0.70 FROM sents),
    ok AS (SELECT * FROM rr WHERE object IS NOT NULL AND {_is_entity('object')} AND object NOT IN ({', '.join(repr(x) for x in E.EMPTY)})),
    ro AS (SELECT 'root' AS subject, CASE WHEN relation = 'PREFERS' THEN 'KNOWS_ABOUT' ELSE relation END AS relation, object, CASE WHEN relation = 'PREFERS' THEN 0.65 ELSE confidence END AS confidence FROM ok)
    SELECT subject, relation, object, count(*) AS mentions, max(confidence)::DOUBLE AS confidence, substr(sha256(object), 1, 16) AS object_id FROM ro GROUP BY 1, 2, 3"""
)
#: Sentences appended by id, so that the statement families have something to find in these texts.
TEMPLATES = ["We decided to use exponential backoff for the worker queue.", "We implemented the retry logic for the service today. We fixed the event loop bug in the worker.", "Next step is to profile the cache under load. We switched to poetry for builds.", "The worker depends on the queue. We are using redis."]
_TPL_SQL = "CASE id % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TEMPLATES)) + " END"
_TRIM = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_NW = r"len(list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> ''))"
_STMT = (
    L.SQL
    + f", tpl AS (SELECT id, content || ' ' || {_TPL_SQL} AS content FROM working), live AS (SELECT id, content AS text FROM tpl WHERE len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) >= 8 AND regexp_matches(lower(content), '"
    + "" + "|".join(E.TRIGGERS) + "')), st AS ("
    + " UNION ALL ".join(
        f"SELECT id, '{n}' AS relation, {_TRIM.format(c=f'unnest(regexp_extract_all(text, {chr(39)}(?i){p}{chr(39)}, 1))')} AS v, {_TRIM.format(c=f'unnest(regexp_extract_all(text, {chr(39)}(?i){p}{chr(39)}, 2))') if n == 'DEPENDS_ON' else 'NULL'} AS o, {m} AS most, {80 if n == 'DEPENDS_ON' else 120 if n == 'USES' else 160} AS long, {c} AS confidence FROM live"
        for n, p, m, c in E.STATEMENTS
    )
    + f") SELECT DISTINCT id, relation, substr(v, 1, long) AS subject, substr(o, 1, long) AS object, confidence::DOUBLE AS confidence FROM st WHERE v <> '' AND {_NW.format(c='v')} <= most AND (o IS NULL OR o <> '' AND {_NW.format(c='o')} <= most)"
)
_COO = f", en AS (SELECT DISTINCT id, sent, {_ENT.format(c='term')} AS e FROM ti), co AS (SELECT x.e AS a, y.e AS b, count(*) AS count FROM en x JOIN en y ON x.id = y.id AND x.sent = y.sent AND x.e < y.e WHERE x.e <> '' AND y.e <> '' GROUP BY 1, 2)"


def _edges(s, d):
    """Episode to episode by shared session, as a plain graph of sessions and projects."""
    e = L.episodes(s, d).filter("session_id IS NOT NULL AND session_id <> 'unknown' AND project_id IS NOT NULL")
    return e.select(F.col("session_id").alias("a"), F.col("project_id").alias("b")).distinct()


_EDGE = L.SQL + ", ed AS (SELECT DISTINCT session_id AS a, project_id AS b FROM eps WHERE session_id IS NOT NULL AND session_id <> 'unknown' AND project_id IS NOT NULL), bw AS (SELECT a AS src, b AS dst FROM ed UNION SELECT b, a FROM ed)"


def _bfs(start, goal, longest):
    """SQL for the first shortest path: one level per hop, the least path to each node not seen before."""
    out = f", b0 AS (SELECT '{start}' AS node, ['{start}'] AS path)"
    for h in range(1, longest + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM b{i}" for i in range(h))
        out += f", b{h} AS (SELECT dst AS node, min(list_append(path, dst)) AS path FROM b{h - 1} JOIN bw ON src = node WHERE node <> '{goal}' AND dst NOT IN ({seen}) GROUP BY 1)"
    return out + " " + " UNION ALL ".join(f"SELECT array_to_string(path, '>') AS path, {h}::INT AS length FROM b{h} WHERE node = '{goal}'" for h in range(1, longest + 1))


def _ev(s, d):
    return table(s, d, "events", "event_id", "user_id", "event_type", "ts").select("event_id", "user_id", "event_type", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6).alias("ts"))


_EPI = f""", er AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rank FROM bm), ex AS (SELECT query_id, id, text, rank, {split('query')} AS qs, {split('text')} AS ts2, regexp_extract_all(lower(text), '[a-z0-9_./-]+') AS rt, importance, greatest(0.0, ({AS_OF} - ts) / 86400.0) AS a FROM er JOIN eps USING (id) JOIN q USING (query_id) WHERE rank <= 15)"""

QUERIES = {
    "x10_sentences": (lambda s, d: E.sentences(_docs(s, d)), _SENT + "SELECT id, sent, sentence FROM sents"),
    "x6_statements": (lambda s, d: E.statements(L.working(s, d).select("id", F.concat("content", F.lit(" "), F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("id") % 4 + 1).cast("int"))).alias("text"))), _STMT),
    "x9_relations": (lambda s, d: E.relations(_docs(s, d)), _REL),
    "x11_tfidf": (lambda s, d: E.tfidf(_docs(s, d)).select("id", "sent", "term", F.round("score", 6).alias("score")), _TERMS + "SELECT id, sent, term, round(score, 6) AS score FROM ti"),
    "g37_entities": (
        lambda s, d: E.entities(E.tfidf(_docs(s, d))).select("term", F.round("score", 6).alias("score"), "mentions", "documents"),
        _TERMS + f", en AS (SELECT id, sent, {_ENT.format(c='term')} AS term, score FROM ti) SELECT term, round(max(score), 6) AS score, count(DISTINCT (id, sent)) AS mentions, count(DISTINCT id) AS documents FROM en WHERE {_is_entity('term')} GROUP BY 1",
    ),
    "w9_without_parts": (lambda s, d: E.without_parts(E.tfidf(_docs(s, d))).select("id", "sent", "term"), _TERMS + "SELECT id, sent, term FROM ti WHERE NOT EXISTS (SELECT 1 FROM ti b WHERE b.id = ti.id AND contains(b.term, ' ') AND list_contains(string_split(b.term, ' '), ti.term))"),
    "j5_g38_cooccurrences": (lambda s, d: E.cooccurrences(E.tfidf(_docs(s, d)), 2), _TERMS + _COO + " SELECT a, b, count FROM co WHERE count >= 2"),
    "g1_reachable": (
        lambda s, d: G.reachable(G.both_ways(_edges(s, d)), _edges(s, d).select(F.col("b").alias("seed")).distinct(), 2),
        _EDGE + ", h1 AS (SELECT DISTINCT b AS seed, src AS node FROM (SELECT DISTINCT b FROM ed) JOIN bw ON bw.dst = b), h2 AS (SELECT DISTINCT seed, dst AS node FROM h1 JOIN bw ON src = node WHERE dst <> seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.node = bw.dst)) SELECT seed, node, 1 AS hop FROM h1 UNION ALL SELECT seed, node, 2 FROM h2",
    ),
    "g5_shortest": (
        lambda s, d: G.shortest(G.both_ways(_edges(s, d)), "atlas-notes", "kitchen-ai"),
        _EDGE + _bfs("atlas-notes", "kitchen-ai", 5),
    ),
    "g7_sequences": (
        lambda s, d: G.sequences(_ev(s, d), "user_id", "event_type", "ts").select("src", "dst", "freq", F.round("delay", 3).alias("delay")),
        "WITH x AS (SELECT event_type, lag(event_type) OVER w AS p, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT p AS src, event_type AS dst, count(*) AS freq, round(avg(g), 3) AS delay FROM x WHERE p IS NOT NULL GROUP BY 1, 2",
    ),
    "j11_next_kinds": (
        lambda s, d: G.next_kinds(G.sequences(_ev(s, d), "user_id", "event_type", "ts"), 2).select("src", "dst", "rank"),
        "WITH x AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), g AS (SELECT p AS src, event_type AS dst, count(*) AS freq FROM x WHERE p IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY freq DESC, dst)::INT AS rank FROM g) SELECT src, dst, rank FROM r WHERE rank <= 2",
    ),
    "j8_near_in_time": (
        lambda s, d: G.near_in_time(_ev(s, d).withColumnRenamed("event_id", "id"), "event_type", "ts", 60.0),
        "WITH e AS (SELECT event_id AS id, event_type, epoch_us(ts) / 1e6 AS t FROM events) SELECT x.event_type, x.id AS a, y.id AS b FROM e x JOIN e y ON x.event_type = y.event_type AND x.id < y.id AND abs(x.t - y.t) < 60",
    ),
    "g8_clusters": (
        lambda s, d: reporting.clusters(_ev(s, d), "user_id"),
        "SELECT user_id, count(*) AS n, min(epoch_us(ts) / 1e6) AS first_ts, max(epoch_us(ts) / 1e6) AS last_ts FROM events GROUP BY 1",
    ),
    "g9_l8_counts": (
        lambda s, d: G.counts({"working": L.working(s, d), "episodic": L.episodes(s, d), "semantic": L.facts(s, d), "cold": L.cold(s, d)}),
        L.SQL + "SELECT 'working' AS kind, count(*) AS n FROM working UNION ALL SELECT 'episodic', count(*) FROM eps UNION ALL SELECT 'semantic', count(*) FROM fcts UNION ALL SELECT 'cold', count(*) FROM coldm",
    ),
    "x20_episodic": (
        lambda s, d: retrieval.episodic(L.episodes(s, d), queries_df(s), AS_OF).select("query_id", "id", "tokens", F.round("score", 6).alias("score")),
        L.SQL + QSQL + bm25_sql("eps", "text") + _EPI
        + """, s AS (SELECT query_id, id, text, rank, a, importance, ts2, rt, CASE WHEN list_contains(qs, 'preference') THEN list_distinct(list_concat(qs, ['prefer', 'favorite', 'like'])) ELSE qs END AS qs FROM ex)
        SELECT query_id::BIGINT AS query_id, id, greatest(1, length(text) // 4)::INT AS tokens, round(0.5 * CASE WHEN len(qs) > 0 AND len(ts2) > 0 THEN len(list_intersect(qs, ts2)) / len(qs) ELSE 0 END + 0.28 * coalesce(nullif(importance, 0), 0.5) + 0.16 * CASE WHEN a < 1 THEN greatest(0.0, 1 - a) ELSE greatest(0.0, 1 - least(a / 30.0, 1.0)) END + 0.06 * CASE WHEN len(rt) > 0 THEN len(list_filter(rt, lambda t: list_contains(qs, t))) / len(rt) ELSE 0 END - 0.02 * (rank - 1), 6) AS score FROM s""",
    ),
    "x24_retrieve": (lambda s, d: retrieval.retrieve(L.episodes(s, d), L.facts(s, d), L.cold(s, d), queries_df(s), AS_OF), None),
    "x17_overlap_search": (
        lambda s, d: lexical.by_overlap(L.facts(s, d), queries_df(s), "content", 5).select("query_id", "id", "rank"),
        L.SQL + QSQL + f", c AS (SELECT query_id, id, list_distinct({longs('query')}) AS qs, list_distinct({longs('content')}) AS cs FROM q CROSS JOIN fcts WHERE query <> ''), t AS (SELECT query_id, id, round(CASE WHEN len(qs) > 0 AND len(cs) > 0 THEN len(list_intersect(qs, cs)) / len(qs) ELSE 0 END, 9) AS score FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM t WHERE score > 0) SELECT query_id::BIGINT AS query_id, id, rank FROM r WHERE rank <= 5",
    ),
}

