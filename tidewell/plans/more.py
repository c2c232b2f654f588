"""Queries of evaluation, affinities, entity lookups and the parts of retrieval on their own."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as S
from ..functions import text as T
from ..operators import extraction as E
from ..operators import lifecycle, prompts, records, reporting, retrieval, vectors
from ..sources import logical as L
from ..sources.tables import table
from .kernels import AS_OF, split, tok
from .knowledge import _REL, _SENT, _STMT, _TERMS, QUERIES as KNOWLEDGE, _docs
from .memory import QSQL, bm25_sql, queries_df


def _trials(s, d):
    """Judgments per trial made from runs."""
    return L.runs(s, d).select((F.col("task") % 6).alias("trial"), (F.col("run_id") % 2 == 0).alias("direct"), (F.col("status") == "done").alias("retrieved"), (F.col("candidates") % 9 == 0).alias("contaminated"), (F.col("candidates") % 4 == 0).alias("verbatim"), "duration")


_TR = L.SQL + ", tr AS (SELECT task % 6 AS trial, run_id % 2 = 0 AS direct, status = 'done' AS retrieved, candidates % 9 = 0 AS contaminated, candidates % 4 = 0 AS verbatim, duration FROM runs)"


def _metrics(s, d):
    b = lambda c: F.col(c).cast("double")
    return _trials(s, d).groupBy("trial").agg(
        F.avg(F.when(F.col("direct"), b("retrieved"))).alias("recall_direct"), F.avg(F.when(~F.col("direct"), b("retrieved"))).alias("recall_other"), F.avg(F.when(F.col("contaminated") & ~F.col("retrieved"), 1.0).otherwise(0.0)).alias("bleed"), F.avg(b("contaminated")).alias("contamination"), F.avg(b("verbatim")).alias("verbatim")
    )


def _curves(s, d):
    m = _metrics(s, d).select("trial", "recall_direct")
    base = m.filter("trial = 0").select(F.col("recall_direct").alias("b")).scalar()
    return m.select("trial", F.when(base > 0, F.round(F.col("recall_direct") / base, 9)).alias("kept"))


def _typing(s, d):
    c = F.when(F.col("contaminated") & F.col("retrieved"), "mixed").when(F.col("contaminated"), "replaced").when(F.col("verbatim") & ~F.col("retrieved"), "paradox").otherwise("clean")
    return _trials(s, d).groupBy("trial", c.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


EXPECT = ["planner", "retry queue", "worker pool"]
FORBID = ["password", "secret"]


def _fixtures(s, d):
    low = F.lower(T.text("text"))
    hit = lambda ws: sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0))
    return L.episodes(s, d).select("id", (hit(EXPECT) / len(EXPECT)).alias("recall"), (hit(FORBID) / len(FORBID)).alias("penalty")).withColumn("passed", (F.col("recall") >= 0.3) & (F.col("penalty") == 0))


def _p95(s, d):
    """The element at index floor(.95 n) of each kind's sorted values, found by rank; groups keep no list."""
    r = L.runs(s, d).filter("duration IS NOT NULL")
    mean = r.groupBy("strategy").agg(F.round(F.avg("duration"), 6).alias("mean"))
    return reporting.order_statistics(r, "duration", {"p95": F.floor(0.95 * F.col("n"))}, "strategy").join(mean, "strategy").select("strategy", "n", "mean", "p95")


def _mentions(s, d):
    """The two newest facts of each frequent entity."""
    e = E.tfidf(_docs(s, d)).select("term", "id").distinct()
    big = E.entities(E.tfidf(_docs(s, d))).filter("documents >= 5").select("term")
    x = e.join(big, "term").join(L.facts(s, d).select("id", "ts"), "id")
    w = Window.partitionBy("term").orderBy(F.desc("ts"), "id")
    return x.withColumn("rank", F.row_number().over(w)).filter("rank <= 2").select("term", "id", "rank")


def _affinity(s, d):
    v = table(s, d, "embeddings", "vec_id", "embedding", "label")
    first = v.filter("vec_id = 0").select(F.col("embedding").alias("p")).scalar()
    # one prediction for all rows: a single value, carried as a column
    x = v.select(F.col("vec_id").alias("id"), "label", "embedding", first.alias("p"))
    return x.select("id", "label", F.round(F.greatest(F.lit(0.0), vectors.cosine(F.col("embedding"), F.col("p"))), 6).alias("affinity"))


_AFF = "WITH f AS (SELECT embedding::DOUBLE[] AS p FROM embeddings WHERE vec_id = 0), af AS (SELECT vec_id AS id, label, round(greatest(0.0, list_dot_product(embedding::DOUBLE[], p) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(p, p)))), 6) AS affinity FROM embeddings, f)"

_X21 = f""", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rk FROM bm), b AS (SELECT *, max(bm25) OVER (PARTITION BY query_id) AS top FROM r WHERE rk <= 20),
c AS (SELECT query_id, id, bm25, top, content, confidence, ts, list_distinct(list_filter({tok('query')}, lambda x: length(x) > 2)) AS ql, list_distinct(list_filter({tok('content')}, lambda x: length(x) > 2)) AS cl, {split('query')} AS q0, {split('content')} AS cs, {tok('content')} AS rt FROM b JOIN fcts USING (id) JOIN q USING (query_id)),
m AS (SELECT *, round(least(1.0, 0.6 * bm25 / top + 0.4 * CASE WHEN len(ql) > 0 AND len(cl) > 0 THEN len(list_intersect(ql, cl)) / len(ql) ELSE 0 END), 9) AS mt, CASE WHEN list_contains(q0, 'preference') THEN list_distinct(list_concat(q0, ['prefer', 'favorite', 'like'])) ELSE q0 END AS qs FROM c),
mm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mt DESC, id) AS mr FROM m),
z AS (SELECT *, greatest(CASE WHEN len(qs) > 0 AND len(cs) > 0 THEN len(list_intersect(qs, cs)) / len(qs) ELSE 0 END, mt) AS lex FROM mm WHERE mr <= 24),
y AS (SELECT query_id, id, round(0.52 * lex + 0.28 * coalesce(nullif(confidence, 0), 0.62) + 0.12 * greatest(0.0, 1 - least(greatest(0.0, ({AS_OF} - ts) / 86400.0) / 180.0, 1.0)) + 0.08 * CASE WHEN len(rt) > 0 THEN len(list_filter(rt, lambda t: list_contains(qs, t))) / len(rt) ELSE 0 END, 9) AS score FROM z WHERE lex >= 0.08),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM y) SELECT query_id::BIGINT AS query_id, id, round(score, 6) AS score FROM w WHERE rn <= 8"""

_X22 = f""", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rk FROM bm), c0 AS (SELECT query_id, id, round(1.0 + 0.35 * pow(0.5, greatest(0.0, ({AS_OF} - ts) / 86400.0) / 30.0) + 0.20 * least(1.0, greatest(0.0, coalesce(nullif(try_cast(json_extract_string(metadata_json, '$.importance') AS DOUBLE), 0), 0.5))), 9) AS s FROM r JOIN coldm USING (id) WHERE rk <= 50),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rn FROM c0) WHERE rn <= 5),
x AS (SELECT query_id, id, text, ts, {split('query')} AS q0, {split('text')} AS cs, {tok('text')} AS rt FROM c JOIN coldm USING (id) JOIN q USING (query_id)), y AS (SELECT *, CASE WHEN list_contains(q0, 'preference') THEN list_distinct(list_concat(q0, ['prefer', 'favorite', 'like'])) ELSE q0 END AS qs FROM x)
SELECT query_id::BIGINT AS query_id, id, greatest(1, length(text) // 4)::INT AS tokens, round(0.42 * CASE WHEN len(qs) > 0 AND len(cs) > 0 THEN len(list_intersect(qs, cs)) / len(qs) ELSE 0 END + 0.10 * greatest(0.0, 1 - least(greatest(0.0, ({AS_OF} - ts) / 86400.0) / 365.0, 1.0)) + 0.08 * CASE WHEN len(rt) > 0 THEN len(list_filter(rt, lambda t: list_contains(qs, t))) / len(rt) ELSE 0 END + 0.10, 6) AS score FROM y"""

#: Entities whose surroundings are asked for.
SEEDS = [(0, "scheduler"), (0, "photo"), (1, "planificador"), (2, "nothing at all")]
#: Sentences appended by length, so that there are relations with words to search for.
SAID = ["I use PyCharm as my primary editor.", "FastAPI is a framework for building services.", "I prefer pytest over unittest."]


def _said(s, d):
    c = F.col("content")
    return L.facts(s, d).select("id", F.concat(c, F.lit(" "), F.element_at(F.array(*map(F.lit, SAID)), (F.length(c) % 3 + 1).cast("int"))).alias("text"))


_REL_SAID = _REL.replace("AS p FROM fcts)", "AS p FROM (SELECT id, content || ' ' || CASE length(content) % 3 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(SAID)) + " END AS content FROM fcts))")

QUERIES = {
    "g30_trial_metrics": (
        _metrics,
        _TR + "SELECT trial, avg(CASE WHEN direct THEN retrieved::INT END) AS recall_direct, avg(CASE WHEN NOT direct THEN retrieved::INT END) AS recall_other, avg((contaminated AND NOT retrieved)::INT) AS bleed, avg(contaminated::INT) AS contamination, avg(verbatim::INT) AS verbatim FROM tr GROUP BY 1",
    ),
    "g31_kept_recall": (_curves, _TR + ", m AS (SELECT trial, avg(CASE WHEN direct THEN retrieved::INT END) AS r FROM tr GROUP BY 1) SELECT trial, CASE WHEN (SELECT r FROM m WHERE trial = 0) > 0 THEN round(r / (SELECT r FROM m WHERE trial = 0), 9) END AS kept FROM m"),
    "g33_typing": (_typing, _TR + "SELECT trial, CASE WHEN contaminated AND retrieved THEN 'mixed' WHEN contaminated THEN 'replaced' WHEN verbatim AND NOT retrieved THEN 'paradox' ELSE 'clean' END AS kind, count(*) AS n FROM tr GROUP BY 1, 2"),
    "g34_fixtures": (
        _fixtures,
        L.SQL + ", f AS (SELECT id, (contains(lower(text), 'planner')::INT + contains(lower(text), 'retry queue')::INT + contains(lower(text), 'worker pool')::INT) / 3 AS recall, (contains(lower(text), 'password')::INT + contains(lower(text), 'secret')::INT) / 2 AS penalty FROM eps) SELECT id, coalesce(recall, 0) AS recall, coalesce(penalty, 0) AS penalty, coalesce(recall, 0) >= 0.3 AND coalesce(penalty, 0) = 0 AS passed FROM f",
    ),
    "g35_latency": (
        _p95,
        L.SQL + ", x AS (SELECT strategy, count(*) AS n, round(avg(duration), 6) AS mean, list_sort(list(duration)) AS l FROM runs WHERE duration IS NOT NULL GROUP BY 1) SELECT strategy, n, mean, l[floor(0.95 * n)::BIGINT + 1] AS p95 FROM x",
    ),
    "j6_newest_mentions": (
        _mentions,
        _TERMS
        + ", nm AS (SELECT DISTINCT id, term FROM ti), big AS (SELECT term FROM nm WHERE term NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_ENTITIES) + ") AND NOT regexp_matches(term, '^[0-9]+$') GROUP BY 1 HAVING count(DISTINCT id) >= 5), x AS (SELECT term, id, row_number() OVER (PARTITION BY term ORDER BY ts DESC, id)::INT AS rank FROM nm JOIN big USING (term) JOIN fcts USING (id)) SELECT term, id, rank FROM x WHERE rank <= 2",
    ),
    "g2_g3_context": (
        lambda s, d: E.context(E.tfidf(_docs(s, d)), E.sentences(_docs(s, d)), L.facts(s, d).select("id", "ts"), s.createDataFrame(SEEDS, "query_id bigint, term string")),
        _TERMS
        + ", sd AS (SELECT query_id::BIGINT AS query_id, term FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in SEEDS) + ") AS v(query_id, term))"
        + """, m AS (SELECT DISTINCT id, sent, term FROM ti), nw AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ts DESC, id, sent) AS rn FROM m JOIN fcts USING (id)),
        a AS (SELECT query_id, 0 AS o1, 0 AS o2, term, rn, id, sent FROM sd JOIN nw USING (term) WHERE rn <= 3), nr AS (SELECT query_id, sd.term, o.term AS other, count(*) AS n FROM sd JOIN m h ON h.term = sd.term JOIN m o ON o.id = h.id AND o.sent = h.sent AND o.term <> sd.term GROUP BY 1, 2, 3),
        nt AS (SELECT *, row_number() OVER (PARTITION BY query_id, term ORDER BY n DESC, other) AS o2 FROM nr), b AS (SELECT query_id, 1 AS o1, o2, nt.term, rn, id, sent FROM nt JOIN nw ON nw.term = other WHERE o2 <= 5 AND rn <= 2),
        vs AS (SELECT query_id, sentence, o1, o2, term, rn, id, sent, row_number() OVER (PARTITION BY query_id, sentence ORDER BY o1, o2, term, rn, id, sent) AS f FROM (SELECT * FROM a UNION ALL SELECT * FROM b) JOIN sents USING (id, sent)),
        pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o1, o2, term, rn, id, sent) AS place FROM vs WHERE f = 1)
        SELECT query_id, count(*)::INT AS sentences, string_agg(sentence, chr(10) || '---' || chr(10) ORDER BY place) AS context FROM pl WHERE place <= 8 GROUP BY 1""",
    ),
    "j10_unmentioned": (
        lambda s, d: table(s, d, "subjects", "subject").join(E.sentence_terms(_docs(s, d)).select(F.col("term").alias("subject")).distinct(), "subject", "left_anti"),
        _SENT + "SELECT subject FROM subjects WHERE NOT EXISTS (SELECT 1 FROM sents WHERE list_contains(regexp_extract_all(lower(sentence), '[a-z0-9_]{2,}'), subject))",
    ),
    "j13_trials": (
        lambda s, d: reporting.trials(L.facts(s, d), 6, ["decoy", "direct", "paraphrase"]),
        L.SQL + "SELECT id, unnest(range(0, 6))::INT AS trial, k AS kind FROM fcts, (VALUES ('decoy'), ('direct'), ('paraphrase')) AS v(k)",
    ),
    "v5_affinity": (_affinity, _AFF + " SELECT id, label, affinity FROM af"),
    "v6_consolidation": (lambda s, d: _affinity(s, d).filter("affinity >= 0.15").groupBy("label").agg(F.count(F.lit(1)).alias("hits")).filter("hits >= 2"), _AFF + " SELECT label, count(*) AS hits FROM af WHERE affinity >= 0.15 GROUP BY 1 HAVING count(*) >= 2"),
    "l4_maintenance": (
        lambda s, d: lifecycle.actions(L.episodes(s, d), AS_OF),
        L.SQL + f"SELECT id, CASE WHEN coalesce(importance, 0.5) >= 0.8 THEN 'promote' WHEN greatest(0.0, ({AS_OF} - ts) / 86400.0) >= 45 AND coalesce(importance, 0.5) <= 0.55 THEN 'archive' ELSE 'keep' END AS action FROM eps",
    ),
    "l6_consolidated": (
        lambda s, d: lifecycle.promotions(L.episodes(s, d).join(lifecycle.access(table(s, d, "access_log")).filter("hits >= 5").select(F.col("episode_id").alias("id")), "id", "left_semi"), 0.5).filter("kind = 'event'").select("digest", "id"),
        L.SQL + r", h AS (SELECT episode_id FROM (SELECT DISTINCT * FROM access_log) WHERE episode_id IS NOT NULL GROUP BY 1 HAVING sum(access_count) >= 5), e AS (SELECT id, ts, sha256(regexp_replace(lower(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')) AS digest FROM eps WHERE importance >= 0.5 AND id IN (SELECT episode_id FROM h)) SELECT digest, id FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY ts, id) AS rn FROM e) WHERE rn = 1",
    ),
    "x21_semantic": (lambda s, d: retrieval.semantic(L.facts(s, d), queries_df(s), AS_OF).select("query_id", "id", F.round("score", 6).alias("score")), L.SQL + QSQL + bm25_sql("fcts", "content") + _X21),
    "x22_cold": (lambda s, d: retrieval.cold(L.cold(s, d), queries_df(s), AS_OF).select("query_id", "id", "tokens", F.round("score", 6).alias("score")), L.SQL + QSQL + bm25_sql("coldm", "text") + _X22),
    "x23_needs_cold": (
        lambda s, d: retrieval.needs_cold(retrieval.episodic(L.episodes(s, d), queries_df(s), AS_OF), queries_df(s), 3000),
        L.SQL + QSQL + bm25_sql("eps", "text") + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rk FROM bm), t AS (SELECT query_id, sum(greatest(1, length(text) // 4)) AS tok FROM r JOIN eps USING (id) WHERE rk <= 15 GROUP BY 1) SELECT query_id::BIGINT AS query_id FROM q LEFT JOIN t USING (query_id) WHERE coalesce(tok, 0) = 0 OR tok < 160",
    ),
    "x7_payloads": (
        lambda s, d: E.payloads(KNOWLEDGE["x6_statements"][0](s, d)),
        f"SELECT id, relation, substr('[' || relation || '] ' || subject || coalesce(' → ' || object, ''), 1, 320) AS content, confidence FROM (SELECT *, row_number() OVER (PARTITION BY relation, substr(subject, 1, 40), object ORDER BY id, subject) AS rn FROM ({_STMT})) WHERE rn = 1",
    ),
    "x19_relation_search": (
        lambda s, d: E.search_relations(E.relations(_said(s, d)).filter("subject = 'root'"), s.createDataFrame([(0, "which editor: pycharm"), (1, "pytest and fastapi"), (2, "")], "query_id bigint, query string")).select("query_id", "relation", "object", F.round("score", 6).alias("score"), "rank"),
        f"""WITH rl AS (SELECT relation, object, confidence, list_distinct(list_filter({tok('object')}, lambda x: length(x) > 2)) AS t FROM ({_REL_SAID}) WHERE subject = 'root'), qq AS (SELECT query_id::BIGINT AS query_id, list_distinct(list_filter({tok('query')}, lambda x: length(x) > 2)) AS q FROM (VALUES (0, 'which editor: pycharm'), (1, 'pytest and fastapi'), (2, '')) AS v(query_id, query)),
        sc AS (SELECT query_id, relation, object, round(least(1.0, 0.7 * len(list_intersect(q, t)) / len(q) + 0.3 * len(list_intersect(q, t)) / len(t)) * confidence, 9) AS score FROM qq JOIN rl ON len(list_intersect(q, t)) > 0), rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, object, relation)::INT AS rank FROM sc) SELECT query_id, relation, object, round(score, 6) AS score, rank FROM rr WHERE rank <= 8""",
    ),
    "x33_hint": (
        lambda s, d: L.runs(s, d).groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.max_by("duration", F.struct("ts", "run_id")).alias("last"), F.avg("duration").alias("mean")).select("task", F.regexp_replace(prompts.hint(F.col("n"), F.col("last"), F.col("mean")), r"surprise: [0-9.]+x", "surprise").alias("hint")),
        L.SQL + "SELECT task, CASE WHEN count(*) < 50 OR avg(duration) <= 0 THEN '' WHEN arg_max(duration, (ts, run_id)) / avg(duration) < 0.7 THEN 'This interaction pattern is familiar (confidence: high, based on ' || count(*) || ' prior exchanges). Prioritize consistency with previous responses on this topic.' WHEN arg_max(duration, (ts, run_id)) / avg(duration) > 1.5 THEN 'This appears to be a novel topic or unusual framing (surprise above average). No strong prior pattern detected; reason carefully.' ELSE '' END AS hint FROM runs GROUP BY 1",
    ),
    "f5_w8_write_once": (
        lambda s, d: records.best_per_group(L.facts(s, d).select(T.normal(F.col("content")).alias("norm"), F.lit(1.0).alias("one"), "id"), "norm", "one", "id").select("norm", "id"),
        L.SQL + r"SELECT norm, min(id) AS id FROM (SELECT regexp_replace(lower(regexp_replace(content, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS norm, id FROM fcts) GROUP BY 1",
    ),
}
