"""Entities and relations in text: sentences, TF-IDF terms, co-occurrence, typed relations.

Documents are rows (id, text); sentences are numbered from 0 within a document. Null text has no
sentences; an empty table gives no rows; ties go by term or id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: The statement families of a turn: name, pattern, most words, confidence. Word characters are those of any script.
STATEMENTS = [
    ("IMPLEMENTED", r"\b(?:we\s+)?(?:implemented|added|built|created|wrote)\s+(.+?)(?:\.|$)", 15, 0.70),
    ("FIXED", r"\b(?:we\s+)?(?:fixed|resolved|patched|corrected)\s+(?:the\s+)?(.+?)(?:\.|$)", 15, 0.72),
    ("DEPENDS_ON", r"(?:^|[^\p{L}\p{N}_])([\p{L}\p{N}_][\p{L}\p{N}_\s]{1,40}?)\s+(?:requires|depends on|needs)\s+([\p{L}\p{N}_][\p{L}\p{N}_\s]{1,40}?)(?:\.|$)", 8, 0.65),
    ("DECIDED", r"\b(?:we\s+)?decided\s+(?:to\s+)?(.+?)(?:\.|$)", 20, 0.68),
    ("USES", r"\b(?:we\s+(?:use|are\s+using|switched\s+to)|switched\s+to)\s+([\p{L}\p{N}_][\p{L}\p{N}_\s\.\-]{1,60}?)(?:\s+for|\s+to|\.|$)", 8, 0.65),
    ("NEXT_STEP", r"\b(?:next\s+step|next\s+we|todo)\s+(?:is\s+)?(?:to\s+)?(.+?)(?:\.|$)", 20, 0.60),
]
#: Words one of which must occur for a statement to be looked for, and the fewest words of the text.
TRIGGERS = ["implemented", "added", "built", "fixed", "resolved", "patched", "decided", "requires", "depends", "using", "switched", "next", "todo", "phase", "corrected", "created", "wrote"]
LEAST_WORDS = 8
#: Captures of one or two words after a verb of use, and of a place of work.
TERM = r"([A-Za-z][A-Za-z0-9._-]*(?:\s+[A-Za-z][A-Za-z0-9._-]*)?)"
USES = [r"\bi (?:use|am using|work with|rely on|depend on)\s+" + TERM, r"\bwe (?:use|are using|adopted|switched to)\s+" + TERM]
PREFERS = [r"\bI (?:strongly |really |always )?(?:prefer|like|love|choose)\s+" + TERM, r"\b" + TERM + r"\s+is (?:my (?:preferred|favorite|go-to)|better|best)\b"]
KNOWS = [r"\bI (?:work|worked) (?:at|for)\s+" + TERM, r"\b" + TERM + r"\s+is (?:a|an) (?:tool|framework|library|language|database|platform)\b"]
#: A word that a capture may not end with, and captures that say nothing.
TRAILING = ["over", "as", "on", "at", "in", "for", "with", "to", "of", "the", "a", "an", "and", "or", "but", "my", "our", "your", "via", "by", "from", "into", "onto", "than"]
EMPTY = ["it", "this", "that", "them", "they", "one", "something", "anything", "everything", "nothing", "some", "any", "all", "both", "each", "many", "much", "more", "most", "other", "another", "such"]
#: Words that no entity is made of.
STOP_WORDS = "a about after again all also am an and any are as at be because been before being below between both but by can could did do does down during each few for from further had has have he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up us very was we were what when where which while who whom why will with would you your".split()


def sentences(docs: DataFrame) -> DataFrame:
    """id, sent (from 0), sentence."""
    return docs.select("id", F.posexplode(T.sentences(F.col("text"))).alias("sent", "sentence"))


def statements(docs: DataFrame) -> DataFrame:
    """id, relation, subject, object (null but for DEPENDS_ON), confidence: every statement of every
    family in texts that are long enough and hold a trigger word; one row per id, relation, subject and object."""
    low = F.lower(T.text("text"))
    live = docs.filter((T.words(F.col("text")) >= LEAST_WORDS) & low.rlike("|".join(TRIGGERS)))

    def family(name: str, pattern: str, most: int, confidence: float) -> Column:
        strip = lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")
        group = lambda i: F.regexp_extract_all(T.text("text"), F.lit("(?i)(?d)" + pattern), F.lit(i))
        two = name == "DEPENDS_ON"
        long, none = (80 if two else 120 if name == "USES" else 160), F.lit(None).cast("string")
        made = lambda v, o: F.struct(F.lit(name).alias("relation"), strip(v).alias("v"), (strip(o) if two else none).alias("o"), F.lit(most).alias("most"), F.lit(long).alias("long"), F.lit(confidence).alias("confidence"))
        return F.zip_with(group(1), group(2), made) if two else F.transform(group(1), lambda v: made(v, v))

    found = F.flatten(F.array(*[family(*s) for s in STATEMENTS]))
    x = live.select("id", F.explode(found).alias("s")).filter((T.words(F.col("s.v")) <= F.col("s.most")) & (F.col("s.v") != "") & (F.col("s.o").isNull() | (F.col("s.o") != "") & (T.words(F.col("s.o")) <= F.col("s.most"))))
    return x.select("id", "s.relation", F.substring(F.col("s.v"), F.lit(1), F.col("s.long")).alias("subject"), F.substring(F.col("s.o"), F.lit(1), F.col("s.long")).alias("object"), "s.confidence").distinct()


def _capture(c: Column, patterns: list[str]) -> Column:
    got = T.first_nonempty(*[F.regexp_extract(c, "(?i)" + p, 1) for p in patterns])
    words = F.split(got, r"\s+")
    two = (F.size(words) > 1) & F.lower(F.element_at(words, -1)).isin(*TRAILING)
    return T.entity(F.when(two, F.element_at(words, 1)).otherwise(got))


def relations(docs: DataFrame, preferences: DataFrame | None = None) -> DataFrame:
    """subject, relation, object, object_id, confidence over all sentences. A preference that is
    already known (preferences: id, value) is the subject of PREFERS; everything else belongs to the
    root. preferences has one id per value by the least id."""
    s = sentences(docs)
    x = s.select("id", "sent", F.explode(F.array(
        F.struct(F.lit("PREFERS").alias("relation"), _capture(F.col("sentence"), PREFERS).alias("object"), F.lit(0.80).alias("confidence")),
        F.struct(F.lit("USES").alias("relation"), _capture(F.col("sentence"), USES).alias("object"), F.lit(0.75).alias("confidence")),
        F.struct(F.lit("KNOWS_ABOUT").alias("relation"), _capture(F.col("sentence"), KNOWS).alias("object"), F.lit(0.70).alias("confidence")),
    )).alias("r")).select("id", "sent", "r.*").filter(F.col("object").isNotNull() & T.is_entity(F.col("object")) & ~F.col("object").isin(*EMPTY))
    if preferences is not None:
        known = preferences.select(F.col("id").alias("_pid"), T.entity(F.col("value")).alias("object")).groupBy("object").agg(F.min("_pid").alias("_pid"))
        x = x.join(known, "object", "left")
    else:
        x = x.withColumn("_pid", F.lit(None).cast("string"))
    prefers = (F.col("relation") == "PREFERS") & F.col("_pid").isNotNull()
    x = x.select(
        F.when(prefers, F.col("_pid")).otherwise("root").alias("subject"), F.when((F.col("relation") == "PREFERS") & ~prefers, "KNOWS_ABOUT").otherwise(F.col("relation")).alias("relation"), "object",
        F.when((F.col("relation") == "PREFERS") & ~prefers, 0.65).otherwise(F.col("confidence")).alias("confidence"),
    )
    return x.groupBy("subject", "relation", "object").agg(F.count(F.lit(1)).alias("mentions"), F.max("confidence").alias("confidence")).withColumn("object_id", T.digest(F.col("object"), 16))


def sentence_terms(docs: DataFrame, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """id, sent, term, tf: words of at least two letters without stop words, and pairs of neighbours
    among what is left."""
    s = sentences(docs)
    w = F.filter(F.regexp_extract_all(F.lower("sentence"), F.lit("[a-z0-9_]{2,}"), F.lit(0)), lambda x: ~x.isin(*stop))
    x = s.withColumn("w", w)
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return x.select("id", "sent", F.explode(F.concat("w", pairs)).alias("term")).groupBy("id", "sent", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(docs: DataFrame, least: float = 0.20, most_terms: int = 15, max_df: float = 0.85, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """id, sent, term, score (9 decimals): per document its sentences are the corpus; idf is
    ln((1 + n) / (1 + df)) + 1, rows are of length 1, terms in more than max_df of the sentences are
    left out (documents of one sentence keep theirs), and each sentence keeps its best terms. `stop` is
    the list of stop words; a longer one is a parameter, not a table here."""
    t = sentence_terms(docs, stop)
    n = sentences(docs).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    df = t.groupBy("id", "term").agg(F.count(F.lit(1)).alias("df"))
    x = t.join(df, ["id", "term"]).join(n, "id").filter((F.col("df") <= max_df * F.col("n")) | (F.col("n") == 1))
    x = x.withColumn("v", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id", "sent")))
    x = x.withColumn("score", F.round(F.col("v") / norm, 9)).filter(F.col("score") >= least)
    w = Window.partitionBy("id", "sent").orderBy(F.desc("score"), "term")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most_terms).select("id", "sent", "term", "score")


def entities(terms: DataFrame) -> DataFrame:
    """term, score (the best), mentions (sentences), documents."""
    return terms.filter(T.is_entity(T.entity(F.col("term")))).groupBy(T.entity(F.col("term")).alias("term")).agg(F.max("score").alias("score"), F.count_distinct("id", "sent").alias("mentions"), F.count_distinct("id").alias("documents"))


def without_parts(terms: DataFrame) -> DataFrame:
    """Per document the terms that are no part of a longer term of the same document: one word is
    dropped if a kept pair holds it."""
    pair = terms.filter(F.contains("term", F.lit(" "))).select("id", F.explode(F.split("term", " ")).alias("term")).distinct()
    return terms.join(pair, ["id", "term"], "left_anti")


def cooccurrences(terms: DataFrame, least: int = 1) -> DataFrame:
    """a < b, count: how many sentences hold both. A sentence has at most 15 terms (see tfidf), so
    its pairs are bounded; pairs are counted map-side before the shuffle."""
    per = terms.groupBy("id", "sent").agg(F.array_sort(F.collect_set(T.entity(F.col("term")))).alias("e"))
    p = per.select(F.explode(F.flatten(F.transform("e", lambda a, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.a", "p.b").filter("a <> '' AND b <> ''")
    return p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= least)


def payloads(found: DataFrame) -> DataFrame:
    """Statements as fact texts: "[RELATION] subject → object", one per relation, beginning of the subject
    and object, the first by id. found: id, relation, subject, object, confidence."""
    key = F.substring("subject", 1, 40).alias("_head")
    first = found.groupBy("relation", key, "object").agg(F.min_by(F.struct("id", "subject", "confidence"), F.struct("id", "subject")).alias("r"))
    text = F.concat(F.lit("["), "relation", F.lit("] "), "r.subject", F.coalesce(F.concat(F.lit(" → "), "object"), F.lit("")))
    return first.select("r.id", "relation", F.substring(text, 1, 320).alias("content"), "r.confidence")


def search_relations(rel: DataFrame, queries: DataFrame, n: int = 8) -> DataFrame:
    """The n relations of each query by coverage of its long words times confidence; words meet in an
    equi-join, so what shares no word is never scored. rel: relation, object, confidence."""
    words = T.long_set(F.col("query"))
    q = queries.select("query_id", F.explode(words).alias("term"), F.size(words).alias("_q"))
    own = T.long_set(F.col("object"))
    r = rel.select("relation", "object", "confidence", F.explode(own).alias("term"), F.size(own).alias("_t"))
    hit = r.join(q, "term").groupBy("query_id", "relation", "object").agg(F.count(F.lit(1)).alias("h"), F.max("_q").alias("_q"), F.max("_t").alias("_t"), F.max("confidence").alias("confidence"))
    score = F.least(F.lit(1.0), 0.7 * F.col("h") / F.col("_q") + 0.3 * F.col("h") / F.col("_t")) * F.col("confidence")
    x = hit.withColumn("score", F.round(score, 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "object", "relation")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("query_id", "relation", "object", "score", "rank")


def context(terms: DataFrame, sents: DataFrame, when: DataFrame, seeds: DataFrame, direct: int = 3, related: int = 5, each: int = 2, most: int = 8) -> DataFrame:
    """What the entity graph knows about the seeds (query_id, term): per seed its `direct` newest
    sentences, then the `each` newest of the `related` terms that share most sentences with it, every
    sentence once at its first visit, `most` per query, as one text. when: id, ts. Newest-per-term
    limits come before any join, so a frequent term brings no more than its few sentences."""
    m = terms.select("id", "sent", "term").distinct()
    w = Window.partitionBy("term").orderBy(F.desc("ts"), "id", "sent")
    newest = m.join(when, "id").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max(direct, each))
    zero = F.lit(0)
    a = seeds.join(newest.filter(F.col("rn") <= direct), "term").select("query_id", zero.alias("o1"), zero.alias("o2"), "term", "rn", "id", "sent")
    held = m.join(seeds, "term").select("query_id", "term", "id", "sent")
    near = held.join(m.withColumnRenamed("term", "other"), ["id", "sent"]).filter("other <> term").groupBy("query_id", "term", "other").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("query_id", "term").orderBy(F.desc("n"), "other")
    near = near.withColumn("o2", F.row_number().over(best)).filter(F.col("o2") <= related)
    b = near.join(newest.filter(F.col("rn") <= each).withColumnRenamed("term", "other"), "other").select("query_id", F.lit(1).alias("o1"), "o2", "term", "rn", "id", "sent")
    visits = a.unionByName(b).join(sents, ["id", "sent"])
    once = visits.groupBy("query_id", "sentence").agg(F.min(F.struct("o1", "o2", "term", "rn", "id", "sent")).alias("v"))
    order = Window.partitionBy("query_id").orderBy("v")
    kept = once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "sentence"))).alias("p")).select("query_id", F.size("p").alias("sentences"), F.array_join(F.transform("p", lambda x: x["sentence"]), "\n---\n").alias("context"))


def index(docs: DataFrame, preferences: DataFrame | None = None, **how) -> dict[str, DataFrame]:
    """All that indexing documents(id, text) yields: sentences, mentions (id, sent, entity), entities,
    edges (co-occurrences), relations, and stats per document."""
    sents = sentences(docs)
    terms = without_parts(tfidf(docs, **how))
    entity = T.entity(F.col("term"))
    mentions = terms.filter(T.is_entity(entity)).select("id", "sent", entity.alias("entity")).distinct()
    per = mentions.groupBy("id").agg(F.count_distinct("entity").alias("entities"), F.count(F.lit(1)).alias("mentions"))
    stats = sents.groupBy("id").agg(F.count(F.lit(1)).alias("sentences")).join(per, "id", "left").select("id", "sentences", F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("mentions", F.lit(0)).alias("mentions"))
    return {"sentences": sents, "mentions": mentions, "entities": entities(terms), "edges": cooccurrences(terms), "relations": relations(docs, preferences), "stats": stats}
