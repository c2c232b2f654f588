"""Which of four languages a text is in, by word dictionaries.

The seeds are closed-class words. `dictionary` extends them from a corpus: texts the seeds decide
count for their language, and a word gets its log-odds for each language, drawn to even by SMOOTH
texts, so that a rare word says little. The counts cover the whole corpus; the dictionary has at
most `most` words, the most frequent ones.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGS = ("en", "de", "fr", "es")
#: Closed-class words of each language that the others lack.
SEEDS = {
    "en": "the is are was were of and to for it that this with how why what which does did first before not be been from can could will would you your we they there has have had about when because",
    "de": "der die das den dem und ist sind war nicht von mit auf zu zum zur ein eine einen einem für wie warum welche welcher wenn dass aus im erst sonst wird wurde haben hat ich wir sie bitte noch auch nach über seit",
    "fr": "le les et est sont du des une pour que qui avec dans pourquoi comment quel quelle sur à au aux ne pas il elle nous vous je ce cette ces mais ou où puis après avant depuis être",
    "es": "el los las y es son del una para que con por qué cómo cuál sobre se su sus no al lo hay pero este esta después antes desde cuando como muy más está",
}
#: Names of the languages in each of them, as roots.
NAMES = {"en": ["english", "englisch", "anglais", "inglés", "ingles"], "de": ["german", "deutsch", "allemand", "alemán", "aleman"], "fr": ["french", "französisch", "français", "francais", "francés", "frances"], "es": ["spanish", "spanisch", "espagnol", "español", "espanol", "castellano"]}
WORD = re.compile(r"[^\W\d_]+")
_SEED = {}
for _l, _w in SEEDS.items():
    for _x in _w.split():
        _SEED.setdefault(_x, set()).add(_l)


#: Texts of each language that a word is taken to occur in besides those seen.
SMOOTH = 4.0
Words = dict[str, tuple[float, float, float, float]]


def by_seeds(n: list[Column]) -> Column:
    """The language whose seeds, counted in n, lead by at least two, null if none does."""
    led = F.lit(None).cast("string")
    for i, x in enumerate(LANGS):
        rest = F.greatest(*[c for j, c in enumerate(n) if j != i])
        led = F.when(n[i] >= rest + 2, x).otherwise(led)
    return led


def counts(texts: DataFrame, by_language: bool = True) -> DataFrame:
    """texts(text) -> w, n (texts that have the word) and for each language the texts of it that do."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    if not by_language:
        return texts.filter("text IS NOT NULL").select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    t = texts.filter("text IS NOT NULL").select(words.alias("_w"))
    t = t.select("_w", *[F.size(F.array_intersect("_w", F.array(*[F.lit(w) for w in sorted(set(SEEDS[x].split()))]))).alias(f"_{x}") for x in LANGS])
    t = t.select(by_seeds([F.col(f"_{x}") for x in LANGS]).alias("_lang"), F.explode("_w").alias("w"))
    return t.groupBy("w").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("_lang") == x, 1)).alias(x) for x in LANGS])


def frequent(word_counts: DataFrame, most: int = 20_000, least: int = 4) -> list:
    """The `most` most frequent words with their counts: a bounded list."""
    return word_counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(most).collect()


def dictionary(rows: list) -> Words:
    """The log-odds per language, within -3 and 3, of the words of `frequent`."""
    if not rows:
        return {}
    n = np.array([[r[x] for x in LANGS] for r in rows], float)
    sizes = n.sum(axis=0)
    # a language that the corpus lacks is out of the question
    p = np.where(sizes > 0, (n + SMOOTH * sizes / max(1.0, sizes.sum())) / np.maximum(sizes, 1.0), 1e-12)
    odds = np.clip(np.log(p / p.mean(axis=1, keepdims=True)), -3, 3)
    return {r.w: tuple(map(float, o)) for r, o, any_ in zip(rows, odds, n.sum(axis=1) > 0, strict=True) if any_}


def detect(text: str, words: Words, margin: float = 2.5) -> str | None:
    """The language of a text, or None if it says too little."""
    a = b = c = d = 0.0
    n = 0
    for w in WORD.findall(text.lower()):
        v = words.get(w)
        if v is not None:
            a, b, c, d, n = a + v[0], b + v[1], c + v[2], d + v[3], n + 1
    if n < 2:
        return None
    score = (a, b, c, d)
    best = max(range(4), key=score.__getitem__)
    return LANGS[best] if all(score[best] - s >= margin for i, s in enumerate(score) if i != best) else None


_DEMAND = re.compile(r"translat|tradu|übersetz|\bin\b|\bauf\b|\bins\b|\ben\b|\bal\b|\binto\b|respond|answer|antwort|répon|write|schreib|escrib|écri", re.I)


def asked_for(text: str) -> set[str]:
    """Languages that a text names with a wish to have them: an answer in one of these is no defect."""
    t = text.lower()
    return {lang for lang, roots in NAMES.items() if any(r in t for r in roots)} if _DEMAND.search(t) else set()
