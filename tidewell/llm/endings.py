"""Terminal contexts: does a text without a final stop end where its author would end?

Texts become sequences of abstract tokens: a frequent word stands for itself, any other word for
its length class, a number for a number. Over all sentences of a corpus, each position counts as an
end or a continuation of its contexts — the first two tokens of the sentence with the last three,
and the last four, three and two. The chance that a sentence ends after a given tail is backed off
from the longest context to the shortest and from there to a small constant, so a tail never seen,
such as a word cut in half, counts as unfinished.

The vocabulary and the context counts are Spark aggregates over the whole corpus. The vocabulary
sent to the tasks has at most VOCABULARY words. Contexts are never collected: tails meet them in a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import skew
from ..session import spread
from . import languages

#: Words that stand for themselves; packed into 12 bits with the classes below.
VOCABULARY = 4000
#: A word of the vocabulary occurs in at least one text of so many.
ONE_IN = 1500
#: Strength of a shorter context against the counts of the longer, and the chance of an end after an unknown tail.
BACKOFF, UNKNOWN = 2.0, 0.02
#: Below this chance a tail is unfinished. A sentence has many more continuations than ends, so the odds are skewed on purpose.
UNFINISHED = 0.2

_PAD, _NUMBER, _SHORT, _MIDDLE, _LONG, _PART, _OTHER = range(7)
_PUNCT = {c: 7 + i for i, c in enumerate(",;:()[]{}\"'/-.!?«»„“”`*_<>=+#%&@…|\\")}
_BASE = 7 + len(_PUNCT)
_TOKEN = re.compile(r"\d+|[^\W\d_]+|[^\w\s]|_|\n")
#: Marks that a cut leaves behind.
_MARK = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…|truncated|cut|abgeschnitten|gekürzt|tronqué|coupé|truncado|cortado)\s*\]|\(\s*(?:\.\.\.|…|truncated|cut|continued)\s*\)|<\s*(?:truncated|cut)\s*>|\.\.\.|…|--+>?)\s*$", re.I)
_STOP = re.compile(r"(?:[.!?。！？][\"'”’»)\]*_`]*|`)\s*$")


class Words(dict):
    """The numbers of the frequent words, and the beginnings of these words."""

    def __init__(self, words: list[str]) -> None:
        super().__init__((w, _BASE + i) for i, w in enumerate(words))
        self.parts = {w[:i] for w in words for i in range(1, len(w))}

    def __reduce__(self):
        return Words, (list(self),)


def vocabulary(texts: DataFrame) -> Words:
    """texts(text) -> the numbers of the frequent words. A bounded aggregate over all texts."""
    return chosen(languages.frequent(languages.counts(spread(texts), False), VOCABULARY - _BASE), texts.filter("text IS NOT NULL").count())


def chosen(rows: list, texts: int) -> Words:
    """The vocabulary out of `languages.frequent`, for a corpus of so many texts."""
    return Words([r.w for r in rows[: VOCABULARY - _BASE] if r.n >= max(4, texts // ONE_IN)])


def _number(token: str, words: Words) -> int:
    got = words.get(token)
    if got is not None:
        return got
    if token.isdigit():
        return _NUMBER
    if token[0].isalpha():
        if token in words.parts:
            return _PART
        return _SHORT if len(token) <= 3 else _MIDDLE if len(token) <= 5 else _LONG
    return _PUNCT.get(token, _OTHER)


def _sentences(text: str, words: Words) -> list[tuple[list[int], bool]]:
    """(abstract tokens, ended by a stop) of each sentence."""
    out, now = [], []
    found = _TOKEN.findall(text.lower())
    for i, t in enumerate(found):
        if t == "\n":
            if now:
                out.append((now, True))
                now = []
        elif t in ".!?…":
            if i + 1 < len(found) and found[i + 1] in ".!?…":
                continue  # of several stops the last one counts
            if now:
                out.append((now, True))
                now = []
        else:
            now.append(_number(t, words))
    if now:
        out.append((now, False))
    return out


def _pack(first: np.ndarray, second: np.ndarray, t2: np.ndarray, t1: np.ndarray, t0: np.ndarray, t3: np.ndarray) -> list[np.ndarray]:
    a, b, c = t2.astype(np.int64), t1.astype(np.int64), t0.astype(np.int64)
    two = (b << 12) | c
    three = (a << 24) | two
    four = (t3.astype(np.int64) << 36) | three
    anchored = (first.astype(np.int64) << 48) | (second.astype(np.int64) << 36) | three
    return [anchored * 4, four * 4 + 1, three * 4 + 2, two * 4 + 3]


def _shifts(flat: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """The tokens 0 to 3 before each position, the first two tokens of its sentence."""
    out = []
    at = np.arange(len(flat)) - begin
    for k in range(4):
        s = np.zeros(len(flat), np.int64)
        if k < len(flat):
            s[k:] = flat[: len(flat) - k]
        s[at < k] = _PAD
        out.append(s)
    second = np.minimum(begin + 1, len(flat) - 1)
    second = np.where(at >= 1, flat[second], _PAD) if len(flat) else flat
    return [*out, flat[begin] if len(flat) else flat, second]


#: Texts without a final stop count as ends of their tails from so many different texts on.
FINALS = 12
#: Texts of so few words are brief, not cut.
BRIEF = 2


def contexts(texts: DataFrame, words: Words) -> DataFrame:
    """key, ends, finals, seen of every context in the sentences of texts(text): how often a stop
    ends it, how often the text ends there without a stop, and how often it occurs. A text that
    ends in a part of a frequent word or in an unknown short word is no final."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens: list[int] = []
            begin: list[int] = []
            stopped: list[int] = []
            final: list[int] = []
            for t in pdf["text"]:
                for s, ended in _sentences(t, words):
                    begin.extend([len(tokens)] * len(s))
                    tokens.extend(s)
                    if ended:
                        stopped.append(len(tokens) - 1)
                    elif s[-1] not in (_PART, _SHORT):
                        final.append(len(tokens) - 1)
            flat, b = np.array(tokens, np.int64), np.array(begin, np.int64)
            end, fin = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
            end[stopped] = 1
            fin[final] = 1
            t0, t1, t2, t3, first, second = _shifts(flat, b)
            keys = np.concatenate(_pack(first, second, t2, t1, t0, t3)) if len(flat) else flat
            u, inverse, seen = np.unique(keys, return_inverse=True, return_counts=True)
            count = lambda x: np.bincount(inverse, np.tile(x, 4), len(u)).astype(np.int64) if len(u) else u  # noqa: E731,B023
            yield pd.DataFrame({"key": u, "ends": count(end), "finals": count(fin), "seen": seen.astype(np.int64)})

    return (
        spread(texts.select("text").filter("text IS NOT NULL")).mapInPandas(run, "key bigint, ends bigint, finals bigint, seen bigint")
        .groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("finals").alias("finals"), F.sum("seen").alias("seen"))
    )


#: A remark after the text: in brackets, or a signature or version after a dash.
_REMARK = re.compile(r"\s+(?:\([^()\n]{1,30}\)|\[[^\[\]\n]{1,30}\]|(?:--|[–—])\s*\w{1,16})\s*$")


def unmarked(text: str) -> str:
    """The text without the marks of a cut at its end."""
    before = None
    while before != text:
        before, text = text, _MARK.sub("", text)
    return text.rstrip()


def is_open(text: str) -> bool:
    """A bracket, code fence or straight double quote of the last paragraph that is never closed."""
    if text.count("```") % 2:
        return True
    tail = text.rsplit("\n\n", 1)[-1]
    line = tail.rsplit("\n", 1)[-1]
    for o, c in ("()", "{}", "[]", "«»", "“”", "„“"):
        if o != c and line.count(o) > line.count(c) and line.rfind(o) > line.rfind(c) and o in "({[«":
            return True
    return line.count('"') % 2 == 1 and not line.rstrip().endswith('"')


def _last_sentence(text: str, words: Words) -> list[int]:
    """The abstract tokens of the last sentence: the last element of `_sentences`, without the others."""
    t = text.rstrip(" \t\r\n\f\v.!?…")
    start = max(t.rfind(c) for c in ".!?…\n") + 1
    return [_number(x, words) for x in _TOKEN.findall(t[start:].lower())]


def _signed(x: int) -> int:
    """x as the 64-bit number that numpy makes of it."""
    return (x + 2**63) % 2**64 - 2**63


def look(text: str, words: Words) -> tuple[bool, bool, bool, list[int]]:
    """(ended by a stop, marked as cut, open, the four context keys of the tail)."""
    t = text.strip()
    bare = unmarked(t)
    marked = bare != t
    plain = _REMARK.sub("", bare)
    ended = not marked and bool(_STOP.search(t) or _STOP.search(plain) or len(t.split()) <= BRIEF) or not bare
    s = _last_sentence(bare, words)
    if not s:
        return ended, marked, False, [0, 0, 0, 0]
    f = [_PAD, _PAD, _PAD, *s]
    two = f[-2] << 12 | f[-1]
    three = f[-3] << 24 | two
    anchored = s[0] << 48 | (s[1] if len(s) > 1 else _PAD) << 36 | three
    return ended, marked, is_open(bare), [_signed(anchored * 4), _signed((f[-4] << 36 | three) * 4 + 1), three * 4 + 2, two * 4 + 3]


def tails(texts: DataFrame, keys: list[str], words: Words) -> DataFrame:
    """texts(keys, text) -> keys, ended, marked, open, k0..k3. A null text is ended."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*keys).schema), "ended boolean, marked boolean, open boolean, k0 bigint, k1 bigint, k2 bigint, k3 bigint"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [look(t, words) if t is not None else (True, False, False, [0, 0, 0, 0]) for t in pdf["text"]]
            out = pdf[keys].copy()
            out["ended"], out["marked"], out["open"] = [g[0] for g in got], [g[1] for g in got], [g[2] for g in got]
            for i in range(4):
                out[f"k{i}"] = np.array([g[3][i] for g in got], np.int64)
            yield out

    return spread(texts.select(*keys, "text")).mapInPandas(run, schema)


def end_chance(tail: DataFrame, counts: DataFrame) -> DataFrame:
    """tail plus `chance`, the backed-off chance that a sentence ends there. Distinct tails are
    scored once; the records then look their tail's score up, hot tails spread over tasks."""
    pattern = F.xxhash64("k0", "k1", "k2", "k3")
    distinct = tail.select("k0", "k1", "k2", "k3").distinct()
    one = distinct.select(pattern.alias("pattern"), F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("order", "key"))
    scored = skew.lookup(one, counts, "key").groupBy("pattern").agg(
        *[F.max(F.when(F.col("order") == i, F.col("ends") + F.when(F.col("finals") >= FINALS, F.col("finals") - 1).otherwise(0))).alias(f"e{i}") for i in range(4)], *[F.max(F.when(F.col("order") == i, F.col("seen"))).alias(f"n{i}") for i in range(4)]
    )
    p: Column = F.lit(UNKNOWN)
    for i in (3, 2, 1, 0):
        p = (F.coalesce(F.col(f"e{i}"), F.lit(0)) + BACKOFF * p) / (F.coalesce(F.col(f"n{i}"), F.lit(0)) + BACKOFF)
    return skew.lookup(tail.withColumn("pattern", pattern), scored.select("pattern", p.alias("chance")), "pattern").drop("pattern")
