"""Broken prompt and response pairs.

Each assistant row is set against the question before it — the user rows since the previous answer,
or the last user row — and gets at most one defect:

- empty: blank content;
- refusal: every clause is judged a refusal or its courtesy (see refusals);
- copy: the answer, compressed with its question as zstandard dictionary, leaves next to nothing,
  and so does the question compressed with the answer; the limits are calibrated on made-up answers
  that give the question back and such that quote it and go on;
- language: language dictionaries see another language than the question's, none the question asks for;
- truncated: it ends without a stop where sentences go on, or inside a bracket, quote or fence
  (terminal contexts, see endings).

Questions are found in blocks of time per session (skew.with_blocks): no session is one task. The
user rows of one question are numbered over the blocks and gathered whole.
Rows with a null id are left out; a null content is blank; without a question only empty, refusal
and truncated can hold. A null time sorts first. Every delivery of a row is judged. Repeated rows
give one row. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import skew
from ..session import cut
from . import endings, languages, refusals
from .conversations import MILLIS_FROM, is_blank, speaker

#: What introduces a question given back.
LEAD_IN = re.compile(r"^\W*(?:you asked|you said|you wrote|your question(?: was| is)?|question|the question (?:was|is)|quote|du (?:hast gefragt|fragtest)|sie (?:haben gefragt|fragten)|(?:deine|ihre) frage(?: war| ist| lautet)?|frage|vous avez demandé|vous demandiez|tu as demandé|tu demandais|votre question(?: était)?|ta question(?: était)?|preguntaste|has preguntado|usted preguntó|tu pregunta(?: era| es)?|su pregunta(?: era| es)?|pregunta)\b\s*[:,–-]?\s*", re.I)

_SPLIT = re.compile(r"(?<=[.!?;])\s+|\n+")
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|https?://\S+|\S+@\S+|\b\w+\(\)", re.S)
_WORD = re.compile(r"[^\W_]+")
#: What a frame of zstandard takes besides the data.
_FRAME = 9
_PLAIN = {"level": 3, "write_content_size": False, "write_checksum": False}
_BARE = zstandard.ZstdCompressor(**_PLAIN)


def left_over(known: str, text: str) -> float:
    """Compressed size of the text with `known` as dictionary, over that without it."""
    t = text.encode()
    d = zstandard.ZstdCompressionDict(known.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    bare = len(_BARE.compress(t))
    return max(0, len(zstandard.ZstdCompressor(dict_data=d, **_PLAIN).compress(t)) - _FRAME) / max(1, bare - _FRAME)


class Limits(NamedTuple):
    """A copy leaves at most `new` of itself beyond the question, `apart` more than the question
    leaves beyond it, and the question at most `lost` beyond the copy."""

    new: float
    lost: float
    apart: float


def _spoken(text: str) -> str:
    return " ".join(_WORD.findall(text.casefold()))


def measures(question: str, answer: str, most: float = 1.0) -> tuple[float, float] | None:
    """(what the answer leaves beyond the question, what the question, whole or its last sentence,
    leaves beyond the answer); None if either has too few words or the first is above `most`."""
    a, q = _spoken(LEAD_IN.sub("", answer)), _spoken(question)
    if a.count(" ") < 2 or q.count(" ") < 2:
        return None
    new = left_over(q, a)
    if new > most:
        return None
    last = _spoken([s for s in _SPLIT.split(question) if _WORD.search(s)][-1])
    return new, min(left_over(a, q), left_over(a, last) if 2 <= last.count(" ") and last != q else 1.0)


def is_copy(question: str, answer: str, limits: Limits) -> bool:
    """The answer gives back the question and nothing new."""
    got = measures(question, answer, limits.new)
    return got is not None and got[1] <= limits.lost and got[0] - got[1] <= limits.apart


@cache
def copy_limits(n: int = 400, seed: int = 3) -> Limits:
    """Calibrated on made-up questions with answers that copy them and answers that do not."""
    r = random.Random(seed)
    empty = {x: sorted(set(w.split())) for x, w in languages.SEEDS.items()}
    made = lambda: "".join(r.choice("ba do fe gar hi jol ka lum mo ne pas ro sen ta vu wir".split()) for _ in range(r.randint(2, 4)))

    def sentence(lang: str, end: str = ".") -> str:
        return " ".join(r.choice(empty[lang]) if r.random() < 0.55 else made() if r.random() < 0.8 else str(r.randint(1, 99999)) for _ in range(r.randint(6, 16))).capitalize() + end

    rows = []
    for _ in range(n):
        lang = r.choice(languages.LANGS)
        last = sentence(lang, "?")
        q = " ".join([sentence(lang) for _ in range(r.choice((0, 0, 1, 2)))] + [last])
        w = last.split()
        edited = w[:]
        edited[r.randrange(len(w))] = made()
        longer = w[:]
        longer.insert(r.randrange(1, len(w)), made() + made())
        for copy in (q, q.upper(), last, f"{q}\n{q}", q.replace("?", "."), " ".join(edited), " ".join(longer)):
            rows.append((q, copy, True))
        topic = r.choice([x for x in w if len(x) > 5] or w)
        short = " ".join([*(r.choice(empty[lang]) for _ in range(2)), made(), made()]) + "."
        for other in (sentence(lang), f"> {q}\n{sentence(lang)}", f"{last} {sentence(lang)}", f"> {q}\n{short}", f"{topic} {sentence(lang)}", " ".join(w[: len(w) // 2]) + " " + sentence(lang)):
            rows.append((q, other, False))
    got = [(*m, y) for q, a, y in rows if (m := measures(q, a)) is not None]
    new, lost, y = (np.array(c) for c in zip(*got, strict=True))
    best, at = -1.0, []
    for i in np.arange(0.2, 0.71, 0.05):
        for j in np.arange(0.2, 0.71, 0.05):
            for k in np.arange(0.05, 0.41, 0.05):
                right = float((((new <= i) & (lost <= j) & (new - lost <= k)) == y).mean())
                if right > best + 1e-9:
                    best, at = right, []
                if right >= best - 1e-9:
                    at.append((i, j, k))
    return Limits(*map(float, np.median(np.array(at), axis=0)))


def pairs(rows: DataFrame) -> DataFrame:
    """rows(table_name, id, session_id, speaker, said, seconds, content) -> the assistant rows with
    `question` (null if there is none) and `answer`."""
    r = rows.filter("speaker IN ('user', 'assistant')")
    keys, order = ["table_name", "session_id"], ["seconds", "id"]
    user, answer = (F.col("speaker") == "user") & F.col("said"), F.col("speaker") == "assistant"
    r = skew.with_blocks(r, keys, "seconds")
    r = skew.previous(r, keys, order, ["content"], "_last", where=user)
    # a run is the rows since the previous answer and the answer that ends it, however many and in whatever blocks
    r = skew.running(r, keys, order, {"_run": answer.cast("long")})
    runs = r.groupBy(*keys, (F.col("_run") - answer.cast("long")).alias("_run")).agg(
        F.array_sort(F.collect_list(F.when(user, F.struct("seconds", "id", "content")))).alias("_asked"),
        F.max(F.when(answer, F.struct("id", "said", "content", F.col("_last.content").alias("last")))).alias("_a"),
    )
    asked = F.when(F.size("_asked") > 0, F.array_join(F.transform("_asked", lambda x: x["content"]), "\n"))
    return runs.filter("_a IS NOT NULL").select("table_name", "_a.id", F.coalesce(asked, "_a.last").alias("question"), "_a.said", F.col("_a.content").alias("answer"))


def all_rows(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """Both tables in one shape; rows of turns repeated under one turn_id count once."""
    m = messages.select(F.lit("messages").alias("table_name"), F.col("id").cast("bigint").alias("id"), "session_id", "role", "content", "timestamp")
    t = turns.select(F.lit("turns").alias("table_name"), F.col("turn_id").cast("bigint").alias("id"), "session_id", "role", "content", "timestamp").distinct()
    s = F.col("timestamp").cast("double")
    return m.unionByName(t).filter("id IS NOT NULL").select(
        "table_name", "id", "session_id", speaker(F.col("role")).alias("speaker"), (~is_blank(F.col("content"))).alias("said"), F.when(s > MILLIS_FROM, s / 1000).otherwise(s).alias("seconds"), "content"
    )


def judged(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """table_name, answer_id, defect (null for a sound pair) of every assistant row."""
    rows = cut(all_rows(messages, turns), "rows")
    texts = rows.filter("said").select(F.col("content").alias("text"))
    common = languages.frequent(languages.counts(texts))
    words, known = endings.chosen(common, texts.count()), languages.dictionary(common)
    refuses, limits = refusals.judge(), copy_limits()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            labels, looks = [], []
            refused = refuses.texts([a if said else "" for said, a in zip(pdf["said"], pdf["answer"], strict=True)])
            for q, said, a, no in zip(pdf["question"], pdf["said"], pdf["answer"], refused, strict=True):
                label, tail = None, (True, False, False, [0, 0, 0, 0])
                if not said:
                    label = "empty"
                elif no:
                    label = "refusal"
                elif isinstance(q, str) and is_copy(q, a, limits):
                    label = "copy"
                else:
                    if isinstance(q, str):
                        lq, la = (languages.detect(_CODE.sub(" ", t) if any(c in t for c in ("`", "@", "//", "()")) else t, known) for t in (q, a))
                        if lq and la and lq != la and la not in languages.asked_for(q):
                            label = "language"
                    tail = endings.look(a, words)
                labels.append(label)
                looks.append(tail)
            yield pd.DataFrame(
                {
                    "table_name": pdf["table_name"], "answer_id": pdf["id"], "label": pd.Series(labels, dtype=object),
                    "ended": [x[0] for x in looks], "marked": [x[1] for x in looks], "open": [x[2] for x in looks],
                    **{f"k{i}": np.array([x[3][i] for x in looks], np.int64) for i in range(4)},
                }
            )

    found = cut(pairs(rows).mapInPandas(run, "table_name string, answer_id bigint, label string, ended boolean, marked boolean, open boolean, k0 bigint, k1 bigint, k2 bigint, k3 bigint"), "answers")
    t = endings.end_chance(found, endings.contexts(texts.distinct(), words))
    cut_off = ~F.col("ended") & (F.col("open") | (F.col("chance") < endings.UNFINISHED))
    return t.select("table_name", "answer_id", F.coalesce("label", F.when(cut_off, "truncated")).alias("defect")).distinct()


def found(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """p5_found: table_name, answer_id, defect of the defective pairs."""
    return judged(messages, turns).filter("defect IS NOT NULL").select("table_name", "answer_id", "defect").distinct()


def report(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """Answers per table and defect."""
    return judged(messages, turns).groupBy("table_name", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count(F.lit(1)).alias("answers"))
