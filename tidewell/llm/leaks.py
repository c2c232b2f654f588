"""Evaluation texts leaking into training text.

Winnowing: over the words of a text, each window of `window` successive k-gram hashes keeps its
minimum. A shared run of at least window + k - 1 words contains a whole window of equal k-grams,
so both sides keep the same fingerprint of it: with k = 10 and window = 11 no shared run of 20
words is missed. Kept fingerprints of the documents are joined with those of the items, and each
hit is extended word by word to its full run.

The held-out side is small and fixed: its fingerprints are joined on the map side, in blocks of at
most `block` items and about BLOCK_BYTES of text, each block one pass over the documents, so that what is sent to the tasks has
a bound whatever its size. The documents are scanned once per block and never shuffled.

Null or empty texts on either side leak nothing; items of fewer than `run` words cannot be held
with `run` words and give no rows; repeated documents and items count each by their own id; rows
with a null id are left out; an empty table gives no rows. Texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .dartminhash import mix
from .wiki import WORD, visible_words

RUN, K = 20, 10
#: Bytes of held-out text that one pass takes along.
BLOCK_BYTES = 64_000_000
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


def _codes(words: list[str], memo: dict[str, int]) -> list[int]:
    out = []
    for w in words:
        h = memo.get(w)
        if h is None:
            if len(memo) > 300_000:
                memo.clear()
            h = memo[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return out


def fingerprints(codes: np.ndarray, starts: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) kept by winnowing several texts laid end to end; starts: where each
    begins, with the end of the last. Hashes of k-grams across two texts are never kept."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + codes[j : j + n]
    h = np.minimum(mix(h), _FAR - np.uint64(1))
    crossing = np.zeros(len(codes) + 1, bool)
    for e in starts[1:-1]:
        crossing[max(0, e - k + 1) : e] = True
    h[crossing[:n]] = _FAR
    low = np.full(n + 2 * window, _FAR)  # the minimum of each window that starts at i - window
    low[window : window + n] = h
    size, span = low.copy(), 1
    while span * 2 <= window:
        size[: len(size) - span] = np.minimum(size[: len(size) - span], size[span:])
        span *= 2
    size[: len(size) - (window - span)] = np.minimum(size[: len(size) - (window - span)], size[window - span :])
    # a hash is kept if it is the minimum of any window that holds it
    most = size.copy()
    held = np.zeros(n, bool)
    for j in range(window):
        held |= h == most[window - j : window - j + n]
    held &= h != _FAR
    at = np.flatnonzero(held)
    return at, h[at]


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, k: int = K, block: int = 20_000) -> DataFrame:
    """documents(doc_id, text), items(item_id, text) -> doc_id, item_id, words (the longest shared
    run), first_word (where it begins in the document), one row for each pair with a run of `run`."""
    window = run - k + 1
    docs = spread(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL"))
    its = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    many, size = its.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-many // block), -(-size // BLOCK_BYTES))
    parts = []
    for b in range(blocks):
        held_out = its.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        parts.append(_pass(docs, [(r.item_id, r.text) for r in held_out], run, k, window))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pass(docs: DataFrame, held_out: list[tuple[int, str]], run: int, k: int, window: int) -> DataFrame:
    memo: dict[str, int] = {}
    rows = [(i, np.array(_codes(WORD.findall(t.lower()), memo), np.uint64)) for i, t in held_out]
    ids = np.array([i for i, _ in rows], np.int64)
    codes = np.concatenate([c for _, c in rows]) if rows else np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(c) for _, c in rows])]).astype(np.int64)
    at, fp = fingerprints(codes, starts, k, window)
    by = np.argsort(fp, kind="stable")
    at, fp = at[by], fp[by]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for pdf in batches:
            words = [_codes(visible_words(t), seen) for t in pdf["text"]]
            begin = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
            text = np.fromiter((c for w in words for c in w), np.uint64, begin[-1])
            pos, h = fingerprints(text, begin, k, window)
            lo, hi = np.searchsorted(fp, h, "left"), np.searchsorted(fp, h, "right")
            best: dict[tuple[int, int], tuple[int, int]] = {}
            done: set[tuple[int, int]] = set()
            for i in np.flatnonzero(hi > lo):
                p = int(pos[i])
                d = int(np.searchsorted(begin, p, "right")) - 1
                for q in at[lo[i] : hi[i]].tolist():
                    e = int(np.searchsorted(starts, q, "right")) - 1
                    back = min(p - begin[d], q - starts[e])
                    ahead = min(begin[d + 1] - p, starts[e + 1] - q)
                    same = text[p - back : p + ahead] == codes[q - back : q + ahead]
                    if not same[back : back + k].all():
                        continue
                    left = np.flatnonzero(~same[:back])
                    first = int(left[-1]) + 1 if len(left) else 0
                    right = np.flatnonzero(~same[back:])
                    last = back + int(right[0]) if len(right) else back + ahead
                    start = p - back + first
                    if (start, q - back + first) in done:
                        continue
                    done.add((start, q - back + first))
                    n = int(last - first)
                    if n >= run and n > best.get((d, e), (0, 0))[0]:
                        best[d, e] = (n, int(start - begin[d]))
            doc = pdf["doc_id"].to_numpy()
            yield pd.DataFrame(
                {
                    "doc_id": np.array([doc[d] for d, _ in best], np.int64),
                    "item_id": np.array([ids[e] for _, e in best], np.int64),
                    "words": np.array([n for n, _ in best.values()], np.int32),
                    "first_word": np.array([s for _, s in best.values()], np.int32),
                }
            )

    return docs.mapInPandas(scan, "doc_id bigint, item_id bigint, words int, first_word int")


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p7_found: distinct (doc_id, item_id)."""
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item that leaked: documents that hold it and the longest run."""
    return leaks(documents, items).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("words").alias("longest_run"))
