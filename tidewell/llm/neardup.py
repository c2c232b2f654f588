"""Near-duplicate records with small edits.

Texts are bags of words (runs of letters or digits, lower case, with repeats). One scan turns each
text into the hash of its bag, a DartMinHash signature of its words weighted by their counts, cut
into bands, and parities. Records with the same bag form one class without any comparison.
Classes that share a band are candidates if their sizes and parities allow the threshold, and an
exact comparison of the bags keeps those with a similarity of at least `threshold`.

Parity: every word flips one of PARITY bits, so two bags whose parities differ in h bits differ in
at least h words. This is a bound, not an estimate: it sorts out nearly all pairs that meet in a
band by chance while they are still in the join, and loses none. Those pairs grow with the square of
the records, so there are bits enough for texts of some 200 words, whose few bits would be full.

A band bucket is joined with itself by key, never collected; both sides read one exchange, and the
skew join of adaptive execution splits a bucket that outgrows its task. The bands are joined in
PASSES, and each gives its shuffle files back, so the disk holds the rows of one pass. A pair that
shares several bands is compared once. Only the texts of classes in a candidate pair are read again
for their bags.

Nulls: rows with a null id or a null text are left out. A text without any word is similar to
nothing, another such text included (0 of 0 words). Rows repeated under one id count once; an id
with several texts is linked by any of them, and joins their groups. Texts are processed whole; an
empty table gives no rows; other columns are ignored. Classes are told apart by 64 bits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import skew
from ..session import cut, spread
from . import dartminhash

WORD = re.compile(r"[^\W_]+")
#: Bands and rows a band: a pair at similarity .8 meets in a band with probability 1 - (1 - .8^6)^22 = .9988.
BANDS, ROWS = 22, 6
#: Three longs hold the parity, the first of them the number of words, up to MOST, in its lower bits.
LONGS, SIZE_BITS = 3, 12
PARITY, MOST = 64 * LONGS - SIZE_BITS, 2**SIZE_BITS - 1
PARITIES = tuple(f"parity{i}" for i in range(LONGS))
#: The bands are joined in so many passes.
PASSES = 3


class _Hashes(dict):
    """Words to 64-bit numbers, forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _bag(text: str, memo: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of a text as sorted 64-bit numbers, and how often each occurs."""
    n = Counter(WORD.findall(text.lower()))
    h = np.fromiter((memo[w] for w in n), np.uint64, len(n))
    by = np.argsort(h)
    return h[by], np.fromiter(n.values(), np.int64, len(n))[by]


def _unrolled(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bag as a set: the second occurrence of a word is another number than the first."""
    if not len(counts) or counts.max() == 1:
        return words
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    w = np.repeat(words, counts)
    return np.where(nth == 0, w, dartminhash.mix(w + nth.astype(np.uint64)))


def _class(words: np.ndarray, counts: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(words.tobytes() + counts.tobytes())


def _clean(records: DataFrame) -> DataFrame:
    return records.select(F.col("id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")


def sketches(records: DataFrame, n_bands: int = BANDS, n_rows: int = ROWS, seed: int = 1) -> DataFrame:
    """records(id, text) -> id, cls (hash of the bag), parity0 (with the size) and on, bands (array of
    int). Texts without words have no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Hashes()
        for pdf in batches:
            got = [_bag(t, memo) for t in pdf["text"]]
            cls = np.array([_class(w, c) for w, c in got], np.uint64).view(np.int64)
            some = np.array([len(w) > 0 for w, _ in got], bool)
            if not some.any():
                continue
            ids, cls = pdf["id"].to_numpy()[some], cls[some]
            got = [g for g in got if len(g[0])]
            # copies within a batch are sketched once
            _, first, which = np.unique(cls, return_index=True, return_inverse=True)
            mine = [got[i] for i in first]
            owner = np.repeat(np.arange(len(mine), dtype=np.int32), [len(w) for w, _ in mine])
            words, counts = np.concatenate([w for w, _ in mine]), np.concatenate([c for _, c in mine])
            sig = dartminhash.sketch(owner, words, counts.astype(float), len(mine), n_bands * n_rows, seed)
            keys = dartminhash.bands(sig, n_rows).astype(np.int32)
            at = owner * np.int64(PARITY) + (dartminhash.mix(words) % np.uint64(PARITY)).astype(np.int64)
            bits = np.zeros((len(mine), 64 * LONGS), np.uint8)
            bits[:, SIZE_BITS:] = (np.bincount(at, counts, len(mine) * PARITY) % 2).reshape(len(mine), PARITY)
            parity = np.packbits(bits, axis=1, bitorder="little").view("<i8")
            parity[:, 0] |= np.minimum(np.bincount(owner, counts, len(mine)).astype(np.int64), MOST)
            yield pd.DataFrame({"id": ids, "cls": cls} | {p: parity[which, i] for i, p in enumerate(PARITIES)} | {"bands": list(keys[which])})

    return _clean(records).mapInPandas(run, f"id string, cls bigint, {', '.join(f'{p} bigint' for p in PARITIES)}, bands array<int>")


def bags(records: DataFrame) -> DataFrame:
    """records(id, text) -> cls, bag (array of bigint, repeats as numbers of their own)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Hashes()
        for pdf in batches:
            got = [_bag(t, memo) for t in pdf["text"]]
            yield pd.DataFrame({"cls": np.array([_class(w, c) for w, c in got], np.uint64).view(np.int64), "bag": [_unrolled(w, c).view(np.int64) for w, c in got]})

    return _clean(records).mapInPandas(run, "cls bigint, bag array<bigint>").filter("size(bag) > 0")


def _pairs(classes: DataFrame, threshold: float, first: int = 0, n: int = BANDS) -> DataFrame:
    """classes(cls, parities, bands), one row each -> distinct candidates a < b: classes of one bucket
    of the n bands from `first` on whose sizes and parities allow the threshold."""
    rows = classes.select("cls", *PARITIES, F.posexplode(F.slice("bands", first + 1, n)).alias("_i", "_h"))
    key = F.shiftleft(F.col("_i").cast("bigint"), 32).bitwiseOR(F.col("_h").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))
    side = lambda cls, p: rows.select(key.alias("band"), F.col("cls").alias(cls), *(F.col(x).alias(f"{p}{i}") for i, x in enumerate(PARITIES)))
    na, nb = (F.col(p).bitwiseAND(F.lit(MOST).cast("bigint")) for p in ("pa0", "pb0"))
    long = (na == MOST) | (nb == MOST)
    fits = (na >= nb * threshold) & (nb >= na * threshold)
    # |A and B| >= t / (1 + t) (na + nb), so at most (1 - t) / (1 + t) (na + nb) words lie in one bag alone
    differ = [F.col(f"pa{i}").bitwiseXOR(F.col(f"pb{i}")) for i in range(LONGS)]
    flipped = sum((F.bit_count(x) for x in differ[1:]), F.bit_count(F.shiftrightunsigned(differ[0], SIZE_BITS)))
    apart = flipped <= (na + nb) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return side("a", "pa").join(side("b", "pb"), "band").filter((F.col("a") < F.col("b")) & (long | fits & apart)).select("a", "b").distinct()


def _candidates(classes: DataFrame, threshold: float, n_bands: int) -> DataFrame:
    """The distinct candidates of all bands, pass by pass."""
    n = -(-n_bands // PASSES)
    parts = [cut(_pairs(classes, threshold, first, n), "candidates", release=True) for first in range(0, n_bands, n)]
    return cut(reduce(DataFrame.unionByName, parts).distinct(), "candidates", release=True)


def classes_and_links(records: DataFrame, threshold: float = 0.8, n_bands: int = BANDS, n_rows: int = ROWS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: id, cls — the class of equal bags of each id (an id with several
    texts has several rows). links: a < b, classes whose similarity is at least `threshold`, and
    the similarity."""
    s = cut(sketches(spread(records), n_bands, n_rows, seed), "sketches", release=True)
    members = s.select("id", "cls").distinct()
    cand = _candidates(cut(s.drop("id").distinct(), "classes", release=True), threshold, n_bands)
    need = cand.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    # one record of each class that a candidate needs
    pick = s.select("cls", "id").join(need, "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("id"))
    texts = _clean(records).join(pick.select("id").distinct(), "id", "left_semi").distinct()
    bag = bags(texts).join(need, "cls", "left_semi").groupBy("cls").agg(F.first("bag").alias("bag"))
    bag = cut(bag, "bags", release=True)
    both = cand.join(bag.select(F.col("cls").alias("a"), F.col("bag").alias("bag_a")), "a").join(bag.select(F.col("cls").alias("b"), F.col("bag").alias("bag_b")), "b")
    links = (
        both.withColumn("_s", F.size(F.array_intersect("bag_a", "bag_b")))
        .withColumn("similarity", F.col("_s") / (F.size("bag_a") + F.size("bag_b") - F.col("_s")))
        .filter(F.col("similarity") >= threshold)
        .select("a", "b", "similarity")
    )
    return members, cut(links, "links", release=True)


def similar_pairs(records: DataFrame, threshold: float = 0.8, **how) -> DataFrame:
    """All pairs of different ids (id_a < id_b) whose texts are similar, equal texts included.
    This form expands groups of copies, so its size is that of its result; `groups` doesn't."""
    members, links = classes_and_links(records, threshold, **how)
    a = members.select(F.col("id").alias("id_a"), F.col("cls").alias("a"))
    b = members.select(F.col("id").alias("id_b"), F.col("cls").alias("b"))
    across = links.select("a", "b").join(a, "a").join(b, "b").select("id_a", "id_b")
    within = a.join(b, F.col("a") == F.col("b")).filter("id_a < id_b").select("id_a", "id_b")
    return across.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).filter("id_a <> id_b").unionByName(within).distinct()


def groups(records: DataFrame, threshold: float = 0.8, rounds: int = 40, **how) -> DataFrame:
    """One row per id: group_id (the smallest id of its connected component), copies (records
    with the same bag, itself included) and links (similar classes). Components are found by
    alternating minimum label and pointer jumping, each round written to the shared folder."""
    members, links = classes_and_links(records, threshold, **how)
    members = cut(members, "members")
    # the classes of an id with several texts are one group
    several = members.groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("_b")).filter("a < _b").select("id", "a")
    same = skew.lookup(members, several, "id", "inner").filter("cls <> a").select("a", F.col("cls").alias("b"))
    both = lambda df: df.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(df.select(F.col("b").alias("x"), F.col("a").alias("y")))
    sym = cut(both(links.select("a", "b").unionByName(same)).distinct(), "edges")
    label = cut(members.select(F.col("cls").alias("x")).distinct().withColumn("label", F.col("x")), "label")
    for _ in range(rounds):
        least = skew.lookup(sym, label.withColumnRenamed("x", "y"), "y", "inner").groupBy("x").agg(F.min("label").alias("other"))
        step = label.join(least, "x", "left").select("x", F.least("label", "other").alias("label"))
        step = cut(step, "label")
        jump = skew.lookup(step, step.select(F.col("x").alias("label"), F.col("label").alias("root")), "label").select("x", F.least("label", "root").alias("label"))
        jump = cut(jump, "label")
        moved = jump.join(label.withColumnRenamed("label", "old"), "x").filter("label <> old").limit(1).count()
        label = jump
        if not moved:
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    degree = both(links).groupBy("x").agg(F.count(F.lit(1)).alias("links"))
    copies = members.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
    per_class = label.join(degree, "x", "left").join(copies, label.x == copies.cls).select(F.col("x").alias("cls"), F.col("label").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    one = skew.lookup(members, per_class, "cls", "inner").groupBy("id").agg(F.min("group_id").alias("_g"), F.max("copies").alias("copies"), F.max("links").alias("links"))
    one = cut(one, "grouped")
    return skew.lookup(one, one.groupBy("_g").agg(F.min("id").alias("group_id")), "_g", "inner").select("id", "group_id", "copies", "links")
