"""Subject areas of documents.

The units are the sentences of a page's own prose, since a document's subjects are defined by the
shares of its sentences. Fitting runs on a bounded sample of labelled documents (MAX_LABELLED
documents and MAX_BYTES of text, those with the smallest hash of their id):

1. Terms: an EM over the sentences, each restricted to the labels of its document (a label may be
   wrong: others keep a small weight), gives P(subject | term) and with it how discriminative a
   term is — the divergence of that distribution from the subjects' own.
2. Bisecting k-means over the normalised, discriminativeness-weighted term vectors of the
   sentences splits the leaf of the greatest scatter until `leaves` leaves or none is scattered.
3. A leaf is labelled by its discriminative terms: its mixture over subjects is that of its
   centroid's terms.

Then every document, labelled or not, is scanned once: a sentence goes to the leaf of the nearest
centroid, and that leaf's mixture is its vote, one vote split over subjects. Whether it votes at all
is decided by its terms: a sentence without discriminative terms, or with too weak ones, has no
subject. A document has the subjects with at least `share` of its votes (no subject lies between
.15 and .3, so .225 is used).

Null text, redirects, pages outside namespace 0 (a null namespace counts as 0) and texts without
prose have no rows; a null doc_id is left out; repeated rows of one doc_id give equal rows, made
distinct. Without labels, or with an empty documents table, the result is empty.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import spread
from . import wiki

#: Bounds of the labelled sample that is fitted on: documents, and bytes of their texts together.
MAX_LABELLED, MAX_BYTES = 20_000, 256_000_000
SHARE = 0.225


def _terms(sentence: str, memo: dict[str, int]) -> tuple[int, ...]:
    return tuple(sorted({memo[w] for w in wiki.WORD.findall(sentence.lower()) if w in memo}))


class Model:
    """Fitted terms, leaves and mixtures. All state is small: terms x subjects and leaves x terms."""

    def __init__(self, subjects: list[str], vocabulary: dict[str, int], lift: np.ndarray, weight: np.ndarray, centroids: np.ndarray, mixtures: np.ndarray, clear: float) -> None:
        self.subjects, self.vocabulary, self.lift, self.weight = subjects, vocabulary, lift, weight
        self.centroids, self.mixtures, self.clear = np.ascontiguousarray(centroids.T), mixtures, clear
        self._memo: dict[tuple[int, ...], tuple[tuple[int, float], ...]] = {}

    def vote(self, terms: tuple[int, ...]) -> tuple[tuple[int, float], ...]:
        """A sentence's vote: subject numbers and their parts of it, () for no subject."""
        got = self._memo.get(terms)
        if got is None:
            if len(self._memo) > 200_000:
                self._memo.clear()
            got = self._memo[terms] = self._decide(terms)
        return got

    def _decide(self, terms: tuple[int, ...]) -> tuple[tuple[int, float], ...]:
        if not terms:
            return ()
        t = list(terms)
        if self.lift[t].sum(axis=0).max() < self.clear:
            return ()
        mixed = self.mixtures[int(np.argmax(self.weight[t] @ self.centroids[t]))]
        return tuple((int(i), float(mixed[i])) for i in np.flatnonzero(mixed > 0))

    def shares(self, text: str, memo: dict[str, tuple[tuple[int, float], ...]]) -> tuple[Counter, int]:
        """Votes by subject number, and the number of sentences that voted."""
        votes: Counter = Counter()
        of = 0
        for s in wiki.sentences(text):
            v = memo.get(s)
            if v is None:
                if len(memo) > 100_000:
                    memo.clear()
                v = memo[s] = self.vote(_terms(s, self.vocabulary))
            of += bool(v)
            for i, part in v:
                votes[i] += part
        return votes, of

    def leaf_terms(self, n: int = 8) -> list[list[str]]:
        """The most discriminative terms of each leaf."""
        words = sorted(self.vocabulary, key=self.vocabulary.get)
        return [[words[i] for i in np.argsort(-c)[:n] if c[i] > 0] for c in self.centroids.T * self.weight]


class Rows:
    """Rows of few entries each: terms, their values, and where each row starts and ends."""

    def __init__(self, term: np.ndarray, value: np.ndarray, start: np.ndarray, terms: int) -> None:
        self.term, self.value, self.start, self.terms = term, value, start, terms

    @classmethod
    def of(cls, x: np.ndarray) -> Rows:
        row, term = np.nonzero(x)
        return cls(term, x[row, term], np.searchsorted(row, np.arange(len(x) + 1)), x.shape[1])

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, i: np.ndarray) -> Rows:
        size = (self.start[1:] - self.start[:-1])[i]
        start = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[i] - start[:-1], size) + np.arange(start[-1])
        return Rows(self.term[at], self.value[at], start, self.terms)

    def dot(self, c: np.ndarray) -> np.ndarray:
        """The product of each row with the vector c."""
        return np.bincount(np.repeat(np.arange(len(self)), np.diff(self.start)), self.value * c[self.term], len(self))

    def total(self, n: np.ndarray) -> np.ndarray:
        """The sum of the rows, n times each."""
        return np.bincount(self.term, self.value * np.repeat(n, np.diff(self.start)), self.terms)


def bisecting_kmeans(x: np.ndarray | Rows, n: np.ndarray, leaves: int, scatter: float, seed: int = 0) -> np.ndarray:
    """Leaf numbers of unit vectors x with multiplicities n: the leaf with the greatest weighted
    scatter is split in two by spherical 2-means, until `leaves` or no mean scatter above `scatter`."""
    rng = np.random.default_rng(seed)
    rows, n = x if isinstance(x, Rows) else Rows.of(x), n.astype(float)
    leaf = np.zeros(len(rows), np.int64)

    def spread_of(i: np.ndarray) -> float:
        return float(n[i].sum() - np.linalg.norm(rows.take(i).total(n[i])))

    cost = {0: spread_of(np.arange(len(rows)))}
    while len(cost) < leaves:
        at = max((k for k in cost if cost[k] > 0), key=cost.get, default=None)
        if at is None:
            break
        i = np.flatnonzero(leaf == at)
        if len(i) < 2 or cost[at] / n[i].sum() < scatter:
            cost[at] = 0.0
            continue
        own, times = rows.take(i), n[i]
        one = lambda k: own.take(np.array([k])).total(np.ones(1))  # noqa: E731,B023
        a = one(rng.choice(len(i), p=times / times.sum()))
        c = np.stack([a, one(int(np.argmin(own.dot(a))))])
        side = np.zeros(len(i), np.int64)
        for _ in range(12):
            new = (own.dot(c[1]) > own.dot(c[0])).astype(np.int64)
            if (new == side).all() and _:
                break
            side = new
            for j in (0, 1):
                m = own.total(times * (side == j))
                c[j] = m / max(np.linalg.norm(m), 1e-12)
        if side.min() == side.max():
            cost[at] = 0.0
            continue
        new_leaf = len(cost)
        leaf[i[side == 1]] = new_leaf
        cost[at], cost[new_leaf] = spread_of(i[side == 0]), spread_of(i[side == 1])
    return leaf


def fit(rows: list[tuple[str, int, list[str]]], subjects: list[str], leaves: int = 800, scatter: float = 0.05, least_pages: int = 3, smooth: float = 2.0, wrong: float = 0.02, clear: float = 1.8, rounds: int = 12) -> Model:
    """rows: (text, page_id, labels) of labelled documents. The leaves are made from all sets of
    discriminative terms in this sample."""
    number = {s: i for i, s in enumerate(subjects)}
    n_subjects = len(subjects)
    units: dict[tuple, None] = {}
    pages: dict[str, set] = defaultdict(set)
    for text, page, labels in rows:
        known = frozenset(number[s] for s in labels if s in number)
        for s in wiki.sentences(text):
            words = frozenset(w for w in wiki.WORD.findall(s.lower()) if not w.isdigit())
            if words and (page, words, known) not in units:
                units[page, words, known] = None
                for w in words:
                    pages[w].add(page)
    # invented names recur on a few pages by chance, the more so the more pages there are
    least = max(least_pages, len({page for page, _, _ in units}) // 800)
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, p in pages.items() if len(p) >= least))}
    merged = Counter((tuple(sorted(vocabulary[w] for w in words if w in vocabulary)), known) for _, words, known in units)
    merged = {k: n for k, n in merged.items() if k[0]}
    if not merged:
        return Model(subjects, {}, np.zeros((0, n_subjects)), np.zeros(0), np.zeros((1, 0)), np.zeros((1, n_subjects)), clear)
    times = np.array(list(merged.values()), float)
    own = np.repeat(np.arange(len(merged)), [len(t) for t, _ in merged])
    term = np.concatenate([np.array(t) for t, _ in merged])
    mask = np.full((len(merged), n_subjects), wrong)
    for i, (_, known) in enumerate(merged):
        mask[i, list(known)] = 1
    by_term = np.argsort(term, kind="stable")
    term_start = np.searchsorted(term[by_term], np.arange(len(vocabulary)))
    unit_start = np.searchsorted(own, np.arange(len(merged)))
    z = mask / mask.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        total = np.add.reduceat((z * times[:, None])[own[by_term]], term_start, axis=0)
        prior = (z * times[:, None]).sum(axis=0) / times.sum()
        p = (total + smooth * prior) / (total.sum(axis=1, keepdims=True) + smooth)
        lift = np.log(p / prior)
        weight = np.minimum(1.0, (p * lift).sum(axis=1)) ** 2
        lift = lift * weight[:, None]
        score = np.add.reduceat(lift[term], unit_start, axis=0) + np.log(prior) + np.log(mask)
        z = np.exp(score - score.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
    telling = weight > 0.1
    sets: Counter = Counter()
    for (t, _), n in merged.items():
        kept = tuple(i for i in t if telling[i])
        if kept:
            sets[kept] += n
    kept = np.flatnonzero(telling)
    column = np.cumsum(telling) - 1
    common = sorted(sets)
    size = np.array([len(t) for t in common], np.int64)
    term = np.array([i for t in common for i in t], np.int64)
    length = np.sqrt(np.bincount(np.repeat(np.arange(len(common)), size), weight[term] ** 2, len(common)))
    x = Rows(column[term], weight[term] / np.repeat(np.maximum(length, 1e-12), size), np.concatenate([[0], np.cumsum(size)]), len(kept))
    n = np.array([sets[t] for t in common], float)
    leaf = bisecting_kmeans(x, n, leaves, scatter)
    count = int(leaf.max()) + 1 if len(leaf) else 1
    centroids = np.stack([x.take(i).total(n[i]) for i in (np.flatnonzero(leaf == k) for k in range(count))]).astype(np.float32)
    centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    mixtures = centroids @ (p[kept] * weight[kept, None]).astype(np.float32)
    mixtures /= np.maximum(mixtures.sum(axis=1, keepdims=True), 1e-12)
    words = sorted(vocabulary, key=vocabulary.get)
    return Model(subjects, {words[j]: i for i, j in enumerate(kept)}, lift[kept].astype(np.float32), weight[kept].astype(np.float32), centroids, mixtures, clear)


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, most_bytes: int = MAX_BYTES) -> list[tuple[str, int, list[str]]]:
    """(text, page_id, labels) of labelled documents in the order of the hash of doc_id: at most `most`,
    and only as long as their texts together have at most `most_bytes`."""
    per_doc = labels.filter("doc_id IS NOT NULL AND subject IS NOT NULL").groupBy(F.col("doc_id").alias("_d")).agg(F.sort_array(F.collect_set("subject")).alias("_labels"))
    few = per_doc.orderBy(F.xxhash64("_d"), "_d").limit(most)
    got = documents.select("doc_id", "page_id", "text").filter("text IS NOT NULL").join(F.broadcast(few), F.col("doc_id") == F.col("_d"))
    # one task sorts the sample, `most` documents; what leaves it has a bound in bytes
    until = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    got = got.withColumn("_sum", F.sum(F.octet_length("text")).over(until)).filter(F.col("_sum") <= most_bytes).select("doc_id", "page_id", "text", "_labels").toPandas()
    got = got.drop_duplicates("doc_id").sort_values("doc_id")
    return [(text, page, list(known)) for text, page, known in zip(got["text"], got["page_id"], got["_labels"], strict=True)]


def votes(documents: DataFrame, labels: DataFrame, subjects: list[str], **how) -> DataFrame:
    """documents(doc_id, page_id, namespace, text) -> doc_id, subject, votes (parts of a sentence's vote count),
    of (votes in all)."""
    model = fit(labelled_sample(documents, labels), subjects, **how)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple[tuple[int, float], ...]] = {}
        for pdf in batches:
            ids, names, counts, totals = [], [], [], []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if wiki.is_redirect(text):
                    continue
                v, total = model.shares(text, memo)
                for s, k in v.items():
                    ids.append(doc)
                    names.append(model.subjects[s])
                    counts.append(k)
                    totals.append(total)
            yield pd.DataFrame({"doc_id": np.array(ids, np.int64), "subject": pd.Series(names, dtype=object), "votes": np.array(counts, float), "of": np.array(totals, np.int32)})

    prose = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL AND coalesce(namespace, 0) = 0").select(F.col("doc_id").cast("bigint"), "text")
    return spread(prose).mapInPandas(run, "doc_id bigint, subject string, votes double, of int")


def _names(subjects: DataFrame) -> list[str]:
    return [r[0] for r in subjects.select("subject").filter("subject IS NOT NULL").distinct().orderBy("subject").collect()]


def found(documents: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = SHARE) -> DataFrame:
    """p9_found: distinct (doc_id, subject)."""
    v = votes(documents, labels, _names(subjects))
    return v.filter(F.col("votes") >= share * F.col("of")).select("doc_id", "subject").distinct()


def composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = SHARE) -> DataFrame:
    """Make-up of the corpus: documents with each subject, and the sum of their shares of sentences."""
    v = votes(documents, labels, _names(subjects)).filter(F.col("votes") >= share * F.col("of")).distinct()
    return v.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("votes") / F.col("of")).alias("weight"))
