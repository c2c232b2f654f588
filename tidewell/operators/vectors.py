"""Vector search.

Exact search sets blocks of queries against chunks of rows on a grid, so that no task holds more
than one block and one chunk; each cell keeps its best k, and a window merges the cells. The index
(inverted lists around centroids fitted on a bounded sample) reads only the lists near a query.
Vectors of another length than the first row's, null vectors and null ids are left out; a zero
vector has similarity 0; ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a chunk and of a block of queries.
CHUNK, BLOCK = 20_000, 2_000
#: Rows that centroids are fitted on, at most.
SAMPLE = 20_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, computed in double."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 1e-10, dot(a, b) / norm).otherwise(F.lit(0.0))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def nearest(rows: DataFrame, queries: DataFrame, k: int, least: float = -1.0, older_only: bool = False, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """rows(id, vector) x queries(id, vector) -> query_id, id, similarity (9 decimals), rank: the k
    nearest other rows of each query with at least `least`; older_only: only rows of a smaller id."""
    rows, queries = rows.filter("id IS NOT NULL AND vector IS NOT NULL"), queries.filter("id IS NOT NULL AND vector IS NOT NULL")
    chunks, blocks = max(1, -(-rows.count() // chunk)), max(1, -(-queries.count() // block))
    side = lambda df, n, own, other, m: df.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
    left, right = side(rows, chunks, "c", "b", blocks), side(queries, blocks, "b", "c", chunks)

    def cell(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "id": [], "similarity": []}
        if len(r) and len(q):
            r = r.sort_values("id")
            ids = r["id"].to_numpy()
            s = np.round(_unit(q["vector"]) @ _unit(r["vector"]).T, 9)
            for i, one in enumerate(q["id"].to_numpy()):
                ok = np.flatnonzero((ids != one) & (s[i] >= least) & ((ids < one) if older_only else True))
                best = ok[np.lexsort((ids[ok], -s[i][ok]))[:k]]
                out["query_id"] += [one] * len(best)
                out["id"] += ids[best].tolist()
                out["similarity"] += s[i][best].tolist()
        return pd.DataFrame({"query_id": np.array(out["query_id"], np.int64), "id": np.array(out["id"], np.int64), "similarity": np.array(out["similarity"], np.float64)})

    cells = left.groupBy("c", "b").cogroup(right.groupBy("c", "b")).applyInPandas(cell, "query_id bigint, id bigint, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return cells.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def superseded(rows: DataFrame, least: float = 0.92, k: int = 5) -> DataFrame:
    """The ids that a newer row (larger id) has among its k nearest older rows with at least `least`."""
    return nearest(rows, rows, k, least, older_only=True).select("id").distinct()


def centroids(rows: DataFrame, lists: int, seed: int = 1) -> np.ndarray:
    """Spherical k-means on at most SAMPLE rows, those with the smallest hash of their id."""
    x = _unit(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()["vector"])
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(8):
        a = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (a == j).any():
                m = x[a == j].sum(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def nearest_indexed(rows: DataFrame, queries: DataFrame, k: int, lists: int = 16, probes: int = 12) -> DataFrame:
    """As nearest, reading only the `probes` lists nearest to each query. Every row is indexed."""
    c = centroids(rows, lists)

    def place(n: int, name: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                near = np.argsort(-(_unit(pdf["vector"]) @ c.T), axis=1)[:, :n] if len(pdf) else np.zeros((0, n), int)
                yield pd.DataFrame({name: np.repeat(pdf["id"].to_numpy(), near.shape[1]), "vector": pdf["vector"].loc[pdf.index.repeat(near.shape[1])].to_list(), "list": near.reshape(-1).astype(np.int32)})

        return run

    q = queries.mapInPandas(place(min(probes, len(c)), "query_id"), "query_id bigint, vector array<float>, list int").withColumnRenamed("vector", "qv")
    r = rows.mapInPandas(place(1, "id"), "id bigint, vector array<float>, list int")
    x = r.join(q, "list").filter("id <> query_id").select("query_id", "id", F.round(cosine(F.col("qv"), F.col("vector")), 9).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def projected(rows: DataFrame, width: int, seed: int = 42) -> DataFrame:
    """Each vector through one fixed Gaussian matrix, over the root of the new width."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = None
        for pdf in batches:
            if len(pdf):
                x = np.array([np.asarray(v, np.float64) for v in pdf["vector"]])
                m = np.random.RandomState(seed).randn(x.shape[1], width) / np.sqrt(width) if m is None else m
                yield pd.DataFrame({"id": pdf["id"], "vector": list((x @ m).astype(np.float32))})

    return rows.filter("vector IS NOT NULL").mapInPandas(run, "id bigint, vector array<float>")
