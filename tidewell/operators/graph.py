"""Graphs as edge tables. Hops are joins; every frontier is made distinct before the next hop, so
no walk is followed twice. An edge with a null end is left out; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from . import skew


def both_ways(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """src, dst in both directions, each once."""
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return e.select(F.col(a).alias("src"), F.col(b).alias("dst")).unionByName(e.select(F.col(b).alias("src"), F.col(a).alias("dst"))).distinct()


def reachable(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """seeds(seed) x edges(src, dst) -> seed, node, hop (the least): nodes other than the seed within `hops`."""
    front = seeds.select("seed", F.col("seed").alias("node")).distinct()
    seen = front.withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        step = front.join(edges, front.node == edges.src).select("seed", F.col("dst").alias("node")).distinct()
        # each hop is written once, so that no plan holds the hops before it
        front = cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti"), "hop")
        seen = seen.unionByName(front.withColumn("hop", F.lit(h)))
    return seen.filter("hop > 0")


def shortest(edges: DataFrame, start: str, goal: str, longest: int = 5) -> DataFrame:
    """The first shortest path by node names as one row: path, length; no row if there is none within
    `longest`. Per node only its least path of each length goes on."""
    edges = cut(edges, "edges")
    front = edges.sparkSession.createDataFrame([(start, [start])], "node string, path array<string>")
    seen = front.select("node")
    out = None
    for h in range(1, longest + 1):
        nxt = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        nxt = nxt.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti")
        nxt = cut(nxt, "front")
        hit = nxt.filter(F.col("node") == goal).select(F.array_join("path", ">").alias("path"), F.lit(h).alias("length"))
        out = hit if out is None else out.unionByName(hit)
        if not nxt.filter(F.col("node") != goal).limit(1).count() or hit.limit(1).count():
            break
        seen, front = seen.unionByName(nxt.select("node")), nxt
    return out


def sequences(events: DataFrame, key: str, kind: str, ts: str) -> DataFrame:
    """src, dst, freq, delay (mean seconds): successive events of a key."""
    t = skew.previous(skew.with_blocks(events, [key], ts), [key], [ts, "event_id"], [kind, ts])
    return t.filter("_prev IS NOT NULL").groupBy(F.col(f"_prev.{kind}").alias("src"), F.col(kind).alias("dst")).agg(F.count(F.lit(1)).alias("freq"), F.avg(F.col(ts) - F.col(f"_prev.{ts}")).alias("delay"))


def next_kinds(seq: DataFrame, n: int) -> DataFrame:
    """The n likeliest successors of each kind."""
    w = Window.partitionBy("src").orderBy(F.desc("freq"), "dst")
    return seq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def near_in_time(rows: DataFrame, key: str, ts: str, within: float) -> DataFrame:
    """a < b: rows of one key less than `within` apart. Rows meet in buckets of that width and the
    neighbouring one, so a hot key is spread over time and no pair is made that is too far apart."""
    b = F.floor(F.col(ts) / within).cast("bigint")
    left = rows.select(F.col(key).alias("_k"), F.col("id").alias("a"), F.col(ts).alias("ta"), b.alias("_b"))
    right = rows.select(F.col(key).alias("_k"), F.col("id").alias("b"), F.col(ts).alias("tb"), F.explode(F.array(b - 1, b, b + 1)).alias("_b"))
    return left.join(right, ["_k", "_b"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) < within)).select(F.col("_k").alias(key), "a", "b")


def counts(nodes: dict[str, DataFrame]) -> DataFrame:
    """Rows per named table."""
    out = None
    for name, df in nodes.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def without(nodes: DataFrame, edges: DataFrame, key: str, n: int) -> DataFrame:
    """The first n nodes that no edge reaches: an anti-join."""
    return nodes.join(edges.select(key).distinct(), key, "left_anti").orderBy(key).limit(n)


def through(edges: DataFrame, nodes: DataFrame, by: str, key: str, order: str, n: int) -> DataFrame:
    """For each `by` the n latest nodes one hop away: edges(by, key), nodes(key, order)."""
    x = edges.select(by, key).filter(F.col(by).isNotNull()).distinct().join(nodes, key)
    w = Window.partitionBy(by).orderBy(F.desc(order), key)
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def similar_pairs(edges: DataFrame, least: float, a: str = "a", b: str = "b", score: str = "similarity") -> DataFrame:
    """a < b of an edge table with at least the given similarity, each pair once with its best score."""
    e = edges.filter((F.col(score) >= least) & (F.col(a) != F.col(b)))
    return e.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max(score).alias(score))


def by_first_word(messages: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """query_id, message, frequency, rank: the most frequent messages that contain the first word of a
    query. queries is a stated set, set against the distinct messages."""
    first = F.element_at(F.split(F.trim("query"), r"\s+"), 1)
    q = F.broadcast(queries.filter(F.trim("query") != "").select("query_id", first.alias("_w")))
    m = messages.filter("message IS NOT NULL").groupBy("message").agg(F.count(F.lit(1)).alias("frequency"))
    w = Window.partitionBy("query_id").orderBy(F.desc("frequency"), "message")
    return m.join(q, F.contains("message", F.col("_w"))).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("query_id", "message", "frequency", "rank")


def upsert_nodes(nodes: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Nodes after a write: new rows replace old ones of the same key, the later by ts."""
    cols = [c for c in nodes.columns if c != key]
    u = nodes.unionByName(new.select(*nodes.columns))
    return u.groupBy(key).agg(F.max(F.struct("ts", *[c for c in cols if c != "ts"])).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in cols])


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges(src, dst, kind, weight) after a write: one row per src, dst and kind with the greatest weight."""
    return edges.select("src", "dst", "kind", "weight").unionByName(new.select("src", "dst", "kind", "weight")).groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight"))
