"""Event streams: windows, ingestion in micro-batches, sessions, counters with a trigger.

Sources and sinks are any Structured Streaming ones; `available_now` drains what is there, which is
how a batch run or a test uses them. State is bounded by watermarks or by one row per key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingestion


def files(spark: SparkSession, path: str, schema: str, per_batch: int = 100) -> DataFrame:
    """A stream of Parquet files; per_batch is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their mean value per kind and window; what is later than `late` is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "events", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user that end after `gap` of silence."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "events")


def available_now(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs `each` on every micro-batch until nothing is left."""
    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(stream: DataFrame, episodes: str, checkpoint: str, threshold: float = 0.35) -> StreamingQuery:
    """The write path: each micro-batch of turns(id, role, content, session_id, ts) is judged, and
    what is worth keeping is appended to the Parquet folder `episodes`. A batch that is run again
    overwrites its own part, so nothing is stored twice."""

    def each(batch: DataFrame, number: int) -> None:
        keep = ingestion.judged(batch, threshold).filter("store").select("id", "score", "reasons")
        batch.join(keep, "id").dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{episodes}/batch={number}")

    return available_now(stream, each, checkpoint)


def every(stream: DataFrame, n: int, act: Callable[[int], None], checkpoint: str) -> StreamingQuery:
    """Calls act(total) each time the number of rows passes a multiple of n. Only a count per
    micro-batch reaches the driver; it is written beside the checkpoint, one row a batch, so a
    stream that is started again goes on from there and a batch run again counts once."""
    spark = stream.sparkSession
    counts = f"{checkpoint}/counts"

    def each(batch: DataFrame, number: int) -> None:
        own = batch.count()
        spark.createDataFrame([(number, own)], "number bigint, rows bigint").coalesce(1).write.mode("overwrite").parquet(f"{counts}/part={number}")
        before = spark.read.schema("number bigint, rows bigint, part bigint").parquet(counts).filter(F.col("number") < number).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        if before // n != (before + own) // n:
            act(before + own)

    return available_now(stream, each, checkpoint)


@dataclass(order=True)
class Turn:
    """A queued turn; the most important goes first, then the oldest."""

    order: tuple[float, int] = field(init=False)
    importance: float = field(compare=False)
    number: int = field(compare=False)
    role: str = field(compare=False, default="user")
    text: str = field(compare=False, default="")
    ts: float = field(compare=False, default=0.0)
    merged: bool = field(compare=False, default=False)

    def __post_init__(self) -> None:
        self.order = (-self.importance, self.number)


class Bus:
    """A bounded queue for one process: when it is full, a turn of less than `least` importance is
    dropped; any other is merged into the head of the queue (texts joined, the greater importance,
    the later time and role). A cluster bounds its input at the source instead (see files)."""

    def __init__(self, most: int = 100, least: float = 0.4) -> None:
        self.most, self.least = most, least
        self.queue: list[Turn] = []
        self.dropped = self.merged = 0

    def put(self, t: Turn) -> bool:
        import heapq

        if len(self.queue) < self.most:
            heapq.heappush(self.queue, t)
            return True
        if t.importance < self.least:
            self.dropped += 1
            return False
        head = heapq.heappop(self.queue)
        late = t if t.ts >= head.ts else head
        both = replace(head, importance=max(head.importance, t.importance), role=late.role, text=f"{head.text}\n{t.text}", ts=late.ts, merged=True)
        heapq.heappush(self.queue, both)
        self.merged += 1
        return True

    def get(self) -> Turn | None:
        import heapq

        return heapq.heappop(self.queue) if self.queue else None
