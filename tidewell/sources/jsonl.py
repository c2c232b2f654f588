"""JSON lines and small states in the shared folder.

Telemetry events are one JSON object a line (kind, message, ts, payload as text). A line that does
not parse becomes an event of the kind `parse_error` with the line as its message: nothing is lost.
Small states (a calibration, a net) are one-row JSON files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "kind string, message string, ts double, payload string"


def emit(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append events(kind, message, ts, payload) as JSON lines."""
    events.select(F.to_json(F.struct("kind", "message", "ts", "payload")).alias("value")).write.mode(mode).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """kind, message, ts, payload of every line; blank lines are none."""
    x = spark.read.text(path).filter(F.trim("value") != "").withColumn("e", F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}))
    bad = F.col("e").isNull() | F.col("e.kind").isNull()
    return x.select(F.when(bad, "parse_error").otherwise(F.col("e.kind")).alias("kind"), F.when(bad, F.col("value")).otherwise(F.col("e.message")).alias("message"), F.when(~bad, F.col("e.ts")).alias("ts"), F.when(~bad, F.col("e.payload")).alias("payload"))


def save_state(state: DataFrame, path: str) -> None:
    """One row as a JSON file."""
    state.limit(1).coalesce(1).write.mode("overwrite").json(path)


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
