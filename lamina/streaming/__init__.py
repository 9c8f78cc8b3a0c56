"""Streams of changes (an extension of ours): every micro-batch is a write batch appended to a changelog table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamina.operators.mvcc import as_of


def append_changes(changes: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of ``k, seq, op, v`` to the log, each micro-batch in a folder of its number, so that a retried one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The live view of an appended log."""
    return as_of(log.select("k", "seq", F.col("op").cast("tinyint").alias("op"), "v"), snapshot)
