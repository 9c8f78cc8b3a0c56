"""The changelog: one row per version, ``k, seq, op (0 delete, 1 put, 2 pointer), v``; and batches applied to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE, PUT, POINTER = 0, 1, 2


def changelog(df: DataFrame, k: Column, seq: Column, op: Column, v: Column) -> DataFrame:
    return df.select(k.alias("k"), seq.cast("long").alias("seq"), op.cast("tinyint").alias("op"), v.alias("v"))


def from_events(events: DataFrame) -> DataFrame:
    """Users as keys, events as versions; an error event deletes."""
    op = F.when(F.col("event_type") == "error", DELETE).otherwise(PUT)
    return changelog(events, F.col("user_id"), F.col("event_id"), op, F.col("value"))


def explode_batches(batches: DataFrame, base: Column) -> DataFrame:
    """Batches ``ops array<struct<op,k,v>>`` to versions: the op at position i has the sequence number ``base`` + i."""
    return batches.select(base.cast("long").alias("base"), F.posexplode("ops").alias("pos", "o")).select(
        F.col("o.k").alias("k"), (F.col("base") + F.col("pos")).alias("seq"), F.col("o.op").cast("tinyint").alias("op"), F.col("o.v").alias("v")
    )


def apply_batch(log: DataFrame, ops: list[tuple[int, int, float | None]], first_seq: int) -> DataFrame:
    """The changelog with a batch of ``(op, k, v)`` appended, all at once."""
    kinds = dict(log.dtypes)
    spark = log.sparkSession
    batch = spark.createDataFrame([(ops,)], f"ops array<struct<op:int,k:{kinds['k']},v:{kinds['v']}>>")
    return log.unionByName(explode_batches(batch, F.lit(first_seq)))
