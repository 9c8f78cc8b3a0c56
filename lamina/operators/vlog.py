"""Large values kept apart from their keys: pointers, a value table, and the states of its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 1024
STATES = ["normal", "pending_lsm", "being_gc", "pending_gc", "init"]
EVENTS = ["flush_completed", "compaction_completed", "gc_completed", "gc_begin", "gc_output", "output", "restart"]
#: Every legal (state, event) and the state that follows; what is missing is an error.
TRANSITIONS = {
    ("pending_lsm", "flush_completed"): "normal", ("pending_gc", "flush_completed"): "pending_gc", ("normal", "flush_completed"): "normal", ("being_gc", "flush_completed"): "being_gc",
    ("pending_gc", "gc_completed"): "normal", ("being_gc", "gc_completed"): "normal", ("pending_lsm", "compaction_completed"): "normal", ("normal", "gc_begin"): "being_gc",
    ("init", "gc_output"): "pending_gc", ("init", "output"): "pending_lsm", ("init", "restart"): "normal",
}


def _large(v: str) -> Column:
    return F.octet_length(v) >= THRESHOLD


def value_log(df: DataFrame, file: Column) -> DataFrame:
    """The large values: ``k, file_number, offset, size, value``; offsets run within each file in key order."""
    big = df.filter(_large("v")).select("k", file.alias("file_number"), F.octet_length("v").cast("long").alias("size"), F.col("v").alias("value"))
    before = Window.partitionBy("file_number").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return big.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))


def separate(df: DataFrame, file: Column) -> DataFrame:
    """``k, v`` with large values replaced by a pointer; one pass, the pointer is key, file and size."""
    large = _large("v")
    return df.select(
        "k", large.alias("separated"), F.when(~large, F.col("v")).alias("v"), F.when(large, file).alias("file_number"), F.when(large, F.octet_length("v")).cast("long").alias("size")
    )


def dereference(separated: DataFrame, values: DataFrame) -> DataFrame:
    """Pointers back to values: an equality join on file and key, only for separated rows."""
    near = separated.filter("not separated").select("k", "v")
    far = separated.filter("separated").select("k", "file_number").join(values, ["k", "file_number"]).select("k", F.col("value").alias("v"))
    return near.unionByName(far)


def discardable(values: DataFrame, dead: Column) -> DataFrame:
    """Share of each value file that no key points to any more."""
    return values.groupBy("file_number").agg((F.sum(F.when(dead, F.col("size")).otherwise(0)) / F.sum("size")).alias("discardable"))


def next_state(state: Column, event: Column) -> Column:
    """The state after an event; null where the event is illegal."""
    pairs = F.create_map(*(F.lit(x) for (s, e), t in TRANSITIONS.items() for x in (f"{s}/{e}", t)))
    return F.element_at(pairs, F.concat_ws("/", state, event))
