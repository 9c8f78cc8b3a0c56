"""Reads of a changelog under snapshots. One hash aggregation by key; the tombstone test comes after the newest version is chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.changelog import DELETE

def as_of(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``k, seq, v`` of the newest version of each key that the snapshot sees, without deleted keys."""
    seen = log if snapshot is None else log.filter(F.col("seq") <= snapshot)
    newest = seen.groupBy("k").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "v"), "seq").alias("n"))
    return newest.filter(F.col("n.op") != DELETE).select("k", "seq", F.col("n.v").alias("v"))


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    """One row, or none if the key isn't there; the key predicate reaches the scan."""
    return as_of(log.filter(F.col("k") == key), snapshot)


def multi_get(log: DataFrame, keys: list, snapshot: int | None = None) -> DataFrame:
    """A row per asked key: ``k, found, v``."""
    kind = dict(log.dtypes)["k"]
    asked = log.sparkSession.createDataFrame([(k,) for k in keys], f"k {kind}").distinct()
    hit = as_of(log.filter(F.col("k").isin(keys)), snapshot)
    return asked.join(hit, "k", "left").select("k", F.col("seq").isNotNull().alias("found"), "v")


def range_scan(log: DataFrame, low, high, snapshot: int | None = None, descending: bool = False) -> DataFrame:
    """Live keys from ``low`` to ``high``, both included, in order."""
    order = F.col("k").desc() if descending else F.col("k").asc()
    return as_of(log.filter(F.col("k").between(low, high)), snapshot).orderBy(order)


def seek(log: DataFrame, target: Column | int, snapshot: int | None = None) -> DataFrame:
    """The first live key at or behind ``target``."""
    return as_of(log.filter(F.col("k") >= target), snapshot).orderBy("k").limit(1)


def seek_last(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    return as_of(log, snapshot).orderBy(F.col("k").desc()).limit(1)


def version_chain(log: DataFrame) -> DataFrame:
    """Every version with the sequence number of the next newer one of its key."""
    return log.select("k", "seq", F.lag("seq").over(Window.partitionBy("k").orderBy(F.col("seq").desc())).alias("newer_seq"))


def intervals(log: DataFrame) -> DataFrame:
    """Every version with the half-open interval of snapshots that see it."""
    return log.select("k", F.col("seq").alias("begin_seq"), F.lead("seq").over(Window.partitionBy("k").orderBy("seq")).alias("end_seq"), F.col("op").cast("int").alias("op"))


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """Sorted runs as one stream in key order, newest first; equal versions come from the first run that has them first."""
    tagged = [r.select("k", "seq", "op", "v", F.lit(i).alias("run")) for i, r in enumerate(runs)]
    out = tagged[0]
    for r in tagged[1:]:
        out = out.unionByName(r)
    return out.orderBy(F.col("k"), F.col("seq").desc(), F.col("op").desc(), F.col("run"))
