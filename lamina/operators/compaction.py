"""Compaction: which versions survive, where outputs are cut, which level and file come next."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.changelog import DELETE

L0_TRIGGER, LEVELS, L1_BYTES = 4, 7, 10 * 1024 * 1024
#: Keys to a bucket in lookups of ranges.
BUCKET = 64


def survivors(log: DataFrame, smallest_snapshot: int, deeper: DataFrame | None = None) -> DataFrame:
    """Versions that a compaction keeps.

    A version goes if a newer one of its key is visible to every snapshot; a tombstone also if it is itself visible to
    all and no file of a deeper level (``deeper``: ranges ``lo, hi`` of integers) can hold the key. Without ``deeper`` all keys
    are at their base level. Ranges are merged to disjoint ones and spread over buckets, so a tombstone meets only its bucket's.
    """
    newer = F.lag("seq").over(Window.partitionBy("k").orderBy(F.col("seq").desc()))
    kept = log.withColumn("newer", newer).filter(F.coalesce(F.col("newer") > smallest_snapshot, F.lit(True))).drop("newer")
    old_delete = (F.col("op") == DELETE) & (F.col("seq") <= smallest_snapshot)
    if deeper is None:
        return kept.filter(~old_delete)
    ranges = disjoint(deeper).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / BUCKET), F.floor(F.col("hi") / BUCKET))))
    covered = (F.floor(F.col("k") / BUCKET) == F.col("bucket")) & (F.col("k") >= F.col("lo")) & (F.col("k") <= F.col("hi"))
    tombstones = kept.filter(old_delete).join(ranges, covered, "left_semi")
    return kept.filter(~old_delete).unionByName(tombstones)


def disjoint(ranges: DataFrame) -> DataFrame:
    """Overlapping ranges ``lo, hi`` merged. The window orders file metadata in one task."""
    upto = F.max("hi").over(Window.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("upto").isNull() | (F.col("lo") > F.col("upto")), 1).otherwise(0)).over(Window.orderBy("lo", "hi"))
    return ranges.select("lo", "hi").withColumn("upto", upto).withColumn("island", island).groupBy("island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lo", "hi")


def level_scores(files: DataFrame) -> DataFrame:
    """``level, n_files, level_bytes, score``: files against the trigger at level 0, bytes against the budget below; the last level has none."""
    budget = L1_BYTES * F.pow(F.lit(10.0), F.col("level") - 1)
    per = files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("file_size").alias("level_bytes"))
    score = F.when(F.col("level") == 0, F.col("n_files") / L0_TRIGGER).when(F.col("level") < LEVELS - 1, F.col("level_bytes") / budget)
    return per.withColumn("score", score)


def pick_level(scores: DataFrame) -> DataFrame:
    """The level of the highest score; of equal ones the lower level."""
    return scores.filter(F.col("score").isNotNull()).orderBy(F.col("score").desc(), F.col("level")).limit(1)


def cut_greedily(df: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """Adds ``part``: within each group, in order, a new part begins once the last one's sizes reached ``limit``.

    The fold is sequential by nature; it runs per group (a key range of the compaction), so groups run in parallel, and
    streams within a group in bounded memory.
    """
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", part bigint"
    columns = [c for c, _ in df.dtypes]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, part, held = None, 0, 0
        for batch in batches:
            parts = []
            for g, s in zip(batch[group], batch[size], strict=True):
                if g != last:
                    last, part, held = g, 0, 0
                elif held >= limit:
                    part, held = part + 1, 0
                held += s
                parts.append(part)
            yield batch[columns].assign(part=parts)

    return df.repartition(group).sortWithinPartitions(group, order).mapInPandas(fold, schema)


def group_commit(batches: DataFrame, queue: str, order: str, size: str, sync: str) -> DataFrame:
    """Adds ``commit_group``: a leader takes the batches behind it up to 1 MiB, or its own size and 128 KiB if it is small;
    a synchronous batch never joins a leader that isn't."""
    schema = ", ".join(f"{c} {t}" for c, t in batches.dtypes) + ", commit_group bigint"
    columns = [c for c, _ in batches.dtypes]

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, group, held, most, leader_sync = None, 0, 0, 0, False
        for batch in parts:
            groups = []
            for q, s, y in zip(batch[queue], batch[size], batch[sync], strict=True):
                joins = q == last and not (y and not leader_sync) and held + s <= most
                if q != last:
                    group = 0
                elif not joins:
                    group += 1
                if joins:
                    held += s
                else:
                    last, held, leader_sync = q, s, y
                    most = s + (128 << 10) if s <= (128 << 10) else 1 << 20
                groups.append(group)
            yield batch[columns].assign(commit_group=groups)

    return batches.repartition(queue).sortWithinPartitions(queue, order).mapInPandas(fold, schema)


def cut_at_overlap(rows: DataFrame, grandparents: DataFrame, limit: int) -> DataFrame:
    """Adds ``part``: an output ends before a key once the grandparent files passed since the last cut have more than ``limit`` bytes.

    Every row finds by bucket how many grandparents (``hi, file_size``, in order of ``hi``) lie wholly before its key. Only these numbers,
    at most one per grandparent and group ``grp``, go through the sequential fold.
    """
    order = Window.orderBy("hi")  # file metadata
    placed = grandparents.select("hi", "file_size").withColumn("passed", F.row_number().over(order)).withColumn("before", F.lag("hi").over(order))
    placed = placed.withColumn("sum", F.sum("file_size").over(order))
    lows = rows.agg(F.min("k").alias("low"), F.max("k").alias("high"))
    last = placed.agg(F.max("hi").alias("before"), F.max("passed").alias("passed"), F.max("sum").alias("sum"))
    zones = placed.select("before", F.col("hi").alias("upto"), (F.col("passed") - 1).alias("passed"), (F.col("sum") - F.col("file_size")).alias("sum"))
    zones = zones.unionByName(last.select("before", F.lit(None).cast("bigint").alias("upto"), "passed", "sum")).crossJoin(F.broadcast(lows))  # one row
    zones = zones.select(F.coalesce("before", F.col("low") - 1).alias("before"), F.coalesce("upto", "high").alias("upto"), "passed", "sum").filter("before < upto")
    zones = zones.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("before") + 1) / BUCKET), F.floor(F.col("upto") / BUCKET))))
    at = (F.floor(F.col("k") / BUCKET) == F.col("bucket")) & (F.col("k") > F.col("before")) & (F.col("k") <= F.col("upto"))
    found = rows.join(zones, at).select(*rows.columns, "passed", "sum")
    steps = found.select("grp", "passed", "sum").distinct()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seen, held, part = None, 0, 0, 0
        for batch in batches:
            parts = []
            for g, upto in zip(batch["grp"], batch["sum"], strict=True):
                if g != last:
                    last, seen, held, part = g, upto, 0, 0
                held, seen = held + upto - seen, upto
                if held > limit:
                    held, part = 0, part + 1
                parts.append(part)
            yield batch[["grp", "passed"]].assign(part=parts)

    kinds = dict(steps.dtypes)
    cuts = steps.repartition("grp").sortWithinPartitions("grp", "passed").mapInPandas(fold, f"grp {kinds['grp']}, passed {kinds['passed']}, part bigint")
    return found.join(cuts, ["grp", "passed"]).select(*rows.columns, "part")


def allowed_seeks(file_size: Column) -> Column:
    return F.greatest(F.lit(100), F.floor(file_size / 16384)).cast("long")
