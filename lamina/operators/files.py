"""Queries over file metadata: ``level, number, file_size, lo, hi``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_OUTPUT_LEVEL, GRANDPARENT_LIMIT = 2, 25


def overlap_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], width: int, how: str = "inner") -> DataFrame:
    """Join of intervals ``a`` of ``left`` with intervals ``b`` of ``right`` (integer ends, included) that overlap.

    Intervals are spread over buckets of ``width`` numbers and meet by equality of the bucket, each pair once, in the bucket where
    the later one begins. No nested loop; ``how`` may be inner, left, left_semi or left_anti.
    """
    spread = lambda df, x, name: df.withColumn(name, F.explode(F.sequence(F.floor(F.col(x[0]) / width), F.floor(F.col(x[1]) / width))))
    keyed = left.withColumn("_row", F.struct(*left.columns))
    meet = (F.col("_a") == F.col("_b")) & (F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1]))
    meet = meet & (F.col("_a") == F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / width))
    pairs = spread(keyed, a, "_a").join(spread(right, b, "_b"), meet).drop("_a", "_b")
    if how == "inner":
        return pairs.drop("_row")
    if how == "left":
        return left.join(pairs.select("_row", *right.columns), F.struct(*(left[c] for c in left.columns)) == F.col("_row"), "left").drop("_row")
    return left.join(pairs.select("_row").distinct(), F.struct(*(left[c] for c in left.columns)) == F.col("_row"), how)


def overlapping_pairs(left: DataFrame, right: DataFrame, by: Column | None = None, width: int = 64) -> DataFrame:
    """Pairs of files whose key ranges overlap: ``left`` columns with prefix a, ``right`` with b."""
    a = left.select(F.col("number").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    b = right.select(F.col("number").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    met = overlap_join(a, b, ("a_lo", "a_hi"), ("b_lo", "b_hi"), width)
    return met if by is None else met.filter(by)


def closure(files: DataFrame, lo: int, hi: int) -> DataFrame:
    """Files of level 0 that a range draws in: those that overlap it, those that overlap them, and so on. Overlapping files form
    islands whose hulls are disjoint, so the fixpoint is all islands whose hull meets the range."""
    named = overlap_islands(files).join(files, "number")
    hull = named.groupBy("island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter((F.col("lo") <= hi) & (F.col("hi") >= lo))
    return named.join(hull.select("island"), "island", "left_semi").select("number")


def expand_inputs(upper: DataFrame, lower: DataFrame, limit: int, width: int = 64) -> DataFrame:
    """For every file of a level picked as input: ``number, lower_files, upper_files, expanded``.

    The inputs below are the files of the next level that overlap it. The files of its own level that overlap the hull of both are
    taken too if that adds bytes, stays under ``limit`` and draws in no further file below.
    """
    seed = upper.select(F.col("number").alias("seed"), F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"), F.col("file_size").alias("s_size"))
    below = lower.select("number", F.col("lo").alias("n_lo"), F.col("hi").alias("n_hi"), "file_size")
    own = upper.select("number", F.col("lo").alias("n_lo"), F.col("hi").alias("n_hi"), "file_size")
    sums = lambda df, keys, p: df.groupBy(*keys).agg(F.count("number").alias(f"{p}_n"), F.coalesce(F.sum("file_size"), F.lit(0)).alias(f"{p}_size"), F.min("n_lo").alias(f"{p}_lo"), F.max("n_hi").alias(f"{p}_hi"))
    keys = ["seed", "s_lo", "s_hi", "s_size"]
    one = sums(overlap_join(seed, below, ("s_lo", "s_hi"), ("n_lo", "n_hi"), width, "left"), keys, "b")
    hull = one.withColumn("a_lo", F.least("s_lo", "b_lo")).withColumn("a_hi", F.greatest("s_hi", "b_hi"))
    two = sums(overlap_join(hull, own, ("a_lo", "a_hi"), ("n_lo", "n_hi"), width, "left"), hull.columns, "u")
    three = sums(overlap_join(two, below, ("u_lo", "u_hi"), ("n_lo", "n_hi"), width, "left"), two.columns, "e")
    grows = (F.col("b_n") > 0) & (F.col("u_size") > F.col("s_size")) & (F.col("u_size") + F.col("b_size") < limit) & (F.col("e_n") == F.col("b_n"))
    return three.select(F.col("seed").alias("number"), F.col("b_n").alias("lower_files"), F.when(grows, F.col("u_n")).otherwise(1).alias("upper_files"), grows.alias("expanded"))


def charge_seeks(files: DataFrame, probes: DataFrame, width: int = 64) -> DataFrame:
    """``number, left``: seeks left to each file after the ``probes`` (``k``): a probe that goes on to a second file charges the first one it touches."""
    met = overlap_join(probes.withColumn("k2", F.col("k")), files.select("level", "number", "lo", "hi"), ("k", "k2"), ("lo", "hi"), width)
    charged = met.groupBy("k").agg(F.count("*").alias("touched"), F.min(F.struct("level", "number"))["number"].alias("number")).filter("touched > 1")
    seeks = charged.groupBy("number").agg(F.count("*").alias("used"))
    return files.join(seeks, "number", "left").select("number", (F.greatest(F.lit(100), F.floor(F.col("file_size") / 16384)).cast("long") - F.coalesce("used", F.lit(0))).alias("left"))


def find_file(keys: DataFrame, files: DataFrame, width: int) -> DataFrame:
    """For each key the first file whose largest key is not below it (null behind the last).

    A file answers the keys after the largest one of its predecessor up to its own. These intervals are spread over
    buckets of ``width`` keys, so the lookup is an equality join on the bucket; only the file metadata is ordered in one
    task. The first file's interval reaches down to the smallest key asked for.
    """
    order = Window.orderBy("hi", "number")
    lowest = keys.agg(F.min("k").alias("lowest"))
    spans = files.withColumn("before", F.lag("hi").over(order)).crossJoin(F.broadcast(lowest))  # one row
    spans = spans.select("number", "hi", F.coalesce(F.col("before"), F.col("lowest") - 1).alias("before")).filter("before < hi")
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("before") + 1) / width), F.floor(F.col("hi") / width))))
    probes = keys.withColumn("bucket", F.floor(F.col("k") / width))
    on = (probes["bucket"] == spans["bucket"]) & (F.col("k") > F.col("before")) & (F.col("k") <= F.col("hi"))
    return probes.join(spans, on, "left").select("k", "number")


def overlap_islands(files: DataFrame) -> DataFrame:
    """Groups of files linked by overlapping ranges: ``number, island``. The window orders file metadata in one task."""
    order = Window.orderBy("lo", "number")
    upto = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("upto").isNull() | (F.col("lo") > F.col("upto")), 1).otherwise(0)
    return files.withColumn("upto", upto).select("number", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("island"))


def fold_edits(edits: DataFrame) -> DataFrame:
    """Edits ``edit_id, action, number`` to the files that live: the last edit of a file decides."""
    return edits.groupBy("number").agg(F.max_by("action", "edit_id").alias("action"), F.max("edit_id").alias("edit_id")).filter("action = 'add'")


def apply_edit(base: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """(base and added) without deleted, by level and number."""
    return base.unionByName(added).distinct().join(deleted.select("level", "number"), ["level", "number"], "left_anti")


def flush_level(flushes: DataFrame, files: DataFrame, max_file_size: int, width: int = 64) -> DataFrame:
    """Deepest level up to 2 that a flushed range can go to: it passes a level with no overlap whose next one overlaps little."""
    f, n = flushes.select("flush", F.col("lo").alias("f_lo"), F.col("hi").alias("f_hi")), files.select("level", "lo", "hi", "file_size")
    hit = overlap_join(f, n, ("f_lo", "f_hi"), ("lo", "hi"), width, "left")
    level = lambda i: F.coalesce(F.max(F.when(F.col("level") == i, 1)), F.lit(0)) == 1
    bytes_ = lambda i: F.coalesce(F.sum(F.when(F.col("level") == i, F.col("file_size"))), F.lit(0))
    per = hit.groupBy("flush").agg(*(level(i).alias(f"o{i}") for i in range(3)), *(bytes_(i).alias(f"b{i}") for i in (2, 3)))
    limit = GRANDPARENT_LIMIT * max_file_size
    one = ~F.col("o0") & ~F.col("o1") & (F.col("b2") <= limit)
    two = one & ~F.col("o2") & (F.col("b3") <= limit)
    return per.select("flush", F.when(two, 2).when(one, 1).otherwise(0).alias("level"))
