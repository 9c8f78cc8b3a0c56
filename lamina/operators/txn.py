"""Transaction theory over operation tables ``txn, at, obj, writes``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.steps import written


def conflicts(ops: DataFrame) -> DataFrame:
    """Ordered pairs of operations of different transactions on one object, at least one a write."""
    a = ops.select("obj", F.col("txn").alias("src"), F.col("at").alias("first"), F.col("writes").alias("a_writes"))
    b = ops.select("obj", F.col("txn").alias("dst"), F.col("at").alias("second"), F.col("writes").alias("b_writes"))
    pairs = a.join(b, "obj").filter("first < second and src <> dst and (a_writes or b_writes)")
    kind = F.when(F.col("a_writes") & F.col("b_writes"), "WW").when(F.col("a_writes"), "WR").otherwise("RW")
    return pairs.select("obj", "src", "dst", "first", "second", kind.alias("kind"))


def precedence(ops: DataFrame) -> DataFrame:
    """Edges of the precedence graph: ``src, dst``.

    Per object and transaction only the first and last operation and write matter, so operations are aggregated before
    they meet.
    """
    at_write = F.when(F.col("writes"), F.col("at"))
    per = ops.groupBy("obj", "txn").agg(F.min("at").alias("a0"), F.max("at").alias("a1"), F.min(at_write).alias("w0"), F.max(at_write).alias("w1"))
    a = per.select("obj", F.col("txn").alias("src"), F.col("a0").alias("src_first"), F.col("w0").alias("src_write"))
    b = per.select("obj", F.col("txn").alias("dst"), F.col("a1").alias("dst_last"), F.col("w1").alias("dst_write"))
    return a.join(b, "obj").filter("src <> dst and (src_write < dst_last or src_first < dst_write)").select("src", "dst").distinct()


def on_cycles(edges: DataFrame) -> DataFrame:
    """Transactions on a cycle, by doubling reachability: paths of length n take log n joins, each step is written."""
    reach, known = written(edges.distinct(), "reach"), -1
    while (n := reach.count()) != known:
        known = n
        step = reach.select("src", F.col("dst").alias("via")).join(reach.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
        reach = written(reach.unionByName(step).distinct(), "reach")
    return reach.filter("src = dst").select(F.col("src").alias("txn"))


def write_write(txns: DataFrame) -> DataFrame:
    """Transactions ``txn, obj, begin_at, commit_at`` that overlap and write the same object: the later committer loses."""
    a = txns.select("obj", F.col("txn").alias("loser"), F.col("begin_at").alias("a0"), F.col("commit_at").alias("a1"))
    b = txns.select("obj", F.col("txn").alias("winner"), F.col("begin_at").alias("b0"), F.col("commit_at").alias("b1"))
    return a.join(b, "obj").filter("loser <> winner and a0 < b1 and b0 < a1 and a1 > b1").select("loser", "winner", "obj")


def waits(ops: DataFrame) -> DataFrame:
    """Edges ``requester, holder`` of the wait-for graph: the first writer of an object holds it, later writers wait."""
    writes = ops.filter("writes")
    held = writes.groupBy("obj").agg(F.min_by("txn", "at").alias("holder"), F.min("at").alias("since"))
    return writes.join(held, "obj").filter("at > since and txn <> holder").select(F.col("txn").alias("requester"), "holder").distinct()


def prevention(edges: DataFrame) -> DataFrame:
    """What each wait comes to; the smaller number is the older transaction."""
    older = F.col("requester") < F.col("holder")
    return edges.withColumns({"wait_die": F.when(older, "wait").otherwise("die"), "wound_wait": F.when(older, "wound").otherwise("wait")})


def validation(ops: DataFrame, theirs: Column, own: Column, meets: Callable[[Column, Column], Column]) -> DataFrame:
    """``txn, valid``: of the operations ``own`` of a transaction none shares its object with one in ``theirs`` of those it ``meets``."""
    mine = ops.filter(own).select("txn", "obj").distinct()
    others = ops.filter(theirs).select(F.col("txn").alias("other"), "obj").distinct()
    bad = mine.join(others, "obj").filter(meets(F.col("txn"), F.col("other"))).select("txn").distinct().withColumn("bad", F.lit(True))
    return ops.select("txn").distinct().join(bad, "txn", "left").select("txn", F.col("bad").isNull().alias("valid"))


def backward_validation(ops: DataFrame, back: int) -> DataFrame:
    """``txn, valid``: no transaction of the ``back`` before it wrote what it read."""
    return validation(ops, F.col("writes"), ~F.col("writes"), lambda own, other: other.between(own - back, own - 1))


def write_skew(ops: DataFrame, apart: int) -> DataFrame:
    """Pairs ``a, b`` of transactions at most ``apart`` numbers from each other: each reads what the other writes, writes are disjoint."""
    sets = ops.groupBy("txn", "obj").agg(F.bool_or("writes").alias("w"), F.bool_or(~F.col("writes")).alias("r"))
    b = sets.select("obj", F.col("txn").alias("b"), F.col("w").alias("b_w"), F.col("r").alias("b_r"))
    met = sets.withColumnRenamed("txn", "a").join(b, "obj").filter((F.col("a") < F.col("b")) & (F.col("b") <= F.col("a") + apart))
    any_ = lambda x, y: F.bool_or(F.col(x) & F.col(y))
    judged = met.groupBy("a", "b").agg(any_("r", "b_w").alias("there"), any_("w", "b_r").alias("back"), any_("w", "b_w").alias("both"))
    return judged.filter("there and back and not both").select("a", "b")


def first_writer(ops: DataFrame) -> DataFrame:
    """``obj, loser, winner``: of the writers of an object only the first goes on."""
    writes = ops.filter("writes")
    first = writes.groupBy("obj").agg(F.min_by("txn", "at").alias("winner"))
    return writes.select("obj", F.col("txn").alias("loser")).distinct().join(first, "obj").filter("loser <> winner")


def timestamp_order(ops: DataFrame) -> DataFrame:
    """Whether an operation comes too late for its transaction's number: a read behind a younger write, a write behind a
    younger read or write, of the same object. Writes that a younger read aborts leave no mark; the marks of other
    aborted operations lie below one that stays, so they change nothing and two running maxima suffice."""
    earlier = Window.partitionBy("obj").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    late = lambda mark: F.coalesce(F.col(mark) > F.col("txn"), F.lit(False))
    read = ops.withColumn("read_ts", F.max(F.when(~F.col("writes"), F.col("txn"))).over(earlier))
    marked = read.withColumn("write_ts", F.max(F.when(F.col("writes") & ~late("read_ts"), F.col("txn"))).over(earlier))
    return marked.select("at", "txn", "obj", (late("write_ts") | (F.col("writes") & late("read_ts"))).alias("aborts"))


def _ends(log: DataFrame, begins: Column, commits: Column) -> DataFrame:
    return log.groupBy("txn").agg(F.max(F.when(begins, F.col("lsn"))).alias("began"), F.max(F.when(commits, F.col("lsn"))).alias("done")).filter("began > coalesce(done, -1)")


def losers(log: DataFrame, begins: Column, commits: Column) -> DataFrame:
    return _ends(log, begins, commits).select("txn")


def recovery(log: DataFrame, flushes: Column, begins: Column, commits: Column, changes: Column) -> DataFrame:
    """One row: ``dirty_pages``, where redo begins (``redo_from``), how many of the losers' changes are ``undone``, last first from ``undo_from``."""
    flushed = F.max(F.when(flushes, F.col("lsn"))).over(Window.partitionBy("page"))
    dirty = log.select("page", "lsn", flushes.alias("flush"), F.coalesce(flushed, F.lit(-1)).alias("flushed")).filter("not flush and lsn > flushed")
    pages = dirty.groupBy("page").agg(F.min("lsn").alias("rec_lsn")).agg(F.count("*").alias("dirty_pages"), F.min("rec_lsn").alias("redo_from"))
    undo = log.filter(changes).join(_ends(log, begins, commits), "txn").filter("lsn >= began")
    return pages.crossJoin(undo.agg(F.count("*").alias("undone"), F.max("lsn").alias("undo_from")))  # one row each


def suffix(log: DataFrame, is_checkpoint: Column) -> DataFrame:
    """Records behind the last checkpoint; all of them if there is none."""
    last = log.filter(is_checkpoint).agg(F.max("lsn").alias("last"))
    return log.join(F.broadcast(last), F.col("last").isNull() | (F.col("lsn") > F.col("last"))).drop("last")  # one row
