"""Queries of the versioned store over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import codec
from lamina.operators import changelog as cl
from lamina.operators import compaction, files, mvcc
from lamina.plans.catalog import register
from lamina.operators.steps import shared_path
from lamina.sources.tables import parse_filename, read_sorted_run, table, write_sorted_run

_LOG = "SELECT user_id AS k, event_id AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op, value AS v FROM events"


def _view(where: str = "true") -> str:
    return f"(SELECT k, max(seq) AS seq, max_by(v, seq) AS v FROM ({_LOG}) WHERE {where} GROUP BY k HAVING max_by(op, seq) <> 0)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return cl.from_events(table(spark, d, "events"))


@register("get_latest", f"SELECT * FROM {_view('k = 42')}")
def get_latest(spark, d):
    return mvcc.get(_log(spark, d), 42)


@register("get_asof", f"SELECT * FROM {_view('seq <= 5000')}")
def get_asof(spark, d):
    return mvcc.as_of(_log(spark, d), 5000)


@register("latest_view", f"SELECT * FROM {_view()}")
def latest_view(spark, d):
    return mvcc.as_of(_log(spark, d))


@register("multi_get", f"SELECT a.k, l.k IS NOT NULL AS found, l.v FROM (SELECT unnest([1, 2, 3, 42, 77, 100000])::BIGINT AS k) a LEFT JOIN {_view()} l ON a.k = l.k")
def multi_get(spark, d):
    return mvcc.multi_get(_log(spark, d), [1, 2, 3, 42, 77, 100000])


@register("range_scan", f"SELECT * FROM {_view('k BETWEEN 20 AND 60')} ORDER BY k")
def range_scan(spark, d):
    return mvcc.range_scan(_log(spark, d), 20, 60)


@register("reverse_scan", f"SELECT * FROM {_view('k BETWEEN 20 AND 60')} ORDER BY k DESC")
def reverse_scan(spark, d):
    return mvcc.range_scan(_log(spark, d), 20, 60, descending=True)


@register("seek_ge", f"SELECT * FROM {_view('k >= 30')} ORDER BY k LIMIT 1")
def seek_ge(spark, d):
    return mvcc.seek(_log(spark, d), 30)


@register("seek_last", f"SELECT * FROM {_view()} ORDER BY k DESC LIMIT 1")
def seek_last(spark, d):
    return mvcc.seek_last(_log(spark, d))


@register("prefix_scan", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000000')")
def prefix_scan(spark, d):
    return table(spark, d, "customer").filter(F.col("c_name").startswith("Customer#00000000")).select("c_custkey", "c_name")


@register("changelog_scan", f"SELECT k, seq, op::TINYINT AS op, v FROM ({_LOG}) ORDER BY k, seq DESC")
def changelog_scan(spark, d):
    return mvcc.merge_runs([_log(spark, d)]).drop("run")


@register("kway_merge", f"SELECT k, seq, op::TINYINT AS op, v, (seq % 4)::INTEGER AS run FROM ({_LOG}) ORDER BY k, seq DESC")
def kway_merge(spark, d):
    log = _log(spark, d)
    return mvcc.merge_runs([log.filter(F.col("seq") % 4 == i) for i in range(4)])


@register("version_chain", f"SELECT k, seq, lag(seq) OVER (PARTITION BY k ORDER BY seq DESC) AS newer_seq FROM ({_LOG})")
def version_chain(spark, d):
    return mvcc.version_chain(_log(spark, d))


@register("mvcc_intervals", f"SELECT k, seq AS begin_seq, lead(seq) OVER (PARTITION BY k ORDER BY seq) AS end_seq, op FROM ({_LOG})")
def mvcc_intervals(spark, d):
    return mvcc.intervals(_log(spark, d))


_BATCH = [(1, 7, 1.5), (0, 8, None), (1, 7, 2.5), (1, 1000000, 3.5), (0, 9, None)]


def _with_ops(ops: list[tuple]) -> str:
    rows = ", ".join(f"({k}::BIGINT, {10_000_000 + i}::BIGINT, {op}, {'NULL' if v is None else v}::DOUBLE)" for i, (op, k, v) in enumerate(ops))
    return f"SELECT k, max(seq) AS seq, max_by(v, seq) AS v FROM (SELECT * FROM ({_LOG}) UNION ALL SELECT * FROM (VALUES {rows})) t(k, seq, op, v) GROUP BY k HAVING max_by(op, seq) <> 0"


@register("batch_apply", _with_ops(_BATCH))
def batch_apply(spark, d):
    return mvcc.as_of(cl.apply_batch(_log(spark, d), _BATCH, 10_000_000))


@register("put_apply", _with_ops([(1, 7, 1.5)]))
def put_apply(spark, d):
    return mvcc.as_of(cl.apply_batch(_log(spark, d), [(1, 7, 1.5)], 10_000_000))


@register("delete_apply", _with_ops([(0, 7, None)]))
def delete_apply(spark, d):
    return mvcc.as_of(cl.apply_batch(_log(spark, d), [(0, 7, None)], 10_000_000))


_CHAIN = f"SELECT *, lag(seq) OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM ({_LOG})"


@register("compact_survivors", f"SELECT k, seq, op::TINYINT AS op, v FROM ({_CHAIN}) WHERE NOT coalesce(n <= 7000, false) AND NOT (op = 0 AND seq <= 7000)")
def compact_survivors(spark, d):
    return compaction.survivors(_log(spark, d), 7000)


@register(
    "tombstone_gc",
    f"""WITH deeper AS (SELECT min(user_id) AS lo, max(user_id) AS hi FROM events WHERE user_id < 75 GROUP BY user_id // 10)
SELECT k, seq, op::TINYINT AS op, v FROM ({_CHAIN}) c WHERE NOT coalesce(n <= 7000, false)
AND NOT (op = 0 AND seq <= 7000 AND NOT EXISTS (SELECT 1 FROM deeper d WHERE c.k BETWEEN d.lo AND d.hi))""",
)
def tombstone_gc(spark, d):
    ranges = table(spark, d, "events").filter("user_id < 75").groupBy(F.floor(F.col("user_id") / 10)).agg(F.min("user_id").alias("lo"), F.max("user_id").alias("hi"))
    return compaction.survivors(_log(spark, d), 7000, ranges.select("lo", "hi"))


_SPANS = "(SELECT number, number * 40 AS lo, number * 40 + 30 + (number % 3) * 15 AS hi, number * 1000 AS file_size, number % 4 AS level FROM (SELECT DISTINCT o_custkey % 40 AS number FROM orders))"


def _spans(spark, d) -> DataFrame:
    n = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("number")).distinct()
    number = F.col("number")
    return n.select("number", (number * 40).alias("lo"), (number * 40 + 30 + (number % 3) * 15).alias("hi"), (number * 1000).alias("file_size"), (number % 4).alias("level"))


@register("file_ranges", "SELECT o_orderkey // 500 AS number, min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders GROUP BY 1")
def file_ranges(spark, d):
    """Smallest and largest key of each file of 500 orders."""
    return table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 500).alias("number")).agg(F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("hi"))


@register("file_overlap_join", f"SELECT a.number AS a, a.lo AS a_lo, a.hi AS a_hi, b.number AS b, b.lo AS b_lo, b.hi AS b_hi FROM {_SPANS} a, {_SPANS} b WHERE a.lo <= b.hi AND b.lo <= a.hi AND a.number < b.number")
def file_overlap_join(spark, d):
    f = _spans(spark, d)
    return files.overlapping_pairs(f, f, F.col("a") < F.col("b"))


@register("l0_overlap_closure", f"SELECT number, (sum(CASE WHEN ph IS NULL OR lo > ph THEN 1 ELSE 0 END) OVER (ORDER BY lo, number))::BIGINT AS island FROM (SELECT *, max(hi) OVER (ORDER BY lo, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph FROM {_SPANS})")
def l0_overlap_closure(spark, d):
    return files.overlap_islands(_spans(spark, d))


@register("find_file", f"SELECT k, (SELECT min_by(number, hi) FROM {_SPANS} WHERE hi >= k) AS number FROM (SELECT DISTINCT o_custkey AS k FROM orders)")
def find_file(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return files.find_file(keys, _spans(spark, d), 64)


@register(
    "boundary_files",
    f"""WITH RECURSIVE f AS (SELECT number, number * 10 AS lo, number * 10 + CASE WHEN number % 4 = 3 THEN 5 ELSE 10 END AS hi FROM {_SPANS}),
r(number, hi) AS (SELECT number, hi FROM f WHERE number % 8 = 0 UNION SELECT f.number, f.hi FROM f JOIN r ON f.lo = r.hi AND f.number <> r.number) SELECT number FROM r""",
)
def boundary_files(spark, d):
    n = F.col("number")
    f = _spans(spark, d).select("number", (n * 10).alias("lo"), (n * 10 + F.when(n % 4 == 3, 5).otherwise(10)).alias("hi"))
    view = f"boundary_{uuid.uuid4().hex}"
    f.createOrReplaceTempView(view)
    try:
        return spark.sql(
            f"WITH RECURSIVE r(number, hi) AS (SELECT number, hi FROM {view} WHERE number % 8 = 0 UNION ALL "
            f"SELECT f.number, f.hi FROM {view} f JOIN r ON f.lo = r.hi AND f.number <> r.number) SELECT DISTINCT number FROM r"
        )
    finally:
        spark.catalog.dropTempView(view)


_LEVELS = "(SELECT (l_linenumber - 1)::BIGINT AS level, l_suppkey AS number, (sum(l_quantity) * 10000)::BIGINT AS file_size FROM lineitem GROUP BY 1, 2)"
_BUDGET = "10485760 * pow(10.0, level - 1)"
_SCORES = f"(SELECT level, count(*) AS n_files, sum(file_size)::BIGINT AS level_bytes, round(CASE WHEN level = 0 THEN count(*) / 4 WHEN level < 6 THEN sum(file_size) / ({_BUDGET}) END, 6) AS score FROM {_LEVELS} GROUP BY level)"


def _levels(spark, d) -> DataFrame:
    line = table(spark, d, "lineitem")
    level = (F.col("l_linenumber") - 1).cast("long").alias("level")
    return line.groupBy(level, F.col("l_suppkey").alias("number")).agg((F.sum("l_quantity") * 10000).cast("long").alias("file_size"))


@register("level_bytes", f"SELECT level, sum(file_size)::BIGINT AS level_bytes FROM {_LEVELS} GROUP BY level")
def level_bytes(spark, d):
    return _levels(spark, d).groupBy("level").agg(F.sum("file_size").alias("level_bytes"))


@register("level_scores", f"SELECT * FROM {_SCORES}")
def level_scores(spark, d):
    return compaction.level_scores(_levels(spark, d)).withColumn("score", F.round("score", 6))


@register("pick_level", f"SELECT * FROM {_SCORES} WHERE score IS NOT NULL ORDER BY score DESC, level LIMIT 1")
def pick_level(spark, d):
    return compaction.pick_level(compaction.level_scores(_levels(spark, d)).withColumn("score", F.round("score", 6)))


@register("pick_input_file", f"SELECT level, coalesce(min(number) FILTER (number > 40), min(number)) AS number FROM {_LEVELS} GROUP BY level")
def pick_input_file(spark, d):
    """The first file behind the level's round-robin pointer (40), else the level's first."""
    return _levels(spark, d).groupBy("level").agg(F.coalesce(F.min(F.when(F.col("number") > 40, F.col("number"))), F.min("number")).alias("number"))


@register("compaction_stats", f"SELECT level, sum(file_size)::BIGINT AS bytes_read, (sum(file_size) FILTER (number % 2 = 0))::BIGINT AS bytes_written, count(*) AS files FROM {_LEVELS} GROUP BY level")
def compaction_stats(spark, d):
    even = F.when(F.col("number") % 2 == 0, F.col("file_size"))
    return _levels(spark, d).groupBy("level").agg(F.sum("file_size").alias("bytes_read"), F.sum(even).alias("bytes_written"), F.count("*").alias("files"))


@register("allowed_seeks", f"SELECT level, number, greatest(100, file_size // 16384)::BIGINT AS allowed_seeks FROM {_LEVELS}")
def allowed_seeks(spark, d):
    return _levels(spark, d).select("level", "number", compaction.allowed_seeks(F.col("file_size")).alias("allowed_seeks"))


_MOVE = f"SELECT a.number FROM {_SPANS} a WHERE a.level = 1 AND NOT EXISTS (SELECT 1 FROM {_SPANS} p WHERE p.level = 2 AND p.lo <= a.hi AND a.lo <= p.hi) AND (SELECT coalesce(sum(g.file_size), 0) FROM {_SPANS} g WHERE g.level = 3 AND g.lo <= a.hi AND a.lo <= g.hi) <= 20000"


@register("trivial_moves", _MOVE)
def trivial_moves(spark, d):
    """Files of level 1 that can move down as they are: no overlap at level 2, little at level 3."""
    f = _spans(spark, d)
    level = lambda n, x: f.filter(F.col("level") == n).select(F.col("lo").alias(f"{x}_lo"), F.col("hi").alias(f"{x}_hi"), F.col("file_size").alias(f"{x}_size"))
    alone = files.overlap_join(f.filter("level = 1"), level(2, "p"), ("lo", "hi"), ("p_lo", "p_hi"), 64, "left_anti")
    grand = files.overlap_join(alone, level(3, "g"), ("lo", "hi"), ("g_lo", "g_hi"), 64, "left").groupBy("number").agg(F.coalesce(F.sum("g_size"), F.lit(0)).alias("below"))
    return grand.filter("below <= 20000").select("number")


@register(
    "flush_level",
    f"""WITH u AS (SELECT DISTINCT o_custkey % 50 AS flush FROM orders), r AS (SELECT flush, flush * 33 AS lo, flush * 33 + 8 AS hi FROM u), n AS (SELECT * FROM {_SPANS}),
p AS (SELECT flush, bool_or(coalesce(n.level = 0, false)) AS o0, bool_or(coalesce(n.level = 1, false)) AS o1, bool_or(coalesce(n.level = 2, false)) AS o2,
coalesce(sum(file_size) FILTER (level = 2), 0) AS b2, coalesce(sum(file_size) FILTER (level = 3), 0) AS b3 FROM r LEFT JOIN n ON n.lo <= r.hi AND n.hi >= r.lo GROUP BY flush)
SELECT flush, (CASE WHEN o0 OR o1 OR b2 > 25000 THEN 0 WHEN o2 OR b3 > 25000 THEN 1 ELSE 2 END)::INTEGER AS level FROM p""",
)
def flush_level(spark, d):
    flush = (F.col("o_custkey") % 50).alias("flush")
    flushes = table(spark, d, "orders").select(flush).distinct().select("flush", (F.col("flush") * 33).alias("lo"), (F.col("flush") * 33 + 8).alias("hi"))
    return files.flush_level(flushes, _spans(spark, d), 1000)


_EDITS = "(SELECT event_id AS edit_id, CASE WHEN event_type = 'error' THEN 'del' ELSE 'add' END AS action, user_id AS number FROM events WHERE event_type IN ('signup', 'purchase', 'error'))"
_LIVE = f"(SELECT number, max(edit_id) AS edit_id FROM {_EDITS} GROUP BY number HAVING max_by(action, edit_id) = 'add')"


def _edits(spark, d) -> DataFrame:
    e = table(spark, d, "events").filter(F.col("event_type").isin("signup", "purchase", "error"))
    return e.select(F.col("event_id").alias("edit_id"), F.when(F.col("event_type") == "error", "del").otherwise("add").alias("action"), F.col("user_id").alias("number"))


@register("manifest_fold", f"SELECT number, edit_id FROM {_LIVE}")
def manifest_fold(spark, d):
    return files.fold_edits(_edits(spark, d)).select("number", "edit_id")


@register("manifest_snapshot", f"SELECT 'add' AS action, number FROM {_LIVE}")
def manifest_snapshot(spark, d):
    return files.fold_edits(_edits(spark, d)).select("action", "number")


@register("live_files", f"SELECT DISTINCT number FROM (SELECT number FROM {_LIVE} UNION ALL SELECT number FROM {_EDITS} WHERE edit_id <= 2000 GROUP BY number HAVING max_by(action, edit_id) = 'add')")
def live_files(spark, d):
    """Files of the newest version or of one that a reader still holds."""
    e = _edits(spark, d)
    held = files.fold_edits(e.filter("edit_id <= 2000"))
    return files.fold_edits(e).select("number").unionByName(held.select("number")).distinct()


@register("obsolete_files", f"SELECT DISTINCT number FROM {_EDITS} WHERE number NOT IN (SELECT number FROM {_LIVE})")
def obsolete_files(spark, d):
    e = _edits(spark, d)
    return e.select("number").distinct().join(files.fold_edits(e).select("number"), "number", "left_anti")


@register("version_apply", f"SELECT level, number, lo FROM {_SPANS} WHERE number % 2 = 0 AND number % 3 <> 0 UNION SELECT level, number, lo FROM {_SPANS} WHERE number % 5 = 0 AND number % 3 <> 0")
def version_apply(spark, d):
    f = _spans(spark, d).select("level", "number", "lo")
    return files.apply_edit(f.filter("number % 2 = 0"), f.filter("number % 5 = 0"), f.filter("number % 3 = 0"))


_NAMES = "(SELECT CASE event_id % 9 WHEN 0 THEN 'CURRENT' WHEN 1 THEN 'LOCK' WHEN 2 THEN 'LOG.old' WHEN 3 THEN 'MANIFEST-' || lpad(event_id::VARCHAR, 6, '0') WHEN 4 THEN lpad(event_id::VARCHAR, 6, '0') || '.log' WHEN 5 THEN event_id::VARCHAR || '.ldb' WHEN 6 THEN event_id::VARCHAR || '.vtb' WHEN 7 THEN '99999999999999999999' || '.sst' ELSE event_id::VARCHAR || '.dbtmp' END AS name FROM events)"


@register(
    "parse_filename",
    f"""SELECT name, CASE WHEN name IN ('CURRENT', 'LOCK', 'LOG.old') THEN 0 WHEN name LIKE '%.sst' THEN NULL ELSE regexp_extract(name, '(\\d+)', 1)::BIGINT END AS number,
CASE WHEN name = 'CURRENT' THEN 'current' WHEN name = 'LOCK' THEN 'lock' WHEN name = 'LOG.old' THEN 'info_log' WHEN name LIKE 'MANIFEST%' THEN 'manifest' WHEN name LIKE '%.log' THEN 'log' WHEN name LIKE '%.ldb' THEN 'table' WHEN name LIKE '%.vtb' THEN 'value' WHEN name LIKE '%.dbtmp' THEN 'temp' END AS kind FROM {_NAMES}""",
)
def parse_filename_query(spark, d):
    text = F.col("event_id").cast("string")
    padded = F.lpad(text, 6, "0")
    forms = ["CURRENT", "LOCK", "LOG.old", F.concat(F.lit("MANIFEST-"), padded), F.concat(padded, F.lit(".log")), F.concat(text, F.lit(".ldb")), F.concat(text, F.lit(".vtb")), "99999999999999999999.sst", F.concat(text, F.lit(".dbtmp"))]
    name = F.get(F.array(*(F.lit(x) if isinstance(x, str) else x for x in forms)), (F.col("event_id") % 9).cast("int"))
    parsed = table(spark, d, "events").select(name.alias("name")).withColumn("p", parse_filename(F.col("name")))
    return parsed.select("name", F.col("p.number").cast("long").alias("number"), F.col("p.kind").alias("kind"))


@register("sst_write_roundtrip", f"SELECT count(*) AS n, sum(seq)::BIGINT AS seqs, round(sum(v), 2) AS vs FROM ({_LOG})")
def sst_write_roundtrip(spark, d):
    path = shared_path(spark, "sorted-run")
    write_sorted_run(_log(spark, d), path, 4)
    return read_sorted_run(spark, path).agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"), F.round(F.sum("v"), 2).alias("vs"))


@register("pack_tag", f"SELECT k, seq, (seq << 8) | op AS tag FROM ({_LOG})")
def pack_tag(spark, d):
    return _log(spark, d).select("k", "seq", codec.pack_tag(F.col("seq"), F.col("op")).alias("tag"))


@register("fixed64", "SELECT event_id, lpad(hex(event_id), 16, '0') AS bytes FROM events")
def fixed64(spark, d):
    return table(spark, d, "events").select("event_id", codec.fixed64(F.col("event_id")).alias("bytes"))


_VARINT = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END"


@register("varint_length", f"SELECT doc_id, ({_VARINT.format('strlen(text)')})::INTEGER AS varint_bytes FROM documents")
def varint_length(spark, d):
    return table(spark, d, "documents").select("doc_id", codec.varint_length(F.octet_length("text")).alias("varint_bytes"))


_ENTRY = f"({_VARINT.format('(strlen(k) + 8)')} + strlen(k) + 8 + {_VARINT.format('strlen(text)')} + strlen(text))"


@register("entry_size", f"SELECT doc_id, {_ENTRY}::BIGINT AS entry_bytes FROM (SELECT doc_id, doc_id::VARCHAR AS k, text FROM documents)")
def entry_size(spark, d):
    return table(spark, d, "documents").select("doc_id", codec.entry_size(F.octet_length(F.col("doc_id").cast("string")), F.octet_length("text")).alias("entry_bytes"))


@register("memtable_bytes", f"SELECT doc_id, (sum({_ENTRY}) OVER (PARTITION BY doc_id % 64 ORDER BY doc_id))::BIGINT AS used FROM (SELECT doc_id, doc_id::VARCHAR AS k, text FROM documents)")
def memtable_bytes(spark, d):
    """Bytes that each of 64 writers' buffers holds after each write."""
    size = codec.entry_size(F.octet_length(F.col("doc_id").cast("string")), F.octet_length("text"))
    sized = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 64).alias("writer"), size.alias("size"))
    order = Window.partitionBy("writer").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sized.select("doc_id", F.sum("size").over(order).alias("used"))


_KEYS = "(SELECT c_nationkey AS file, c_name AS key, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1 AS r, lag(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_name) AS p FROM customer)"


@register("restart_points", f"SELECT file, key FROM {_KEYS} WHERE r % 16 = 0")
def restart_points(spark, d):
    order = Window.partitionBy("file").orderBy("key")
    keys = table(spark, d, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_name").alias("key"))
    return keys.withColumn("r", F.row_number().over(order) - 1).filter("r % 16 = 0").select("file", "key")


_SHARED = "(CASE WHEN r % 16 = 0 THEN 0 ELSE len(list_filter(range(1, length(key) + 1), lambda i: p[1:i] = key[1:i])) END)::INTEGER"


@register("prefix_delta", f"SELECT file, key, {_SHARED} AS shared, (length(key) - {_SHARED})::INTEGER AS non_shared FROM {_KEYS}")
def prefix_delta(spark, d):
    return codec.prefix_delta(table(spark, d, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_name").alias("key")), "file", "key")


_PAIRS = "(SELECT p_partkey, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS b FROM part)"
_LCP = "len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[1:i] = b[1:i]))"


@register(
    "short_separator",
    f"SELECT p_partkey, CASE WHEN n >= least(length(a), length(b)) OR ascii(a[n + 1:n + 1]) + 1 >= ascii(b[n + 1:n + 1]) THEN a ELSE a[1:n] || chr(ascii(a[n + 1:n + 1]) + 1) END AS separator FROM (SELECT *, {_LCP} AS n FROM {_PAIRS} WHERE a < b)",
)
def short_separator(spark, d):
    order = Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")
    pairs = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.lead("p_name").over(order).alias("b")).filter("a < b")
    return pairs.select("p_partkey", codec.short_separator(F.col("a"), F.col("b")).alias("separator"))


@register("short_successor", "SELECT p_partkey, chr(ascii(p_name) + 1) AS successor FROM part")
def short_successor(spark, d):
    return table(spark, d, "part").select("p_partkey", codec.short_successor(F.col("p_name")).alias("successor"))


_SIZED = "(SELECT user_id % 16 AS grp, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS r, event_id, (event_id * 7919) % 4000 + 10 AS size, (event_id % 5 = 0) AS sync FROM events)"


def _sized(spark, d) -> DataFrame:
    return table(spark, d, "events").select((F.col("user_id") % 16).alias("grp"), "event_id", ((F.col("event_id") * 7919) % 4000 + 10).alias("size"), (F.col("event_id") % 5 == 0).alias("sync"))


@register(
    "output_file_split",
    f"""WITH RECURSIVE s AS (SELECT * FROM {_SIZED}), f AS (SELECT grp, r, event_id, size AS held, 0::BIGINT AS part FROM s WHERE r = 1 UNION ALL
SELECT s.grp, s.r, s.event_id, CASE WHEN f.held >= 50000 THEN s.size ELSE f.held + s.size END, f.part + CASE WHEN f.held >= 50000 THEN 1 ELSE 0 END FROM f JOIN s ON s.grp = f.grp AND s.r = f.r + 1)
SELECT grp, event_id, part FROM f""",
)
def output_file_split(spark, d):
    return compaction.cut_greedily(_sized(spark, d), "grp", "event_id", "size", 50000).select("grp", "event_id", "part")


_MOST = "CASE WHEN s.size * 50 <= 131072 THEN s.size * 50 + 131072 ELSE 1048576 END"
_JOINS = "(NOT (s.sync AND NOT f.leader_sync) AND f.held + s.size * 50 <= f.most)"


@register(
    "group_commit",
    f"""WITH RECURSIVE s AS (SELECT * FROM {_SIZED}), f AS (SELECT grp, r, event_id, size * 50 AS held, {_MOST} AS most, sync AS leader_sync, 0::BIGINT AS g FROM s WHERE r = 1 UNION ALL
SELECT s.grp, s.r, s.event_id, CASE WHEN {_JOINS} THEN f.held + s.size * 50 ELSE s.size * 50 END, CASE WHEN {_JOINS} THEN f.most ELSE {_MOST} END,
CASE WHEN {_JOINS} THEN f.leader_sync ELSE s.sync END, f.g + CASE WHEN {_JOINS} THEN 0 ELSE 1 END FROM f JOIN s ON s.grp = f.grp AND s.r = f.r + 1)
SELECT grp, event_id, g AS commit_group FROM f""",
)
def group_commit(spark, d):
    sized = _sized(spark, d).withColumn("size", F.col("size") * 50)
    return compaction.group_commit(sized, "grp", "event_id", "size", "sync").select("grp", "event_id", "commit_group")


_STEP = "CASE WHEN 32768 - f.pos < 7 THEN 0 ELSE f.pos END"
_FRAGMENTS = f"""WITH RECURSIVE s AS (SELECT grp AS log, r, event_id AS rec, size * 20 AS size FROM {_SIZED}),
f AS (SELECT log, r, rec, -1 AS fragment, '' AS kind, 0::BIGINT AS bytes, 0::BIGINT AS block, 0::BIGINT AS pos, size AS remaining, false AS ended FROM s WHERE r = 1
UNION ALL
SELECT n.log, n.r, n.rec, n.fragment, CASE WHEN n.fragment = 0 THEN CASE WHEN n.bytes = n.remaining THEN 'FULL' ELSE 'FIRST' END ELSE CASE WHEN n.bytes = n.remaining THEN 'LAST' ELSE 'MIDDLE' END END,
n.bytes, n.block, n.pos + 7 + n.bytes, n.remaining - n.bytes, n.bytes = n.remaining FROM (
SELECT s.log, s.r, s.rec, CASE WHEN f.ended THEN 0 ELSE f.fragment + 1 END AS fragment, CASE WHEN f.ended THEN s.size ELSE f.remaining END AS remaining,
f.block + CASE WHEN 32768 - f.pos < 7 THEN 1 ELSE 0 END AS block, {_STEP} AS pos, least(CASE WHEN f.ended THEN s.size ELSE f.remaining END, 32768 - {_STEP} - 7) AS bytes
FROM f JOIN s ON s.log = f.log AND s.r = f.r + CASE WHEN f.ended THEN 1 ELSE 0 END) n)
SELECT log, rec, fragment, kind, bytes, block FROM f WHERE fragment >= 0"""


def _records(spark, d) -> DataFrame:
    return _sized(spark, d).select(F.col("grp").alias("log"), F.col("event_id").alias("rec"), (F.col("size") * 20).alias("size"))


@register("wal_fragments", _FRAGMENTS)
def wal_fragments(spark, d):
    return codec.log_fragments(_records(spark, d), "log", "rec", "size")


@register("wal_replay", f"SELECT grp AS log, event_id AS rec, (size * 20)::BIGINT AS bytes FROM {_SIZED}")
def wal_replay(spark, d):
    return codec.join_fragments(codec.log_fragments(_records(spark, d), "log", "rec", "size"), "log", "rec")
