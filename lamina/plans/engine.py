"""Queries of the store as a whole, of its codecs, and the relational and index operators beside the plain ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.functions import codec, index
from lamina.operators import compaction, files, mvcc
from lamina.operators.engine import Store
from lamina.operators.steps import shared_path
from lamina.plans.catalog import register
from lamina.plans.store import _LEVELS, _LOG, _SPANS, _levels, _log, _spans, _view
from lamina.sources.tables import read_sorted_run, table, write_sorted_run

c = F.col
_CHANGES = "k bigint, seq bigint, op tinyint, v double"


def _reopened(spark, d) -> Store:
    """A store that flushed three quarters of the changes in two runs, then was closed and opened again."""
    log, path = _log(spark, d).select("k", "seq", c("op").cast("tinyint").alias("op"), "v"), shared_path(spark, "store")
    store = Store(spark, path, _CHANGES)
    for part in range(4):
        store.write(log.filter(c("seq") % 4 == part))
        if part in (1, 2):
            store.flush(4)
    return Store(spark, path, _CHANGES)


@register("open_recover", f"SELECT * FROM {_view()}")
def open_recover(spark, d):
    """Manifest fold, live runs and log replay give the same view as the changelog."""
    return _reopened(spark, d).view()


@register("recovered_changes", f"SELECT k, seq, op::TINYINT AS op, v FROM ({_LOG})")
def recovered_changes(spark, d):
    return _reopened(spark, d).changes().select("k", "seq", "op", "v")


@register("point_read", f"SELECT k, seq, op::TINYINT AS op, v FROM ({_LOG}) WHERE k = 42")
def point_read(spark, d):
    """All versions of a key from a sorted run; the filter is pushed into the scan."""
    path = shared_path(spark, "sorted-run")
    write_sorted_run(_log(spark, d), path, 8)
    return read_sorted_run(spark, path).filter("k = 42").select("k", "seq", c("op").cast("tinyint").alias("op"), "v")


@register("manifest_append", "SELECT number, level FROM (VALUES (1, 0), (3, 1), (4, 0)) t(number, level)")
def manifest_append(spark, d):
    store = Store(spark, shared_path(spark, "store"), _CHANGES)
    for edit in ([("add", 1, 0)], [("add", 2, 0)], [("del", 2, 0), ("add", 3, 1)], [("add", 4, 0)]):
        store.append_edit(edit)
    live = Store(spark, store.path, _CHANGES).live
    return spark.createDataFrame([(n, lv) for n, lv in live], "number int, level int")


@register("empty_scan", f"SELECT k, seq, v FROM ({_LOG}) WHERE false")
def empty_scan(spark, d):
    return _log(spark, d).select("k", "seq", "v").limit(0)


@register("level_scan", f"SELECT (k // 10)::BIGINT AS file, k, seq, v FROM ({_LOG}) ORDER BY k, seq DESC")
def level_scan(spark, d):
    """The files of a level, disjoint and in key order, read one after the other."""
    log = _log(spark, d)
    ranges = log.groupBy(F.floor(c("k") / 10).alias("number")).agg(F.max("k").alias("hi"))
    placed = log.join(files.find_file(log.select("k").distinct(), ranges, 64), "k")
    return placed.orderBy("k", c("seq").desc()).select(c("number").alias("file"), "k", "seq", "v")


@register("compaction_input", f"SELECT k, seq, v, CASE WHEN seq % 5 < 3 THEN seq % 5 ELSE 3 END::INTEGER AS run FROM ({_LOG}) ORDER BY k, seq DESC")
def compaction_input(spark, d):
    """Every file of level 0 is a run by itself, the files of the level below are one run; all are merged."""
    log = _log(spark, d)
    upper = [log.filter(c("seq") % 5 == i) for i in range(3)]
    lower = log.filter(c("seq") % 5 == 3).unionByName(log.filter(c("seq") % 5 == 4))
    return mvcc.merge_runs([*upper, lower]).select("k", "seq", "v", "run")


_VARINT4 = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END"
_ENTRY = f"({_VARINT4.format('(strlen(doc_id::VARCHAR) + 8)')} + strlen(doc_id::VARCHAR) + 8 + {_VARINT4.format('strlen(text)')} + strlen(text))"


@register(
    "memtable_rotate",
    f"""WITH RECURSIVE s AS (SELECT doc_id % 16 AS writer, doc_id, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS r, {_ENTRY} AS size FROM documents),
f AS (SELECT writer, r, doc_id, size AS held, 0::BIGINT AS buffer FROM s WHERE r = 1 UNION ALL
SELECT s.writer, s.r, s.doc_id, CASE WHEN f.held > 65536 THEN s.size ELSE f.held + s.size END, f.buffer + CASE WHEN f.held > 65536 THEN 1 ELSE 0 END FROM f JOIN s ON s.writer = f.writer AND s.r = f.r + 1)
SELECT writer, doc_id, buffer FROM f""",
)
def memtable_rotate(spark, d):
    """A writer's buffer gives way to a new one before a write that finds it above the write-buffer size."""
    size = codec.entry_size(F.octet_length(c("doc_id").cast("string")), F.octet_length("text"))
    sized = table(spark, d, "documents").select((c("doc_id") % 16).alias("writer"), "doc_id", size.alias("size"))
    return compaction.cut_greedily(sized, "writer", "doc_id", "size", 65537).select("writer", "doc_id", c("part").alias("buffer"))


@register("l0_closure", f"WITH RECURSIVE f AS (SELECT * FROM {_SPANS}), r AS (SELECT number, lo, hi FROM f WHERE lo <= 220 AND hi >= 200 UNION SELECT f.number, f.lo, f.hi FROM f JOIN r ON f.lo <= r.hi AND f.hi >= r.lo) SELECT DISTINCT number FROM r")
def l0_closure(spark, d):
    return files.closure(_spans(spark, d), 200, 220)


_P = f"(SELECT * FROM {_SPANS} WHERE number % 2 = 0)"
_Q = f"(SELECT * FROM {_SPANS} WHERE number % 2 = 1)"


@register(
    "expand_inputs",
    f"""WITH u AS (SELECT * FROM {_P}), w AS (SELECT * FROM {_Q}),
a AS (SELECT s.number, s.file_size, count(w.number) AS b_n, coalesce(sum(w.file_size), 0) AS b_size, least(s.lo, coalesce(min(w.lo), s.lo)) AS lo, greatest(s.hi, coalesce(max(w.hi), s.hi)) AS hi FROM u s LEFT JOIN w ON w.lo <= s.hi AND s.lo <= w.hi GROUP BY s.number, s.file_size, s.lo, s.hi),
b AS (SELECT a.number, a.file_size, b_n, b_size, count(*) AS u_n, sum(u.file_size) AS u_size, min(u.lo) AS lo, max(u.hi) AS hi FROM a JOIN u ON u.lo <= a.hi AND a.lo <= u.hi GROUP BY ALL),
e AS (SELECT b.*, (SELECT count(*) FROM w WHERE w.lo <= b.hi AND b.lo <= w.hi) AS e_n FROM b)
SELECT number, b_n AS lower_files, CASE WHEN ok THEN u_n ELSE 1 END AS upper_files, ok AS expanded FROM (SELECT *, b_n > 0 AND u_size > file_size AND u_size + b_size < 90000 AND e_n = b_n AS ok FROM e)""",
)
def expand_inputs(spark, d):
    f = _spans(spark, d)
    return files.expand_inputs(f.filter("number % 2 = 0"), f.filter("number % 2 = 1"), 90000)


_SCORE = f"(SELECT level, CASE WHEN level = 0 THEN count(*) / 4 WHEN level < 6 THEN sum(file_size) / (10485760 * pow(10.0, level - 1)) END AS score FROM {_LEVELS} GROUP BY level)"


@register(
    "pick_compaction",
    f"""SELECT p.level, CASE WHEN p.score >= 1 THEN 'size' ELSE 'seek' END AS reason, CASE WHEN p.score >= 1 THEN (SELECT coalesce(min(number) FILTER (number > 40), min(number)) FROM {_LEVELS} f WHERE f.level = p.level)
ELSE (SELECT min_by(number, file_size) FROM {_LEVELS} f WHERE f.level = p.level) END AS number FROM {_SCORE} p WHERE score IS NOT NULL""",
)
def pick_compaction(spark, d):
    """What each level would be compacted for: its size if the score is 1 or more, then the first file behind the pointer (40); else seeks, then the file with the least left."""
    f = _levels(spark, d)
    scores = compaction.level_scores(f).filter("score is not null").select("level", "score")
    per = f.groupBy("level").agg(F.coalesce(F.min(F.when(c("number") > 40, c("number"))), F.min("number")).alias("next"), F.min_by("number", "file_size").alias("worn"))
    big = c("score") >= 1
    return scores.join(per, "level").select("level", F.when(big, "size").otherwise("seek").alias("reason"), F.when(big, c("next")).otherwise(c("worn")).alias("number"))


_TOUCH = f"(SELECT k, min_by(number, level * 1000 + number) AS number, count(*) AS n FROM (SELECT DISTINCT o_custkey AS k FROM orders) o JOIN {_SPANS} s ON o.k BETWEEN s.lo AND s.hi GROUP BY k)"


@register("seek_charges", f"SELECT s.number, (greatest(100, file_size // 16384) - (SELECT count(*) FROM {_TOUCH} t WHERE t.n > 1 AND t.number = s.number))::BIGINT AS \"left\" FROM {_SPANS} s")
def seek_charges(spark, d):
    return files.charge_seeks(_spans(spark, d), table(spark, d, "orders").select(c("o_custkey").alias("k")).distinct())


_STEPS = f"(SELECT user_id % 4 AS grp, user_id AS k, (SELECT coalesce(sum(file_size), 0) FROM {_SPANS} g WHERE g.hi < user_id) AS upto FROM (SELECT DISTINCT user_id FROM events))"


@register(
    "grandparent_split",
    f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY k) AS r FROM {_STEPS}),
f AS (SELECT grp, k, r, upto, 0::HUGEINT AS held, 0::BIGINT AS part FROM s WHERE r = 1 UNION ALL
SELECT s.grp, s.k, s.r, s.upto, CASE WHEN f.held + s.upto - f.upto > 3000 THEN 0 ELSE f.held + s.upto - f.upto END, f.part + CASE WHEN f.held + s.upto - f.upto > 3000 THEN 1 ELSE 0 END FROM f JOIN s ON s.grp = f.grp AND s.r = f.r + 1)
SELECT grp, k, part FROM f""",
)
def grandparent_split(spark, d):
    rows = table(spark, d, "events").select((c("user_id") % 4).alias("grp"), c("user_id").alias("k")).distinct()
    return compaction.cut_at_overlap(rows, _spans(spark, d), 3000)


# codecs
@register("unpack_tag", f"SELECT k, seq, op::TINYINT AS op FROM ({_LOG})")
def unpack_tag(spark, d):
    return _log(spark, d).select("k", codec.unpack_tag(codec.pack_tag(c("seq"), c("op"))).alias("t")).select("k", "t.seq", "t.op")


@register("fixed_decode", "SELECT event_id, printf('%08X', event_id) AS short, event_id AS a, event_id * 1000003 AS b FROM events")
def fixed_decode(spark, d):
    e, wide = table(spark, d, "events"), c("event_id") * 1000003
    short = codec.fixed32(c("event_id"))
    return e.select("event_id", short.alias("short"), codec.fixed_value(short).alias("a"), codec.fixed_value(codec.fixed64(wide)).alias("b"))


_WIDE = "(event_id * event_id * 104729)"
_SIZE = "CASE " + " ".join(f"WHEN n < {1 << 7 * s} THEN {s}" for s in range(1, 9)) + " ELSE 9 END"


@register("varint_bytes", f"SELECT n, list_aggregate(list_transform(range(s), lambda i: printf('%02X', ((n >> (7 * i)::INTEGER) & 127) + CASE WHEN i < s - 1 THEN 128 ELSE 0 END)), 'string_agg', '') AS bytes, n AS decoded FROM (SELECT n, {_SIZE} AS s FROM (SELECT {_WIDE}::BIGINT AS n FROM events))")
def varint_bytes(spark, d):
    out = table(spark, d, "events").select((c("event_id") * c("event_id") * 104729).alias("n")).withColumn("bytes", codec.varint(c("n")))
    return out.select("n", "bytes", codec.read_varint(c("bytes"))["value"].alias("decoded"))


@register("length_prefixed", "SELECT p_partkey, printf('%02X', strlen(p_name)) || hex(p_name) AS bytes, p_name AS decoded FROM part")
def length_prefixed(spark, d):
    out = table(spark, d, "part").select("p_partkey", codec.length_prefixed(c("p_name").cast("binary")).alias("bytes"))
    return out.select("p_partkey", "bytes", codec.read_length_prefixed(c("bytes")).cast("string").alias("decoded"))


_FF = "(repeat('FF', (p_partkey % 3)::INTEGER) || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE hex(p_name) END)"


@register("short_successor_bytes", f"SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN {_FF} ELSE repeat('FF', (p_partkey % 3)::INTEGER) || printf('%02X', ascii(p_name) + 1) END AS successor FROM part")
def short_successor_bytes(spark, d):
    key = F.concat(F.repeat(F.lit("FF"), (c("p_partkey") % 3).cast("int")), F.when(c("p_partkey") % 7 == 0, "").otherwise(F.hex("p_name")))
    return table(spark, d, "part").select("p_partkey", codec.short_successor_bytes(F.unhex(key)).alias("successor"))


_PAIRS = "(SELECT p_partkey, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS b FROM part)"
_LCP = "len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[1:i] = b[1:i]))"
_SEP = f"(SELECT p_partkey, a, CASE WHEN n >= least(length(a), length(b)) OR ascii(a[n + 1:n + 1]) + 1 >= ascii(b[n + 1:n + 1]) THEN a ELSE a[1:n] || chr(ascii(a[n + 1:n + 1]) + 1) END AS s FROM (SELECT *, {_LCP} AS n FROM {_PAIRS} WHERE a < b))"


@register("internal_separator", f"SELECT p_partkey, CASE WHEN length(s) < length(a) AND a < s THEN s ELSE a END AS key, CASE WHEN length(s) < length(a) AND a < s THEN {codec.SEEK_TAG} ELSE p_partkey * 256 + 1 END AS tag FROM {_SEP}")
def internal_separator(spark, d):
    order = Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")
    pairs = table(spark, d, "part").select("p_partkey", c("p_name").alias("a"), F.lead("p_name").over(order).alias("b")).filter("a < b")
    made = codec.internal_key(c("a"), codec.short_separator(c("a"), c("b")), codec.pack_tag(c("p_partkey"), F.lit(1)))
    return pairs.select("p_partkey", made.alias("x")).select("p_partkey", "x.key", "x.tag")


_BYTES = "list_transform(range(1, strlen(c_name) + 1), lambda i: ascii(c_name[i:i])::UBIGINT)"


@register(
    "crc32c",
    f"""SELECT c_custkey, crc, (((crc >> 15) | ((crc << 17) & 4294967295)) + 2726488792) % 4294967296 AS stored, crc AS back FROM (SELECT c_custkey, xor(list_reduce(list_prepend(4294967295::UBIGINT, {_BYTES}),
lambda h, b: xor({[*codec.CRC_TABLE]!r}[(xor(h, b) & 255)::BIGINT + 1]::UBIGINT, h >> 8)), 4294967295::UBIGINT)::BIGINT AS crc FROM customer)""",
)
def crc32c(spark, d):
    crc = table(spark, d, "customer").select("c_custkey", codec.crc32c(c("c_name").cast("binary")).alias("crc")).withColumn("stored", codec.masked(c("crc")))
    return crc.withColumn("back", codec.unmasked(c("stored")))


_M = 0xC6A4A793
_WORDS4 = "list_transform(range(0, strlen(c_name) // 4), lambda i: (ascii(c_name[4*i+1:4*i+1]) + 256 * ascii(c_name[4*i+2:4*i+2]) + 65536 * ascii(c_name[4*i+3:4*i+3]) + 16777216 * ascii(c_name[4*i+4:4*i+4]))::UBIGINT)"
_MIXED = f"list_reduce(list_prepend(xor(3164544308::UBIGINT, (strlen(c_name) * {_M} % 4294967296)::UBIGINT), {_WORDS4}), lambda h, w: xor((h + w) % 4294967296 * {_M} % 4294967296, ((h + w) % 4294967296 * {_M} % 4294967296) >> 16))"
_TAIL = "coalesce(list_sum(list_transform(range(0, strlen(c_name) % 4), lambda j: ascii(c_name[strlen(c_name) // 4 * 4 + j + 1:strlen(c_name) // 4 * 4 + j + 1]) * pow(256, j)::BIGINT)), 0)::UBIGINT"


@register("hash32", f"SELECT c_custkey, (CASE WHEN strlen(c_name) % 4 = 0 THEN h ELSE xor((h + t) % 4294967296 * {_M} % 4294967296, ((h + t) % 4294967296 * {_M} % 4294967296) >> 24) END)::BIGINT AS hash FROM (SELECT c_custkey, c_name, {_MIXED} AS h, {_TAIL} AS t FROM (SELECT c_custkey, c_name[1:18 - (c_custkey % 5)::INTEGER] AS c_name FROM customer))")
def hash32(spark, d):
    name = F.substring("c_name", F.lit(1), F.lit(18) - (c("c_custkey") % 5).cast("int"))
    return table(spark, d, "customer").select("c_custkey", codec.hash32(name.cast("binary"), 0xBC9F1D34).alias("hash"))


# relational, index and partitioning
@register("theta_join_range", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_name <> b.n_name")
def theta_join_range(spark, d):
    """No equality: a nested loop over a table of fixed size."""
    n = table(spark, d, "nation")
    a, b = n.select(c("n_nationkey").alias("a"), c("n_regionkey").alias("ar"), c("n_name").alias("an")), n.select(c("n_nationkey").alias("b"), c("n_regionkey").alias("br"), c("n_name").alias("bn"))
    return a.join(F.broadcast(b), (c("ar") < c("br")) & (c("an") != c("bn"))).select("a", "b")


@register("delete_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 5)")
def delete_join(spark, d):
    """What DELETE … JOIN leaves."""
    gone = table(spark, d, "customer").filter("c_nationkey = 5").select(c("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(gone, "o_custkey", "left_anti").select("o_orderkey")


@register("insert_values", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL VALUES (100, 'NEW', 1), (101, 'UNKNOWN', NULL)")
def insert_values(spark, d):
    """INSERT … VALUES, the second row with the columns' defaults."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = spark.createDataFrame([(100, "NEW", 1), (101, None, None)], n.schema)
    return n.unionByName(rows.withColumn("n_name", F.coalesce("n_name", F.lit("UNKNOWN"))))


@register("order_ordinal", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def order_ordinal(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_nationkey").limit(5)


@register("sample_rows", "SELECT o_orderkey FROM orders WHERE ('0x' || md5(o_orderkey::VARCHAR)[1:8])::BIGINT % 100 < 10")
def sample_rows(spark, d):
    """A tenth of the rows, by a hash of their key, so the same at every run."""
    return table(spark, d, "orders").select("o_orderkey").filter(index.hashed(c("o_orderkey")) % 100 < 10)


_GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: {0}[i:i + 2]))"


@register("ngram_search", f"SELECT p_partkey, round(len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q))), 6) AS similarity FROM (SELECT p_partkey, {_GRAMS.format('p_name')} AS g, {_GRAMS.format('w')} AS q FROM part, (SELECT min(p_name) AS w FROM part)) WHERE len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q))) >= 0.4")
def ngram_search(spark, d):
    """Names that share many trigrams with the first one."""
    part = table(spark, d, "part")
    return index.ngram_search(part, "p_partkey", "p_name", part.agg(F.min("p_name")).first()[0], 0.4).withColumn("similarity", F.round("similarity", 6))


_RING = "(SELECT n, v, ('0x' || md5('node' || n || '#' || v)[1:8])::BIGINT AS pos FROM range(8) a(n), range(16) b(v))"


@register("consistent_hash", f"SELECT o_orderkey, coalesce((SELECT min_by(n, pos) FROM {_RING} WHERE pos >= h), (SELECT min_by(n, pos) FROM {_RING})) AS node FROM (SELECT o_orderkey, ('0x' || md5(o_orderkey::VARCHAR)[1:8])::BIGINT AS h FROM orders)")
def consistent_hash(spark, d):
    """The first of 16 points of each of 8 nodes on the ring at or behind the key's."""
    return table(spark, d, "orders").select("o_orderkey", index.ring_node(c("o_orderkey"), 8, 16).alias("node"))
