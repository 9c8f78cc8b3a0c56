"""Index, statistics, value-log and transaction queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import index
from lamina.operators import txn, vlog
from lamina.plans.catalog import register
from lamina.sources.tables import table

c = F.col


# large values
_KV = "SELECT doc_id AS k, strlen(text) >= 1024 AS separated, CASE WHEN strlen(text) < 1024 THEN text END AS v, CASE WHEN strlen(text) >= 1024 THEN doc_id % 8 END AS file_number, CASE WHEN strlen(text) >= 1024 THEN strlen(text) END AS size FROM documents"


@register("kv_separate", _KV)
def kv_separate(spark, d):
    docs = table(spark, d, "documents").select(c("doc_id").alias("k"), c("text").alias("v"))
    return vlog.separate(docs, c("k") % 8).select("k", "separated", "v", "file_number", "size")


@register("kv_deref", "SELECT doc_id AS k, md5(text) AS digest FROM documents")
def kv_deref(spark, d):
    docs = table(spark, d, "documents").select(c("doc_id").alias("k"), c("text").alias("v"))
    return vlog.dereference(vlog.separate(docs, c("k") % 8), vlog.value_log(docs, c("k") % 8)).select("k", F.md5("v").alias("digest"))


@register("vlog_discardable", "SELECT doc_id % 8 AS file_number, round(sum(CASE WHEN doc_id % 3 = 0 THEN strlen(text) ELSE 0 END) / sum(strlen(text)), 6) AS discardable FROM documents WHERE strlen(text) >= 1024 GROUP BY 1")
def vlog_discardable(spark, d):
    docs = table(spark, d, "documents").select(c("doc_id").alias("k"), c("text").alias("v"))
    return vlog.discardable(vlog.value_log(docs, c("k") % 8), c("k") % 3 == 0).withColumn("discardable", F.round("discardable", 6))


_STATES = ", ".join(f"('{s}', '{e}', '{t}')" for (s, e), t in vlog.TRANSITIONS.items())


@register("vfile_state", f"SELECT e.event_id, t.next_state FROM (SELECT event_id, {index.sql_pick(vlog.STATES, 'user_id')} AS state, {index.sql_pick(vlog.EVENTS, 'event_id')} AS event FROM events) e LEFT JOIN (VALUES {_STATES}) t(state, event, next_state) ON t.state = e.state AND t.event = e.event")
def vfile_state(spark, d):
    e = table(spark, d, "events").select("event_id", index.pick(vlog.STATES, c("user_id")).alias("state"), index.pick(vlog.EVENTS, c("event_id")).alias("event"))
    return e.select("event_id", vlog.next_state(c("state"), c("event")).alias("next_state"))


# index and statistics
@register("inverted_index", "SELECT term, count(*) AS df, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS term FROM documents) GROUP BY term")
def inverted_index(spark, d):
    postings = index.postings(table(spark, d, "documents"), "doc_id", "text")
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@register(
    "tfidf",
    """WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS term FROM documents) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT doc_id, term, round(tf * ln(n / df), 6) AS weight FROM t JOIN f USING (term), n)
SELECT doc_id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS r FROM w) WHERE r <= 3""",
)
def tfidf(spark, d):
    return index.tfidf(table(spark, d, "documents"), "doc_id", "text", 3, 6)


@register(
    "vector_topk",
    "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q) , 4) AS score FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) ORDER BY list_dot_product(embedding::DOUBLE[], q) DESC, vec_id LIMIT 10",
)
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return index.nearest(e, e.filter("vec_id = 0"), 10).withColumn("score", F.round("score", 4))


_BOUNDS = "(SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 10 AS w FROM orders)"


@register("hist_equiwidth", f"SELECT least(floor((o_totalprice - lo) / w), 9)::BIGINT AS bucket, count(*) AS n FROM orders, {_BOUNDS} GROUP BY 1")
def hist_equiwidth(spark, d):
    return index.equi_width(table(spark, d, "orders"), "o_totalprice", 10)


@register("hist_equidepth", "SELECT bucket, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n FROM (SELECT o_totalprice, (ntile(10) OVER (ORDER BY o_totalprice, o_orderkey))::INTEGER AS bucket FROM orders) GROUP BY bucket")
def hist_equidepth(spark, d):
    return index.equi_depth(table(spark, d, "orders"), "o_totalprice", "o_orderkey", 10)


@register("hist_endbiased", "WITH f AS (SELECT o_custkey AS v, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT v, n FROM f ORDER BY n DESC, v LIMIT 5) SELECT v, n::DOUBLE AS n FROM t UNION ALL SELECT NULL, round(avg(n), 6) FROM f WHERE v NOT IN (SELECT v FROM t)")
def hist_endbiased(spark, d):
    return index.end_biased(table(spark, d, "orders"), "o_custkey", 5)


@register("join_size_estimate", "SELECT ((SELECT count(*) FROM orders) * (SELECT count(*) FROM customer) / greatest((SELECT count(DISTINCT o_custkey) FROM orders), (SELECT count(DISTINCT c_custkey) FROM customer)))::BIGINT AS estimate")
def join_size_estimate(spark, d):
    return index.join_size(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey")


@register("zone_map_prune", "SELECT zone, min(o_totalprice) AS low, max(o_totalprice) AS high, max(o_totalprice) >= 490000 AS must_read FROM (SELECT o_orderkey // 500 AS zone, o_totalprice FROM orders) GROUP BY zone")
def zone_map_prune(spark, d):
    zones = index.zone_map(table(spark, d, "orders"), F.floor(c("o_orderkey") / 500), "o_totalprice")
    return zones.withColumn("must_read", c("high") >= 490000)


@register("bloom_filter", "SELECT count(*) AS members, 0::BIGINT AS missed, true AS few_false FROM orders")
def bloom_filter(spark, d):
    """Every key is found; of as many absent keys at most 2 % pass (10 bits a key: about 1 %)."""
    o = table(spark, d, "orders").select("o_orderkey")
    bits = index.bloom_bits(o.count())
    bloom = index.bloom_filter(o, "o_orderkey", bits)
    absent = o.select((-c("o_orderkey") - 1).alias("o_orderkey"))
    both = o.withColumn("member", F.lit(True)).unionByName(absent.withColumn("member", F.lit(False)))
    tested = index.may_contain(both, "o_orderkey", bloom, bits)
    passed = F.count_if(~c("member") & c("maybe")) <= 0.02 * F.count_if(~c("member"))
    return tested.agg(F.count_if("member").alias("members"), F.count_if(c("member") & ~c("maybe")).alias("missed"), passed.alias("few_false"))


# transactions: a user's events are a transaction's operations; 16 events in a row meet on one object
_OPS = "(SELECT user_id AS txn, event_id AS at, event_id // 16 AS obj, event_type IN ('purchase', 'signup') AS writes FROM events)"


def _ops(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(c("user_id").alias("txn"), c("event_id").alias("at"), F.floor(c("event_id") / 16).alias("obj"), c("event_type").isin("purchase", "signup").alias("writes"))


@register("conflict_pairs", f"SELECT a.obj, a.at AS first, b.at AS second, CASE WHEN a.writes AND b.writes THEN 'WW' WHEN a.writes THEN 'WR' ELSE 'RW' END AS kind FROM {_OPS} a JOIN {_OPS} b ON a.obj = b.obj AND a.at < b.at AND a.txn <> b.txn AND (a.writes OR b.writes)")
def conflict_pairs(spark, d):
    return txn.conflicts(_ops(spark, d)).select("obj", "first", "second", "kind")


@register("precedence_edges", f"SELECT DISTINCT a.txn AS src, b.txn AS dst FROM {_OPS} a JOIN {_OPS} b ON a.obj = b.obj AND a.at < b.at AND a.txn <> b.txn AND (a.writes OR b.writes)")
def precedence_edges(spark, d):
    return txn.precedence(_ops(spark, d))


# the events of every eighth user among 32 in a row are one transaction, on four objects
_SHORT = "(SELECT event_id // 32 * 8 + user_id % 8 AS txn, event_id AS at, event_id // 32 * 4 + event_id % 4 AS obj, event_type IN ('purchase', 'signup') AS writes FROM events)"


def _short(spark, d) -> DataFrame:
    epoch = F.floor(c("event_id") / 32)
    e = table(spark, d, "events")
    return e.select((epoch * 8 + c("user_id") % 8).alias("txn"), c("event_id").alias("at"), (epoch * 4 + c("event_id") % 4).alias("obj"), c("event_type").isin("purchase", "signup").alias("writes"))


_CYCLES = "WITH RECURSIVE e AS ({0}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT DISTINCT src AS txn FROM r WHERE src = dst"


@register("precedence_cycle", _CYCLES.format(f"SELECT DISTINCT a.txn AS src, b.txn AS dst FROM {_SHORT} a JOIN {_SHORT} b ON a.obj = b.obj AND a.at < b.at AND a.txn <> b.txn AND (a.writes OR b.writes)"))
def precedence_cycle(spark, d):
    return txn.on_cycles(txn.precedence(_short(spark, d)))


_WAITS = f"(SELECT DISTINCT o.txn AS requester, h.txn AS holder FROM {_SHORT} o JOIN (SELECT obj, min_by(txn, x.at) AS txn, min(x.at) AS since FROM {_SHORT} x WHERE writes GROUP BY obj) h ON o.obj = h.obj AND o.at > h.since AND o.txn <> h.txn WHERE o.writes)"


@register("deadlocked", _CYCLES.format(f"SELECT requester AS src, holder AS dst FROM {_WAITS}"))
def deadlocked(spark, d):
    """Transactions on a cycle of the wait-for graph; the first writer of an object holds its lock to the end."""
    return txn.on_cycles(txn.waits(_short(spark, d)).select(c("requester").alias("src"), c("holder").alias("dst")))


@register("lock_prevention", f"SELECT requester, holder, CASE WHEN requester < holder THEN 'wait' ELSE 'die' END AS wait_die, CASE WHEN requester < holder THEN 'wound' ELSE 'wait' END AS wound_wait FROM {_WAITS}")
def lock_prevention(spark, d):
    return txn.prevention(txn.waits(_short(spark, d)))


_TX = "(SELECT user_id AS txn, event_id // 500 AS epoch, min(event_id) AS begin_at, max(event_id) AS commit_at FROM events GROUP BY 1, 2)"


@register("ww_conflicts", f"SELECT a.txn AS loser, b.txn AS winner, a.epoch FROM {_TX} a JOIN {_TX} b ON a.epoch = b.epoch AND a.txn % 10 = b.txn % 10 AND a.txn <> b.txn AND a.begin_at < b.commit_at AND b.begin_at < a.commit_at AND a.commit_at > b.commit_at")
def ww_conflicts(spark, d):
    """The object a transaction writes is txn % 10; of two that overlap, the later committer loses."""
    e = table(spark, d, "events")
    t = e.groupBy(c("user_id").alias("txn"), F.floor(c("event_id") / 500).alias("epoch")).agg(F.min("event_id").alias("begin_at"), F.max("event_id").alias("commit_at"))
    return txn.write_write(t.withColumn("obj", F.struct("epoch", c("txn") % 10))).select("loser", "winner", c("obj.epoch").alias("epoch"))


@register("occ_validate", f"WITH o AS {_OPS}, w AS (SELECT DISTINCT txn, obj FROM o WHERE writes), r AS (SELECT DISTINCT txn, obj FROM o WHERE NOT writes), t AS (SELECT DISTINCT txn FROM o) SELECT t.txn, NOT EXISTS (SELECT 1 FROM r JOIN w ON r.obj = w.obj WHERE r.txn = t.txn AND w.txn < t.txn AND w.txn >= t.txn - 2) AS valid FROM t")
def occ_validate(spark, d):
    """A transaction is valid if the two before it wrote nothing that it read."""
    return txn.backward_validation(_ops(spark, d), 2)


_SETS = f"o AS {_OPS}, w AS (SELECT DISTINCT txn, obj FROM o WHERE writes), r AS (SELECT DISTINCT txn, obj FROM o WHERE NOT writes), t AS (SELECT DISTINCT txn FROM o)"


@register("occ_forward", f"WITH {_SETS} SELECT t.txn, NOT EXISTS (SELECT 1 FROM w JOIN r ON r.obj = w.obj WHERE w.txn = t.txn AND r.txn > t.txn AND r.txn <= t.txn + 2) AS valid FROM t")
def occ_forward(spark, d):
    """A transaction is valid if the two behind it, still active, read nothing that it writes."""
    return txn.validation(_ops(spark, d), ~c("writes"), c("writes"), lambda own, other: other.between(own + 1, own + 2))


@register("occ_write_write", f"WITH {_SETS} SELECT t.txn, NOT EXISTS (SELECT 1 FROM w a JOIN w b ON a.obj = b.obj WHERE a.txn = t.txn AND b.txn < t.txn AND b.txn >= t.txn - 2) AS valid FROM t")
def occ_write_write(spark, d):
    return txn.validation(_ops(spark, d), c("writes"), c("writes"), lambda own, other: other.between(own - 2, own - 1))


@register("write_skew", f"WITH {_SETS} SELECT a.txn AS a, b.txn AS b FROM t a JOIN t b ON b.txn = a.txn + 1 WHERE EXISTS (SELECT 1 FROM r JOIN w ON r.obj = w.obj WHERE r.txn = a.txn AND w.txn = b.txn) AND EXISTS (SELECT 1 FROM r JOIN w ON r.obj = w.obj WHERE r.txn = b.txn AND w.txn = a.txn) AND NOT EXISTS (SELECT 1 FROM w x JOIN w y ON x.obj = y.obj WHERE x.txn = a.txn AND y.txn = b.txn)")
def write_skew(spark, d):
    """Of two concurrent transactions (neighbours in number) each reads what the other writes, and they write nothing in common."""
    return txn.write_skew(_ops(spark, d), 1)


@register("first_writer_wins", f"WITH f AS (SELECT obj, txn, min(x.at) AS at FROM {_OPS} x WHERE writes GROUP BY 1, 2) SELECT obj, txn AS loser, (SELECT min_by(g.txn, g.at) FROM f g WHERE g.obj = f.obj) AS winner FROM f WHERE txn <> (SELECT min_by(g.txn, g.at) FROM f g WHERE g.obj = f.obj)")
def first_writer_wins(spark, d):
    return txn.first_writer(_ops(spark, d))


@register(
    "to_write_check",
    f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY o.at) AS r FROM {_OPS} o),
f AS (SELECT obj, r, s.at, txn, false AS aborts, CASE WHEN writes THEN -1 ELSE txn END AS rts, CASE WHEN writes THEN txn ELSE -1 END AS wts FROM s WHERE r = 1
UNION ALL SELECT s.obj, s.r, s.at, s.txn, f.wts > s.txn OR (s.writes AND f.rts > s.txn),
CASE WHEN NOT s.writes AND f.wts <= s.txn THEN greatest(f.rts, s.txn) ELSE f.rts END,
CASE WHEN s.writes AND f.rts <= s.txn AND f.wts <= s.txn THEN s.txn ELSE f.wts END FROM f JOIN s ON s.obj = f.obj AND s.r = f.r + 1)
SELECT f.at, txn, obj, aborts FROM f""",
)
def to_write_check(spark, d):
    return txn.timestamp_order(_ops(spark, d))


_RECORDS = "(SELECT event_id AS lsn, user_id AS txn, event_type AS kind FROM events)"


@register("aries_losers", f"SELECT txn FROM {_RECORDS} GROUP BY txn HAVING max(lsn) FILTER (kind = 'signup') > coalesce(max(lsn) FILTER (kind = 'purchase'), -1)")
def aries_losers(spark, d):
    """Transactions whose last begin (signup) no commit (purchase) follows."""
    return txn.losers(_records(spark, d), c("kind") == "signup", c("kind") == "purchase")


_SINCE = f"(SELECT lsn // 100 AS page, lsn, kind FROM {_RECORDS})"


@register(
    "aries_recovery",
    f"""WITH flushed AS (SELECT page, max(lsn) AS at FROM {_SINCE} WHERE kind = 'view' GROUP BY page),
dirty AS (SELECT p.page, min(p.lsn) AS rec_lsn FROM {_SINCE} p LEFT JOIN flushed f USING (page) WHERE p.kind <> 'view' AND p.lsn > coalesce(f.at, -1) GROUP BY p.page),
undo AS (SELECT r.lsn FROM {_RECORDS} r JOIN (SELECT txn, max(lsn) FILTER (kind = 'signup') AS began, max(lsn) FILTER (kind = 'purchase') AS done FROM {_RECORDS} GROUP BY txn) t USING (txn) WHERE t.began > coalesce(t.done, -1) AND r.lsn >= t.began AND r.kind IN ('click', 'error'))
SELECT (SELECT count(*) FROM dirty) AS dirty_pages, (SELECT min(rec_lsn) FROM dirty) AS redo_from, (SELECT count(*) FROM undo) AS undone, (SELECT max(lsn) FROM undo) AS undo_from""",
)
def aries_recovery(spark, d):
    """Dirty pages by their first change after the last flush (view), where redo begins, and the losers' changes to undo."""
    log = _records(spark, d).withColumn("page", F.floor(c("lsn") / 100))
    return txn.recovery(log, c("kind") == "view", c("kind") == "signup", c("kind") == "purchase", c("kind").isin("click", "error"))


def _records(spark, d) -> DataFrame:
    return table(spark, d, "events").select(c("event_id").alias("lsn"), c("user_id").alias("txn"), c("event_type").alias("kind"))


@register("log_suffix", f"SELECT lsn, txn FROM {_RECORDS} WHERE lsn > (SELECT max(lsn) FROM {_RECORDS} WHERE kind = 'error' AND txn < 5)")
def log_suffix(spark, d):
    return txn.suffix(_records(spark, d), (c("kind") == "error") & (c("txn") < 5)).select("lsn", "txn")
