"""The store's smoke sequence, the golden example, and properties against a dictionary of versions."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lamina.functions import codec, index
from lamina.operators import changelog as cl
from lamina.operators import compaction, files, mvcc, txn, vlog
from lamina.operators.engine import Store

LOG = "k string, seq long, op tinyint, v string"
GOLDEN = [("a", 1, 1, "1"), ("b", 2, 1, "2"), ("a", 3, 1, "3"), ("a", 4, 0, None)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_smoke(spark):
    log = spark.createDataFrame([("key", 1, 1, "value")], LOG)
    assert rows(mvcc.get(log, "key").select("v")) == [("value",)]
    log = log.unionByName(spark.createDataFrame([("key", 2, 0, None)], LOG))
    assert rows(mvcc.get(log, "key")) == []


@pytest.mark.parametrize(("snapshot", "expected"), [(None, [("b", "2")]), (3, [("a", "3"), ("b", "2")]), (2, [("a", "1"), ("b", "2")]), (0, [])])
def test_golden(spark, snapshot, expected):
    assert rows(mvcc.as_of(spark.createDataFrame(GOLDEN, LOG), snapshot).select("k", "v")) == expected


def test_empty_value_is_no_delete_and_bytes_are_unsigned(spark):
    log = spark.createDataFrame([(b"", 1, 1, ""), (b"a", 2, 1, "x"), (b"a\x00", 3, 1, "y"), (b"\x7f", 4, 1, None), (b"\x80", 5, 1, "z"), (b"q", 6, 0, None)], "k binary, seq long, op tinyint, v string")
    assert [bytes(r.k) for r in mvcc.range_scan(log, bytearray(b""), bytearray(b"\xff")).collect()] == [b"", b"a", b"a\x00", b"\x7f", b"\x80"]


def test_compaction_keeps_every_later_snapshot(spark):
    rng = random.Random(11)
    data = [(f"k{rng.randrange(12)}", i, int(rng.random() > 0.3), str(i)) for i in range(1, 300)]
    log = spark.createDataFrame(data, LOG).cache()
    kept = compaction.survivors(log, 150).cache()
    for s in (150, 151, 200, 299):
        assert rows(mvcc.as_of(kept, s)) == rows(mvcc.as_of(log, s))
    last, expected = {}, []
    for k, seq, op, v in sorted(data, key=lambda r: (r[0], -r[1])):
        newer, last[k] = last.get(k, 1 << 60), seq
        if newer <= 150 or (op == 0 and seq <= 150):
            continue
        expected.append((k, seq, op, v))
    assert rows(kept.select("k", "seq", "op", "v")) == sorted(expected)


def test_tombstone_stays_over_deeper_files(spark):
    log = spark.createDataFrame([(1, 1, 0, 0.0), (9, 2, 0, 0.0)], "k long, seq long, op tinyint, v double")
    deeper = spark.createDataFrame([(0, 3), (2, 4)], "lo long, hi long")
    assert rows(compaction.survivors(log, 5, deeper).select("k")) == [(1,)]


def test_batch_numbers_follow_positions(spark):
    log = spark.createDataFrame([], "k bigint, seq bigint, op tinyint, v double")
    out = cl.apply_batch(log, [(1, 5, 1.0), (0, 5, None)], 7)
    assert rows(out.select("seq", "op")) == [(7, 1), (8, 0)]
    assert rows(mvcc.as_of(out)) == []


def test_find_file(spark):
    f = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, 35)], "number bigint, hi bigint")
    keys = spark.createDataFrame([(k,) for k in (0, 10, 11, 20, 21, 35, 36)], "k bigint")
    assert rows(files.find_file(keys, f, 8).na.fill(-1)) == [(0, 1), (10, 1), (11, 2), (20, 2), (21, 4), (35, 4), (36, -1)]


def test_codecs(spark):
    n = spark.createDataFrame([(x,) for x in (0, 127, 128, 16383, 16384, 2**62)], "n bigint")
    assert [r[0] for r in n.select(codec.varint_length(F.col("n"))).collect()] == [1, 1, 2, 2, 3, 9]
    pairs = spark.createDataFrame([("abcd", "abzz"), ("ab", "abc"), ("a1", "a2"), ("", "x")], "a string, b string")
    assert [r[0] for r in pairs.select(codec.short_separator(F.col("a"), F.col("b"))).collect()] == ["abd", "ab", "a1", ""]
    rec = spark.createDataFrame([(0, 0, 32761), (0, 1, 70000), (0, 2, 0), (1, 0, 32755), (1, 1, 5)], "log int, rec int, size bigint")
    fragments = codec.log_fragments(rec, "log", "rec", "size")
    assert rows(codec.join_fragments(fragments, "log", "rec")) == [(0, 0, 32761), (0, 1, 70000), (0, 2, 0), (1, 0, 32755), (1, 1, 5)]
    assert [(r.kind, r.bytes, r.block) for r in fragments.filter("log = 1").orderBy("rec").collect()] == [("FULL", 32755, 0), ("FULL", 5, 1)]


def test_threshold_value_is_separated(spark):
    df = spark.createDataFrame([(1, "x" * 1024), (2, "x" * 1023), (3, "")], "k long, v string")
    out = vlog.separate(df, F.lit(0))
    assert rows(out.select("k", "separated")) == [(1, True), (2, False), (3, False)]
    assert rows(vlog.dereference(out, vlog.value_log(df, F.lit(0)))) == [(1, "x" * 1024), (2, "x" * 1023), (3, "")]


def test_store_is_reopened(spark, tmp_path):
    """Put, get, delete, get, with flushes and new openings between them."""
    kinds, path = "k string, seq long, op tinyint, v string", f"file://{tmp_path}/store"
    change = lambda *rows: spark.createDataFrame(rows, kinds)
    store = Store(spark, path, kinds)
    assert rows(store.get("key")) == []
    store.write(change(("key", 1, 1, "value"), ("other", 2, 1, "x")))
    assert rows(Store(spark, path, kinds).get("key").select("v")) == [("value",)]
    store.flush()
    store.flush()
    store = Store(spark, path, kinds)
    assert store.live == [(1, 0)] and rows(store.get("key").select("v")) == [("value",)]
    store.write(change(("key", 3, 0, None)))
    assert rows(store.get("key")) == [] and rows(store.get("key", 2).select("v")) == [("value",)]
    store.flush()
    store = Store(spark, path, kinds)
    assert rows(store.get("key")) == [] and rows(store.view().select("k")) == [("other",)] and len(store.live) == 2
    assert store._log().count() == 0


def test_byte_codecs(spark):
    one = spark.createDataFrame([(b"123456789",), (b"",), (b"\xff\xff",), (b"\xffa",)], "b binary")
    got = one.select(codec.crc32c(F.col("b")).alias("crc"), codec.short_successor_bytes(F.col("b")).alias("next"), codec.read_length_prefixed(codec.length_prefixed(F.col("b"))).alias("back")).collect()
    assert got[0].crc == 0xE3069283 and got[1].crc == 0
    assert [r.next for r in got] == ["32", "", "FFFF", "FF62"] and [bytes(r.back) for r in got] == [b"123456789", b"", b"\xff\xff", b"\xffa"]
    cut = spark.createDataFrame([("80",), ("05AA",), ("",)], "d string")
    assert [r[0] for r in cut.select(codec.read_length_prefixed(F.col("d"))).collect()] == [None, None, None]


def test_timestamp_order_as_a_fold(spark):
    rng = random.Random(4)
    ops = [(rng.randrange(9), i, rng.randrange(3), rng.random() < 0.5) for i in range(300)]
    marks, expected = {}, []
    for t, at, obj, writes in ops:
        read, write = marks.get(obj, (-1, -1))
        aborts = write > t or (writes and read > t)
        if not aborts:
            marks[obj] = (read, t) if writes else (max(read, t), write)
        expected.append((at, aborts))
    df = spark.createDataFrame(ops, "txn long, at long, obj long, writes boolean")
    assert rows(txn.timestamp_order(df).select("at", "aborts")) == expected


@pytest.mark.parametrize("most", [1 << 18, 0])  # by broadcast, by shuffle
def test_bloom_filter_is_met_by_block(spark, most):
    """A row meets one block and never the whole filter; nulls, repeated and very frequent keys, blocks without keys."""
    keys = spark.range(30_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    bits = index.bloom_bits(30_000)
    bloom = index.bloom_filter(keys.unionByName(keys), "k", bits)
    assert bloom.count() <= bits // 448
    often = spark.range(12_000).select((F.col("id") % 1 + 7).alias("k"), F.lit(True).alias("member"))
    both = keys.withColumn("member", F.lit(True)).unionByName(often).unionByName(spark.range(1, 30_001).select((-F.col("id")).alias("k"), F.lit(False).alias("member")))
    tested = index.may_contain(both, "k", bloom, bits, most)
    assert "NestedLoop" not in tested._jdf.queryExecution().optimizedPlan().toString() + tested._jdf.queryExecution().sparkPlan().toString()
    got = {(r.member, r.maybe): r.n for r in tested.groupBy("member", "maybe").agg(F.count("*").alias("n")).collect()}
    assert tested.columns == ["k", "member", "maybe"] and got.pop((True, True)) == 42_000
    assert 90 <= got.pop((False, True)) <= 600 and list(got) == [(False, False)]
    few = index.may_contain(both, "k", index.bloom_filter(keys.filter("k = 5"), "k", bits), bits, most)
    assert rows(few.filter("maybe and member").select("k").distinct()) == [(5,)]


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("head", [0, 2, 10, 200_000])
def test_tfidf_bounds_lose_no_term(spark, repeated, head):
    """Against counting by hand, whatever the number of terms of known frequency; null and empty texts, a null key, ties, repeated keys."""
    rng = random.Random(5)
    data = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.choice([1, 2, 5, 40, 200])))) for i in range(60)]
    data += [(60, None), (61, ""), (62, " a  a "), (None, "w1 w2 w3 w4 w4")] + ([(0, "w1 new w1"), (61, "w2"), (None, "w4"), (60, None)] if repeated else [])
    counts, df = {}, Counter()
    for k, text in data:
        counts.setdefault(k, Counter()).update([] if text is None else text.split(" "))
    for x in counts.values():
        df.update(x.keys())
    weights = {k: sorted((-round(tf * math.log(len(data) / df[t]), 6), t) for t, tf in x.items())[:3] for k, x in counts.items()}
    got = index.tfidf(spark.createDataFrame(data, "id long, text string"), "id", "text", 3, 6, head).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((k, t, -w) for k, x in weights.items() for w, t in x), key=key)
    assert [tuple(r)[:2] for r in sorted(map(tuple, got), key=key)] == [x[:2] for x in want]
    assert [r[2] for r in sorted(map(tuple, got), key=key)] == pytest.approx([x[2] for x in want], abs=1.1e-6)


def test_tfidf_hands_on_few_terms(spark, monkeypatch):
    """Of all pairs of text and term only those that may be in the result are written or joined."""
    from lamina.plans import catalog

    folder, sizes, write = "/root/testdata/sf0.001", {}, index.written
    monkeypatch.setattr(index, "written", lambda df, what: (out := write(df, what), sizes.update({what: out.count()}))[0])
    assert catalog.queries()["tfidf"](spark, folder).count() > 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    del sizes["frequency"]  # one row a term
    assert sizes and 4 * max(sizes.values()) <= index.postings(docs, "doc_id", "text").count()
