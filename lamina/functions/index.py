"""Query-based indexes and statistics."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lamina.operators.steps import written


def pick(names: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.pmod(n, F.lit(len(names))).cast("int"))


def sql_pick(names: list[str], n: str) -> str:
    return "CASE " + n + f" % {len(names)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names)) + " END"


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct ``key, term``: duplicates go within the row, before any shuffle."""
    return docs.select(key, F.explode(F.array_distinct(F.split(text, " "))).alias("term"))


#: Terms whose frequencies are broadcast.
_HEAD = 200_000


def _head(frequency: DataFrame, head: int) -> int:
    """The least power of two that the frequencies of at most ``head`` terms reach."""
    bits = dict(frequency.groupBy(F.length(F.bin("df")).alias("bits")).agg(F.count("*").alias("n")).collect())  # 64 rows at most
    least = max(bits, default=0) + 1
    while least > 1 and sum(n for b, n in bits.items() if b >= least - 1) <= head:
        least -= 1
    return 1 << (least - 1)


def _able(docs: DataFrame, key: str, text: str, known: dict[bytes, int], least: int, n: int, top: int, digits: int) -> DataFrame:
    """``key, term, tf, df`` of the terms that may be among the ``top`` of their row, keys being unique; ``df`` is null if it isn't ``known``."""
    low, high, slack = math.log(n / max(least - 1, 1)) if n else 0.0, math.log(n) if n else 0.0, 2 * 10.0**-digits  # for rounding
    terms = docs.sparkSession.sparkContext.broadcast({t: (math.log(n / df), df) for t, df in known.items()})

    def pick(batches):
        of, rare = terms.value.get, (low, None)
        for batch in batches:
            at, out, tfs, dfs = [], [], [], []
            for i, value in enumerate(batch.column(1)):
                if (words := value.as_py()) is None:
                    continue
                counts = Counter(words.split(b" "))
                bounds = sorted([tf * of(t, rare)[0] for t, tf in counts.items()])
                bar = (bounds[-top] if len(bounds) >= top else 0.0) - slack
                for t, tf in counts.items():
                    if tf * high >= bar:
                        weight, df = of(t, rare)
                        if df is None or tf * weight >= bar:
                            at.append(i), out.append(t), tfs.append(tf), dfs.append(df)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.binary()), pa.array(tfs, pa.int64()), pa.array(dfs, pa.int64())], names=[key, "term", "tf", "df"])

    kinds = StructType([docs.schema[key], *(StructField(x, k) for x, k in (("term", BinaryType()), ("tf", LongType()), ("df", LongType())))])
    return docs.select(key, F.col(text).cast("binary")).mapInArrow(pick, kinds).withColumn("term", F.col("term").cast("string"))


def tfidf(docs: DataFrame, key: str, text: str, top: int, digits: int, head: int = _HEAD) -> DataFrame:
    """``key, term, weight``: the ``top`` terms of the largest rounded weight of each key, ties by term.

    The frequencies of the ``head`` most frequent terms, at most, come by broadcast. They bound those of the others, and so
    weights from both sides: only terms whose upper bound reaches the ``top``-th largest lower bound of their key, none else
    can be in the result, go on and meet their frequencies by shuffle.
    """
    docs = docs.select(key, text)
    n = docs.count()
    unique = docs.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    terms = postings(docs, key, text) if unique else docs.select(key, F.explode(F.split(text, " ")).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    frequency = written(terms.groupBy("term").agg(F.count("*").alias("df")), "frequency")
    least = _head(frequency, head)
    known, others = frequency.filter(F.col("df") >= least), frequency.filter(F.col("df") < least)
    weight = lambda df: F.round(F.col("tf") * F.log(F.lit(n) / df), digits)
    if unique:
        known = {bytes(t): df for t, df in known.select(F.col("term").cast("binary"), "df").collect()}  # at most ``head``
        able = _able(docs, key, text, known, least, n, top, digits)
    else:
        met = terms.join(F.broadcast(known), "term", "left")
        of_key = Window.partitionBy(key).orderBy(F.col("low").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        met = met.withColumn("low", weight(F.coalesce("df", F.lit(max(least - 1, 1))))).withColumn("bar", F.nth_value("low", top).over(of_key))
        able = met.filter(F.col("bar").isNull() | (weight(F.coalesce("df", F.lit(1))) >= F.col("bar"))).select(key, "term", "tf", "df")
    able = written(able, "able")
    met = able.filter("df IS NOT NULL").unionByName(able.filter("df IS NULL").drop("df").join(others, "term"))
    order = Window.partitionBy(key).orderBy(F.col("weight").desc(), "term")
    ranked = met.select(key, "term", weight(F.col("df")).alias("weight")).withColumn("r", F.row_number().over(order))
    return ranked.filter(F.col("r") <= top).drop("r")


def nearest(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The ``k`` vectors of the largest dot product with the one query vector (one row, broadcast)."""
    q = query.select(F.col("embedding").cast("array<double>").alias("q")).limit(1)
    product = F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), "q", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return vectors.crossJoin(F.broadcast(q)).select("vec_id", product.alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(k)


def equi_width(df: DataFrame, column: str, buckets: int) -> DataFrame:
    bounds = df.agg(F.min(column).alias("lo"), ((F.max(column) - F.min(column)) / buckets).alias("w"))
    bucket = F.least(F.floor((F.col(column) - F.col("lo")) / F.col("w")), F.lit(buckets - 1)).cast("long")
    return df.crossJoin(F.broadcast(bounds)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))  # one row


def equi_depth(df: DataFrame, column: str, tie: str, buckets: int) -> DataFrame:
    """Exact equal-count buckets. A range partitioning orders the rows; partition counts turn local ranks into global ones, so no
    task sees more than its range."""
    ranged = df.select(column, tie).repartitionByRange(F.col(column), F.col(tie))
    ordered = written(ranged.withColumn("part", F.spark_partition_id()), "ranges")  # both uses below see the same partitions
    ranked = ordered.withColumn("local", F.row_number().over(Window.partitionBy("part").orderBy(column, tie)) - 1)
    sizes = ordered.groupBy("part").agg(F.count("*").alias("size"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("part", F.coalesce(F.sum("size").over(running), F.lit(0)).alias("before"))
    n = df.agg(F.count("*").alias("total"))
    placed = ranked.join(F.broadcast(starts), "part").crossJoin(F.broadcast(n))
    at, small = F.col("before") + F.col("local"), F.floor(F.col("total") / buckets)
    extra = F.col("total") % buckets
    bucket = F.when(at < extra * (small + 1), F.floor(at / (small + 1))).otherwise(extra + F.floor((at - extra * (small + 1)) / small))
    return placed.groupBy((bucket + 1).cast("int").alias("bucket")).agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("n"))


def end_biased(df: DataFrame, column: str, top: int) -> DataFrame:
    """The most frequent values with their counts, and the mean count of all others under a null value."""
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    best = counts.orderBy(F.col("n").desc(), "v").limit(top)
    rest = counts.join(F.broadcast(best.select("v")), "v", "left_anti").agg(F.round(F.avg("n"), 6).alias("n"))  # top rows
    return best.select("v", F.col("n").cast("double").alias("n")).unionByName(rest.select(F.lit(None).cast("bigint").alias("v"), "n"))


def join_size(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """Rows that an equality join is expected to have: the product of both sizes over the larger number of distinct keys."""
    x = left.agg(F.count("*").alias("n"), F.countDistinct(a).alias("dn"))
    y = right.agg(F.count("*").alias("m"), F.countDistinct(b).alias("dm"))
    return x.crossJoin(y).select((F.col("n") * F.col("m") / F.greatest("dn", "dm")).cast("long").alias("estimate"))  # one row each


def zone_map(df: DataFrame, zone: Column, column: str) -> DataFrame:
    return df.groupBy(zone.alias("zone")).agg(F.min(column).alias("low"), F.max(column).alias("high"))


#: A key's hashes set one bit each in the words of one block of the filter. A filter of at most so many blocks (64 bytes each) is broadcast.
_HASHES, _BITS_A_KEY, _BROADCAST_BLOCKS = 7, 10, 1 << 18
_BLOCK = 64 * _HASHES


def bloom_bits(keys: int) -> int:
    """Bits for so many keys, a whole number of blocks; 7 hashes and 10 bits a key let about 1 % of absent keys pass."""
    return _BLOCK * max(1, -(-keys * _BITS_A_KEY // _BLOCK))


def _block(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(bits // _BLOCK))


def _bit(column: str, i: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column), F.lit(i)), F.lit(64)).cast("int")


def bloom_filter(df: DataFrame, column: str, bits: int) -> DataFrame:
    """Blocks of a bloom filter, ``block`` and its words: at most ``bits`` / 448 rows, whatever the input."""
    one = F.lit(1).cast("long")
    return df.groupBy(_block(column, bits).alias("block")).agg(*(F.bit_or(F.call_function("shiftleft", one, _bit(column, i))).alias(f"word{i}") for i in range(_HASHES)))


def may_contain(df: DataFrame, column: str, bloom: DataFrame, bits: int, most: int = _BROADCAST_BLOCKS) -> DataFrame:
    """Adds ``maybe``: false only if the value is certainly not in the filter. Each row meets its one block of the filter: a filter
    of at most ``most`` blocks comes by broadcast; else blocks of very many rows, at most 1000 by their definition, do, and the others by shuffle."""
    words = bloom.select(F.col("block").alias("_block"), *(F.col(f"word{i}").alias(f"_word{i}") for i in range(_HASHES)))
    placed = df.withColumn("_block", _block(column, bits))
    if bits // _BLOCK <= most:
        met = placed.join(F.broadcast(words), "_block", "left")
    else:
        words = written(words, "bloom")
        n = written(placed.groupBy("_block").agg(F.count("*").alias("n")), "block-rows")
        least = max(10_000, (n.agg(F.sum("n")).head()[0] or 0) // 1000)
        hot = F.broadcast(n.filter(F.col("n") >= least).select("_block"))
        aside = placed.join(hot, "_block", "left_semi").join(F.broadcast(words.join(hot, "_block", "left_semi")), "_block", "left")
        met = placed.join(hot, "_block", "left_anti").join(words, "_block", "left").unionByName(aside)
    hit = F.lit(True)
    for i in range(_HASHES):
        word = F.coalesce(f"_word{i}", F.lit(0))  # no key is in a block that isn't there
        hit = hit & (F.call_function("shiftright", word, _bit(column, i)).bitwiseAND(F.lit(1)) == 1)
    return met.select(*(F.col(f"`{x}`") for x in df.columns), hit.alias("maybe"))


def hashed(value: Column) -> Column:
    """A number below 2^32, the same on every engine: the first half of the MD5's first half."""
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def ring_node(key: Column, nodes: int, points: int) -> Column:
    """Node of a key on a hash ring of ``nodes`` with ``points`` each: the ring is a sorted constant array."""
    ring = sorted((int(hashlib.md5(f"node{n}#{v}".encode()).hexdigest()[:8], 16), n) for n in range(nodes) for v in range(points))
    places, owners = F.lit([p for p, _ in ring]), F.lit([n for _, n in ring])
    below = lambda h: F.size(F.filter(places, lambda p: p < h))
    at = F.transform(F.array(hashed(key)), below)[0]  # the key is hashed once
    return F.get(owners, at % len(ring)).cast("long")


def _grams(text: Column, n: int) -> Column:
    last = F.length(text) - n + 1
    every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def ngram_search(df: DataFrame, key: str, text: str, wanted: str, least: float, n: int = 3) -> DataFrame:
    """``key, similarity`` of the texts that share at least that part of their n-grams with ``wanted``."""
    own, query = _grams(F.col(text), n), F.lit(sorted({wanted[i : i + n] for i in range(len(wanted) - n + 1)}))
    counted = df.select(key, F.size(own).alias("a"), F.size(F.array_intersect(own, query)).alias("both"))
    similarity = F.col("both") / (F.col("a") + F.size(query) - F.col("both"))
    return counted.select(key, similarity.alias("similarity")).filter(F.col("similarity") >= least)
