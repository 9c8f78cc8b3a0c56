"""MinHash near-duplicate detection with odd sketches.

1. One pass over the texts gives each document the size and a 128-bit hash of its shingle set, ``BANDS`` band keys of
   its MinHash samples, and its odd sketch: a parity bitmap into which every sample is folded. Documents of equal
   sets are one class from here on, with the smallest id as node.
2. Nodes that share a band key form a bucket. Each bucket compares its members with its hub (the smallest node) only. The
   XOR population count of two odd sketches estimates how many samples differ and screens the pair; what passes
   is confirmed on the full sets.
3. Links become components. A bucket whose other members now lie in one component is done: copies by the thousand cost
   as many pairs as there are copies. What is left of the other buckets is compared in blocks of at most about
   ``BLOCK`` nodes, every pair of blocks once: the sketches (72 bytes a node) tell which nodes of a pair of blocks have
   a possible partner in another component, only those nodes' full sets are fetched, and only a forest of the
   confirmed links leaves a block. So no link between nodes of a bucket is lost.

The number of bands follows from the wanted similarity s: two sets that are so similar share no bucket with probability
(1 - s^5)^bands < 1e-7 (28 bands for 0.85, 41 for 0.8), and the screen lets pass what is five standard deviations below.

Scale: bands are narrow rows (16 bytes); sets move only for confirmation, only of nodes in screened pairs (found
by a broadcast if they are at most ``BROADCAST_NODES``, counted, else by a shuffle); a hub of very many pairs is
spread over salts, an open bucket of any size over blocks. Rows find their class by a join that splits off classes of very many
copies; texts without words take no part in it. All steps are tables in the shared folder, deleted at the end.

Defined cases. A null text has no words. Documents without words have no shingles, are linked with nothing and kept.
Rows that repeat a doc_id count as one document, linked by any of its texts. A null id is no node: its row gets
the component of equal texts if there is one, else null. An empty table gives an empty result; other columns of the
input are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import HOT_KEYS, HOT_ROWS, id_text, materialise, tidy
from lamina.llm.components import components

ROWS, SKETCH_WORDS, MISSED = 5, 8, 1e-7
SHINGLE, PERCENT = 3, 85
BLOCK, BROADCAST_NODES, PAIRS_PER_SALT = 512, 250_000, 2_000
_BITS = 64 * SKETCH_WORDS
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ONE = np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as asked for."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.append(_ONE, np.full(size - 1, b, np.uint64)), dtype=np.uint64) for b in (self.BASE, pow(self.BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_powers = _Powers()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word: polynomial over its bytes, by differences of one running sum."""
    raw = np.frombuffer(text.encode("utf-8").translate(_LOWER), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    space = np.concatenate([[True], _SPACE[raw], [True]])
    start, end = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    up, down = _powers.upto(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + _ONE) * up[:-1], dtype=np.uint64)])
        return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; of fewer words, one hash of them all."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = min(size, len(words))
    with np.errstate(over="ignore"):
        runs = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            runs = _mix(runs * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k])
    return np.unique(runs)


def n_bands(percent: int) -> int:
    """Bands that sets of that similarity share one of, but with probability ``MISSED``."""
    return ceil(log(MISSED) / log(1 - min(percent / 100, 0.99) ** ROWS))


@cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(971)
    return rng.integers(0, 1 << 63, (n, 1), np.uint64) * np.uint64(2) + _ONE, rng.integers(0, 1 << 63, (n, 1), np.uint64)


def samples(own: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash samples, 32 bits each."""
    a, b = _functions(n)
    out = np.full(n, 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(own), 512):
            np.minimum(out, ((a * own[k : k + 512] + b) >> np.uint64(32)).min(axis=1), out=out)
    return out


def bands(sample: np.ndarray) -> np.ndarray:
    rows = sample.reshape(-1, ROWS)
    with np.errstate(over="ignore"):
        key = np.arange(len(rows), dtype=np.uint64) + _ONE
        for column in rows.T:
            key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + column)
    return key.view(np.int64)


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Parity bitmap: every sample flips the bit that it and its number hash to."""
    with np.errstate(over="ignore"):
        place = _mix(sample * np.uint64(256) + np.arange(len(sample), dtype=np.uint64)) % np.uint64(_BITS)
    flips = np.bincount(place.astype(np.int64), minlength=_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(">i8").astype(np.int64)


def sketch_similarity(apart: int, n: int) -> float:
    """Similarity that the number of differing sketch bits speaks for, for ``n`` samples."""
    return 1.0 + _BITS / (4.0 * n) * float(np.log(max(1e-9, 1.0 - 2.0 * apart / _BITS)))


def _most_apart(percent: int) -> int:
    """Differing bits that pairs of the wanted similarity stay under, five standard deviations aside."""
    p, n = 1 - percent / 100, n_bands(percent) * ROWS
    differing = n * p + 5 * (n * p * (1 - p)) ** 0.5
    bits = _BITS / 2 * (1 - (1 - 2 / _BITS) ** (2 * differing))
    return int(bits + 10)


def signatures(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_hash, bands, sketch`` per row."""
    kind, n_samples = docs.schema["doc_id"].dataType.simpleString(), n_bands(percent) * ROWS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hashes, keys, sketches = [], [], [], []
            for t in batch.column("text"):
                own = shingles(t.as_py(), size)
                n.append(len(own))
                if not len(own):
                    hashes.append(None), keys.append(None), sketches.append(None)
                    continue
                with np.errstate(over="ignore"):
                    hashes.append(np.array([_mix(own).sum(), _mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64).tobytes())
                sample = samples(own, n_samples)
                keys.append(bands(sample))
                sketches.append(odd_sketch(sample))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n_shingles", "set_hash", "bands", "sketch"],
            )

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(run, f"doc_id {kind}, text_key bigint, n_shingles bigint, set_hash binary, bands array<bigint>, sketch array<bigint>")


def _linked(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * common >= percent * (a + b - common)


def _set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Written table ``node, own``: the packed shingle set of each wanted node (of each of its texts, if its id repeats)."""
    known = materialise(nodes.select("node", "text_key").join(wanted, "node", "left_semi").withColumnRenamed("node", "doc_id"), "wanted")
    if known.count() <= BROADCAST_NODES:
        known = F.broadcast(known)
    texts = docs.withColumn("text_key", F.xxhash64("text")).join(known, ["doc_id", "text_key"], "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [shingles(t.as_py(), size).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(packed, pa.binary())], ["node", "text_key", "own"])

    sets = texts.select("doc_id", "text_key", "text").mapInArrow(run, "node bigint, text_key bigint, own binary")
    return materialise(sets.dropDuplicates(["node", "text_key"]).select("node", "own"), "sets")


def hub_links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` (a: hub) that the sketches let pass and the full sets confirm."""
    sketch = lambda side: nodes.select(F.col("node").alias(side), F.col("sketch").alias(f"{side}_sketch"))
    apart = sum(F.bit_count(F.get("a_sketch", F.lit(k)).bitwiseXOR(F.get("b_sketch", F.lit(k)))) for k in range(SKETCH_WORDS))
    screened = pairs.join(sketch("a"), "a").join(sketch("b"), "b").filter(apart <= _most_apart(percent)).select("a", "b")
    screened = materialise(screened, "screened")
    sets = full_sets(docs, nodes, screened.select(F.explode(F.array("a", "b")).alias("node")).distinct(), size)
    salts = screened.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / PAIRS_PER_SALT).cast("int").alias("salts"))
    salted = screened.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    members = salted.join(sets.withColumnRenamed("node", "b"), "b").select("a", "b", "salt", "own")
    hubs = salts.join(sets.select(F.col("node").alias("a"), F.col("own").alias("hub_own")), "a")
    hubs = hubs.select("a", "hub_own", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for hub, own in zip(batch.column("hub_own"), batch.column("own"), strict=True):
                x, y = _set(hub), _set(own)
                good.append(bool(_linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = members.join(hubs, ["a", "salt"]).select("a", "b", "hub_own", "own")
    return materialise(both.mapInArrow(confirm, "a bigint, b bigint"), "links")


def block_links(nodes: list[int], labels: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest of the links between nodes of different labels: enough to join what they join."""
    root = {x: x for x in labels}
    if len(root) < 2:
        return []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    owner, column = owner[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        held = np.zeros((len(sets), width), np.float32)
        held[owner[a:b], column[a:b] - start] = 1.0
        common += held @ held.T
    kinds = np.array(labels)
    linked = _linked(common.astype(np.int64), size[:, None], size[None, :], percent) & (kinds[:, None] != kinds[None, :])
    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = find(labels[i]), find(labels[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((nodes[i], nodes[j]))
    return out


def near_rows(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches are similar enough to be looked at."""
    apart = np.zeros((len(a), len(b)), np.uint16)
    for k in range(SKETCH_WORDS):
        apart += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return apart <= _most_apart(percent)


def possible(side: np.ndarray, labels: np.ndarray, sketches: np.ndarray, percent: int) -> np.ndarray:
    """Which nodes of a pair of blocks (sides 0 and 1; only 0 for a block by itself) may be linked with one of another label."""
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == side.max())
    near = near_rows(sketches[one], sketches[two], percent) & (labels[one][:, None] != labels[two][None, :])
    out = np.zeros(len(side), bool)
    out[one[near.any(axis=1)]] = True
    out[two[near.any(axis=0)]] = True
    return out


_GROUP = ("bucket", "lo", "hi")


def _by_group(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[list]]]:
    """The groups of rows that follow each other, as key and lists of columns."""
    last, held = None, [[] for _ in columns]
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in _GROUP), strict=True))
        values = [batch.column(c) if c == "own" else batch.column(c).to_pylist() for c in columns]
        for k, key in enumerate(keys):
            if key != last:
                if held[0]:
                    yield last, held
                last, held = key, [[] for _ in columns]
            for h, v in zip(held, values, strict=True):
                h.append(v[k])
    if held[0]:
        yield last, held


def open_links(live: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``a, b`` between different labels inside each bucket of ``live`` (bucket, node, label), each pair of blocks once."""
    half = BLOCK // 2
    count = F.when(F.col("n") <= BLOCK, 1).otherwise(F.ceil(F.col("n") / half)).cast("int")
    sizes = live.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", count.alias("blocks"))
    placed = live.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.join(nodes.select("node", "sketch"), "node").select("bucket", "node", "label", "sketch", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keyed = placed.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "label", "sketch")
    keyed = keyed.repartition(*_GROUP).sortWithinPartitions(*_GROUP)

    def screen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (block, node, label, sketch) in _by_group(batches, ("block", "node", "label", "sketch")):
            side = (np.array(block) != key[1]).astype(np.int8)
            if side.max() == 0 and key[1] != key[2]:
                continue
            node, label = np.array(node, np.int64), np.array(label, np.int64)
            keep = possible(side, label, np.array(sketch, np.int64).view(np.uint64).reshape(len(node), SKETCH_WORDS), percent)
            n = int(keep.sum())
            if n:
                same = [pa.array(np.full(n, x, t)) for x, t in zip(key, (np.int64, np.int32, np.int32), strict=True)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(node[keep]), pa.array(label[keep])], [*_GROUP, "node", "label"])

    wanted = materialise(keyed.mapInArrow(screen, "bucket bigint, lo int, hi int, node bigint, label bigint"), "open")
    sets = full_sets(docs, nodes, wanted.select("node").distinct(), size)
    held = wanted.join(sets, "node").repartition(*_GROUP).sortWithinPartitions(*_GROUP)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (node, label, own) in _by_group(batches, ("node", "label", "own")):
            if found := block_links(node, label, [_set(x) for x in own], percent):
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return materialise(held.mapInArrow(run, "a bigint, b bigint"), "open-links")


def _of_class(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Rows with the columns of their class (``set_hash``, ``n_shingles``; ``n``: its rows). Classes of very many rows are at most
    ``HOT_KEYS``, as each has that share of all rows, and are joined by broadcast, the others by shuffle."""
    keys = ["set_hash", "n_shingles"]
    least = max(HOT_ROWS, total // HOT_KEYS)
    named = rows.filter("set_hash is not null")
    hot, cold = classes.filter(F.col("n") >= least), classes.filter(F.col("n") < least)
    out = named.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    out = out.unionByName(named.join(F.broadcast(hot), keys))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in classes.dtypes if c not in keys]
    return out.unionByName(rows.filter("set_hash is null").select(*rows.columns, *nothing))


@tidy("near")
def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per input row."""
    docs = id_text(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = materialise(signatures(docs, size, percent), "signatures")
    rows = signed.select("doc_id", "n_shingles", "set_hash")
    known = signed.filter("n_shingles > 0 and doc_id is not null")
    first = F.min_by(F.struct("text_key", "bands", "sketch"), F.col("doc_id"))
    nodes = known.groupBy("set_hash", "n_shingles").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"), first.alias("first"))
    nodes = materialise(nodes.select("set_hash", "n_shingles", "n", "node", "first.*"), "nodes")
    classes = nodes.select("set_hash", "n_shingles", "n", "node")
    several = known.groupBy("doc_id").agg(F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi")).filter("lo <> hi").select("doc_id")
    several = materialise(several, "several")
    total = signed.count()
    repeated = None
    if not several.isEmpty():
        repeated = _of_class(rows.filter("doc_id is not null").join(several, "doc_id", "left_semi"), classes, total)
        repeated = repeated.filter("node is not null").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()

    member = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = member.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    shared = materialise(member.join(buckets, "bucket").filter("node <> hub"), "buckets")
    pairs = shared.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    found = hub_links(pairs, nodes, docs, size, percent)
    if repeated is not None:
        found = materialise(found.unionByName(repeated), "found")
    roots = components(found)

    labelled = shared.filter("n > 2").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("label"))
    unsettled = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    live = materialise(labelled.join(unsettled, "bucket", "left_semi"), "live")
    if not live.isEmpty():
        roots = components(found.unionByName(open_links(live, nodes, docs, size, percent)))

    classes = classes.join(roots, "node", "left").select("set_hash", "n_shingles", "n", F.coalesce("root", "node").alias("component"))
    joined = _of_class(rows, materialise(classes, "classes"), total)
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
