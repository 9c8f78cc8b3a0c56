"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

Words are hashed into ``BUCKETS`` rows. Every bucket has a sparse ternary index vector (fixed by the bucket's
number); its context vector is the sum of the index vectors of the words around it, over all documents. A
document is the pooled context vectors of its words (mean, spread and norm) with how many words it has and
how many of them differ. A network of one hidden layer learns ``quality`` from that; its logits are divided by
the temperature that suits held-back training rows best.

Scale. The context vectors are summed over the whole corpus: each task adds up one fixed table (``BUCKETS`` x
``DIM`` floats, 4 MB), the tables are summed slice by slice in a stream, and only the fixed-size result comes to
the driver. The network is fitted on at most ``MAX_LABELS`` labelled rows (chosen by hash), the one bounded sample
here. Scoring maps over partitions without a shuffle.

Labels come only from rows whose crc32 of the id is not divisible by ``FOLDS``; labels, language, source and id are
never inputs of a score.

Defined cases. A null text counts as empty; an empty text pools to zeros and gets the network's score for that. A
document with several labels takes the largest; null labels are left out. With no labels, or one class
only, every score is the share of label 1 (0.5 without labels). A null id is never held out. Repeated rows are
scored one by one; an empty table gives an empty result; other columns of the input are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import id_text, materialise
from lamina.llm.pretokens import TwoGenerations, chunks

BUCKETS, DIM, NONZERO, WINDOW, SLICES = 1 << 14, 64, 4, 2, 32
MAX_LABELS = 20_000
FOLDS, THRESHOLD, HIDDEN = 5, 0.3, 32
_PIECE, _DIGIT = re.compile(r"[^\W_]+|[^\w\s]+|_+"), re.compile(r"\d")
_SHAPES = 64  # buckets kept for the shapes of words


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


class Buckets:
    """Texts to bucket numbers; every word gives the bucket of each of its pieces and one for its shape."""

    def __init__(self):
        self.memo = TwoGenerations(200_000)

    def _miss(self, word: str) -> bytes:
        found = self.memo.old.get(word)
        if found is None:
            shape = word[:1].isupper() + 2 * (word.isupper() and len(word) > 1)
            if word.isalpha():
                pieces = (word,)
            elif word[:-1].isalpha() and not word[-1].isalnum() and word[-1] != "_":
                pieces, shape = (word[:-1], word[-1]), shape + 24
            else:
                pieces, shape = _PIECE.findall(word), shape + 4 * bool(_DIGIT.search(word)) + 8 * (not word[-1].isalnum()) + 16 * (not word.isalnum())
            numbers = [shape, *(zlib.crc32(p.lower().encode()) % (BUCKETS - _SHAPES) + _SHAPES for p in pieces)]
            found = b"".join([n.to_bytes(2, "little") for n in numbers])
        self.memo.put(word, found)
        return found

    def of(self, text: str) -> np.ndarray:
        get, miss = self.memo.young.get, self._miss
        return np.frombuffer(b"".join([get(w) or miss(w) for w in text.split()]), "<u2")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's few nonzero entries."""
    rng = np.random.default_rng(20240501)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def context_vectors(docs: DataFrame) -> np.ndarray:
    """``BUCKETS`` x ``DIM``: unit vectors, from the co-occurrences of all documents."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        buckets, total = Buckets(), np.zeros(BUCKETS * DIM)
        apart = np.full(WINDOW, BUCKETS, np.uint16)  # between texts
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts, 1 << 20):
                ids = np.concatenate([x for t in texts[a:b] for x in (buckets.of(t), apart)]).astype(np.int32)
                ids = ids[(ids >= _SHAPES)]
                hit, by = [], []
                for step in range(1, WINDOW + 1):
                    left, right = ids[:-step], ids[step:]
                    pair, n = np.unique((left * np.int32(BUCKETS) + right)[(left < BUCKETS) & (right < BUCKETS)], return_counts=True)
                    left, right = pair // BUCKETS, pair % BUCKETS
                    for own, other in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            hit.append(own * DIM + places[other, k])
                            by.append(n * signs[other, k])
                total += np.bincount(np.concatenate(hit), np.concatenate(by), BUCKETS * DIM)
        for k, part in enumerate(np.split(total.astype(np.float32), SLICES)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "part"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("slice").to_pylist(), batch.column("part"), strict=True):
                sums[k] = sums.get(k, 0.0) + np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s.astype(np.float32).tobytes()], pa.binary())], ["slice", "part"])

    schema = "slice int, part binary"
    summed = docs.select("text").mapInArrow(partial, schema).repartition(SLICES, "slice").mapInArrow(add, schema)
    total = np.zeros((SLICES, BUCKETS * DIM // SLICES), np.float32)
    for row in summed.collect():  # at most SLICES rows, 4 MB in all
        total[row["slice"]] = np.frombuffer(row["part"], np.float32)
    total = total.reshape(BUCKETS, DIM)
    total -= total.mean(axis=0)
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-6)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of one document: mean, spread and norm of its words' vectors, length, share of different ones, shares of shapes."""
    if not len(ids):
        return np.zeros(2 * DIM + 3 + 32, np.float32)
    count = np.bincount(ids, minlength=BUCKETS)
    seen = np.flatnonzero(count)
    share = (count[seen] / len(ids)).astype(np.float32)
    own = vectors[seen]
    mean = share @ own
    spread = np.sqrt(np.maximum(share @ (own * own) - mean * mean, 0.0))
    return np.concatenate([mean, spread, [np.linalg.norm(mean), np.log1p(len(ids)), len(seen) / len(ids)], count[:32] / len(ids)]).astype(np.float32)


@dataclass
class Network:
    """Standardise, hidden layer, logit, temperature."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.shift) / self.scale).clip(-8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1.0 / (1.0 + np.exp(-(self.logits(x) / self.temperature).clip(-50, 50)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 7) -> Network:
    """Adam on four fifths of the rows; the temperature on the rest."""
    share = float(y.mean()) if len(y) else 0.5
    shift = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    scale = (x.std(axis=0) if len(x) else np.ones(x.shape[1])) + 1e-4
    rng = np.random.default_rng(seed)
    net = Network(shift, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    if share in (0.0, 1.0) or len(y) < 10:
        net.constant = share
        return net
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    rest, train = order[:cut], order[cut:]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    step = 0
    for epoch in range(epochs):
        rate = 0.005 * (1 - epoch / epochs) + 1e-4
        rng.shuffle(train)
        for k in range(0, len(train), 128):
            rows = train[k : k + 128]
            z = ((x[rows] - shift) / scale).clip(-8, 8)
            h = np.tanh(z @ net.w1 + net.b1)
            p = 1 / (1 + np.exp(-(h @ net.w2 + net.b2).clip(-50, 50)))
            d = (p - y[rows]) / len(rows)
            dh = np.outer(d, net.w2) * (1 - h * h)
            grads = [z.T @ dh + 1e-4 * net.w1, dh.sum(axis=0), h.T @ d + 1e-4 * net.w2, np.array([d.sum()])]
            step += 1
            moves = []
            for (m, v), g in zip(state, grads, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                moves.append(rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
            net.w1 -= moves[0]
            net.b1 -= moves[1]
            net.w2 -= moves[2]
            net.b2 -= float(moves[3][0])
    logits, truth = net.logits(x[rest]), y[rest]
    loss = lambda t: np.mean(np.logaddexp(0, -np.where(truth > 0, 1, -1) * logits / t))
    net.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
    return net


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = MAX_LABELS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``."""
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    vectors = context_vectors(rows)

    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).dropna()
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels), "quality-labels")

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            packed = [pool(buckets.of(t.as_py()), vectors).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(packed, pa.binary())], ["label", "x"])

    # at most max_labels rows of 16 bytes: that bound is what makes the broadcast safe
    one_each = rows.join(F.broadcast(chosen), "doc_id").select("label", "text")
    sample = one_each.mapInArrow(features, "label int, x binary").limit(2 * max_labels).collect()
    sample.sort(key=lambda r: (r["x"], r["label"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in sample], np.float64).reshape(len(sample), 2 * DIM + 3 + 32)
    net = fit(x, np.array([r["label"] > 0 for r in sample], np.float64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            x = np.array([pool(buckets.of(t.as_py()), vectors) for t in batch.column("text")]).reshape(batch.num_rows, 2 * DIM + 3 + 32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(net.score(x), pa.float64())], ["doc_id", "held_out", "score"])

    scored = rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
