"""Benchmark decontamination by latent semantic retrieval.

Every document is cut into cells of ``CELL`` words; a passage is two neighbouring cells. Terms are the words of the
benchmark, weighted by inverse cell frequency, which no term loses wholly but one in all cells. A randomised decomposition
of the term covariance of all cells (one pass: the sketch G W of G = A'A with a thin random W, then Nystroem) gives ``RANK``
latent directions; benchmark items enter G with the weight of the corpus, so that the directions tell items apart. A
passage is a candidate for the items its latent vector has a cosine of ``COSINE`` or more with. Candidates around which
too few of the item's words stand are dropped at once, the others are checked on the words: the longest common
subsequence of the item and a stretch of twice its length in the cells around must cover ``COMMON`` of the item, or
``COMMON_WITH_ANSWER`` if the item's last ``ANSWER`` words, its answer, stand there side by side too. Pairs that the latent
search doesn't settle are then looked for by counting words (``Exact``): every stretch that may pass the check on the
words is checked, so recall hangs on no cosine, rank or weight.

Scale. The texts are read once and written as numbers of benchmark words. Both corpus passes map over that table
and add up fixed-size arrays (terms x 1, terms x ``RANK`` + ``OVER``), summed in a tree, so the driver receives one
array of a size that the benchmark sets. The benchmark is the query set: it is read in blocks of ``BLOCK`` items,
each with its own directions, against all rows.

Defined cases. Null or empty texts have no cells and no row. Null or empty items match nothing; items of fewer than
``MIN_ITEM`` words match only as a whole, their words side by side. An empty benchmark or document table gives an empty result. A row per document id and item
(repeated rows: the best match); other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import id_text, materialise, tidy

CELL, RANK, OVER = 24, 128, 16
COSINE, COMMON, COMMON_WITH_ANSWER, ANSWER, MIN_ITEM = 0.4, 0.7, 0.5, 5, 5
BLOCK, MERGERS = 512, 16
_ITEM_WEIGHT = 1.0
#: For the choice of the words that the exact search counts: how much more often words come where their like stand, the cost
#: of a check in words read; and the occurrences held at once. They don't change what is found.
_BURSTS, _CHECK_COST, _PAIRS = 4, 5000.0, 1 << 22
_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_RESULT = "doc_id {}, item_id {}, cosine double, common double, answer boolean"


def words(text: str) -> list[bytes]:
    """Lower-cased words; what is no letter or digit of ASCII separates, other characters are letters."""
    return text.encode("utf-8").translate(_WORD_BYTES).split()


def encode(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, ids``: the vocabulary's number of every word (-1: not in it) as packed 32-bit integers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            packed = [np.array([get(w, -1) for w in words(t.as_py())], np.int32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "ids"])

    return docs.mapInArrow(run, f"doc_id {kind}, ids binary")


def _slices(batch: pa.RecordBatch, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch: first row, behind last, all their ids, and where each row's ids start."""
    ids = batch.column("ids")
    sizes = [len(x.as_buffer()) // 4 for x in ids]
    first = total = 0
    for k in range(len(sizes) + 1):
        if k == len(sizes) or (total and total + sizes[k] > most):
            if k > first:
                at = np.concatenate([[0], np.cumsum(sizes[first:k])]).astype(np.int64)
                yield first, k, np.frombuffer(b"".join(x.as_buffer() for x in ids[first:k]), np.int32), at
            first, total = k, 0
        if k < len(sizes):
            total += sizes[k]


def cells(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each word, and the first cell of each row (one more at the end)."""
    size = np.diff(at)
    first = np.concatenate([[0], np.cumsum(-(-size // CELL))])
    row = np.repeat(np.arange(len(size)), size)
    return first[row] + (np.arange(len(ids)) - at[row]) // CELL, first


def _sum_arrays(encoded: DataFrame, shape: tuple[int, ...], add: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Sum over all slices of what ``add(total, ids, at)`` adds to a fixed array: in each task, then in a tree of streams that take ``MERGERS`` tasks' arrays each."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for _, _, ids, at in _slices(batch):
                add(total, ids, at)
        yield _one(total)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for part in batch.column("part"):
                total += np.frombuffer(part.as_buffer()).reshape(shape)
        yield _one(total)

    def _one(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    schema = "part binary"
    merged = encoded.select("ids").mapInArrow(partial, schema)
    tasks = encoded.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // MERGERS)
        merged = merged.repartition(tasks).mapInArrow(merge, schema)
    rows = merged.collect()  # one row, none if there are no partitions
    return np.frombuffer(rows[0]["part"]).reshape(shape) if rows else np.zeros(shape)


def _padded(ids: np.ndarray, at: np.ndarray, n_terms: int) -> np.ndarray:
    """Cells x ``CELL``: the words' numbers, ``n_terms`` for what is none of the terms."""
    cell, first = cells(ids, at)
    out = np.full((first[-1], CELL), n_terms, np.int32)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out[cell, (np.arange(len(ids)) - at[row]) % CELL] = np.where(ids < 0, n_terms, ids)
    return out


def _cell_sums(rows: np.ndarray, padded: np.ndarray) -> np.ndarray:
    """Sum of the words' ``rows`` (one more at the end, of zeros) by cell."""
    total = rows[padded[:, 0]]
    for k in range(1, CELL):
        total += rows[padded[:, k]]
    return total


def _with_zeros(rows: np.ndarray) -> np.ndarray:
    return np.vstack([rows, np.zeros((1, rows.shape[1]), rows.dtype)])


def directions(encoded: DataFrame, items: list[np.ndarray], n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted latent projection, ``n_terms`` x ``RANK``: a cell's latent vector is the sum of its words' rows; and the share of the cells that hold each term."""

    def count(total: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        cell, first = cells(ids, at)
        known = ids >= 0
        pairs = np.unique(cell[known] * np.int64(n_terms) + ids[known])
        total[:n_terms] += np.bincount(pairs % n_terms, minlength=n_terms)
        total[n_terms] += first[-1]

    counted = _sum_arrays(encoded, (n_terms + 1,), count)
    n = max(counted[n_terms], 1.0)
    weight = np.log((1.0 + n) / (1.0 + counted[:n_terms]))
    rng = np.random.default_rng(31)
    width = min(RANK + OVER, n_terms)
    thin = np.linalg.qr(rng.normal(size=(n_terms, width)))[0]
    weighted = _with_zeros((weight[:, None] * thin).astype(np.float32))

    def sketch(total: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        padded = _padded(ids, at, n_terms)
        z, flat = _cell_sums(weighted, padded), padded.ravel()
        order = np.argsort(flat, kind="stable")
        order = order[: len(flat) - int(np.count_nonzero(flat == n_terms))]
        if not len(order):
            return
        terms, first = np.unique(flat[order], return_index=True)
        of = order // CELL
        for t, a, b in zip(terms.tolist(), first.tolist(), [*first[1:].tolist(), len(of)], strict=True):
            total[t, :width] += weight[t] * z[of[a:b]].sum(axis=0)
        total[0, width] += float((weight[flat[order]] ** 2).sum())

    summed = _sum_arrays(encoded, (n_terms, width + 1), sketch)
    g, energy = summed[:, :width].copy(), max(summed[0, width], 1e-9)
    own = np.zeros((len(items), n_terms))
    for row, item in zip(own, items, strict=True):
        np.add.at(row, item, weight[item])
    scale = _ITEM_WEIGHT * energy / max(float((own**2).sum()), 1e-9)
    g += scale * (own.T @ (own @ thin))
    core = thin.T @ g
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values[-1] * 1e-10
    root = g @ (vectors[:, good] / np.sqrt(values[good])) if good.any() else np.zeros((n_terms, 1))
    left = np.linalg.svd(root, full_matrices=False)[0][:, :RANK]
    return (weight[:, None] * left).astype(np.float32), counted[:n_terms] / n


def common_length(masks: dict[int, int], size: int, other: list[int]) -> int:
    """Longest common subsequence, bit-parallel; ``masks`` has the places of each word in the item."""
    return _common(size, [masks[w] for w in other if w in masks])


def _common(size: int, places: list[int]) -> int:
    full = (1 << size) - 1
    v = full
    for m in places:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _stands_in(answer: list[int], other: list[int]) -> bool:
    n = len(answer)
    return any(other[k : k + n] == answer for k in range(len(other) - n + 1))


def _compact_share(masks: dict[int, int], size: int, window: list[int]) -> float:
    """Share of the item that is common with a stretch of at most twice its length."""
    best = 0
    places = [masks.get(w, 0) for w in window]
    for k in range(0, len(window), 2 * size):
        near = places[k : k + 4 * size]  # holds the stretches that start in the first half
        telling = [m for m in near if m]
        if len(telling) <= best or (most := _common(size, telling)) <= best or most < COMMON_WITH_ANSWER * size:
            continue
        for j in range(min(2 * size, len(near))):
            if near[j]:
                best = max(best, _common(size, [m for m in near[j : j + 2 * size] if m]))
                if best == most:
                    break
    return best / size


def _masks(item: list[int]) -> dict[int, int]:
    places: dict[int, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    return places


class Exact:
    """All (row, item) pairs whose texts share enough words in order, whatever the corpus.

    A stretch that has ``COMMON`` of an item lacks at most the rest of its words; so of any r of the item's words it has r
    less that many. The r rarest are counted, r chosen for the least work; every stretch with enough of them is checked.
    Below ``COMMON`` the answer must stand in the text, which is looked up by itself.
    """

    def __init__(self, items: list[np.ndarray], shares: np.ndarray) -> None:
        self.items = [i.tolist() for i in items]
        self.short = np.array([len(i) < MIN_ITEM for i in items])
        self.size = np.array([len(i) for i in items])
        self.masks = [_masks(i) for i in self.items]
        self.reach = (2 * -(-int(self.size.max()) // CELL) + 2) * CELL
        pairs, self.need = [], np.zeros(len(items), np.int64)
        for q, item in enumerate(items):
            if not self.short[q]:
                chosen, self.need[q] = self._rarest(item, shares)
                pairs += [(w, q) for w in chosen]
        pairs.sort()
        self.owner = np.array([q for _, q in pairs], np.int64)
        self.count = np.bincount([w for w, _ in pairs], minlength=len(shares))
        self.start = np.cumsum(self.count) - self.count
        self.answers: dict[bytes, list[int]] = {}
        for q, item in enumerate(items):
            self.answers.setdefault(item[-ANSWER:].astype(np.int32).tobytes(), []).append(q)
        ends = [np.frombuffer(a, np.int32) for a in self.answers]
        self.hashes = {n: np.array([self._hash(a, np.array([n - 1]), n)[0] for a in ends if len(a) == n]) for n in {len(a) for a in ends}}
        self.ends = np.zeros(len(shares), bool)
        self.ends[[i[-1] for i in self.items]] = True

    @staticmethod
    def _rarest(item: np.ndarray, shares: np.ndarray) -> tuple[set[int], int]:
        """The words of an item that are counted, and how many of their occurrences a stretch must hold."""
        size = len(item)
        lacks = size - next(k for k in range(size + 1) if k / size >= COMMON)
        order = item[np.argsort(shares[item], kind="stable")].tolist()
        best, rate = None, 0.0
        for r, w in enumerate(order, 1):
            rate += 0.0 if w in order[: r - 1] else float(shares[w]) / CELL
            if r > lacks:
                k, mean = r - lacks, max(_BURSTS * 2 * size * rate, 1e-9)
                chance = 1.0 if k <= mean else float(np.exp(k - mean - k * np.log(k / mean)))
                if best is None or rate + _CHECK_COST * chance < best[0]:
                    best = rate + _CHECK_COST * chance, r, k
        return set(order[: best[1]]), best[2]

    @staticmethod
    def _hash(ids: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
        """Of the ``n`` words up to each place."""
        h = np.zeros(len(last), np.uint64)
        for k in range(n - 1, -1, -1):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[last - k].astype(np.uint64)
        return h

    def _stretches(self, ids: np.ndarray, at: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int, int, int]]:
        """Row, item, first and last start of the stretches of rows ``lo`` to ``hi`` that hold enough of the item's counted words."""
        part = ids[at[lo] : at[hi]]
        place = np.flatnonzero(part >= 0)
        place = place[self.count[part[place]] > 0]
        times = self.count[part[place]]
        total = int(times.sum())
        if total > _PAIRS and hi - lo > 1:
            mid = (lo + hi) // 2
            yield from self._stretches(ids, at, lo, mid)
            yield from self._stretches(ids, at, mid, hi)
            return
        if not total:
            return
        place = place + at[lo]
        item = self.owner[np.repeat(self.start[ids[place]] - (np.cumsum(times) - times), times) + np.arange(total)]
        gap = 2 * int(self.size.max())  # keeps rows and items apart
        apart = place + (np.searchsorted(at, place, side="right") - 1) * gap
        bits = int(at[hi] + (hi + 1) * gap).bit_length()
        key = np.sort((item << bits) | np.repeat(apart, times))
        item = key >> bits
        behind = np.arange(total) + self.need[item] - 1
        hit = np.flatnonzero(behind < total)
        hit = hit[key[behind[hit]] - key[hit] < 2 * self.size[item[hit]]]
        if not len(hit):
            return
        item, mask = item[hit], (1 << bits) - 1
        last, first = key[hit] & mask, (key[behind[hit]] & mask) - 2 * self.size[item] + 1
        fresh = np.append(True, (item[1:] != item[:-1]) | (first[1:] > last[:-1] + 1))
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(hit)) - 1
        spread = at + np.arange(len(at)) * gap
        row = np.searchsorted(spread, last[begin], side="right") - 1
        yield from zip(row.tolist(), item[begin].tolist(), (first[begin] - row * gap).tolist(), (last[end] - row * gap).tolist(), strict=True)

    def _answers(self, ids: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Row, item and last place of every answer that stands in a text."""
        every = np.flatnonzero(ids >= 0)
        every = every[self.ends[ids[every]]]
        rows = np.searchsorted(at, every, side="right") - 1
        for n, hashes in self.hashes.items():
            inside = every - (n - 1) >= at[rows]
            last, row = every[inside], rows[inside]
            same = np.isin(self._hash(ids, last, n), hashes)
            for p, r in zip(last[same].tolist(), row[same].tolist(), strict=True):
                for q in self.answers.get(ids[p - n + 1 : p + 1].tobytes(), ()):
                    yield r, q, p

    def complete(self, out: dict[tuple[int, int], tuple[float, bool]], ids: np.ndarray, at: np.ndarray) -> None:
        """Add what is missing in ``out``: by row and item the best share in common, and whether the answer stands near."""

        def check(row: int, q: int, a: int, b: int, least: float, answer: bool) -> None:
            before = out.get((row, q), (0.0, False))
            if before[0] == 1.0 and before[1] >= answer:
                return
            share = _compact_share(self.masks[q], int(self.size[q]), ids[max(a, at[row]) : min(b, at[row + 1])].tolist())
            if share >= least:
                out[row, q] = max(before[0], share), before[1] or answer

        for row, q, p in self._answers(ids, at):
            if self.short[q]:
                out[row, q] = 1.0, True
            else:
                check(row, q, p + 1 - self.reach, p - ANSWER + 1 + self.reach, COMMON_WITH_ANSWER, True)
        for row, q, first, last in self._stretches(ids, at, 0, len(at) - 1):
            check(row, q, first, last + 2 * int(self.size[q]), COMMON, False)


class Latent:
    """Candidates by cosine, checked on the words."""

    def __init__(self, exact: Exact, projection: np.ndarray, cosine: float) -> None:
        self.exact, self.rows, self.cosine = exact, _with_zeros(projection), cosine
        latent = np.array([projection[i].sum(axis=0) for i in exact.items])
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        self.around = max(1, -(-int(exact.size.max()) // CELL))
        self.words = np.full((len(exact.items), int(exact.size.max())), len(projection), np.int64)
        for own, item in zip(self.words, exact.items, strict=True):
            own[: len(item)] = item
        self.least = np.ceil(COMMON_WITH_ANSWER * exact.size - 1e-9).astype(np.int64)

    def passages(self, padded: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Latent vectors of unit length, one for each cell with the next one of its row (or zeros)."""
        full = np.vstack([_cell_sums(self.rows, padded), np.zeros((1, self.rows.shape[1]), np.float32)])
        last = np.zeros(len(padded) + 1, bool)
        last[first[1:] - 1] = True
        out = full[:-1] + np.where(last[:-1, None], 0, full[1:])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def _candidates(self, passage: np.ndarray, padded: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Row, cell and item; where those left out stand, too few of the item's words occur for any subsequence."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for k in range(0, len(passage), 8192):
            p, q = np.nonzero(passage[k : k + 8192] @ self.latent.T >= self.cosine)
            p, q = (p + k)[~self.exact.short[q]], q[~self.exact.short[q]]
            good = np.zeros(len(p), bool)
            for j in range(0, len(p), 1024):
                some, item = p[j : j + 1024], q[j : j + 1024]
                there = np.zeros((len(some), len(self.rows)), bool)
                for d in range(-self.around, self.around + 2):
                    c = some + d
                    inside = np.flatnonzero((c >= first[row[some]]) & (c < first[row[some] + 1]))
                    there[inside[:, None], padded[c[inside]]] = True
                there[:, -1] = False
                good[j : j + 1024] = there[np.arange(len(some))[:, None], self.words[item]].sum(axis=1) >= self.least[item]
            yield from zip(row[p[good]].tolist(), p[good].tolist(), q[good].tolist(), strict=True)

    def pairs(self, passage: np.ndarray, padded: np.ndarray, first: np.ndarray, ids: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], tuple[float, bool]]:
        """By row and item: the best share in common, and whether the answer stands near."""
        out: dict[tuple[int, int], tuple[float, bool]] = {}
        for row, c, q in self._candidates(passage, padded, first):
            before = out.get((row, q), (0.0, False))
            if before == (1.0, True):
                continue
            a = at[row] + max(0, c - first[row] - self.around) * CELL
            window = ids[a : min(at[row + 1], at[row] + (c - first[row] + 2 + self.around) * CELL)].tolist()
            share = _compact_share(self.exact.masks[q], int(self.exact.size[q]), window)
            if share >= COMMON_WITH_ANSWER:
                answer = _stands_in(self.exact.items[q][-ANSWER:], window)
                if share >= COMMON or answer:
                    out[row, q] = max(before[0], share), before[1] or answer
        return out


def _search(encoded: DataFrame, block: list[tuple[object, np.ndarray]], projection: np.ndarray, shares: np.ndarray, item_kind: str, cosine: float) -> DataFrame:
    kind = encoded.schema["doc_id"].dataType.simpleString()
    exact = Exact([i for _, i in block], shares)
    near = Latent(exact, projection, cosine)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for start, _, ids, at in _slices(batch):
                padded, first = _padded(ids, at, len(projection)), cells(ids, at)[1]
                passage = near.passages(padded, first)
                found = near.pairs(passage, padded, first, ids, at)
                exact.complete(found, ids, at)
                for (row, q), (share, answer) in found.items():
                    best = float((passage[first[row] : first[row + 1]] @ near.latent[q]).max())
                    out.append((start + row, block[q][0], best, share, answer))
            if out:
                columns = list(zip(*out, strict=True))
                arrays = [batch.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1])]
                arrays += [pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "cosine", "common", "answer"])

    return encoded.mapInArrow(run, _RESULT.format(kind, item_kind))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The query set, ``BLOCK`` items at a time."""
    block: list[tuple[object, list[bytes]]] = []
    for row in benchmark.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).dropna().orderBy("i", "t").toLocalIterator():
        item = words(row["t"])
        if item:
            block.append((row["i"], item))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


@tidy("decontaminate")
def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """``doc_id, item_id, cosine, common, answer``: documents and the benchmark items that they hold."""
    docs = id_text(df, id_col, text_col)
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    found = None
    for block in _blocks(benchmark, item_col, item_text_col):
        vocabulary = {w: k for k, w in enumerate(sorted({w for _, item in block for w in item}))}
        items = [np.array([vocabulary[w] for w in item], np.int64) for _, item in block]
        encoded = materialise(encode(docs, vocabulary), "encoded")
        projection, shares = directions(encoded, items, len(vocabulary))
        hits = _search(encoded, [(i, x) for (i, _), x in zip(block, items, strict=True)], projection, shares, item_kind, cosine)
        hits = materialise(hits, "hits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return df.sparkSession.createDataFrame([], _RESULT.format(kind, item_kind))
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("common").alias("common"), F.max("answer").alias("answer"))
