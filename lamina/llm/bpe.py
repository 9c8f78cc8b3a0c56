"""Byte-level BPE encoding and decoding.

``encode`` cuts texts into pre-tokens by array scans (``pretokens``), merges every distinct pre-token
once per worker through a bounded memo, and returns the ids with each token's byte offset; ``decode`` puts the
bytes back by those offsets. Ids and offsets are packed as little-endian unsigned 32-bit integers.

Both map over partitions: no shuffle. A worker holds one batch as it came, one slice of it of about half a million
bytes, a bounded memo and the vocabulary; ``round_trip`` does both in one worker.

Defined cases. A null text counts as empty; an empty text has no ids and decodes to no bytes. A text longer
than a slice is a slice of its own. Repeated rows are encoded one by one; an empty table gives an empty
result; the input's other columns are left out. Special strings inside texts are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import pretokens
from lamina.llm.common import id_text

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
_SHORT = 48
_loaded: dict[str, dict[bytes, int]] = {}


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank; read once per worker."""
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return _loaded[path]


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: again and again the leftmost pair of lowest rank."""
    if (whole := rank.get(piece)) is not None:
        return [whole]
    if len(piece) > _SHORT:
        return _merge_long(piece, rank)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = rank.get
    pairs = [get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
    while pairs:
        low = min(pairs)
        if low == 1 << 30:
            break
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        pairs.pop(i)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], 1 << 30)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], 1 << 30)
    return [rank[p] for p in parts]


def _merge_long(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same with a heap over a linked list, for pieces where rescanning would be quadratic."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := rank.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if not alive[i] or end[i] != j or not alive[j] or end[j] != k:
            continue
        end[i], alive[j] = k, False
        if k < n:
            before[k] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Texts to packed ids; keeps a bounded memo of merged pre-tokens."""

    def __init__(self, path: str = VOCABULARY):
        self.rank, self.memo = ranks(path), pretokens.TwoGenerations()

    def _miss(self, piece: str) -> bytes:
        found = self.memo.old.get(piece)
        if found is None:
            found = np.array(merge(piece.encode("utf-8"), self.rank), "<u4").tobytes()
        self.memo.put(piece, found)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces, counts = pretokens.split(texts)
        out, at = [], 0
        for n in counts.tolist():
            get, miss = self.memo.young.get, self._miss
            out.append(b"".join([get(p) or miss(p) for p in pieces[at : at + n]]))
            at += n
        return out


class Decoder:
    def __init__(self, path: str = VOCABULARY):
        by_id = sorted((i, b) for b, i in ranks(path).items())
        self.size = np.zeros(by_id[-1][0] + 1, np.int64)
        self.size[[i for i, _ in by_id]] = [len(b) for _, b in by_id]
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(b for _, b in by_id), np.uint8)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token's bytes start."""
        size = self.size[ids]
        return np.cumsum(size) - size

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        size = self.size[ids]
        total = int(offsets[-1] + size[-1]) if len(ids) else 0
        return self.flat[np.arange(total) + np.repeat(self.at[ids] - offsets, size)].tobytes()


def _encoded(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder, decoder = Encoder(path), Decoder(path)
    for batch in batches:
        for first, texts in pretokens.slices(batch.column("text")):
            packed = encoder.encode(texts)
            offsets = [decoder.offsets(np.frombuffer(x, "<u4")).astype("<u4").tobytes() for x in packed]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, len(texts)), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(offsets, pa.binary())],
                ["doc_id", "n_tokens", "ids", "offsets"],
            )


def _decoded(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(path)
    for batch in batches:
        rows = zip(batch.column("ids"), batch.column("offsets"), strict=True)
        out = [decoder.decode(np.frombuffer(i.as_buffer(), "<u4"), np.frombuffer(o.as_buffer(), "<u4").astype(np.int64)) for i, o in rows]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "n_tokens", "ids")] + [pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, ids, offsets``; ids and byte offsets packed as little-endian unsigned 32-bit integers."""
    docs = id_text(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lambda batches: _encoded(batches, path), f"doc_id {kind}, n_tokens bigint, ids binary, offsets binary")


def decode(df: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """What ``encode`` returns, with a column ``decoded``, the bytes of the text, in place of the offsets."""
    kind = df.schema["doc_id"].dataType.simpleString()
    columns = df.select("doc_id", "n_tokens", "ids", "offsets")
    return columns.mapInArrow(lambda batches: _decoded(batches, path), f"doc_id {kind}, n_tokens bigint, ids binary, decoded binary")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``decode(encode(df))`` slice by slice in one worker: ids and offsets of a whole batch are never held, nor sent there and back."""
    docs = id_text(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lambda batches: _decoded(_encoded(batches, path), path), f"doc_id {kind}, n_tokens bigint, ids binary, decoded binary")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """Encode, decode, and the digests of both."""
    return round_trip(df, id_col, text_col, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
