"""Token counts by rank-synchronous merging of ragged arrays.

All pre-tokens that a slice of texts brings anew stand in one flat array of symbols. In every round each
pre-token's pair of lowest rank is applied at all its places, for all pre-tokens at once; those without a pair
left leave the array with their count. Merging all places of one pair together equals the one by one order
because no merge makes a pair of lower rank than the one that made its parts.

A map over partitions: no shuffle; a worker holds a slice of about half a million characters and a bounded memo.

Defined cases. A null text counts as empty and has 0 bytes and 0 tokens. The file's special strings inside a
text count one token each and cut the text around them. Repeated rows are counted one by one; an empty table
gives an empty result; the input's other columns are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import pretokens
from lamina.llm.common import id_text

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 512
_NONE = np.iinfo(np.int32).max


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Counter:
    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.width = max(vocab.values()) + 1
        self.of_byte = np.array([vocab[c] for c in _byte_characters()], np.int64)
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.memo = pretokens.TwoGenerations()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE)

    def merged_sizes(self, pieces: list[str]) -> np.ndarray:
        """Number of symbols that survive in each piece (none is empty)."""
        raw = [p.encode("utf-8") for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), size)
        out = size.copy()
        last = np.append(owner[1:] != owner[:-1], True)
        rank = np.append(self._ranks(symbol[:-1], symbol[1:]), _NONE).astype(np.int32)
        rank[last] = _NONE
        while len(symbol):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            length = np.diff(np.append(first, len(symbol)))
            low = np.minimum.reduceat(rank, first)
            out[owner[first]] = length
            going = low < _NONE
            if not going.any():
                break
            stay, low_at = np.repeat(going, length), np.repeat(low, length)
            symbol, owner, rank, last, low_at = symbol[stay], owner[stay], rank[stay], last[stay], low_at[stay]
            hit = np.flatnonzero(rank == low_at)
            run = np.append(True, np.diff(hit) != 1)  # overlapping places: every second one of a run
            since = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            hit = hit[since % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            last[hit] = last[hit + 1]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            symbol, owner, rank, last = symbol[keep], owner[keep], rank[keep], last[keep]
            at = place[hit]
            again = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[again] = _NONE
            again = again[~last[again]]
            rank[again] = self._ranks(symbol[again], symbol[again + 1])
        return out

    def count(self, texts: list[str]) -> list[int]:
        parts, owner, extra = texts, None, np.zeros(len(texts), np.int64)
        if self.special is not None and any(self.special.search(t) for t in texts):
            cut = [self.special.split(t) for t in texts]
            extra = np.array([len(c) - 1 for c in cut], np.int64)
            owner = np.repeat(np.arange(len(texts)), extra + 1)
            parts = [p for c in cut for p in c]
        pieces, counts = pretokens.split(parts)
        memo = self.memo
        young, old = memo.young, memo.old
        new = [p for p in set(pieces) if p not in young]
        fresh = {p: old[p] for p in new if p in old}
        if missing := [p for p in new if p not in fresh]:
            fresh.update(zip(missing, self.merged_sizes(missing).tolist(), strict=True))
        get = young.get
        found = np.array([get(p) or fresh[p] for p in pieces], np.int64)
        for p, n in fresh.items():
            memo.put(p, n)
        upto = np.concatenate([[0], np.cumsum(found)])
        at = np.concatenate([[0], np.cumsum(counts)])
        sums = upto[at[1:]] - upto[at[:-1]]
        if owner is not None:
            sums = np.bincount(owner, sums, len(texts)).astype(np.int64)
        return (sums + extra).tolist()


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per input row."""
    docs = id_text(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [n for a, b in pretokens.chunks(texts) for n in counter.count(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
