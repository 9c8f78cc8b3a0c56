"""Licence scans: one Aho-Corasick pass finds notice phrases and identifier tags, a shunting-yard parser evaluates the tags' expressions.

Phrases are matched on whole words: the text, lower-cased in A-Z, becomes its words joined by one space, and
every phrase stands in the automaton with a space on either side, so all places are found, overlapping ones too.
An ``SPDX-License-Identifier`` tag is read up to the end of its line and evaluated: every licence has a
restrictiveness from 0 to 1; OR offers the mildest, AND demands the strictest, WITH an exception makes its
licence milder. A document's score is the strictest of what it holds, 0 without any licence.

A map over partitions: no shuffle; a worker holds one batch and the automaton.

Defined cases. A null text counts as empty: no words, no places, null first and last word, empty labels, score
0. An expression that doesn't parse still gives the labels of the identifiers in it, and the strictest of them
as value. Repeated rows are scanned one by one; an empty table gives an empty result; the input's other columns
are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.llm.common import id_text

#: Phrase to label; the base of the contract.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Phrase to label; the method's own.
PHRASES = {
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "isc license": "isc",
    "boost software license": "bsl",
    "proprietary and confidential": "proprietary",
}
_TAG_WORDS, _TAG = "spdx license identifier", "spdx-license-identifier:"
#: Restrictiveness by the longest fitting beginning of a label.
RESTRICTIVENESS = {
    "cc0": 0.0, "public-domain": 0.0, "unlicense": 0.0, "0bsd": 0.0, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "bsl": 0.1, "zlib": 0.1, "apache": 0.2,
    "cc-by": 0.2, "mpl": 0.4, "epl": 0.4, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.7, "agpl": 0.8, "cc-by-nc": 0.8, "cc-by-nd": 0.8, "reserved": 1.0, "proprietary": 1.0,
}
UNKNOWN, MILDER = 0.5, 0.8

_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_LOWER = {i: i + 32 for i in range(65, 91)}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}


def restrictiveness(label: str) -> float:
    return next((RESTRICTIVENESS[label[:n]] for n in range(len(label), 0, -1) if label[:n] in RESTRICTIVENESS), UNKNOWN)


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels (lower-case identifiers, exceptions not among them) and restrictiveness of a licence expression."""
    tokens = _TOKEN.findall(expression)
    output: list[str] = []
    stack: list[str] = []
    labels, wants_operand, well, after_with = set(), True, True, False
    for t in tokens:
        op = t.upper() if t.upper() in _PRECEDENCE else None
        if op:
            well &= not wants_operand
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[op]:
                output.append(stack.pop())
            stack.append(op)
            wants_operand, after_with = True, op == "WITH"
        elif t == "(":
            well &= wants_operand
            stack.append(t)
        elif t == ")":
            well &= not wants_operand
            while stack and stack[-1] != "(":
                output.append(stack.pop())
            well &= bool(stack)
            if stack:
                stack.pop()
        elif not wants_operand:
            break  # a comment behind the expression
        else:
            if not after_with:
                labels.add(t.translate(_LOWER))
            output.append(t)
            wants_operand = after_with = False
    well &= not wants_operand and "(" not in stack
    output += reversed([s for s in stack if s != "("])
    strictest = max(map(restrictiveness, labels), default=0.0)
    if not well:
        return labels, strictest
    values: list[float] = []
    for t in output:
        if t in _PRECEDENCE:
            b, a = values.pop(), values.pop()
            values.append(min(a, b) if t == "OR" else max(a, b) if t == "AND" else a * MILDER)
        else:
            values.append(restrictiveness(t.translate(_LOWER)))
    return labels, values[0]


class Scanner:
    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        for phrase in {**BASE_PHRASES, **PHRASES, _TAG_WORDS: ""}:
            self.automaton.add_word(f" {phrase} ", phrase)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = text.encode("utf-8").translate(_WORD_BYTES).split(b" ")
        words = [w for w in words if w]
        joined = f" {b' '.join(words).decode('utf-8')} "
        starts, base, labels, values, tagged = [], set(), set(), [], False
        seen = word = 0
        for end, phrase in self.automaton.iter(joined):
            if phrase in BASE_PHRASES:
                at = end - len(phrase) - 1
                if at >= seen:
                    word, seen = word + joined.count(" ", seen, at), at
                    starts.append(word)
                else:
                    starts.append(joined.count(" ", 0, at))
                base.add(BASE_PHRASES[phrase])
            elif phrase == _TAG_WORDS:
                tagged = True
            else:
                labels.add(PHRASES[phrase])
        labels |= base
        values += map(restrictiveness, labels)
        if tagged:
            low, at = text.translate(_LOWER), 0
            while (at := low.find(_TAG, at)) >= 0:
                at += len(_TAG)
                end = low.find("\n", at)
                found, value = evaluate(text[at : end if end >= 0 else len(text)])
                if found:
                    labels |= found
                    values.append(value)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max(values, default=0.0)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per input row."""
    docs = id_text(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column("text")]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True))], ["doc_id", *kinds])

    return docs.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
