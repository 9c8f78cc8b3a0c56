"""Pre-token boundaries of byte-level BPE, found without regular expressions.

Code points become classes through one array lookup; what a boundary needs to know of the characters
ahead (a contraction after an apostrophe, white space before a word) is folded into the symbol by shifted
comparisons. The rest is a small automaton. Its transition functions form a finite monoid, so the states at
all positions come from an associative scan over function numbers: blocks are composed side by side,
the block results scanned, and every block replayed from its known state.

The classes are those of Unicode 16, which the tokenizer libraries use: the tables of ``unicodedata``
plus the letters and digits that came after its version.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_NEWER = {
    "15.1.0": (
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
        (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
        (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
        (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ),
}
_NEWER_DIGITS = {
    "15.1.0": ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)),
}
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, DIGIT, OTHER, WHITE, SPACE, WHITE_ALONE, SHORT, LONG, RESET = range(9)
_IDLE, _IN_LETTERS, _IN_DIGITS, _IN_OTHER, _IN_WHITE, _AFTER_SPACE, _ONE_MORE, _TWO_MORE = range(8)
_BLOCK = 128


@cache
def classes() -> np.ndarray:
    """Class of every code point: LETTER, DIGIT, WHITE or OTHER."""
    first = {"L": LETTER, "N": DIGIT}
    table = np.fromiter((first.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    for newer, kind in ((_NEWER, LETTER), (_NEWER_DIGITS, DIGIT)):
        for a, b in newer.get(unicodedata.unidata_version, ()):
            table[a : b + 1] = kind
    table[_WHITE] = WHITE
    return table


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Next state and "a boundary stands before" by (state, symbol); function number of a symbol; composition; state reached from idle."""
    step, cut = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    for state in range(8):
        for symbol, into in ((LETTER, _IN_LETTERS), (DIGIT, _IN_DIGITS), (OTHER, _IN_OTHER)):
            step[state, symbol] = into
            cut[state, symbol] = state not in (into, _AFTER_SPACE)
        step[state, WHITE], cut[state, WHITE] = _IN_WHITE, state != _IN_WHITE
        step[state, SPACE], step[state, WHITE_ALONE], step[state, RESET] = _AFTER_SPACE, _IDLE, _IDLE
        joined = state in (_IN_OTHER, _AFTER_SPACE)
        for symbol, into in ((SHORT, _ONE_MORE), (LONG, _TWO_MORE)):
            step[state, symbol], cut[state, symbol] = (_IN_OTHER if joined else into), not joined
    for state, into in ((_ONE_MORE, _IDLE), (_TWO_MORE, _ONE_MORE)):
        step[state, LETTER], cut[state, LETTER] = into, False
    number: dict[tuple[int, ...], int] = {}
    of_symbol = [number.setdefault(tuple(step[:, s].tolist()), len(number)) for s in range(9)]
    known = list(number)
    for f in known:  # grows until it is closed under composition
        for g in list(known):
            for h in (tuple(g[x] for x in f), tuple(f[x] for x in g)):
                if h not in number:
                    number[h] = len(number)
                    known.append(h)
    compose = np.array([[number[tuple(g[x] for x in f)] for g in known] for f in known], np.uint16)
    assert 9 * len(known) < 256, "function and symbol together are one byte"
    return step, cut, np.array(of_symbol, np.uint8), compose.astype(np.uint8), np.array([f[_IDLE] for f in known], np.uint8)


def boundaries(symbols: np.ndarray) -> np.ndarray:
    """True where a token starts."""
    step, cut, of_symbol, compose, from_idle = automaton()
    n, size = len(symbols), len(compose)
    blocks = -(-n // _BLOCK)
    padded = np.full(blocks * _BLOCK, RESET, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(blocks, _BLOCK).T)
    then = np.ascontiguousarray(compose[:, of_symbol]).ravel()
    total = of_symbol[columns[0]]
    for column in columns[1:]:
        total = then.take(total * np.uint8(9) + column)
    flat, span = compose.ravel(), 1
    while span < blocks:  # inclusive scan of the blocks' functions, in doubling steps
        total = np.concatenate([total[:span], flat.take(total[:-span] * np.int32(size) + total[span:])])
        span *= 2
    state = np.empty(blocks, np.uint8)
    state[0], state[1:] = _IDLE, from_idle[total[:-1]]
    out = np.empty((_BLOCK, blocks), bool)
    next_, cuts = step.ravel(), cut.ravel()
    for j, column in enumerate(columns):
        at = (state * np.uint8(9) + column).astype(np.intp)
        cuts.take(at, out=out[j], mode="clip")
        state = next_.take(at)
    return np.ascontiguousarray(out.T).ravel()[:n]


def symbols(text: str, ends: np.ndarray) -> np.ndarray:
    """The automaton's input for texts joined in ``text``; ``ends`` are the positions of the one separator after each."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = classes()[points]
    out[ends] = RESET
    white = out == WHITE
    inner = np.zeros(len(out), bool)  # a visible character of the same text follows
    inner[:-1] = ~white[1:] & (out[1:] != RESET)
    alone = white & inner  # SPACE and WHITE_ALONE follow WHITE in number
    out += alone.view(np.uint8) * (np.uint8(WHITE_ALONE - WHITE) - (points == 32).view(np.uint8))
    quotes = np.flatnonzero((points == 39) & (out == OTHER))
    if len(quotes):
        ahead = np.concatenate([np.where(out == RESET, 0, points), np.zeros(2, np.uint32)])
        one, two = ahead[quotes + 1], ahead[quotes + 2]
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        out[quotes[long]] = LONG
    return out


def split(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pre-tokens of all texts, in order, and how many each text has."""
    joined = "\n".join(texts) + "\n"
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    start = boundaries(symbols(joined, ends))
    start[ends] = True  # the separator is a slice of its own, left out below
    at = np.flatnonzero(start)
    upto = np.append(at[1:], len(joined))
    real = np.ones(len(at), bool)
    real[np.searchsorted(at, ends)] = False
    counts = np.diff(np.searchsorted(at[real], np.concatenate([[0], ends + 1])))
    return [joined[a:b] for a, b in zip(at[real].tolist(), upto[real].tolist(), strict=True)], counts


def chunks(texts: list[str], most: int = 1 << 19):
    """Slices of ``texts`` of about ``most`` characters each (a longer text is a slice of its own), as (first, behind last)."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """A column's texts (none is null) in slices of at most ``most`` bytes (a longer text is a slice of its own), as (first, texts)."""
    upto = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))])
    first = 0
    while first < len(column):
        behind = max(first + 1, int(np.searchsorted(upto, upto[first] + most, "right")) - 1)
        yield first, column.slice(first, behind - first).to_pylist()
        first = behind


class TwoGenerations:
    """A bounded memo: when the young half is full it becomes the old one, and what is asked again moves back."""

    def __init__(self, most: int = 150_000, longest: int = 64):
        self.young, self.old, self.most, self.longest = {}, {}, most, longest

    def put(self, key: str, value) -> None:
        if len(key) <= self.longest:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[key] = value
