"""Words of whole Arrow batches as 64-bit hashes, by numpy; used inside tasks only.

A word is a run of bytes that are no separators. Every class of separators used here is ASCII,
so a run of UTF-8 bytes is the same as the run of code points that the contracts speak of.

Defined results: a null or empty text has no words; equal rows give equal hashes, whatever batch or piece they come in; a
text, or a single word, longer than what is taken at once is cut by pieces with the same result; no rows give nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_ASCII = np.arange(256) < 0x80
_ALNUM = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])
#: After lower-casing A-Z: all of ASCII but 0-9 and a-z.
NON_ALNUM = _ASCII & ~_ALNUM

_U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240601))
_OF_BYTE = _RANDOM.integers(1, 2**64, 256, dtype=_U)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 2**64)
_PLACE = _RANDOM.integers(1, 2**64, 64, dtype=_U) | _U(1)
_SHORT = _U(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


class Words(NamedTuple):
    """Words of rows first .. first+rows-1 of a batch; doc counts from 0 at first; start and end are byte places in data."""

    first: int
    rows: int
    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def bounds(self) -> np.ndarray:
        """Row r has the words bounds[r] .. bounds[r+1]-1."""
        return np.searchsorted(self.doc, np.arange(self.rows + 1))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n; n never exceeds what words() takes at once."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.concatenate([[_U(1)], np.multiply.accumulate(np.full(max(n, 1 << 16), _U(b), _U))]) for b in (_BASE, _UNBASE)]
    return _powers[0], _powers[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    big = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = big.buffers()
    at = np.frombuffer(offsets, np.int64)[big.offset : big.offset + len(big) + 1] if offsets and len(big) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _cut(data: np.ndarray, edges: np.ndarray, separators: np.ndarray, of_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of data; no word crosses an edge."""
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[edges] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    power, unpower = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(of_byte[data] * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * unpower[start] + (end - start).astype(_U) * _SHORT), start, end


def _giant(data: np.ndarray, of_byte: np.ndarray, at_once: int) -> int:
    """The hash of one word, by pieces."""
    power, total = _tables(at_once + 1)[0], 0
    for k in range(0, len(data), at_once):
        piece = data[k : k + at_once]
        total += int((of_byte[piece] * power[: len(piece)]).sum()) * pow(_BASE, k, 2**64)
    return int(mix(np.array([total % 2**64], _U) + np.array([len(data)], _U) * _SHORT)[0])


def _long_row(data: np.ndarray, separators: np.ndarray, of_byte: np.ndarray, at_once: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of one long text, by pieces that end at a separator."""
    parts, at = [(np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    while at < len(data):
        stop = min(len(data), at + at_once)
        if stop < len(data):
            gaps = np.flatnonzero(separators[data[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:  # a word of more than at_once bytes
                while stop < len(data) and not len(gaps := np.flatnonzero(separators[data[stop : stop + at_once]])):
                    stop = min(len(data), stop + at_once)
                stop += int(gaps[0]) if stop < len(data) else 0
                parts.append((np.array([_giant(data[at:stop], of_byte, at_once)], _U), np.array([at]), np.array([stop])))
                at = stop
                continue
        hashed, start, end = _cut(data[at:stop], np.array([0, stop - at]), separators, of_byte)
        parts.append((hashed, start + at, end + at))
        at = stop
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def words(texts: pa.Array, separators: np.ndarray = SPACES, fold: bool = True, at_once: int = 256 << 10) -> Iterator[Words]:
    """Whole rows, about so many bytes at once. fold: A-Z count as a-z.

    A longer row comes alone: it is cut into words by pieces of so many bytes, so besides its bytes only its words (32 bytes
    each) are held.
    """
    of_byte = _OF_BYTE.copy()
    if fold:
        of_byte[0x41:0x5B] = of_byte[0x61:0x7B]
    at, everything = buffers(texts)
    row, n = 0, len(at) - 1
    while row < n:
        stop = min(n, max(row + 1, int(np.searchsorted(at, at[row] + at_once, "right")) - 1))
        data = everything[at[row] : at[stop]]
        inner = at[row : stop + 1] - at[row]
        hashed, start, end = _cut(data, inner, separators, of_byte) if len(data) <= at_once else _long_row(data, separators, of_byte, at_once)
        doc = np.searchsorted(inner, start, "right") - 1
        yield Words(row, stop - row, doc.astype(np.int64), hashed, start, end, data)
        row = stop


def word_hash(word: str) -> int:
    """The hash that words() gives this word."""
    return int(next(words(pa.array([word]), np.zeros(256, bool), fold=False)).hash[0])


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one text in order; of a shorter text, of its whole sequence."""
    if len(hashes) >= n:
        out = np.zeros(len(hashes) - n + 1, _U)
        for k in range(n):
            out += hashes[k : len(hashes) - n + 1 + k] * _PLACE[k]
        return mix(out)
    if not len(hashes):
        return np.zeros(0, _U)
    return mix((hashes * _PLACE[: len(hashes)]).sum(keepdims=True) + np.full(1, len(hashes), _U) * _SHORT)


def binary16(high: np.ndarray, low: np.ndarray) -> pa.Array:
    """A binary column of 16 bytes a row."""
    data = np.empty((len(high), 2), ">u8")
    data[:, 0], data[:, 1] = high, low
    offsets = np.arange(len(high) + 1, dtype=np.int32) * 16
    return pa.BinaryArray.from_buffers(pa.binary(), len(high), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
