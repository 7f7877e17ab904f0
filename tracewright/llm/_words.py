"""Vectorised words over Arrow text: lower-cased ASCII, words of ``[0-9a-z\\x80-\\xff]+`` bytes.

In UTF-8 these are exactly the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the
text after lower-casing A-Z, since every byte of a non-ASCII character is above 0x7F.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_FOLD = np.zeros(256, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)

_SEED, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
#: Words of more bytes are hashed one by one.
_LONG = 64


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n+1 offsets of its rows; null is empty."""
    if pa.types.is_large_string(column.type) or column.null_count:
        column = pa.compute.fill_null(column, "").cast(pa.large_string())
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a run of rows, in order: byte spans, row and 64-bit hash of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    n_rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """FNV-1a of each span, byte by byte over all spans at once, mixed with its length."""
    size = end - start
    h = np.full(len(start), _SEED, np.uint64)
    live = np.flatnonzero(size <= _LONG)
    k = 0
    while len(live):
        h[live] = (h[live] ^ data[start[live] + k].astype(np.uint64)) * _PRIME
        k += 1
        live = live[size[live] > k]
    for i in np.flatnonzero(size > _LONG):
        h[i] = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return mix(h ^ (size.astype(np.uint64) << np.uint64(48)))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes, and the start, end and row of each word."""
    raw, offsets = text_bytes(column)
    data = _FOLD[raw]
    inside = data > 0
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    before[offsets[full]] = False
    after[offsets[full + 1] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return data, start, end, np.searchsorted(offsets, start, "right") - 1


def words_of(column: pa.Array) -> Words:
    data, start, end, row = spans_of(column)
    return Words(data, start, end, row, hash_spans(data, start, end), len(column))
