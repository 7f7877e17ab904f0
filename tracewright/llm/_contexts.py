"""Grams: bytes with the contexts before them, for models that predict a byte from those before it.

All grams of all texts are counted. Models keep them as sorted arrays, one for
each length of context, so that what a text needs is found by binary search over
its different grams. Tables too large for a task are split into blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import materialise, text_slices

#: The symbol that stands before a text, and for every byte that training never met.
EDGE = 0


def shifted(symbols: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """The symbol ``k`` places earlier in the same text, EDGE before its start."""
    out = np.zeros(len(symbols), symbols.dtype)
    out[k:] = symbols[:-k] if k < len(symbols) else symbols[:0]
    near = (offsets[:-1, None] + np.arange(k))[np.arange(k) < np.diff(offsets)[:, None]]
    out[near] = EDGE
    return out


def grams(symbols: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """For each position the ``depth`` symbols before it and its own, 8 bits each, newest lowest; depth is 7 at most."""
    out = symbols.astype(np.uint64)
    for k in range(1, depth + 1):
        out |= shifted(symbols, offsets, k).astype(np.uint64) << np.uint64(8 * k)
    return out


def sum_grams(rows: DataFrame, symbols_of, depth: int) -> DataFrame:
    """(kind, gram, n): the counts of all grams of all ``rows`` (kind int, text string), summed by Spark and stored.

    ``symbols_of(column)`` gives the symbols, the offsets of the runs that contexts stay within,
    and the row of each symbol.
    """

    def count(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def settle(kind):
            g, n = (np.concatenate(x) for x in zip(*held[kind], strict=True))
            u, at = np.unique(g, return_inverse=True)
            held[kind] = [(u, np.bincount(at, n, len(u)).astype(np.int64))]

        for batch in batches:
            for part in text_slices(batch, "text"):
                symbols, offsets, row = symbols_of(part.column("text"))
                g = grams(symbols, offsets, depth)
                kinds = part.column("kind").to_numpy(zero_copy_only=False)
                of = kinds[row]
                for kind in np.unique(kinds).tolist():
                    if len(own := g[of == kind]):
                        held.setdefault(kind, []).append(np.unique(own, return_counts=True))
                        if len(held[kind]) >= 8:
                            settle(kind)
        for kind in held:
            settle(kind)
            u, n = held[kind][0]
            for k in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u[k : k + 100_000]), kind, np.int32)), pa.array(u[k : k + 100_000].view(np.int64)), pa.array(n[k : k + 100_000])], names=["kind", "gram", "n"])

    return materialise(rows.select("kind", "text").mapInArrow(count, "kind int, gram long, n long").groupBy("kind", "gram").agg(F.sum("n").alias("n")), "grams")


@dataclass(frozen=True)
class Block:
    """The grams of some kinds, of one part of the contexts: what a task holds at once. Contexts fall into parts by their
    two newest symbols, so that a part holds every longer context together with all that follow it."""

    kinds: tuple[int, ...]
    parts: int = 1
    part: int = 0

    def rows(self, summed: DataFrame) -> DataFrame:
        mine = F.pmod(F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)) * F.lit(_SPREAD), F.lit(65536)) % F.lit(self.parts) == self.part
        return summed.where(F.col("kind").between(min(self.kinds), max(self.kinds)) & mine)

    def holds(self, gram: np.ndarray) -> np.ndarray:
        return (((gram >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(_SPREAD) % np.uint64(65536)) % np.uint64(self.parts) == self.part


_SPREAD = 40503


def mask(symbols: int) -> np.uint64:
    """The newest ``symbols`` of a gram."""
    return np.uint64((1 << (8 * symbols)) - 1)


def tally(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys in order, and the sums of the counts of each."""
    u, at = np.unique(keys, return_inverse=True)
    return u, *(np.bincount(at, c, len(u)) for c in counts)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each wanted key among sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return i, keys[i] == wanted


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values of each row, in double precision; empty rows give 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=np.float64)
    return out
