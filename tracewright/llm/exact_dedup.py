"""Exact deduplication by two passes over Bloom filters.

Pass one deals the hashes of all texts, eight bytes each, into shards of about
``SHARD`` hashes. The task of a shard holds one Bloom filter and gives out every
hash whose bits are all set when it comes: each hash met again, and a few others.
A hash met often is counted once for each ``COMPACT`` hashes of its task before
it travels. Pass two sets the hashes given out in a second filter that goes to
every task; only rows that pass it shuffle, and all others stay as they are. The
second filter grows with the number of repeated hashes up to ``max_bits``; where
these have fewer than ``LEAST_BITS`` bits each, their rows are found by a join on
the hash in its place, with the same results.

Defined results: null text equals empty text. White space means
``[\\x20\\x09-\\x0D]``. Of a group stays the row with the most code points, then
the smallest doc_id (null last), then the smallest hash of all its columns;
rows alike in everything are told apart by their row number alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import bounded_batches, discard, materialise, released, row_hash
from ._words import mix

WHITE = " \t\n\x0b\x0c\r"
#: Bits of the filter that is sent to all tasks, at most (128 MB), and the bits for each key below which it is not made.
MAX_BITS, LEAST_BITS = 1 << 30, 3
#: Bits for each key, where the bound allows them, and bits that a key sets.
BITS_PER_KEY, PROBES = 16, 4
#: Hashes of a shard, and hashes that a task brings together before they travel.
SHARD, COMPACT = 1 << 20, 1 << 19
#: Filters travel in pieces of so many bytes.
PIECE = 1 << 16
#: Groups of more than this share of the rows are looked up by broadcast; at most 1/HEAVY_SHARE exist.
HEAVY_SHARE = 1e-4


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _bits(h: np.ndarray, m: int) -> np.ndarray:
    """PROBES positions of each hash, by double hashing; m is a power of two."""
    a = h.astype(np.int64).view(np.uint64)
    b = mix(a) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) & np.uint64(m - 1) for i in range(PROBES)])


def repeated_hashes(hashes: DataFrame, column: str, n_rows: int, shard: int = SHARD) -> DataFrame:
    """(h): every hash that occurs more than once, at least once, and a few that do not."""
    shards = max(1, -(-n_rows // shard))
    m = 1 << max(16, math.ceil(math.log2(min(n_rows, shard) * BITS_PER_KEY or 1)))

    def compact(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size >= COMPACT:
                yield distinct(held)
                held, size = [], 0
        if size:
            yield distinct(held)

    def distinct(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n > 1)], names=["h", "again"])

    def pass_shard(batches):
        seen = np.zeros(m, bool)
        for batch in batches:
            h, again = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            order = np.argsort(h, kind="stable")
            h, again = h[order], again[order].astype(bool)
            again[1:] |= h[1:] == h[:-1]
            at = _bits(h, m)
            again |= seen[at].all(axis=0)
            seen[at] = True
            yield pa.RecordBatch.from_arrays([pa.array(h[again])], names=["h"])

    return hashes.select(column).mapInArrow(released(compact), "h long, again boolean").repartition(shards, "h").mapInArrow(released(pass_shard), "h long")


def filter_of(keys: DataFrame, column: str, n_keys: int, max_bits: int = MAX_BITS) -> tuple[np.ndarray, int]:
    """The packed Bloom filter of ``keys``, and its number of bits."""
    m = 1 << min(int(math.log2(max_bits)), max(19, math.ceil(math.log2(max(1, n_keys) * BITS_PER_KEY))))

    def build(batches):
        flags = np.zeros(m, bool)
        for batch in batches:
            flags[_bits(batch.column(0).to_numpy(zero_copy_only=False), m)] = True
        step = PIECE * 8
        for k in range(0, m, step):
            if flags[k : k + step].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // step], pa.int32()), pa.array([np.packbits(flags[k : k + step], bitorder="little").tobytes()], pa.binary())], names=["piece", "bits"])

    def merge(piece: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in piece["bits"]])
        return pd.DataFrame({"piece": [piece["piece"].iloc[0]], "bits": [bits.tobytes()]})

    # few large tasks: a filter per task costs its size, and keys are small
    tasks = max(1, min(-(-n_keys // 1_000_000), 64))
    pieces = keys.select(column).coalesce(tasks).mapInArrow(released(build), "piece int, bits binary").groupBy("piece").applyInPandas(merge, "piece int, bits binary")
    bits = np.zeros(m // 8, np.uint8)
    for r in pieces.toLocalIterator():
        x = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[r["piece"] * PIECE : r["piece"] * PIECE + len(x)] = x
    return bits, m


def tester(keys: DataFrame, column: str, n_keys: int, max_bits: int = MAX_BITS):
    """A function from an array of hashes to flags, for use in workers: may they be among ``keys``? None with more keys than a filter can hold."""
    if n_keys * LEAST_BITS > max_bits:
        return None
    bits, m = filter_of(keys, column, n_keys, max_bits)
    sent = keys.sparkSession.sparkContext.broadcast(bits)

    def test(h: np.ndarray) -> np.ndarray:
        at = _bits(h, m)
        return ((sent.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)

    return test


def marked_among(rows: DataFrame, hash_of: Column, keys: DataFrame, column: str, n_keys: int, to: str, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` with a column ``to``: may the row's hash be one of ``keys``? True for all that are, and for few others.

    A filter tells it where the rows are. With more keys than the filter can hold the rows are joined with them.
    """
    if test := tester(keys, column, n_keys, max_bits):
        return rows.withColumn(to, F.pandas_udf(lambda h: pd.Series(test(h.to_numpy())), T.BooleanType(), F.PandasUDFType.SCALAR)(hash_of))
    known = keys.select(F.col(column).alias("_hash")).distinct().withColumn("_known", F.lit(True))
    return rows.withColumn("_hash", hash_of).join(known, "_hash", "left").withColumn(to, F.col("_known").isNotNull()).drop("_hash", "_known")


def classify_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).cast("long").alias("size"), sha.alias("text_sha256"), F.xxhash64(text).alias("tie"))
    rows = rows.select("*", F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long").alias("h"), F.monotonically_increasing_id().alias("row_id"))
    rows = materialise(rows, "exact-dedup")  # row numbers and hashes are fixed from here on
    n = rows.count()
    again = materialise(repeated_hashes(rows, "h", n, shard), "exact-dedup-again")
    rows = marked_among(rows, F.col("h"), again, "h", again.count(), "maybe", max_bits)
    alone = rows.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = materialise(rows.where("maybe").drop("maybe", "h"), "exact-dedup-maybe")
    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie", "row_id"))
    groups = materialise(some.groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "exact-dedup-groups")
    groups = groups.select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("keep_row"))
    out = lookup(some, groups, "text_sha256", "group_size", max(100, int(n * HEAVY_SHARE)))
    return alone.unionByName(out.select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256"))


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str, heavy: int) -> DataFrame:
    """Join ``rows`` with one row of ``groups`` per key. Groups of more than ``heavy`` rows, of which
    there are at most rows / heavy, are broadcast, so that no task gets all rows of a large group."""
    large = groups.where(F.col(size) > heavy)
    marked = rows.join(F.broadcast(large.select(key, F.lit(True).alias("_heavy"))), key, "left")
    return marked.where(F.col("_heavy")).drop("_heavy").join(F.broadcast(large), key).unionByName(marked.where(F.col("_heavy").isNull()).drop("_heavy").join(groups.where(F.col(size) <= heavy), key))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, shard: int = SHARD) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    Rows that cannot have a copy pass straight through. The others are reduced to one row of each
    group before they shuffle: the whole row rides in the minimum.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = docs.columns
    h = F.xxhash64(normalised(F.col(text_col)))
    hashes = materialise(docs.select(h.alias("h")), "exact-dedup-hashes")
    n = hashes.count()
    again = materialise(repeated_hashes(hashes, "h", n, shard), "exact-dedup-again")
    discard(hashes)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), h.alias("h"))
    row = marked_among(row, F.col("h"), again, "h", again.count(), "maybe", max_bits)
    alone = row.where(~F.col("maybe")).select("row")
    text, key = F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), F.col(f"row.`{id_col}`")
    some = row.where("maybe").select(F.sha2(normalised(text).cast("binary"), 256).alias("sha"), (-F.char_length(text)).alias("size"), key.isNull().alias("no_id"), key.alias("id"), row_hash(F.col("row")).alias("tie"), "row")
    kept = some.groupBy("sha").agg(F.min_by("row", F.struct("size", "no_id", "id", "tie")).alias("row")).select("row")
    return alone.unionByName(kept).select(*(F.col(f"row.`{c}`").alias(c) for c in names))
