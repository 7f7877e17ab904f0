"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of every word of the training texts: one row of
the index, a segment, covers about SEGMENT bytes of text and holds the hashes of its
words in order, the number of postings of each, and the positions, list after list.
Segments are made where the texts are, so nothing shuffles, and can be searched
again for other test items.

``search`` looks windows of test words up in every segment: from the window's rarest
word there, whose list is shifted to where the window would start; the other words'
lists, shifted by their offsets, are intersected with it in order of rarity. Only
windows travel, at most about ``block_windows`` at once; more are taken in blocks,
each over all segments, and only rows with findings are stored between blocks.

Defined results: null or empty text has no words and no finding. Repeated rows and
repeated ids are judged row by row. Ids keep their type. A test item without words
has no window; items with equal windows are all reported. Null item ids are named "".
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import bounded_batches, id_and_text, materialise, released, text_slices
from ._words import words_of
from .exact_dedup import tester

WINDOW = 10
#: (window, item) pairs of one block; a window is 10 hashes of 8 bytes.
BLOCK_WINDOWS = 200_000
#: Bytes of text of a segment, about.
SEGMENT = 1 << 20
#: Candidates that one step of the lookup holds.
_STEP = 1 << 21

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _key(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored segments: ``segment`` (a number), ``ids``, ``keys`` (hashes of the texts) and ``n_words`` of their rows,
    and as packed little-endian numbers ``terms`` (sorted 64-bit word hashes), ``counts`` (32 bits each) and
    ``postings`` (32 bits each: word positions from the segment's first word, ascending for each term)."""
    bounded_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make(batches):
        for batch in batches:
            for part in text_slices(batch, "text", limit=SEGMENT):
                words = words_of(part.column("text"))
                order = np.argsort(words.hash, kind="stable")
                terms, counts = np.unique(words.hash, return_counts=True)
                ids, n = part.column("doc_id"), words.counts()
                packed = [terms.astype("<u8"), counts.astype("<i4"), order.astype("<i4")]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        pa.array([[_key(t) for t in part.column("text").to_pylist()]], pa.list_(pa.binary())),
                        pa.array([n.tolist()], pa.list_(pa.int32())),
                        *(pa.array([x.tobytes()], pa.binary()) for x in packed),
                    ],
                    names=["ids", "keys", "n_words", "terms", "counts", "postings"],
                )

    made = rows.mapInArrow(released(make), f"ids array<{kind}>, keys array<binary>, n_words array<int>, terms binary, counts binary, postings binary")
    return materialise(made.withColumn("segment", F.monotonically_increasing_id()), "postings", large_rows=True)


@dataclass
class TestWindows:
    """Distinct windows of test words as term numbers, and the items that hold each."""

    terms: np.ndarray  # sorted word hashes
    window: np.ndarray  # windows x width term numbers, -1 beyond the length
    size: np.ndarray
    item_at: np.ndarray  # CSR: items of window w are item_of[item_at[w]:item_at[w + 1]]
    item_of: np.ndarray
    items: list[str]

    @classmethod
    def of(cls, rows: list[tuple[bytes, str]], width: int = WINDOW) -> TestWindows:
        """``rows``: a window's word hashes as packed numbers, and an item that holds it."""
        items = sorted({i for _, i in rows})
        number = {x: k for k, x in enumerate(items)}
        held: dict[bytes, list[int]] = {}
        for w, i in rows:
            held.setdefault(bytes(w), []).append(number[i])
        size = np.array([len(w) // 8 for w in held], np.int64)
        terms, ids = np.unique(np.frombuffer(b"".join(held), "<u8"), return_inverse=True)
        window = np.full((len(held), width), -1, np.int32)
        window[np.arange(width) < size[:, None]] = ids
        return cls(terms, window, size, np.cumsum([0, *map(len, held.values())]), np.array([i for x in held.values() for i in x], np.int64), items)


class Segment:
    """The lists of one stored segment, as far as test items use their terms."""

    def __init__(self, terms: bytes, counts: bytes, postings: bytes, n_words: list[int], tests: TestWindows):
        own, count, places = np.frombuffer(terms, "<u8"), np.frombuffer(counts, "<i4").astype(np.int64), np.frombuffer(postings, "<i4")
        ends = np.cumsum(count)
        self.n, self.tests = len(places), tests
        self.row_start = np.concatenate([[0], np.cumsum(np.asarray(n_words, np.int64))])
        at = np.searchsorted(own, tests.terms)
        at[at == len(own)] = 0
        known = np.flatnonzero(own[at] == tests.terms) if len(own) else np.zeros(0, np.int64)
        self.count = np.zeros(len(tests.terms), np.int64)
        self.count[known] = count[at[known]]
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        each = self.count[known]
        take = np.repeat(ends[at[known]] - count[at[known]] - self.first[known], each) + np.arange(self.first[-1])
        #: term * n + position, sorted: one list of positions after the other
        self.postings = np.repeat(known, each) * self.n + places[take]

    def row_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.row_start, place, "right") - 1

    def lookup(self, slop: int = 0):
        """(window numbers, start positions, rows) of the windows found, for slop > 0 with every term at most so far from its place;
        the start then follows from the rarest term and may lie before the row's first word."""
        t = self.tests
        if not len(t.size) or not self.n:
            return (np.zeros(0, np.int64),) * 3
        length = np.where(t.window >= 0, self.count[t.window], np.iinfo(np.int64).max)
        alive = np.flatnonzero(length.min(axis=1) > 0)
        rarity = np.argsort(length[alive], axis=1, kind="stable")
        todo = length[alive, rarity[:, 0]]
        found = []
        upto, lo = np.cumsum(todo), 0
        while lo < len(alive):
            # as many windows as _STEP candidates allow, at least one
            hi = max(lo + 1, int(np.searchsorted(upto, _STEP + (upto[lo - 1] if lo else 0), "right")))
            found += self._expand(alive[lo:hi], rarity[lo:hi], todo[lo:hi], slop)
            lo = hi
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _expand(self, which, rarity, todo, slop):
        t = self.tests
        if not len(which):
            return
        # the rarest term's list, shifted to where the window would start
        off = rarity[:, 0]
        rank = np.repeat(np.arange(len(which)), todo)
        within = np.arange(len(rank)) - np.repeat(np.cumsum(todo) - todo, todo)
        rare = t.window[which, off]
        place = self.postings[self.first[rare][rank] + within] - rare[rank].astype(np.int64) * self.n
        start, row = place - off[rank], self.row_of(place)
        if not slop:
            keep = (start >= self.row_start[row]) & (start + t.size[which][rank] <= self.row_start[row + 1])
            rank, start, row = rank[keep], start[keep], row[keep]
        for j in range(1, t.window.shape[1]):
            if not len(rank):
                return
            off = rarity[rank, j]
            term = t.window[which[rank], off].astype(np.int64)
            want = start + off
            # no further than the row's own words
            least = np.maximum(want - slop, self.row_start[row])
            low = np.searchsorted(self.postings, term * self.n + least)
            got = self.postings[np.minimum(low, len(self.postings) - 1)] - term * self.n
            ok = (term < 0) | ((low < len(self.postings)) & (got >= least) & (got <= want + slop) & (got < self.row_start[row + 1]))
            rank, start, row = rank[ok], start[ok], row[ok]
        yield which[rank], start, row


def windows_of(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(window, item), distinct: the word hashes of every window of every item."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def make(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                words = words_of(part.column("text"))
                ends = np.cumsum(words.counts())
                for item, hi, n in zip(part.column("item").to_pylist(), ends.tolist(), words.counts().tolist(), strict=True):
                    own = words.hash[hi - n : hi].astype("<u8").tobytes()
                    cut = [own[8 * k : 8 * (k + width)] for k in range(max(1, n - width + 1) if n else 0)]
                    if cut:
                        yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), pa.array([item] * len(cut), pa.string())], names=["window", "item"])

    return rows.mapInArrow(released(make), "window binary, item string").distinct()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int, block_windows: int):
    """The windows of the test items, in parts of about ``block_windows``: one of them is collected at a time."""
    pairs = materialise(windows_of(benchmark, item_col=item_col, text_col=text_col, width=width), "test-windows")
    parts = max(1, -(-pairs.count() // block_windows))
    for k in range(parts):
        yield parts, TestWindows.of([tuple(r) for r in pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == k).collect()], width)


def search(index: DataFrame, benchmark: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per indexed text: doc_id, text_key, n_words, ``spans`` (the disjoint runs of words inside any window found) and
    ``items`` (the ids of the items found, sorted as strings)."""
    bounded_batches(index.sparkSession)
    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"segment long, row int, doc_id {kind}, text_key binary, n_words long, spans array<struct<start: long, end: long>>, items array<string>"
    hits = None
    for parts, tests in _blocks(benchmark, item_col, item_text_col, width, block_windows):
        sent = index.sparkSession.sparkContext.broadcast(tests)

        def scan(batches, sent=sent, whole=parts == 1):
            for batch in batches:
                for k in range(batch.num_rows):
                    yield _findings(batch.slice(k, 1), sent.value, whole)

        found = index.mapInArrow(released(scan), schema)
        if parts == 1:
            return found.drop("segment", "row")
        found = materialise(found, "findings")
        hits = found if hits is None else hits.unionByName(found)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["n_words"].iloc[0])
        inside = np.zeros(n + 1, np.int64)
        for spans in group["spans"]:
            for s in spans:
                inside[s["start"]] += 1
                inside[s["end"]] -= 1
        out = group.head(1).copy()
        out["spans"] = [_runs(np.cumsum(inside[:-1]) > 0)]
        out["items"] = [sorted({i for items in group["items"] for i in items})]
        return out

    merged = materialise(hits.groupBy("segment", "row").applyInPandas(merge, schema), "findings").select("segment", "row", "spans", "items")
    rows = index.select("segment", F.posexplode(F.arrays_zip("ids", "keys", "n_words")).alias("row", "own")).select("segment", "row", F.col("own.ids").alias("doc_id"), F.col("own.keys").alias("text_key"), F.col("own.n_words").cast("long").alias("n_words"))
    rows = rows.join(merged, ["segment", "row"], "left")
    return rows.select("doc_id", "text_key", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _runs(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]


def _findings(segment: pa.RecordBatch, tests: TestWindows, whole: bool) -> pa.RecordBatch:
    """The findings of one segment: of all its rows, or of those that have any."""
    own = {c: segment.column(c)[0] for c in segment.schema.names}
    n_words = own["n_words"].as_py()
    lists = Segment(own["terms"].as_py(), own["counts"].as_py(), own["postings"].as_py(), n_words, tests)
    w, s, row = lists.lookup()
    inside = np.zeros(lists.n + 1, np.int64)
    np.add.at(inside, s, 1)
    np.add.at(inside, s + tests.size[w], -1)
    hit = np.cumsum(inside[:-1]) > 0
    each = tests.item_at[w + 1] - tests.item_at[w]
    item = tests.item_of[np.repeat(tests.item_at[w] - (np.cumsum(each) - each), each) + np.arange(each.sum())] if len(w) else np.zeros(0, np.int64)
    items: dict[int, list[str]] = {}
    for p in np.unique(np.repeat(row, each) * len(tests.items) + item).tolist() if len(w) else ():
        items.setdefault(p // len(tests.items), []).append(tests.items[p % len(tests.items)])
    rows = list(range(len(n_words))) if whole else sorted(items)
    first = lists.row_start
    take = pa.array(rows, pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([own["segment"].as_py()] * len(rows), pa.int64()),
            take,
            own["ids"].values.take(take),
            own["keys"].values.take(take),
            pa.array([n_words[k] for k in rows], pa.int64()),
            pa.array([_runs(hit[first[k] : first[k + 1]]) if k in items else [] for k in rows], _ARROW_SPANS),
            pa.array([sorted(items.get(k, ())) for k in rows], pa.list_(pa.string())),
        ],
        names=["segment", "row", "doc_id", "text_key", "n_words", "spans", "items"],
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found, all columns kept.

    What goes is told by a hash of the text. Rows stay where they are but for the few that may go.
    """
    names = docs.columns
    found = search(build_index(docs, id_col=id_col, text_col=text_col), benchmark, item_col=item_col, item_text_col=item_text_col, width=width, block_windows=block_windows)
    bad = materialise(found.where(F.size("items") > 0).select(F.col("text_key").alias("_key")).distinct(), "contaminated")
    hashes = bad.select(F.conv(F.hex(F.substring("_key", 1, 7)), 16, 10).cast("long").alias("h"))
    test = tester(hashes, "h", bad.count()) or (lambda h: np.ones(len(h), bool))

    # one step in a worker: the key of a text that may be among the bad ones, else null
    @F.pandas_udf("binary")
    def key_of(text: pd.Series) -> pd.Series:
        keys = [_key(t) for t in text]
        some = test(np.array([int.from_bytes(k[:7]) for k in keys], np.int64)) if keys else ()
        return pd.Series([k if ok else None for k, ok in zip(keys, some, strict=True)], dtype=object)

    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    row = row.withColumn("key", key_of(F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))))
    clean = row.where(F.col("key").isNotNull()).join(bad, F.col("key") == F.col("_key"), "left_anti")
    return row.where(F.col("key").isNull()).select("row").unionByName(clean.select("row")).select(*(F.col(f"row.`{c}`").alias(c) for c in names))


def matches(index: DataFrame, benchmark: DataFrame, *, slop: int = 0, item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per occurrence of a window: phrase matches (slop 0), or proximity matches in which every term lies at most ``slop`` words from its place."""
    bounded_batches(index.sparkSession)
    kind = index.schema["ids"].dataType.elementType.simpleString()
    out = None
    for _, tests in _blocks(benchmark, item_col, item_text_col, width, block_windows):
        sent = index.sparkSession.sparkContext.broadcast(tests)

        def scan(batches, sent=sent):
            for batch in batches:
                for k in range(batch.num_rows):
                    tests, own = sent.value, {c: batch.column(c)[k] for c in batch.schema.names}
                    lists = Segment(own["terms"].as_py(), own["counts"].as_py(), own["postings"].as_py(), own["n_words"].as_py(), tests)
                    exact = set(zip(*(x.tolist() for x in lists.lookup()[:2]), strict=True)) if slop else None
                    got = []
                    for w, s, row in zip(*(x.tolist() for x in lists.lookup(slop)), strict=True):
                        at = s - int(lists.row_start[row])
                        got += [(row, tests.items[i], at, at + int(tests.size[w]), exact is None or (w, s) in exact) for i in tests.item_of[tests.item_at[w] : tests.item_at[w + 1]]]
                    columns = [pa.array([x[j] for x in got], t) for j, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_()))]
                    yield pa.RecordBatch.from_arrays([own["ids"].values.take(columns[0]), *columns[1:]], names=["doc_id", "item_id", "start", "end", "exact"])

        part = index.mapInArrow(released(scan), f"doc_id {kind}, item_id string, start long, end long, exact boolean")
        out = part if out is None else out.unionByName(part)
    return out


def item_digest(items: list[str]) -> str:
    """The digest of a set of items, as the query gives it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
