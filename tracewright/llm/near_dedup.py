"""Near duplicates by order MinHash over five-word k-mers, verified by banded alignment.

Texts with equal word sequences are one text. Every distinct text has its
occurrence-labelled k-mers; a sketch is the ``length`` k-mers that are smallest
under one hash, taken in text order. Texts that share one of ``sketches``
sketches are candidates. The similarity of two texts is that of their k-mer
sequences: with M the longest run of equal labelled k-mers in the same order, M
over the k-mers of both less M. Pairs of 0.8 or more are links; classes are the
connected components of the links.

A bucket of texts with equal sketches is not expanded into all its pairs. In two
rounds every text is compared with members of its buckets drawn by hash; links
join texts into components, and only texts in different components are compared
again. In the end, texts of one bucket that are still in different components are
compared all, those outside the bucket's largest component with every other
member of a size that allows a link. So no candidate pair that could join two
classes is left out. Pairs whose sizes rule out 0.8 are not aligned, nor are pairs
whose signatures do: 512 to 8192 parity bits of the k-mers, which differ in no more
places than the k-mers do, so that a link is never ruled out.

What can be missed: a link whose texts share none of the sketches. A sketch of 4
k-mers agrees with probability about 0.41 at 0.8, so 24 of them miss it in about 3
of a million; texts of up to 20 k-mers, where few k-mers make chances coarse, have
8 more sketches of one k-mer each, which miss such a link in under 3 of a million.

A frequent bucket, text or component never meets in one task: joins deal its rows
over several tasks by a hash (``spread_join``).

Defined results: null and empty text, and text without words, are classes of their
own. A text of fewer than five words is one k-mer of all its words. A class is
named by its smallest doc_id; null ids count as larger than all others. Ids keep
their type. Rows with equal ids keep their own rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import bounded_batches, discard, id_and_text, materialise, released, row_hash, spread_join, text_slices
from ._words import Words, mix, words_of
from .exact_dedup import lookup, marked_among, tester

K = 5
SIMILARITY = 0.8
SKETCHES, LENGTH = 24, 4
#: Texts of up to so many k-mers, and those that may be linked with one, have so many sketches of one k-mer besides.
SHORT, SHORT_SKETCHES = 16, 8
#: Sketches that the first round looks at; the second looks at all.
FIRST = 4
#: Texts that a round needs are picked by a broadcast of their keys up to so many (of 16 bytes), else by a shuffle.
PICKED = 500_000
#: Bits of a signature by the number of k-mers, and of the short one that travels with every bucket.
SIGNATURES = ((256, 512), (1024, 2048), (math.inf, 8192))
MARK = 512
#: Pairs of one bucket that one task of the last comparison looks at, about, for each of its texts.
SPREAD = 500
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def labelled_kmers(words: Words, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of all rows, in order, mixed with their occurrence number in the row; offsets of the rows."""
    count = words.counts()
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(words.n_rows), n)
    first = np.concatenate([[0], np.cumsum(count)])
    at = first[row] + np.arange(offsets[-1]) - offsets[row]
    size = np.minimum(count, k)[row]
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        use = size > j
        h[use] = mix(h[use] * _GOLD + words.hash[at[use] + j] + np.uint64(j + 1))
    # how many equal k-mers of the row come earlier
    order = np.lexsort((h, row))
    same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])])
    run = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    label = np.empty(len(order), np.uint64)
    label[order] = run.astype(np.uint64)
    return mix(h + label * _GOLD), offsets


def sketch(kmers: np.ndarray, sketches: int = SKETCHES, length: int = LENGTH, first: int = 0) -> np.ndarray:
    """The order MinHash values of one text's labelled k-mers; the orders are those numbered from ``first``."""
    salts = mix(np.arange(first + 1, first + sketches + 1, dtype=np.uint64) * _GOLD)
    out = np.zeros(sketches, np.uint64)
    for i, salt in enumerate(salts):
        # xor with a salt and a product by an odd number: a different order for each sketch
        order = (kmers ^ salt) * (salt | np.uint64(1))
        order ^= order >> np.uint64(29)
        order *= np.uint64(0xBF58476D1CE4E5B9)
        if len(order) > length:
            least = np.argpartition(order, length - 1)[:length]
            least.sort()
        else:
            least = np.arange(len(order))
        h = salt
        for x in kmers[least].tolist():
            h = ((int(h) ^ x) * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF
        out[i] = h
    return out


def sketches_of(kmers: np.ndarray, sketches: int = SKETCHES, length: int = LENGTH, least: float = SIMILARITY) -> np.ndarray:
    """All sketches of one text: the dealt ones, and for a short text those of one k-mer."""
    out = sketch(kmers, sketches, length)
    return np.concatenate([out, sketch(kmers, SHORT_SKETCHES, 1, sketches)]) if len(kmers) * least <= SHORT else out


def signature(kmers: np.ndarray, bins: int | None = None) -> np.ndarray:
    """As longs: in each of ``bins`` bins the parity of its number of k-mers; without ``bins`` as many as the length asks for."""
    bins = bins or next(b for n, b in SIGNATURES if len(kmers) <= n)
    at = (mix(kmers ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bins) & 1).astype(np.uint8)).view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two sequences of distinct k-mers if it is ``least`` or more, else 0.

    An alignment that reaches ``least`` leaves at most ``band`` k-mers out, so equal k-mers more
    than ``band`` places apart cannot be part of it and are not looked at.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    need = least * (n + m) / (1 + least)
    if min(n, m) < need - 1e-9:
        return 0.0
    if n == m and np.array_equal(a, b):
        return 1.0
    band = n + m - 2 * need
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < need - 1e-9:
        return 0.0
    near = np.abs(i - j) <= band + 1e-9
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if not len(j):
        return 0.0
    if (j[1:] > j[:-1]).all():
        match = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            p = bisect_left(tails, x)
            if p == len(tails):
                tails.append(x)
            else:
                tails[p] = x
        match = len(tails)
    similarity = match / (n + m - match)
    return similarity if similarity >= least - 1e-12 else 0.0


def _sequence_keys(words: Words) -> list[bytes]:
    """128 bits of each row's sequence of words."""
    import hashlib

    first = np.concatenate([[0], np.cumsum(words.counts())])
    return [hashlib.blake2b(words.hash[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _sketched(docs: DataFrame, id_col: str, text_col: str, least: float, sketches: int, length: int) -> DataFrame:
    """(doc_id, text_key, n, sketches, mark, signature, row_id) of every row; the key of a text without words is null."""
    rows = id_and_text(docs, id_col, text_col)

    def make(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                words = words_of(part.column("text"))
                has = (words.counts() > 0).tolist()
                kmers, offsets = labelled_kmers(words)
                own = [kmers[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([k if ok else None for k, ok in zip(_sequence_keys(words), has, strict=True)], pa.binary()),
                        pa.array([len(x) for x in own], pa.int32()),
                        pa.array([sketches_of(x, sketches, length, least).view(np.int64) if ok else None for x, ok in zip(own, has, strict=True)], pa.list_(pa.int64())),
                        *(pa.array([signature(x, bins) if ok else None for x, ok in zip(own, has, strict=True)], pa.list_(pa.int64())) for bins in (MARK, None)),
                    ],
                    names=["doc_id", "text_key", "n", "sketches", "mark", "signature"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(make), f"doc_id {kind}, text_key binary, n int, sketches array<long>, mark array<long>, signature array<long>").withColumn("row_id", F.monotonically_increasing_id())


def _texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the texts in ``wanted`` (node, doc_id): rows are found by id, then told apart by their words."""
    wanted = materialise(wanted, "near-ids")
    ids = wanted.select(F.xxhash64("doc_id").alias("h"))
    test = tester(ids, "h", wanted.count())
    rows = id_and_text(docs, id_col, text_col).select(F.xxhash64("doc_id").alias("h"), "text")
    rows = rows if test else rows.join(ids.distinct(), "h", "left_semi").select("h", "text")

    def keyed(batches):
        for batch in batches:
            if test:
                batch = batch.filter(pa.array(test(batch.column("h").to_numpy(zero_copy_only=False))))
            for part in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(_sequence_keys(words_of(part.column("text"))), pa.binary()), part.column("text")], names=["node", "text"])

    found = rows.mapInArrow(released(keyed), "node binary, text string")
    return found.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))


def _verify(pairs: DataFrame, n: int, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose alignment reaches ``least``; ``n`` is their number."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))

    def kmers_of(texts: pa.Array) -> list[np.ndarray]:
        out = []
        for part in text_slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
            h, offsets = labelled_kmers(words_of(part.column("text")))
            out += [h[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return out

    def check(batches):
        for batch in batches:
            # as many pairs at a time as their texts allow; a text that comes several times is read once
            for part in text_slices(batch, "x", "y"):
                both = pa.concat_arrays([part.column("x"), part.column("y")]).dictionary_encode()
                which, kmers = both.indices.to_numpy(), kmers_of(both.dictionary)
                m = part.num_rows
                ok = pa.array([aligned(kmers[which[i]], kmers[which[m + i]], least) > 0 for i in range(m)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(ok), part.column("b").filter(ok)], names=["a", "b"])

    both = spread_join(spread_join(pairs, left, "a", "b", n), right, "b", "a", n, counted=pairs)
    return both.select("a", "b", "x", "y").mapInArrow(released(check), "a binary, b binary")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): the smallest node connected with it.

    Large-star and small-star rounds, each of them grouped and joined by node and stored, until every
    node hangs on one root.
    """
    edges = materialise(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct(), label)
    while True:
        n = 2 * edges.count()
        both = materialise(edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y"))), label)
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        # large star: larger neighbours go to the least; then small star: smaller ones too
        large = materialise(spread_join(both, low, "x", "y", n).where("y > x").select(F.col("m").alias("u"), F.col("y").alias("v")).where("u < v").distinct(), label)
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        before, edges = edges, materialise(spread_join(large, least, "v", "u", n).select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u < v").distinct(), label)
        discard(before, both, large)
        # a root has no edge to a smaller node, any other node has one edge, to its root
        ends = edges.select(F.col("v").alias("x"), F.lit(1).alias("down")).unionByName(edges.select(F.col("u").alias("x"), F.lit(0).alias("down")).distinct())
        if ends.groupBy("x").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _fits(a: str, b: str, least: float) -> Column:
    """Sizes that allow a similarity of ``least``."""
    return F.least(a, b) >= F.lit(least - 1e-9) * F.greatest(a, b)


def _alike(a: str, b: str, an: str, bn: str, least: float) -> Column:
    """Marks that do not rule out a similarity of ``least``."""
    differ = F.lit(0)
    for i in range(MARK // 64):
        differ = differ + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return differ <= _apart(an, bn, least)


def _alike_whole(a: str, b: str, an: str, bn: str, least: float) -> Column:
    """The same of whole signatures, where both have the same length."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (F.size(a) != F.size(b)) | (differ <= _apart(an, bn, least))


def _apart(an: str, bn: str, least: float) -> Column:
    """How many k-mers of texts of that similarity differ at most; each of them changes one parity at most."""
    return F.floor((F.col(an) + F.col(bn)) * F.lit((1 - least) / (1 + least)) + 1e-6)


def _roots(texts: DataFrame, n_texts: int, docs: DataFrame, id_col: str, text_col: str, least: float, first: int = FIRST, spread: int = SPREAD) -> DataFrame:
    """(node, root) of the texts that have a link. ``texts``: node, doc_id, n, sketches, mark, signature."""
    members = texts.select("node", "doc_id", "n", "mark", F.posexplode("sketches").alias("place", "value")).select("node", "doc_id", "n", "mark", "place", F.xxhash64("place", "value").alias("bucket"))
    # most buckets hold one text: they are found by their numbers alone, and what may be in others shuffles whole
    shared = materialise(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("bucket"), "near-shared")
    members = materialise(marked_among(members, F.col("bucket"), shared, "bucket", shared.count(), "some").where("some").drop("some"), "near-members")
    drawn = [F.min(F.struct(F.xxhash64("bucket", "node", F.lit(d)).alias("h"), "node", "n", "mark")).alias(f"lead{d}") for d in (0, 1)]
    leads = members.groupBy("bucket").agg(*drawn, F.count(F.lit(1)).alias("members")).where("members > 1")
    heavy = max(100, n_texts // 10_000)
    members = materialise(lookup(members, leads, "bucket", "members", heavy), "near-buckets")
    discard(shared)
    found = materialise(_texts_of(docs, members.groupBy("node").agg(F.first("doc_id").alias("doc_id")), id_col, text_col), "near-texts")
    links, tried, roots = None, None, None

    def placed(rows: DataFrame, column: str, by: str, to: str) -> DataFrame:
        at = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
        return spread_join(rows, at, column, by, rows.count(), "left").withColumn(to, F.coalesce("_root", column)).drop("_root")

    def compare(pairs: DataFrame) -> None:
        nonlocal links, tried, roots
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "near-pairs")
        if roots is not None:
            pairs = materialise(placed(pairs, "a", "b", "p"), "near-pairs")
            pairs = materialise(placed(pairs, "b", "a", "q").where("p != q").select("a", "b"), "near-pairs")
        n = pairs.count()
        wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-wanted")
        wanted = F.broadcast(wanted) if wanted.count() <= PICKED else wanted
        more = materialise(_verify(pairs, n, found.join(wanted, "node", "left_semi"), least), "near-links")
        if roots is None or not more.isEmpty():
            # earlier links are as well stated by each text's root
            roots = components(more if roots is None else more.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))), "near-roots")
        tried = pairs if tried is None else tried.unionByName(pairs)

    def drawn_pairs(rows: DataFrame, draws: tuple[int, ...]) -> DataFrame:
        lead = F.explode(F.array(*(F.col(f"lead{d}") for d in draws))).alias("lead")
        rows = rows.select("node", "n", "mark", lead).where("node != lead.node").select("node", "n", "mark", "lead.node", "lead.n", "lead.mark").toDF("a", "an", "x", "b", "bn", "y")
        return rows.where(_fits("an", "bn", least) & _alike("x", "y", "an", "bn", least)).select("a", "b")

    compare(drawn_pairs(members.where(F.col("place") < first), (0,)))
    compare(drawn_pairs(members, (0, 1)))
    # what shares a bucket and is still apart
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(least - 1e-6)))
    at = materialise(placed(members.select("bucket", "node", "n", "mark"), "node", "bucket", "root"), "near-placed")
    parts = at.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("bucket").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("members"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    at = lookup(at, main, "bucket", "members", heavy).join(texts.select("node", "signature"), "node")
    at = materialise(at.withColumn("band", band).withColumn("deals", F.ceil(F.col("members") / spread).cast("int")), "near-open")
    x = at.where("root != main").select("bucket", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), "deals", F.col("node").alias("a"), F.col("n").alias("an"), F.col("root").alias("ar"), F.col("mark").alias("x"), F.col("signature").alias("xs"))
    x = x.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
    y = at.select("bucket", "band", F.pmod(F.xxhash64("node"), F.col("deals")).cast("int").alias("deal"), F.col("node").alias("b"), F.col("n").alias("bn"), F.col("root").alias("br"), "main", F.col("mark").alias("y"), F.col("signature").alias("ys"))
    # two outsiders meet from both sides; the order keeps one of these pairs
    apart = (F.col("ar") != F.col("br")) & ((F.col("br") == F.col("main")) | (F.col("a") < F.col("b")))
    compare(x.join(y, ["bucket", "band", "deal"]).where(apart & _fits("an", "bn", least) & _alike("x", "y", "an", "bn", least) & _alike_whole("xs", "ys", "an", "bn", least)).select("a", "b"))
    discard(members, found, at)
    return roots


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, sketches: int = SKETCHES, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, text_key, and its class: class_id and class_row (id and row
    number of the row that names it), class_size (rows) and n_texts (distinct texts)."""
    bounded_batches(docs.sparkSession)
    rows = materialise(_sketched(docs, id_col, text_col, least, sketches, length), "near-rows")
    n = rows.count()
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    texts = rows.where(F.col("text_key").isNotNull()).groupBy(F.col("text_key").alias("node")).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("n", "sketches", "mark", "signature"), first).alias("own"))
    texts = materialise(texts.select("node", "first", "copies", "own.*"), "near-distinct")
    roots = _roots(texts.select("node", F.col("first.doc_id").alias("doc_id"), "n", "sketches", "mark", "signature"), texts.count(), docs, id_col, text_col, least)
    named = materialise(texts.select("node", "first", "copies").join(roots, "node", "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root")), "near-named")
    best = named.groupBy("root").agg(F.min("first").alias("best"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n_texts"))
    heavy = max(100, n // 10_000)
    classes = lookup(named.select("node", "copies", "root"), materialise(best, "near-best"), "root", "n_texts", heavy)
    classes = materialise(classes.select(F.col("node").alias("text_key"), "copies", "best", "class_size", "n_texts"), "near-classes")
    out = lookup(rows.where(F.col("text_key").isNotNull()).select("row_id", "doc_id", "text_key"), classes, "text_key", "copies", heavy)
    out = out.select("row_id", "doc_id", "text_key", F.col("best.doc_id").alias("class_id"), F.col("best.row_id").alias("class_row"), "class_size", "n_texts")
    one = F.lit(1).cast("long")
    return out.unionByName(rows.where(F.col("text_key").isNull()).select("row_id", "doc_id", "text_key", F.col("doc_id").alias("class_id"), F.col("row_id").alias("class_row"), one.alias("class_size"), one.alias("n_texts")))


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, sketches: int = SKETCHES, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size and kept, true for one row of each class."""
    out = near_classes(docs, id_col=id_col, text_col=text_col, least=least, sketches=sketches, length=length)
    return out.select("doc_id", "class_id", "class_size", "n_texts", (F.col("row_id") == F.col("class_row")).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, all columns kept.

    What is dropped is found again by id and words, never by row number, since a scan may be dealt
    out otherwise the next time. Rows alike in both are reduced to one.
    """
    names = docs.columns
    each = near_classes(docs, id_col=id_col, text_col=text_col).where(F.col("text_key").isNotNull())
    verdict = each.groupBy("doc_id", "text_key").agg(F.max((F.col("row_id") == F.col("class_row")).cast("int")).alias("best"), F.count(F.lit(1)).alias("k"))
    verdict = materialise(verdict.where("best = 0 or k > 1").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("best").alias("_best")), "near-verdict")

    ids = verdict.select(F.xxhash64("_id").alias("h"))
    test = tester(ids, "h", verdict.count()) or (lambda h: np.ones(len(h), bool))

    # one step in a worker both picks rows and makes their keys: null where an id has no verdict
    @F.pandas_udf("binary")
    def key_of(h: pd.Series, text: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(h), dtype=object)
        some = np.flatnonzero(test(h.to_numpy()))
        if len(some):
            words = words_of(pa.array(text.iloc[some], pa.large_string()))
            out.iloc[some] = [k if ok else b"" for k, ok in zip(_sequence_keys(words), (words.counts() > 0).tolist(), strict=True)]
        return out

    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(id_col).alias("id"))
    row = row.withColumn("key", key_of(F.xxhash64("id"), F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))))
    # rows whose id has no verdict stay where they are
    alone = row.where(F.col("key").isNull()).select("row")
    judged = row.where(F.col("key").isNotNull()).join(verdict, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    alone = alone.unionByName(judged.where(F.col("_best").isNull()).select("row"))
    alike = judged.where("_best = 1").groupBy("id", "key").agg(F.min_by("row", row_hash(F.col("row"))).alias("row")).select("row")
    return alone.unionByName(alike).select(*(F.col(f"row.`{c}`").alias(c) for c in names))
