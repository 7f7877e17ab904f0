"""Toxicity by class-conditional Kneser-Ney models over the bytes of words.

Two models, of toxic and of ordinary texts, predict each byte of a word from up
to ``depth`` bytes before it in that word. Each keeps its own counts of its
longest contexts and discounts them; what discounting frees is shared out by
backoff models that both have in common, built from Kneser-Ney continuation
counts of both classes, so that rare expressions differ little between them.

Texts are compared by length-normalised log-likelihoods: the mean log-ratio per
byte of the whole text, and the log-ratios of its most toxic words, which a
long text would hide. A logistic function, fitted on rows that the models have
not counted, turns these into a score.

All labelled rows that may be learnt from are counted, except those kept for the
logistic function; of these at most ``sample_rows`` are used. All grams and contexts
met are kept, however rare; the tables grow with the input.

Defined results: null text counts as empty; text without words has log-ratios of
0 and the score that belongs to them. Without labels of both kinds every score
is the smoothed share of toxic labels.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._contexts import Block, find, grams, mask, row_sums, sum_grams, tally
from ._util import bounded_batches, fold, materialise, text_slices
from ._words import spans_of

DEPTH = 4
#: (kind, gram) rows that a task holds as tables at once; with more, blocks of contexts take turns over the different words.
BLOCK_ROWS = 2_000_000
#: Text bytes whose grams are looked up at once.
SLICE = 2 << 20
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
#: Labels (an id and a bit) are broadcast up to so many; with more, texts are joined with them by a shuffle.
BROADCAST_ROWS = 1_000_000
#: The symbol at the end of each word; no byte of a word has this value.
END = 1
#: The most toxic words of a text that the score sees.
TOP = 3


def word_symbols(column: pa.Array):
    """The bytes of all words, each closed by END; the offsets of the words; the row of each symbol."""
    data, start, end, row = spans_of(column)
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size + 1)])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size + 1)
    out = data[np.minimum(at, max(0, len(data) - 1))] if len(data) else np.zeros(0, np.uint8)
    out[offsets[1:] - 1] = END
    return out, offsets, np.repeat(row, size + 1)


def _discount(n1: int, n2: int) -> float:
    return float(min(0.95, max(0.1, n1 / (n1 + 2 * n2)))) if n1 else 0.5


def _cut(counts: np.ndarray) -> float:
    return _discount((counts == 1).sum(), (counts == 2).sum())


@dataclass
class Corpus:
    """What the tables of a block need to know of all blocks: the counts of both kinds after contexts of one symbol at most,
    how many symbols precede these, and the discounts by length of context: of continuations, ordinary and toxic counts."""

    low: tuple[np.ndarray, np.ndarray, np.ndarray]  # two symbols, and their counts in each kind
    before: np.ndarray  # for each of ``low``, how many different symbols precede both
    cuts: list[tuple[float, float, float]] | None  # None: one block holds everything


def corpus_of(gram: np.ndarray, counts: list[np.ndarray]) -> Corpus:
    """From the grams of the only block."""
    low = tally(gram & mask(2), *counts)
    wide = np.unique(gram & mask(3)) & mask(2)
    return Corpus(low, tally(wide, np.ones(len(wide)))[1], None)


def corpus_by_spark(summed: DataFrame, depth: int) -> Corpus:
    """The same, and the discounts, from the stored grams of all blocks."""
    newest = lambda symbols: F.col("gram").bitwiseAND(F.lit((1 << (8 * symbols)) - 1)).alias("gram")
    got = summed.groupBy(newest(2)).agg(*(F.sum(F.when(F.col("kind") == y, F.col("n")).otherwise(0)).alias(f"c{y}") for y in range(2)))
    preceding = lambda d: summed.select(newest(d + 2)).distinct().groupBy(newest(d + 1)).agg(F.count(F.lit(1)).alias("n"))
    got = got.join(preceding(1), "gram").toPandas().sort_values("gram")
    once = lambda k: F.sum((F.col("n") == k).cast("long")).alias(f"n{k}")
    cuts = []
    for d in range(depth + 1):
        own = {r["kind"]: r for r in summed.groupBy("kind", newest(d + 1)).agg(F.sum("n").alias("n")).groupBy("kind").agg(once(1), once(2)).collect()}
        cont = preceding(d).agg(once(1), once(2)).first() if d < depth else {"n1": 1, "n2": 0}
        cuts.append(tuple(_discount(r["n1"], r["n2"]) for r in (cont, own[0], own[1])))
    return Corpus((got["gram"].to_numpy(np.uint64), got["c0"].to_numpy(np.float64), got["c1"].to_numpy(np.float64)), got["n"].to_numpy(np.float64), cuts)


@dataclass
class Level:
    """Contexts of one length and all that was met after them, as sorted arrays; what was not met follows by backoff."""

    gram: np.ndarray  # context and symbol
    ratio: np.ndarray  # ln P(symbol | context, toxic) - ln P(symbol | context, ordinary)
    shared: np.ndarray  # P of the model that both kinds back off to
    context: np.ndarray
    freed: np.ndarray  # by context: the share that goes to the shorter context, of the shared model, of ordinary and of toxic texts


def levels_of(gram: np.ndarray, counts: list[np.ndarray], corpus: Corpus, depth: int, size: int) -> list[Level]:
    """The tables of a block from its grams (in order, each once, with the counts of both kinds)."""
    out: list[Level] = []
    for d in range(depth + 1):
        if d == 0:
            g, c0, c1 = tally(corpus.low[0] & mask(1), *corpus.low[1:])
            cont = tally(corpus.low[0] & mask(1), np.ones(len(corpus.low[0])))[1]
        elif d == 1:
            (g, c0, c1), cont = corpus.low, corpus.before
        else:
            g, c0, c1 = tally(gram & mask(d + 1), *counts)
            wide = np.unique(gram & mask(min(d + 2, depth + 1))) & mask(d + 1)
            cont = tally(wide, np.ones(len(wide)))[1]
        context, first, of = np.unique(g >> np.uint64(8), return_index=True, return_inverse=True)
        below = out[-1].shared[find(out[-1].gram, g & mask(d))[0]] if d else np.full(len(g), 1 / size)
        cuts = corpus.cuts[d] if corpus.cuts else (_cut(cont), _cut(c0), _cut(c1))
        probability, freed = [], []
        for c, cut in zip((cont, c0, c1), cuts, strict=True):
            n = np.add.reduceat(c, first) if len(c) else c
            share = (np.add.reduceat(np.minimum(c, cut), first) if len(c) else c) / np.maximum(n, 1e-9)
            p = (np.maximum(c - cut, 0)) / np.maximum(n, 1e-9)[of] + share[of] * below
            # a kind that never met the context takes the shared model
            probability.append(np.where(n[of] > 0, p, probability[0]) if probability else p)
            freed.append(np.where(n > 0, share, freed[0]) if freed else share)
        ratio = np.log(np.maximum(probability[2], 1e-12)) - np.log(np.maximum(probability[1], 1e-12))
        out.append(Level(g, ratio.astype(np.float32), probability[0], context, np.stack(freed, axis=1)))
    return out


def log_ratios(levels: list[Level], gram: np.ndarray, size: int) -> np.ndarray:
    """The log-ratio of each of some different grams, by the longest context that training met."""
    out = np.zeros(len(gram), np.float32)
    todo = np.arange(len(gram))
    shares = np.ones((len(gram), 2))
    inside = np.zeros(len(gram), bool)  # a longer context was met, without this symbol

    def settle(k, shared):
        out[k] = np.log(np.maximum(shares[k, 1] * shared, 1e-12)) - np.log(np.maximum(shares[k, 0] * shared, 1e-12))

    for d in range(len(levels) - 1, -1, -1):
        level, wanted = levels[d], gram[todo] & mask(d + 1)
        i, met = find(level.gram, wanted)
        late = inside[todo]
        out[todo[met & ~late]] = level.ratio[i[met & ~late]]
        settle(todo[met & late], level.shared[i[met & late]])
        todo, late, wanted = todo[~met], late[~met], wanted[~met]
        i, met = find(level.context, wanted >> np.uint64(8))
        k, freed, late = todo[met], level.freed[i[met]], late[met]
        shares[k] *= np.where(late[:, None], freed[:, :1], freed[:, 1:])
        inside[k] = True
    settle(todo, 1 / size)
    return out


@dataclass
class RatioModel:
    alphabet: np.ndarray  # byte -> symbol: itself, or EDGE if never met
    size: int
    depth: int
    blocks: list[Block]
    levels: list[Level] | None  # the tables of the only block; with several, they are made when used
    corpus: Corpus
    summed: DataFrame | None = None
    weights: np.ndarray | None = None

    def table(self, block: Block) -> list[Level]:
        rows = block.rows(self.summed).groupBy("gram").agg(*(F.sum(F.when(F.col("kind") == y, F.col("n")).otherwise(0)).alias(f"c{y}") for y in range(2))).toPandas().sort_values("gram")
        return levels_of(rows["gram"].to_numpy(np.uint64), [rows["c0"].to_numpy(np.float64), rows["c1"].to_numpy(np.float64)], self.corpus, self.depth, self.size)

    def sendable(self) -> RatioModel:
        return replace(self, summed=None)

    def word_values(self, column: pa.Array, levels: list[Level], block: Block):
        """The log-ratio of each word, as far as its contexts are in the block; the offsets of words, the row of each symbol."""
        data, offsets, row = word_symbols(column)
        if not len(data):
            return np.zeros(0), offsets, row
        gram, at = np.unique(grams(self.alphabet[data], offsets, self.depth), return_inverse=True)
        value = log_ratios(levels, gram, self.size)
        if block.parts > 1:
            value[~block.holds(gram)] = 0
        return row_sums(value[at], offsets), offsets, row

    def features(self, column: pa.Array) -> np.ndarray:
        """Per text: the mean log-ratio per byte, and the log-ratios of its TOP most toxic words."""
        n = len(column)
        word, offsets, row = self.word_values(column, self.levels, self.blocks[0])
        out = np.zeros((n, 1 + TOP))
        if not len(word):
            return out
        of = row[offsets[:-1]]
        size = np.bincount(row, minlength=n)
        out[:, 0] = np.bincount(of, word, n) / np.maximum(size, 1)
        # words by row, most toxic first
        order = np.lexsort((-word, of))
        first = np.searchsorted(of[order], np.arange(n))
        count = np.bincount(of, minlength=n)
        for k in range(TOP):
            has = np.flatnonzero(count > k)
            out[has, 1 + k] = word[order[first[has] + k]]
        return out

    def scored(self, rows: DataFrame) -> DataFrame:
        """The logistic function of x, over the columns of ``_design``."""
        w = [float(v) for v in self.weights]
        x = [F.col("x")[k] for k in range(1 + TOP)]
        bounded = [F.greatest(F.lit(-5.0), F.least(F.lit(12.0), v)) for v in x[1:]]
        z = sum((F.lit(v) * c for v, c in zip(w[2:], bounded, strict=True)), F.lit(w[0]) + F.lit(w[1]) * x[0] * 10)
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
        return rows.select("doc_id", "held_out", (1 / (1 + F.exp(-z))).alias("score"), x[0].alias("log_ratio"))


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x[:, 0] * 10, np.clip(x[:, 1:], -5, 12)])


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Newton's method with a small ridge."""
    a = _design(x)
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ a + l2 * np.eye(len(w)), a.T @ (y - p) - l2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def model_of(summed: DataFrame, depth: int = DEPTH, block_rows: int = BLOCK_ROWS) -> RatioModel | None:
    """The model of all stored grams; None without grams of both kinds."""
    sizes = {r["kind"]: r["n"] for r in summed.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    parts = -(-sum(sizes.values()) // block_rows)
    blocks = [Block((0, 1), parts, k) for k in range(parts)]
    model = RatioModel(np.zeros(256, np.uint8), 0, depth, blocks, None, None, summed)
    if parts > 1:
        model.corpus = corpus_by_spark(summed, depth)
    else:
        rows = summed.toPandas()
        gram, *counts = tally(rows["gram"].to_numpy(np.uint64), *(rows["n"].where(rows["kind"] == y, 0).to_numpy(np.float64) for y in range(2)))
        model.corpus = corpus_of(gram, counts)
    met = np.unique(model.corpus.low[0] & mask(1)).astype(np.int64)
    model.alphabet[met] = met
    model.size = len(met) + 1
    if parts == 1:
        model.levels = levels_of(gram, counts, model.corpus, depth, model.size)
    return model


def features(rows: DataFrame, carry: str, model: RatioModel) -> DataFrame:
    """The columns ``carry`` of ``rows``, and x, the features of their texts."""
    names = [x.split()[0] for x in carry.split(", ")]
    spark = rows.sparkSession
    if model.levels is not None:
        sent = spark.sparkContext.broadcast(model.sendable())

        def measure(batches):
            for batch in batches:
                for part in text_slices(batch, "text", limit=SLICE):
                    x = sent.value.features(part.column("text"))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(list(x), pa.list_(pa.float64()))], names=[*names, "x"])

        return rows.select(*names, "text").mapInArrow(measure, f"{carry}, x array<double>")

    # tables too large for a task: each block rates the different words, and the words' sums go to the texts
    def split(batches):
        for batch in batches:
            for part in text_slices(batch, "text", limit=SLICE):
                data, start, end, row = spans_of(part.column("text"))
                raw = data.tobytes()
                found = Counter(zip(row.tolist(), (raw[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)), strict=True))
                found.update(dict.fromkeys(((k, None) for k in set(range(part.num_rows)) - set(row.tolist())), 1))
                at = pa.array([k for k, _ in found], pa.int64())
                word = pa.array([w for _, w in found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("row", *names)), word, pa.array(list(found.values()), pa.int64())], names=["row", *names, "word", "k"])

    words = materialise(rows.select(F.monotonically_increasing_id().alias("row"), *names, "text").mapInArrow(split, f"row long, {carry}, word string, k long"), "toxicity-words")
    different = materialise(words.select(F.col("word").alias("text")).where("text is not null").distinct(), "toxicity-vocabulary")
    rated = []
    for block in model.blocks:
        sent = spark.sparkContext.broadcast((model.sendable(), model.table(block), block))

        def rate(batches, sent=sent):
            m, levels, block = sent.value
            for batch in batches:
                for part in text_slices(batch, "text", limit=SLICE):
                    yield pa.RecordBatch.from_arrays([part.column("text"), pa.array(m.word_values(part.column("text"), levels, block)[0])], names=["word", "v"])

        rated.append(materialise(different.mapInArrow(rate, "word string, v double"), "toxicity-rated"))
        sent.unpersist()
    value = reduce(DataFrame.union, rated).groupBy("word").agg(F.sum("v").alias("v"))
    top = F.slice(F.sort_array(F.flatten(F.collect_list(F.when(F.col("v").isNotNull(), F.array_repeat("v", F.least("k", F.lit(TOP)).cast("int"))))), False), 1, TOP)
    whole = F.coalesce(F.sum(F.col("k") * F.col("v")) / F.sum(F.col("k") * (F.octet_length("word") + 1)), F.lit(0.0))
    got = words.join(value, "word", "left").groupBy("row", *names).agg(whole.alias("mean"), top.alias("top"))
    return got.select(*names, F.slice(F.concat(F.array("mean"), "top", F.array_repeat(F.lit(0.0), TOP)), 1, 1 + TOP).alias("x"))


def label_rows(labels: DataFrame, label: str, learn: Column, id_col: str) -> DataFrame:
    """(doc_id, kind) of the ids that may be learnt from; of an id with several labels the largest counts."""
    y = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("kind")).where(F.col("kind").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    return y.groupBy("doc_id").agg(F.max("kind").alias("kind"))


def train(docs: DataFrame, kinds: DataFrame, *, depth: int = DEPTH, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> RatioModel | float:
    """Learn from the texts of ``docs`` (doc_id, text) whose ids are in ``kinds`` (doc_id, kind): a model, or the
    smoothed share of toxic rows where one kind is missing. Texts stay where they are as long as the ids can be broadcast."""
    bounded_batches(docs.sparkSession)
    kinds = materialise(kinds, "toxicity-labels")
    kept = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(5)) == 0
    learnt = kinds.where(~kept)
    chosen = kinds.where(kept).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    few = kinds.count() <= broadcast_rows
    texts = lambda ids: docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids) if few else ids, "doc_id").select("kind", "text")
    model = model_of(sum_grams(texts(learnt), word_symbols, depth), depth, block_rows)
    chosen = texts(chosen)
    got = (chosen.withColumn("x", F.array()) if model is None else features(chosen, "kind int", model)).select("kind", "x").toPandas()
    y = got["kind"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max() or model is None:
        return float((y.sum() + 1) / (len(y) + 2))
    x = np.stack(got["x"].to_numpy())
    order = np.lexsort((*x.T, y))
    model.weights = fit_logistic(x[order], y[order])
    return model


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held: int = 2, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted and the mean log-ratio of every row; learns from rows not held out."""
    bounded_batches(docs.sparkSession)
    kinds = label_rows(labels, label, fold(F.col("doc_id"), folds) != held, id_col)
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), kinds, sample_rows=sample_rows, block_rows=block_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), folds) == held).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if isinstance(model, float):
        got = rows.select("doc_id", "held_out", F.lit(model).alias("score"), F.lit(0.0).alias("log_ratio"))
    else:
        got = model.scored(features(rows, "doc_id long, held_out boolean", model))
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
