"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of up to ``depth`` bytes with escape
probabilities, frozen after training and stored as sorted arrays; a text's exact code length in bits is the sum of the costs of its bytes under
each language, and the language with the shortest code wins.

Statistics are gathered from every training row by distributed counts, and every
context met is kept; the trees grow with the input. What a task holds at once is
bounded by ``block_rows``: larger trees are split into blocks that code the texts
in turn.

Probabilities follow method D: of a context met n times with d distinct symbols,
a symbol met c times has (2c - 1) / 2n and escape d / 2n, shared out over the
symbols not met there in proportion to the next shorter context.

Defined results: null text and text without a letter give ``und`` with score 0;
without any training row every text does. Ties go to the language first in order.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._contexts import Block, find, grams, mask, row_sums, sum_grams, tally
from ._util import bounded_batches, fold, materialise, text_slices
from ._words import text_bytes

DEPTH = 4
#: (lang, gram) rows that a task holds as tables at once; with more, blocks of languages and contexts code the texts in turn.
BLOCK_ROWS = 1_200_000
#: Of these, the driver reads so many at a time.
FETCH_ROWS = 300_000
#: Text bytes whose grams are looked up at once.
SLICE = 2 << 20
#: The bits of a symbol at most (a probability of 1e-30).
LARGEST = np.float32(99.66)
UNKNOWN = "und"
#: The score is the share of the best code among all, for a text of at most so many bytes at its mean cost.
EVIDENCE_BYTES = 64


def raw_symbols(column: pa.Array):
    data, offsets = text_bytes(column)
    return data, offsets, np.repeat(np.arange(len(column)), np.diff(offsets))


@dataclass
class Level:
    """The contexts of one language and length, and what followed them, as sorted arrays, in bits."""

    gram: np.ndarray  # context and symbol
    cost: np.ndarray
    context: np.ndarray
    escape: np.ndarray  # the cost of going to the shorter context for a symbol not met here


def levels_of(gram: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray], depth: int, size: int) -> list[Level]:
    """The tables of a block of one language, from its grams and, of all blocks, the counts of two symbols (``low``)."""
    out: list[Level] = []
    shorter = None
    for d in range(depth + 1):
        g, c = tally(low[0] & mask(d + 1), low[1]) if d < 2 else tally(gram & mask(d + 1), n)
        context, first, of = np.unique(g >> np.uint64(8), return_index=True, return_inverse=True)
        below = shorter[find(out[-1].gram, g & mask(d))[0]] if d else np.full(len(g), 1 / size)
        total = np.add.reduceat(c, first) if len(c) else c
        different = np.bincount(of, minlength=len(context))
        left = np.maximum(1 - (np.add.reduceat(below, first) if len(c) else c), 0)
        left[(different == size) | (left < 1e-12)] = 0
        own = (2 * c - 1) / (2 * total[of])
        # where every symbol was met nothing escapes
        own /= np.where(left > 0, 1, np.bincount(of, own, len(context)))[of]
        with np.errstate(divide="ignore"):
            escape = -np.log2(np.where(left > 0, different / (2 * total) / np.maximum(left, 1e-300), 0))
        out.append(Level(g, -np.log2(own).astype(np.float32), context, np.minimum(escape, LARGEST).astype(np.float32)))
        shorter = own
    return out


def gram_costs(levels: list[Level], gram: np.ndarray, size: int) -> np.ndarray:
    """The bits of the newest symbol of each of some different grams under one language."""
    out = np.zeros(len(gram), np.float32)
    todo = np.arange(len(gram))
    for d in range(len(levels) - 1, -1, -1):
        level, wanted = levels[d], gram[todo] & mask(d + 1)
        i, met = find(level.gram, wanted)
        out[todo[met]] += level.cost[i[met]]
        todo, wanted = todo[~met], wanted[~met]
        i, met = find(level.context, wanted >> np.uint64(8))
        out[todo[met]] += level.escape[i[met]]
    out[todo] += np.float32(np.log2(size))
    return np.minimum(out, LARGEST)


def _by_kind(counted: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    rows = counted.select("kind", "gram", "n").toArrow()
    kind, gram, n = (rows.column(c).to_numpy() for c in ("kind", "gram", "n"))
    return {int(k): tally(gram[kind == k].view(np.uint64), n[kind == k].astype(np.float64)) for k in np.unique(kind)}


@dataclass
class Trees:
    """The trees of all languages: blocks of grams, and the tables of the only block."""

    languages: list[str]
    alphabet: np.ndarray  # byte -> symbol: itself, or EDGE if never met
    size: int
    depth: int
    blocks: list[Block]
    summed: DataFrame | None  # (kind, gram, n)
    sizes: dict[int, int]  # rows of ``summed`` by kind
    tables: dict[int, list[Level]] | None = None

    def table(self, block: Block) -> dict[int, list[Level]]:
        """The tables of a block by language."""
        none = np.zeros(0, np.uint64), np.zeros(0)
        out: dict[int, list[Level]] = {}
        # a few languages at a time, for the driver's memory
        for some in blocks_of({k: min(self.sizes[k], FETCH_ROWS) for k in block.kinds}, FETCH_ROWS) if block.parts == 1 else [block]:
            own = _by_kind(some.rows(self.summed))
            if block.parts > 1:
                two = F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("gram")
                low = _by_kind(replace(block, parts=1, part=0).rows(self.summed).groupBy("kind", two).agg(F.sum("n").alias("n")))
            else:
                low = {k: tally(g & mask(2), n) for k, (g, n) in own.items()}
            for k in some.kinds:
                out[k] = levels_of(*own.get(k, none), low.get(k, none), self.depth, self.size)
        return out

    def sendable(self, tables: dict[int, list[Level]] | None) -> Trees:
        return replace(self, summed=None, tables=tables)

    def code_lengths(self, column: pa.Array, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text under each language of a block, as far as its contexts are there; the texts' numbers of bytes."""
        data, offsets = text_bytes(column)
        gram, at = np.unique(grams(self.alphabet[data], offsets, self.depth), return_inverse=True)
        bits = np.zeros((len(column), len(block.kinds)))
        away = ~block.holds(gram) if block.parts > 1 else None
        for j, kind in enumerate(block.kinds):
            cost = gram_costs(self.tables[kind], gram, self.size)
            if away is not None:
                cost[away] = 0
            bits[:, j] = row_sums(cost[at], offsets)
        return bits, np.diff(offsets)

    @property
    def bits(self) -> np.ndarray:
        """The costs of every symbol after every context met, by context, symbol and language; for small models."""
        met = np.flatnonzero(self.alphabet).astype(np.uint64)
        symbols = np.concatenate([np.zeros(1, np.uint64), met])
        every = np.unique(self.summed.select("gram").toPandas()["gram"].to_numpy(np.uint64) >> np.uint64(8))
        gram = ((every[:, None] << np.uint64(8)) | symbols).reshape(-1)
        out = np.zeros((len(gram), len(self.languages)))
        for block in self.blocks:
            for kind, levels in self.table(block).items():
                out[:, kind] += np.where(block.holds(gram), gram_costs(levels, gram, self.size), 0)
        return out.reshape(len(every), len(symbols), -1)


def blocks_of(sizes: dict[int, int], block_rows: int) -> list[Block]:
    """Languages in order, several to a block as far as they fit; a language too large for one is split by contexts."""
    out: list[Block] = []
    held: list[int] = []
    for kind in sorted(sizes):
        if held and sum(sizes[k] for k in held) + sizes[kind] > block_rows:
            out.append(Block(tuple(held)))
            held = []
        if sizes[kind] > block_rows:
            parts = -(-sizes[kind] // block_rows)
            out += [Block((kind,), parts, k) for k in range(parts)]
        else:
            held.append(kind)
    return [*out, Block(tuple(held))] if held else out


def train(rows: DataFrame, *, depth: int = DEPTH, block_rows: int = BLOCK_ROWS, max_contexts: int | None = None) -> Trees | None:
    """Learn from ``rows`` (lang, text): all of them, and every lang met. ``max_contexts`` lowers what a block holds, not what is learnt."""
    bounded_batches(rows.sparkSession)
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not languages:
        return None
    kinds = rows.sparkSession.createDataFrame(list(enumerate(languages)), "kind int, lang string")
    summed = sum_grams(rows.join(F.broadcast(kinds), "lang").select("kind", "text"), raw_symbols, depth)
    # a language with only empty texts has no grams; its code is that of no knowledge
    sizes = dict.fromkeys(range(len(languages)), 0) | {r["kind"]: r["n"] for r in summed.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    alphabet = np.zeros(256, np.uint8)
    used = [r["s"] for r in summed.select(F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("s")).distinct().collect()]
    alphabet[used] = used
    model = Trees(languages, alphabet, len({0, *used}), depth, blocks_of(sizes, min(block_rows, max_contexts or block_rows)), summed, sizes)
    if len(model.blocks) == 1:
        model.tables = model.table(model.blocks[0])
    return model


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])


def score_of(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    gap = (bits - bits.min(axis=1, keepdims=True)) / np.maximum(size, 1)[:, None] * np.minimum(size, EVIDENCE_BYTES)[:, None]
    return 1 / np.exp2(-gap).sum(axis=1)


def identify(docs: DataFrame, model: Trees | None, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    languages = model.languages

    def judged(part, bits, size):
        n, letter = part.num_rows, part.column("letter").to_numpy(zero_copy_only=False).astype(bool)
        k = bits.argmin(axis=1)
        best = [languages[i] if ok else UNKNOWN for i, ok in zip(k.tolist(), letter.tolist(), strict=True)]
        score = np.where(letter, score_of(bits, size), 0.0)
        rate = np.where(letter, bits[np.arange(n), k] / np.maximum(size, 1), 0.0)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(best, pa.string()), pa.array(score), pa.array(rate)], names=SCHEMA.names)

    if len(model.blocks) == 1:
        sent = spark.sparkContext.broadcast(model.sendable(model.tables))

        def judge(batches):
            trees = sent.value
            for batch in batches:
                for part in text_slices(batch, "text", limit=SLICE):
                    yield judged(part, *trees.code_lengths(part.column("text"), trees.blocks[0]))

        return rows.mapInArrow(judge, SCHEMA)

    # trees too large for a task: each block codes all texts in turn, and the bits of a text are added up
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "language-texts")
    coded = []
    for block in model.blocks:
        sent = spark.sparkContext.broadcast((model.sendable(model.table(block)), block))

        def code(batches, sent=sent):
            trees, block = sent.value
            for batch in batches:
                for part in text_slices(batch, "text", limit=SLICE):
                    bits, _ = trees.code_lengths(part.column("text"), block)
                    yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.full(len(bits), block.kinds[0], np.int32)), pa.array(list(bits), pa.list_(pa.float64()))], names=["row", "kind", "bits"])

        coded.append(materialise(rows.select("row", "text").mapInArrow(code, "row long, kind int, bits array<double>"), "language-bits"))
        sent.unpersist()
    # parts of one language have one cost each; blocks of several languages come once
    added = reduce(DataFrame.union, coded).groupBy("row", "kind").agg(F.collect_list("bits").alias("b"))
    added = added.select("row", "kind", F.when(F.size("b") == 1, F.col("b")[0]).otherwise(F.array(F.aggregate("b", F.lit(0.0), lambda s, x: s + x[0]))).alias("bits"))
    added = added.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("kind", "bits"))), lambda x: x["bits"])).alias("bits"))
    texts = rows.select("row", "doc_id", "held_out", "letter", F.octet_length("text").alias("size"))

    def choose(batches):
        for batch in batches:
            if batch.num_rows:
                bits = np.stack(batch.column("bits").to_numpy(zero_copy_only=False))
                yield judged(batch, bits, batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64))

    return texts.join(added, "row").mapInArrow(choose, SCHEMA)


def classify(docs: DataFrame, *, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Learn from the rows that are not held out, and identify the language of every row."""
    held_out = fold(F.col(id_col), folds) == held
    model = train(docs.where(~held_out).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), block_rows=block_rows)
    return identify(docs, model, held_out, id_col=id_col, text_col=text_col)
