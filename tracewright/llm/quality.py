"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few bounded or logarithmic measures. Every measure has a
lookup table over its bins, learnt by boosting shallow trees in turn over the
measures; then the pairs of measures that explain most of the rest get tables of
two dimensions, learnt the same way. A score is the sum of the tables' entries,
put through the logistic function.

The model is fitted on the driver from at most ``sample_rows`` labelled rows,
chosen by the hash of their ids; what is collected is the measures, not texts.

Defined results: null text counts as empty; empty text has measures of zero and
so gets a score as any other. Without usable labels every score is 0.5; with
labels of one kind only, the smoothed share of that kind.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import bounded_batches, fold, id_and_text

#: Labelled rows used for fitting, at most.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3

FEATURES = (
    "log_words", "mean_word", "sd_word", "distinct_words", "top_word", "repeated_neighbour", "distinct_pairs", "upper", "digit",
    "symbol", "symbol_kinds", "stop_end", "comma", "title_words", "shouted_words", "marked_words", "long_words", "lines_per_word",
    "repeated_lines", "short_lines", "white", "non_ascii", "top_symbol",
)

#: Kinds of code points below this are looked up; those above count as letters.
_TABLE_END = 0x3000
_SPACE, _UPPER, _DIGIT, _SYMBOL, _LETTER = range(5)
_KIND = np.array([_SPACE if c.isspace() else _UPPER if c.isupper() else _DIGIT if c.isdigit() else _LETTER if c.isalnum() or c == "_" else _SYMBOL for c in map(chr, range(_TABLE_END))] + [_LETTER], np.uint8)


def measures(text: str) -> list[float]:
    """The measures of one whole text, in the order of FEATURES."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, k = len(text), len(words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KIND[np.minimum(points, _TABLE_END)]
    share = np.bincount(kind, minlength=5)
    # a word lies between two edges of white space
    solid = np.concatenate([[False], kind != _SPACE, [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[::2], edge[1::2]
    sizes = end - start
    n_solid = int(sizes.sum())
    upper = np.concatenate([[0], np.cumsum(kind == _UPPER)])
    letters = upper + np.concatenate([[0], np.cumsum(kind == _LETTER)])
    n_upper, n_letters = upper[end] - upper[start], letters[end] - letters[start]
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    marks = int(share[_SYMBOL])
    symbols = np.unique(points[kind == _SYMBOL], return_counts=True)[1] if marks else np.zeros(1)
    return [
        np.log1p(k),
        n_solid / k,
        float(sizes.std()),
        len(counts) / k**0.8,
        max(counts.values()) / k,
        sum(map(str.__eq__, words, words[1:])) / k,
        len(set(zip(words, words[1:], strict=False))) / k,
        int(share[_UPPER]) / n_solid,
        int(share[_DIGIT]) / n_solid,
        marks / n_solid,
        (len(symbols) if marks else 0) / (1 + np.log1p(marks)),
        (text.count(".") + text.count("?") + text.count("!")) / k,
        text.count(",") / k,
        int(((n_upper == 1) & (kind[start] == _UPPER)).sum()) / k,
        int(((n_upper == n_letters) & (n_letters > 0)).sum()) / k,
        int((kind[end - 1] == _SYMBOL).sum()) / k,
        float((sizes > 20).mean()),
        len(lines) / k,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(len(x) < 30 for x in lines) / max(1, len(lines)),
        1 - n_solid / n,
        float((points > 127).mean()),
        float(symbols.max()) / marks if marks else 0.0,
    ]


def measure_all(texts) -> np.ndarray:
    return np.array([measures(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


@dataclass
class AdditiveModel:
    """Bin edges and tables: one per measure, and one per chosen pair of measures."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edge, x[:, j], "right")]
        if self.pairs:
            bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)]
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                out += table[bins[a], bins[b]]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Between quantiles, halfway between the values met."""
    values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)))
    return (values[1:] + values[:-1]) / 2


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """A tree over ordered bins: cut the part whose best cut gains most until it has ``leaves`` parts."""
    def gain(lo: int, hi: int):
        cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        if hi - lo < 2:
            return 0.0, lo
        left, right = (cg[:-1], ch[:-1]), (cg[-1] - cg[:-1], ch[-1] - ch[:-1])
        won = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - cg[-1] ** 2 / (ch[-1] + l2)
        k = int(np.argmax(won))
        return float(won[k]), lo + k + 1

    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*gain(*p), p) for p in parts), key=lambda x: x[0])
        if best[0] <= 1e-9:
            break
        parts.remove(best[2])
        parts += [(best[2][0], best[1]), (best[1], best[2][1])]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + l2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The best tree that cuts both ordered sides once: its gain and its four leaves as a table."""
    sums = [np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h)]

    def four(s):
        a = s[1:-1, 1:-1]
        b, c = s[1:-1, -1:] - a, s[-1:, 1:-1] - a
        return a, b, c, s[-1, -1] - a - b - c

    gs, hs = four(sums[0]), four(sums[1])
    won = sum(x ** 2 / (y + l2) for x, y in zip(gs, hs, strict=True))
    if not won.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(won)), won.shape)
    leaf = [x[i, j] / (y[i, j] + l2) for x, y in zip(gs, hs, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(won[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 48, pair_bins: int = 24, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.15, leaves: int = 3, l2: float = 2.0) -> AdditiveModel:
    """Boost in turn over the measures, then over the pairs that gain most on what is left."""
    if not len(y):
        return AdditiveModel()
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(_logit(share))
    if y.min() == y.max():
        return model
    d = x.shape[1]
    model.edges = [_edges(x[:, j], bins) for j in range(d)]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    out = np.full(len(y), model.base)
    slope = lambda: (y - (p := 1 / (1 + np.exp(-out))), np.maximum(p * (1 - p), 1e-6))
    for _ in range(rounds):
        for j in range(d):
            if not len(model.edges[j]):
                continue
            r, w = slope()
            size = len(model.tables[j])
            step = rate * _shallow(np.bincount(at[j], r, size), np.bincount(at[j], w, size), leaves, l2)
            model.tables[j] += step
            out += step[at[j]]
    model.pair_edges = [_edges(x[:, j], pair_bins) for j in range(d)]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    size = [len(e) + 1 for e in model.pair_edges]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(at[a] * size[b] + at[b], v, size[a] * size[b]).reshape(size[a], size[b])

    r, w = slope()
    gains = sorted(((_quadrants(grid(a, b, r), grid(a, b, w), l2)[0], a, b) for a in range(d) for b in range(a + 1, d)), reverse=True)
    model.pairs = [(a, b) for _, a, b in gains[:n_pairs]]
    model.pair_tables = [np.zeros((size[a], size[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            r, w = slope()
            step = rate * _quadrants(grid(a, b, r), grid(a, b, w), l2)[1]
            model.pair_tables[k] += step
            out += step[at[a], at[b]]
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, learn: Column, sample_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text, y) of at most ``sample_rows`` labelled rows that may be learnt from, by the hash of their ids.

    The chosen ids are at most ``sample_rows`` and so may be broadcast. Of an id with several labels the largest counts.
    """
    y = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    chosen = y.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    return id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "y")


def train(docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, label: str = "quality", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    bounded_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, label, learn=F.lit(True) if learn is None else learn, sample_rows=sample_rows, id_col=id_col, text_col=text_col)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def measured(text: pd.Series) -> pd.Series:
        return pd.Series(list(measure_all(text).astype(np.float32)))

    got = rows.select(measured("text").alias("x"), "y").toPandas()
    # rows come in any order; sums of floats should not
    x = np.stack(got["x"].to_numpy()).astype(np.float64) if len(got) else np.zeros((0, len(FEATURES)))
    y = got["y"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def scorer(docs: DataFrame, model: AdditiveModel):
    """A column function from text to score."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(measure_all(text.fillna("")).astype(np.float32).astype(np.float64)))

    return score


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held: int = 0, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learns from the rows that are not held out."""
    held_out = lambda c: fold(F.col(c), folds) == held
    model = train(docs, labels, learn=~held_out("doc_id"), sample_rows=sample_rows, id_col=id_col, text_col=text_col)
    rows = id_and_text(docs, id_col, text_col)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), scorer(docs, model)("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns kept."""
    model = train(docs, labels, sample_rows=sample_rows, id_col=id_col, text_col=text_col)
    return docs.where(scorer(docs, model)(F.col(text_col)) >= threshold)
