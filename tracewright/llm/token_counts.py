"""Token counts that follow edits, by a segment tree over each document's pre-tokens.

A text is cut into pre-tokens by the tokenizer's pattern; the number of tokens of
each is counted once per distinct pre-token and kept. Leaves of the tree are runs
of pre-tokens with their sums of code points and tokens; inner nodes hold sums. An
edit finds its place by descending the code point sums. It cuts anew from a
boundary before the edit, far enough that the pattern's look-ahead cannot see the
edit, until a new boundary meets an old one; only pre-tokens in between are
encoded again, and the sums above the leaves touched are updated.

Defined results: null counts as empty, which has 0 tokens. Edits with null or out
of range bounds are clipped to the text; a null replacement is empty.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import bounded_batches, id_and_text

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that goes with the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of a leaf at first; a leaf that grows to four times as many has the tree built again.
LEAF = 64
CACHE = 500_000
#: Code points beyond a boundary that the pattern may have looked at.
LOOK = 2


class Encoder:
    """Counts tokens of pre-tokens."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN)
        self.cache: dict[str, int] = {}
        self.counted = 0

    def count(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        got = list(map(self.cache.get, pieces))
        if None in got:
            got = [self.count(p) if n is None else n for p, n in zip(pieces, got, strict=True)]
        return got


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class TokenTree:
    """The pre-tokens of one text in leaves, and sums of (code points, tokens) in a tree over these."""

    def __init__(self, text: str, enc: Encoder):
        self.enc = enc
        self.reencoded = 0
        pieces = enc.cut.findall(text)
        self._build([(pieces[k : k + LEAF], enc.counts(pieces[k : k + LEAF])) for k in range(0, len(pieces), LEAF)])

    def _build(self, leaves: list[tuple[list[str], list[int]]]) -> None:
        self.leaves = leaves or [([], [])]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for k in range(len(self.leaves)):
            self._sum_leaf(k)
        for i in range(self.base - 1, 0, -1):
            self._sum_node(i)

    def _sum_leaf(self, k: int) -> None:
        pieces, counts = self.leaves[k]
        self.chars[self.base + k], self.tokens[self.base + k] = sum(map(len, pieces)), sum(counts)

    def _sum_node(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_pieces(self) -> int:
        return sum(len(p) for p, _ in self.leaves)

    def text(self) -> str:
        return "".join(x for p, _ in self.leaves for x in p)

    def _place(self, at: int) -> tuple[int, int]:
        """(leaf, code points before it) of the leaf that holds code point ``at``, the last leaf at the end."""
        i, before = 1, 0
        while i < self.base:
            i *= 2
            if at >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return min(i - self.base, len(self.leaves) - 1), before

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace code points [start, end) by ``new``."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        leaf, before = self._place(max(0, start - LOOK))
        # back to a boundary that was found without sight of the edit
        k, at = 0, before
        pieces = self.leaves[leaf][0]
        while k < len(pieces) and at + len(pieces[k]) + LOOK <= start:
            at += len(pieces[k])
            k += 1
        if k == 0 and at + LOOK > start:
            while leaf and at + LOOK > start:
                leaf -= 1
                pieces = self.leaves[leaf][0]
                k = len(pieces)
                while k and at + LOOK > start:
                    k -= 1
                    at -= len(pieces[k])
        first, keep, head = leaf, k, at
        # old boundaries from there on, and their text, as far as needed
        old: list[tuple[int, int, int]] = []  # (position in the old text, leaf, number in the leaf)
        tail: list[str] = []
        shift = len(new) - (end - start)
        where, n, j = head, leaf, k
        fresh: list[str] = []
        reach = max(64, end - start + 64)
        while True:
            # take in old text until ``reach`` code points beyond the edit, or its end
            while n < len(self.leaves) and where < end + reach:
                own = self.leaves[n][0]
                while j < len(own) and where < end + reach:
                    old.append((where, n, j))
                    tail.append(own[j])
                    where += len(own[j])
                    j += 1
                if j >= len(own):
                    n, j = n + 1, 0
            done = n >= len(self.leaves)
            window = "".join(tail)
            window = window[: start - head] + new + window[end - head :]
            bounds = {p: (m, i) for p, m, i in old if p >= end}
            fresh, pos, met = [], head, None
            limit = head + len(window)
            for m in self.enc.cut.finditer(window):
                pos = head + m.start()
                if pos - shift in bounds and pos >= start + len(new):
                    met = bounds[pos - shift]
                    break
                if not done and head + m.end() + LOOK > limit:
                    break  # this piece might be longer than the text taken in
                fresh.append(m.group())
                pos = head + m.end()
            if met or done:
                break
            reach *= 4
        last, upto = met if met else (len(self.leaves) - 1, len(self.leaves[-1][0]))
        left, right = self.leaves[first], self.leaves[last]
        counts = self.enc.counts(fresh)
        self.reencoded += len(fresh)
        merged = (left[0][:keep] + fresh + right[0][upto:], left[1][:keep] + counts + right[1][upto:])
        if len(merged[0]) > 4 * LEAF or last - first > 64:
            pieces, numbers = merged
            cut = [(pieces[a : a + LEAF], numbers[a : a + LEAF]) for a in range(0, len(pieces), LEAF)]
            self._build(self.leaves[:first] + cut + self.leaves[last + 1 :])
            return
        self.leaves[first] = merged
        for k in range(first + 1, last + 1):
            self.leaves[k] = ([], [])
        touched = set()
        for k in range(first, last + 1):
            self._sum_leaf(k)
            touched.add((self.base + k) // 2)
        while touched:
            up = set()
            for i in sorted(touched):
                if i:
                    self._sum_node(i)
                    up.add(i // 2)
            touched = up - {0}


def count_tokens(docs: DataFrame, *, ranks: str = RANKS, edits_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_pieces and n_tokens of every row; with ``edits_col``, an array of (start, end, new)
    that apply in order, also n_tokens_after, n_chars_after and n_reencoded, the pre-tokens encoded again."""
    bounded_batches(docs.sparkSession)
    edits = F.col(edits_col) if edits_col else F.lit(None).cast("array<struct<start: int, end: int, new: string>>")

    @F.pandas_udf("n_chars long, n_pieces long, n_tokens long, n_chars_after long, n_tokens_after long, n_reencoded long")
    def run(texts: pd.Series, changes: pd.Series) -> pd.DataFrame:
        enc = encoder(ranks)
        rows = []
        for text, todo in zip(texts, changes, strict=True):
            tree = TokenTree(text, enc)
            before = (tree.n_chars, tree.n_pieces, tree.n_tokens)
            for e in todo if todo is not None else ():
                tree.edit(int(e["start"] or 0), int(e["end"] or 0), e["new"] or "")
            rows.append((*before, tree.n_chars, tree.n_tokens, tree.reencoded))
        return pd.DataFrame(rows, columns=["n_chars", "n_pieces", "n_tokens", "n_chars_after", "n_tokens_after", "n_reencoded"])

    out = id_and_text(docs.withColumn("_edits", edits), id_col, text_col, "_edits").select("doc_id", run("text", "_edits").alias("r"))
    names = ["n_chars", "n_pieces", "n_tokens"] + (["n_chars_after", "n_tokens_after", "n_reencoded"] if edits_col else [])
    return out.select("doc_id", *(f"r.{n}" for n in names))
