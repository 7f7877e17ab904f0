"""SentencePiece encoding and decoding: the n best segmentations over the piece lattice.

The lattice of a text has an arc for every piece of the model that matches; its
weight is the piece's own score. Scores from a forward Viterbi pass are exact
heuristics for an A* search that runs backward from the end, which therefore
yields segmentations in order of total score.

A text falls apart at places that no piece crosses: before a space that follows
something else, and around characters without a piece. Such chunks are searched
once each. The n best segmentations of a text can differ from its best one only
in the n - 1 chunks with the least loss to their second best (and repeats of
them), so only these are searched further, and their lists are merged.

Characters without a piece become byte pieces where the model has them, else the
unknown piece. So do literal U+2581 characters, which otherwise stand for spaces;
decoding gives the text back exactly with byte pieces. Defined results: null
counts as empty; the empty text has one segmentation, of no pieces. Ties come in
a fixed order.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import bounded_batches, id_and_text, released, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
SPACE = "▁"
#: Chunks whose results a worker keeps.
CACHE = 200_000
#: New chunks that are searched together; longer ones than _WIDE are searched alone.
_MANY, _WIDE = 5_000, 64
#: Bytes of text that are searched together.
_TOGETHER = 1 << 18
_INF = float("inf")
_MARK = "\x00"  # stands for a literal U+2581 while a text is cut; a NUL has no piece either


class Lattice:
    """A model's pieces with their scores, and searches over them."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int] | None, unknown: int):
        self.byte_ids, self.unknown = byte_ids, unknown
        #: Pieces with (score, ids).
        self.pieces: dict[str, tuple[float, tuple[int, ...]]] = {p: (score, (i,)) for p, (i, score) in pieces.items()}
        self.byte_of = {i: b for b, i in enumerate(byte_ids or [])}
        #: The text of pieces, and of byte pieces that are a character.
        self.plain = {i: p.replace(SPACE, " ") for p, (i, _) in pieces.items()} | {i: chr(b) for i, b in self.byte_of.items() if b < 0x80}
        #: Less than any piece: a character without a piece is no cheaper than one that has a piece.
        self.floor = min((s for _, s in pieces.values() if s > -1e8), default=0.0) - 10.0
        self.known = {p for p in pieces if len(p) == 1}
        self.forget()
        self.lists: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}
        self.longest = max(map(len, pieces), default=1)
        self._trie = None

    def forget(self) -> None:
        """Empty the cache: the number of every chunk, and by that number its best score, its loss to the second best, and where its ids are in the pool."""
        self.index: dict[str, int] = {}
        self.score, self.loss, self.at, self.count = (np.zeros(0, t) for t in (np.float64, np.float64, np.int64, np.int64))
        self.pool = np.zeros(0, np.int32)

    def put(self, chunks: list[str], score, loss, count, ids) -> None:
        at = len(self.pool) + np.cumsum(count) - count
        self.index.update(zip(chunks, range(len(self.index), len(self.index) + len(chunks)), strict=True))
        for name, more in (("score", score), ("loss", loss), ("at", at), ("count", count), ("pool", ids)):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.asarray(more, old.dtype)]))

    def held(self, chunk: str) -> tuple[float, tuple[int, ...], float]:
        """What the cache has of a chunk, as ``chunk`` gives it."""
        k = self.index[chunk]
        return (float(self.score[k]), tuple(self.pool[self.at[k] : self.at[k] + self.count[k]].tolist()), float(self.loss[k]))

    @classmethod
    def load(cls, path: str) -> Lattice:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, own = {}, [-1] * 256
        for i in range(sp.vocab_size()):
            if sp.is_byte(i):
                own[int(sp.id_to_piece(i)[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[sp.id_to_piece(i)] = (i, sp.get_score(i))
        return cls(pieces, own if min(own) >= 0 else None, sp.unk_id())

    def arcs(self, chunk: str) -> list[tuple[int, int, float, tuple[int, ...]]]:
        """All arcs (start, end, score, ids), by start."""
        out = []
        get, n = self.pieces.get, len(chunk)
        for start in range(n):
            for end in range(start + 1, min(n, start + self.longest) + 1):
                if (hit := get(chunk[start:end])) is not None:
                    out.append((start, end, *hit))
            if chunk[start] not in self.known:
                out.append((start, start + 1, self.floor, self.fallback(chunk[start])))
        return out

    def fallback(self, c: str) -> tuple[int, ...]:
        if self.byte_ids is None:
            return (self.unknown,)
        return tuple(self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass"))

    @staticmethod
    def forward(arcs, n: int) -> tuple[list[float], list]:
        """The best score from the start to every place, and the last arc of each best path."""
        best, back = [0.0] + [-_INF] * n, [None] * (n + 1)
        for arc in arcs:
            start, end, s, _ = arc
            if (v := best[start] + s) > best[end]:
                best[end], back[end] = v, arc
        return best, back

    def chunk(self, text: str) -> tuple[float, tuple[int, ...], float]:
        """(best score, ids of the best, loss to the second best) of a chunk; the loss is inf where there is no second."""
        n = len(text)
        arcs = self.arcs(text)
        best, back = self.forward(arcs, n)
        taken, path, end = set(), [], n
        while end:
            taken.add(arc := back[end])
            path.append(arc[3])
            end = arc[0]
        # the second best has an arc that the best has not
        rest, second = [-_INF] * n + [0.0], -_INF
        for arc in reversed(arcs):
            start, end, s, _ = arc
            v = rest[end] + s
            if v > rest[start]:
                rest[start] = v
            if (w := best[start] + v) > second and arc not in taken:
                second = w
        return (best[n], tuple(i for x in reversed(path) for i in x), best[n] - second)

    def _tables(self):
        """The beginnings of pieces as a trie in arrays: symbols of characters, keys (node, symbol) in order, the nodes they lead to, and each node's score and id."""
        if self._trie is None:
            prefixes = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
            symbol = {c: k for k, c in enumerate(sorted({c for p in prefixes for c in p}), 1)}
            of = np.zeros(0x110000, np.int32)
            for c, k in symbol.items():
                of[ord(c)] = k
            node = {p: k for k, p in enumerate(sorted(prefixes, key=lambda p: (len(p), p)), 1)}
            wide = len(symbol) + 1
            key = np.array([node.get(p[:-1], 0) * wide + symbol[p[-1]] for p in node], np.int64)
            to = np.array(list(node.values()), np.int64)
            order = np.argsort(key)
            score = np.full(len(node) + 1, np.nan)
            ids = np.zeros(len(node) + 1, np.int32)
            for p, k in node.items():
                if p in self.pieces:
                    score[k], (ids[k],) = self.pieces[p]
            known = np.zeros(wide, bool)
            known[[symbol[c] for c in self.known]] = True
            self._trie = of, wide, key[order], to[order], score, ids, known
        return self._trie

    def learn(self, chunks: list[str]) -> None:
        """Put the results of many different chunks into the cache: all their lattices are searched together, place by place; those with characters that have no piece one by one."""
        of, wide, keys, to, scores, ids, known = self._tables()
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        text = of[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)]
        first = np.concatenate([[0], np.cumsum(size)])
        plain = np.logical_and.reduceat(known[text], first[:-1])
        # places are numbered with one more per chunk than characters
        chunk = np.repeat(np.arange(len(chunks)), size)
        place = np.arange(len(text)) + chunk
        left = first[chunk + 1] - np.arange(len(text))
        at, node = np.flatnonzero(plain[chunk]), None
        node = np.zeros(len(at), np.int64)
        found = []
        for length in range(1, self.longest + 1):
            key = node * wide + text[at + length - 1]
            i = np.searchsorted(keys, key)
            i[i == len(keys)] = 0
            hit = keys[i] == key
            at, node = at[hit], to[i[hit]]
            piece = ~np.isnan(scores[node])
            found.append((at[piece], np.full(int(piece.sum()), length), node[piece]))
            more = left[at] > length
            at, node = at[more], node[more]
            if not len(at):
                break
        at, length, node = (np.concatenate(x) for x in zip(*found, strict=True))
        offset = at - first[chunk[at]]
        order = np.lexsort((length, offset))
        at, length, node, offset = at[order], length[order], node[order], offset[order]
        start, score = place[at], scores[node]
        end = start + length
        cuts = np.searchsorted(offset, np.arange(int(offset.max(initial=-1)) + 2))
        n_places = len(text) + len(chunks)
        best, back, rest = np.full(n_places, -_INF), np.zeros(n_places, np.int64), np.full(n_places, -_INF)
        low, high = first[:-1] + np.arange(len(chunks)), first[1:] + np.arange(len(chunks))
        best[low], rest[high] = 0.0, 0.0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            # arcs of one offset end in different places
            v = best[start[a:b]] + score[a:b]
            up = np.flatnonzero(v > best[end[a:b]])
            best[end[a:b][up]], back[end[a:b][up]] = v[up], a + up
        for a, b in zip(cuts[-2::-1].tolist(), cuts[:0:-1].tolist(), strict=True):
            np.maximum.at(rest, start[a:b], rest[end[a:b]] + score[a:b])
        taken = np.zeros(len(at), bool)
        which, now, steps = np.flatnonzero(plain), high[plain], []
        while len(which):
            arc = back[now]
            taken[arc] = True
            steps.append((which, arc))
            now = start[arc]
            go = now > low[which]
            which, now = which[go], now[go]
        second = np.full(len(chunks), -_INF)
        other = ~taken
        np.maximum.at(second, chunk[at[other]], (best[start] + score + rest[end])[other])
        which, arc = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64),) * 2
        order = np.lexsort((start[arc], which))
        score, count = best[high][plain], np.bincount(which, minlength=len(chunks))[plain]
        self.put([c for c, ok in zip(chunks, plain.tolist(), strict=True) if ok], score, score - second[plain], count, ids[node[arc[order]]])
        self.learn_alone([c for c, ok in zip(chunks, plain.tolist(), strict=True) if not ok])

    def learn_alone(self, chunks: list[str]) -> None:
        got = [self.chunk(c) for c in chunks]
        self.put(chunks, [x[0] for x in got], [x[2] for x in got], [len(x[1]) for x in got], list(chain.from_iterable(x[1] for x in got)))

    def prepare(self, texts) -> list[tuple[list[str], np.ndarray]]:
        """The texts' chunks and their numbers in the cache, after all that it lacks have been searched, many at once. A mark has number -1."""
        if len(self.index) >= CACHE:
            self.forget()
        cut = [self.chunks(t) for t in texts]
        flat = list(chain.from_iterable(cut))
        which = list(map(self.index.get, flat))
        if None in which:
            new = {c for c, k in zip(flat, which, strict=True) if k is None} - {_MARK}
            short = sorted(c for c in new if len(c) <= _WIDE)
            for k in range(0, len(short), _MANY):
                self.learn(short[k : k + _MANY])
            self.learn_alone([c for c in new if len(c) > _WIDE])
            which = [self.index.get(c, -1) if k is None else k for c, k in zip(flat, which, strict=True)]
        ends = np.cumsum([0, *map(len, cut)]).tolist()
        which = np.array(which, np.int64)
        return [(c, which[i:j]) for c, i, j in zip(cut, ends[:-1], ends[1:], strict=True)]

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of one chunk by A* from its end: f is the score so far plus the forward score."""
        arcs = self.arcs(text)
        best, _ = self.forward(arcs, len(text))
        into: dict[int, list] = {}
        for start, end, s, ids in arcs:
            into.setdefault(end, []).append((start, s, ids))
        heap = [(-best[-1], 0, 0.0, len(text), ())]
        out, order = [], 0
        while heap and len(out) < n:
            f, _, g, at, tail = heapq.heappop(heap)
            if at == 0:
                ids = []
                while tail:
                    ids.extend(tail[0])
                    tail = tail[1]
                out.append((-f, tuple(ids)))
                continue
            for start, s, ids in reversed(into[at]):
                if best[start] > -_INF:
                    # of equal sums the latest goes first, so that ties are followed to their end
                    order -= 1
                    heapq.heappush(heap, (-(best[start] + s + g), order, g + s, start, (ids, tail)))
        return out

    def chunks(self, text: str) -> list[str]:
        """The text with its dummy prefix and spaces marked, cut where no piece can cross."""
        return _CHUNK.findall((" " + text).replace(SPACE, _MARK).replace(" ", SPACE)) if text else []


    def encode(self, text: str, n: int = N_BEST, prepared: tuple[list[str], np.ndarray] | None = None) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of a whole text: (score, ids), best first. ``prepared``: what ``prepare`` gave for it."""
        cut, which = self.prepare([text])[0] if prepared is None else prepared
        if not cut:
            return [(0.0, np.zeros(0, np.int32))]
        if _MARK in cut:
            literal = iter(re.findall(f"[{_MARK}{SPACE}]", text))
            score, loss, paths = zip(*((self.floor, _INF, np.array(self.fallback(next(literal)), np.int32)) if c == _MARK else ((x := self.held(c))[0], x[2], np.array(x[1], np.int32)) for c in cut), strict=True)
            score, loss, count, best = np.array(score), np.array(loss), np.array([len(x) for x in paths]), np.concatenate(paths)
        else:
            score, loss, count = self.score[which], self.loss[which], self.count[which]
            best = self.pool[np.repeat(self.at[which] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        total = float(score.sum())
        # lists of the cheapest places' segmentations, merged into the n best combinations
        k = min(n - 1, len(loss))
        places = sorted(np.argpartition(loss, k - 1)[:k].tolist(), key=lambda i: (loss[i], i)) if k > 0 else []
        combos: list[tuple[float, dict[int, tuple[int, ...]]]] = [(0.0, {})]
        for i in places:
            if loss[i] < _INF:
                options = self.options(cut[i], n)
                combos = heapq.nlargest(n, ((v + s, {**d, i: ids} if j else d) for v, d in combos for j, (s, ids) in enumerate(options)), key=lambda x: x[0])
        out = [(total, best)]
        ends = np.cumsum(count)
        for lost, swap in combos[1:n]:
            # only the places swapped differ from the best
            ids, done = [], 0
            for i in sorted(swap):
                ids += [best[done : ends[i] - count[i]], swap[i]]
                done = ends[i]
            out.append((total + lost, np.concatenate([*ids, best[done:]]).astype(np.int32)))
        return out

    def options(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a chunk, with what each loses to the best."""
        got = self.lists.get((chunk, n))
        if got is None:
            best = self.n_best(chunk, n)
            got = [(s - best[0][0], ids) for s, ids in best]
            if len(self.lists) >= CACHE // 10:
                self.lists.clear()
            self.lists[chunk, n] = got
        return got

    def decode(self, ids) -> str:
        """The text of a segmentation."""
        ids = np.asarray(ids, np.int64).tolist()
        parts = list(map(self.plain.get, ids))
        if None in parts:  # byte pieces of longer characters
            out, held = [], bytearray()
            for i, part in zip(ids, parts, strict=True):
                if i in self.byte_of:
                    held.append(self.byte_of[i])
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                out.append("\ufffd" if part is None else part)
            parts = [*out, held.decode("utf-8", "replace")]
        text = "".join(parts)
        return text[1:] if text.startswith(" ") else text


    def decodes_alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Do two segmentations decode to the same text? Only what lies between their equal ends is decoded, if it has no byte pieces."""
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        head = int(differ[0]) if len(differ) else m
        differ = np.flatnonzero(a[len(a) - m :][::-1] != b[len(b) - m :][::-1])
        tail = min(int(differ[0]) if len(differ) else m, m - head)
        parts = [list(map(self.plain.get, x[head : len(x) - tail].tolist())) for x in (a, b)]
        return self.decode(a) == self.decode(b) if None in parts[0] or None in parts[1] else "".join(parts[0]) == "".join(parts[1])


#: A newline or a mark alone, or a run of spaces with what follows up to the next of these.
_CHUNK = re.compile(f"[\n{_MARK}]|{SPACE}+[^{SPACE}\n{_MARK}]*|[^{SPACE}\n{_MARK}]+")


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    """The model of this worker."""
    return Lattice.load(path)


def _numbers(lists: list) -> pa.Array:
    """Lists of ids, given as arrays, as one Arrow column."""
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *lists]))


def _searched(docs: DataFrame, model: str, n_best: int, id_col: str, text_col: str, columns, names: str) -> DataFrame:
    """doc_id and the columns that ``columns`` makes of a model, texts and their n best segmentations."""
    bounded_batches(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = lattice(model)
        for batch in batches:
            for part in text_slices(batch, "text", limit=_TOGETHER):
                texts = part.column("text").to_pylist()
                got = [m.encode(t, n_best, prepared) for t, prepared in zip(texts, m.prepare(texts), strict=True)]
                made = {"doc_id": part.column("doc_id"), **columns(m, texts, got)}
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))
        # the worker may go on to other work: only the model stays
        m.forget()
        m.lists.clear()

    return rows.mapInArrow(released(run), f"doc_id {kind}, {names}")


def encode(docs: DataFrame, *, model: str = MODEL, n_best: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``segmentations``, an array of (score, ids), best first, of every row."""

    def columns(m, texts, got):
        each = [x for segmentations in got for x in segmentations]
        both = pa.StructArray.from_arrays([pa.array([s for s, _ in each], pa.float64()), _numbers([ids for _, ids in each])], ["score", "ids"])
        return {"segmentations": pa.ListArray.from_arrays(np.cumsum([0, *map(len, got)], dtype=np.int32), both)}

    return _searched(docs, model, n_best, id_col, text_col, columns, "segmentations array<struct<score: double, ids: array<int>>>")


def decode(rows: DataFrame, ids: str, *, model: str = MODEL, to: str = "text") -> DataFrame:
    """``rows`` with the text of the ids in column ``ids``."""

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        m = lattice(model)
        return pd.Series([m.decode([] if x is None else x) for x in lists])

    return rows.withColumn(to, run(F.col(ids)))


def summarise(docs: DataFrame, *, model: str = MODEL, n_best: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the number of pieces of the best segmentation and its ids, the scores of the n best and the digest of the ids
    of each, and whether each of them decodes to the text."""

    def columns(m, texts, got):
        ids = [[x for _, x in segmentations] for segmentations in got]
        return {
            "n_pieces": pa.array([len(x[0]) for x in ids], pa.int64()),
            "ids": _numbers([x[0] for x in ids]),
            "scores": pa.array([[s for s, _ in x] for x in got], pa.list_(pa.float64())),
            "ids_crc32": pa.array([[zlib.crc32(y.astype("<i4").tobytes()) for y in x] for x in ids], pa.list_(pa.int64())),
            "round_trip": pa.array([m.decode(x[0]) == t and all(m.decodes_alike(x[0], y) for y in x[1:]) for t, x in zip(texts, ids, strict=True)], pa.bool_()),
        }

    return _searched(docs, model, n_best, id_col, text_col, columns, "n_pieces long, ids array<int>, scores array<double>, ids_crc32 array<long>, round_trip boolean")
