"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is a row of symbols, one a character.  An agenda holds the adjacent pairs
whose concatenation is a piece; the pair of the highest score, the leftmost of
equals, is merged until none is left.  Pieces hold the space mark only in front
(checked when a model is loaded), so that texts fall into pre-tokens that merge
independently: each distinct pre-token of an Arrow batch is encoded once, all of
them together in numpy, a merge for each pre-token and round.  Whatever the agenda
made is compared with the library in the same batch; a difference raises.

Null and empty texts have no pieces (the end id alone, if asked for).  Repeated
rows, ties of scores and very long texts need no special care: rows are
independent, and pre-tokens of over ``LONG`` characters use a heap.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from . import common

MARK, LONG = "▁", 64
#: Pre-tokens that a worker remembers; beyond it the older half is forgotten.
CACHE = 400_000
#: Pre-tokens that go through the agenda together.
ROUND = 8_000
UNITS = re.compile(r" *[^ \n]+|\n| +")
#: The agenda's key of a pair that isn't a piece; a key's low bits are the place.
FAR, PLACE = np.int64(1 << 62), np.int64((1 << 32) - 1)


class PieceModel:
    """A merge-type vocabulary as arrays, beside the library's own processor."""

    def __init__(self, path: str):
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        pieces = {lib.id_to_piece(i): i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        if any(lib.decode(lib.encode(x)) != x for x in (" a  b ", "A\t\r\n\n b", "ﬁ ½ Å Å ſ", "e\u0301 ẛ̣　x", "日本 ｶﾞ ①", "😀\u200d\ufeff\u00ad")):
            raise ValueError("only vocabularies that keep texts as they are can be used")
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("a piece crosses a pre-token")
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = lib.eos_id()
        chars = sorted({c for p in pieces for c in p})
        self.symbol = {c: pieces.get(c, n + k) for k, c in enumerate(chars)}
        self.of_char = np.full(0x110000, -1, np.int32)
        self.of_char[[ord(c) for c in chars]] = [self.symbol[c] for c in chars]
        self.plain = re.compile("[" + re.escape("".join(c for c in chars if c in pieces)) + "]*")
        self.spelled = {s: self._fallback(c) for c, s in self.symbol.items() if s >= n}
        symbol = self.symbol | pieces
        ranks = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in pieces.values()}, reverse=True))}
        self.width = n + len(chars)
        pairs = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (ranks[lib.get_score(i)], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.known: dict[str, tuple[int, ...]] = {}

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def _offer(self, at: np.ndarray, sym: np.ndarray, after: np.ndarray, become: np.ndarray, key: np.ndarray) -> None:
        """Puts the pairs that begin at ``at`` on the agenda: the better score first, then the leftmost."""
        a, b = sym[at], sym[after[at]]
        pair = np.where((a >= 0) & (b >= 0), a * self.width + b, -1)
        i = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        hit = self.keys[i] == pair
        key[at] = np.where(hit, (self.ranks[i] << 32) | at, FAR)
        become[at] = self.merged[i]

    def agenda(self, units: list[str]) -> list[tuple[int, ...]]:
        """Ids of every pre-token, its spaces written as the mark."""
        out: list[tuple[int, ...]] = [()] * len(units)
        short = [i for i, u in enumerate(units) if len(u) <= LONG]
        for i, u in enumerate(units):
            if len(u) > LONG:
                out[i] = self._heap(u)
        if not short:
            return out
        words = [units[i] for i in short]
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym = self.of_char[codes]
        sym = np.where(sym < 0, -1 - codes.astype(np.int64), sym)  # an unknown character keeps its code
        lens = np.fromiter(map(len, words), np.int64, len(words))
        size = len(sym)
        # symbols are linked in place; slot ``size`` stands for "none"
        sym = np.append(sym, -1)
        after = np.arange(1, size + 2)
        before = np.arange(-1, size)
        ends = np.cumsum(lens)
        after[ends - 1], after[size] = size, size
        before[ends - lens], before = size, np.append(before, size)
        key = np.full(size, FAR)
        become = np.full(size + 1, -1, np.int64)
        self._offer(np.arange(size), sym, after, become, key)
        starts = ends - lens
        live = np.ones(size, bool)
        while True:
            best = np.minimum.reduceat(key, starts)
            going = best < FAR
            if not going.any():
                break
            at = best[going] & PLACE
            gone = after[at]
            sym[at] = become[at]
            live[gone] = False
            after[at] = nxt = after[gone]
            before[nxt] = at
            key[gone] = FAR
            self._offer(at, sym, after, become, key)
            prior = before[at]
            self._offer(prior[prior < size], sym, after, become, key)
            starts = starts[going]  # words that are done have no pair left, so they may lie in the stretch before the next
        flat = sym[:size][live].tolist()
        cuts = np.cumsum(np.add.reduceat(live, ends - lens, dtype=np.int64)).tolist()
        at = 0
        for i, cut in zip(short, cuts, strict=True):
            out[i] = tuple(flat[at:cut])
            at = cut
        odd = {i for i, u in enumerate(units) if not self.plain.fullmatch(u)}
        return [self._ids(ids) if i in odd else ids for i, ids in enumerate(out)] if odd else out

    def _ids(self, symbols: tuple[int, ...]) -> tuple[int, ...]:
        ids: list[int] = []
        for s in symbols:
            ids += self._fallback(chr(-1 - s)) if s < 0 else self.spelled.get(s, [s])
        return tuple(ids)

    def _heap(self, unit: str) -> tuple[int, ...]:
        """One long pre-token: the agenda as a heap over linked symbols."""
        sym = [self.symbol.get(c, -1 - ord(c)) for c in unit]
        n = len(sym)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (p := self.pairs.get(sym[i] * self.width + sym[j])):
                heapq.heappush(agenda, (p[0], i, j, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = [False] * n
        while agenda:
            _, i, j, a, b = heapq.heappop(agenda)
            if gone[i] or gone[j] or sym[i] != a or sym[j] != b or after[i] != j:
                continue
            sym[i] = self.pairs[a * self.width + b][1]
            gone[j] = True
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return tuple(s for s, x in zip(sym, gone, strict=True) if not x)

    def library(self, units: list[str]) -> list[list[int]]:
        """What the library makes of the same pre-tokens."""
        alone = self.lib.encode("\n")  # the space in front and the newline
        marked = [u[1:] if u[0] == MARK else "\n" + u for u in units]
        made = self.lib.encode(marked, num_threads=1)
        return [alone[:1] if u == MARK else x if u[0] == MARK else x[len(alone) :] for u, x in zip(units, made, strict=True)]

    def learn(self, units: set[str]) -> None:
        """Encodes pre-tokens that the worker doesn't remember and compares them with the library."""
        new = [u for u in units if u not in self.known]
        if len(self.known) + len(new) > CACHE:
            for u in list(self.known)[: max(0, len(self.known) - CACHE // 2)]:
                if u not in units:
                    del self.known[u]
        for at in range(0, len(new), ROUND):
            some = [u.replace(" ", MARK) for u in new[at : at + ROUND]]
            ids = self.agenda(some)
            for u, a, b in zip(some, ids, self.library(some), strict=True):
                if list(a) != b:
                    raise ValueError(f"the agenda and the library differ on {u!r}: {a} and {b}")
            self.known.update(zip(new[at : at + ROUND], ids, strict=True))

    def encode(self, texts: list[str], end: bool) -> list[list[int]]:
        """Ids of whole texts, with the space in front that the library adds."""
        cut = [UNITS.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        self.learn(set().union(*cut))
        known, tail = self.known, [self.end] if end else []
        out = []
        for units in cut:
            ids: list[int] = []
            for u in units:
                ids += known[u]
            out.append(ids + tail)
        return out


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """A worker's own model, kept between batches and tasks."""
    return PieceModel(path)


def encode_decode(docs: DataFrame, path: str, *, end: bool = True, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` array<int> and ``decoded`` string, the library's decode(ids).

    Other columns stay; columns called ids or decoded, in any case, give way to the new ones.
    """
    inner = common.Inner(docs, ("ids", "decoded"), text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in common.slices(batches, "text"):
            ids = pieces.encode([t or "" for t in batch.column("text").to_pylist()], end)
            flat = np.fromiter((i for x in ids for i in x), np.int32, sum(map(len, ids)))
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield common.with_columns(batch, {"ids": lists, "decoded": pa.array(pieces.lib.decode(ids), pa.string())})

    return inner.outer(inner.df.mapInArrow(run, common.schema_with(inner.df, "ids array<int>, decoded string")), "ids", "decoded")
