"""Packing of tokenized documents into sequences by online best fit with a bounded number of open bins.

A document is its token ids and an end id.  Only documents of more than ``CAPACITY`` tokens are cut, into pieces of that
size, the last of what is left.  A piece goes where it leaves the least room among the open sequences.  At most ``OPEN`` of them are
open, as a bitset with a bit for each amount of free space: the lowest set bit at or above the piece's length is the best
fit.  If none fits and all are in use, the fullest closes.  A full one closes at once.

*Rounds.*  A task packs what it reads; closed sequences are final, and the pieces of those still open at its end are
packed again, in a round of fewer tasks: each gets about ``FAN_IN * OPEN`` sequences' worth and leaves ``OPEN`` at most, so rounds
shrink at least ``FAN_IN``-fold, and the last one, of one task, closes everything.  Texts are read once, in the first
round; pieces are rows of a few numbers.  Each round is written before the next, so sequence ids never change under a reader.

*Tokens.*  The tokenizer never looks across spaces or line ends, so a worker encodes each distinct stretch between
them once and puts documents together from the remembered ids; what it remembers is bounded.  Stretches of ASCII and Latin
letters are merged here, all new words of a batch at once, and some of every batch are held against the library, which
encodes all others (and everything, if the tokenizer file has other rules).

Null and empty texts are the end id alone.  Repeated rows and ties are packed like other documents, a null doc_id
too; doc_id may be of any type.  Very long texts give many pieces.  Which sequence a piece gets depends on the order of
the rows read.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common
from .divergence import changes, packed

CAPACITY, END_ID = 4096, 1
OPEN, FAN_IN = 256, 16
#: Stretches, and ids of them, that a worker remembers before it forgets them all.
REMEMBERED, REMEMBERED_IDS = 1_000_000, 8_000_000


class Merges:
    """Byte pairs merged by rank, for all words of a list at once."""

    #: Words longer than this are left to the library.
    LONGEST = 64
    # How the tokenizer file cuts words, and what it does to a text before.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

    @classmethod
    def of(cls, path: str) -> Merges | None:
        """The merges of a tokenizer file; None if it cuts words in another way."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, cut = file["model"], [{k: p[k] for k in p if k != "trim_offsets"} for p in (file["pre_tokenizer"] or {}).get("pretokenizers", [])]
        as_known = [{"type": "Split", "pattern": {"Regex": cls.SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
        known = (file["normalizer"] or {}).get("normalizers") == cls.NORMAL and cut == as_known and file["post_processor"] is None
        known = known and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["continuing_subword_prefix"] and not model["dropout"] and not model.get("ignore_merges")
        return cls(model) if known and len(model["vocab"]) < 1 << 16 else None

    def __init__(self, model: dict):
        vocab = model["vocab"]
        # the printable bytes stand for themselves, the others for the characters from 256 on
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        other = [b for b in range(256) if b not in own]
        sign = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}
        self.first = np.array([vocab[sign[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[sign[b] + "</w>"] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._slot(keys)] = True
        # SPLIT for plain stretches, and the ends of stretches
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+|\n")

    @classmethod
    def plain(cls, stretches: list[bytes]) -> np.ndarray:
        """Which stretches the rules below are for: printable ASCII and Latin letters in UTF-8, nothing that may be a special token."""
        data = np.frombuffer(b"\n".join([*stretches, b""]), np.uint8)
        after = np.append(data[1:], np.uint8(0))
        sizes = np.array([len(s) for s in stretches], np.int64)
        # leads of two bytes from U+00C0 to U+024F, but for U+0130, which has two characters in lower case
        odd = ((data < 33) & (data != 10)) | (data == 127) | (data == 0xC2) | (data >= 0xCA) | ((data == 0xC4) & (after == 0xB0)) | ((data == 0xC9) & (after >= 0x90)) | ((data == 60) & (after == 124))
        return (np.add.reduceat(odd, np.cumsum(sizes + 1) - sizes - 1, dtype=np.int64) == 0) & (sizes <= cls.LONGEST)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 & 0xFFFFFFFF) >> 10

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of symbols; the number of merges for those that don't merge."""
        keys = left << 16 | right
        out = np.full(len(keys), len(self.keys))
        some = np.flatnonzero(self.maybe[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        hit = self.keys[at] == keys[some]
        out[some[hit]] = self.rank[at[hit]]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words (none empty), and how many each has: a round merges the first lowest pair of every word."""
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.first[data]
        ends = np.cumsum(size)
        symbols[ends - 1] = self.last[data[ends - 1]]
        done_word, done_symbols = [], []
        word = np.arange(len(words))
        none = len(self.keys)
        inner = np.ones(len(symbols), bool)  # followed by another symbol of its word
        inner[ends - 1] = False
        rank = np.full(len(symbols), none)
        at = np.flatnonzero(inner)
        rank[at] = self.ranks(symbols[at], symbols[at + 1])
        while len(word):
            starts = ends - size
            least = np.minimum.reduceat(rank, starts)
            over = least == none
            if over.any():
                gone = np.repeat(over, size)
                done_word.append(np.repeat(word[over], size[over]))
                done_symbols.append(symbols[gone])
                symbols, rank, word, size, least = symbols[~gone], rank[~gone], word[~over], size[~over], least[~over]
                if not len(word):
                    break
                ends = np.cumsum(size)
                starts = ends - size
            hits = np.flatnonzero(rank == np.repeat(least, size))
            owner = np.searchsorted(ends, hits, "right")
            at = hits[np.concatenate(([True], owner[1:] != owner[:-1]))]
            symbols[at] = self.made[least]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # where they are when the right halves are gone
            symbols, rank = symbols[keep], rank[keep]
            size = size - 1
            ends = np.cumsum(size)
            starts = ends - size
            rank[at] = none
            for left in (at[at < ends - 1], at[at > starts] - 1):  # each word has one, so the places go with the words
                rank[left] = self.ranks(symbols[left], symbols[left + 1])
        word, symbols = np.concatenate([*done_word, np.empty(0, np.int64)]), np.concatenate([*done_symbols, np.empty(0, np.int64)])
        return symbols[np.argsort(word, kind="stable")].astype(np.uint32), np.bincount(word, minlength=len(words))


class Encoder:
    """Ids of texts by a tokenizer file, with a memory of stretches between spaces and line ends."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges.of(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.empty(0, np.uint32)
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    def _by_library(self, stretches: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([s.decode() for s in stretches], add_special_tokens=False)]

    def _learn(self, stretches: list[bytes]) -> None:
        """Remembers the ids of new stretches; some of those that are merged here are held against the library."""
        fits = self.merges.plain(stretches) if self.merges else np.zeros(len(stretches), bool)
        plain, rest = ([s for s, f in zip(stretches, fits.tolist(), strict=True) if f == side] for side in (True, False))
        flat, lengths = np.empty(0, np.uint32), np.empty(0, np.int64)
        if plain:
            found = self.merges.split.findall(b"\n".join([*plain, b""]).decode().lower())
            words = {w: k for k, w in enumerate(dict.fromkeys(found))}
            at = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
            end = at == words["\n"]
            ids, sizes = self.merges.encode([w.encode() for w in words])
            sizes[words["\n"]], starts = 0, np.cumsum(sizes) - sizes
            flat = ids[_spans(starts[at], sizes[at])]
            lengths = np.diff(np.concatenate(([0], np.cumsum(sizes[at])[end])))
        ends = np.cumsum(lengths)
        for k, expected in enumerate(self._by_library(plain[:64])):
            if not np.array_equal(flat[ends[k] - lengths[k] : ends[k]], expected):
                raise ValueError(f"the merges of {plain[k]!r} aren't the library's")
        others = self._by_library(rest)
        lengths = np.concatenate((lengths, np.array([len(x) for x in others], np.int64)))
        self.known.update(zip([*plain, *rest], range(len(self.known), len(self.known) + len(stretches)), strict=True))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(lengths) - lengths)
        self.sizes = np.append(self.sizes, lengths)
        self.ids = np.concatenate([self.ids, flat, *others])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and where each text ends."""
        if len(self.known) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            self.forget()
        data = b"\n".join([*texts, b"\n" * 16])
        low = np.frombuffer(data, np.uint8)
        inside = np.concatenate(([False], (low != 32) & (low != 10)))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        code = np.empty(len(starts), np.int64)
        runs = []
        for at, keys in packed(low, starts, sizes):
            first = np.flatnonzero(changes([*keys, sizes[at]]))
            runs.append((at, first, [data[a : a + n] for a, n in zip(starts[at[first]].tolist(), sizes[at[first]].tolist(), strict=True)]))
        if new := {s for _, _, names in runs for s in names if s not in self.known}:
            self._learn(list(new))
        for at, first, names in runs:
            found = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
            code[at] = np.repeat(found, np.diff(np.append(first, len(at))))
        lengths = self.sizes[code]
        flat = self.ids[_spans(self.starts[code], lengths)]
        bounds = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        ends = np.concatenate(([0], np.cumsum(lengths)))[bounds]
        return np.insert(flat, ends, END_ID), ends + np.arange(1, len(texts) + 1)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of spans, one after the other."""
    offsets = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - offsets, sizes)


@cache
def encoder(path: str) -> Encoder:
    """A worker's own, kept for its next tasks."""
    return Encoder(path)


@dataclass
class _Bin:
    number: int
    pieces: list


class BestFit:
    """Open sequences by their free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free = 0  # bit f is set if a sequence with f tokens free is open
        self.bins: list[list[_Bin]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.made = 0

    def _take(self, room: int) -> _Bin:
        self.n_open -= 1
        found = self.bins[room].pop()
        if not self.bins[room]:
            self.free ^= 1 << room
        return found

    def add(self, length: int, piece: object) -> Iterator[_Bin]:
        """Places a piece; yields the sequences that this closes."""
        above = self.free >> length
        if above:
            room = length + (above & -above).bit_length() - 1
            target = self._take(room)
        else:
            if length < self.capacity and self.n_open == self.most:
                yield self._take((self.free & -self.free).bit_length() - 1)
            room, target = self.capacity, _Bin(self.made, [])
            self.made += 1
        target.pieces.append((piece, self.capacity - room))
        room -= length
        if room == 0:
            yield target
        else:
            self.bins[room].append(target)
            self.free |= 1 << room
            self.n_open += 1

    def rest(self) -> Iterator[_Bin]:
        while self.free:
            yield self._take((self.free & -self.free).bit_length() - 1)


def _packed(batches: Iterator[pa.RecordBatch], round_: int, last: bool, capacity: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows with ``length`` and their sequence_id and offset; the rows of sequences that stay open have neither, but in the last round."""
    packer = BestFit(capacity, most)
    prefix = (round_ << 56) | (TaskContext.get().partitionId() << 32)
    rows: list[tuple] = []
    schema: pa.Schema | None = None

    def placed(target: _Bin, final: bool = True) -> None:
        rows.extend((piece, prefix | target.number, offset) if final else (piece, None, None) for piece, offset in target.pieces)

    def sent() -> pa.RecordBatch:
        columns = {n: pa.array([p[i] for p, _, _ in rows], schema.field(i).type) for i, n in enumerate(schema.names)}
        out = columns | {"sequence_id": pa.array([s for _, s, _ in rows], pa.int64()), "offset": pa.array([o for _, _, o in rows], pa.int64())}
        rows.clear()
        return pa.RecordBatch.from_pydict(out)

    for batch in batches:
        schema = batch.schema
        lengths = batch.column("length").to_pylist()
        for length, piece in zip(lengths, zip(*(c.to_pylist() for c in batch.columns), strict=True), strict=True):
            for closed in packer.add(length, piece):
                placed(closed)
        if len(rows) > 10_000:
            yield sent()
    for target in packer.rest():
        placed(target, last)
    if rows:
        yield sent()


def _pieces(encode: Encoder, batch: pa.RecordBatch, capacity: int, keep_ids: bool) -> pa.RecordBatch:
    ids, ends = encode([(t or "").encode() for t in batch.column("text").to_pylist()])
    sizes = np.diff(np.concatenate(([0], ends)))
    n = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = piece * capacity
    length = np.minimum(capacity, sizes[row] - start)
    first = (ends - sizes)[row] + start
    data = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(data[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), length.tolist(), strict=True)]
    out = {"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64())}
    if keep_ids:  # a piece's ids follow those of the piece before
        out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_pydict(out)


def pack(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, most_open: int = OPEN, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id and offset of every piece."""
    inner = common.Inner(docs, (), doc_id=doc_id, text=text).df.select("doc_id", "text")
    made = StructType([inner.schema["doc_id"], *StructType.fromDDL("piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if keep_ids else "")).fields])
    with_place = StructType([*made.fields, *StructType.fromDDL("sequence_id bigint, offset bigint").fields])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = (_pieces(encoder(path), b, capacity, keep_ids) for b in common.slices(batches, "text"))
        yield from _packed(cut, 0, False, capacity, most_open)

    def again(round_: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        return lambda batches: _packed(batches, round_, last, capacity, most_open)

    with common.workspace() as keep:
        done = keep(common.Staged(inner.mapInArrow(first, with_place), "packed-0")).df
        out, round_ = done.where("sequence_id is not null"), 0
        while True:
            left = done.where("sequence_id is null").select(*made.names)
            tokens = left.agg(F.sum("length")).first()[0] or 0
            tasks = -(-tokens // (FAN_IN * most_open * capacity))
            if not tokens:
                return out
            round_ += 1
            done = keep(common.Staged(left.coalesce(tasks).mapInArrow(again(round_, tasks == 1), with_place), f"packed-{round_}")).df
            out = out.unionByName(done.where("sequence_id is not null"))
            if tasks == 1:
                return out


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, n_tokens and n_pieces of a packing with ids; a sequence's pieces, at most its capacity of tokens, meet in one row."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.size("p").alias("n_pieces")).withColumn("n_tokens", F.size("ids"))
