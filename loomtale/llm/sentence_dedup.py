"""Substring dedup on sliding spans of sentences.

A text is cut into pieces: sentences and their clauses, after ``.!?,;:`` before white space, and at line
ends; a piece of over ``LONG`` words is cut further after words that a hash of the word picks (one in
``ONE_IN``), so that text without punctuation has pieces too, and equal passages have equal ones.  From
each piece on, the shortest run of at least ``PIECES`` pieces and ``WORDS`` words is hashed (128 bits,
white space around pieces aside).  A run that occurs before, in a document of a smaller doc_id or
earlier in the same one, is a repeat, and the pieces it covers are removed.  Repeats inside a batch
are settled before anything is sent, so that a hot run is one row for each batch; the rest is sorted
by hash in one exchange.

Only whole pieces are seen: of a passage that begins or ends inside a piece, the pieces it holds whole.
Texts of fewer words or pieces than a run keep all they have, copies too.  Null and empty texts
have no pieces.  Rows equal in doc_id and text are one document, and each gets its result; ties of
doc_id are ordered by a hash.  doc_id must be an integer, a null one is the least.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontam import _power
from .repeats import KEY, ROWS, keyed, marked, rows, spans_of

PIECES, WORDS = 2, 16
LONG, ONE_IN = 12, 6
#: A clause with the white space after it.
CLAUSE = re.compile(r"(?:[^.!?,;:\n]|[.!?,;:](?!\s|$))+[.!?,;:]*\s*|[.!?,;:\n]+\s*")
WORD = re.compile(r"\s*\S+\s*")


def pieces(text: str) -> list[str]:
    """The text in pieces; joined, they are the text."""
    out = []
    for clause in CLAUSE.findall(text):
        if len(clause) <= 2 * LONG or len(words := WORD.findall(clause)) <= LONG:
            out.append(clause)
            continue
        held: list[str] = []
        for w in words:
            held.append(w)
            if zlib.crc32(w.strip().encode()) % ONE_IN == 0:
                out.append("".join(held))
                held = []
        if held:
            out.append("".join(held))
    return out


def ends_of_runs(parts: list[str], least_pieces: int = PIECES, least_words: int = WORDS) -> np.ndarray:
    """Where the run from each piece ends; pieces too near the end of the text have none."""
    words = np.concatenate(([0], np.cumsum([len(p.split()) for p in parts], dtype=np.int64)))
    ends = np.maximum(np.searchsorted(words, words[:-1] + least_words), np.arange(len(parts)) + least_pieces)
    return ends[: np.searchsorted(ends, len(parts), "right")]


def _runs(docs: DataFrame, least_pieces: int, least_words: int) -> DataFrame:
    """ROWS with a piece number as pos: the runs that start there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            return rows(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch in common.slices(batches, "text"):
            ids, ks = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in KEY)
            for d, t in enumerate(batch.column("text").to_pylist()):
                parts = pieces(t or "")
                ends = ends_of_runs(parts, least_pieces, least_words)
                count = len(ends)
                if not count:
                    continue
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p.strip()) for p in parts), np.uint64).reshape(-1, 2)
                power, inverse = _power(len(parts))
                total = np.concatenate((np.zeros((1, 2), np.uint64), np.cumsum(h * power[: len(parts), None], axis=0)))
                at = np.arange(count)
                mixed = (total[ends] - total[:count]) * inverse[:count, None] + (ends - at).astype(np.uint64)[:, None]
                held.append((mixed[:, 0], mixed[:, 1], np.full(count, ids[d]), np.full(count, ks[d]), at, np.ones(count, np.int64)))
                size += count
            if size >= 1 << 18:
                yield sent()
                held, size = [], 0
        if held:
            yield sent()

    return docs.select(*KEY, "text").mapInArrow(run, ROWS)


def drop_repeated_sentences(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_pieces: int = PIECES, least_words: int = WORDS) -> DataFrame:
    """``docs`` with n_sentences (pieces), n_removed and ``kept``, the text without repeated ones."""
    inner = common.Inner(docs, ("n_sentences", "n_removed", "kept"), doc_id=doc_id, text=text)
    docs = keyed(inner.df)
    repeats = marked(_runs(docs, least_pieces, least_words)).where("later")
    spans = spans_of(repeats, F.col("pos"), F.col("pos") + F.col("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            counts, removed, kept = [], [], []
            for t, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                parts = pieces(t or "")
                gone = bytearray(len(parts))
                ends = ends_of_runs(parts, least_pieces, least_words) if found else ()
                for x in found or ():
                    stop = int(ends[x["e"] - 1])
                    gone[x["s"] : stop] = b"\1" * (stop - x["s"])
                counts.append(len(parts))
                removed.append(sum(gone))
                kept.append("".join(p for p, g in zip(parts, gone, strict=True) if not g))
            new = {"n_sentences": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())}
            yield common.with_columns(batch.drop_columns(["spans"]), new)

    both = docs.join(spans, list(KEY), "left")
    out = both.mapInArrow(run, common.schema_with(both.drop("spans"), "n_sentences bigint, n_removed bigint, kept string"))
    return inner.outer(out, "n_sentences", "n_removed", "kept")
