"""Benchmark decontamination: a broadcast hash set of the items' word n-grams scans the documents.

Words are runs of digits, letters a-z (A-Z lowered) and characters beyond ASCII.  Every window
of ``WINDOW`` consecutive words of an item is hashed; an item of fewer words is one window.
Tasks hash the windows of their documents with numpy, look them up in the broadcast set, and
compare the words of each match, so that a hit is exact.  Hit words are reported as spans and
can be cut out, or the documents dropped.

The distinct windows of all items are made on Spark.  Up to ``MAX_WINDOWS`` of them, with their
items, are broadcast as one set of numpy arrays (some 100 bytes each), which a worker holds once for all its
tasks; more are dealt into blocks by a hash of the window, and the documents are scanned once for each
block.  So neither a long item nor repeated items make a block larger.

Null or empty texts have no words and no hits, null or empty items no windows.  Repeated items
count once by their item_id; a null item_id is the empty string.  Rows of documents are independent of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, MAX_WINDOWS = 10, 1_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Each byte lower-cased, 0 if it isn't part of a word.
_BYTE = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 0 for b in range(256)], np.uint64)
_BASE, _MIX, _STEP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the power of 0..n and its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, b in enumerate((_BASE, inverse)):
            p = np.full(max(n + 1, 1 << 16), b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of ``data``."""
    low = _BYTE[np.frombuffer(data, np.uint8)]
    inside = np.concatenate(([False], low != 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    power, inverse = _power(len(low))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(low * power[: len(low)])))
    h = (total[ends] - total[starts]) * inverse[starts]
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return starts, ends, h ^ (h >> np.uint64(29))


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    out = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        out = out * _STEP + h[k : k + len(out)]
    return out ^ (out >> np.uint64(32))


class Windows:
    """Windows of words joined by spaces, with their items: all in numpy arrays, by width and hash."""

    def __init__(self, rows: pa.Table):
        """rows: window and item, distinct, in any order."""
        windows = rows.column("window").combine_chunks()
        data = b"\n".join(w.encode() for w in windows.to_pylist())
        starts, _, h = _words(data)
        sizes = np.array(pc.binary_length(windows), np.int64) + 1
        first = np.searchsorted(starts, np.cumsum(sizes) - sizes)
        widths = np.diff(np.append(first, len(starts)))
        self.items = rows.column("item").combine_chunks()
        self.sets = {}
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            hashes = _rolled(h, width)[first[at]]
            order = np.argsort(hashes, kind="stable")
            known, at = hashes[order], at[order]
            bits = max(12, min(26, int(len(known)).bit_length() + 6))
            table = np.zeros(1 << bits, bool)
            table[known & np.uint64((1 << bits) - 1)] = True
            self.sets[width] = (known, table, np.uint64((1 << bits) - 1), windows.cast(pa.binary()).take(pa.array(at)), at)

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str], np.ndarray, np.ndarray]]:
        """For each text: its words, the runs of words hit, the items, and the words' byte starts and ends."""
        data = b"\n".join(texts)
        starts, ends, h = _words(data)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        bounds = np.cumsum(sizes) - sizes
        first = np.searchsorted(starts, bounds)  # each text's first word
        doc = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(starts))))
        items: list[set[str]] = [set() for _ in texts]
        runs: list[list[tuple[int, int]]] = [[] for _ in texts]
        for width, (known, table, mask, windows, rows) in self.sets.items():
            w = _rolled(h, width)
            at = np.flatnonzero(table[w & mask])
            at = at[doc[at] == doc[at + width - 1]]
            low, high = np.searchsorted(known, w[at]), np.searchsorted(known, w[at], "right")
            for k, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                if a == b:
                    continue
                words = b" ".join(data[s:e] for s, e in zip(starts[k : k + width].tolist(), ends[k : k + width].tolist(), strict=True)).translate(_LOWERED)
                if found := [self.items[int(rows[i])].as_py() for i in range(a, b) if windows[i].as_py() == words]:
                    d = int(doc[k])
                    items[d].update(found)
                    runs[d].append((k - int(first[d]), k - int(first[d]) + width))
        stops = np.append(first[1:], len(starts))
        return [(int(b - a), r, x, starts[a:b] - at, ends[a:b] - at) for a, b, r, x, at in zip(first.tolist(), stops.tolist(), runs, items, bounds.tolist(), strict=True)]


def windows_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct (window, item) of all items."""
    inner = common.Inner(benchmark, (), item=item_id, text=text).df
    items = inner.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (WINDOW - 1)))
    windows = items.where(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, WINDOW), " "))).alias("window"))
    return windows.select("window", "item").distinct()


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what ``runs`` cover."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(text: bytes, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]).decode()


RESULTS = ("n_words", "n_hit", "hit_items", "hit_words", "hit_bytes")
_STATE = "n_words bigint, n_hit bigint, hit_items array<string>, hit_words array<int>, hit_bytes array<int>"


def _scan(docs: DataFrame, windows: pa.Table, first: bool, last: bool) -> DataFrame:
    """One pass with one broadcast block; adds to what earlier blocks have found, and the last one cuts."""
    shared = docs.sparkSession.sparkContext.broadcast(Windows(windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 1_000_000):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            rows = shared.value.scan(texts)
            if not first:
                before = zip(batch.column("hit_words").to_pylist(), batch.column("hit_items").to_pylist(), strict=True)
                rows = [(n, r + list(zip(w[::2], w[1::2], strict=True)), x | set(i), s, e) for (n, r, x, s, e), (w, i) in zip(rows, before, strict=True)]
            runs = [_union(r) for _, r, _, _, _ in rows]
            spans = [[(int(s[a]), int(e[b - 1])) for a, b in r] for r, (_, _, _, s, e) in zip(runs, rows, strict=True)]
            new = {
                "n_words": pa.array([n for n, *_ in rows], pa.int64()),
                "n_hit": pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()),
                "hit_items": pa.array([sorted(x) for _, _, x, _, _ in rows], pa.list_(pa.string())),
                "hit_words": pa.array([[k for run in r for k in run] for r in runs], pa.list_(pa.int32())),
                "hit_bytes": pa.array([[k for span in r for k in span] for r in spans], pa.list_(pa.int32())),
            }
            if last:
                new["cleaned"] = pa.array([_cut(t, s) if s else t.decode() for t, s in zip(texts, spans, strict=True)], pa.string())
            yield common.with_columns(batch, new)

    kept = docs if first else docs.drop(*RESULTS)
    return docs.mapInArrow(run, common.schema_with(kept, _STATE + (", cleaned string" if last else "")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", cleaned: str | None = None, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_items (sorted as strings), hit_words and hit_bytes.

    The last two hold from, to of each maximal run of hit words, as word numbers and as UTF-8
    bytes of the text.  ``cleaned`` names a column for the text without the hit spans.
    """
    inner = common.Inner(docs, (*RESULTS, *([cleaned] if cleaned else [])), text=text)
    out = inner.df
    with common.workspace() as keep:
        windows = common.Staged(windows_of(benchmark), "windows").df
        blocks = max(1, -(-windows.count() // max_windows))
        dealt = windows.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(blocks)))
        before = None
        for k in range(blocks):
            block = dealt.where(F.col("block") == k).select("window", "item").toArrow()  # about max_windows rows
            out = _scan(out, block, k == 0, bool(cleaned) and k == blocks - 1)
            if blocks > 1:
                staged = keep(common.Staged(out, "decontam"))
                if before:
                    before.drop()
                before, out = staged, staged.df
    return inner.outer(out, *RESULTS, *([F.col("cleaned").alias(cleaned)] if cleaned else []))
