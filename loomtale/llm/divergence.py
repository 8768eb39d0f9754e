"""Audit of sources: how far each source of a language departs from the others, and by which terms.

Terms are runs of letters a-z (A-Z lowered) and characters beyond ASCII.  A language keeps the V terms that
at least ``MIN_DOCS`` of its documents have.  In a group of n occurrences among N of kept terms a term has
p = 1 + floor(SCALE * (n + 1) / (N + V)).  Against a reference q, f = floor((p - q)**2 / q).  ``pair`` rows hold the sum of f over
all kept terms against each other source of the language, ``term`` rows the ``TOP`` terms that a group overuses against
its whole language.  All arithmetic is on integers.

*Counting.*  Tasks pack the terms of a few MB of text by length: up to 8 bytes are one uint64, up to 16 two, first byte
highest, so that numbers order as bytes do.  Packed terms are sorted by 16-bit digits from the last to the first, which numpy does by
radix, and counted in runs; as texts are taken group by group and the sort is stable, one run has a group's
occurrences together, and a document's.  Longer terms lie in a table for each power of two of their length, sorted by bytes.
Spark adds the counts up, by group and term, before and after one exchange.

*Scale.*  Texts are read once and never moved.  Kept terms meet their counts by (language, term).  For pairs, a language's kept terms
are dealt by hash into blocks of about ``BLOCK`` counts; a task adds f over one block for all pairs of sources, a few
terms at a time, and Spark adds the blocks: no pair of sources meets term by term outside a task.  Each block needs
the sources' totals, a row for each.  The work is terms x sources**2 of a language, as is the result x terms.

Null texts, languages and sources are empty strings.  Empty texts have no terms, but their group has its rows.
Repeated rows are documents of their own.  Ties go to the item that is less in UTF-8.  Very long texts stay whole, terms of any
length count.  A language that keeps no term has pairs of value 0; a language of one source has no pairs; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Counts of a block of terms, and cells that a task compares at a time.
BLOCK, _CELLS = 100_000, 500_000
_LOW = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 0 for b in range(256)], np.uint8)
#: Which bytes of a word count, by how many of them do.
_MASK = np.array([0, *[(2**64 - 1) ^ (2 ** (8 * (8 - k)) - 1) for k in range(1, 9)]], np.uint64)


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by uint64 columns, the first one highest: 16 bits at a time, from the last."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in (0, 16, 32, 48):
            digit = (key >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a run begins: at 0, and where any column differs from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def packed(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The terms by length: which they are, in the stable order of their bytes, and columns that tell them apart in that order, but for zero bytes at their ends."""
    words = np.ndarray((len(low) - 7,), ">u8", low, strides=(1,))  # the 8 bytes from each place on
    for least, most in ((1, 8), (9, 16)):
        at = np.flatnonzero((sizes >= least) & (sizes <= most))
        if len(at):
            keys = [words[starts[at]].astype(np.uint64) & _MASK[np.minimum(sizes[at], 8)]]
            if least > 8:
                keys.append(words[starts[at] + 8].astype(np.uint64) & _MASK[sizes[at] - 8])
            order = radix_order(keys)
            yield at[order], [k[order] for k in keys]
    long = np.flatnonzero(sizes > 16)
    width = 32
    while len(long):
        fits = sizes[long] <= width
        at, long = long[fits], long[~fits]
        if len(at):
            table = np.zeros((len(at), width), np.uint8)
            column = np.arange(int(sizes[at].sum())) - np.repeat(np.cumsum(sizes[at]) - sizes[at], sizes[at])
            table[np.repeat(np.arange(len(at)), sizes[at]), column] = low[np.repeat(starts[at], sizes[at]) + column]
            strings = table.view(f"S{width}").ravel()  # terms have no zero bytes
            order = np.argsort(strings, kind="stable")
            yield at[order], [strings[order]]
        width *= 2


def _strings(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    data = low[np.arange(int(offsets[-1])) + np.repeat(starts - offsets[:-1], sizes)]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


def count_terms(texts: list[bytes], groups: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(group, term, occurrences, documents) of some texts; a group's texts stand together."""
    data = b"\n".join([*texts, b"\n" * 16])
    low = _LOW[np.frombuffer(data, np.uint8)]
    inside = np.concatenate(([False], low != 0))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    group = groups[doc]
    for at, keys in packed(low, starts, sizes):
        first = np.flatnonzero(changes([*keys, group[at]]))
        documents = np.add.reduceat(changes([*keys, doc[at]]).astype(np.int64), first)
        yield group[at[first]], _strings(low, starts[at[first]], sizes[at[first]]), np.diff(np.append(first, len(at))), documents


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and documents of (lang, source, text); a row without a term for each group and task, so that none is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 8_000_000):
            names: dict[tuple[str, str], int] = {}
            pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            group = np.array([names.setdefault(p, len(names)) for p in pairs])
            order = np.argsort(group, kind="stable")
            texts = batch.column("text").cast(pa.binary()).take(pa.array(order)).to_pylist()
            langs, sources = (pa.array([n[k] for n in names], pa.string()) for k in (0, 1))

            def sent(of: np.ndarray, term: pa.Array, n: np.ndarray, documents: np.ndarray) -> pa.RecordBatch:
                at = pa.array(of)
                return pa.RecordBatch.from_pydict({"lang": langs.take(at), "source": sources.take(at), "term": term, "n": pa.array(n, pa.int64()), "documents": pa.array(documents, pa.int64())})  # noqa: B023

            nothing = np.zeros(len(names), np.int64)
            yield sent(np.arange(len(names)), pa.nulls(len(names), pa.string()), nothing, nothing)
            for found in count_terms(texts, group[order]):
                yield sent(*found)

    made = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]).mapInArrow(run, "lang string, source string, term string, n bigint, documents bigint")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _share(n: str, total: str, kept: str) -> str:
    """SQL of p; products of large counts need more than 64 bits."""
    return f"1 + (cast({SCALE} as decimal(10, 0)) * cast({n} + 1 as decimal(20, 0))) div cast({total} + {kept} as decimal(20, 0))"


_DISTANCE = "(p - q) * (p - q) div q"


def _pair_sums(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item and value of all pairs: entries (lang, source, term, p), groups (lang, source, p0)."""
    n_blocks = entries.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    blocks = groups.select("lang").distinct().join(n_blocks, "lang", "left").select("lang", F.ceil(F.coalesce("rows", F.lit(0)) / BLOCK + 1).cast("long").alias("blocks"))
    blocks = common.Staged(blocks, "blocks").df  # a row for each language
    dealt = entries.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "p")
    totals = groups.join(blocks, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))

    def run(table: pa.Table) -> pa.Table:
        absent = pa.compute.is_null(table.column("term"))
        sources, counts = table.filter(absent), table.filter(pa.compute.invert(absent))
        names = sources.column("source").combine_chunks()
        base = sources.column("p").to_numpy()
        source = pa.compute.index_in(counts.column("source"), names).to_numpy()
        terms = counts.column("term").combine_chunks().dictionary_encode()
        term, p = terms.indices.to_numpy(), counts.column("p").to_numpy()
        order = np.argsort(term, kind="stable")
        source, term, p = source[order], term[order], p[order]
        value = np.zeros((len(names), len(names)), np.int64)
        step = max(1, _CELLS // max(1, len(names)))
        for a in range(0, len(terms.dictionary), step):
            low, high = np.searchsorted(term, (a, a + step))
            cells = np.tile(base, (min(step, len(terms.dictionary) - a), 1))
            cells[term[low:high] - a, source[low:high]] = p[low:high]
            for g in range(len(names)):
                value[g] += ((cells[:, g : g + 1] - cells) ** 2 // cells).sum(0)
        g, other = (x.ravel() for x in np.indices(value.shape))
        apart = np.flatnonzero(g != other)
        lang = pa.repeat(table.column("lang")[0], len(apart))
        return pa.table({"lang": lang, "source": names.take(pa.array(g[apart])), "item": names.take(pa.array(other[apart])), "value": pa.array(value.ravel()[apart])})

    sums = dealt.unionByName(totals).groupBy("lang", "block").applyInArrow(run, "lang string, source string, item string, value bigint")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank."""
    inner = common.Inner(docs, (), text=text, lang=lang, source=source).df
    with common.workspace() as keep:
        counts = common.Staged(term_counts(inner), "counts").df
        words = counts.where("term is not null")
        kept = words.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("whole")).where(F.col("documents") >= min_docs)
        kept = common.Staged(kept.select("lang", "term", "whole"), "kept").df
        vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("whole").alias("lang_n"))
        found = common.Staged(words.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "whole"), "found").df
        totals = found.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
        groups = groups.select("lang", "source", F.coalesce("group_n", F.lit(0)).cast("long").alias("group_n"), F.coalesce("v", F.lit(0)).cast("long").alias("v"), "lang_n")
        groups = common.Staged(groups, "groups").df
        # one row for each count, with its group's and its language's share
        entries = found.join(groups, ["lang", "source"]).select("lang", "source", "term", F.expr(_share("n", "group_n", "v")).alias("p"), F.expr(_share("whole", "lang_n", "v")).alias("q"))
        entries = common.Staged(entries, "entries").df
        none = groups.select("lang", "source", F.expr(f"case when v > 0 then {_share('0', 'group_n', 'v')} else 1 end").alias("p0"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = _pair_sums(entries.select("lang", "source", "term", "p"), none).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        pairs = pairs.withColumn("rank", F.row_number().over(order))
        over = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_DISTANCE).alias("value"))
        # Spark keeps each task's first ranks before the exchange, so that a large group isn't moved whole
        terms = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return keep(common.Staged(pairs.unionByName(terms), "audit")).df
