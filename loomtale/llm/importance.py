"""Importance resampling towards a target: hashed n-gram features, log ratios of buckets, Gumbel top-k.

Words are runs of digits, letters a-z (A-Z lowered) and characters beyond ASCII.  Features are all runs
of 1 to ``ORDER`` consecutive words, joined by one space; a feature's bucket is the CRC-32 of its bytes
modulo ``BUCKETS``.  A bucket's gain is the floor of 1000 times the log of its smoothed share of the
target's features over its share of the documents'.  A document's weight is the sum of its features' gains; with Gumbel noise
by its doc_id the highest scores are a draw without replacement in proportion to exp(weight / 1000).

*Position tables.*  CRC-32 is affine in the bits of a string of a given length: it is a constant of the length
XOR one term for each byte, which depends on the byte and its distance from the end.  So a task gathers
the terms of all features' bytes from one table of ``REACH`` distances and folds each feature's span with
``bitwise_xor.reduceat``.  Longer spans are cut into blocks of ``REACH`` bytes, counted from the end; their terms are folded
block by block, each step moving the state over ``REACH`` bytes by four tables.

*Scale.*  Texts are read twice, once to count buckets and once to weigh with the gains (``BUCKETS`` numbers are all
that is collected and broadcast), and never moved.  Ranks come from a range-partitioned sort of (score, doc_id, row):
a row's place in its partition, and the number of rows of the partitions before it, which is one number for each partition.
Only the rows drawn are joined to their ranks.

Nulls: a null text has no words, weight 0 and is never drawn; a null doc_id is hashed as an empty string and comes
first among ties.  Empty texts are handled as null ones.  Repeated rows are documents of their own: they count in
all totals, and of equal scores and doc_ids the order is that of the written rows.  Very long texts stay whole.  An empty table of documents gives no rows;
without a target, or without documents, the smoothed shares alone decide.  doc_id may be of any type that has an order.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .decontam import _BYTE

ORDER, BUCKETS, SEED = 3, 10_000, 42
MIN_WORDS, PERCENT = 20, 5
#: Distances from the end that the position table holds.
REACH = 256
#: Bytes of features that are folded at a time, and words whose features are made at a time.
_FOLDED, _WORDS = 200_000, 100_000
_LOW = _BYTE.astype(np.uint8)
_ONES = np.uint32(0xFFFFFFFF)


def _moved(x: np.ndarray, n: int) -> np.ndarray:
    """CRC states after n zero bytes."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    for _ in range(n):
        x = (x >> np.uint32(8)) ^ step[x & np.uint32(255)]
    return x


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms by distance from the end and byte (flat), constants by length, and what moves a state over REACH bytes, by its bytes."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    terms = [one]
    for _ in range(REACH - 1):
        terms.append(_moved(terms[-1], 1))
    lengths = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)
    over = np.stack([_moved(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), REACH) for k in range(4)])
    return np.concatenate(terms), lengths, over


def _terms(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XOR of the terms of spans of 1 to REACH bytes."""
    table = tables()[0]
    out = np.zeros(len(starts), np.uint32)
    ends = np.cumsum(sizes)
    a = 0
    while a < len(starts):
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + _FOLDED, "right")))
        n, last = sizes[a:b], (ends[a:b] - before).astype(np.int32)
        back = np.repeat(last - 1, n) - np.arange(int(last[-1]), dtype=np.int32)  # distance from the span's end
        byte = data[np.repeat((starts[a:b] + n - 1).astype(np.int32), n) - back]
        back <<= 8
        back |= byte
        out[a:b] = np.bitwise_xor.reduceat(table[back], last - n)
        a = b
    return out


def crc32_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of ``data`` (uint8); sizes are 1 or more."""
    _, lengths, over = tables()
    far = sizes > REACH
    if not far.any():
        return _terms(data, starts, sizes) ^ lengths[sizes]
    out = np.zeros(len(starts), np.uint32)
    near = np.flatnonzero(~far)
    out[near] = _terms(data, starts[near], sizes[near]) ^ lengths[sizes[near]]
    far = np.flatnonzero(far)
    far = far[np.argsort(-sizes[far], kind="stable")]  # the longest first, so that those still folding are a prefix
    n_blocks = -(-sizes[far] // REACH)
    first = sizes[far] - (n_blocks - 1) * REACH
    state = _terms(data, starts[far], first) ^ lengths[first] ^ _ONES
    for k in range(1, int(n_blocks[0])):
        m = int(np.searchsorted(-n_blocks, -k, "left"))
        x = state[:m]
        moved = over[0][x & np.uint32(255)] ^ over[1][(x >> np.uint32(8)) & np.uint32(255)] ^ over[2][(x >> np.uint32(16)) & np.uint32(255)] ^ over[3][x >> np.uint32(24)]
        state[:m] = moved ^ _terms(data, starts[far[:m]] + first[:m] + (k - 1) * REACH, np.full(m, REACH))
    out[far] = state ^ _ONES
    return out


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words, lowered and each followed by one space, in one array; their starts, sizes and texts."""
    low = _LOW[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    inside = np.concatenate(([False], low != 0))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    low[ends] = 32
    bounds = np.cumsum([len(t) + 1 for t in texts])
    sizes = ends - starts
    return low[low != 0], np.cumsum(sizes + 1) - sizes - 1, sizes, np.searchsorted(bounds, starts, "right")


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of the features, in pieces of bounded size; texts ascend within a piece."""
    data, starts, sizes, text = words(texts)
    for a in range(0, len(starts), _WORDS):
        for width in range(1, ORDER + 1):
            at = np.arange(a, min(a + _WORDS, len(starts) - width + 1))
            at = at[text[at] == text[at + width - 1]]
            last = at + width - 1
            yield text[at], crc32_spans(data, starts[at], starts[last] + sizes[last] - starts[at]) % np.uint32(BUCKETS)


def _encoded(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket and n, the number of features, of (text): every task sends a row for each bucket that it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in common.slices(iter([batch]), "text"):
                for _, bucket in features(_encoded(part)):
                    total += np.bincount(bucket, minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(met, pa.int64()), "n": pa.array(total[met])})

    return texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain, from its features in the documents and in the target."""
    whole, aimed = float(counts.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * whole / ((s + 1) * aimed))) for s, t in zip(counts.tolist(), target.tolist(), strict=True)], np.int64)


def fit(docs: DataFrame, target: DataFrame, *, text: str = "text", target_text: str = "text") -> np.ndarray:
    """The gains of all buckets; all that comes to the driver are two numbers for each."""
    out = []
    for df, column in ((docs, text), (target, target_text)):
        found = np.zeros(BUCKETS, np.int64)
        for r in bucket_counts(common.Inner(df, (), text=column).df).collect():  # BUCKETS rows at most
            found[r["bucket"]] = r["n"]
        out.append(found)
    return gains(*out)


def gumbel(doc_id: Column) -> Column:
    """1000 times standard Gumbel noise, floored, by the first 32 bits of a hash of the seed and doc_id."""
    text = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def weigh(inner: DataFrame, gain: np.ndarray) -> DataFrame:
    """``inner`` (with ``text``) and n_words, n_features and weight, in one pass without a shuffle."""
    shared = inner.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            n = batch.num_rows
            made, weight = np.zeros((ORDER, n), np.int64), np.zeros(n, np.int64)
            for k, (text, bucket) in enumerate(features(_encoded(batch))):
                if len(text):
                    first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
                    weight[text[first]] += np.add.reduceat(shared.value[bucket], first)
                    made[k % ORDER] += np.bincount(text, minlength=n)
            yield common.with_columns(batch, {"n_words": pa.array(made[0]), "n_features": pa.array(made.sum(0)), "weight": pa.array(weight)})

    return inner.mapInArrow(run, common.schema_with(inner, "n_words bigint, n_features bigint, weight bigint"))


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, score, row) with rank, 1 for the highest score; no task holds more than its range.

    The sort is by range, and its last key has no ties, so that equal scores of one document are dealt out as well.
    """
    ordered = rows.orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "row").withColumn("at", F.monotonically_increasing_id())
    ordered = common.Staged(ordered.select("*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")), "ordered").df
    counts = sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "part bigint, before bigint")
    return ordered.join(F.broadcast(offsets), "part").select("doc_id", "score", "row", (F.col("before") + F.col("place") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_features, weight, score and rank.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred are drawn, those of the highest scores, ties to
    smaller doc_ids; rank is null for all others.
    """
    inner = common.Inner(docs, ("n_words", "n_features", "weight", "score", "rank"), doc_id=doc_id, text=text)
    gain = fit(docs, target, text=text, target_text=target_text)
    weighed = weigh(inner.df, gain)
    if not keep_text:
        weighed, inner.kept = weighed.drop("text"), [x for x in inner.kept if x[0] != "text"]
    with common.workspace() as keep:
        scored = keep(common.Staged(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"))).withColumn("row", F.monotonically_increasing_id()), "scored")).df
        slim = scored.where(F.col("n_words") >= min_words).select("doc_id", "score", "row")
        drawn = slim.count() * percent // 100
        ranks = keep(common.Staged(_ranked(slim).where(F.col("rank") <= drawn).select("row", "score", "rank"), "ranks")).df
    worst = ranks.agg(F.min("score")).first()[0]
    # only rows that may have been drawn are joined; all of lower scores pass by
    near = (F.col("n_words") >= min_words) & (F.col("score") >= F.lit(worst).cast("long"))
    near = F.coalesce(near, F.lit(False))
    joined = scored.where(near).join(ranks.select("row", "rank"), "row", "left")
    rest = scored.where(~near).withColumn("rank", F.lit(None).cast("long"))
    return inner.outer(joined.unionByName(rest), "n_words", "n_features", "weight", "score", "rank")
