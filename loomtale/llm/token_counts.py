"""Token counts of whole texts by a two-tier lookup on the map side.

Tier one is a compact hash table, broadcast to every worker: the token lengths of frequent
pre-tokens.  Which they are is read off about ``SAMPLE`` rows drawn at random, texts of over
``SAMPLE_BYTES`` aside, so that the driver holds a bounded sample and no pre-token is ever
shuffled.  Tier two is a cache in each Python worker: pre-tokens that the table lacks are encoded
by the library once in a batch and remembered.  The table only saves time: every pre-token of every
text is counted, whatever it holds.

Null and empty texts have 0 bytes and 0 tokens.  Rows are independent, so repeated
rows, ties and very long texts have no special case.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sp_codec

#: Rows of the broadcast table, characters of a pre-token in it, rows of the sample it comes from, bytes of their texts at most.
FREQUENT, LONGEST, SAMPLE, SAMPLE_BYTES = 32_768, 32, 2_000, 16_384
#: Lengths that a worker remembers.
CACHE = 500_000


def frequent(docs: DataFrame, text: str = "text") -> list[str]:
    """The most frequent pre-tokens of about ``SAMPLE`` rows drawn at random, of texts up to ``SAMPLE_BYTES``."""
    some = docs.select(F.col(text).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    share = SAMPLE / max(SAMPLE, docs.count())
    rows = some.where(F.rand(1) < share).limit(2 * SAMPLE).collect()  # 2 * SAMPLE * SAMPLE_BYTES at most
    seen: Counter[str] = Counter()
    for r in rows:
        seen.update(sp_codec.UNITS.findall(" " + r["text"].replace(sp_codec.MARK, " ")) if r["text"] else ())
    return [u for u, _ in seen.most_common(FREQUENT) if len(u) <= LONGEST]


class _Lengths:
    """A worker's cache of token lengths."""

    def __init__(self, path: str):
        self.pieces = sp_codec.model(path)
        self.known: dict[str, int] = {}

    def learn(self, units: list[str]) -> None:
        if len(self.known) + len(units) > CACHE:
            for u in list(self.known)[: CACHE // 2]:
                del self.known[u]
        ids = self.pieces.library([u.replace(" ", sp_codec.MARK) for u in units])
        self.known.update(zip(units, map(len, ids), strict=True))


_caches: dict[str, _Lengths] = {}


def count_tokens(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` long, as the library counts them without begin or end id."""
    inner = common.Inner(docs, ("n_tokens",), text=text)
    top = frequent(inner.df)
    lengths = map(len, sp_codec.model(path).library([u.replace(" ", sp_codec.MARK) for u in top]))
    first = docs.sparkSession.sparkContext.broadcast(dict(zip(top, lengths, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tier1 = first.value
        cache = _caches.setdefault(path, _Lengths(path))
        for batch in common.slices(batches, "text"):
            cut = [sp_codec.UNITS.findall(" " + t.replace(sp_codec.MARK, " ")) if t else [] for t in batch.column("text").to_pylist()]
            tier2 = cache.known
            distinct = set().union(*cut)
            misses = [u for u in distinct if u not in tier1 and u not in tier2]
            if misses:
                cache.learn(misses)
            local = {u: tier1[u] if u in tier1 else tier2.get(u, -1) for u in distinct}
            if lost := [u for u, n in local.items() if n < 0]:  # forgotten while room was made
                cache.learn(lost)
                local |= {u: cache.known[u] for u in lost}
            yield common.with_columns(batch, {"n_tokens": pa.array([sum(map(local.__getitem__, units)) for units in cut], pa.int64())})

    return inner.outer(inner.df.mapInArrow(run, common.schema_with(inner.df, "n_tokens bigint")), "n_tokens")
