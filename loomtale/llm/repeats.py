"""First and later occurrences of hashed pieces of documents: what both exact span dedups share.

An occurrence is (id, k, pos): the doc_id (null: the least long), a hash of the row that
tells rows of one doc_id apart, and a place in the text.  Rows equal in doc_id and text are one
document; each of them gets its result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

LEAST = -(1 << 63)
KEY = ("id", "k")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) with id and k; doc_id must be of an integer type."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be an integer, for its order decides; it is {kind.simpleString()}")
    return docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), "k": F.xxhash64("doc_id", "text")})


def local_repeats(a: np.ndarray, b: np.ndarray, ids: np.ndarray, ks: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Marks the occurrences of a piece (a, b) after its first one among these.

    What is left to send for a piece is one row for each batch, however many copies there are.
    """
    order = np.lexsort((pos, ks, ids, b, a))
    same = np.concatenate(([False], (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])))
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    later = (ids[order] != ids[first]) | (ks[order] != ks[first]) | (pos[order] != pos[first])
    out = np.zeros(len(order), bool)
    out[order] = same & later
    return out


def runs_of(mask: np.ndarray, ids: np.ndarray, ks: np.ndarray, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Starts of the runs of marked, adjacent pieces; run i ends where run i+1 starts, among the marked."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at
    i, j = at[:-1], at[1:]
    joined = (j == i + 1) & (ids[i] == ids[j]) & (ks[i] == ks[j]) & (pos[i] + n[i] == pos[j])
    return np.flatnonzero(np.concatenate(([True], ~joined)))


ROWS = "a bigint, b bigint, id bigint, k bigint, pos int, n int, known boolean"


def rows(a: np.ndarray, b: np.ndarray, ids: np.ndarray, ks: np.ndarray, pos: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A batch of ROWS: first occurrences of the pieces, and runs of pieces known to be repeats.

    The runs carry hashes of their own place, so that they spread over the partitions.
    """
    late = local_repeats(a, b, ids, ks, pos)
    starts = runs_of(late, ids, ks, pos, n)
    at = np.flatnonzero(late)
    widths = np.add.reduceat(n[at], starts) if len(at) else n[:0]
    run = at[starts]
    new = ~late
    spread = (ks[run].astype(np.uint64) + pos[run].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    join = lambda x, y: pa.array(np.concatenate((x, y)))
    return pa.RecordBatch.from_pydict(
        {
            "a": join(a[new].view(np.int64), spread),
            "b": join(b[new].view(np.int64), np.zeros(len(run), np.int64)),
            "id": join(ids[new], ids[run]),
            "k": join(ks[new], ks[run]),
            "pos": join(pos[new].astype(np.int32), pos[run].astype(np.int32)),
            "n": join(n[new].astype(np.int32), widths.astype(np.int32)),
            "known": join(np.zeros(int(new.sum()), bool), np.ones(len(run), bool)),
        }
    )


def marked(found: DataFrame) -> DataFrame:
    """``found`` by piece (a, b) in one exchange, with ``later``: the piece occurs before.

    A hot piece has a row for each batch at most, so that no partition stands out.
    """
    piece = Window.partitionBy("a", "b").orderBy("id", "k", "pos")
    return found.withColumn("later", F.col("known") | (F.rank().over(piece) > 1))


def spans_of(spans: DataFrame, start: Column, stop: Column) -> DataFrame:
    """(id, k, spans): the spans of each document, as many as it has places at most."""
    return spans.select(*KEY, F.struct(start.alias("s"), stop.alias("e")).alias("x")).groupBy(*KEY).agg(F.collect_set("x").alias("spans"))
