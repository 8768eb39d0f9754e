"""Quality by compression: two zstandard dictionaries, one of good and one of bad labelled text.

A text that compresses better beside good text than beside bad text is likelier good.  The
difference of its two compressed sizes, divided by its own size, is all that is known of a text; it
and its square go through a logistic curve, so that the score is a calibrated probability.

Fitting takes a bounded sample of the labelled rows: of each class the ``PER_CLASS`` rows that come
first by a hash of doc_id, texts of over ``LONGEST`` bytes aside.  Half of them make the
dictionaries, the other half the curve, weighted to the classes' shares among all labelled rows.
Every text is scored whole, in blocks of ``BLOCK`` bytes.  Without rows of both classes the score
is the share of good rows among the labelled (0.5 without any).

Null text is empty; an empty text has sizes of zero and gets what the curve says of it.  Repeated
label rows of a document count once, the least label; rows with a null label don't count.  Of
several documents of one doc_id the sample takes the one of the least text hash; all are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PER_CLASS, LONGEST = 3_000, 16_384
#: A short block leaves most of the saving to the dictionary, not to the text's own repeats.
DICTIONARY, BLOCK, LEVEL = 112_640, 512, 3


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int, modulus: int, remainder: int) -> tuple[list[tuple[str, int]], float]:
    """At most per_class whole texts of each class, in the order of a hash, and the share of class 1."""
    docs, labels = common.only(docs, ("doc_id", "text")), common.only(labels, ("doc_id", label))
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("__label"))
    counts = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    order = F.xxhash64("doc_id", F.lit(label))
    chosen = [known.where(F.col("__label") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    # 2 * per_class ids at most, so they can be broadcast
    texts = docs.where(F.octet_length("text") <= longest).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    texts = texts.groupBy("doc_id", "__label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # a row for each id
    rows = sorted((r["doc_id"], r["text"], r["__label"]) for r in texts.collect())
    total = sum(counts.values())
    return [(t, y) for _, t, y in rows], counts.get(1, 0) / total if total else 0.5


def blocks(text: str) -> list[bytes]:
    data = text.encode()
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: their text itself serves
        return b"".join(samples)[-DICTIONARY:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Coefficients of a ridge logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    good: bytes
    bad: bytes
    beta: np.ndarray | None
    share: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for data in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def score(self, texts: list[str], compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
        if self.beta is None:
            return np.full(len(texts), self.share)
        return sigmoid(features(texts, compressors) @ self.beta)


def features(texts: list[str], compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """1, the normalised size difference and its square."""
    sizes = [[sum(len(c.compress(b)) for b in p) for c in compressors] + [sum(map(len, p))] for p in map(blocks, texts)]
    good, bad, raw = np.array(sizes, float).reshape(-1, 3).T
    difference = 10 * (bad - good) / np.maximum(raw, 1)
    return np.stack([np.ones(len(texts)), difference, difference**2], axis=1)


def fit(docs: DataFrame, labels: DataFrame, *, modulus: int = 3, remainder: int = 1) -> Model:
    rows, share = labelled_sample(docs, labels, "quality", PER_CLASS, LONGEST, modulus, remainder)
    parts: dict[tuple[int, int], list[str]] = {(y, half): [] for y in (0, 1) for half in (0, 1)}
    seen = [0, 0]
    for t, y in rows:
        parts[y, seen[y] % 2].append(t)
        seen[y] += 1
    if not all(parts.values()):
        return Model(b"", b"", None, share)
    model = Model(_dictionary([b for t in parts[1, 0] for b in blocks(t)]), _dictionary([b for t in parts[0, 0] for b in blocks(t)]), None, share)
    texts, y = parts[1, 1] + parts[0, 1], np.array([1.0] * len(parts[1, 1]) + [0.0] * len(parts[0, 1]))
    weight = np.where(y == 1, share / len(parts[1, 1]), (1 - share) / len(parts[0, 1])) * len(y)
    model.beta = logistic(features(texts, model.compressors()), y, weight)
    return model


def score_quality(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    inner = common.Inner(docs, ("score",), text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY bytes
    ready: list[list[zstandard.ZstdCompressor]] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not ready:
            ready.append(shared.value.compressors() if shared.value.beta is not None else [])
        for batch in common.slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield common.with_columns(batch, {"score": pa.array(shared.value.score(texts, ready[0]), pa.float64())})

    return inner.outer(inner.df.mapInArrow(run, common.schema_with(inner.df, "score double")), "score")
