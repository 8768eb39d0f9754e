"""Near-duplicate classes by ProbMinHash, banding and verification.

A document is a set of shingles of ``SHINGLE`` consecutive words, each weighted by how often it
occurs (a text of fewer words is one shingle).  Similarity is the probability Jaccard of the
weights, which for weights of one is the Jaccard of the sets.

*Sketch.*  Each shingle starts a Poisson process whose rate is its weight; every arrival falls into
one of ``REGISTERS`` registers, which keeps its earliest.  A process ends as soon as its next
arrival is later than all registers of its document.  The chance that two documents agree in a
register is their similarity.  ``ROWS`` registers make a band.

*Candidates.*  Documents of equal words are one node; nodes that agree in a band share a bucket.  All
nodes of a bucket are compared with one of them, its pivot: the node that shares the most buckets
with others, which in a group of near copies is what they were copied from.
*The rest.*  Where a bucket then still holds several classes, every node outside the pivot's class is
compared with all nodes of the bucket.  A task keeps nodes outside of about ``WIDE`` bytes of shingles
and streams about as many of all nodes past them, in tiles of ``BLOCK`` bytes, however large the bucket
is.  A bucket of N bytes with S outside moves N + S up to ``WIDE``, and 2 N S / ``WIDE`` beyond.  So each
pair that shares a bucket is compared unless links have put it into one class, and no pair becomes a
row: a task hands on a link only if it joins two classes for the first time in its block.

*Verification.*  Comparisons are exact, on all shingles: common shingles are counted by matrix products,
and pairs with a weight above one whose shared mass allows it are computed one by one.
*Classes.*  Components by alternating large and small stars; edges are cut to a shared table.

A pair of similarity 0.8 misses all bands with a chance of 2e-6.  A text without words is a class of
its own.  Rows of equal words, in one doc_id or several, are in one class.  The class is named by its
least doc_id (null first).  doc_id must be an integer.  Equal words are told by 128 bits and shingles
by 64 of hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .decontam import _rolled, _words
from .repeats import LEAST, keyed

SHINGLE, SIMILARITY = 5, 0.8
#: What a similarity may miss by rounding.
NEAR = 1e-9
REGISTERS, ROWS = 264, 6
#: Bytes of shingles that are compared at a time and that a task keeps of a bucket's rest, and bytes that a node counts for at least.
BLOCK, WIDE, LEAST_BYTES = 1_000_000, 24_000_000, 1_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and weight of every distinct shingle, by text and hash; and a hash of each text's words (0: none)."""
    starts, _, h = _words(b"\n".join(texts))
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.searchsorted(starts, np.cumsum(sizes) - sizes)
    counts = np.diff(np.append(first, len(h)))
    doc = np.repeat(np.arange(len(texts)), counts)
    whole = np.zeros(len(texts), np.uint64)
    place = np.arange(len(h), dtype=np.uint64) - first[doc].astype(np.uint64)
    np.bitwise_xor.at(whole, doc, _mix(h + _mix(place * _A)))
    whole[counts > 0] |= np.uint64(1)
    out_doc, out_hash = [], []
    for width in range(1, SHINGLE + 1):
        w = _rolled(h, width)
        at = np.flatnonzero(doc[: len(w)] == doc[width - 1 :][: len(w)]) if len(w) else np.empty(0, np.int64)
        if width < SHINGLE:
            at = at[counts[doc[at]] == width]
        out_doc.append(doc[at])
        out_hash.append(w[at])
    doc, h = np.concatenate(out_doc), np.concatenate(out_hash)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.empty(0, np.int64)
    return doc[new], h[new], np.diff(np.append(new, len(h))), whole


def sketch(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The winning shingle of each register for ``n`` documents."""
    times = np.full(n * REGISTERS, np.inf)
    winners = np.zeros(n * REGISTERS, np.uint64)
    clock, step, burst = np.zeros(len(h)), 0, 1
    while len(h):
        number = np.arange(step, step + burst, dtype=np.uint64)
        draw = _mix(h[:, None] + (number + np.uint64(1)) * _A)
        register = (draw % np.uint64(REGISTERS)).astype(np.int64)
        waits = -np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight[:, None]
        arrival = clock[:, None] + np.cumsum(waits, axis=1)
        slot = (doc[:, None] * REGISTERS + register).ravel()
        flat = arrival.ravel()
        np.minimum.at(times, slot, flat)
        won = np.flatnonzero(flat == times[slot])
        winners[slot[won]] = np.repeat(h, burst)[won]
        clock = arrival[:, -1]
        going = clock <= times.reshape(n, REGISTERS).max(1)[doc]  # the others can't win any more
        doc, h, weight, clock = doc[going], h[going], weight[going], clock[going]
        step += burst
        burst = 1 if step < 3 else 32
    return winners.reshape(n, REGISTERS)


def bands(winners: np.ndarray) -> np.ndarray:
    """A hash of each band's registers and number."""
    grouped = winners.reshape(len(winners), REGISTERS // ROWS, ROWS)
    out = np.broadcast_to(np.arange(REGISTERS // ROWS, dtype=np.uint64) * _A, grouped.shape[:2]).copy()
    for k in range(ROWS):
        out = _mix(out * _C + grouped[:, :, k])
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """id, k, w1, w2 (hashes of the words; w1 null without any) and the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 1_000_000):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            doc, h, weight, whole = shingles(texts)
            found = bands(sketch(doc, h, weight, len(texts)))
            second = np.zeros(len(texts), np.uint64)
            np.add.at(second, doc, _mix(h + weight.astype(np.uint64)))
            offsets = pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32))
            w1 = pa.array(whole.view(np.int64), mask=whole == 0)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "k": batch.column("k"), "w1": w1, "w2": pa.array(second.view(np.int64)), "bands": pa.ListArray.from_arrays(offsets, pa.array(found.view(np.int64).ravel()))})

    return docs.select("id", "k", "text").mapInArrow(run, "id bigint, k bigint, w1 bigint, w2 bigint, bands array<bigint>")


def shingle_table(texts: DataFrame) -> DataFrame:
    """node, bytes, h (sorted hashes of the shingles) and w (their weights; null: all one) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 1_000_000):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            doc, h, weight, _ = shingles(texts)
            at = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
            hs = [h[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
            ws = [weight[a:b].astype(np.int32).tobytes() if weight[a:b].max(initial=1) > 1 else None for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "bytes": pa.array([max(LEAST_BYTES, len(x)) for x in hs], pa.int64()), "h": pa.array(hs, pa.binary()), "w": pa.array(ws, pa.binary())})

    return texts.select("node", "text").mapInArrow(run, "node struct<id:bigint,k:bigint>, bytes bigint, h binary, w binary")


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets, each as sorted hashes and weights."""
    union = np.union1d(a[0], b[0])
    wa, wb = np.zeros(len(union)), np.zeros(len(union))
    wa[np.searchsorted(union, a[0])] = a[1]
    wb[np.searchsorted(union, b[0])] = b[1]
    both = np.flatnonzero((wa > 0) & (wb > 0))
    if not len(both):
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = np.where(wb > 0, wa / np.maximum(wb, 1e-300), np.inf)
    order = np.argsort(ratio, kind="stable")
    above = np.concatenate((np.cumsum(wa[order][::-1])[::-1], [0.0]))  # of those with at least this ratio
    below = np.concatenate(([0.0], np.cumsum(wb[order])))
    at = np.searchsorted(ratio[order], ratio[both], "left")
    return float((wa[both] / (above[at] + ratio[both] * below[at])).sum())


class _Side:
    """Some nodes of a block: their classes, and all their shingles with text number, hash and weight."""

    def __init__(self, rows: list[tuple[int, bytes, bytes | None]]):
        self.classes = np.array([c for c, _, _ in rows])
        self.sets = [(np.frombuffer(h, np.uint64), np.ones(len(h) // 8) if w is None else np.frombuffer(w, np.int32).astype(float)) for _, h, w in rows]
        self.heavy = np.array([w is not None for _, _, w in rows])
        self.sizes = np.array([len(h) for h, _ in self.sets])
        self.total = np.array([w.sum() for _, w in self.sets])
        self.row = np.repeat(np.arange(len(rows)), self.sizes)
        self.h = np.concatenate([h for h, _ in self.sets])
        self.mass = np.concatenate([w for _, w in self.sets]) / np.repeat(self.total, self.sizes)


def _shared(left: _Side, right: _Side) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of a value for each shingle of either side: the sums of products over common shingles, for all pairs."""
    known, at = np.unique(left.h, return_inverse=True)
    to = np.minimum(np.searchsorted(known, right.h), len(known) - 1)
    both = known[to] == right.h
    n_left, n_right = np.bincount(at, minlength=len(known)), np.bincount(to[both], minlength=len(known))
    n, m = len(left.sizes), len(right.sizes)
    common_to_many = 64 * n_left * n_right >= n * m
    number = np.cumsum(common_to_many) - 1
    # entries of shingles that few pairs share, by shingle
    few = np.flatnonzero(~common_to_many[at] & (n_right[at] > 0))
    few = few[np.argsort(at[few], kind="stable")]
    few_right = np.flatnonzero(both & ~common_to_many[to])
    first = np.searchsorted(at[few], to[few_right])
    count = n_left[to[few_right]]
    dense_left, dense_right = np.flatnonzero(common_to_many[at]), np.flatnonzero(both & common_to_many[to])

    def sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(n * m)
        for some in np.split(np.arange(len(few_right)), np.flatnonzero(np.diff(np.cumsum(count) // 1_000_000)) + 1):
            pair = np.repeat(some, count[some])
            a = few[np.arange(len(pair)) - np.repeat(np.cumsum(count[some]) - count[some], count[some]) + first[pair]]
            b = few_right[pair]
            out += np.bincount(left.row[a] * m + right.row[b], x[a] * y[b], n * m)
        out = out.reshape(n, m)
        for start in range(0, int(number[-1]) + 1, 2048):
            sides = []
            for side, entries, column, value in ((left, dense_left, at, x), (right, dense_right, to, y)):
                e = entries[(number[column[entries]] >= start) & (number[column[entries]] < start + 2048)]
                table = np.zeros((len(side.sizes), 2048), np.float32)
                table[side.row[e], number[column[e]] - start] = value[e]
                sides.append(table)
            out += sides[0] @ sides[1].T
        return out

    return sums


class _Block:
    """The classes of a block's nodes, by number, joined as links between them are found."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.names: list[tuple] = []
        self.up: list[int] = []

    def number(self, name: tuple) -> int:
        if name not in self.numbers:
            self.numbers[name] = len(self.names)
            self.up.append(len(self.names))
            self.names.append(name)
        return self.numbers[name]

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def met(self, left: _Side, right: _Side) -> list[tuple[tuple, tuple]]:
        """Links that similar nodes of the two sides make between classes, none that earlier ones make already."""
        ours, theirs = (np.array([self.top(c) for c in x.classes.tolist()]) for x in (left, right))
        other = ours[:, None] != theirs[None, :]
        if not other.any():
            return []
        sums = _shared(left, right)
        shared = np.rint(sums(np.ones(len(left.h)), np.ones(len(right.h))))
        alike = other & (shared >= (SIMILARITY - NEAR) * (left.sizes[:, None] + right.sizes[None, :] - shared))
        heavy = left.heavy[:, None] | right.heavy[None, :]
        out = []

        def link(i: int, j: int) -> None:
            if (a := self.top(i)) != (b := self.top(j)):
                self.up[a] = b
                out.append((self.names[i], self.names[j]))

        i, j = np.nonzero(alike & ~heavy)
        for code in np.unique(ours[i] * len(self.up) + theirs[j]).tolist():
            link(*divmod(code, len(self.up)))
        if heavy.any():
            # probability Jaccard is never above the mass that either side has on common shingles
            mass = np.minimum(sums(left.mass, np.ones(len(right.h))), sums(np.ones(len(left.h)), right.mass))
            for i, j in np.argwhere(other & heavy & (mass >= SIMILARITY - 1e-4)).tolist():
                a, b = int(ours[i]), int(theirs[j])
                if self.top(a) != self.top(b) and probability_jaccard(left.sets[i], right.sets[j]) >= SIMILARITY - NEAR:
                    link(a, b)
        return out


def _joined(rows: Iterator[tuple]) -> Iterator[tuple[tuple, tuple]]:
    """Links between classes that similar nodes of a block's two sides make, none twice.

    A row: left, class, h, w; those of the left side come first and are kept, the others pass by in tiles.
    """
    block, kept, tile, size = _Block(), [], [], 0

    def full() -> Iterator[tuple[tuple, tuple]]:
        side = _Side(tile)
        if is_left:
            kept.append(side)
            return
        for held in kept:
            yield from block.met(held, side)

    for is_left, sides in groupby(rows, lambda r: r[0]):
        for _, name, h, w in sides:
            if h:
                tile.append((block.number(name), h, w))
                size += max(LEAST_BYTES, len(h))
                if size >= BLOCK:
                    yield from full()
                    tile, size = [], 0
        if tile:
            yield from full()
            tile, size = [], 0
        if not kept:
            return


def _compared(rows: DataFrame, shingled: DataFrame) -> DataFrame:
    """Links (a, b) of classes in the blocks of ``rows``: block, left, node, class."""
    dealt = rows.join(shingled.select("node", "h", "w"), "node").select("block", "left", F.col("class.id").alias("id"), F.col("class.k").alias("k"), "h", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("block", "left", "id", "k", "h", "w")), strict=True)

        def sent(found: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
            flat = [(*a, *b) for a, b in found]
            return pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in flat], pa.int64()) for i, n in enumerate(("id", "k", "b_id", "b_k"))})

        found: list[tuple[tuple, tuple]] = []
        for _, block in groupby(every(), lambda r: r[0]):
            for pair in _joined((left, (i, k), h, w) for _, left, i, k, h, w in block):
                found.append(pair)
                if len(found) > 10_000:
                    yield sent(found)
                    found = []
        yield sent(found)

    # a block's left side is bounded by WIDE; blocks of one hash are compared together, which is harmless
    links = dealt.repartition("block").sortWithinPartitions("block", F.desc("left")).mapInArrow(run, "id bigint, k bigint, b_id bigint, b_k bigint")
    return links.select(F.struct("id", "k").alias("a"), F.struct(F.col("b_id").alias("id"), F.col("b_k").alias("k")).alias("b")).distinct()


def _parts(n_bytes: Column, of: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n_bytes / of)).cast("long")


def _star_blocks(stars: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks of pivots with their nodes; stars: pivot, node."""
    members = stars.join(sizes, "node")
    parts = members.groupBy("pivot").agg(_parts(F.sum("bytes"), BLOCK).alias("parts"))
    right = members.join(parts, "pivot").select(F.xxhash64("pivot", F.pmod(F.xxhash64("node"), "parts")).alias("block"), F.lit(False).alias("left"), "node", F.col("node").alias("class"))
    left = parts.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return right.unionByName(left.select(F.xxhash64("pivot", "part").alias("block"), F.lit(True).alias("left"), F.col("pivot").alias("node"), F.col("pivot").alias("class")))


def _rest_blocks(starred: DataFrame, classes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks of the nodes outside their pivot's class with all nodes of the bucket."""
    known = starred.where("n > 2").join(sizes, "node").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    whole = known.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max(F.when(F.col("node") == F.col("pivot"), F.col("class"))).alias("home"), _parts(F.sum("bytes"), WIDE).alias("all"))
    whole = common.Staged(whole.where("low != high").select("bucket", "home", "all"), "whole").df  # as the pivots were
    mixed = known.join(whole, "bucket").withColumn("outside", F.col("class") != F.col("home"))
    mixed = common.Staged(mixed.select("bucket", "node", "class", "bytes", "outside", "all"), "mixed").df
    some = mixed.where("outside").groupBy("bucket").agg(_parts(F.sum("bytes"), WIDE).alias("some"))
    mixed = mixed.join(some, "bucket")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = mixed.where("outside").withColumn("g", F.pmod(F.xxhash64("node"), "some")).withColumn("h", every("all"))
    right = mixed.withColumn("h", F.pmod(F.xxhash64("node"), "all")).withColumn("g", every("some"))
    blocks = [x.select(F.xxhash64("bucket", "g", "h").alias("block"), F.lit(is_left).alias("left"), "node", "class") for x, is_left in ((left, True), (right, False))]
    return blocks[0].unionByName(blocks[1])


def _components(edges: DataFrame) -> DataFrame:
    """(node, class): the least node of each node's component, for nodes with an edge."""
    stage = common.Staged(edges.select("a", "b"), "edges")
    before = -1
    while True:
        edges = stage.df
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).where("a != b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        last, stage = edges, common.Staged(after, "edges")
        n = stage.df.count()
        if n == before and stage.df.join(last, ["a", "b"], "left_anti").isEmpty():
            return stage.df.select(F.col("a").alias("node"), F.col("b").alias("class"))
        before = n


def _classes(docs: DataFrame) -> DataFrame:
    """(id, k, class, class_size) of the keyed documents; class is a node, the least (id, k) of its words."""
    signed = common.Staged(signatures(docs), "signatures").df
    key = F.struct("id", "k")
    member = signed.select("id", "k", "w1", "w2").distinct()
    least = signed.where("w1 is not null").groupBy("w1", "w2").agg(F.min(F.struct("id", "k", "bands")).alias("x"))
    nodes = common.Staged(least.select("w1", "w2", F.struct("x.id", "x.k").alias("node"), "x.bands"), "nodes").df
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    crowd = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = common.Staged(placed.join(crowd, "bucket").select("bucket", "node", "n"), "buckets").df
    seen = buckets.groupBy("node").agg(F.sum("n").alias("met"))
    # written, so that the join below isn't bound to the aggregate's partitions and a hot bucket can be split
    pivots = common.Staged(buckets.join(seen, "node").groupBy("bucket").agg(F.max(F.struct("met", "node")).alias("most")), "pivots").df
    starred = common.Staged(buckets.join(pivots, "bucket").select("bucket", "node", "n", F.col("most.node").alias("pivot")), "starred").df
    # the texts of nodes in buckets are moved once
    texts = docs.select(key.alias("node"), "text").join(starred.select("node").distinct(), "node").dropDuplicates(["node"])
    shingled = common.Staged(shingle_table(texts), "shingles").df
    sizes = shingled.select("node", "bytes")
    stars = starred.where("node != pivot").select("pivot", "node").distinct()
    classes = _components(_compared(_star_blocks(stars, sizes), shingled))
    wider = _components(_compared(_rest_blocks(starred, classes, sizes), shingled))
    classes = classes.join(wider.select(F.col("node").alias("class"), F.col("class").alias("wider")), "class", "left").select("node", F.coalesce("wider", "class").alias("class"))
    alone = wider.join(classes, "node", "left_anti")
    # sizes are summed by node first, so that neither many copies nor a large class meets in one task
    counts = member.where("w1 is not null").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("copies"))
    named = nodes.select("w1", "w2", "node").join(counts, ["w1", "w2"]).join(classes.unionByName(alone), "node", "left").withColumn("class", F.coalesce("class", "node"))
    named = common.Staged(named, "named").df
    summed = common.Staged(named.groupBy("class").agg(F.sum("copies").alias("class_size")), "sizes").df
    named = common.Staged(named.join(summed, "class").select("w1", "w2", "class", "class_size"), "named").df
    return member.join(named, ["w1", "w2"], "left").select("id", "k", F.coalesce("class", key).alias("class"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``class_id``, the least doc_id of the class, ``class_size`` and ``first``.

    class_size counts rows equal in doc_id and text once.  ``first`` marks one row of each class,
    one of the least doc_id.
    """
    inner = common.Inner(docs, ("class_id", "class_size", "first"), doc_id=doc_id, text=text)
    rows = keyed(inner.df)
    with common.workspace() as keep:
        named = keep(common.Staged(_classes(rows), "classes")).df
    out = rows.join(named, ["id", "k"])
    # the join has dealt the rows by document, so that equal rows are numbered without moving them
    copy = F.row_number().over(Window.partitionBy("id", "k").orderBy("k"))
    first = (F.col("class.id") == F.col("id")) & (F.col("class.k") == F.col("k")) & (copy == 1)
    return inner.outer(out, F.when(F.col("class.id") != LEAST, F.col("class.id")).alias("class_id"), "class_size", first.alias("first"))
