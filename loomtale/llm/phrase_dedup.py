"""Exact substring dedup by prefix-free parsing, on bytes.

A byte goes if it lies in a string of ``WIDTH`` bytes that also starts earlier: in a document
of a smaller doc_id, or earlier in the same one.

*Triggers.*  A rolling hash over ``GRAM`` bytes is taken at every place; in each string of WIDTH
bytes the gram of the least hash (the rightmost of equals) is its trigger.  So equal strings have
equal triggers at equal offsets, wherever they stand.  *Phrases.*  Strings that start side by side
and share a trigger form a phrase; phrases overlap by WIDTH-1 bytes instead of a trigger's width, so
that each string of WIDTH bytes starts in exactly one phrase of its document, and no string of one
trigger has to be compared with a string of another.

*Parse.*  The documents as sequences of phrases are put in corpus order by phrase: one that is there
before is a repeat from end to end, which settles the inside of long repeats without looking at its
bytes again.  *Dictionary.*  Distinct phrases that share their trigger with another one may still
have strings in common, at the ends of a repeat.  They go to tasks by trigger, with their bytes, and
a task builds the suffix array of some triggers' phrases: suffixes of WIDTH bytes at least, sorted by
trigger and then by bytes, eight at a time, as long as there are ties.  *Combined.*  Equal suffixes stand
side by side in that array; with the places of their phrases in the parse they are put in corpus
order, and all but the first are repeats.  The arrays of all triggers, one after the other, are the
suffix array of the dictionary.

A trigger with over ``CROWD`` bytes of such phrases would make a task too large.  Its suffixes are sorted
by Spark instead, a row for each, by the trigger's hash and 64 bits of one of their first WIDTH bytes.  There and for whole
phrases equality is by both hashes.  Strings of different triggers are told apart by 128 bits, but the n strings of one
trigger by 64: they have a false match with a chance of n * n / 2**65 (1e-7 for 2 million strings of one trigger).

Null text is empty; empty and short texts keep all they have.  Rows equal in doc_id and text are
one document, and each gets its result; other rows of one doc_id are ordered by a hash.  doc_id must
be an integer, a null one is the least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .repeats import KEY, ROWS, keyed, marked, rows, runs_of, spans_of

WIDTH, GRAM = 100, 32
#: Bytes hashed at a time, and rows among which repeats are found before they are sent.
PART, ROWS_AT_ONCE = 1 << 19, 1 << 18
#: Bytes of a trigger's phrases that a task sorts, and bytes of phrases that it sorts together.
CROWD, TOGETHER = 4_000_000, 2_000_000
#: Rows of the sample that common triggers are read off, and phrases in it that make one common.
SAMPLE, COMMON = 4_000, 8
_BASE, _MIX, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LOW = np.uint64((1 << 20) - 1)


def _mix(h: np.ndarray, by: np.uint64 = _MIX) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * by
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


#: A 64-bit value for each byte, so that sums of them don't collide as the bytes' own would.
_VALUE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE)
_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _tables:
        for b in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
            p = np.full(2 * PART + WIDTH + 1, b, np.uint64)
            p[0] = 1
            _tables.append(np.multiply.accumulate(p))
    return _tables


class _Sums:
    """Rolling hashes of ``data``: the hash of bytes [i, j) in constant time."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers()
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * power[: len(data)], out=self.total[1:])

    def fixed(self, width: int) -> np.ndarray:
        return (self.total[width:] - self.total[:-width]) * self.inverse[: len(self.total) - width]

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.total[stop] - self.total[start]) * self.inverse[start]


def _phrases(data: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """start, strings, trigger hash and phrase hash; ``ends``: for each place the end of its document."""
    sums = _Sums(data)
    grams = _mix(sums.fixed(gram))
    size = len(data) - width + 1
    least = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
    span, have = width - gram + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: -(span - have)], least[span - have :])
    trigger = (_LOW - (least[:size] & _LOW)).astype(np.int64)
    at = np.flatnonzero(ends[:size] - np.arange(size) >= width)  # strings inside one document
    if not len(at):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    cut = np.concatenate(([True], (trigger[at][1:] != trigger[at][:-1]) | (np.diff(at) != 1)))
    first = np.flatnonzero(cut)
    start, n = at[first], np.diff(np.append(first, len(at)))
    return start, n, grams[trigger[start]], _mix(sums.of(start, start + n - 1 + width) + n.astype(np.uint64), _BASE)


def _parts(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of several documents, or of a piece of a long one, in arrays of at most about PART.

    Yields data, the end of each place's document, the document of each place, and what to add to
    a place in the data for the place in its document.  Pieces overlap so that no string is lost.
    """
    held: list[tuple[int, int, bytes]] = []
    total = 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(b) for _, _, b in held])
        stops = np.cumsum(sizes)
        repeat = lambda x: np.repeat(np.array(x), sizes)
        return np.frombuffer(b"".join(b for _, _, b in held), np.uint8), repeat(stops), repeat([d for d, _, _ in held]), repeat([o - s for (_, o, b), s in zip(held, (stops - sizes).tolist(), strict=True)])

    for d, text in enumerate(texts):
        for at in range(0, max(0, len(text) - width + 1), PART):
            piece = text[at : at + PART + width - 1]
            if held and total + len(piece) > PART:
                yield joined()
                held, total = [], 0
            held.append((d, at, piece))
            total += len(piece)
    if held:
        yield joined()


def common_triggers(docs: DataFrame, width: int, gram: int) -> list[int]:
    """Triggers with many phrases in a sample of about SAMPLE rows drawn at random.

    They only decide where rows meet: phrases of a common trigger are dealt out by phrase, not by trigger.
    """
    some = docs.where(F.rand(1) < SAMPLE / max(SAMPLE, docs.count()))
    counts = _parse(some, width, gram, []).groupBy("a").agg(F.count_distinct("b").alias("n"))
    return sorted(r["a"] for r in counts.where(F.col("n") >= COMMON).select("a").collect())  # of the sample's phrases a COMMON-th at most


def _parse(docs: DataFrame, width: int, gram: int, common_ones: list[int]) -> DataFrame:
    """The phrases of all documents, with repeats inside a batch already known; ``part`` is what rows meet by."""
    hot = docs.sparkSession.sparkContext.broadcast(np.array(common_ones, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            start, n, a, b, ids, ks = (np.concatenate(x) for x in zip(*held, strict=True))
            out = rows(a, b, ids, ks, start, n)
            a, b = (out.column(c).to_numpy() for c in "ab")
            is_common = np.isin(a, hot.value)
            part = np.where(is_common, _mix(a.view(np.uint64) ^ _mix(b.view(np.uint64))).view(np.int64), a)
            return out.append_column("part", pa.array(part)).append_column("common", pa.array(is_common))

        for batch in common.slices(batches, "text"):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            ids, ks = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in KEY)
            for data, ends, doc, shift in _parts(texts, width):
                start, n, a, b = _phrases(data, ends, width, gram)
                held.append((start + shift[start], n, a, b, ids[doc[start]], ks[doc[start]]))
                size += len(start)
                if size >= ROWS_AT_ONCE:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    return docs.select(*KEY, "text").mapInArrow(run, ROWS + ", part bigint, common boolean")


def _met(found: DataFrame) -> DataFrame:
    """``found`` by part in one exchange, with ``later`` (the phrase is there before) and ``several`` (others of its trigger may be).

    A hot phrase has a row for each batch at most, and a common trigger's phrases are apart and taken to be several.
    """
    group, phrase = Window.partitionBy("part"), Window.partitionBy("part", "a", "b").orderBy(*KEY, "pos")
    new = F.when(~F.col("known"), F.col("b"))
    dealt = found.repartition("part").sortWithinPartitions("part", "a", "b", *KEY, "pos")
    several = F.col("common") | F.coalesce(F.min(new).over(group) != F.max(new).over(group), F.lit(False))
    return dealt.withColumn("several", several).withColumn("later", F.col("known") | (F.rank().over(phrase) > 1))


def _places(batch: pa.RecordBatch, d: int, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """pos, n, trigger and crowded of the phrases listed for a row, by place."""
    some = batch.column("phrases").flatten().slice(bounds[d], bounds[d + 1] - bounds[d])
    pos, n, trigger, crowded = (some.field(k).to_numpy(zero_copy_only=False) for k in range(4))
    order = np.argsort(pos)
    return pos[order].astype(np.int64), n[order].astype(np.int64), trigger[order], crowded[order]


def _bounds(batch: pa.RecordBatch) -> np.ndarray:
    return np.cumsum([0, *(x or 0 for x in batch.column("phrases").value_lengths().to_pylist())])


PHRASE = "trigger bigint, id bigint, k bigint, pos int, n int, bytes binary"


def _dictionary(docs: DataFrame, width: int) -> DataFrame:
    """PHRASE: the phrases listed in ``phrases`` whose trigger isn't crowded, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 1_000_000):
            bounds, out = _bounds(batch), []
            ids, ks = (batch.column(c).to_pylist() for c in KEY)
            for d, t in enumerate(batch.column("text").to_pylist()):
                data = (t or "").encode()
                for p, n, m, crowded in zip(*(x.tolist() for x in _places(batch, d, bounds)), strict=True):
                    if not crowded:
                        out.append((m, ids[d], ks[d], p, n, data[p : p + n + width - 1]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=[c.split()[0] for c in PHRASE.split(", ")])

    return docs.select(*KEY, "text", "phrases").mapInArrow(run, PHRASE)


def equal_suffixes(data: np.ndarray, start: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """The rank of each suffix in the suffix array by group and then by ``width`` bytes; -1 where no other is equal.

    Suffixes are sorted by eight bytes at a time, and only those that are still tied go on.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    word = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(word)]
    rank = np.zeros(len(start), np.int64)
    order = np.argsort(group, kind="stable")
    starts = np.concatenate(([0], np.flatnonzero(np.diff(group[order])) + 1)) if len(order) else np.empty(0, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, len(order))))
    tied = np.arange(len(start))
    for offset in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        w = word[start[tied] + offset]
        order = np.lexsort((w, rank[tied]))
        tied, w = tied[order], w[order]
        r = rank[tied]
        same_rank = np.concatenate(([False], r[1:] == r[:-1]))
        same = same_rank & np.concatenate(([False], w[1:] == w[:-1]))
        at = np.arange(len(tied))
        first_of_rank = np.maximum.accumulate(np.where(same_rank, 0, at))
        first_of_run = np.maximum.accumulate(np.where(same, 0, at))
        rank[tied] = r + first_of_run - first_of_rank
        more = same | np.append(same[1:], False)
        tied = tied[more]
        if not len(tied):
            break
    out = np.full(len(start), -1, np.int64)
    out[tied] = rank[tied]
    return out


def _later(phrases: list[tuple], width: int) -> list[np.ndarray]:
    """id, k, pos and n of the runs of suffixes that come before in the corpus; phrases as in PHRASE."""
    trigger, ids, ks, pos, n = (np.array([p[i] for p in phrases], np.int64) for i in range(5))
    data = np.frombuffer(b"".join(p[5] for p in phrases), np.uint8)
    sizes = n + width - 1
    begin = np.cumsum(sizes) - sizes
    phrase = np.repeat(np.arange(len(phrases)), n)
    inside = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
    rank = equal_suffixes(data, begin[phrase] + inside, trigger[phrase], width)
    several = np.flatnonzero(rank >= 0)
    ph, place = phrase[several], pos[phrase[several]] + inside[several]
    order = np.lexsort((place, ks[ph], ids[ph], rank[several]))
    ph, place, r = ph[order], place[order], rank[several][order]
    first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.empty(0, np.int64)
    lead = np.repeat(first, np.diff(np.append(first, len(r))))
    # rows of one document are the same suffix, not an earlier one
    gone = (ids[ph] != ids[ph[lead]]) | (ks[ph] != ks[ph[lead]]) | (place != place[lead])
    ph, place = ph[gone], place[gone]
    order = np.lexsort((place, ks[ph], ids[ph]))
    ph, place = ph[order], place[order]
    ones = np.ones(len(ph), np.int64)
    starts = runs_of(np.ones(len(ph), bool), ids[ph], ks[ph], place, ones)
    return [ids[ph][starts], ks[ph][starts], place[starts], np.diff(np.append(starts, len(ph)))]


def _sorted(dictionary: DataFrame, width: int) -> DataFrame:
    """(id, k, pos, n): runs of repeated suffixes in the phrases of PHRASE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some() -> Iterator[list[tuple]]:
            """Phrases of whole triggers, about TOGETHER bytes of them."""
            held: list[tuple] = []
            size = 0
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if size > TOGETHER and row[0] != held[-1][0]:
                        yield held
                        held, size = [], 0
                    held.append(row)
                    size += len(row[5])
            if held:
                yield held

        for phrases in some():
            i, k, p, n = _later(phrases, width)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(k), pa.array(p.astype(np.int32)), pa.array(n.astype(np.int32))], names=["id", "k", "pos", "n"])

    return dictionary.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(run, "id bigint, k bigint, pos int, n int")


def _suffixes(docs: DataFrame, width: int) -> DataFrame:
    """ROWS of the suffixes of the crowded phrases in ``phrases``, each by its first ``width`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 1_000_000):
            ids, ks = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in KEY)
            bounds, out, size = _bounds(batch), [], 0
            for d, t in enumerate(batch.column("text").to_pylist()):
                p, c, m, crowded = _places(batch, d, bounds)
                p, c, m = p[crowded], c[crowded], m[crowded]
                data = np.frombuffer((t or "").encode(), np.uint8)
                for at in range(0, len(data) if len(p) else 0, PART):  # a long document piece by piece
                    here = (p < at + PART) & (p + c > at)
                    if not here.any():
                        continue
                    sums = _Sums(data[at : at + PART + width - 1])
                    lo, hi = np.maximum(p[here], at), np.minimum(p[here] + c[here], at + PART)
                    k = hi - lo
                    start = np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(k.sum())
                    h = _mix(sums.of(start - at, start - at + width))
                    out.append((h, np.repeat(m[here], k).view(np.uint64), np.full(len(start), ids[d]), np.full(len(start), ks[d]), start, np.ones(len(start), np.int64)))
                    size += len(start)
                    if size >= ROWS_AT_ONCE:
                        yield rows(*(np.concatenate(x) for x in zip(*out, strict=True)))
                        out, size = [], 0
            if out:
                yield rows(*(np.concatenate(x) for x in zip(*out, strict=True)))

    return docs.select(*KEY, "text", "phrases").mapInArrow(run, ROWS)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for s, e in spans:
        kept.append(data[at:s])
        at = e
    return b"".join([*kept, data[at:]])


def _whole(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without characters of which they hold only a part."""
    out = []
    for s, e in spans:
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e < len(data) and e > s and data[e] & 0xC0 == 0x80:
            e -= 1
        out.append((s, e))
    return out


def _repeats(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(id, k, spans): the repeated bytes of each document, in spans that may touch or overlap."""
    found = _met(_parse(docs, width, gram, common_triggers(docs, width, gram))).where("later or several")
    parse = common.Staged(found.select("a", *KEY, "pos", "n", "later"), "parse").df
    open_ones = parse.where("not later")
    sizes = open_ones.groupBy("a").agg(F.sum(F.col("n").cast("long") + (width - 1)).alias("bytes"))
    crowds = common.Staged(sizes.where(F.col("bytes") > CROWD).select("a", F.lit(True).alias("crowded")), "crowds").df
    listed = open_ones.join(crowds, "a", "left").groupBy(*KEY).agg(F.collect_set(F.struct("pos", "n", "a", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("phrases"))
    with_text = docs.select(*KEY, "text").join(listed, list(KEY))
    if crowded := not crowds.isEmpty():
        with_text = common.Staged(with_text, "open").df
    ends = [_sorted(_dictionary(with_text, width), width)]
    if crowded:
        ends.append(marked(_suffixes(with_text, width)).where("later").select(*KEY, "pos", "n"))
    repeats = parse.where("later").select(*KEY, "pos", "n")
    for x in ends:
        repeats = repeats.unionByName(x)
    return spans_of(repeats, F.col("pos"), F.col("pos") + F.col("n") + (width - 1))


def drop_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, kept_text: bool = False) -> DataFrame:
    """``docs`` with ``removed`` array<int> (from, to of each maximal run of bytes) and ``kept`` binary.

    With ``kept_text`` the kept bytes come as a string instead, in which a character of which
    only a part is repeated stays whole.
    """
    inner = common.Inner(docs, ("removed", "kept"), doc_id=doc_id, text=text)
    docs = keyed(inner.df)
    with common.workspace() as keep:
        spans = keep(common.Staged(_repeats(docs, width, gram), "spans")).df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            removed, kept = [], []
            lists = batch.column("spans")
            flat = lists.flatten()
            starts, stops = flat.field(0).to_pylist(), flat.field(1).to_pylist()
            at = 0
            for t, k in zip(batch.column("text").to_pylist(), lists.value_lengths().to_pylist(), strict=True):
                data, k = (t or "").encode(), k or 0
                union = _union(list(zip(starts[at : at + k], stops[at : at + k], strict=True)))
                at += k
                removed.append([x for span in union for x in span])
                kept.append(_without(data, _whole(data, union)).decode() if kept_text else _without(data, union))
            new = {"removed": pa.array(removed, pa.list_(pa.int32())), "kept": pa.array(kept, pa.string() if kept_text else pa.binary())}
            yield common.with_columns(batch.drop_columns(["spans"]), new)

    both = docs.join(spans, list(KEY), "left")
    out = both.mapInArrow(run, common.schema_with(both.drop("spans"), f"removed array<int>, kept {'string' if kept_text else 'binary'}"))
    return inner.outer(out, "removed", "kept")
