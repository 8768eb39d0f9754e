"""Chunks of chapters and paragraphs, packed greedily with an overlap, inside the row of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# What splits chapters and paragraphs, the first that splits counts.
CHAPTERS = [r"(?U)\n(?:Capítulo|Capitulo|Chapter)\s+[\w\dIVXLC]+", r"(?U)\n(?:Parte|Part)\s+[\w\dIVXLC]+"]
PARAGRAPHS = [r"\n\n", r"\.\n", r"\n"]
MAX_CHARS, OVERLAP = 5000, 1
STRETCH = 128


def _let(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def clean(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def split_first(text: Column, patterns: list[str]) -> Column:
    """Clean parts by the first pattern that splits the text, else the text itself; none of a blank text."""

    def way(p: str) -> Column:
        some = lambda c: F.when(F.size(c) > 0, c)
        return _let(F.split(text, p, -1), lambda parts: F.when(F.size(parts) > 1, _let(clean(parts), some)))

    whole = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.coalesce(*map(way, patterns), F.array(t)))
    return _let(strip(text), whole)


def bounds(lengths: Column, max_chars: int, overlap: int) -> Column:
    """First and last paragraph of every chunk, by a fold over the paragraphs' lengths.

    The state holds the chunk's first paragraph, the characters since it and what has been emitted.
    Emitting copies the list, so there is one for each ``STRETCH`` paragraphs, and the time follows
    the number of paragraphs.
    """
    state = "struct<start:int,chars:int,done:array<struct<f:int,t:int>>>"
    init = {"start": F.lit(0), "chars": F.get(lengths, F.lit(0))}

    def step(s: Column, i: Column) -> Column:
        n = F.get(lengths, i)
        fits = s["chars"] + 1 + n <= max_chars
        start = F.greatest(s["start"], i - overlap) if overlap else i
        kept = F.slice(lengths, start + 1, i - start + 1)  # the overlap and this paragraph
        total = F.aggregate(kept, F.lit(0), lambda a, x: a + x) + (i - start)
        emitted = F.concat(s["done"], F.array(F.struct(s["start"].alias("f"), (i - 1).alias("t"))))
        return F.when(fits, F.struct(s["start"].alias("start"), (s["chars"] + 1 + n).alias("chars"), s["done"].alias("done"))).otherwise(
            F.struct(start.alias("start"), total.alias("chars"), emitted.alias("done"))
        ).cast(state)

    last = F.size(lengths) - 1
    outer = "struct<start:int,chars:int,done:array<array<struct<f:int,t:int>>>>"
    nothing = F.array().cast("array<struct<f:int,t:int>>")

    def stretch(s: Column, first: Column) -> Column:
        begin = F.struct(s["start"].alias("start"), s["chars"].alias("chars"), nothing.alias("done")).cast(state)
        inner = F.aggregate(F.sequence(first, F.least(last, first + (STRETCH - 1))), begin, step)
        return _let(inner, lambda x: F.struct(x["start"].alias("start"), x["chars"].alias("chars"), F.concat(s["done"], F.array(x["done"])).alias("done")).cast(outer))

    stretches = F.when(last >= 1, F.sequence(F.lit(1), last, F.lit(STRETCH))).otherwise(F.array().cast("array<int>"))
    begin = F.struct(init["start"].alias("start"), init["chars"].alias("chars"), F.array().cast("array<array<struct<f:int,t:int>>>").alias("done")).cast(outer)
    return F.aggregate(stretches, begin, stretch, lambda s: F.concat(F.flatten(s["done"]), F.array(F.struct(s["start"].alias("f"), last.alias("t")))))


def pack(paragraphs: Column, max_chars: int, overlap: int) -> Column:
    """Paragraphs joined by line ends into chunks of at most max_chars where they allow it."""

    def joined(p: Column) -> Column:
        return _let(F.transform(p, F.length), lambda n: F.transform(bounds(n, max_chars, overlap), lambda b: F.array_join(F.slice(p, b["f"] + 1, b["t"] - b["f"] + 1), "\n")))

    return _let(paragraphs, lambda p: F.when(F.size(p) > 0, joined(p)).otherwise(F.array().cast("array<string>")))


def chunks_of(blocks: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """All chunks of a document's blocks, in order."""
    if max_chars <= 0 or overlap < 0:
        raise ValueError("max_chars must be positive and overlap not negative")
    of_chapter = lambda c: pack(split_first(c, PARAGRAPHS), max_chars, overlap)
    of_block = lambda b: F.flatten(F.transform(split_first(b, CHAPTERS), of_chapter))
    return F.flatten(F.transform(clean(blocks), of_block))


def chunk(docs: DataFrame, *, doc_id: str = "doc_id", blocks: Column | None = None, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, raw_index, chunk_text); no shuffle: a document's chunks come from its row."""
    blocks = F.array("text") if blocks is None else blocks
    return docs.where(F.size(blocks) > 0).select(doc_id, F.posexplode(chunks_of(F.filter(blocks, lambda b: b.isNotNull()), max_chars, overlap)).alias("raw_index", "chunk_text"))


def with_errors(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``error``: why a document can't be chunked, null if it can."""
    return docs.withColumn("error", F.when(F.col(text).isNull(), "missing").when(strip(F.col(text)) == "", "blank"))
