"""Front and back matter: a rule-based predicate and filter on chunks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import strip

_I = "(?idU)"
# Headings, lines of a table of contents, chapter starts, copyright and review phrases.
HEADING = _I + r"^\s*(?:" + "|".join(V.HEADINGS) + r")\s*[:.\-–—]?\s*$"
CONTENTS_LINE = _I + r"^\s*(?:(?:cap[ií]tulo|chapter|parte|part)\s+[\w\dIVXLC]+|[A-ZÁÉÍÓÚÑ][^.\n]{2,80})\s*(?:\.{2,}|\s{2,})\s*\d+\s*$"
CHAPTER = _I + r"(?:^|\n)\s*(?:cap[ií]tulo|chapter|parte|part)\s+[\w\dIVXLC]+\b"
COPYRIGHT = _I + r"(?:copyright|all rights reserved|todos los derechos reservados|isbn|publicado por|published by|editorial|primera edici[oó]n|no se permite la reproducci[oó]n)"
REVIEW = _I + r"(?:\b(?:dijo|dice|seg[uú]n|says)\b|[\"“”])[^.\n]{0,160}(?:new york times|publishers weekly|kirkus|booklist|autor(?:a)?|escritor(?:a)?|novelist)"
# What every match of the three holds, in lower case; letters that case folding may hide are looked for too.
HEADING_STEMS = [
    "agradecimiento", "acknowledg", "contenido", "contents", "ndice", "index", "autor", "author", "dedicatoria", "dedication", "copyright", "dito", "credit",
    "reseñ", "review", "elogio", "praise for", "otros libros de", "also by", "bibliogra", "glosario", "glossary",
]
COPYRIGHT_STEMS = ["copyright", "rights reserved", "derechos reservados", "isbn", "publicado por", "published by", "editorial", "primera edici", "no se permite"]
REVIEW_STEMS = ["new york times", "publishers weekly", "kirkus", "booklist", "autor", "escritor", "novelist"]
ANY_HEADING = _I + r"\b(?:" + "|".join(V.HEADINGS) + r")\b"
# The first five lines that aren't blank, and a line that ends in a digit but for white space.
_BREAKS = r"\n\x0B\f\r\x{85}\x{2028}\x{2029}"
OPENING = rf"(?U)\A\s*(?:[^{_BREAKS}]+\s*){{0,5}}"
ENDS_IN_DIGIT = rf"(?U)\d\s*(?:[{_BREAKS}]|\z)"
FOLDED = ["ſ", "ı", "i̇", "İ"]


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\R", -1), strip), lambda x: x != "")


def non_narrative(text: Column) -> Column:
    """True for blank text, headings, contents, copyright pages, reviews and the like.

    Lines are looked at only where the first five may hold a heading or some line ends in a digit; two patterns over the text tell, the first
    of which is looked for only where the text has some heading's letters.
    """
    some = lambda low, stems: reduce(or_, [low.contains(s) for s in stems])

    def let(value: Column, f) -> Column:  # computed once, also inside a lambda
        return F.element_at(F.transform(F.array(value), f), 1)

    def by_line(lines: Column) -> Column:
        top, opening = F.slice(lines, 1, 5), F.slice(lines, 1, 40)
        heading = F.exists(top, lambda x: x.rlike(HEADING)) & ~text.rlike(CHAPTER)
        # a line ends in a digit, which is cheap to see
        entries = F.size(F.filter(opening, lambda x: F.substring(x, -1, 1).rlike(r"(?U)\d") & x.rlike(CONTENTS_LINE)))
        contents = (entries >= 3) & (entries >= 0.35 * F.size(opening))
        found = lambda joined: joined.rlike(ANY_HEADING) & (sum((joined.rlike(_I + rf"\b{p}\b").cast("int") for p in V.HEADINGS), F.lit(0)) >= 2)
        return heading | contents | let(F.array_join(top, "\n"), found)

    def phrases(low: Column) -> Column:
        twice = lambda pattern, stems: some(low, [*stems, *FOLDED]) & (F.regexp_count(text, F.lit(pattern)) >= 2)
        return some(low, ["table of contents", "tabla de contenidos"]) | twice(COPYRIGHT, COPYRIGHT_STEMS) | (twice(REVIEW, REVIEW_STEMS) & (F.length(strip(text)) < 5000))

    def matter(low: Column) -> Column:
        headed = some(low, [*HEADING_STEMS, *FOLDED]) & F.regexp_extract(text, OPENING, 0).rlike(ANY_HEADING)
        return F.when(headed | text.rlike(ENDS_IN_DIGIT), let(lines_of(text), by_line)).otherwise(F.lit(False))

    return F.coalesce(~text.rlike(r"(?U)\S") | let(F.lower(text), lambda low: phrases(low) | matter(low)), F.lit(True))


def narrative_chunks(chunks: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """The narrative chunks, numbered anew inside each document."""
    kept = chunks.where(~non_narrative(F.col("chunk_text")))
    order = Window.partitionBy(doc_id).orderBy("raw_index")
    return kept.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("int"))


def filter_stats(chunks: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    out = non_narrative(F.col("chunk_text"))
    return chunks.groupBy(doc_id).agg(F.count_if(~out).alias("kept"), F.count_if(out).alias("removed"))
