"""Snippets and mentions: chunks looked up by reference or by term.

Mentions come from an automaton of all terms that some chunks are searched for: it is built once for a part of a book
(``PART`` chunks) and reads each chunk once, however many terms there are.  Hits are rows without the chunk's text, and are dealt
to those who asked for the term afterwards.  Terms and texts are compared in lower case, character by character; a
word is letters, digits and underscores.  Where a term occurs as a whole word, its first such place counts, else its first place.

Null texts have no mentions, null and one-character terms aren't looked for.  A null doc_id is a document like another.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import head, strip, window_around
from .keys import opened, sealed
from .lineage import cut

MAX_SNIPPETS, SNIPPET_CHARS, MAX_MENTIONS, MENTION_CHARS = 4, 900, 6, 500
#: Chunks of a book that are searched together.
PART = 512
#: The first chunks of books, those of several books together, and how many such sets a shuffle partition has.
SHORT, SETS = 32, 64
#: What counts as white space at the ends of a snippet.
WHITE = "".join(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def clean_terms(terms: Column) -> Column:
    """Stripped terms of two characters or more, the first of those equal without case."""
    kept = F.filter(F.transform(F.filter(terms, lambda t: t.isNotNull()), strip), lambda t: F.length(t) >= 2)
    let = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731 - computed once
    return let(kept, lambda k: let(F.transform(k, F.lower), lambda low: F.filter(k, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)))


def find_term(text: Column, term: Column) -> Column:
    """0-based place of the term as a whole word, else anywhere, case aside; null if absent."""
    quoted = F.regexp_replace(term, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    before = F.call_function("regexp_extract", text, F.concat(F.lit(r"(?isU)^(.*?)(?<!\w)"), quoted, F.lit(r"(?!\w)")), F.lit(1))
    whole = F.regexp_like(text, F.concat(F.lit(r"(?iU)(?<!\w)"), quoted, F.lit(r"(?!\w)")))
    anywhere = F.position(F.lower(term), F.lower(text))
    return F.when(whole, F.length(before)).when(anywhere > 0, anywhere - 1)


def best_snippet(text: Column, terms: Column, width: int = SNIPPET_CHARS) -> Column:
    """Around the first term that occurs, else the head of the text."""

    def around(t: Column) -> Column:  # the place is looked for once, whatever reads it
        return F.element_at(F.transform(F.array(find_term(text, t)), lambda at: F.when(at.isNotNull(), window_around(text, at, at + F.length(t), width))), 1)

    found = F.filter(F.transform(clean_terms(terms), around), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), head(text, width))


def snippets(references: DataFrame, chunks: DataFrame, *, limit: int = MAX_SNIPPETS) -> DataFrame:
    """(doc_id, char_ord, ord, chunk_index, local_id, snippet) for references with ``terms``.

    references: doc_id, char_ord, ord, chunk_index, local_id, terms.  An equi-join by document and chunk.
    """
    first = Window.partitionBy("doc_id", "char_ord", "chunk_index", "local_id").orderBy("ord")
    order = Window.partitionBy("doc_id", "char_ord").orderBy("ord")
    unique = references.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    found = unique.join(chunks.select("doc_id", "chunk_index", "chunk_text"), ["doc_id", "chunk_index"])
    top = found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit)
    return top.select("doc_id", "char_ord", "ord", "chunk_index", "local_id", best_snippet(F.col("chunk_text"), F.col("terms")).alias("snippet"))


def lowered(text: str) -> str:
    """Lower case of the same length: characters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Finder:
    """The first place of each of some lower-case terms, as a whole word if there is one."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.machine = None
        if len(terms) > 8:  # a few are found faster one by one
            self.machine = ahocorasick.Automaton()
            for k, t in enumerate(terms):
                self.machine.add_word(t, (k, len(t)))
            self.machine.make_automaton()

    def _places(self, low: str) -> Iterator[tuple[int, int, int]]:
        if self.machine:
            for end, (k, n) in self.machine.iter(low):
                yield k, end - n + 1, n
            return
        for k, t in enumerate(self.terms):
            at = low.find(t)
            while at >= 0:
                yield k, at, len(t)
                at = low.find(t, at + 1)

    def __call__(self, text: str) -> dict[int, tuple[int, int]]:
        """Number of a term -> its place and length."""
        low = lowered(text)
        whole: dict[int, tuple[int, int]] = {}
        first: dict[int, tuple[int, int]] = {}
        for k, at, n in self._places(low):
            if k in whole:
                continue
            if k not in first:
                first[k] = (at, n)
            if not (at and _is_word(low[at - 1])) and not (at + n < len(low) and _is_word(low[at + n])):
                whole[k] = (at, n)
        return first | whole


def _around(text: str, at: int, n: int, width: int) -> str:
    """``window_around`` of a place."""
    half = max(80, width // 2)
    lo, hi = max(0, at - half), min(len(text), at + n + half)
    return ("..." if lo else "") + text[lo:hi].strip(WHITE) + ("..." if hi < len(text) else "")


def mentions(chunks: DataFrame, terms: DataFrame, *, limit: int = MAX_MENTIONS, width: int = MENTION_CHARS) -> DataFrame:
    """(doc_id, query, chunk_index, matched_text, snippet): the first ``limit`` per document, by chunk and term.

    terms: doc_id, term_ord, term.  One who asks for a document's terms is a key like another of ``mentions_by_key``.
    """
    asked = terms.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("term_ord", "term"))), lambda x: x["term"]).alias("terms"))
    return mentions_by_key(asked.withColumn("key", F.lit(0)), chunks, limit=limit, width=width).drop("key", "term_ord")


def mentions_of(chunks: DataFrame, *, limit: int = MAX_MENTIONS, width: int = MENTION_CHARS, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The same where the ``terms`` are an array in the chunk's row, as for documents with a few each: no join; the limit is for each ``by``."""
    rows = chunks.select(*by, "chunk_index", "chunk_text", "terms")
    made = StructType([*rows.schema.fields[:-2], *StructType.fromDDL("term_ord int, query string, matched_text string, snippet string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, find, numbers = None, None, {}
        for batch in batches:
            at_row, found = [], []
            for i, (text, terms) in enumerate(zip(batch.column("chunk_text").to_pylist(), batch.column("terms").to_pylist(), strict=True)):
                if not text or not terms:
                    continue
                if terms != last:  # a document's chunks follow one another
                    lows = [lowered(t) if t else "" for t in terms]
                    numbers = {}
                    for o, t in enumerate(lows):
                        numbers.setdefault(t, []).append(o)
                    numbers.pop("", None)
                    last, find = terms, Finder(list(numbers))
                for k, (at, n) in find(text).items():
                    snippet = _around(text, at, n, width)
                    for o in numbers[find.terms[k]]:
                        at_row.append(i)
                        found.append((o, terms[o], text[at : at + n], snippet))
            kept = {name: batch.column(name).take(pa.array(at_row, pa.int32())) for name in made.names[:-4]}
            yield pa.RecordBatch.from_pydict(kept | {n: pa.array([f[j] for f in found], pa.int32() if j == 0 else pa.string()) for j, n in enumerate(made.names[-4:])})

    hits = rows.mapInArrow(run, made)
    top = hits.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("chunk_index", "term_ord"))).where(F.col("__n") <= limit)
    return top.select(*by, "query", "chunk_index", "matched_text", "snippet")


def _hits(asked: DataFrame, chunks: DataFrame, limit: int, width: int) -> DataFrame:
    """(doc_id, low, chunk_index, matched_text, snippet): of each lower-case term of a document its first ``limit`` chunks; doc_ids are sealed."""
    terms = asked.select("doc_id", F.explode("terms").alias("term")).where("term is not null").select("doc_id", _low(F.col("term")).alias("low")).where("low != ''").distinct()
    parts_of = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = F.col("chunk_index").between(0, SHORT - 1)
    shared = F.concat(F.lit("*"), F.pmod(F.hash("doc_id"), F.lit(parts_of * SETS)).cast("string"))  # no sealed id begins so
    texts = chunks.where("chunk_text is not null").select("doc_id", F.when(short, shared).otherwise(F.col("doc_id")).alias("set"), F.when(short, 0).otherwise(F.floor(F.col("chunk_index") / PART)).cast("long").alias("part"), "chunk_index", "chunk_text")
    # a book's terms go to each of its parts, never to its chunks
    parts = texts.select("doc_id", "set", "part").distinct().join(terms, "doc_id")

    def run(terms: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        of: dict[str, list[str]] = {}
        for book, low in zip(terms["book"], terms["low"], strict=True):
            of.setdefault(book, []).append(low)
        finders = {book: Finder(lows) for book, lows in of.items()}
        out = []
        for book, i, text in zip(texts["doc_id"], texts["chunk_index"], texts["chunk_text"], strict=True):
            if find := finders.get(book):
                out += [(book, find.terms[k], i, text[at : at + n], _around(text, at, n, width)) for k, (at, n) in find(text).items()]
        return pd.DataFrame(out, columns=["doc_id", "low", "chunk_index", "matched_text", "snippet"])

    kind = texts.schema["chunk_index"].dataType.simpleString()
    parts = parts.select(F.col("doc_id").alias("book"), F.col("set").alias("of"), F.col("part").alias("piece"), "low")  # names of their own, for both sides come from the chunks
    # a search is much work for its bytes, so tasks aren't put together by bytes
    parts, texts = parts.repartition(parts_of, "of", "piece"), texts.repartition(parts_of, "set", "part")
    dealt = parts.groupBy("of", "piece").cogroup(texts.groupBy("set", "part")).applyInPandas(run, f"doc_id string, low string, chunk_index {kind}, matched_text string, snippet string")
    order = Window.partitionBy("doc_id", "low").orderBy("chunk_index")
    return dealt.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__n")


def _low(term: Column) -> Column:
    """``lowered`` as a column."""
    low = F.lower(term)
    each = F.array_join(F.transform(F.split(term, "", -1), lambda c: F.when(F.length(F.lower(c)) == 1, F.lower(c)).otherwise(c)), "")
    return F.when(F.length(low) == F.length(term), low).otherwise(each)


def mentions_by_key(asked: DataFrame, chunks: DataFrame, *, limit: int = MAX_MENTIONS, width: int = MENTION_CHARS) -> DataFrame:
    """(doc_id, key, query, term_ord, chunk_index, matched_text, snippet): of each key the first ``limit`` of its document, by chunk and term.

    asked: doc_id, key, terms (an array, in order).
    """
    kind = asked.schema["doc_id"].dataType
    asked, chunks = sealed(asked.select("doc_id", "key", "terms")), sealed(chunks.select("doc_id", "chunk_index", "chunk_text"))
    wanted = asked.select("doc_id", "key", F.posexplode("terms").alias("term_ord", "query")).withColumn("low", _low(F.col("query")))
    found = wanted.join(_hits(asked, chunks, limit, width), ["doc_id", "low"])
    order = Window.partitionBy("doc_id", "key").orderBy("chunk_index", "term_ord")
    top = found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit)
    return opened(top.select("doc_id", "key", "query", "term_ord", "chunk_index", "matched_text", "snippet"), kind)


def source_context(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, key, snippets, mentions) for characters: doc_id, key, references, terms.

    Snippets are of chunks that refer to the character, mentions of any chunk of its document; both are
    bounded in number and length, so that a character's row stays small.
    """
    kind = asked.schema["doc_id"].dataType
    # chunks are read three times, and each of them takes long to make
    asked, chunks = sealed(asked), cut(sealed(chunks.select("doc_id", "chunk_index", "chunk_text")))
    refs = asked.select("doc_id", F.col("key").alias("char_ord"), F.posexplode("references").alias("ord", "r"), "terms")
    refs = refs.select("doc_id", "char_ord", "ord", "r.chunk_index", "r.local_id", "terms")
    shown = snippets(refs, chunks).groupBy("doc_id", F.col("char_ord").alias("key")).agg(F.array_sort(F.collect_list(F.struct("ord", "chunk_index", "snippet"))).alias("snippets"))
    named = asked.select("doc_id", "key", clean_terms(F.col("terms")).alias("terms"))
    met = mentions_by_key(named, chunks).groupBy("doc_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "term_ord", "query", "snippet"))), lambda m: F.struct(m["chunk_index"].alias("chunk_index"), m["query"].alias("query"), m["snippet"].alias("snippet"))).alias("mentions"))
    out = asked.select("doc_id", "key").join(shown, ["doc_id", "key"], "left").join(met, ["doc_id", "key"], "left")
    return opened(out, kind)
