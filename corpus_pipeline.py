"""A corpus pipeline over ``documents``; each stage is written as Parquet and read again by the next.

Every stage takes documents with doc_id (an integer), text, lang, source and n_chars, in any order and
with any further columns of any name, which it drops.  Nulls: a null text has no words, so quality_rules
rejects it; near_duplicates and decontamination keep it, repeated_strings drops it as a document with
nothing left, encode gives it the end id alone.  Empty texts are handled as null ones.  A null doc_id
counts as the least, and a null source is a host of its own.  Very long texts stay whole.  Repeated rows (equal in doc_id and text) are one document to the
dedup stages: near_duplicates keeps one, the others treat each alike.  Ties of doc_id are ordered by a
hash of the text.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtale.llm import common, decontam, host_quality, near_dedup, phrase_dedup, queries, sp_codec

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules and whose host isn't rejected."""
    return host_quality.judge(common.only(docs, COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates."""
    return near_dedup.near_duplicates(common.only(docs, COLUMNS)).where("first").select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier text has, whole characters only; documents with nothing left go."""
    cut = phrase_dedup.drop_repeats(common.only(docs, COLUMNS), kept_text=True).where(F.length(F.trim("kept")) > 0)
    return cut.withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans of benchmark items; documents that are nothing else go."""
    benchmark = common.table(spark, sf_dir, "benchmark")
    cut = decontam.decontaminate(common.only(docs, COLUMNS), benchmark, cleaned="cleaned").where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    return cut.withColumns({"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the end id, for training."""
    coded = sp_codec.encode_decode(common.only(docs, COLUMNS), queries.PIECES)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("decontamination", decontamination),
    ("sentencepiece", encode),
]

#: Token ids and near-duplicate classes aren't SQL's; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with common.workspace() as keep:
            written = keep(common.Staged(stage(spark, docs, sf_dir), name))
        if before:
            before.drop()
        before, docs = written, written.df
    return STAGES[-1][1](spark, docs, sf_dir)
