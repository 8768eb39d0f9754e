"""The whole flow over a batch of documents, as one lazy lineage up to the order-dependent merge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import detected
from ..operators import cards, chunking, consolidation, extraction, guardrails, narrative, resolving, retrieval
from ..operators.keys import opened, sealed
from ..operators.lineage import Bucketed, cut
from ..streaming import progress


@dataclass(frozen=True)
class Pipeline:
    """Documents (doc_id, text) to characters and cards; models are callables, offline ones by default."""

    extractor: extraction.Extractor = extraction.capitalised_names
    resolver: resolving.Resolver | None = None
    generator: cards.Generator = cards.plain_card
    max_chars: int = chunking.MAX_CHARS
    overlap: int = chunking.OVERLAP
    merge: float = V.AUTO_MERGE
    review: float = V.REVIEW

    def chunks(self, docs: DataFrame) -> DataFrame:
        """Narrative chunks of the documents that pass the guardrail; the filter runs before any call."""
        usable = guardrails.passed(docs, guardrails.text_error(F.col("text")))
        return narrative.narrative_chunks(chunking.chunk(usable, max_chars=self.max_chars, overlap=self.overlap))

    def characters(self, docs: DataFrame) -> DataFrame:
        chunks = self.chunks(docs)
        return self.consolidate(extraction.extract(chunks, self.extractor), chunks)

    def consolidate(self, observations: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
        """Observations to characters, those with too little evidence aside; a resolver is shown their source if there are chunks.

        Observed characters, their groups and clusters are read more than once, so they are cut:
        models are asked once, and the rest starts from small plans.
        """
        kind = observations.schema["doc_id"].dataType
        seen = Bucketed(consolidation.observed(sealed(observations)), "doc_id", "group_key")
        found = cut(consolidation.groups(seen.df))
        assigned = cut(consolidation.clusters(found, self.resolver, merge=self.merge, review=self.review, chunks=sealed(chunks) if chunks is not None else None, rows=seen.df))
        whole = consolidation.characters(seen.df, assigned)
        seen.drop()  # the clusters' rows are a table of their own
        return opened(whole.where(~consolidation.anecdotal(whole)), kind)

    def cards(self, found: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
        """A card for each eligible character; the generator is shown its source if there are chunks."""
        kind = found.schema["doc_id"].dataType
        chosen = sealed(found.where(consolidation.eligible(found)))
        if chunks is not None:
            chunks = sealed(chunks)
            key = F.struct("ord", "canonical_name")
            names = F.concat(F.array("canonical_name"), "aliases", "specific_appellations", F.transform("identity_names", lambda n: n["value"]))
            source = retrieval.source_context(chosen.select("doc_id", key.alias("key"), "references", names.alias("terms")), chunks)
            chosen = chosen.withColumn("key", key).join(source.select("doc_id", "key", F.struct("snippets", "mentions").alias("source")), ["doc_id", "key"], "left")
        return cards.generate_cards(cards.payload(opened(chosen, kind)), self.generator)

    def events(self, chunks: DataFrame, ts: Column) -> DataFrame:
        """A progress event for each chunk to be read, by document: what a job reports while it extracts."""
        counts = chunks.select(F.col("doc_id").cast("string").alias("job_id"), ts.alias("ts"), (F.col("chunk_index") + 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("n"))
        return progress.events(counts, "extraction", "chunk {i} of {n}", 5, 95)


def language_report(docs: DataFrame, max_chars: int = 400) -> DataFrame:
    """The flagship query: usable documents by detected language, with their narrative chunks."""
    usable = detected(guardrails.passed(docs, guardrails.text_error(F.col("text"))))
    chunks = usable.select("language", F.posexplode(chunking.chunks_of(F.array("text"), max_chars, 1)).alias("n", "chunk"))
    # a generator of one row keeps the optimizer from writing the predicate out for every use
    judged = chunks.select("language", "n", F.length("chunk").alias("chars"), F.explode(F.array(~narrative.non_narrative(F.col("chunk")))).alias("kept"))
    return judged.groupBy("language").agg(
        F.count_if(F.col("n") == 0).alias("documents"), F.count(F.lit(1)).alias("chunks"), F.count_if("kept").alias("narrative_chunks"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("chars"))), F.lit(0)).alias("narrative_chars")
    )
