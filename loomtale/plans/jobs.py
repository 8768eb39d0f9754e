"""Files as jobs: the Pipeline's stages over a micro-batch of files, with an event for each stage of each job.

A file is a job and its path the job's id and doc_id.  Each stage is checkpointed before its events are published, so an event tells of
what is done.  A batch that runs again publishes only what it hasn't yet (nothing, if it had ended), and its results are one version by the batch's number.  Jobs
that fail (an unreadable file, a text that the guardrail refuses) end with an error, the others of the batch go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import percent
from ..operators import chunking, extraction, guardrails, narrative
from ..operators.lineage import cut
from ..sources.readers import Reader, extract_blocks
from ..streaming.progress import ingest
from ..streaming.store import Events, Results
from .narrative import Pipeline

#: Steps in the order in which a job passes them, and the percent that each ends with.
STEPS = {"reading": None, "progress": 5, "chunking": None, "character_extraction": 95, "character_consolidation": 97, "prompt_generation": 99, "done": 100}

#: The number of the stage that ends a batch.
LAST = 10


def _event(jobs: DataFrame, step: str, message: Column | str, pct: Column | int | None = None) -> DataFrame:
    """An event of each row of ``jobs`` (doc_id), at the time of its stage."""
    text = F.lit(message) if isinstance(message, str) else message
    return jobs.select(F.col("doc_id").alias("job_id"), F.current_timestamp().cast("timestamp_ntz").alias("ts"), F.lit(step).alias("step"), (pct if isinstance(pct, Column) else F.lit(pct)).cast("int").alias("pct"), text.alias("message"))


def run_batch(files: DataFrame, batch: int, pipeline: Pipeline, events: Events, results: Results, readers: dict[str, Reader] | None = None) -> None:
    """All stages of the jobs of one batch; files: path, content."""
    if events.has(batch, LAST):
        return
    stage = iter(range(LAST + 1))
    publish = lambda *made: events.publish(_all(made), batch, next(stage))
    jobs = files.select(F.col("path").alias("doc_id"))
    publish(_event(jobs, "reading", "reading the file"))
    read = cut(extract_blocks(files, readers).withColumnRenamed("path", "doc_id"))
    refused = F.coalesce("error", guardrails.text_error(F.array_join("blocks", "\n")))
    read = cut(read.withColumn("refused", refused))
    jobs = read.where("refused is null").select("doc_id")
    publish(_event(read.where("refused is not null"), "error", F.col("refused")), _event(jobs, "progress", "processing", STEPS["progress"]))
    publish(_event(jobs, "chunking", "cutting the text into chunks"))
    whole = chunking.chunk(read.where("refused is null"), blocks=F.col("blocks"), max_chars=pipeline.max_chars, overlap=pipeline.overlap)
    chunks = cut(narrative.narrative_chunks(whole))
    counted = cut(jobs.join(chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id", "left").na.fill(0, ["n"]))
    publish(_event(counted, "chunking", F.concat(F.col("n").cast("string"), F.lit(" chunks"))))
    observed = cut(extraction.extract(chunks, pipeline.extractor))
    each = observed.join(counted, "doc_id").withColumn("i", F.col("chunk_index") + 1)
    steps = F.concat(F.lit("chunk "), F.col("i").cast("string"), F.lit(" of "), F.col("n").cast("string"))
    publish(_event(each, "character_extraction", steps, percent(F.col("i"), F.col("n"), 0, STEPS["character_extraction"])))
    publish(_event(jobs, "character_extraction", "characters extracted", STEPS["character_extraction"]))
    publish(_event(jobs, "character_consolidation", "consolidating characters", STEPS["character_consolidation"]))
    found = cut(pipeline.consolidate(observed, chunks))
    publish(_event(jobs, "character_consolidation", "characters consolidated", STEPS["character_consolidation"]))
    publish(_event(jobs, "prompt_generation", "making cards", STEPS["character_consolidation"]))
    made = cut(pipeline.cards(found, chunks))
    publish(_event(jobs, "prompt_generation", "cards made", STEPS["prompt_generation"]))
    results.write(made, jobs, f"batch-{batch:09}")
    publish(_event(jobs, "done", "finished", STEPS["done"]))


def _all(parts: tuple[DataFrame, ...]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def serve(spark: SparkSession, folder: str, path: str, pipeline: Pipeline | None = None, readers: dict[str, Reader] | None = None) -> DataStreamWriter:
    """New files of ``folder`` as jobs; events, results and the stream's checkpoint are below ``path``."""
    pipeline, events, results = pipeline or Pipeline(), Events(spark, f"{path}/events"), Results(spark, f"{path}/results")
    return ingest(spark, folder, lambda files, batch: run_batch(files, batch, pipeline, events, results, readers), f"{path}/checkpoint")
