"""Progress events and incremental ingest as streams; each works on batches too."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("done", "error")
FORGET_MS = 24 * 3600 * 1000
EVENT = "job_id string, ts timestamp_ntz, step string, pct int, message string"


def events(counts: DataFrame, step: str, template: str, start: int, stop: int) -> DataFrame:
    """An event for each row of counts (job_id, ts, i, n), with {i} and {n} in the template."""
    from ..functions.text import percent

    message = F.replace(F.replace(F.lit(template), F.lit("{i}"), F.col("i").cast("string")), F.lit("{n}"), F.col("n").cast("string"))
    return counts.select("job_id", "ts", F.lit(step).alias("step"), percent(F.col("i"), F.col("n"), start, stop).alias("pct"), message.alias("message"))


def log_lines(logs: DataFrame) -> DataFrame:
    """A row for each line of ``text`` that isn't blank."""
    lines = logs.select("job_id", "ts", F.posexplode(F.split("text", "\n", -1)).alias("line", "message"))
    return lines.where(F.trim("message") != "")


#: Events of one time are in the order of their percent, a terminal one last, then of step and message.
ORDER = ("ts", "terminal", "pct", "step", "message")


def until_terminal(stream: DataFrame) -> DataFrame:
    """Batch: the events of each job up to its first terminal one, in ORDER; none after it.

    Of the events a job ends with, equal rows of the first terminal one all stay.
    """
    missing = [F.lit(None).alias(c) for c in ("pct", "message") if c not in stream.columns]
    keyed = stream.select("*", *missing, F.col("step").isin(*TERMINAL).alias("terminal")) if missing else stream.withColumn("terminal", F.col("step").isin(*TERMINAL))
    place = F.struct(*ORDER)
    end = F.min(F.when(F.col("terminal"), place)).over(Window.partitionBy("job_id"))
    return keyed.withColumn("__end", end).where(F.col("__end").isNull() | (place <= F.col("__end"))).select(*stream.columns)


def _open_only(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    closed = state.exists and state.get[0]
    # the events of one trigger, which are few for a job, are put in order together
    rows = pd.concat(list(batches), ignore_index=True)
    if not closed:
        rows = rows.assign(terminal=rows["step"].isin(TERMINAL)).sort_values(list(ORDER), kind="stable")
        ends = rows["terminal"].to_numpy().nonzero()[0]
        if len(ends):
            closed, rows = True, rows.iloc[: ends[0] + 1]
        yield rows.drop(columns="terminal")
    state.update((bool(closed),))
    state.setTimeoutDuration(FORGET_MS)


def stream_until_terminal(stream: DataFrame) -> DataFrame:
    """Stream: a job's events until a terminal one has been seen, those of a trigger in ORDER.

    The state is one flag a job; it is forgotten when a job has been silent for FORGET_MS.
    """
    return stream.groupBy("job_id").applyInPandasWithState(_open_only, EVENT, "closed boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest_status(updates: DataFrame, *tie: str) -> DataFrame:
    """The last status of each job with its error, both of one event; of events of one time the last by ``tie``, then status and error."""
    last = F.max_by(F.struct("status", "error", "ts"), F.struct("ts", *tie, "status", "error"))
    return updates.groupBy("job_id").agg(last.alias("last")).select("job_id", "last.status", "last.error", "last.ts")


def as_sse(stream: DataFrame) -> DataFrame:
    """Server-sent events, nulls left out."""
    return stream.select(F.concat(F.lit("event: progress\ndata: "), F.to_json(F.struct("ts", "step", "pct", "message")), F.lit("\n\n")).alias("value"))


def expired(files: DataFrame, now: str, hours: int) -> DataFrame:
    """Artefacts older than some hours: path and modificationTime."""
    return files.where(F.col("modificationTime") < F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(hours)))


def ingest(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """New files of a folder, each handed once to ``handle`` with its micro-batch."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True)
