"""What the corpus operators share: tables, staging, row keys and Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes handled at a time inside a Python task, so that memory doesn't follow the batch size.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("loomtale.stage.dir", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("loomtale.stage.dir", own)
    return own


_live: list[Staged] = []


@contextlib.contextmanager
def workspace() -> Iterator[Callable[[Staged], Staged]]:
    """Tables staged inside are deleted at the end, but for those given to the yielded function."""
    kept, earlier = [], list(_live)

    def keep(table: Staged) -> Staged:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        for t in [t for t in _live if t not in earlier and t not in kept]:
            t.drop()


class Staged:
    """A table written to the shared folder: a cut in the lineage that outlives executors.

    It is deleted by ``drop``, at the end of a ``workspace``, or when the driver ends; what a driver
    that dies leaves is found in the shared folder under ``loomtale-``.
    """

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/loomtale-{label}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        atexit.register(self.drop)
        _live.append(self)

    def drop(self) -> None:
        """Deletes the table; call it once nothing lazy reads it."""
        atexit.unregister(self.drop)
        if self in _live:
            _live.remove(self)
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may have ended; its folder goes with it
            pass


def text_hash(text: Column) -> Column:
    """128 bits of a text as two longs; null as its own value."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text, F.length(text)).alias("b"))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``; one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` and the new columns; one of the same name gives way."""
    return pa.RecordBatch.from_pydict({n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in new} | new)


def schema_with(df: DataFrame, new: str) -> StructType:
    """The schema of ``df`` and the new columns, as ``with_columns`` orders them."""
    return StructType([*df.schema.fields, *StructType.fromDDL(new).fields])


def _place(columns: list[str], name: str) -> int:
    """Where a column is: of this very name, or else the first of it in another case."""
    for spelled, wanted in ((columns, name), ([c.lower() for c in columns], name.lower())):
        if wanted in spelled:
            return spelled.index(wanted)
    raise ValueError(f"there is no column {name} among {columns}")


def only(docs: DataFrame, names: Iterable[str]) -> DataFrame:
    """These columns alone, whatever other columns are called."""
    apart = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return apart.select(*[F.col(f"c{_place(docs.columns, n)}").alias(n) for n in names])


class Inner:
    """A table's columns under names of the operator's own, so that no name of the user's can clash with them.

    ``roles`` maps the operator's names to the user's (in any case); all other columns are carried as
    c0, c1, ...  ``new`` are the names of the results: columns of the same name, in any case, give way.
    Names may hold any character.
    """

    def __init__(self, docs: DataFrame, new: Iterable[str], **roles: str):
        at = {_place(docs.columns, name): role for role, name in roles.items()}
        gone = {n.lower() for n in new}
        names = [at.get(i, f"c{i}") for i in range(len(docs.columns))]
        self.kept = [(n, c) for i, (n, c) in enumerate(zip(names, docs.columns, strict=True)) if i in at or c.lower() not in gone]
        self.df = docs.toDF(*names).select(*[n for n, _ in self.kept])

    def outer(self, df: DataFrame, *new: Column | str) -> DataFrame:
        """``df`` with the user's names and order of columns, and the results."""
        return df.select(*[F.col(n).alias(c) for n, c in self.kept], *new)
