"""Cuts in the lineage: what is read more than once, or grows with rounds, is written to the checkpoint folder; columns that are made once."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder that spark.checkpoint.dir names; one of our own only where it is unset and Spark is local."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the checkpoint folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as the session shuffles to."""
    return df.repartition(_tasks(df), *keys)


class Bucketed:
    """A cut as a table in the checkpoint folder, bucketed by ``keys``: what is grouped or joined by them, or by more, moves no more.

    Only the columns that are asked for are read.  It is deleted by ``drop``, else when the driver ends; what a driver that dies
    leaves is in the checkpoint folder under ``loomtale_``.
    """

    def __init__(self, df: DataFrame, *keys: str):
        self.spark = df.sparkSession
        name = f"loomtale_{uuid.uuid4().hex}"
        self.path, self.table = f"{_folder(self.spark)}/{name}", f"spark_catalog.default.{name}"
        dealt(df, *keys).write.format("parquet").option("compression", "zstd").option("path", self.path).bucketBy(_tasks(df), *keys).saveAsTable(self.table)
        self.df = self.spark.table(self.table)
        atexit.register(self.drop)

    def drop(self) -> None:
        """Deletes the table; call it once nothing lazy reads it."""
        atexit.unregister(self.drop)
        try:
            self.spark.sql(f"drop table if exists {self.table}")
            context = self.spark.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may have ended; its folder goes with it
            pass


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that the optimizer can't write out again wherever they are used: a generator of one row makes them."""
    kept = [c for c in df.columns if c not in columns]
    made = df.select(*kept, F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))).alias("made"))
    return made.select(*kept, *[F.col(f"made.{k}").alias(k) for k in columns])
