"""Tables that grow by whole folders: each appears by one rename, so readers see all of it or nothing."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import opened, sealed
from .progress import EVENT


class Store:
    """A folder in any store that Spark reaches by a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name)))

    def add(self, df: DataFrame, name: str) -> bool:
        """Writes a table as the folder ``name``; False if it is there already, which it then stays."""
        if self.exists(name):
            return False
        draft = f"_draft-{uuid.uuid4().hex}"  # readers pass over such names
        df.write.parquet(f"{self.path}/{draft}")
        self._fs.mkdirs(self._at(name).getParent())
        if not self._fs.rename(self._at(draft), self._at(name)):
            self._fs.delete(self._at(draft), True)
            return False
        return True

    def put(self, name: str, value: object) -> bool:
        """Writes a small JSON file; False if there is one of this name."""
        draft = f"_draft-{uuid.uuid4().hex}"
        out = self._fs.create(self._at(draft))
        out.write(json.dumps(value).encode())
        out.close()
        done = not self.exists(name) and self._fs.rename(self._at(draft), self._at(name))
        if not done:
            self._fs.delete(self._at(draft), False)
        return done

    def get(self, name: str) -> object:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])


class Events:
    """An append-only table of progress events: a folder for each stage of each micro-batch, which a replayed batch doesn't write again."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path)

    def has(self, batch: int, stage: int) -> bool:
        return self.store.exists(f"batch-{batch:09}-stage-{stage:02}")

    def publish(self, events: DataFrame, batch: int, stage: int) -> bool:
        """False if the stage's events are there already; they stay as they are."""
        return self.store.add(events.select("job_id", "ts", "step", "pct", "message"), f"batch-{batch:09}-stage-{stage:02}")

    def read(self) -> DataFrame:
        return self.store.spark.read.schema(EVENT).option("recursiveFileLookup", True).parquet(self.store.path)

    def stream(self) -> DataFrame:
        return self.store.spark.readStream.schema(EVENT).option("recursiveFileLookup", True).parquet(self.store.path)

    def status(self) -> DataFrame:
        """job_id, status (running, done or error) and error of each job."""
        last = F.max_by(F.struct("step", "message"), F.struct(F.col("step").isin("done", "error"), "ts", "pct", "step", "message"))
        status = F.when(F.col("last.step").isin("done", "error"), F.col("last.step")).otherwise("running")
        return self.read().groupBy("job_id").agg(last.alias("last")).select("job_id", status.alias("status"), F.when(F.col("last.step") == "error", F.col("last.message")).alias("error"))


class Results:
    """What jobs have given, by document: a run replaces the rows of its own documents and leaves all others.

    A run is a version of at most ``files`` files, whatever the number of documents, and counts once a manifest names it: manifests
    are numbered, each lists all versions that count, and the last one is read.  So a run that is killed leaves the
    results as they were, and of two runs at a time the second one to end starts over from the first one's manifest.
    """

    def __init__(self, spark: SparkSession, path: str, files: int = 16):
        self.store, self.files = Store(spark, path), files

    def _last(self) -> tuple[int, list[str]]:
        numbers = [int(n[9:18]) for n in self.store.names() if n.startswith("manifest-")]
        return (max(numbers), self.store.get(f"manifest-{max(numbers):09}.json")) if numbers else (0, [])

    def write(self, rows: DataFrame, documents: DataFrame, name: str | None = None) -> bool:
        """``rows`` (with doc_id) are all that there is of ``documents`` (doc_id) from now on; a version's name is written once."""
        name = name or uuid.uuid4().hex
        if name in self._last()[1]:
            return False
        dealt = lambda df: df.repartition(self.files, F.xxhash64("doc_id"))
        self.store.add(dealt(rows), f"{name}/rows")
        self.store.add(dealt(documents.select("doc_id").distinct()), f"{name}/documents")
        while True:
            number, versions = self._last()
            if name in versions or self.store.put(f"manifest-{number + 1:09}.json", [*versions, name]):
                return True

    def _versions(self, part: str, versions: list[str]) -> DataFrame:
        read = lambda k, v: self.store.spark.read.parquet(f"{self.store.path}/{v}/{part}").withColumn("__version", F.lit(k))
        out = read(0, versions[0])
        for k, v in enumerate(versions[1:], 1):
            out = out.unionByName(read(k, v), allowMissingColumns=True)
        return out

    def read(self) -> DataFrame | None:
        """The rows of each document's last version; None before the first one."""
        versions = self._last()[1]
        if not versions:
            return None
        rows = self._versions("rows", versions)
        kind = rows.schema["doc_id"].dataType
        last = sealed(self._versions("documents", versions)).groupBy("doc_id").agg(F.max("__version").alias("__version"))
        return opened(sealed(rows).join(last, ["doc_id", "__version"]).drop("__version"), kind)

    def compact(self) -> None:
        """All versions as one, so that their number stays small; a killed one changes nothing."""
        number, versions = self._last()
        if len(versions) > 1:
            name = uuid.uuid4().hex
            self.store.add(self.read().repartition(self.files, F.xxhash64("doc_id")), f"{name}/rows")
            self.store.add(self._versions("documents", versions).select("doc_id").distinct().repartition(self.files, F.xxhash64("doc_id")), f"{name}/documents")
            self.store.put(f"manifest-{number + 1:09}.json", [name])  # not if another run has ended meanwhile
