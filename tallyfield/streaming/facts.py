"""Facts that are merged once: a table of the latest fact of each key, as versions of Parquet files.

The table is dealt into a fixed number of buckets by key. A merge writes new files for the buckets that it touches and
refers to the old files of all others; a version is a small file in the log, written only if no other writer has written
that version, else the merge is done again on the newer one. So no update is lost, and readers always see a whole version.

The log remembers the last batch of each writer. A batch that comes again changes nothing, and as the fact that stays of a
key depends on the facts alone, batches may come in any order.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16
#: A fact: what a run of a title cost, or null where that can't be recovered.
FACTS = "appid bigint, run bigint, cost bigint, at timestamp"


class _Store:
    """The folder by Hadoop's file system, so that it can be in any store."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.io = spark._jvm.org.apache.commons.io.IOUtils

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.files.listStatus(at)) if self.files.exists(at) else []

    def read(self, file: str) -> dict:
        stream = self.files.open(self.path(file))
        try:
            return json.loads(self.io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, file: str, content: dict) -> bool:
        """Writes a new file as a whole; False if there is one already, which a shared store's rename finds out for sure."""
        draft = self.path(f"{file}.{uuid.uuid4().hex}.draft")
        stream = self.files.create(draft, False)
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        stream.close()
        done = not self.files.exists(self.path(file)) and self.files.rename(draft, self.path(file))
        if not done:
            self.files.delete(draft, False)
        return done

    def delete(self, path: str) -> None:
        self.files.delete(self.path(path), True)


class FactTable:
    """The facts in `folder`; `buckets` counts when the table is new."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.store = spark, folder, _Store(spark, folder)
        self.buckets = self._version()[1].get("buckets", buckets)

    def _version(self) -> tuple[int, dict]:
        known = [n for n in self.store.names(f"{self.folder}/log") if n.endswith(".json")]
        if not known:
            return 0, {"files": {}, "batches": {}}
        return int(known[-1].removesuffix(".json")), self.store.read(f"{self.folder}/log/{known[-1]}")

    def version(self) -> int:
        return self._version()[0]

    def _rows(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(FACTS).parquet(*files) if files else self.spark.createDataFrame([], FACTS)

    def read(self) -> DataFrame:
        return self._rows(sorted(self._version()[1]["files"].values()))

    def merge(self, facts: DataFrame, writer: str, batch: int) -> bool:
        """Adds the batch of a writer, whose batches are numbered upwards; False if the table has it already."""
        rows = latest(facts.select("appid", "run", "cost", "at")).withColumn("bucket", F.pmod(F.xxhash64("appid", "run"), F.lit(self.buckets)))
        folder = f"{self.folder}/new/{uuid.uuid4().hex}"
        rows.write.partitionBy("bucket").parquet(folder)  # what has come is computed once, however often the merge is tried
        try:
            while True:
                version, was = self._version()
                if batch <= was["batches"].get(writer, -1):
                    return False
                touched = {n.removeprefix("bucket="): f"{folder}/{n}" for n in self.store.names(folder) if n.startswith("bucket=")}
                files = dict(was["files"])
                if touched:
                    old = [files[b] for b in touched if b in files]
                    merged = latest(self._rows([*old, *touched.values()]))
                    there = f"{self.folder}/data/{uuid.uuid4().hex}"
                    merged.withColumn("bucket", F.pmod(F.xxhash64("appid", "run"), F.lit(self.buckets))).write.partitionBy("bucket").parquet(there)
                    files |= {b: f"{there}/bucket={b}" for b in touched}
                new = {"files": files, "batches": was["batches"] | {writer: batch}, "buckets": self.buckets}
                if self.store.create(f"{self.folder}/log/{version + 1:012d}.json", new):
                    return True
        finally:
            self.store.delete(folder)

    def vacuum(self) -> None:
        """Removes older versions and the files that only they refer to; not while anything reads or merges."""
        version, now = self._version()
        for name in self.store.names(f"{self.folder}/log"):
            if name != f"{version:012d}.json":
                self.store.delete(f"{self.folder}/log/{name}")
        for name in self.store.names(f"{self.folder}/data"):
            for part in self.store.names(f"{self.folder}/data/{name}"):
                if f"{self.folder}/data/{name}/{part}" not in now["files"].values():
                    self.store.delete(f"{self.folder}/data/{name}/{part}")


def latest(facts: DataFrame) -> DataFrame:
    """One fact of each (appid, run): a known cost before none, then the later one, then the larger."""
    best = F.max_by(F.struct("cost", "at"), F.struct(F.col("cost").isNotNull(), "at", "cost"))
    return facts.groupBy("appid", "run").agg(best.alias("x")).select("appid", "run", "x.cost", "x.at")


def follow(stream: DataFrame, table: FactTable, log: str, writer: str = "stream") -> None:
    """Merges a stream of facts over what is there now; `log` is its checkpoint. A micro-batch that runs again after a
    failure has the number that it had."""
    merge = lambda rows, batch: table.merge(rows, writer, batch) and None
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
