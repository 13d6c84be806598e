"""A sink that writes one file per entity, with commits.

Tasks write to a folder of their own below the target, so an attempt that fails or is overtaken leaves nothing that counts.
The driver then moves the files of the attempts that succeeded into a new version and points readers to it by one small
file, which is replaced as a whole: they see all files of the old version or all of the new. A file is written piece by
piece, so it may be larger than a task's memory.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tallyfield.package import ship

#: name: the file; rank and seq: the order of its pieces.
PIECES = "name string, rank int, seq bigint, piece string"
POINTER = "_current.json"


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, which may name its store, and the path within."""
    return pafs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else f"file://{path}")


def replace_file(files: pafs.FileSystem, path: str, content: bytes) -> None:
    """Writes a file under another name and moves it, so that nobody sees half of it."""
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with files.open_output_stream(draft) as out:
        out.write(content)
    files.move(draft, path)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class EntityFiles(DataSource):
    """Option: path. Rows as in PIECES, all of a name in one task and in order."""

    @classmethod
    def name(cls) -> str:
        return "entity_files"

    def schema(self) -> str:
        return PIECES

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, root = located(self.path)
        folder = f"{root}/_staged/{self.job}/{uuid.uuid4().hex}"
        files.create_dir(folder, recursive=True)
        names: list[str] = []
        out, last = None, None
        try:
            for name, rank, seq, piece in iterator:
                if out is None or name != names[-1]:
                    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name or "") or name in names[-1:]:
                        raise ValueError(f"{name!r} can't be the name of a file")
                    if out is not None:
                        out.close()
                    out, last = files.open_output_stream(f"{folder}/{name}"), None
                    names.append(name)
                if last is not None and (rank, seq) < last:
                    raise ValueError(f"the pieces of {name} aren't in order")
                last = (rank, seq)
                out.write((piece or "").encode())
        finally:
            if out is not None:
                out.close()
        if len(set(names)) < len(names):
            raise ValueError("the pieces of a file don't follow one another")
        return Written(folder, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = located(self.path)
        version = f"{root}/{self.job}"
        files.create_dir(version, recursive=True)
        names: set[str] = set()
        for m in messages:
            for name in m.names if m else []:
                if name in names:
                    raise ValueError(f"two tasks wrote {name}")
                names.add(name)
                files.move(f"{m.folder}/{name}", f"{version}/{name}")
        before = current_version(self.path)
        replace_file(files, f"{root}/{POINTER}", json.dumps({"version": self.job, "before": before and before[0]}).encode())
        if before and before[1]:  # readers of the version before may go on; the one before that goes
            self._remove(files, f"{root}/{before[1]}")
        self._remove(files, f"{root}/_staged/{self.job}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = located(self.path)
        self._remove(files, f"{root}/_staged/{self.job}")
        self._remove(files, f"{root}/{self.job}")

    @staticmethod
    def _remove(files: pafs.FileSystem, folder: str) -> None:
        if files.get_file_info(folder).type != pafs.FileType.NotFound:
            files.delete_dir(folder)


def current_version(path: str) -> tuple[str, str | None] | None:
    """The version that readers see, and the one before."""
    files, root = located(path.rstrip("/"))
    if files.get_file_info(f"{root}/{POINTER}").type == pafs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{root}/{POINTER}") as f:
        told = json.loads(f.read())
    return told["version"], told["before"]


def write_entities(pieces: DataFrame, path: str) -> None:
    """Writes the files that `pieces` (name, rank, seq, piece) make up, as the new content of `path`."""
    spark = pieces.sparkSession
    ship(spark)
    spark.dataSource.register(EntityFiles)
    rows = pieces.select("name", F.col("rank").cast("int").alias("rank"), F.col("seq").cast("long").alias("seq"), F.col("piece").cast("string").alias("piece"))
    rows.repartition("name").sortWithinPartitions("name", "rank", "seq").write.format("entity_files").mode("append").option("path", path).save()


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """name, content of the files of the version that is current."""
    version = current_version(path)
    if version is None:
        return spark.createDataFrame([], "name string, content string")
    rows = spark.read.text(f"{path.rstrip('/')}/{version[0]}", wholetext=True)
    return rows.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("value").alias("content"))


def json_pieces(documents: DataFrame, name: str) -> DataFrame:
    """A file of JSON, over several lines, for each row; `name` is the column that names it."""
    body = F.to_json(F.struct(*[c for c in documents.columns]), {"pretty": "true", "ignoreNullFields": "false"})
    return documents.select(F.concat(F.col(name).cast("string"), F.lit(".json")).alias("name"), F.lit(0).alias("rank"), F.lit(0).alias("seq"), body.alias("piece"))


def envelope_pieces(heads: DataFrame, items: DataFrame, closing: str) -> DataFrame:
    """Files of JSON that hold long lists: `heads` has name, head, up to where the list begins, `items` name, seq, piece. The
    items of a file are never gathered."""
    first = items.groupBy("name").agg(F.min("seq").alias("first"))
    listed = items.join(first, "name").select("name", F.lit(1).alias("rank"), "seq", F.when(F.col("seq") == F.col("first"), F.col("piece")).otherwise(F.concat(F.lit(","), "piece")).alias("piece"))
    end = lambda rank, piece: heads.select("name", F.lit(rank).alias("rank"), F.lit(0).cast("long").alias("seq"), piece.alias("piece"))
    return end(0, F.col("head")).unionByName(listed.withColumn("seq", F.col("seq").cast("long"))).unionByName(end(2, F.lit(closing)))


def dropped_pieces(classified: DataFrame, reasons: list[str]) -> DataFrame:
    """The report of a game's dropped reviews (game, rid, bucket, reason, text), grouped by reason, for someone to read. A
    group's reviews are in the order of rid; each is a piece of its own."""
    gone = classified.where("reason IS NOT NULL").withColumn("name", F.concat(F.coalesce(F.col("game").cast("string"), F.lit("unknown")), F.lit(".dropped.txt")))
    rank = F.array_position(F.array(*map(F.lit, reasons)), F.col("reason")) * 2
    head = gone.groupBy("name", "game").agg(F.count("*").alias("n"))
    head = head.select("name", F.lit(0).alias("rank"), F.lit(0).alias("seq"), F.format_string("# dropped reviews - %s\n# %d reviews, by reason\n", F.col("game").cast("string"), "n").alias("piece"))
    groups = gone.groupBy("name", "reason").agg(F.count("*").alias("n"))
    groups = groups.select("name", (rank - 1).alias("rank"), F.lit(0).alias("seq"), F.format_string("\n## %s (%d)\n\n", "reason", "n").alias("piece"))
    one = F.concat(F.lit("["), F.col("rid").cast("string"), F.lit("] "), F.coalesce("bucket", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return head.unionByName(groups).unionByName(gone.select("name", rank.alias("rank"), F.col("rid").alias("seq"), one.alias("piece")))
