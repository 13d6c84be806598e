"""Exact dedup over a cuckoo-filter index of live digests.

Each index owns the digests of one hash partition. A cuckoo filter (two candidate buckets of four 16-bit fingerprints)
answers most probes for new digests without a look at the stored keys; a hit is verified against the bucketed content,
which holds the whole SHA-256 digests. When an insertion evicts too often the filter is rebuilt at twice the size from
the stored keys. An update deletes the digests of which a copy goes, and inserts again what is still live of them.

Defined results: null texts count as empty texts; rows that repeat a doc_id and a text are counted each and share one
decision, and `drop_copies` leaves one of them, the one of least hash; null doc_ids rank below all others; an empty table
gives no rows; other columns are ignored by `exact_dedup` and kept by `drop_copies`.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import cut, text_mark, unused, without

SLOTS = 4
KICKS = 200
BATCH_ROWS = 20_000


class CuckooFilter:
    """Fingerprints of digests; `add` reports an overflow by False, after which the filter has to be rebuilt."""

    def __init__(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots = array("H", bytes(2 * SLOTS * buckets))

    def places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "big") or 1
        first = int.from_bytes(digest[8:16], "big") & self.mask
        return mark, first, self.other(first, mark)

    def other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x9E3779B1 >> 7)) & self.mask

    def __contains__(self, digest: bytes) -> bool:
        mark, first, second = self.places(digest)
        s = self.slots
        return mark in s[first * SLOTS : first * SLOTS + SLOTS] or mark in s[second * SLOTS : second * SLOTS + SLOTS]

    def _put(self, bucket: int, mark: int) -> bool:
        for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.slots[i]:
                self.slots[i] = mark
                return True
        return False

    def add(self, digest: bytes) -> bool:
        mark, first, second = self.places(digest)
        if self._put(first, mark) or self._put(second, mark):
            return True
        bucket = second
        for kick in range(KICKS):
            i = bucket * SLOTS + kick % SLOTS
            mark, self.slots[i] = self.slots[i], mark
            bucket = self.other(bucket, mark)
            if self._put(bucket, mark):
                return True
        return False

    def discard(self, digest: bytes) -> None:
        mark, first, second = self.places(digest)
        for bucket in (first, second):
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.slots[i] == mark:
                    self.slots[i] = 0
                    return


class LiveDigests:
    """Live digests, each with the largest doc_id seen and the number of its rows."""

    def __init__(self, buckets: int = 64) -> None:
        self.filter = CuckooFilter(buckets)
        self.content: list[dict[bytes, list]] = [{} for _ in range(256)]
        self.resized = 0

    def get(self, digest: bytes) -> list | None:
        """The entry of a live digest; a hit of the filter counts only if the stored key agrees."""
        return self.content[digest[31]].get(digest) if digest in self.filter else None

    def insert(self, digest: bytes, doc_id: int | None, rows: int) -> None:
        entry = self.get(digest)
        if entry is None:
            self.content[digest[31]][digest] = [doc_id, rows]
            if not self.filter.add(digest):
                self._resize()
            return
        if entry[0] is None or doc_id is not None and doc_id > entry[0]:
            entry[0] = doc_id
        entry[1] += rows

    def delete(self, digest: bytes) -> bool:
        """Takes a digest away; False if it isn't live."""
        if self.get(digest) is None:
            return False
        del self.content[digest[31]][digest]
        self.filter.discard(digest)
        return True

    def _resize(self) -> None:
        buckets = self.filter.mask + 1
        while True:
            buckets *= 2
            self.resized += 1
            self.filter = CuckooFilter(buckets)
            if all(self.filter.add(d) for bucket in self.content for d in bucket):
                return

    def __iter__(self) -> Iterator[tuple[bytes, int | None, int]]:
        for bucket in self.content:
            for digest, (doc_id, rows) in bucket.items():
                yield digest, doc_id, rows


GROUPS = "digest binary, keep_id bigint, group_size bigint"
_GROUPS = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _batches(index: LiveDigests) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for row in index:
        rows.append(row)
        if len(rows) == BATCH_ROWS:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _GROUPS)], schema=_GROUPS)
            rows = []
    if rows:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _GROUPS)], schema=_GROUPS)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, keep_id, group_size) are inserted; a size of 0 deletes the digest."""
    index = LiveDigests()
    for batch in batches:
        for digest, doc_id, rows in zip(*(c.to_pylist() for c in batch.columns)):
            if rows > 0:
                index.insert(digest, doc_id, rows)
            else:
                index.delete(digest)
    yield from _batches(index)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, digest) of every row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_mark(F.col("text")).alias("mark"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    )


def _merged(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of the rows (doc_id, digest) of each task."""
    return rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).mapInArrow(_index, GROUPS)


def build_index(docs: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of every live digest.

    Each task first merges the rows it reads in an index of its own, so a text that a third of all rows share sends one
    row per task to the index that owns its digest.
    """
    return _merged(digests(docs)).repartition("digest").mapInArrow(_index, GROUPS)


def update_index(index: DataFrame, inserted: DataFrame, deleted: DataFrame, live: DataFrame) -> DataFrame:
    """`index` after the rows of `inserted` came and those of `deleted` (doc_id, text) went; `live` has the documents as
    they are then.

    A digest of which a copy went is deleted and inserted again with its live copies, so keep_id always names a live
    document; rows of `deleted` that never were change nothing.
    """
    touched = cut(digests(deleted).select("digest").distinct())
    left = _merged(digests(live).join(touched, "digest", "left_semi"))
    came = _merged(digests(inserted).join(touched, "digest", "left_anti"))
    steps = (
        index.select("digest", "keep_id", "group_size", F.lit(0).alias("step"))
        .unionByName(touched.select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(1).alias("step")))
        .unionByName(left.unionByName(came).withColumn("step", F.lit(2)))
    )
    return steps.repartition("digest").sortWithinPartitions("step", "digest").drop("step").mapInArrow(_index, GROUPS)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), keep_id, group_size, kept, text_sha256 of every row; of equal texts the largest doc_id is
    kept."""
    groups = build_index(docs)
    rows = digests(docs).join(groups, "digest")
    return rows.select(
        "doc_id",
        "mark",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that `exact_dedup` keeps, with their own columns, and of rows that repeat a doc_id and a text
    one."""
    judged = cut(exact_dedup(docs).select("doc_id", "mark", "kept"))
    kept = without(docs, judged.where(~F.col("kept")))
    repeated = judged.where("kept").groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "mark")
    repeated = cut(repeated)
    if repeated.isEmpty():
        return kept
    id_, mark, place = (unused(docs, x) for x in ("own_id", "own_mark", "own_place"))
    marked = kept.withColumns({id_: F.col("doc_id").cast("long"), mark: text_mark(F.col("text"))})
    same = marked[id_].eqNullSafe(repeated["doc_id"]) & (marked[mark] == repeated["mark"])
    plain = [f"`{c.replace('`', '``')}`" for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    several = Window.partitionBy(id_, mark).orderBy(F.xxhash64(*plain))
    first = marked.join(repeated, same, "left_semi").withColumn(place, F.row_number().over(several)).where(F.col(place) == 1).drop(place)
    return marked.join(repeated, same, "left_anti").unionByName(first).drop(id_, mark)
