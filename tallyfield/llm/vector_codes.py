"""Vector code compression: each vector as one byte per part, the index of the nearest entry of the part's codebook.

Components become integers, so all sums and distances are exact. A round broadcasts one kd-tree per codebook; tasks search
them by branch and bound, a batch of vectors at a time, and sum what each entry gets; Spark adds the sums of the tasks, and
the driver divides them. It holds codebooks only, whose size is fixed by the parameters. A node is left out only if its box
lies farther than the best entry so far: nodes at the same distance are visited, since they may hold an entry of a lower
index.

Defined results: vectors go that are null or empty, that hold null or non-finite components, or whose length can't be cut
into the parts or isn't that of the first vector that stays (by vec_id, nulls last, then by components); vectors that share
a vec_id are entries each, in the order of their components. With fewer vectors than entries the codebooks are shorter. A
component beyond LARGEST after scaling counts as LARGEST, so that distances fit a long. A sum of errors that doesn't is
null. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.broadcasts import small
from tallyfield.llm.common import cut

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
LARGEST = 1 << 27
#: Entries in a leaf of a tree.
LEAF = 4


class KdTree:
    """The entries of a codebook in nested boxes; `index` has their places in the codebook, ascending."""

    def __init__(self, entries: np.ndarray, index: np.ndarray | None = None) -> None:
        self.index = np.arange(len(entries)) if index is None else index
        self.points = entries[self.index]
        self.low, self.high = self.points.min(0), self.points.max(0)
        self.children: tuple[KdTree, ...] = ()
        widest = int(np.argmax(self.high - self.low))
        if len(self.index) > LEAF and self.high[widest] > self.low[widest]:
            order = self.index[np.argsort(self.points[:, widest], kind="stable")]
            half = len(order) // 2
            self.children = tuple(KdTree(entries, np.sort(x)) for x in (order[:half], order[half:]))

    def bound(self, at: np.ndarray) -> np.ndarray:
        """The least squared distance that an entry of this box can have."""
        beyond = np.maximum(self.low - at, 0) + np.maximum(at - self.high, 0)
        return np.einsum("ij,ij->i", beyond, beyond)

    def nearest(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry of each point, the lowest of equals, and its squared distance."""
        best, found = np.full(len(at), np.iinfo(np.int64).max), np.full(len(at), len(self.index))
        self._search(at, np.arange(len(at)), best, found)
        return found, best

    def _search(self, at: np.ndarray, rows: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        here = at[rows]
        if not self.children:
            gap = here[:, None, :] - self.points
            far = np.einsum("ijk,ijk->ij", gap, gap)
            k = far.argmin(1)  # the first of equals, so the lowest index of this leaf
            least, which = far[np.arange(len(rows)), k], self.index[k]
            better = (least < best[rows]) | (least == best[rows]) & (which < found[rows])
            best[rows[better]], found[rows[better]] = least[better], which[better]
            return
        bounds = [child.bound(here) for child in self.children]
        first = bounds[0] <= bounds[1]
        for nearer in (True, False):
            for child, bound, own in zip(self.children, bounds, (first, ~first)):
                visit = (own == nearer) & (bound <= best[rows])
                if visit.any():
                    child._search(at, rows[visit], best, found)


def _integers(vectors: pa.Array) -> np.ndarray:
    """A row of scaled integers for each vector; all have the same length."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64).reshape(len(vectors), -1)


def _parts(vectors: pa.Array, parts: int) -> list[np.ndarray]:
    return np.split(_integers(vectors), parts, axis=1)


def usable(parts: int) -> Column:
    """Whether `embedding` can be cut into so many parts and holds finite components only."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & fine


def kept_vectors(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, embedding and label of the rows that stay."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", label.alias("label")).where(usable(parts))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding")).first()
    return rows.where(F.size("embedding") == (first[0] if first else 0))


SUMS = "part int, entry int, n bigint, total array<bigint>"


def _sums(trees: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(t.index), np.int64) for t in trees.value]
        totals = [np.zeros(t.points.shape, np.int64) for t in trees.value]
        for batch in batches:
            for part, (tree, at) in enumerate(zip(trees.value, _parts(batch.column("embedding"), len(trees.value)))):
                found, _ = tree.nearest(at)
                counts[part] += np.bincount(found, minlength=len(tree.index))
                for k in range(at.shape[1]):  # exact: a batch's sums lie far below 2 ** 53
                    totals[part][:, k] += np.bincount(found, weights=at[:, k], minlength=len(tree.index)).astype(np.int64)
        rows = [(p, e, int(n), totals[p][e].tolist()) for p, c in enumerate(counts) for e, n in enumerate(c) if n]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "entry", "n", "total"])

    return run


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part, from the entries of the smallest vec_ids and so many rounds; none for no vectors."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte per part")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    if not first:
        return []
    books = _parts(pa.array([r.embedding for r in first], pa.list_(pa.float64())), parts)
    for _ in range(rounds):
        trees = kept.sparkSession.sparkContext.broadcast([KdTree(b) for b in books])
        sums = kept.select("embedding").mapInArrow(_sums(trees), SUMS)
        width = books[0].shape[1]
        totals = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(k))) for k in range(width)]).alias("total"))
        books = [b.copy() for b in books]
        for r in totals.collect():  # a row for each entry
            books[r.part][r.entry] = [total // r.n for total in r.total]
        trees.unpersist()
    return books


def encode(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (a byte per part) and error, the squared distance of the integers to the code's entries."""
    trees = kept.sparkSession.sparkContext.broadcast([KdTree(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, error = np.empty((batch.num_rows, len(trees.value)), np.uint8), np.zeros(batch.num_rows, np.int64)
            for part, (tree, at) in enumerate(zip(trees.value, _parts(batch.column("embedding"), len(trees.value)))):
                found, far = tree.nearest(at)
                codes[:, part] = found
                error += far
            columns = [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
            yield pa.record_batch(columns, names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, f"vec_id bigint, label {dict(kept.dtypes)['label']}, code binary, error bigint")


def decode(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id and the vector that each code stands for, in the scale of the vectors."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.array([list(c) for c in batch.column("code").to_pylist()])
            vectors = np.concatenate([b[code[:, p]] for p, b in enumerate(shared.value)], axis=1) / SCALE
            yield pa.record_batch([batch.column("vec_id"), pa.array(vectors.tolist(), pa.list_(pa.float64()))], names=["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id bigint, vector array<double>")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """`codes` with label_error, the sum of the errors of a label's rows; nulls are one label."""
    sums = cut(codes.groupBy("label").agg(F.try_sum("error").alias("label_error")))
    return codes.alias("c").join(small(sums).alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")), "left").select("c.*", "s.label_error")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """The codes of `vectors`, with errors, written once to the shared folder, and the codebooks that they refer to."""
    kept = kept_vectors(vectors, parts)
    books = train(kept, parts, entries, rounds)
    return with_label_errors(cut(encode(kept, books))), books
