"""Substring dedup by fixed-block anchors.

A window is WINDOW consecutive words. Any two documents that share one share a block of BLOCK words that lies on the
grid of the first of them, since every WINDOW words hold a whole block of the grid. So the non-overlapping blocks of
every document are the index, and all rolling runs of BLOCK words of every document probe it. A run found in two
documents or more, and on the grid in at least one, is an anchor.

Hits are extended to maximal exact repeats: every window that holds an anchor is compared with the windows of the other
documents that do; it goes if it also starts in a document with a smaller doc_id, and the windows that go one after
another make up the maximal repeat.

Documents are dealt into chunks of about CHUNK_CHARS characters by their doc_id, and both comparisons are between chunks:
a chunk sends each of its distinct hashes once, whatever the number of its documents that have it, to the task that owns
the hash's range, and gets back what holds for it. There are as many ranges as chunks, so a task's memory is that of one
chunk or one range, and a passage that a third of all documents share costs an entry for each chunk. Anchors are told by
64-bit hashes cut to 40 bits, which only adds windows to compare; windows are told by two independent 64-bit hashes of
their words.

Defined results: null texts have no words; documents of fewer than WINDOW words stay whole; rows with a null doc_id stay
whole and remove nothing; rows that repeat a doc_id are one document and never remove each other's words; an empty table
gives no rows; very long texts are whole, in one chunk; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import partitions, spread_keys, text_mark
from tallyfield.llm.word_hashes import WordHashes, by_range, pack, rolling, unpack

WINDOW = 50
BLOCK = 25
#: Characters of a chunk of documents on average; low bits that an anchor's hash loses; seed of the second hash.
CHUNK_CHARS = 4_000_000
#: So many chunks are dealt evenly to the partitions by keys chosen for that; more fall evenly enough by chance.
EVEN = 4096
ANCHOR_BITS = np.uint64(24)
SECOND = 1

#: What a chunk and a range send each other: hashes, or a chunk's own documents that take part.
HASHES, OWN = 0, 1
SENT = "part int, chunk int, kind int, blob binary"
_SENT = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
FOUND = "chunk int, kind int, blob binary"
_FOUND = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def _texts(table: pa.Table) -> list[tuple[int | None, bytes]]:
    return [(k, t.as_buffer().to_pybytes()) for k, t in zip(table.column("doc_id").to_pylist(), table.column("text"))]


def _blobs(table: pa.Table, kind: int = HASHES) -> list[bytes]:
    return [b for k, b in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()) if k == kind]


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _anchors(known: WordHashes, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's words and, of texts that have a window, of its runs of BLOCK words."""
    h = known.of_text(text)
    return h, rolling(h, BLOCK) >> ANCHOR_BITS << ANCHOR_BITS if len(h) >= WINDOW else np.zeros(0, np.uint64)


def _chunk_anchors(ranges: Sequence[int]) -> Callable:
    """A chunk's distinct runs of BLOCK words: whether several of its documents have one, and whether one lies on a grid."""

    known = WordHashes()

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        hashes, owners, grid = [], [], []
        ids: dict[int, int] = {}
        for doc_id, text in _texts(docs):
            if doc_id is None:
                continue
            _, h = _anchors(known, text)
            hashes.append(h)
            owners.append(np.full(len(h), ids.setdefault(doc_id, len(ids)), np.int32))
            grid.append(np.arange(len(h)) % BLOCK == 0)
        if not sum(map(len, hashes)):
            return _SENT.empty_table()
        h, d, g = np.concatenate(hashes), np.concatenate(owners), np.concatenate(grid)
        order = np.argsort(h, kind="stable")
        h, d, g = h[order], d[order], g[order]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        several = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
        bits = several.astype(np.uint8) + 2 * np.logical_or.reduceat(g, starts).astype(np.uint8)
        h = h[starts]
        return _table([(ranges[k], key[0].as_py(), HASHES, pack(h[s], bits[s])) for k, s in by_range(h, len(ranges))], _SENT)

    return run


def _returned(chunks: list[int], owner: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """The columns, sorted by the first, of each chunk."""
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    edges = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True]))) if len(owner) else [0]
    return _table([(chunks[owner[a]], HASHES, pack(*(c[order[a:b]] for c in columns))) for a, b in zip(edges[:-1], edges[1:])], _FOUND)


def _shared_anchors(sent: pa.Table) -> pa.Table:
    """To each chunk its hashes that several documents have and a grid has."""
    chunks = sent.column("chunk").to_pylist()
    parts = [unpack(b, np.uint8) for b in _blobs(sent)]
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    h, bits = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h, kind="stable")
    h, bits, owner = h[order], bits[order], owner[order]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    several = (np.diff(np.concatenate((starts, [len(h)]))) > 1) | (np.maximum.reduceat(bits & 1, starts) > 0)
    kept = (several & (np.maximum.reduceat(bits & 2, starts) > 0))[group]
    return _returned(chunks, owner[kept], h[kept])


def _chunk_windows(ranges: Sequence[int]) -> Callable:
    """A chunk's distinct windows that hold an anchor, with the first and the last of its documents that have one."""

    known, second = WordHashes(), WordHashes(SECOND)

    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        blobs = _blobs(found)
        if not blobs or not len(docs):
            return _SENT.empty_table()
        anchors = np.unique(np.concatenate([unpack(b)[0] for b in blobs]))
        held: tuple[list, list, list] = ([], [], [])
        for doc_id, text in _texts(docs):
            if doc_id is None:
                continue
            h, runs = _anchors(known, text)
            hit = _among(runs, anchors)
            if not hit.any():
                continue
            sums = np.concatenate(([0], np.cumsum(hit)))
            starts = np.flatnonzero(sums[WINDOW - BLOCK + 1 :] > sums[: len(h) - WINDOW + 1])
            held[0].append(rolling(h, WINDOW)[starts])
            held[1].append(rolling(second.of_text(text), WINDOW)[starts])
            held[2].append(np.full(len(starts), doc_id))
        if not held[0]:
            return _SENT.empty_table()
        one, two, d = map(np.concatenate, held)
        part = ranges[int(one[0] % np.uint64(len(ranges)))]
        own = (part, key[0].as_py(), OWN, np.unique(d).tobytes())
        order = np.lexsort((d, two, one))
        one, two, d = one[order], two[order], d[order]
        starts = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
        last = d[np.concatenate((starts[1:], [len(d)])) - 1]
        one, two, first = one[starts], two[starts], d[starts]
        return _table([own, *((ranges[k], key[0].as_py(), HASHES, pack(one[s], two[s], first[s], last[s])) for k, s in by_range(one, len(ranges)))], _SENT)

    return run


def _first_documents(sent: pa.Table) -> pa.Table:
    """To each chunk its windows that a document before its last one has, with the first of all that have one, and its own
    documents that take part."""
    kinds = pa.array(np.equal(sent.column("kind").to_numpy(), OWN))
    back, sent = sent.filter(kinds).select(["chunk", "kind", "blob"]), sent.filter(pa.array(np.not_equal(sent.column("kind").to_numpy(), OWN)))
    chunks = sent.column("chunk").to_pylist()
    parts = [unpack(b, np.uint64, np.int64, np.int64) for b in _blobs(sent)]
    if not parts:
        return back
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    one, two, first, last = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((two, one))
    one, two, first, last, owner = one[order], two[order], first[order], last[order], owner[order]
    new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    first = np.minimum.reduceat(first, np.flatnonzero(new))[np.cumsum(new) - 1]
    kept = last > first
    return pa.concat_tables([back, _returned(chunks, owner[kept], one[kept], two[kept], first[kept])])


def _covered(doc_id: int, one: np.ndarray, two: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """Where windows start that a document with a smaller doc_id has, too; `known` has both hashes and that document."""
    low, high = (np.searchsorted(known[0], one, side=side) for side in ("left", "right"))
    gone = np.zeros(len(one), bool)
    while (open_ := low < high).any():
        at = low[open_]
        gone[open_] |= (known[1][at] == two[open_]) & (known[2][at] < doc_id)
        low = low + open_
    return np.flatnonzero(gone)


def _remove(with_text: bool) -> Callable:
    hashes, second = WordHashes(), WordHashes(SECOND)

    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        parts = [unpack(b, np.uint64, np.int64) for b in _blobs(found)]
        taking_part = {k for b in _blobs(found, OWN) for k in np.frombuffer(b, np.int64).tolist()}
        known = None
        if parts:
            known = [np.concatenate(x) for x in zip(*parts)]
            order = np.argsort(known[0], kind="stable")
            known = [x[order] for x in known]
        rows = []
        for doc_id, text in _texts(docs):
            kept = words = text.split()
            if known is not None and doc_id in taking_part:
                one = rolling(hashes.array(words), WINDOW)
                if _among(one, known[0]).any():
                    starts = _covered(doc_id, one, rolling(second.array(words), WINDOW), known)
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + WINDOW, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
            joined = b" ".join(kept)
            rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass") if with_text else None))
        return _table(rows, _KEPT)

    return run


def substring_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, text (the kept words, joined by spaces) of every row.

    The documents are dealt by chunk once; all three steps read that one exchange.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // CHUNK_CHARS))
    spread = F.when(F.col("doc_id").isNull(), text_mark(F.col("text"))).otherwise(F.xxhash64("doc_id"))
    if chunks <= EVEN:
        keys = spread_keys(chunks, partitions(docs.sparkSession))
        chunk = F.element_at(F.array(*map(F.lit, keys)), (F.pmod(spread, F.lit(chunks)) + 1).cast("int"))
    else:
        keys, chunk = range(chunks), F.pmod(spread, F.lit(chunks)).cast("int")
    rows = rows.withColumn("chunk", chunk)
    by_chunk = rows.groupBy("chunk")
    anchors = by_chunk.applyInArrow(_chunk_anchors(keys), SENT).groupBy("part").applyInArrow(_shared_anchors, FOUND)
    windows = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(_chunk_windows(keys), SENT)
    repeats = windows.groupBy("part").applyInArrow(_first_documents, FOUND)
    out = by_chunk.cogroup(repeats.groupBy("chunk")).applyInArrow(_remove(with_text), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, text string")
    return out if with_text else out.drop("text")
