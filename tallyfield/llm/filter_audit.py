"""Filter interaction audit: what each filter removes in every order of the filters, and what it alone would miss.

Every text gets a mask of the filters that it fails. Copies of a smaller doc_id's text are found over an RDD routed by the
xxhash of the text: each partition keeps, by fingerprint, a chain of full texts with the least doc_id of each, and emits
the ids that aren't the least. A task does the same with what it reads before it sends anything, so of a text that a third
of all rows share one copy per task travels. Masks then meet the labels by doc_id, and combineByKey merges vectors of counts
by mask, one per part and task. All orders are worked out from a part's vector.

The router's partitions are sized by a count of the bytes of all texts, so that a task holds about ROUTED bytes of them.

Defined results: a null text is empty, a null source the part of the empty name; a row without a doc_id isn't a copy and
makes none, and has no label; rows that share doc_id and text aren't copies of each other, and are counted each; a document
is good or toxic if any of its labels says so; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import permutations
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import partitions

#: Bytes of text that a task holds of what it reads, before it sends them on.
HELD = 64 << 20
#: Bytes of text, copies included, that a partition of the router gets on average.
ROUTED = 64 << 20
UPPER, MARKS = bytes(range(65, 91)), b"#$%&*|"


class Text(NamedTuple):
    """What a filter sees of a text: its bytes in UTF-8, its words, their number of distinct ones and its code points."""

    raw: bytes
    words: int
    distinct: int
    chars: int


#: The filters by letter; each tells whether a text fails. Copies are the last filter.
RULES: dict[str, Callable[[Text], bool]] = {
    "A": lambda t: t.words < 50,
    "B": lambda t: 100 * t.distinct < 65 * t.words,
    "C": lambda t: 100 * (len(t.raw) - len(t.raw.translate(None, UPPER))) > 5 * t.chars,
    "D": lambda t: len(t.raw.translate(None, MARKS)) < len(t.raw),
}
COPIES = "E"
LETTERS = "".join(RULES) + COPIES
COPY = 1 << len(RULES)


def mask_of(raw: bytes, chars: int) -> int:
    """A bit for each of RULES that a text fails."""
    words = raw.split()  # bytes split at the white space of ASCII only
    text = Text(raw, len(words), len(set(words)), chars)
    return sum(1 << k for k, fails in enumerate(RULES.values()) if fails(text))


class Chains:
    """Full texts by fingerprint, each with its mask, its least doc_id so far and the rows of that id by source."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}
        self.held = 0

    def add(self, key: int, raw: bytes, mask: int, doc_id: int, rows: Counter) -> tuple[int, Counter] | None:
        """Takes rows of a text; returns the id that turns out not to be the least, with its rows."""
        chain = self.chains.setdefault(key, [])
        for link in chain:
            if link[0] == raw:
                if doc_id > link[2]:
                    return doc_id, rows
                if doc_id == link[2]:
                    link[3] += rows
                    return None
                beaten = link[2], link[3]
                link[2:] = doc_id, rows
                return beaten
        chain.append([raw, mask, doc_id, rows])
        self.held += len(raw)
        return None

    def __iter__(self) -> Iterator[tuple[int, bytes, int, int, Counter]]:
        for key, chain in self.chains.items():
            for link in chain:
                yield key, *link


def _spread(doc_id: int) -> int:
    return xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True))


def _read(rows: Iterator[tuple]) -> Iterator[tuple[int, tuple]]:
    """(key, (text, mask, doc_id, rows)) of the texts that a task reads; the text is None where the mask is final."""
    chains, unnamed = Chains(), Counter()
    for doc_id, source, text, chars in rows:
        raw = bytes(text)
        mask = mask_of(raw, chars)
        if doc_id is None:
            unnamed[mask, source] += 1
            continue
        if beaten := chains.add(xxhash.xxh64_intdigest(raw), raw, mask, doc_id, Counter({source: 1})):
            yield _spread(beaten[0]), (None, mask | COPY, *beaten)
        if chains.held > HELD:
            yield from ((key, tuple(link)) for key, *link in chains)
            chains = Chains()
    yield from ((key, tuple(link)) for key, *link in chains)
    for k, ((mask, source), n) in enumerate(unnamed.items()):
        yield k, (None, mask, None, Counter({source: n}))


def _route(found: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
    """(doc_id, source, mask, n) of the rows of a partition."""
    chains = Chains()
    for key, (raw, mask, doc_id, rows) in found:
        if raw is None:
            yield from ((doc_id, source, mask, n) for source, n in rows.items())
        elif beaten := chains.add(key, raw, mask, doc_id, rows):
            yield from ((beaten[0], source, mask | COPY, n) for source, n in beaten[1].items())
    for _, _, mask, doc_id, rows in chains:
        yield from ((doc_id, source, mask, n) for source, n in rows.items())


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, source, mask and n, the number of such rows, of all documents. Bit k of a mask is the k-th of LETTERS."""
    text = F.coalesce("text", F.lit(""))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), source, text.cast("binary"), F.length(text)).rdd
    held = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    size = max(partitions(docs.sparkSession), -(-held // ROUTED))
    routed = rows.mapPartitions(_read).partitionBy(size, lambda key: key).mapPartitions(_route)
    return docs.sparkSession.createDataFrame(routed, "doc_id bigint, source string, mask int, n bigint", verifySchema=False)


def _start(x: tuple) -> np.ndarray:
    return _add(np.zeros((3, 2 * COPY), np.int64), x)


def _add(counts: np.ndarray, x: tuple) -> np.ndarray:
    mask, n, good, toxic = x
    counts[:, mask] += (n, n * good, n * toxic)
    return counts


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def orders_of(part: str, counts: np.ndarray) -> list[tuple]:
    """The rows of a part: every order of the filters, step by step."""
    n, good, toxic = counts
    fails = [np.arange(2 * COPY) >> k & 1 == 1 for k in range(len(LETTERS))]
    rows, shares = [], Counter()
    for order in permutations(range(len(LETTERS))):
        alive = np.ones(2 * COPY, bool)
        for step, k in enumerate(order, 1):
            gone = alive & fails[k]
            redundant = int(n[fails[k] & ~alive].sum())
            alive = alive & ~fails[k]
            removed = int(n[gone].sum())
            shares[k] += removed
            rows.append((k, ("".join(LETTERS[i] for i in order), step, int(n[alive].sum()), removed, redundant, int(n[1 << k]), int(good[gone].sum()), int(toxic[gone].sum()))))
    return [(part, *row, shares[k]) for k, row in rows]


REPORT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (source), order of the filters and step; `labels` has doc_id, quality and toxic."""
    spark = docs.sparkSession
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("int").alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality"), says("toxic"))
    marked = masks(docs).join(known, "doc_id", "left").select("source", "mask", "n", F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    counts = marked.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(_start, _add, _merge, partitions(spark), lambda part: xxhash.xxh64_intdigest(part.encode()))
    return spark.createDataFrame(counts.flatMap(lambda x: orders_of(*x)), REPORT, verifySchema=False)
