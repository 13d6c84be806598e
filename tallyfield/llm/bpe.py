"""Byte-level BPE by merge replay over a corpus of distinct words.

`replay` holds all words of a chunk in one linked list of nodes and an inverted index from merge rank to the positions
of the pairs that this merge would join. It takes the ranks in ascending order and applies each to every word at once;
a merge touches its two neighbours only. A merge can make a pair of a lower rank; its word then waits until that rank,
pushed back on the heap, is done, so each word sees its merges in the order in which it would alone.

Documents are cut into pieces by the vocabulary's pattern; the pieces of a chunk of documents that are not known yet are
replayed together, and the ids of known ones are kept in a table of bounded size. Memory is bounded by the chunk and
that table, and every partition is independent of the others.

Defined results: null texts count as empty and give no ids; rows that repeat are encoded each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the table of known pieces, characters of a piece that may enter it, characters of a chunk of documents.
KNOWN, KNOWN_CHARS, CHUNK_CHARS = 200_000, 64, 8_000_000
NEVER = 1 << 62


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks; ranks have to be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip())]
    pairs.sort()
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks are not consecutive")
    return [token for _, token in pairs]


class Merges:
    """A vocabulary: tokens by rank, and the rank of the token that a pair of tokens makes."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.rank = rank = {t: i for i, t in enumerate(tokens)}
        self.bytes = np.array([rank[bytes([b])] for b in range(256)])
        made = {
            rank[t[:i]] * len(tokens) + rank[t[i:]]: r
            for r, t in enumerate(tokens)
            for i in range(1, len(t))
            if t[:i] in rank and t[i:] in rank
        }
        self.keys = np.array([-1, *sorted(made)])
        self.made = np.array([NEVER, *(made[k] for k in sorted(made))])

    def pair(self, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        """NEVER where a pair makes no token."""
        keys = a * len(self.tokens) + b
        at = np.searchsorted(self.keys, keys, side="right") - 1
        return np.where(self.keys[at] == keys, self.made[at], NEVER)


def _split(values: np.ndarray, by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The values of each distinct `by`."""
    order = np.argsort(by, kind="stable")
    by = by[order]
    edges = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1])))
    for key, part in zip(by[edges].tolist(), np.split(values[order], edges[1:])):
        yield key, part


def replay(words: Iterable[bytes], merges: Merges) -> list[tuple[int, ...]]:
    """The ids of each word."""
    words = list(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    total = int(sizes.sum())
    if not total:
        return [()] * len(words)
    ends = np.cumsum(sizes)
    ids = merges.bytes[np.frombuffer(b"".join(words), np.uint8)]
    word_of = np.repeat(np.arange(len(words)), sizes)
    after = np.arange(1, total + 1)
    before = np.arange(-1, total - 1)
    after[ends[sizes > 0] - 1] = -1
    before[(ends - sizes)[sizes > 0]] = -1
    rank = np.full(total, NEVER)  # of the pair that starts at a node
    heads = np.flatnonzero(after >= 0)
    rank[heads] = merges.pair(ids[heads], ids[heads + 1])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(places: np.ndarray) -> None:
        places = places[rank[places] != NEVER]
        if len(places):
            for r, some in _split(places, rank[places]):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(some)

    enter(heads)
    while heap:
        r = heapq.heappop(heap)
        p = np.sort(np.concatenate(index.pop(r)))
        p = p[np.concatenate(([True], p[1:] != p[:-1]))]
        p = p[rank[p] == r]
        if not len(p):
            continue
        # of pairs that overlap, as in a run of one letter, every other one from the left
        runs = np.concatenate(([False], after[p[:-1]] == p[1:]))
        rest = p[:0]
        if runs.any():
            start = np.maximum.accumulate(np.where(runs, 0, np.arange(len(p))))
            p = p[(np.arange(len(p)) - start) % 2 == 0]
        several = np.concatenate(([False], word_of[p[1:]] == word_of[p[:-1]]))
        if several.any():
            # where a merge would make a pair of a lower rank, the word's other places wait
            beyond, left = after[after[p]], before[p]
            low = np.zeros(len(p), bool)
            low[beyond >= 0] |= merges.pair(r, ids[beyond[beyond >= 0]]) < r
            low[left >= 0] |= merges.pair(ids[left[left >= 0]], r) < r
            low |= bool(merges.pair(r, np.array([r]))[0] < r)
            held = several & np.isin(word_of[p], word_of[p[low]])
            rest, p = p[held], p[~held]
        q = after[p]
        ids[p], ids[q], rank[q] = r, -1, NEVER
        after[p] = beyond = after[q]
        before[beyond[beyond >= 0]] = p[beyond >= 0]
        rank[p] = NEVER
        left = before[p]
        left = left[left >= 0]
        heads = np.concatenate((p[beyond >= 0], left))
        rank[heads] = merges.pair(ids[heads], ids[after[heads]])
        enter(heads)
        if len(rest):
            enter(rest)
    alive = ids >= 0
    flat = ids[alive].tolist()
    counts = np.cumsum(np.bincount(word_of[alive], minlength=len(words))).tolist()
    return [tuple(flat[a:b]) for a, b in zip([0, *counts], counts)]


#: Fixed ranges: the letters and the other numbers below U+0250, for the shorter pattern of `Pieces`.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"


class Pieces:
    """Cuts texts by `pattern`; those without a character from U+0250 on go through the standard library's faster regular
    expressions, with the classes of letters and numbers spelled out."""

    def __init__(self, pattern: str) -> None:
        self.full = regex.compile(pattern)
        short = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{LETTERS}{NUMBERS}]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]")
        # the two libraries differ on U+001C to U+001F as white space
        self.short = None if "\\p" in short else re.compile(short)
        self.plain = re.compile("[^\x00-\x1b\x20-ɏ]")

    def __call__(self, text: str) -> list[str]:
        if self.short is None or self.plain.search(text):
            return self.full.findall(text)
        return self.short.findall(text)


class Encoder:
    """Encodes chunks of texts; keeps the ids of short pieces between chunks."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.merges = Merges(tokens)
        self.pieces = Pieces(pattern)
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        cut = [self.pieces(t) for t in texts]
        if len(self.known) > KNOWN:
            self.known.clear()
        known = self.known
        new = list({p for ps in cut for p in set(ps).difference(known)})
        ids = dict(zip(new, replay([p.encode("utf-8", "surrogatepass") for p in new], self.merges)))
        long = {p: v for p, v in ids.items() if len(p) > KNOWN_CHARS}
        for p in long:
            del ids[p]
        known.update(ids)
        if long:
            table = {**{p: known[p] for ps in cut for p in ps if p in known}, **long}
        else:
            table = known
        for ps in cut:
            yield list(chain.from_iterable(map(table.__getitem__, ps)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.merges.tokens.__getitem__, ids))


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in lists of about CHUNK_CHARS characters."""
    some: list[str] = []
    chars = 0
    for t in texts:
        if some and chars + len(t) > CHUNK_CHARS:
            yield some
            some, chars = [], 0
        some.append(t)
        chars += len(t)
    if some:
        yield some


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(tokens: list[bytes], mark: str, pattern: str) -> Encoder:
    if (mark, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[mark, pattern] = Encoder(tokens, pattern)
    return _ENCODERS[mark, pattern]


def _per_document(docs: DataFrame, vocabulary: str, pattern: str, row, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """doc_id and what `row(ids, encoder, numerals)` gives for it. The vocabulary, of a fixed size, goes to each executor
    once."""
    tokens = read_ranks(vocabulary)
    mark = hashlib.sha256(b"\n".join(tokens)).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(tokens)
    schema = pa.schema([("doc_id", pa.int64()), *((n, t) for n, t, _ in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, mark, pattern)
        numerals = [str(i) for i in range(len(sent.value))]
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            for some in chunks(texts):
                rows = [row(ids, encoder, numerals) for ids in encoder.encode(some)]
                columns = [pa.array(c, t) for c, (_, t, _) in zip(zip(*rows), fields)]
                yield pa.record_batch([keys.slice(at, len(some)), *columns], schema=schema)
                at += len(some)
        # a worker lives on for other stages: it keeps the vocabulary, not the pieces
        encoder.known.clear()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} {s}" for n, _, s in fields))


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and the ids of its text."""
    return _per_document(docs, vocabulary, pattern, lambda ids, encoder, numerals: (ids,), [("ids", pa.list_(pa.int32()), "array<int>")])


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the bytes that its ids stand for."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join(sent.value[i] for i in ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, content binary")


def _digest_row(ids: list[int], encoder: Encoder, numerals: list[str]) -> tuple[int, str, str]:
    listed = ",".join(map(numerals.__getitem__, ids))
    return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()


def digest(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, the digest of the bytes that the ids decode to."""
    fields = [("n_tokens", pa.int64(), "bigint"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return _per_document(docs, vocabulary, pattern, _digest_row, fields)
