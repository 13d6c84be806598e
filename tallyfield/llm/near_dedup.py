"""Near-dedup of documents by SuperMinHash.

Every element of a document's shingle set gets, step by step, a random rank and a fresh slot of a permutation of its own;
a slot keeps the least of step and rank. A slot filled in an earlier step can't change, so a document stops as soon as
all of its slots are filled: a few steps for long texts. The slots' correlated ranks give signatures of lower variance
than independent hashes.

Documents of equal sets become one class first. Classes meet in bands of ROWS slots; only bands with several classes go
on. In each such band the classes are tied to the most popular of them, the one whose bands are the fullest; ties whose
signatures agree too little to be links are dropped, and the rest make families. In a band that still holds several
families, the classes outside its largest family are compared by signature with all classes of other families, so that
every pair that shares a band is compared or in one family.

A family's full sets then meet in blocks of bounded size, with a few popular classes of the family as guests in all of
its blocks; every link inside a block is found on the sets, and only a spanning forest of the links leaves. Where a
family of several blocks isn't one component yet, the classes outside its largest component visit all other blocks and
are compared there with whatever isn't connected to them. So work beyond one pass over the blocks depends on what stays
unconnected, not on the size of the group. Union by hooking to the neighbour of least hash, round by round, gives the
components without gathering them.

Defined results: null and empty texts have no shingles, are linked with nothing and are their own component; rows with a
null doc_id are their own component, too, and are kept; rows that repeat a doc_id are judged each by their own
text, but texts that have one least doc_id are one document; an empty table gives no rows; very long texts are hashed and sketched a slice at a time, so a text's memory
is that of its words and the hashes of its shingles; other columns are ignored by `near_dedup` and kept by
`drop_near_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import counted, cut, text_mark, without
from tallyfield.llm.word_hashes import WordHashes, rolling

WIDTH = 5
SLOTS, ROWS = 250, 5
BANDS = SLOTS // ROWS
#: A link: LINK[0] * intersection >= LINK[1] * union. Signatures that agree on less than LEAST of their slots, over five
#: standard deviations below that, are no link.
LINK = 100, 75
LEAST = 0.6
#: Elements of a batch of documents, or of a slice of one; elements and classes of a block; guests of a family.
BATCH, BLOCK, MEMBERS, HUBS = 200_000, 2_000_000, 128, 4
#: Edges that one task may join, whatever the input.
FEW = 4_096
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def superminhash(elements: np.ndarray, owner: np.ndarray, sets: int, slots: int = SLOTS) -> np.ndarray:
    """The signatures of `sets` non-empty sets; `owner` is the set of each element. A slot keeps a least value, so slices
    of BATCH elements follow one another, each until no later step can lower a slot."""
    signature = np.full(sets * slots, NONE)
    for at in range(0, len(elements), BATCH):
        _lower(signature, elements[at : at + BATCH], owner[at : at + BATCH], slots)
    return signature.reshape(sets, slots)


def _lower(signature: np.ndarray, elements: np.ndarray, owner: np.ndarray, slots: int) -> None:
    order = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
    with np.errstate(over="ignore"):
        for step in range(slots):
            x = _mix(elements + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            at = step + ((_mix(x) >> np.uint64(32)) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64)
            each = np.arange(len(elements))
            slot = order[each, at]
            order[each, at] = order[:, step]
            place = owner * slots + slot
            free = signature[place] >= np.uint64(step << 52)
            np.minimum.at(signature, place[free], np.uint64(step << 52) | (x[free] >> np.uint64(12)))
            if step < 4 or step % 4 == 0:
                final = (signature.reshape(-1, slots) < np.uint64(step + 1 << 52)).all(axis=1)
                going = ~final[owner]
                if not going.any():
                    return
                if going.sum() < 0.7 * len(going):
                    elements, owner, order = elements[going], owner[going], order[going]


def band_hashes(signature: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.zeros((len(signature), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for row in range(ROWS):
            h = _mix(h ^ signature[:, row::ROWS])
    return h


def shingles(text: bytes, known: WordHashes) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    h = known.of_text(text.lower())
    if 0 < len(h) < WIDTH:
        return rolling(h, len(h)) ^ np.uint64(len(h))
    return np.unique(rolling(h, WIDTH))


SKETCHES = "doc_id bigint, mark bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch binary"
_SKETCHES = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()

    def sent(keys: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [s for s in sets if len(s)]
        owner = np.repeat(np.arange(len(full)), [len(s) for s in full])
        signatures = superminhash(np.concatenate(full), owner, len(full)) if full else np.zeros((0, SLOTS), np.uint64)
        bands = iter(band_hashes(signatures).view(np.int64).tolist())
        short = iter([s.tobytes() for s in (signatures & np.uint64(0xFF)).astype(np.uint8)])
        some = [bool(len(s)) for s in sets]
        columns = [
            *zip(*keys),
            [len(s) for s in sets],
            [xxhash.xxh3_128_digest(s.tobytes()) if k else None for s, k in zip(sets, some)],
            [next(bands) if k else None for k in some],
            [next(short) if k else None for k in some],
        ]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SKETCHES)], schema=_SKETCHES)

    for batch in batches:
        keys, sets, size = [], [], 0
        for *key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            s = shingles(text.as_buffer().to_pybytes(), known)
            keys.append(key)
            sets.append(s)
            size += len(s)
            if size >= BATCH:
                yield sent(keys, sets)
                keys, sets, size = [], [], 0
        if keys:
            yield sent(keys, sets)


def _united(edges: DataFrame) -> DataFrame:
    """node, root of at most FEW edges, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                one, two = top(a), top(b)
                parent[max(one, two)] = min(one, two)
        if parent:
            yield pa.record_batch([pa.array(list(parent), pa.int64()), pa.array([top(x) for x in parent], pa.int64())], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node bigint, root bigint")


def components(edges: DataFrame, ranks: tuple[str, str] | None = None) -> DataFrame:
    """node, root: of each node of the edges (a, b), one node of its component. Each round hooks every node to the
    neighbour of least hash, or itself, and puts the edges between those; it takes about log(nodes) rounds. With `ranks`,
    columns of the edges, the first round hooks to the neighbour of least rank, so that a star becomes one node. The last
    ones, of FEW edges at most, are one task, since each round costs the driver exchanges, however few its edges. The hooks
    are followed from the last round to the first, each round's nodes once."""
    edges, n = counted(edges.where("a != b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), *(ranks or ())))
    least = F.min_by("b", F.struct("rank", F.xxhash64("b"), "b"))
    hooked: list[DataFrame] = []
    while n > FEW:
        rank = dict(zip("ab", map(F.col, ranks))) if ranks and not hooked else dict.fromkeys("ab", F.lit(0))
        ends = [F.struct(F.col(x).alias("a"), F.col(y).alias("b"), rank[y].alias("rank")) for x, y in ("ab", "ba", "aa", "bb")]
        hooks = cut(edges.select(F.inline(F.array(*ends))).groupBy("a").agg(least.alias("to")))
        hooked.append(hooks.select(F.col("a").alias("node"), "to"))
        one = hooks.select(F.col("a").alias("a_from"), F.col("to").alias("a_to"))
        two = hooks.select(F.col("a").alias("b_from"), F.col("to").alias("b_to"))
        moved = edges.join(one, F.col("a") == F.col("a_from")).join(two, F.col("b") == F.col("b_from"))
        edges, n = counted(moved.select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a != b").distinct())
    if n:
        roots = _united(edges.select("a", "b"))
    elif hooked:
        roots = hooked.pop().withColumnRenamed("to", "root")
    else:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for hooks in reversed(hooked):
        after = roots.select(F.col("node").alias("from"), "root")
        roots = hooks.join(after, F.col("to") == F.col("from"), "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots


def _shared(classes: DataFrame) -> DataFrame:
    """class_id, band, popularity: the bands of each class that others have, too, and how many classes its bands hold."""
    rows = classes.select("class_id", F.explode("bands").alias("band"))
    full = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select(F.col("band").alias("full_band"), "n")
    # a class has at most BANDS of them
    shared = rows.join(full, F.col("band") == F.col("full_band")).groupBy("class_id").agg(F.collect_list("band").alias("own"), F.sum("n").alias("popularity"))
    return cut(shared.select("class_id", F.explode("own").alias("band"), "popularity"))


def _ties(shared: DataFrame) -> DataFrame:
    """(a, b, a_rank, b_rank): each class with the most popular of every band that it shares with others. The most popular
    class has the least rank."""
    heads = shared.groupBy("band").agg(F.max(F.struct("popularity", "class_id")).alias("head")).withColumnRenamed("band", "head_band")
    tied = shared.join(heads, F.col("band") == F.col("head_band")).where("class_id != head.class_id")
    return tied.select(F.col("class_id").alias("a"), F.col("head.class_id").alias("b"), (-F.col("popularity")).alias("a_rank"), (-F.col("head.popularity")).alias("b_rank")).distinct()


def _close(ties: DataFrame, classes: DataFrame) -> DataFrame:
    """The ties whose signatures agree on LEAST of the slots or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                one, two = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SLOTS) for c in batch.columns[4:])
                yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "a_rank", "b_rank"]).filter(pa.array((one == two).mean(axis=1) >= LEAST))

    one = classes.select(F.col("class_id").alias("one_id"), F.col("sketch").alias("one"))
    two = classes.select(F.col("class_id").alias("two_id"), F.col("sketch").alias("two"))
    both = ties.join(one, F.col("a") == F.col("one_id")).join(two, F.col("b") == F.col("two_id"))
    return both.select("a", "b", "a_rank", "b_rank", "one", "two").mapInArrow(run, "a bigint, b bigint, a_rank bigint, b_rank bigint")


class Sketches:
    """A block of classes, each with a label; `inside` and `guest` give edges between labels that join what the close pairs
    of different labels join."""

    def __init__(self, labels: list[int], payloads: list[bytes]) -> None:
        self.label = np.array(labels)
        self.rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SLOTS)

    def _join(self, label: int, others: np.ndarray) -> list[tuple[int, int]]:
        edges = [(int(label), k) for k in np.unique(self.label[others]).tolist()]
        for _, k in edges:
            self.label[self.label == k] = label
        return edges

    def _near(self, row: np.ndarray, others: np.ndarray) -> np.ndarray:
        return others[(self.rows[others] == row).mean(axis=1) >= LEAST]

    def inside(self) -> list[tuple[int, int]]:
        edges = []
        for x in range(len(self.label)):
            later = x + 1 + np.flatnonzero(self.label[x + 1 :] != self.label[x])
            if len(later):
                edges += self._join(self.label[x], self._near(self.rows[x], later))
        return edges

    def roots(self) -> list[tuple[int, int]]:
        """(label, root) of the labels that `inside` joins."""
        before = self.label.copy()
        self.inside()
        pairs = np.unique(np.stack((before, self.label), axis=1), axis=0)
        joined = pairs[pairs[:, 0] != pairs[:, 1], 1]
        return [(a, b) for a, b in pairs[np.isin(pairs[:, 1], joined)].tolist()]

    def guest(self, label: int, payload: bytes) -> list[tuple[int, int]]:
        return self._join(label, self._near(np.frombuffer(payload, np.uint8), np.flatnonzero(self.label != label)))


class Sets(Sketches):
    """The same with full sets and exact links, by an inverted index."""

    def __init__(self, labels: list[int], payloads: list[bytes]) -> None:
        self.label = np.array(labels)
        sets = [np.frombuffer(p, np.uint64) for p in payloads]
        self.sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.tokens, token = np.unique(np.concatenate(sets), return_inverse=True)
        self.posting = owner[np.argsort(token, kind="stable")]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(token))))
        self.frequency = np.diff(self.starts)
        self.token, self.offsets = token, np.concatenate(([0], np.cumsum(self.sizes)))

    def _linked(self, tokens: np.ndarray, size: int) -> np.ndarray:
        common = np.zeros(len(self.label), np.int64)
        if len(tokens):
            common = np.bincount(np.concatenate([self.posting[self.starts[t] : self.starts[t + 1]] for t in tokens.tolist()]), minlength=len(self.label))
        return np.flatnonzero(LINK[0] * common >= LINK[1] * (self.sizes + size - common))

    def _compare(self, x: int) -> list[tuple[int, int]]:
        own = self.token[self.offsets[x] : self.offsets[x + 1]]
        others = self._linked(own[self.frequency[own] > 1], self.sizes[x])
        return self._join(self.label[x], others[self.label[others] != self.label[x]])

    def inside(self) -> list[tuple[int, int]]:
        """The most central sets are compared with all others, then those outside the component that is the largest then;
        those inside are connected already."""
        central = np.argsort(-np.add.reduceat(self.frequency[self.token], self.offsets[:-1]) / self.sizes, kind="stable").tolist()
        edges = []
        for x in central[:16]:
            edges += self._compare(x)
        labels, counts = np.unique(self.label, return_counts=True)
        largest = int(np.flatnonzero(self.label == labels[counts.argmax()])[0])
        for x in central[16:]:
            if self.label[x] != self.label[largest]:
                edges += self._compare(x)
        return edges

    def guest(self, label: int, payload: bytes) -> list[tuple[int, int]]:
        own = np.frombuffer(payload, np.uint64)
        at = np.searchsorted(self.tokens, own)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == own]
        others = self._linked(at, len(own))
        return self._join(label, others[self.label[others] != label])


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("whole", pa.bool_())])


def _compared(rows: DataFrame, kind: type, inside: bool = True) -> DataFrame:
    """Edges (a, b, whole) between the labels of the rows (grp, blocks, class_id, label, loose, payload) of a group. Each row belongs to one of
    the group's blocks, loose rows are guests in all the others; a task holds one block and streams its guests. Where a group
    is one block, `whole` is true and b is the root of a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, block = None, [], None

        def opened() -> tuple[object, list[tuple[int, int, bool]]]:
            block = kind(*map(list, zip(*held)))
            whole = current[2]
            return block, [(a, b, whole) for a, b in (block.roots() if whole else block.inside())] if inside and len(held) > 1 else []

        def sent(edges: list[tuple[int, int, bool]]) -> Iterator[pa.RecordBatch]:
            if edges:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*edges), _EDGES)], schema=_EDGES)

        for batch in batches:
            edges: list[tuple[int, int, bool]] = []
            *columns, payloads = batch.columns
            for *place, guest, label, payload in zip(*(c.to_pylist() for c in columns), payloads):
                if place != current:
                    if block is None and held:
                        edges += opened()[1]
                    current, held, block = place, [], None
                if not guest:
                    held.append((label, payload.as_py()))
                    continue
                if block is None and held:
                    block, found = opened()
                    edges += found
                if block is not None:
                    edges += [(a, b, False) for a, b in block.guest(label, payload.as_py())]
            yield from sent(edges)
        if block is None and held:
            yield from sent(opened()[1])

    place = lambda block, guest: F.struct(block.alias("block"), F.lit(guest).alias("guest"))
    own = F.pmod(F.xxhash64("class_id"), F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: b != own)
    places = F.when(F.col("loose") & (F.col("blocks") > 1), F.concat(F.array(place(own, False)), F.transform(others, lambda b: place(b, True)))).otherwise(F.array(place(own, False)))
    placed = rows.select("grp", (F.col("blocks") == 1).alias("whole"), "class_id", "label", "payload", F.explode(places).alias("at"))
    placed = placed.select("grp", "at.block", "whole", "at.guest", "class_id", "label", "payload")
    dealt = placed.repartition("grp", "block").sortWithinPartitions("grp", "block", "guest", "class_id")
    return dealt.drop("class_id").mapInArrow(run, "a bigint, b bigint, whole boolean")


def _joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root after edges between roots, or nodes that have none, are joined, too; only those are gone through again."""
    more = cut(components(edges)).select(F.col("node").alias("more"), F.col("root").alias("to"))
    moved = roots.join(more, F.col("root") == F.col("more"), "left").select("node", F.coalesce("to", "root").alias("root"))
    new = more.join(roots.select("node"), F.col("more") == F.col("node"), "left_anti")
    return moved.unionByName(new.select(F.col("more").alias("node"), F.col("to").alias("root")))


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """`rows` with the component of their class as label; a class without one is its own."""
    return rows.join(roots, F.col("class_id") == F.col("node"), "left").withColumn("label", F.coalesce("root", "class_id")).drop("node", "root")


def _several(rows: DataFrame) -> DataFrame:
    """open_grp, n, main: the groups of rows (grp, label) with several labels, and the label that most rows have."""
    counts = rows.groupBy("grp", "label").agg(F.count("*").alias("k"))
    return counts.groupBy(F.col("grp").alias("open_grp")).agg(F.sum("k").alias("n"), F.count("*").alias("labels"), F.max_by("label", F.struct("k", "label")).alias("main")).where("labels > 1").drop("labels")


def _across(shared: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """Close pairs between the families of a band. A band of two classes has no pair but its tie."""
    named = _labelled(shared.select("class_id", F.col("band").alias("grp")), roots)
    several = _several(named).where("n > 2").select("open_grp", "main", F.ceil(F.col("n") / MEMBERS).cast("long").alias("blocks"))
    sketches = classes.select(F.col("class_id").alias("of"), F.col("sketch").alias("payload"))
    rows = named.join(several, F.col("grp") == F.col("open_grp")).join(sketches, F.col("class_id") == F.col("of"))
    return _compared(rows.withColumn("loose", F.col("label") != F.col("main")), Sketches)


def _members(families: DataFrame, classes: DataFrame, shared: DataFrame) -> DataFrame:
    """grp (the family), blocks, class_id, loose: whether a class is a guest of its family's other blocks."""
    known = families.join(classes.groupBy("class_id").agg(F.sum("size").alias("size")), F.col("node") == F.col("class_id"))
    sizes = known.groupBy(F.col("root").alias("grp")).agg(F.greatest(F.ceil(F.sum("size") / BLOCK), F.ceil(F.count("*") / MEMBERS)).cast("long").alias("blocks"))
    members = families.join(sizes, F.col("root") == F.col("grp")).select("grp", "blocks", F.col("node").alias("class_id"))
    popular = shared.groupBy("class_id").agg(F.max("popularity").alias("popularity")).withColumnRenamed("class_id", "of")
    ranked = members.where("blocks > 1").join(popular, F.col("class_id") == F.col("of"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("popularity"), "class_id"))
    hubs = ranked.withColumn("place", place).where(F.col("place") <= HUBS).select(F.col("class_id").alias("hub"))
    return members.join(hubs, F.col("class_id") == F.col("hub"), "left").select("grp", "blocks", "class_id", F.col("hub").isNotNull().alias("loose"))


def _sets(members: DataFrame, docs: DataFrame) -> DataFrame:
    """`members` with their full sets; a class whose doc_id has several texts has a row for each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            blobs = [shingles(t.as_buffer().to_pybytes(), known).tobytes() for t in batch.column(4)]
            full = pa.record_batch([*batch.columns[:4], pa.array(blobs, pa.binary())], names=["grp", "blocks", "class_id", "loose", "payload"])
            yield full.filter(pa.array([bool(b) for b in blobs], pa.bool_()))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = own.join(members, F.col("doc_id") == F.col("class_id")).select("grp", "blocks", "class_id", "loose", "text")
    return texts.mapInArrow(sets, "grp bigint, blocks bigint, class_id bigint, loose boolean, payload binary")


def _links(sets: DataFrame) -> DataFrame:
    """node, root of the classes that links connect. A family of one block is done by the task that compares it."""
    edges = cut(_compared(sets.withColumn("label", F.col("class_id")), Sets))
    small = edges.where("whole").select(F.col("a").alias("node"), F.col("b").alias("root"))
    large = sets.where("blocks > 1")
    if large.isEmpty():
        return small
    roots = cut(components(edges.where("NOT whole")))
    named = _labelled(large, roots)
    several = _several(named.select("grp", "label")).select("open_grp", "main")
    rest = named.drop("loose").join(several, F.col("grp") == F.col("open_grp")).withColumn("loose", F.col("label") != F.col("main"))
    return small.unionByName(_joined(roots, _compared(rest, Sets, inside=False)))


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), n_shingles, component_id, kept of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    sketches = cut(rows.mapInArrow(_sketch, SKETCHES))
    known = sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"), F.any_value("n_shingles").alias("size"))
    classes = cut(classes)
    shared = _shared(classes)
    roots = cut(components(_close(_ties(shared), classes), ("a_rank", "b_rank")))
    families = cut(_joined(roots, _across(shared, roots, classes)))
    found = cut(_links(cut(_sets(_members(families, classes, shared), docs))))
    least = found.groupBy("root").agg(F.min("node").alias("component_id")).select(F.col("root").alias("least_root"), "component_id")
    linked = found.join(least, F.col("root") == F.col("least_root")).select("node", "component_id")
    named = classes.select(F.col("digest").alias("class_digest"), "class_id").join(linked, F.col("class_id") == F.col("node"), "left")
    named = named.select("class_digest", F.coalesce("component_id", "class_id").alias("component_id"))
    out = sketches.select("doc_id", "mark", "n_shingles", "digest").join(named, F.col("digest") == F.col("class_digest"), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "mark", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that `near_dedup` keeps, with their own columns."""
    return without(docs, near_dedup(docs).where(~F.col("kept")))
