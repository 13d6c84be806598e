"""Vector codes, the filter audit and line dedup against brute force, and their defined results for odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from tallyfield.llm import filter_audit, line_dedup, vector_codes
from tests.llm.test_operators import ODD, docs_of, prose

WORD = re.compile("[^\x20\x09-\x0d]+")
INF, NAN = float("inf"), float("nan")


# --- vector codes


def test_tree_finds_the_lowest_index_of_equals():
    r = np.random.default_rng(3)
    for size, spread in ((1, 3), (4, 1), (64, 2), (64, 400), (256, 5), (30, 0)):
        entries = r.integers(-spread, spread + 1, (size, 4))
        at = r.integers(-spread - 2, spread + 3, (3000, 4))
        far = ((at[:, None, :] - entries) ** 2).sum(2)
        found, best = vector_codes.KdTree(entries).nearest(at)
        assert (found == far.argmin(1)).all() and (best == far.min(1)).all()


def brute_codes(rows, parts, entries, rounds):
    def fine(v):
        return bool(v) and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)

    rows = sorted((r for r in rows if fine(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    width = len(rows[0][1]) // parts
    ints = [[max(-(2**27), min(2**27, math.floor(256 * x))) for x in v] for _, v, _ in rows]
    pieces = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[v[p] for v in pieces[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        got = [defaultdict(list) for _ in range(parts)]
        for v in pieces:
            for p in range(parts):
                got[p][nearest(p, v[p])[1]].append(v[p])
        books = [[[sum(c) // len(c) for c in zip(*got[p][i])] if i in got[p] else e for i, e in enumerate(books[p])] for p in range(parts)]
    out = []
    for (k, _, label), v in zip(rows, pieces):
        best = [nearest(p, v[p]) for p in range(parts)]
        out.append((k, label, bytes(i for _, i in best), sum(d for d, _ in best)))
    sums = Counter()
    for _, label, _, error in out:
        sums[label] += error
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return sorted((repr((k, label, code, error, sums[label])) for k, label, code, error in out)), hashlib.sha256(flat.encode()).hexdigest()


def vectors_of(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return df.select("*", *[F.lit(7).alias(c) for c in ("code", "error", "part", "entry", "n", "total", "label_error", "vector", "odd `name`", "a.b")])


def test_vector_codes(spark):
    r = random.Random(5)
    rows = [(k, [float(np.float32(r.choice([r.gauss(0, 1), r.randrange(-2, 3) / 256]))) for _ in range(8)], r.choice([0, 1, None])) for k in range(300)]
    rows += [(k, [0.5] * 8, 3) for k in range(300, 420)]  # one vector very often
    rows += [(0, [0.25] * 8, 1), (0, [-0.25] * 8, 1), (None, [1.0] * 8, 2), (7, [1e30] * 8, 2), (8, [-1e30] + [0.0] * 7, 9)]
    rows += [(-1, None, 1), (-2, [], 1), (-3, [None] + [0.0] * 7, 1), (-4, [NAN] * 8, 1), (-5, [INF] + [0.0] * 7, 1), (-6, [0.0] * 7, 1), (500, [0.0] * 12, 1)]
    r.shuffle(rows)
    for parts, entries, rounds in ((4, 16, 2), (2, 64, 1), (8, 3, 0)):
        codes, books = vector_codes.compress(vectors_of(spark, rows).repartition(5), parts, entries, rounds)
        want, digest = brute_codes(rows, parts, entries, rounds)
        got = codes.collect()
        assert sorted(repr((x.vec_id, x.label, bytes(x.code), x.error, x.label_error)) for x in got) == want
        assert vector_codes.digest(books) == digest


def test_vectors_come_back_as_near_as_their_error_says(spark):
    r = random.Random(6)
    rows = [(k, [r.randrange(-300, 300) / 256 for _ in range(8)], 0) for k in range(200)]
    codes, books = vector_codes.compress(vectors_of(spark, rows), 4, 32, 2)
    error, plain = {x.vec_id: x.error for x in codes.collect()}, {k: v for k, v, _ in rows}
    for x in vector_codes.decode(codes, books).collect():
        assert round(sum((256 * (a - b)) ** 2 for a, b in zip(plain[x.vec_id], x.vector))) == error[x.vec_id]


def test_vector_codes_of_few_or_no_vectors(spark):
    few = [(3, [0.1] * 4, None), (1, [0.2] * 4, 5)]
    codes, books = vector_codes.compress(vectors_of(spark, few), 2, 64, 2)
    assert len(books[0]) == 2 and {(x.vec_id, bytes(x.code), x.error) for x in codes.collect()} == {(1, b"\0\0", 0), (3, b"\1\1", 0)}
    for rows in ([], [(1, None, 1)]):
        codes, books = vector_codes.compress(vectors_of(spark, rows), 2, 64, 2)
        assert codes.count() == 0 and books == []


# --- filter audit


def brute_audit(docs, labels):
    least = {}
    for k, text, _ in docs:
        if k is not None:
            least[text or ""] = min(least.get(text or "", k), k)
    good, toxic = {k for k, q, _ in labels if q == 1}, {k for k, _, t in labels if t == 1}
    parts = defaultdict(list)
    for k, text, source in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = {c for c, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum(c in string.ascii_uppercase for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), k is not None and k > least[t])) if bad}
        parts[source or ""].append((fails, k is not None and k in good, k is not None and k in toxic))
    rows = []
    for part, found in parts.items():
        own, shares = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            alive = list(found)
            for step, c in enumerate(order, 1):
                gone = [x for x in alive if c in x[0]]
                alive = [x for x in alive if c not in x[0]]
                shares[c] += len(gone)
                failing = sum(c in x[0] for x in found)
                own.append((c, (part, order, step, len(alive), len(gone), failing - len(gone), sum(x[0] == {c} for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone))))
        rows += [(*row, shares[c]) for c, row in own]
    return sorted(rows)


def audited_rows():
    texts = [prose(k, 60) for k in range(4)] + ["W" + prose(9, 70), "a b " * 60, "", None, "ABC DEF " * 40, "x | y", prose(11, 80) + " é漢\U0001f600" * 3, "$ " * 100]
    r = random.Random(2)
    docs = [(k, r.choice(texts), r.choice(["s", "s", "t", None, ""])) for k in range(200)]
    docs += [(k, texts[0], "hot") for k in range(200, 320)]
    docs += [(5, texts[1], "s"), (5, texts[2], "t"), (5, texts[2], "t"), (None, texts[0], "s"), (None, texts[0], None), (None, "only here", "u"), *ODD]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 330, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    return docs, labels


def test_filter_audit(spark, monkeypatch):
    docs, labels = audited_rows()
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("mask", F.lit(1))
    want = brute_audit(docs, labels)
    df = docs_of(spark, docs)
    for parts in (1, 7):
        assert sorted(tuple(r) for r in filter_audit.audit(df.repartition(parts), table).collect()) == want
    assert filter_audit.audit(df.limit(0), table).count() == 0
    assert filter_audit.audit(df, table.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def copies(found):
    """(doc_id, mask) of what a task reads, once it is routed."""
    by = defaultdict(list)
    for key, link in found:
        by[key % 3].append((key, link))
    return sorted((k, mask) for part in by.values() for k, _, mask, n in filter_audit._route(iter(part)) for _ in range(n))


def test_audit_tells_texts_of_one_fingerprint_apart(monkeypatch):
    docs, _ = audited_rows()
    docs = [d for d in docs if d[0] is not None]
    rows = [(k, s or "", (t or "").encode(), len(t or "")) for k, t, s in docs]
    want = copies(filter_audit._read(iter(rows)))
    monkeypatch.setattr(filter_audit, "HELD", 1000)  # what a task holds goes on early
    assert copies(filter_audit._read(iter(rows))) == want
    monkeypatch.setattr(filter_audit.xxhash, "xxh64_intdigest", lambda raw: 7)
    assert copies(filter_audit._read(iter(rows))) == want
    least = {}
    for k, t, _ in docs:
        least[t or ""] = min(least.get(t or "", k), k)
    assert Counter(k for k, mask in want if mask & filter_audit.COPY) == Counter(k for k, t, _ in docs if k > least[t or ""])


# --- line dedup


def brute_lines(docs, min_chars=40, min_docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))

    holders = defaultdict(set)
    for k, text, _ in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(k)
    gone = {line: max(ks - {None}) for line, ks in holders.items() if len(line) >= min_chars and len(ks - {None}) >= min_docs}
    rows = []
    for k, text, _ in docs:
        lines = (text or "").split("\n")
        left = [x for x in lines if key(x) not in gone or gone[key(x)] == k]
        rows.append((k, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(rows, key=repr)


def lined_rows():
    r = random.Random(4)
    forty = "x" * 40
    said = [forty, "y" * 39, " " + forty.upper() + "\t\r", "É" * 40, "é" * 40, forty + "\xa0", "\x1c" + forty, "a long line that very many of the documents hold \U0001f600", "", "  ", "Z" * 60]
    docs = [(k, "\n".join(r.choice(said) if r.random() < 0.5 else f"own line {r.random()} of nobody else at all, long enough" for _ in range(r.randrange(1, 9))), "s") for k in range(80)]
    docs += [(k, "only four documents hold this line of some length", "s") for k in range(100, 104)]
    docs += [(k, "five documents hold this other line of some length\n\ntail\n", "s") for k in range(110, 115)]
    docs += [(120, "five rows but one document: a line of some length here", "s")] * 5 + [(None, "only rows without a doc_id hold this line, six times", "s")] * 6
    docs += [(114, "five documents hold this other line of some length\nx", "s"), (None, "FIVE documents hold this other line of some length\nkept", None)]
    docs += [(130, "\n".join(f"line {i % 7} of a very long document that repeats its lines" for i in range(60_000)), "s"), *[(131 + k, "line 3 of a very long document that repeats its lines", "s") for k in range(4)]]
    return [*docs, *ODD]


def test_line_dedup(spark):
    docs = lined_rows()
    got = line_dedup.line_dedup(docs_of(spark, docs).repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_lines(docs)
    got = line_dedup.line_dedup(docs_of(spark, docs), min_chars=1, min_docs=2).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_lines(docs, 1, 2)
    assert line_dedup.line_dedup(docs_of(spark, [])).count() == 0


def test_frequent_lines_beyond_a_broadcast(spark, monkeypatch):
    docs = lined_rows()
    monkeypatch.setattr(line_dedup, "small", lambda df: df)
    got = line_dedup.line_dedup(docs_of(spark, docs)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_lines(docs)


def test_documents_keep_their_columns(spark):
    df = docs_of(spark, lined_rows())
    got = line_dedup.drop_lines(df)
    assert got.columns == df.columns and got.where("text IS NULL").count() == df.where("text IS NULL").count()
    assert Counter(r.text for r in got.collect() if r.text is not None) == Counter(t for (k, _, _, t), r in zip(brute_lines(lined_rows()), range(10**6))) - Counter({"": 1})
    assert dict(got.dtypes) == dict(df.dtypes)
