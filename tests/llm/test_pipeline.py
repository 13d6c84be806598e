"""The mixture and the whole pipeline against plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfield.llm import bpe, mixing
from tallyfield.llm.oracles import ORACLES
from tallyfield.llm.queries import VOCABULARY
from tests.llm.test_operators import WORD, brute_near, brute_targets, docs_of, prose


def brute_mix(rows):
    """copies by row of (doc_id, text, source)."""
    size = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    sources = defaultdict(list)
    for i, (_, _, s, *_) in enumerate(rows):
        sources[s].append(i)
    targets = brute_targets({s: sum(size[i] for i in own) for s, own in sources.items()})
    copies = [0] * len(rows)
    for s, own in sources.items():
        words = Counter()
        for i in own:
            words[size[i].bit_length() - 1] += size[i]
        factor = {k: 1048576 // (16 + k) for k in words}
        filled, expected = 0, {}
        for k in sorted(words):
            moved = sum(words[j] * factor[j] for j in words if j >= k)
            if words[k] == 0 or float(moved) * 3 <= (targets[s] - filled) * factor[k]:
                expected[k] = 3.0 if words[k] else 0.0
            filled += words[k] * 3
        taken, open_ = sum(words[k] * 3 for k in expected), sum(words[k] * factor[k] for k in words if k not in expected)
        for k in words:
            if k not in expected:
                expected[k] = min(3.0, max(0.0, targets[s] - taken) * factor[k] / open_)
        due, ranked = targets[s], []
        for i in own:
            e = expected[size[i].bit_length() - 1]
            copies[i] = int(e)
            due -= copies[i] * size[i]
            p = e - int(e)
            if p > 0 and size[i]:
                key = "" if rows[i][0] is None else rows[i][0]
                u = (int(hashlib.md5(f"{mixing.SEED}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranked.append(((u / (1 - u)) / (p / (1 - p)), rows[i][0] is not None, rows[i][0] or 0, size[i], i))
        ranked.sort()
        at = 0
        while at < len(ranked) and ranked[at][3] <= due:
            due -= ranked[at][3]
            copies[ranked[at][4]] += 1
            at += 1
        steps = []
        for change, beside in ((1, ranked[at:]), (-1, ranked[:at][::-1])):
            turns = Counter()
            for *_, n, i in beside:
                k = n.bit_length()
                turns[k] += 1
                if turns[k] <= mixing.NEXT:
                    steps.append((-k, -change, turns[k], n, i))
        for _, change, _, n, i in sorted(steps):
            if abs(due + change * n) < abs(due):
                due += change * n
                copies[i] -= change
    return copies


def corpus(n):
    r = random.Random(8)
    common = "the of and to in is it that was for on are".split()
    rows = []
    for i in range(n):
        w = [r.choice(common) if r.random() < 0.45 else "w" + "".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(r.randrange(55, 400))]
        rows.append((i, " ".join(w), f"src{min(int(r.expovariate(0.5)), 5)}" if i % 13 else None, "en"))
    for i in range(0, n, 5):
        k, t, s, lang = rows[i]
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        rows += [(n + 2 * i, t, s, lang), (n + 2 * i + 1, " ".join(w), "src1", lang)]
    rows += [(5 * n, "### " * 90, "src0", "en"), (5 * n + 1, "short", "src0", "en"), (5 * n + 2, None, None, None), (5 * n + 3, "a b c " * 60, "src2", None)]
    return rows


def test_mixture_against_brute_force(spark):
    rows = [(k, t, s) for k, t, s, _ in corpus(150)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    want = brute_mix(rows)
    assert sorted((str(g.doc_id), g.copies) for g in got) == sorted((str(r[0]), c) for r, c in zip(rows, want))


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = corpus(80)
    schema = "doc_id bigint, text string, source string, lang string"
    spark.createDataFrame(rows, schema).withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    judged = con.execute(f"SELECT doc_id FROM ({ORACLES['op2_quality_divergence']}) WHERE kept").fetchall()
    good = {k for (k,) in judged}
    docs = [r for r in rows if r[0] in good]
    assert 5 * 80 not in good and len(docs) < len(rows) - 3
    last = {t: k for k, t, *_ in sorted(docs)}
    docs = [r for r in docs if last[r[1]] == r[0]]
    near = {k for k, _, _, kept in brute_near(docs) if kept}
    docs = [r for r in docs if r[0] in near]
    mixed = [r for r, c in zip(docs, brute_mix(docs)) for _ in range(c)]
    tokens = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    want = []
    for k, t, *_ in mixed:
        ids = library.encode_ordinary(t)
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)


def test_stages_return_the_columns_of_documents(spark):
    docs = docs_of(spark, [(k, t, s) for k, t, s, _ in corpus(20)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0
