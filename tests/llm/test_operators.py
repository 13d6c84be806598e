"""The operators against brute force, and their defined results for odd rows."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyfield.llm import bpe, chat, exact_dedup, licences, mixing, near_dedup, quality, substring_dedup, toxicity, urls, word_hashes
from tallyfield.llm.common import spread_keys, table
from tallyfield.llm.queries import QUERIES, VOCABULARY

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [(1, None, None), (2, "", "s"), (3, "one two", "s"), (3, "one two", "s"), (None, "no id here", None), (4, "\U0001f600 é ß漢字 \x00\t\n", "t"), (5, "w " * 30_000, "s"), (6, "w " * 30_000, "s")]


def docs_of(spark, rows):
    """Documents with columns whose names the operators use inside."""
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string, lang string")
    extra = ("kept", "digest", "size", "hits", "node", "copies", "gone_id", "gone_mark", "mixed_id", "copy", "mark", "rid", "band", "class_id", "target", "words", "key", "odd `name`", "a.b")
    return df.select("*", *[F.lit(7).alias(c) for c in extra])


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- chat formatting


def test_chat_reads_back(spark):
    said = ["</s>[INST] ok [/INST]", "\\a \\\\ <s> <<SYS>><</SYS>>", "", None, "<<ROLE>>x<</ROLE>>y<</TURN>>", "plain"]
    rows = [(1, i, role, text) for i, (role, text) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "tool"], said))]
    rows += [(2, 0, "assistant", "first"), (3, 0, "user", "a"), (3, 0, "user", "a"), (None, 1, "user", "n"), (4, 0, None, "<s>\n"), (4, None, "we<<ird>>", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("segment", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    groups = defaultdict(list)
    for c, turn, role, text in rows:
        groups[c].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        all_ = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(all_.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got[1].valid and not got[2].valid and not got[3].valid
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_text_holds_no_control_string():
    codec = chat.Codec(chat.Template())
    for text in ("</s>[INST] ok [/INST]", "\\\\<s>\\a", "<<SYS><<SYS>>>"):
        escaped = codec.escape(text)
        assert codec.restore(escaped) == text
        assert not any(c in escaped for c in chat.Template().controls)


# --- quality rules


def brute_quality(text):
    t = text or ""
    w = WORD.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {k for k, n in Counter(tri).items() if n > 1}
    covered = {i + j for i, k in enumerate(tri) if k in again for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_guards(spark):
    rows = [*ODD, (7, "a b c a b c d\nx\nx\n \n", "s"), (8, prose(1, 300), "s"), (9, "the of and to " * 40, "s"), (10, "### $$$ %%% " * 60, "s")]
    got = quality.judge(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    known = {(k, brute_quality(t)) for k, t, _ in rows}
    for r in got:
        assert (r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) in known
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judge(docs_of(spark, [])).count() == 0
    assert quality.keep_good(docs_of(spark, rows)).columns == docs_of(spark, []).columns


def test_quality_rejects_what_lies_far_from_every_language(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    got = quality.judge(docs).where("not base_failed").join(labels, "doc_id").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert all(good) and sum(bad) < 0.25 * len(bad)


def test_quality_leaves_languages_without_a_reference_alone(spark):
    english = "the of and to in is it that was for are on " * 20
    rows = [(1, english, "en"), (2, prose(5, 300), "it"), (3, prose(5, 300), "en"), (4, prose(5, 300), None), (5, prose(5, 300), "de")]
    rows = [(k, " ".join(w + f" u{k}x{i}" for i, w in enumerate(t.split())), lang) for k, t, lang in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.doc_id: r.kept for r in quality.judge(docs.where("doc_id < 5")).collect() if not r.base_failed}[2]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(docs.where("doc_id in (1, 2, 4)")).collect()}
    assert got[1] == (False, True) and got[2] == (False, True) and got[4] == (False, False)


# --- mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 3 * sizes[s]}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
        if not full:
            return target | {s: share * weight[s] for s in open_}
    return target


def test_mixing(spark):
    r = random.Random(5)
    rows = [(i, prose(i, int(r.lognormvariate(4, 1))), f"src{min(int(r.expovariate(0.4)), 7)}" if i % 9 else None) for i in range(600)]
    rows += [(601, None, "src1"), (602, "", "src1"), (3, "again here", "src2"), (None, "some words of none", "src2")]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for g in got:
        assert g.source_size == sizes[g.source] and abs(g.target - want[g.source]) < 1e-6
        assert g.taken == g.copies * g.size and 0 <= g.copies <= 3
        taken[g.source] += g.taken
        largest[g.source] = max(largest[g.source], g.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, 0.02 * want[s])
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    mixed = mixing.repeat_documents(docs)
    assert mixed.columns == docs.columns
    copies = Counter()
    for g in got:
        copies[g.doc_id] = max(copies[g.doc_id], g.copies)
    times = Counter(r[0] for r in rows)
    assert Counter(x[0] for x in rows_of(mixed.select("doc_id"))) == Counter({k: copies[k] * n for k, n in times.items() if copies[k]})
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert mixing.mix(docs_of(spark, ODD)).count() == len(ODD)


# --- licences


def test_licences(spark):
    apache = (
        'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n'
        "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\n"
        'distributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n'
    )
    rows = [
        *ODD,
        (20, "Prose first.\n" + apache + "More prose.", "s"),
        (21, "Released under the MIT License.\nCopyright (c) 2020 A\nLicensed under CC BY-NC 4.0.", "s"),
        (22, "you may not use this file except in compliance with the License.", "s"),
        (23, "The licence of poets is licensed under nothing. All rights reserved!", "s"),
    ]
    got = {r.doc_id: (r.identifiers, r.licences, r.n_sentences, r.n_loose) for r in licences.scan(docs_of(spark, rows)).collect()}
    assert got[20] == ("apache-name,apache-use,apache-copy,apache-warranty", "Apache-2.0", 4, 0)
    assert got[21] == ("mit-name,copyright,cc-by-nc", "CC-BY-NC-4.0,MIT", 3, 0)
    assert got[22] == ("apache-use", "", 1, 1)
    assert got[23] == ("reserved", "all-rights-reserved", 1, 0)
    assert got[1] == got[2] == got[5] == ("", "", 0, 0)
    assert licences.scan(docs_of(spark, [])).count() == 0


def test_licence_tables():
    names = [*licences.SENTENCES]
    for name, texts in licences.SENTENCES.items():
        for t in texts:
            assert licences.identifiers(t.upper() + ".") == [name]
    assert all(n in names for _, sequence in licences.RULES for n in sequence)


def brute_licences(text):
    """Characters one by one; sentences by their words among all known ones; rules by their whole list."""
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    space, sentences, part, i = " \t\n\x0b\x0c\r", [], "", 0
    while i < len(t):
        j = i
        while j < len(t) and t[j] in ".;:!?":
            j += 1
        blank = i
        while blank < len(t) and t[blank] in space:
            blank += 1
        if j > i and (j == len(t) or t[j] in space):
            sentences.append(part)
            part, i = "", j
        elif t[i] == "\n" and t[i:blank].count("\n") > 1:
            sentences.append(part)
            part, i = "", blank
        else:
            part, i = part + t[i : max(j, i + 1)], max(j, i + 1)

    def name(x):
        plain = " ".join(filter(None, (w.strip(".") for w in re.sub("[^a-z0-9.]", " ", x).split(" "))))
        for k, texts in licences.SENTENCES.items():
            if plain in texts:
                return k
        return "copyright" if "\n" not in x.strip(space) and re.match("copyright (c )?([0-9]{4}|the )", plain) else None

    names = [n for x in [*sentences, part] for n in ([name(x)] if name(x) else map(name, re.split("[\n\r]+", x))) if n]
    rest, found, loose = [n for n in names if n != "copyright"], set(), 0
    while rest:
        rule = next((r for r in licences.RULES if rest[: len(r[1])] == r[1]), None)
        loose += rule is None
        found |= {rule[0]} if rule else set()
        rest = rest[len(rule[1]) if rule else 1 :]
    return ",".join(names), ",".join(sorted(found)), len(names), loose


def test_licences_against_brute_force(spark):
    r = random.Random(12)
    known = [t for texts in licences.SENTENCES.values() for t in texts]
    joints = [".", "\n", ". ", ".\n", "\n\n", "\n \t\n", "; ", "\r\n", " ", "...", ": ", "\x0b", "!?\n", "\x01", "\x85"]
    rows = []
    for i in range(400):
        parts = []
        for _ in range(r.randrange(9)):
            sentence = r.choice([*known, "Copyright (c) 2020 Some One", "copyright the authors", prose(r.randrange(99), 8)])
            words = [w.upper() if r.random() < 0.1 else w for w in sentence.split()]
            parts += ["".join(w + r.choice([" ", " ", " ", "\n", ", ", "  "]) for w in words).strip(), r.choice(joints)]
        rows.append((i, "".join(parts), "s"))
    got = {x.doc_id: (x.identifiers, x.licences, x.n_sentences, x.n_loose) for x in licences.scan(docs_of(spark, rows)).collect()}
    assert got == {k: brute_licences(t) for k, t, _ in rows}
    assert sum(bool(v[1]) for v in got.values()) > 100


def test_licence_sentences_of_any_length_and_over_line_ends():
    notice = licences.SENTENCES["mit-notice"][0]
    assert licences.identifiers(notice.replace(" ", " " * 5000)) == ["mit-notice"]
    assert licences.identifiers("This is free and unencumbered software released into the public\ndomain.") == ["unlicense"]
    assert licences.identifiers("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.") == ["mpl-name"]


def test_licences_find_every_line_of_the_test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only"}
    got = {r.doc_id: r.licences for r in licences.scan(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        want = {v for k, v in lines.items() if k in r.text.split("\n")} | ({"all-rights-reserved"} if "All rights reserved." in r.text else set())
        assert got[r.doc_id] == ",".join(sorted(want))


# --- substring dedup


def brute_substrings(rows):
    words = [(k, WORD.findall(t or "")) for k, t, *_ in rows]
    first = {}
    for k, w in words:
        if k is not None:
            for i in range(len(w) - 49):
                key = tuple(w[i : i + 50])
                first[key] = min(first.get(key, k), k)
    out = []
    for k, w in words:
        gone = {p for i in range(len(w) - 49) if k is not None and first[tuple(w[i : i + 50])] < k for p in range(i, i + 50)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substrings_against_brute_force(spark):
    r = random.Random(3)
    passages = [prose(1000 + i, r.randrange(45, 130)) for i in range(6)]
    rows = [(i, " ".join([prose(i, r.randrange(0, 90)), r.choice(passages), prose(i + 500, r.randrange(0, 90)), r.choice([*passages, ""])]), "s") for i in range(60)]
    rows += [(100, rows[3][1], "s"), (100, rows[3][1], "s"), (None, passages[0], "s"), (101, "the " * 200, "s"), (102, "the " * 200, "s"), *ODD[:5]]
    got = substring_dedup.substring_dedup(docs_of(spark, rows))
    assert sorted(rows_of(got), key=str) == brute_substrings(rows)
    assert substring_dedup.substring_dedup(docs_of(spark, [])).count() == 0


def test_substrings_in_many_chunks_with_hashes_that_collide(spark, monkeypatch):
    """One hash for all words leaves the telling apart to the other; a passage that all documents share is in all chunks."""
    passage = prose(70, 80)
    rows = [(i, " ".join([prose(i, 30), passage, prose(i + 900, 60)]), "s") for i in range(90)]
    monkeypatch.setattr(substring_dedup, "CHUNK_CHARS", 3000)
    assert sorted(rows_of(substring_dedup.substring_dedup(docs_of(spark, rows))), key=str) == brute_substrings(rows)

    class Colliding(word_hashes.WordHashes):
        def __missing__(self, word):
            return super().__missing__(word if self.seed else b"same")

    with monkeypatch.context() as m:
        m.setattr(substring_dedup, "WordHashes", Colliding)
        run = [substring_dedup._chunk_anchors([5, 3]), substring_dedup._chunk_windows([5, 3]), substring_dedup._remove(False)]
        docs = pa.table({"doc_id": [k for k, *_ in rows[:30]], "text": [t for _, t, *_ in rows[:30]]})
        key = (pa.scalar(0),)
        found = [substring_dedup._shared_anchors(t) for t in by_part(run[0](key, docs))]
        firsts = [substring_dedup._first_documents(t) for t in by_part(run[1](key, docs, pa.concat_tables(found)))]
        out = run[2](key, docs, pa.concat_tables(firsts)).drop_columns("text")
    assert sorted((tuple(r.values()) for r in out.to_pylist()), key=str) == brute_substrings(rows[:30])


def test_keys_are_dealt_evenly(spark):
    for n, parts in ((1, 7), (7, 7), (50, 7), (30, 211)):
        keys = spark.createDataFrame([(k,) for k in spread_keys(n, parts)], "part int").repartition(parts, "part")
        counts = [r["count"] for r in keys.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == n and max(counts) == -(-n // parts)


def by_part(sent):
    return [sent.filter(pa.compute.equal(sent.column("part"), k)) for k in set(sent.column("part").to_pylist())]


# --- toxicity


def test_deobfuscation(spark):
    model = toxicity.CharModel(toxicity.trigram_counts(table(spark, "/root/testdata/sf0.01", "documents")))
    for seen, word in {"1d10t": "idiot", "m.o.r.o.n": "moron", "l0s3r": "loser", "tr4sh": "trash", "cl0wnnnn": "clown", "stupid$$$": "stupid", "the!!": "the", "words": "words"}.items():
        assert toxicity.restore(toxicity.core_of(seen), model) == word
    found = [toxicity.hidden_words(r, {"scum": 0.9}) for r in toxicity.spaced_runs("what s c u m here and " + "x y z w " * 30 + "s c u m", model)]
    assert found and all(f == {"scum"} for f in found)
    assert toxicity.restore("4532-1111", model) == ""


def test_overlong_words_are_decoded(spark):
    model = toxicity.CharModel(toxicity.trigram_counts(spark.createDataFrame([("you idiot " * 90,)], "text string")))
    for token in ("1" * 50 + "d" * 50 + "1" * 30 + "0" * 30 + "t" * 40, "id" + "-" * 60 + "iot", "i" + "_-" * 40 + "diot", ".".join("idiot" * 30)):
        words, runs = toxicity.words_in(token, model)
        assert "idiot" in {w for w, _ in words} or any(toxicity.hidden_words(r, {"idiot": 0.9}) for r in runs), token
    assert toxicity.decode("x" + "ab" * 20_000, model).startswith("xab")


def test_viterbi_against_all_paths():
    r = random.Random(9)
    counts = np.array([r.randrange(50) for _ in range(27**3)])
    model = toxicity.CharModel(counts)

    def paths(token, i, a, b, spent, made):
        if i == len(token):
            yield spent + model.cost[a][b][toxicity.EDGE], made
            return
        x = token[i]
        stands = ([(x, 0.0)] if x in toxicity.LETTERS else []) + [(c, toxicity.V_FOR_U if x == "v" else toxicity.SWAP) for c in toxicity.STANDS_FOR.get(x, "")]
        for c, channel in stands:
            k = ord(c) - 97
            yield from paths(token, i + 1, b, k, spent + channel + model.cost[a][b][k], made + c)
        again = i > 0 and token[i - 1] == x
        triple = again and (token[i + 1 : i + 2] == x or i > 1 and token[i - 2] == x)
        if x in toxicity.SEPARATORS or not stands:
            yield from paths(token, i + 1, a, b, spent + (toxicity.DROP_SIGN if stands else toxicity.DROP), made)
        elif again and made:
            yield from paths(token, i + 1, a, b, spent + (toxicity.DROP if triple else toxicity.UNDOUBLE) + 1.0, made)

    for _ in range(300):
        token = "".join(r.choice("abiotv1!0@$.-_é") * r.choice([1, 1, 1, 2, 3]) for _ in range(r.randrange(1, 6)))
        best = min(paths(token, 0, toxicity.EDGE, toxicity.EDGE, 0.0, ""))
        assert toxicity.decode(token, model) == best[1], token


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    scores = [(r.score, r.toxic) for r in got]
    clean = sorted(s for s, t in scores if not t)
    wins = [(bisect.bisect_left(clean, s) + bisect.bisect_right(clean, s)) / 2 for s, t in scores if t]
    positive = len(wins)
    assert sum(wins) / (positive * len(clean)) > 0.8
    flagged = [t for s, t in scores if s >= toxicity.THRESHOLD]
    assert sum(flagged) > 0.9 * len(flagged) and sum(flagged) > 0.6 * positive


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(docs_of(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    many = [(i % 40, f"you are a {'scum' if i % 2 else 'friend'} number{i % 7}", "s") for i in range(400)]
    labels40 = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
    again = [sorted(rows_of(toxicity.toxicity(docs_of(spark, x), labels40)), key=str) for x in (many, many[::-1])]
    assert again[0] == again[1]
    assert toxicity.toxicity(docs_of(spark, []), labels.limit(0)).count() == 0


# --- near-dedup


def brute_shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_near(rows):
    sets = [(k, brute_shingles(t)) for k, t, *_ in rows]
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((k, len(s), None if k is None else find(k), k is None or find(k) == k) for k, s in sets), key=str)


def near_of(docs):
    return sorted(rows_of(near_dedup.near_dedup(docs).drop("mark")), key=str)


def near_rows():
    r = random.Random(11)
    rows = []
    for family in range(8):
        base = prose(family, r.randrange(20, 160), 5000).split()
        for _ in range(14):
            w = [x if r.random() > r.choice([0, 0.01, 0.03, 0.06]) else f"n{r.randrange(10**6)}" for x in base]
            rows.append((len(rows), " ".join(w), "s"))
    return rows


def test_near_copies_against_brute_force(spark):
    rows = [*near_rows(), (900, "One  TWO\tthree", "s"), (901, "one two three", "s"), (902, "one two", "s"), (1003, None, "s"), (1002, "", "s"), (1001, " \n", "s"), (None, "no id", "s"), (None, "no id", "s"), (5, near_rows()[5][1], "s")]
    assert near_of(docs_of(spark, rows)) == brute_near(rows)
    assert near_dedup.near_dedup(docs_of(spark, [])).count() == 0
    assert near_dedup.drop_near_copies(docs_of(spark, rows)).columns == docs_of(spark, []).columns


def test_near_copies_in_blocks(spark, monkeypatch):
    rows = near_rows()
    monkeypatch.setattr(near_dedup, "BLOCK", 300)
    assert near_of(docs_of(spark, rows)) == brute_near(rows)
    monkeypatch.setattr(near_dedup, "MEMBERS", 3)
    monkeypatch.setattr(near_dedup, "HUBS", 0)
    assert near_of(docs_of(spark, rows)) == brute_near(rows)


def test_near_copies_in_a_crowd_of_middling_similarity(spark):
    """Documents that share a long passage, and planted pairs among them."""
    r = random.Random(8)
    rows, planted = [], []
    for i in range(1500):
        passage, own = prose(77, 120, 5000).split(), prose(5000 + i, r.randrange(40, 90), 10**6).split()
        rows.append((len(rows), " ".join(passage + own), "s"))
        if i % 10 == 0:
            own[r.randrange(len(own))] = "changed"
            planted.append(rows[-1][0])
            rows.append((len(rows), " ".join(passage + own), "s"))
    sets = {k: brute_shingles(t) for k, t, _ in rows[:40]}
    apart = [len(a & b) / len(a | b) for i, a in sets.items() for j, b in sets.items() if j > i + 1]
    assert 0.25 < min(apart) and max(apart) < 0.75
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs_of(spark, rows)).collect()}
    assert all(got[k] == got[k + 1] == k for k in planted) and len(set(got.values())) == 1500


def test_texts_that_share_a_doc_id_are_judged_each(spark):
    rows = [(1, prose(1, 60), "s"), (5, prose(1, 60), "s"), (5, prose(2, 60), "s"), (7, prose(2, 60), "s"), (9, prose(3, 60), "s"), (9, prose(4, 60), "s"), (None, prose(9, 60), "s"), (None, prose(9, 60), "s")]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(docs_of(spark, rows)).collect()}
    assert got == {(1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False), (9, 9, True), (None, None, True)}
    kept = near_dedup.drop_near_copies(docs_of(spark, rows))
    assert sorted(x[0] or 0 for x in rows_of(kept.select("doc_id"))) == [0, 0, 1, 5, 9, 9]


def test_signatures_of_slices_are_those_of_the_whole(monkeypatch):
    elements = np.random.default_rng(3).integers(0, 2**63, 5000).astype(np.uint64)
    owner = np.repeat([0, 1, 2], [10, 4000, 990])
    whole = near_dedup.superminhash(elements, owner, 3)
    monkeypatch.setattr(near_dedup, "BATCH", 170)
    assert (near_dedup.superminhash(elements, owner, 3) == whole).all()


def test_hashes_of_long_texts(monkeypatch):
    text = " \t".join(f"word{i}" for i in range(500)).encode() + b"\n "
    whole = word_hashes.WordHashes().of_text(text)
    monkeypatch.setattr(word_hashes, "PIECE", 37)
    assert len(whole) == 500 and (word_hashes.WordHashes().of_text(text) == whole).all()


def test_near_copies_in_a_crowded_bucket(spark, monkeypatch):
    """Pairs whose buckets are filled, and headed, by heavier edits of the same text."""

    def one_bucket(batches):
        for batch in near_dedup._sketch(batches):
            bands = pa.array([None if b is None else [1] for b in batch.column("bands").to_pylist()], batch.schema.field("bands").type)
            yield batch.set_column(batch.schema.get_field_index("bands"), batch.schema.field("bands"), bands)

    r = random.Random(5)
    base, rows = prose(1, 150, 5000).split(), []
    for _ in range(30):
        heavy = [x if r.random() > 0.12 else f"n{r.randrange(10**6)}" for x in base]
        light = heavy[:70] + ["changed"] + heavy[71:]
        rows += [(len(rows), " ".join(heavy), "s"), (len(rows) + 1, " ".join(light), "s")]
    want = brute_near(rows)
    assert Counter(kept for *_, kept in want) == {True: 30, False: 30}
    monkeypatch.setattr(near_dedup, "_sketch", one_bucket)
    for members in (1000, 7):
        monkeypatch.setattr(near_dedup, "MEMBERS", members)
        assert near_of(docs_of(spark, rows)) == want


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    one = r.integers(0, 2**63, 400).astype(np.uint64)
    two = np.concatenate((one[:300], r.integers(0, 2**63, 100).astype(np.uint64)))
    tiny = one[:3]
    s = near_dedup.superminhash(np.concatenate((one, two, tiny)), np.repeat([0, 1, 2], [400, 400, 3]), 3)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.1
    assert (s != near_dedup.NONE).all()
    assert (near_dedup.superminhash(tiny, np.zeros(3, int), 1)[0] == s[2]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 9), (9, 5), (7, 7), (3, 2)]
    got = dict(rows_of(near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    groups = defaultdict(set)
    for node, root in got.items():
        groups[root].add(node)
    assert sorted(map(sorted, groups.values())) == [[1, 5, 9], [2, 3], list(range(100, 161))]


# --- exact dedup


def test_exact_copies(spark):
    rows = [*ODD, (9, "one two", "s"), (8, "One two", "s"), (7, "one two ", "s")]
    got = sorted(rows_of(exact_dedup.exact_dedup(docs_of(spark, rows)).drop("mark")), key=str)
    groups = defaultdict(list)
    for k, t, _ in rows:
        groups[t or ""].append(k)
    want = []
    for k, t, _ in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        want.append((k, keep, len(own), k == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0


def test_index_inserts_and_deletes(spark):
    def frame(rows):
        return spark.createDataFrame(rows, "doc_id bigint, text string")

    def state(index):
        return {bytes(r.digest): (r.keep_id, r.group_size) for r in index.collect()}

    before = [(1, "a"), (2, "a"), (3, "b"), (None, "c"), (7, "c"), (8, "d"), (8, "d"), (None, "e")]
    came, went = [(4, "x"), (5, "b"), (9, "y"), (6, "a")], [(2, "a"), (7, "c"), (8, "d"), (3, "b"), (99, "never"), (98, "b"), (None, "e"), (9, "y")]
    after = Counter(before + came) - Counter(went)
    index = exact_dedup.build_index(frame(before))
    live = frame(list(after.elements()))
    now = exact_dedup.update_index(index, frame(came), frame(went), live)
    assert state(now) == state(exact_dedup.build_index(live))
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    assert state(now) == {sha("a"): (6, 2), sha("b"): (5, 1), sha("c"): (None, 1), sha("d"): (8, 1), sha("x"): (4, 1)}
    again = exact_dedup.update_index(now, frame([]), frame([(6, "a"), (1, "a")]), live.where("text <> 'a'"))
    assert sha("a") not in state(again) and len(state(again)) == 4


def test_dropping_copies_leaves_one_of_each_text(spark):
    rows = [(1, "a", "s"), (2, "a", "s"), (2, "a", "t"), (3, "b", "s"), (None, "b", "s"), (None, "c", "s"), (None, "c", "u"), (None, "d", "s"), (5, None, "s"), (4, "", "s"), (5, "e", "s")]
    docs = docs_of(spark, rows).withColumnRenamed("band", "own_id")
    for order in (docs, docs.repartition(3)):
        kept = exact_dedup.drop_copies(order)
        assert kept.columns == docs.columns
        got = sorted((r.text or "", r.doc_id or 0) for r in kept.collect())
        assert got == [("", 5), ("a", 2), ("b", 3), ("c", 0), ("d", 0), ("e", 5)]


def test_cuckoo_filter_resizes_and_forgets():
    index = exact_dedup.LiveDigests(2)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, d in enumerate(digests):
        index.insert(d, i, 1)
    assert index.resized and all(index.get(d) == [i, 1] for i, d in enumerate(digests))
    assert all(index.delete(d) for d in digests[:1500]) and not index.delete(digests[0])
    assert all(index.get(d) is None for d in digests[:1500]) and all(index.get(d) for d in digests[1500:])


# --- byte-level BPE


@pytest.fixture(scope="module")
def reference():
    tokens = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_tokens_match_the_library(spark, reference):
    r = random.Random(2)
    letters = "abc  \n'stredlvm019²½é漢字ß😀\t\x1c\x85\xa0!?*"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(300)] + ["a" * 5000, " " * 3000 + "x", "<|endoftext|>", "ab" * 4000]
    rows = [*ODD, *[(100 + i, t, "s") for i, t in enumerate(texts)]]
    path = public_tokenizers.path(VOCABULARY)
    got = bpe.digest(docs_of(spark, rows), path, public_tokenizers.PATTERN)
    want = []
    for k, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(rows_of(got), key=str) == sorted(want, key=str)
    encoded = bpe.encode(docs_of(spark, rows), path, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, bytes(r.content)) for r in bpe.decode(encoded, path).collect()) == Counter((k, (t or "").encode()) for k, t, _ in rows)
    assert bpe.digest(docs_of(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_replay_waits_for_lower_ranks():
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab", b"aa", b"aab"]
    merges = bpe.Merges(tokens)

    def alone(word):
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            ranks = [(merges.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)]
            rank, i = min(ranks)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return tuple(merges.rank[p] for p in parts)

    r = random.Random(4)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 14))).encode() for _ in range(400)] + [b""]
    assert bpe.replay(words, merges) == [alone(w) for w in words]


# --- URL filters


def test_urls(spark):
    rows = [(1, "http://A.example.COM/en/1?x"), (2, "https://www.example.com/en/a#t"), (3, "http://x.net/es/7"), (4, "http://net/fr/"), (5, "http://y.net/de/9"), (6, None), (7, "no url"), (8, "http://b.org"), (9, "http://b.org?q=/en/"), (9, "http://b.org?q=/en/"), (10, "ftp://example.com/en"), (11, "http://notexample.com/en/1")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, host string, rule int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, spark.createDataFrame([], "page_id bigint, bad boolean")).collect()}
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[3] == ("x.net", "/es/7", "net/es/", "block") and got[4] == ("net", "/fr/", "net/fr/", "block")
    assert got[5][2:] == (None, "allow") and got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("b.org", "", None, "allow") and got[9] == ("b.org", "", None, "allow")
    assert got[10] == ("example.com", "/en", "com/", "allow") and got[11][2:] == ("com/", "allow")
    assert urls.judge_urls(pages.limit(0), spark.createDataFrame([], "page_id bigint, bad boolean")).count() == 0


def test_url_templates_against_labels(spark):
    bad = [(i, f"http://h.org/spam/item{i % 7}x/{i}", True) for i in range(40)]
    good = [(100 + i, f"http://h.org/news/{['a', 'b'][i % 2]}/{i}", False) for i in range(40)]
    many = [(200 + i, f"http://h.org/u/{chr(97 + i % 26)}{chr(97 + i // 26)}name/page", i % 2 == 0) for i in range(100)]
    rows = bad + good + many
    pages = spark.createDataFrame([(k, u) for k, u, _ in rows], "page_id bigint, url string")
    labels = spark.createDataFrame([(k, b) for k, _, b in rows if k % 3], "page_id bigint, bad boolean")
    got = {r.page_id: (r.template, r.verdict) for r in urls.judge_urls(pages, labels).collect()}
    assert all(got[k][1] == "block" for k, _, _ in bad) and all(got[k] == ("/news/a|b/*", "allow") for k, _, _ in good)
    assert {got[k][0] for k, _, _ in many} == {"/u/*/page"}


def brute_templates(rows, bad_of):
    """template and verdict by (host, path) of the urls, as plain loops over one host's tree at a time."""
    routes, places = defaultdict(lambda: [0, 0, 0]), {}
    for k, url in rows:
        rest = url.split("://", 1)[1]
        host, path = re.match("([^/?#]*)([^?#]*)", rest).groups()
        parts = []
        for seg in filter(None, path.split("/")):
            stem, ending = re.fullmatch(r"(.*?)(\.[A-Za-z]{1,5})?", seg).groups()
            wild = re.search("^[0-9]+$|^[0-9a-fA-F-]{8,}$|[0-9].*[0-9].*[0-9]", stem) or len(stem) > 32
            parts.append("*" + (ending or "") if wild else seg)
        places[k] = key = (host.lower(), tuple(parts))
        counts = routes[key]
        counts[0] += 1
        counts[1] += k in bad_of
        counts[2] += bad_of.get(k, False)
    labelled, bad = (sum(v[i] for v in routes.values()) for i in (1, 2))
    prior = bad / max(labelled, 1)
    prefix = dict.fromkeys(routes, "")
    for depth in range(max(len(parts) for _, parts in routes)):
        nodes = defaultdict(lambda: [0, 0, 0])
        for (host, parts), v in routes.items():
            if depth < len(parts):
                node = nodes[host, prefix[host, parts], parts[depth]]
                for i in range(3):
                    node[i] += v[i]
        name = {}
        for host, at in {n[:2] for n in nodes}:
            children = {n[2]: v for n, v in nodes.items() if n[:2] == (host, at)}
            whole, tested = sum(v[0] for v in children.values()), []
            for seg, (n, m, b) in children.items():
                if seg.startswith("*") or len(children) > urls.FANOUT and n < urls.FREQUENT * whole:
                    name[host, at, seg] = "*"
                elif m < urls.MIN_LABELS:
                    name[host, at, seg] = seg
                else:
                    tested.append(((b + urls.STRENGTH * prior) / (m + urls.STRENGTH), seg, m, b))
            groups = []
            for _, seg, m, b in sorted(tested):
                if groups:
                    m0, b0 = (sum(x[i] for x in groups[-1]) for i in (1, 2))
                    share = (b + b0) / (m + m0)
                if groups and not abs(b / m - b0 / m0) > urls.MOST_Z * (share * (1 - share) * (1 / m + 1 / m0)) ** 0.5:
                    groups[-1].append((seg, m, b))
                else:
                    groups.append([(seg, m, b)])
            for g in groups:
                for seg, _, _ in g:
                    name[host, at, seg] = "|".join(sorted(x for x, _, _ in g))
        prefix = {(h, p): at + "/" + name[h, at, p[depth]] if depth < len(p) else at for (h, p), at in prefix.items()}
    sums = defaultdict(lambda: [0, 0])
    for (h, p), v in routes.items():
        sums[h, prefix[h, p]][0] += v[1]
        sums[h, prefix[h, p]][1] += v[2]
    share = {t: (b + urls.STRENGTH * prior) / (m + urls.STRENGTH) for t, (m, b) in sums.items()}
    return {k: (prefix[r], "block" if share[r[0], prefix[r]] >= urls.REJECT else "allow") for k, r in places.items()}


def test_url_branches_are_compared_with_all_of_a_branch(spark):
    """Small steps from a clean to a bad child, none of which tells neighbours apart."""
    rows, bad_of = [], {}
    for step in range(11):
        for i in range(40):
            rows.append((len(rows), f"http://h.test/{'abcdefghijk'[step]}kind/x"))
            bad_of[len(rows) - 1] = i < 4 * step
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    got = urls.judge_urls(pages, spark.createDataFrame(list(bad_of.items()), "page_id bigint, bad boolean"), rules=[])
    found = {x.page_id: (x.template, x.verdict) for x in got.collect()}
    assert found == brute_templates(rows, bad_of)
    assert found[0][1] == "allow" and found[len(rows) - 1][1] == "block" and len({t for t, _ in found.values()}) > 2


def test_url_templates_against_brute_force(spark):
    r = random.Random(6)
    rows, bad_of = [], {}
    for i in range(1500):
        host = r.choice(["one.test", "two.test", "Three.test"])
        first = r.choice(["en", "fr", "shop", "tag", "w" + "abcdefghijklmnopqrstuvwxyz"[r.randrange(26)] + "q"])
        second = r.choice([str(r.randrange(9999)), f"item{r.randrange(3)}", "deadbeef01", f"{r.randrange(99)}.html", ""])
        deep = r.choice(["", "", "/x", "/a" * r.randrange(4), "/a/b/c/d/e/f/g/h/i/j/k/l/m/n/" + r.choice("op"), "/" + "long" * 500])
        rows.append((i, f"http://{host}/{first}/{second}{deep}{r.choice(['', '?a=1', '#t'])}"))
        if r.random() < 0.6:
            bad_of[i] = r.random() < {"en": 0.1, "fr": 0.15, "shop": 0.9}.get(first, 0.5)
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    got = urls.judge_urls(pages, spark.createDataFrame(list(bad_of.items()), "page_id bigint, bad boolean"), rules=[])
    assert {x.page_id: (x.template, x.verdict) for x in got.collect()} == brute_templates(rows, bad_of)


# --- all


def test_queries_run_on_the_smallest_tables(spark):
    for name, query in QUERIES.items():
        df = query(spark, SMALL)
        count = df.count()
        source = "pages" if name.startswith("op10") else "conversations" if name.startswith("op1_") else "documents"
        rows = table(spark, SMALL, source)
        assert count == (rows.select("conv_id").distinct().count() + 1 if source == "conversations" else rows.count()), name


def test_few_edges_are_joined_in_one_task(spark, monkeypatch):
    """The same components by rounds, by one task, and by rounds that end in one task; the latter two in fewer jobs."""
    chain = [(7 * k % 601, 7 * (k + 1) % 601) for k in range(400)] + [(1000 + k, 1000) for k in range(1, 50)] + [(-5, 2**62), (3000, 3000)]
    edges, jobs, found = spark.createDataFrame(chain, "a bigint, b bigint").repartition(4), [], []
    for few in (0, 60, 4_096):
        monkeypatch.setattr(near_dedup, "FEW", few)
        spark.sparkContext.setJobGroup(f"few-{few}", "components")
        groups = defaultdict(set)
        for node, root in rows_of(near_dedup.components(edges)):
            groups[root].add(node)
        assert all(root in nodes for root, nodes in groups.items())
        found.append(sorted(map(sorted, groups.values())))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"few-{few}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1] == found[2] and len(found[0]) == 3
    assert 0 < jobs[2] < jobs[1] < jobs[0]


def test_near_dedup_of_many_edges_takes_few_jobs(spark, monkeypatch):
    """Each job costs the driver memory. Stars are one round of the search, rows are counted as they are written, and
    families of one block are joined where they are compared."""
    monkeypatch.setattr(near_dedup, "FEW", 0)
    rows, jobs = near_rows(), []
    for members in (1000, 5):
        monkeypatch.setattr(near_dedup, "MEMBERS", members)
        spark.sparkContext.setJobGroup(f"many-{members}", "near_dedup")
        got = near_of(docs_of(spark, rows))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"many-{members}")))
        assert got == brute_near(rows)
    assert jobs[0] < 95 and jobs[1] < 147, jobs
