"""Joins on keys and ranges against what compares all with all."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import catalog, claims, ranks, token_index, typeahead


def alike(c, r):
    return c == r or len(c) >= 4 and len(r) >= 4 and (c[:4] == r[:4] or c in r or r in c)


def test_alike_tokens(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randrange(1, 9)))
    left, right = [word() for _ in range(150)] + ["crash", None, "", "é" * 5], [word() for _ in range(150)] + ["crashes", "gamecrash", "cras", "aéééééb", None, ""]
    frame = lambda tokens: spark.createDataFrame([(t,) for t in tokens], "token string")
    got = [tuple(x) for x in token_index.alike_tokens(frame(left), frame(right)).collect()]
    want = {(c, o) for c in left for o in right if c is not None and o is not None and alike(c, o)}
    assert len(got) == len(set(got)) and set(got) == want
    assert token_index.alike_tokens(frame([]), frame(right)).count() == 0


def test_coverages(spark):
    r = random.Random(2)
    vocabulary = ["crash", "crashing", "crashed", "refund", "funds", "server", "serve", "observer", "abcd", "xabcdx", "gear", "gears"]
    told = [(k, r.sample(vocabulary, r.randrange(0, 6))) for k in range(30)]
    shown = [(k, r.sample(vocabulary, r.randrange(0, 4))) for k in range(20)]
    cited = [(r.randrange(31), r.randrange(22)) for _ in range(80)] * 2
    each, any_ = claims.coverages(spark.createDataFrame(cited, "claim_key int, rid int"), spark.createDataFrame(told, "claim_key int, tokens array<string>"), spark.createDataFrame(shown, "rid int, tokens array<string>"))
    tokens, reviews = dict(told), dict(shown)
    share = lambda own, other: round(sum(any(alike(c, o) for o in other) for c in own) / len(own), 3) if own else 0.0
    assert sorted(tuple(x) for x in each.collect()) == sorted({(c, k, share(tokens[c], reviews[k])) for c, k in cited if c in tokens and k in reviews})
    unions = {c: [t for c2, k in cited if c2 == c and k in reviews for t in reviews[k]] for c in tokens}
    assert dict(tuple(x) for x in any_.collect()) == {c: share(tokens[c], unions[c]) for c in tokens}


# --- ranks


def test_order_statistics(spark):
    r = random.Random(3)
    for values in ([5.0], [1.5, 1.5], [r.gauss(0, 1e6) for _ in range(500)], [0.0] * 300 + [1e-300, -1e300, 7.0], [float(k % 7) for k in range(400)], [-0.1, None, 0.1]):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        known = sorted(v for v in values if v is not None)
        asked = sorted({1, len(known), (len(known) + 1) // 2, max(1, len(known) // 10)})
        assert ranks.order_statistics(df, "v", asked, bins=4, few=3) == {k: known[k - 1] for k in asked}
    with pytest.raises(ValueError):
        ranks.order_statistics(df, "v", [9])


def test_exclusive_quantiles(spark):
    r = random.Random(4)
    for n in (2, 5, 9, 10, 11, 19, 57):
        values = [round(r.uniform(-80, 20), 1) for _ in range(n)]
        got = ranks.exclusive_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0.1, 0.5])
        want = statistics.quantiles(values, n=10)
        assert got[0.1] == pytest.approx(want[0]) and got[0.5] == pytest.approx(statistics.median(values))
    assert ranks.exclusive_quantiles(spark.createDataFrame([(3.0,)], "v double"), "v", [0.1, 0.5]) == {0.1: 3.0, 0.5: 3.0}
    assert ranks.exclusive_quantiles(spark.createDataFrame([], "v double"), "v", [0.1]) == {}


def test_global_ranks_and_running_sums(spark):
    r = random.Random(5)
    rows = [(k, r.randrange(20), r.choice([0, 1, 2])) for k in range(400)]
    dealt = ranks.by_range(spark.createDataFrame(rows, "id int, n int, x int").repartition(6), F.desc("n"), F.asc("id"))
    got = {x.id: (x.rank, x.before) for x in ranks.ranked(ranks.running(dealt, {"before": F.col("x")}, F.desc("n"), F.asc("id")), F.desc("n"), F.asc("id")).collect()}
    total, want = 0, {}
    for place, (k, n, x) in enumerate(sorted(rows, key=lambda t: (-t[1], t[0])), 1):
        want[k] = (place, total)
        total += x
    assert got == want
    none = ranks.by_range(spark.createDataFrame([], "id int, n int, x int"), "id")
    assert ranks.ranked(none, "id").count() == 0


def walk(rows, target, cap, first):
    """The capped walk, one title after the other."""
    live = chosen = 0
    out = []
    for appid, rank, is_live, have, duplicate in sorted(rows, key=lambda x: x[1]):
        if chosen >= target:
            break
        if duplicate:
            out.append((appid, "dropped", None))
        elif have:
            continue
        elif is_live and live >= cap:
            out.append((appid, "skipped", None))
        else:
            out.append((appid, "chosen", 1 if chosen < first else 2))
            chosen += 1
            live += is_live
    return sorted(out)


def test_capped_walk_over_ranges(spark):
    r = random.Random(6)
    rows = [(k, k + 1, r.random() < 0.4, r.random() < 0.2, r.random() < 0.1) for k in range(300)]
    df = spark.createDataFrame(rows, "appid int, rank int, live boolean, have boolean, duplicate boolean").repartition(5)
    for target, cap, first in ((50, 10, 20), (1, 0, 1), (1000, 3, 0)):
        got = catalog.select_capped(df, target, cap, first)
        assert sorted((x.appid, x.outcome, x.night) for x in got.collect()) == walk(rows, target, cap, first)


def test_index_is_verified_against_seeds_and_pairs(spark):
    entries = spark.createDataFrame([(k, f"t{k}", 2000 - 10 * k) for k in range(180)], "appid int, title string, reviews int")
    good = catalog.rank_entries(entries)
    seeds, spots = spark.createDataFrame([(1,), (999,)], "appid int"), spark.createDataFrame([(2, "t2"), (3, "other"), (777, "x"), (5, None)], "appid int, title string")
    found = lambda df: {x.problem: x.n for x in catalog.verify_index(df, entries, seeds, spots).collect() if x.n}
    assert found(good) == {"missing_seeds": 1, "spot_absent": 1, "spot_title": 2}
    swapped = good.withColumn("reviews", F.when(F.col("rank") == 90, 5000).otherwise(F.col("reviews")))
    assert found(swapped)["out_of_order"] == 1
    assert "spot_title" not in {x.problem for x in catalog.verify_index(good, entries).collect()}


# --- typeahead


def test_typeahead_finds_what_a_scan_finds(spark):
    r = random.Random(7)
    words = ["half", "halo", "life", "the", "of", "Ömega", "a", "x2", "life's"]
    titles = [" ".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(120)] + ["!!!", ""]
    rows = [(k, t, k + 1) for k, t in enumerate(titles)]
    entries = spark.createDataFrame(rows, "appid int, title string, rank int")
    queries = sorted({t[:k] for t in titles for k in range(1, len(t) + 1)} | {"alf li", "zzz", "  ", "?", "A", "omega", "e", "fe of", "HALF!  life"})
    got = typeahead.typeahead(entries.repartition(4), spark.createDataFrame([(q,) for q in [*queries, None]], "query string"), 5)
    by = {}
    for x in sorted(got.collect(), key=lambda x: x.place):
        by.setdefault(x.query, []).append((x.title, x.rank, x.tier))
    for q in queries:
        want = [(x.title, x.rank, x.tier) for x in catalog.search(entries, q, 5).collect()] if q in ("HALF!  life", "e", "alf li", "zzz", "  ", "?") else None
        assert want is None or by.get(q, []) == want
    plain = lambda t: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in t.lower().replace("ö", "o")).split())
    for q in queries:
        n, found = plain(q), []
        for _, title, rank in rows:
            t = plain(title)
            if n and n in t:
                at = t.index(n)
                found.append((0 if t == n else 1 if at == 0 else 2 if t[at - 1] == " " else 3, rank, title))
        assert by.get(q, []) == [(title, rank, tier) for tier, rank, title in sorted(found)[:5]]


def test_typeahead_cuts_hits_before_they_are_gathered(spark):
    entries = spark.range(1000).select(F.col("id").alias("appid"), F.lit("the same title").alias("title"), F.col("id").cast("int").alias("rank"))
    got = typeahead.typeahead(entries, spark.createDataFrame([("the",), ("same",)], "query string"), 3)
    assert sorted((x.query, x.appid) for x in got.collect()) == [(q, k) for q in ("same", "the") for k in range(3)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
