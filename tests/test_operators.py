"""Boundary rows of the review engine's operators."""

from __future__ import annotations

import math
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield import config as C
from tallyfield.functions import rates as R
from tallyfield.functions import text as X
from tallyfield.operators import admission, audits, catalog, claims, documents, evals, filtering, ledger, pool, publish, sourcing, verdict
from tallyfield.sources import files
from tallyfield.streaming import limits


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_verdict_words(spark):
    got = values(spark, R.verdict_word(F.col("m")), [(89.0,), (88.9,), (64.0,), (63.9,), (None,)], "m double")
    assert got == ["Buy", "Wait", "Wait", "Skip", None]


def test_buckets(spark):
    got = values(spark, R.bucket_of(F.col("m")), [(0,), (119,), (120,), (1199,), (1200,), (5999,), (6000,), (-1,)], "m int")
    assert got == ["refund_window", "refund_window", "early", "early", "mid", "mid", "veteran", "unknown"]


def test_pool_mean_weights_and_floor(spark):
    rows = [("a", "early", 800, 82.0), ("a", "mid", 800, 83.0), ("a", "veteran", 40, 99.0), ("b", "veteran", 29, 50.0), ("b", "mid", 30, 90.0), ("c", "refund_window", 900, 10.0)]
    df = spark.createDataFrame(rows, "game string, bucket string, pool_n long, pct_positive double")
    got = {r.game: r for r in verdict.post_refund_mean(df).collect()}
    assert 82 < got["a"].mean_pct < 84 and got["a"].word == "Wait"
    assert (got["b"].mean_pct, got["b"].word) == (90.0, "Buy") and (got["c"].mean_pct, got["c"].word) == (None, None)


@pytest.mark.parametrize(
    ("k", "n", "pct", "want"),
    [(0, 2, 97.1, 0.029**2), (0, 0, 50.0, None), (3, 5, 100.0, 0.0), (5, 5, 100.0, 1.0), (2, 5, 0.0, 1.0), (3, 9, 40.0, sum(math.comb(9, i) * 0.4**i * 0.6 ** (9 - i) for i in range(4)))],
)
def test_binomial(spark, k, n, pct, want):
    got = values(spark, R.binomial_tail(F.col("k"), F.col("n"), F.col("p") / 100), [(k, n, pct)], "k long, n long, p double")[0]
    assert got == want if want is None else math.isclose(got, want, abs_tol=1e-12)


def test_alpha_lies_between_the_two_rates(spark):
    got = values(spark, R.binomial_tail(F.col("k"), F.col("n"), F.col("p") / 100), [(0, 7, 76.0), (0, 7, 75.0)], "k long, n long, p double")
    assert got[0] < C.ALPHA < got[1]


def test_sourcing_counts_reviewers_once(spark):
    cited = spark.createDataFrame([("g", "mid", r, True) for r in (1, 2, 3, 4)] * 3 + [("h", "mid", r, True) for r in range(5)], "game string, bucket string, rid long, voted_up boolean")
    rates = spark.createDataFrame([("g", "mid", 90.0), ("h", "mid", 90.0)], "game string, bucket string, pct_positive double")
    got = {r.game: (r.cited_reviews, r.triggers, r.level) for r in sourcing.sourcing(cited, rates).collect()}
    assert got == {"g": (4, "thin", "escalated"), "h": (5, "", "baseline")}


def test_tokens(spark):
    hit = lambda a, b: values(spark, F.size(X.fuzzy_hits(X.tokens(F.col("a")), X.tokens(F.col("b")))), [(a, b)], "a string, b string")[0]
    assert hit("beaten", "beat") == 1 and hit("punish", "punishing") == 1 and hit("tutorial", "economy") == 0


def test_grounding_names_what_fails(spark):
    reviews = spark.createDataFrame([(1, "mid", "The tutorial crashes often"), (2, "mid", "crashes in tutorial every session"), (3, "early", "crashes in the tutorial"), (4, "mid", "lovely music")], "rid long, bucket string, text string")
    rows = [(1, "Tutorial crashes", [1, 2]), (2, "Tutorial crashes", [1, 2, 99]), (3, "Tutorial crashes", [1, 2, 3]), (4, "Economy collapses", [1, 2]), (5, "Tutorial crashes", [1, 4]), (6, "Most players see tutorial crashes", [1, 2])]
    df = spark.createDataFrame([(k, c, "mid", ids) for k, c, ids in rows], "claim_key long, claim string, bucket string, ids array<long>")
    got = {r.claim_key: r.failures for r in claims.ground(df, reviews).collect()}
    assert got[1] == "" and got[2] == "ids_not_in_corpus:99" and got[3] == "cited_outside_bucket:3"
    assert got[4] == "low_union_coverage;only_0_supporting_citations" and got[5] == "only_1_supporting_citations" and got[6] == "prevalence_language:quantifier over people"


def test_prevalence_phrases(spark):
    fine = ["the most polished game", "most fun in years", "occasional crashes", "widely praised"]
    bad = ["most players", "40% of reviews", "3 out of 5", "two in three", "many users", "half of the players", "a vast number", "unanimous praise", "numerous bugs"]
    got = values(spark, F.size(X.prevalence(F.col("t"))), [(t,) for t in fine + bad], "t string")
    assert got[: len(fine)] == [0] * len(fine) and all(got[len(fine) :])


def test_bare_digits(spark):
    assert values(spark, X.has_bare_digit(F.col("t")), [("runs on Windows 11",), ("20 hours",), ("needs RTX 4090 and 3 fans",), (None,)], "t string") == [False, True, True, False]


def test_classify_takes_the_first_rule(spark):
    rows = [
        ("♥♥♥ scum", 0, 0), ("you sc0m, sc0000um and more words", 0, 0), ("what a sssscum of a game this is", 0, 0), ("five words make it long", 1, 2),
        ("too short", 0, 0), ("#### #### #### #### #### #### a b c", 0, 0), ("a a a a a a a a a b", 0, 0), ("this is a perfectly normal review", 5, 2), (None, 0, 0), ("scumble is another word entirely", 0, 0),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rid long, text string, votes_up long, votes_funny long")
    got = [r.reason for r in filtering.classify(df, ["scum"], ["normal"]).orderBy("rid").collect()]
    assert got == ["heart_density", None, "blocked_term", "joke_review", "low_information", "low_information", "low_information", None, "low_information", None]


def test_quota_sample_is_a_round_robin(spark):
    rows = [("g", i, "early" if i % 3 else "veteran", "R" if i % 2 else "A", i) for i in range(60)]
    df = spark.createDataFrame(rows, "game string, rid long, bucket string, primary string, seq long")
    got = sorted(r.rid for r in pool.quota_sample(df, 30, 10, ["R", "A"]).collect())

    def turn(queues, limit):
        queues, taken = [q for q in queues if q], []
        while queues and len(taken) < limit:
            for q in queues:
                if len(taken) < limit:
                    taken.append(q.pop(0))
            queues = [q for q in queues if q]
        return taken, [x for q in queues for x in q]

    chosen, left = [], []
    for bucket in C.BUCKET_NAMES:
        queues = [[i for _, i, b, p, _ in rows if b == bucket and p == f] for f in ("R", "A")]
        took, rest = turn(queues, 10)
        chosen += took
        left.append(rest)
    assert got == sorted((chosen + turn(left, 30 - len(chosen))[0]))[:30]


def test_shapes(spark):
    rows = [([50.0, 88.0, 85.0, 66.0],), ([90.0, 60.0, 91.0],), ([50.0, 52.0, 51.0],), ([10.0, 40.0],), ([90.0, 40.0],), ([90.0, 50.0, 60.0, 40.0],)]
    assert values(spark, verdict.shape_of(F.col("p")), rows, "p array<double>") == ["rise_then_fall", "fall_then_rise", "flat", "monotonic_increase", "monotonic_decrease", "mixed"]


def test_thin_segmentation(spark):
    def game(name, refund, early, veteran):
        return [(name, "refund_window")] * refund + [(name, "early")] * early + [(name, "veteran")] * veteran

    rows = game("ok", 20, 40, 45) + game("old", 20, 20, 134) + game("one", 5, 19, 30)
    got = {r.game: r.thin for r in pool.cohort_structure(spark.createDataFrame(rows, "game string, bucket string")).collect()}
    assert got == {"ok": False, "old": True, "one": True}


def test_header_rules(spark):
    schema = "tagline string, for_you_if array<string>, not_for_you_if array<string>, word string"
    good = ("A sharp puzzle box", ["you like puzzles", "you like quiet"], ["you want action", "you hate reading"], "Buy")
    rows = [good, ("You should skip it", *good[1:]), ("Suits those willing to tolerate a launcher", *good[1:]), ("", *good[1:]), (good[0], ["one."], ["One", "two"], "Skip"), ("Played by 20 friends", *good[1:]), (good[0], ["buy it anyway", "fine"], good[2], "Skip")]
    got = [r.failures for r in verdict.check_header(spark.createDataFrame(rows, schema)).collect()]
    assert got[0] == [] and got[1] == ["tagline_contradicts_verdict"] and got[2] == ["tagline_frames_friction_as_a_condition"] and got[3] == ["missing_tagline"]
    assert got[4] == ["for_you_if_out_of_bounds:1", "duplicate_fit_clause"] and got[5] == ["digit_in_prose:tagline"] and got[6] == ["fit_list_contradicts_verdict:for_you_if"]


def test_publish_and_prune(spark):
    day = lambda n: datetime(2026, 8, n)
    branch = spark.createDataFrame([("older", day(1)), ("newer", day(9)), ("same", day(5)), ("absent", day(5)), ("torn", None), ("undated", day(1)), ("unread", day(1))], "key string, generated timestamp")
    main = spark.createDataFrame([*[(k, day(5)) for k in ("older", "newer", "same", "torn", "undated")], ("unread", None)], "key string, generated timestamp")
    take = {"older": False, "newer": True, "same": False, "absent": True, "torn": False, "undated": False, "unread": True}
    assert {r.key: r.take for r in publish.select_publishable(branch, main).collect()} == take
    seen = spark.createDataFrame([("older", day(8)), ("older", day(9)), *[(k, day(1)) for k in ("newer", "same", "absent", "torn", "unread")]], "key string, ts timestamp")
    why = {"older": "inside_deploy_window", "newer": "publishable:newer", "same": "same", "absent": "publishable:absent", "torn": "unreadable", "undated": "no_promotion_date", "unread": "publishable:absent"}
    at = lambda *x: {r.key: (r.prune, r.keep_because) for r in publish.prune(branch, main, seen, F.lit(datetime(*x)).cast("timestamp")).collect()}
    assert at(2026, 8, 9, 23) == {k: (False, v) for k, v in why.items()}
    assert at(2026, 8, 10) == {k: (False, v) for k, v in why.items()} | {"older": (True, None)}  # ties stay for good


def test_shapes_and_their_sentences(spark):
    from tallyfield.operators import serving
    from tallyfield.operators.documents import cohort_label

    seen = {"bent": [50.0, 88.0, 85.0, 66.0], "dip": [80.0, 40.0, 40.0, 90.0], "up": [10.0, 20.0, 30.0, 40.5], "near": [50.0, 60.0, 55.0, 52.0]}
    rows = [(g, b, 40 + k, p) for g, ps in seen.items() for k, (b, p) in enumerate(zip(C.BUCKET_NAMES, ps))] + [("bent", "unknown", 99, 1.0), ("dip", "x", 99, 1.0)]
    found = verdict.cohort_divergence(spark.createDataFrame(rows, "game string, bucket string, pool_n int, pct_positive double"))
    got = {r.game: (r["shape"], r.low_cohort, r.high_cohort, r.peak_cohort, r.after_peak_cohort, r.drop_after_peak_pts, r.trough_cohort) for r in found.collect()}
    assert got == {
        "bent": ("rise_then_fall", "refund_window", "early", "early", "veteran", 22.0, None),
        "dip": ("fall_then_rise", "early", "veteran", None, None, None, "early"),
        "up": ("monotonic_increase", "refund_window", "veteran", None, None, None, None),
    }
    lines = {r.game: r.line for r in serving.describe_divergence(found, cohort_label).collect()}
    assert lines["bent"].endswith("100h+ 66.0% (pool_n 43); peaks at 2-20h and falls 22.0 pts to 100h+") and lines["dip"].endswith("; troughs at 2-20h") and lines["up"].endswith("40.5% (pool_n 43)")


def test_problem_lines_and_prompts(spark):
    from tallyfield.operators import review_tools as tools

    rows = [(1, "Most say so.", "prevalence_language:most;only_1_supporting_citations"), (2, "fine", ""), (3, "x", "ids_not_in_corpus:9;new_code:1")]
    lines = {r.claim_key: r.line for r in tools.problem_lines(spark.createDataFrame(rows, "claim_key int, claim string, failures string")).collect()}
    assert lines == {1: '- "Most say so."\n    problem: it says how many people think so (most); too few of the cited reviews mention it', 3: '- "x"\n    problem: it cites reviews that do not exist; new_code:1'}
    sample = spark.createDataFrame([("g {game}", "early", 1, 0, 3.0, True, "a {reviews}  b")], "game string, bucket string, rid int, seq int, hours double, voted_up boolean, text string")
    got = claims.build_prompts(sample, "About {cohort_label}.", "{game} ({cohort_range}):\n{reviews}").first()
    assert (got.system, got.user) == ("About 2-20h.", "g {game} (2-20 hours played):\n[1] (3.0h, recommends) a {reviews} b")


def test_a_stage_that_raises_stops_its_title_only(spark):
    def fetch(appid):
        if appid % 5 == 0:
            raise KeyError(appid)
        return "no_reviews" if appid % 7 == 0 else None

    titles = spark.createDataFrame([(k,) for k in range(1, 36)], "appid bigint")
    stages = [("fetch", admission.per_title(fetch)), ("check", admission.per_title(lambda appid: None if appid != 3 else 1 / 0))]
    got = {r.appid: r.outcome for r in admission.run_stages(titles, stages).collect()}
    assert got == {k: "crashed:KeyError" if k % 5 == 0 else "no_reviews" if k % 7 == 0 else "crashed:ZeroDivisionError" if k == 3 else "ok" for k in range(1, 36)}


def test_pacific_days(spark):
    times = [("2026-08-02 06:59:00",), ("2026-08-02 07:00:00",), ("2026-01-15 07:59:00",), ("2026-01-15 08:00:00",)]
    assert values(spark, R.pacific_day(F.col("t").cast("timestamp")), times, "t string") == ["2026-08-01", "2026-08-02", "2026-01-14", "2026-01-15"]


def test_balance(spark):
    rows = lambda up, n, game="g", bucket="mid": [(game, bucket, i < up) for i in range(n)]
    schema = "game string, bucket string, voted_up boolean"
    # "h" lacks one cited review, so its cohorts don't count either; unknown cohorts count for nothing
    available = rows(16, 20) + rows(9, 30, bucket="unknown") + rows(5, 40, "h") + rows(3, 19, "i", "early") + rows(0, 9, "i", "unknown") + rows(5, 10, "k", "early") + rows(5, 10, "k", "mid")
    cited = rows(2, 10) + rows(0, 20, bucket="unknown") + rows(5, 9, "h") + rows(1, 30, "i", "early") + rows(4, 4, "k", "early") + rows(0, 6, "k", "mid") + [("k", "unknown", None)]
    got = {(r.game, r.bucket): (r.available_pct, r.cited_pct, r.delta) for r in sourcing.claim_balance(spark.createDataFrame(available, schema), spark.createDataFrame(cited, schema)).collect()}
    assert got == {("g", "mid"): (80.0, 20.0, -60.0), ("g", "all"): (80.0, 20.0, -60.0), ("k", "all"): (50.0, 40.0, -10.0), ("k", "mid"): (50.0, 0.0, -50.0)}


def test_ledgers(spark):
    got = values(spark, R.ledger_for(F.col("m"), F.col("a")), [("flash-lite", "batch"), ("flash", "live"), ("x", None), ("x", "live")], "m string, a string")
    assert got == ["batch", "flash", "batch", "live"]
    rows = spark.createDataFrame([("a", 13, 9), ("b", 13, 14), ("c", 13, None), ("d", 0, 1)], "day string, used int, actual int")
    assert {r.day: r.effective for r in ledger.effective_used(rows).collect()} == {"a": 9, "b": 14, "c": 13, "d": 0}


def test_trailing_window_leaves_out_its_lower_end(spark):
    rows = [(i, "l", datetime(2026, 1, 1, 23, 59, 30 + i) if i < 30 else datetime(2026, 1, 2, 0, 0, i)) for i in (0, 1, 29, 30, 31)]
    got = {r.id: r.in_window for r in ledger.trailing(spark.createDataFrame(rows, "id long, ledger string, ts timestamp"), 60).collect()}
    assert got == {0: 1, 1: 2, 29: 3, 30: 3, 31: 3}


def test_limiter_feeds_back():
    stamps, waits = [], []
    for at in (0.0, 1.0, 2.0, 3.0, 100.0):
        stamps, wait = limits.reserve(stamps, at, 2)
        waits.append(wait)
    assert waits == [0.0, 0.0, 58.0, 58.0, 20.0]


def test_search_tiers(spark):
    titles = ["Half", "Half-Life", "Black Half", "Behalf half", "Other", "Hâlf"]
    df = spark.createDataFrame([(i, t, 100 - i) for i, t in enumerate(titles)], "appid long, title string, reviews int")
    got = [(r.title, r.tier) for r in catalog.search(catalog.rank_entries(df), " HALF! ").collect()]
    assert got == [("Half", 0), ("Hâlf", 0), ("Half-Life", 1), ("Black Half", 2), ("Behalf half", 3)]


def test_capped_selection_stops(spark):
    rows = [(i, i, live, have, dup) for i, (live, have, dup) in enumerate([(1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0), (1, 0, 0), (0, 0, 0)], 1)]
    df = spark.createDataFrame(rows, "appid long, rank long, live int, have int, duplicate int").selectExpr("appid", "rank", "live = 1 AS live", "have = 1 AS have", "duplicate = 1 AS duplicate")
    got = {r.appid: (r.outcome, r.night) for r in catalog.select_capped(df, 2, 1, 1).collect()}
    assert got == {1: ("chosen", 1), 2: ("skipped", None), 4: ("dropped", None), 5: ("chosen", 2)}


def test_scores(spark):
    got = values(spark, evals.derive_score(F.col("f"), F.col("p")), [(2, 0), (1, 5), (0, 2), (0, 1), (0, 0)], "f int, p int")
    assert got == [2, 1, 1, 0, 0]


def test_merge_keeps_the_better_cited(spark):
    rows = [("g", 1, "tutorial crashes constantly", 2), ("g", 2, "crashes during tutorial", 3), ("g", 3, "music sounds lovely", 2), ("g", 4, "tutorial crashing", 3)]
    got = sorted(r.seq for r in claims.merge_similar(spark.createDataFrame(rows, "group string, seq long, claim string, n_ids int")).collect())
    assert got == [2, 3]


def test_first_seen_pool(spark):
    rows = [("g", 1, 5, "A", 2), ("g", 1, 7, "R", 1), ("g", None, 1, "A", 3)]
    got = pool.dedup_pool(spark.createDataFrame(rows, "game string, rid long, minutes int, source_filter string, order int")).collect()
    assert [(r.rid, r.minutes, r.source_filters, r.n_seen) for r in got] == [(1, 7, ["R", "A"], 2)]


def test_files(spark, tmp_path):
    (tmp_path / "terms").write_text("Foo # note\n\n# all\nBAR\n")
    (tmp_path / "ids").write_text("12  # twelve\nx1\n 7\n")
    assert [r.term for r in files.read_word_list(spark, str(tmp_path / "terms")).collect()] == ["foo", "bar"]
    assert [tuple(r) for r in files.read_id_list(spark, str(tmp_path / "ids")).collect()] == [("12", "twelve"), ("7", "")]
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    files.write_json_documents(df, str(tmp_path / "json"))
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("s", T.StringType())])
    assert [(r.n, r.s) for r in files.read_json_documents(spark, str(tmp_path / "json/*.txt"), schema).collect()] == [(1, "a")]
    best = files.first_of([("local", df), ("remote", spark.createDataFrame([(1, "b"), (2, "c")], "n int, s string"))], "n")
    assert {r.n: (r.s, r.origin) for r in best.collect()} == {1: ("a", "local"), 2: ("c", "remote")}
    memo = spark.createDataFrame([("k", "seen")], "key string, response string")
    assert [r.response for r in files.replay(spark.createDataFrame([("k",), ("z",)], "key string"), memo).orderBy("key").collect()] == ["seen", None]


def test_releases_are_refused(spark):
    from tallyfield.operators import review_tools as tools

    prunes = spark.createDataFrame([("a", True), ("b", False)], "key string, prune boolean")
    waiting, none = spark.createDataFrame([("c", True)], "key string, take boolean"), spark.createDataFrame([("c", False)], "key string, take boolean")
    keys = lambda *x: [r.key for r in tools.releasable(prunes, *x).collect()]
    assert keys(waiting, False, "origin/x") == [] and keys(waiting, True, "origin/x") == ["a"] and keys(none, False, "origin/x") == ["a"]
    with pytest.raises(ValueError):
        tools.releasable(prunes, none, True, "x")


def test_banned_words():
    from tallyfield.operators import review_tools as tools

    words = set(tools.banned_words())
    assert {"majority", "most", "consensus", "numerous", "many", "few", "some", "several", "half", "everyone", "none"} <= words
    assert not {"players", "third", "vast", "number", "than", "two", "of"} & words


def test_remote_ledger_fails_closed(spark, tmp_path):
    from tallyfield.operators import review_tools as tools

    def used(text):
        (tmp_path / "ledger.json").write_text(text)
        return tools.remote_ledger(spark, str(tmp_path / "ledger.json"), "2026-08-02")

    assert used('{"date": "2026-08-02", "used": 37}') == 37 and used('{"date": "2026-08-01", "used": 13}') == 0
    for bad in ("", "[]", "{}", "x", '{"date": "2026-08-02"}', '{"used": 3}', '{"date": "2026-08-02", "used": -1}', '{"date": "2026-08-02", "used": "many"}'):
        with pytest.raises(ValueError):
            used(bad)


def test_requests_are_tried_again(spark):
    from tallyfield.sources import paged

    waits, failures = [], [paged.TransportError(429, 7.0), paged.TransportError(503), paged.TransportError(0)]

    def call():
        if failures:
            raise failures.pop(0)
        return {"ok": 1}

    assert paged.with_backoff(call, waits.append, lambda: 0.0) == {"ok": 1} and waits == [7.0, 4.0, 8.0]
    with pytest.raises(paged.TransportError):
        paged.with_backoff(lambda: (_ for _ in ()).throw(paged.TransportError(404)), waits.append)
    cached = spark.createDataFrame([("9", "r", 0, "*", "b", "{}"), ("9", "r", 1, "b", "c", "{}"), ("9", "r", 2, "old", "d", "{}")], paged.PAGES)
    assert sorted(r.page for r in paged.replay_pages(cached).collect()) == [0, 1]


def test_prices(spark):
    from tallyfield.operators import ingest

    rows = [("Free To Play", "499"), ("<i>2,999</i>", "0"), ("", "0"), ("", None)]
    assert values(spark, ingest.is_free(F.col("t"), F.col("a")), rows, "t string, a string") == [True, False, True, False]


def test_extraction_rounds(spark):
    from tallyfield.operators import serving

    def ask(rows, attempt):
        return rows.select("key", F.lit(attempt).alias("claim"))

    got = serving.extract(spark.createDataFrame([(i,) for i in range(5)], "key long"), lambda c: c.where("key <= claim"), ask)
    assert sorted((r.key, r.claim) for r in got.collect()) == [(0, 0), (1, 1), (2, 2)]


def test_binomial_tail_of_many_draws(spark):
    cases = [(285, 300, 0.95), (0, 300, 0.95), (300, 300, 0.95), (1, 3000, 0.5), (1500, 3000, 0.5), (2990, 3000, 0.99), (0, 1, 0.3), (7, 10, 0.7), (3, 3, 1.0), (2, 3, 1.0), (0, 4, 0.0), (0, 0, 0.5)]
    df = spark.createDataFrame(cases, "k int, n int, p double")
    got = [r[0] for r in df.select(R.binomial_tail(F.col("k"), F.col("n"), F.col("p"))).collect()]
    for (k, n, p), x in zip(cases, got):
        if not n:
            assert x is None
            continue
        q = Decimal(p)  # with 28 digits
        want = float(min(1, sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))) if 0 < p < 1 else float(p <= 0 or k >= n)
        assert x == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_sweeps_in_the_order_they_came(spark):
    rows = [("g", 1, "recent", 5), ("g", 1, "all", 9), ("g", 1, "recent", 11), ("g", 2, "all", 2), ("g", None, "all", 1), ("h", 1, "z", 4), ("h", 1, "a", 4)]
    df = spark.createDataFrame(rows, "game string, rid long, source_filter string, at int")
    got = pool.dedup_pool(df.withColumn("order", F.struct("at", F.col("source_filter").alias("sweep"))))
    assert {(r.game, r.rid): (r.source_filters, r.n_seen, r["at"]) for r in got.collect()} == {("g", 1): (["recent", "all"], 3, 5), ("g", 2): (["all"], 1, 2), ("h", 1): (["a", "z"], 2, 4)}
    numbers = {(r.game, r.rid): r.seq for r in pool.numbered(got, F.col("at") % 2).collect()}
    assert set(numbers) == {("g", 1), ("g", 2), ("h", 1)}
    assert {(r.game, r.rid): r.seq for r in pool.numbered(got, F.col("order.at")).collect()} == {("g", 2): 0, ("g", 1): 1, ("h", 1): 0}


def test_prompt_lines(spark):
    rows = [("g", "mid", 7, 1, 21.5, None, " a \n b "), ("g", "mid", 3, 0, None, True, "x" * 1600), ("g", "mid", 9, 2, 2.0, False, None)]
    df = spark.createDataFrame(rows, "game string, bucket string, rid long, seq long, hours double, voted_up boolean, text string")
    assert claims.prompts(df).first().prompt.split("\n\n") == ["[3] (0.0h, recommends) " + "x" * 1500 + " ...[truncated]", "[7] (21.5h, does not recommend) a b", "[9] (2.0h, does not recommend) "]


def test_last_vote_counts(spark):
    rows = [("g", "mid", 1, True, 1), ("g", "mid", 1, False, 2), ("g", "mid", 2, False, 1), ("g", "mid", 2, True, 5), ("g", "mid", 3, None, 1)]
    cited = spark.createDataFrame(rows, "game string, bucket string, rid long, voted_up boolean, order int")
    pooled = spark.createDataFrame([("g", "mid", 90.0)], "game string, bucket string, pct_positive double")
    r = sourcing.sourcing(cited, pooled).first()
    assert (r.cited_reviews, r.cited_recommend) == (3, 1)


def test_all_statements_about_people_are_found(spark):
    df = spark.createDataFrame([("90% of players like it, 80 % do not; most people and many players",), (None,)], "text string")
    got = [[(h["match"], h["label"]) for h in r[0]] for r in df.select(X.prevalence_hits(F.col("text"))).collect()]
    assert got == [[("90%", "percentage"), ("80 %", "percentage"), ("most", "quantifier over people"), ("many players", "quantifier over people")], []]


def test_memo_keys_tell_nulls_apart(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a", "", "b")], "x string, y string, z string")
    assert len({r[0] for r in df.select(files.memo_key("t", "x", "y", "z")).collect()}) == 3


def test_admission_names_the_first_limit(spark):
    rows = [(88, "a", 0), (87, "a", 5), (87, "a", 4), (87, None, 9), (87, "", 9), (None, "a", None), (500, "a", 9)]
    df = spark.createDataFrame(rows, "used int, ip string, seen int")
    got = [tuple(r[0]) for r in df.select(admission.can_generate(F.col("used"), F.col("ip"), F.col("seen"))).collect()]
    assert got == [(False, "reserve_exhausted", 12), (False, "ip_limited", 13), (True, "ok", 13), (True, "ok", 13), (True, "ok", 13), (True, "ok", 100), (False, "reserve_exhausted", 0)]
    both = spark.createDataFrame([(380, 7), (380, 8), (None, None), (0, 400)], "batch int, live int")
    assert [r[0].code for r in both.select(admission.can_batch(F.col("batch"), F.col("live"))).collect()] == ["ok", "batch_budget_exhausted", "ok", "batch_budget_exhausted"]
    assert [r[0].allowed for r in both.select(admission.can_flash(F.col("live") + 12)).collect()] == [True, False, True, False]


def test_stages_stop_a_title_and_no_other(spark):
    titles = spark.createDataFrame([(1,), (2,), (3,), (4,)], "appid int")
    stages = [("one", lambda t: t.where("appid <> 2").withColumn("code", F.when(F.col("appid") == 1, "thin"))), ("two", lambda t: t.withColumn("code", F.when(F.col("appid") == 4, "late")))]
    assert {tuple(r) for r in admission.run_stages(titles, stages).collect()} == {(1, "thin"), (2, "one_failed"), (3, "ok"), (4, "late")}
    assert admission.run_stages(titles.limit(0), stages).count() == 0


def test_only_the_first_attempt_reads_the_memory(spark):
    asked = []
    memo = spark.createDataFrame([("a", "good"), ("b", "bad")], "key string, response string")
    requests = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")

    def ask(rows, attempt):
        asked.append((attempt, sorted(r.key for r in rows.collect())))
        return rows.select("key", F.when(F.col("key") == "d", "bad").otherwise(f"good {attempt}").alias("response"))

    got = admission.retry(requests, memo, ask, lambda r: r.withColumn("code", F.when(F.col("response") == "bad", "invalid")), retries=1)
    assert {tuple(r) for r in got.collect()} == {("a", "good", 0, None), ("c", "good 0", 0, None), ("b", "good 1", 1, None), ("d", "bad", 1, "invalid")}
    assert asked[0] == (0, ["c", "d"]) and asked[1] == (1, ["b", "d"])


def test_titles_without_a_name_stop_everything(spark):
    df = spark.createDataFrame([(1, "x"), (2, " ")], "appid int, name string")
    assert documents.named_only(df.where("appid = 1")).count() == 1
    with pytest.raises(Exception, match="no name for title 2"):
        documents.named_only(df).collect()


def test_documents_of_odd_rows(spark):
    b = F.col("b")
    df = spark.createDataFrame([("early",), ("veteran",), ("other",), (None,)], "b string")
    assert [tuple(r) for r in df.select(documents.cohort_hours(b), documents.cohort_label(b)).collect()] == [("2-20 hours played", "2-20h"), ("100+ hours played", "100h+"), ("unknown playtime", "other"), ("unknown playtime", None)]
    claims_ = spark.createDataFrame([("g", "mid", "t1", "c1", 1), ("g", "mid", "t2", "c2", 2), ("g", "mid", "t1", "c3", 3)], "game string, bucket string, theme string, claim_id string, seq int")
    listed = spark.createDataFrame([("g", "mid", "c3", 0), ("g", "mid", "c2", 1), ("g", "mid", "c3", 2), ("g", "mid", "unknown", 3)], "game string, bucket string, claim_id string, pos int")
    full = documents.ordered_claims(claims_, listed).withColumns({"claim": F.lit("x"), "citation_verdict": F.lit("mixed"), "positive": F.lit(1), "negative": F.lit(0), "citations": F.array(F.lit("r"))})
    assert [(t.theme, [c.claim_id for c in t.claims]) for t in documents.themes(full).first().themes] == [("t1", ["c3", "c1"]), ("t2", ["c2"])]
    first, second = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    assert {tuple(r) for r in documents.prefer(first, second, ["k"]).collect()} == {(1, "a"), (2, "c")}


def test_schedules_and_responses(spark, tmp_path):
    (tmp_path / "tier.txt").write_text("# head\n10 # day 3, big\n20\nx # day 4\n30 # later\n")
    assert {tuple(r) for r in files.read_schedule(spark, str(tmp_path / "tier.txt")).collect()} == {(10, 3), (20, 1), (30, 1)}
    df = spark.createDataFrame([('{"word": "Buy"}',), ('{"word": ',), ("[]",), (None,), ('{"x": 1}',)], "t string")
    got = [(r[0].parsed.word if r[0].parsed else None, r[0].code) for r in df.select(audits.parse_response(F.col("t"), "word string", "word")).collect()]
    assert got[0] == ("Buy", None) and got[1] == got[3] == (None, "invalid_json") and got[2][1] is not None and got[4] == (None, "missing:word")


def test_score_summary_names_the_failing_cases(spark):
    rows = [(k, 0 if k % 3 == 0 else 2, k != 17, k % 50 != 1) for k in range(200, 0, -1)]
    schema = "case_id long, score int, in_cohort boolean, safe boolean"
    got = audits.aggregate_scores(spark.createDataFrame(rows, schema).repartition(7)).collect()
    named = lambda keep: ",".join(str(r[0]) for r in reversed(rows) if keep(r))
    assert [(r.n, r.zero_ids, r.outside_ids, r.unsafe_ids, r.zeros, r.outside, r.unsafe, r.result) for r in got] == [(200, named(lambda r: r[1] == 0), "17", named(lambda r: not r[3]), 66, 1, 4, "fail")]
    none = audits.aggregate_scores(spark.createDataFrame([], schema)).first()
    assert (none.n, none.mean, none.distribution, none.zero_ids, none.outside, none.result) == (0, None, "0/0/0", None, 0, "pass")
