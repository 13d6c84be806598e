"""Queries over whole documents, admission and audits; importing this module registers them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyfield.operators import admission, audits, catalog, documents, pool, serving, sourcing, verdict
from tallyfield.plans import oracles as O
from tallyfield.plans.registry import _CITE, _LAST, _TITLES, _citations, _deltas, _DELTA, _titles, query
from tallyfield.package import shared_folder
from tallyfield.sources import adapters as A
from tallyfield.sources.entity_files import read_entities, write_entities


def _documents(spark, d):
    reviews = A.fact_reviews(spark, d)
    rates = pool.pool_rates(reviews)
    report = rates.select("game", "bucket", F.col("pool_n").alias("kept"), (F.col("pool_n") < 20).alias("muted"))
    sections = documents.cohort_sections(rates, report, rates)
    once = reviews.groupBy("game", "bucket", "rid").agg(F.min("source_filter").alias("theme"), F.max("voted_up").alias("up"))
    cited = once.select(
        "game", "bucket", "theme", F.col("rid").alias("seq"), F.concat(F.lit("c"), F.col("rid").cast("string")).alias("claim_id"), F.lit("a claim").alias("claim"), F.lit("mixed").alias("citation_verdict"),
        F.col("up").cast("int").alias("positive"), (~F.col("up")).cast("int").alias("negative"), F.array(F.struct("rid")).alias("citations"), "up",
    )
    listed = cited.where("NOT up").select("game", "bucket", "claim_id", (-F.col("seq")).alias("pos"))
    themed = documents.themes(documents.ordered_claims(cited.drop("up"), listed))
    summaries = rates.select("game", "bucket", F.when(F.col("bucket") != "mid", F.concat(F.lit("about "), "bucket")).otherwise("").alias("summary"))
    flags = documents.flags_with_sentences(*_flags(spark, d))
    return documents.assemble_documents(sections, themed, summaries, sourcing.sourcing(_citations(spark, d), rates), flags, verdict.post_refund_mean(rates))


def _flags(spark, d):
    """Suppliers of one kind of balance have a flag with a direction, those of another one with a shape; not all are
    described."""
    rows = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("game"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").alias("k"))
    flags = rows.where("x > 0").select("game", F.when(F.col("k") < 12, "recency_shift").otherwise("cohort_divergence").alias("flag_id"), F.lit("improved").alias("direction"), F.when(F.col("k") >= 12, "mixed").alias("shape"))
    sentences = rows.where("x > 4000").select("game", F.lit("recency_shift").alias("flag_id"), F.concat(F.lit("It got better, says "), F.col("k").cast("string")).alias("sentence"))
    return flags, sentences


_CLAIMS = f"""{O.RATES}, one AS (SELECT game, bucket, rid, min(source_filter) AS theme, bool_or(voted_up) AS up FROM fact GROUP BY 1, 2, 3),
 ord AS (SELECT one.*, row_number() OVER (PARTITION BY game, bucket ORDER BY up, CASE WHEN up THEN rid ELSE -rid END, 'c' || rid) AS o FROM one JOIN rates USING (game, bucket) WHERE pool_n >= 20 AND bucket <> 'unknown'),
 th AS (SELECT game, bucket, theme, row_number() OVER (PARTITION BY game, bucket ORDER BY min(o)) - 1 AS theme_place FROM ord GROUP BY 1, 2, 3)"""


@query(f"""WITH {_CLAIMS} SELECT game, bucket, CAST(theme_place AS INTEGER) AS theme_place, theme, CAST(row_number() OVER (PARTITION BY game, bucket, theme ORDER BY o) - 1 AS INTEGER) AS claim_place, 'c' || rid AS claim_id FROM ord JOIN th USING (game, bucket, theme)""")
def assembled_claims(spark, d):
    return documents.claim_rows(_documents(spark, d))


@query(f"""WITH {O.RATES}, g AS (SELECT DISTINCT game FROM rates), b AS (SELECT * FROM (VALUES ('refund_window', '<2h refund window', 'under 2 hours'), ('early', '2-20h', '2-20 hours'), ('mid', '20-100h', '20-100 hours'), ('veteran', '100h+', '100+ hours')) v(bucket, label, hours_range)),
 o AS (SELECT game, bucket, rid, voted_up AS up FROM (SELECT *, row_number() OVER (PARTITION BY game, bucket, rid ORDER BY {_LAST}) AS back FROM fact WHERE {_CITE}) WHERE back = 1), s AS (SELECT game, bucket, count(*) AS cited, count(*) FILTER (up) AS recommend FROM o GROUP BY 1, 2)
 SELECT game, bucket, label, hours_range, pool_n, pct_positive, coalesce(pool_n < 20, false) AS muted, CASE WHEN pool_n < 20 THEN 'n=' || pool_n || ' - too few reviews to call' END AS n_note,
  CASE WHEN coalesce(pool_n < 20, false) OR bucket = 'mid' OR pool_n IS NULL THEN NULL ELSE 'about ' || bucket END AS summary, CASE WHEN pool_n >= 20 THEN cited END AS cited_reviews, CASE WHEN pool_n >= 20 THEN recommend END AS cited_recommend
 FROM g CROSS JOIN b LEFT JOIN rates USING (game, bucket) LEFT JOIN s USING (game, bucket)""")
def assembled_cohorts(spark, d):
    rows = _documents(spark, d).select("game", F.explode("cohorts").alias("c"))
    plain = [F.col(f"c.{n}").alias(n) for n in ("bucket", "label", "hours_range", "pool_n", "pct_positive", "muted", "n_note", "summary")]
    return rows.select("game", *plain, F.col("c.sourcing.cited_reviews").alias("cited_reviews"), F.col("c.sourcing.cited_recommend").alias("cited_recommend"))


_FLAGGED = "f AS (SELECT s_suppkey AS game, CASE WHEN s_nationkey < 12 THEN 'recency_shift' ELSE 'cohort_divergence' END AS flag_id, CASE WHEN s_nationkey < 12 THEN 'improved' END AS direction, CASE WHEN s_nationkey >= 12 THEN 'mixed' END AS shape, CASE WHEN s_nationkey < 12 AND s_acctbal > 4000 THEN 'It got better, says ' || s_nationkey END AS sentence FROM supplier WHERE s_acctbal > 0)"


@query(f"WITH {_FLAGGED} SELECT * FROM f WHERE game IN (SELECT l_suppkey FROM lineitem)")
def assembled_flags(spark, d):
    return _documents(spark, d).select("game", F.explode("flags").alias("f")).select("game", "f.*")


@query(f"""WITH {_CLAIMS}, {O.MEAN}, {_FLAGGED}, {{}} SELECT game, sha256('Game: ' || game || chr(10) || chr(10) || 'VERDICT (settled): ' || coalesce({O.WORD}, 'none') || chr(10) || chr(10) || 'COHORTS:' || body || coalesce(tail, '')) AS turn_sha256 FROM means JOIN body USING (game) LEFT JOIN tail USING (game)""".format(f"""
 cl AS (SELECT game, bucket, string_agg(chr(10) || '   c' || rid || ' (' || theme || ') a claim' || chr(10) || '        cited: ' || up::INT || ' recommend, ' || (NOT up)::INT || ' do not', '' ORDER BY theme_place, o) AS body FROM ord JOIN th USING (game, bucket, theme) GROUP BY 1, 2),
 b AS (SELECT * FROM (VALUES (1, 'refund_window', 'under 2 hours'), (2, 'early', '2-20 hours'), (3, 'mid', '20-100 hours'), (4, 'veteran', '100+ hours')) v(k, bucket, hours)),
 body AS (SELECT game, string_agg(chr(10) || chr(10) || '[' || bucket || '] ' || hours || CASE WHEN pool_n < 20 THEN ' - MUTED: nothing is written about it' ELSE ' - ' || coalesce(CAST(pct_positive AS VARCHAR), 'no') || '% positive' || coalesce(cl.body, '') END, '' ORDER BY k) AS body
  FROM (SELECT DISTINCT game FROM rates) CROSS JOIN b LEFT JOIN rates USING (game, bucket) LEFT JOIN cl USING (game, bucket) GROUP BY 1),
 tail AS (SELECT game, chr(10) || chr(10) || 'PATTERNS, one sentence each:' || string_agg(chr(10) || '   flag_id=' || flag_id || '  ' || coalesce(direction, shape), '' ORDER BY flag_id) AS tail FROM f GROUP BY 1)"""))
def synthesis_turns(spark, d):
    flags, _ = _flags(spark, d)
    lines = flags.select("game", "flag_id", F.coalesce("shape", "direction").alias("line"))
    return documents.synthesis_turn(_documents(spark, d), lines).select("game", F.sha2("turn", 256).alias("turn_sha256"))


@query(f"""WITH {O.FACT} SELECT DISTINCT bucket, CASE bucket WHEN 'refund_window' THEN '0-2 hours played' WHEN 'early' THEN '2-20 hours played' WHEN 'mid' THEN '20-100 hours played' WHEN 'veteran' THEN '100+ hours played' ELSE 'unknown playtime' END AS hours,
 CASE bucket WHEN 'mid' THEN NULL ELSE '{documents.NOTE}' || CASE bucket WHEN 'refund_window' THEN '{documents.NOTE_ENDS["few"]}' WHEN 'early' THEN '{documents.NOTE_ENDS["few_and_more_negative"]}' WHEN 'veteran' THEN '{documents.NOTE_ENDS["more_negative"]}' ELSE '.' END END AS note FROM fact""")
def cohort_texts(spark, d):
    b = F.col("bucket")
    some = F.when(b == "mid", None).when(b == "refund_window", F.array(F.lit("thin"))).when(b == "early", F.array(F.lit("thin"), F.lit("divergent"))).when(b == "veteran", F.array(F.lit("divergent"))).otherwise(F.array().cast("array<string>"))
    rows = A.fact_reviews(spark, d).select("bucket").distinct()
    return rows.select("bucket", documents.cohort_hours(b).alias("hours"), documents.sourcing_sentence(serving.sourcing_note(some)).alias("note"))


@query("""WITH s AS (SELECT user_id AS key, count(*) FILTER (event_type = 'click') AS live, count(*) FILTER (event_type = 'view') AS batch, count(*) FILTER (event_type = 'purchase') AS flash, count(*) FILTER (event_type = 'error') AS ip FROM events GROUP BY 1)
 SELECT key, CASE WHEN greatest(0, 100 - live * 6) < 13 THEN 'reserve_exhausted' WHEN key % 10 <> 0 AND ip >= 5 THEN 'ip_limited' ELSE 'ok' END AS live, greatest(0, 100 - live * 6) AS live_left,
  CASE WHEN greatest(0, 400 - batch * 20 - live * 6) < 13 THEN 'batch_budget_exhausted' ELSE 'ok' END AS batch, CASE WHEN greatest(0, 20 - flash) < 1 THEN 'flash_daily_exhausted' ELSE 'ok' END AS flash FROM s""")
def admissions(spark, d):
    n = lambda kind: F.count(F.when(F.col("ledger") == kind, 1))
    s = A.request_log(spark, d).groupBy("key").agg((n("click") * 6).alias("live"), (n("view") * 20).alias("batch"), n("purchase").alias("flash"), n("error").alias("ip"))
    live = admission.can_generate(F.col("live"), F.when(F.col("key") % 10 != 0, F.col("key").cast("string")), F.col("ip"))
    return s.select("key", live["code"].alias("live"), live["remaining"].alias("live_left"), admission.can_batch(F.col("batch"), F.col("live"))["code"].alias("batch"), admission.can_flash(F.col("flash"))["code"].alias("flash"))


@query(f"SELECT user_id AS key, {O.pacific('ts', '%Y-%m-%d %H')} AS hour, count(*) AS requests FROM events GROUP BY 1, 2 HAVING hour = (SELECT max({O.pacific('ts', '%Y-%m-%d %H')}) FROM events)")
def hour_tallies(spark, d):
    from tallyfield.operators import ledger

    log = A.request_log(spark, d)
    now = log.agg(F.max("ts").alias("now"))  # one row
    tallies = ledger.hourly(log).crossJoin(F.broadcast(now))
    return admission.current_hour(tallies, F.col("now")).select("key", "hour", "requests")


@query("""SELECT p_partkey AS appid FROM part WHERE p_size > 5 AND p_type NOT LIKE 'PROMO%' AND p_partkey % 2 + 1 = 2 AND p_retailprice <= 990 AND p_type <> 'LARGE' ORDER BY p_partkey LIMIT 25""")
def pending_of_night(spark, d):
    parts = A.table(spark, d, "part").withColumnRenamed("p_partkey", "appid")
    titles = parts.select("appid", F.col("appid").alias("place"), (F.col("appid") % 2 + 1).alias("night"))
    state = parts.select("appid", F.when(F.col("p_type") == "LARGE", "qr4_failed").otherwise("stopped").alias("outcome"))
    return admission.pending_titles(titles, state, parts.where("p_retailprice > 990"), 2, parts.where("p_size > 5"), parts.where("p_type LIKE 'PROMO%'"), 25).select("appid")


@query("""SELECT c_custkey AS appid, CASE WHEN c_acctbal < 0 THEN 'no_reviews' WHEN c_mktsegment = 'BUILDING' THEN 'thin_segmentation' WHEN c_mktsegment = 'MACHINERY' THEN 'synthesize_failed' ELSE 'ok' END AS outcome FROM customer""")
def staged_batch(spark, d):
    titles = A.table(spark, d, "customer").select(F.col("c_custkey").alias("appid"), "c_acctbal", "c_mktsegment")
    code = lambda df, c: titles.join(df, "appid").select("appid", c.alias("code"))
    stages = [
        ("fetch", lambda df: code(df, F.when(F.col("c_acctbal") < 0, "no_reviews"))),
        ("filter", lambda df: code(df, F.when(F.col("c_mktsegment") == "BUILDING", "thin_segmentation"))),
        ("synthesize", lambda df: code(df, F.lit(None).cast("string")).join(titles.where("c_mktsegment <> 'MACHINERY'").select("appid"), "appid", "left_semi")),
    ]
    return admission.run_stages(titles, stages)


@query("""SELECT c_custkey AS key, CASE WHEN c_nationkey < 5 AND c_acctbal > 0 THEN 'old' ELSE 'new' || CASE WHEN c_nationkey < 5 OR c_nationkey >= 10 THEN least(2, CASE WHEN c_nationkey < 5 THEN 1 ELSE c_nationkey % 4 END) ELSE 0 END END AS response,
 CASE WHEN c_nationkey < 5 THEN CASE WHEN c_acctbal > 0 THEN 0 ELSE 1 END WHEN c_nationkey < 10 THEN 0 ELSE least(2, c_nationkey % 4) END AS attempt, CASE WHEN c_nationkey >= 10 AND c_nationkey % 4 = 3 THEN 'bad' END AS code FROM customer""")
def retried_responses(spark, d):
    """Remembered responses of poor customers are bad and asked for anew; some customers' new ones are good at the n-th try."""
    rows = A.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey", "c_acctbal")
    memo = rows.where("c_nationkey < 5").select("key", F.when(F.col("c_acctbal") > 0, "old").otherwise("stale").alias("response"))
    ask = lambda df, attempt: df.select("key", F.lit(f"new{attempt}").alias("response"))
    good_at = F.when(F.col("c_nationkey") >= 10, F.col("c_nationkey") % 4).otherwise(0)

    def failures(got):
        tried = F.nullif(F.regexp_extract("response", "^new([0-9])", 1), F.lit("")).cast("int")
        bad = (F.col("response") == "stale") | (tried < F.col("good_at"))
        return got.join(rows.select("key", good_at.alias("good_at")), "key").withColumn("code", F.when(bad, "bad"))

    return admission.retry(rows.select("key"), memo, ask, failures)


_CASES = "ca AS (SELECT o_orderkey AS k, o_custkey AS game, CASE WHEN o_orderpriority < '3' THEN 'early' ELSE 'mid' END AS bucket, o_orderstatus AS theme FROM orders)"


def _cases(spark, d):
    o = A.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("game"), F.when(F.col("o_orderpriority") < "3", "early").otherwise("mid").alias("bucket"), F.col("o_orderstatus").alias("theme"))


@query(f"""WITH {_CASES}, co AS (SELECT c_custkey AS game, c_custkey * 10 + i AS rid, CASE WHEN c_acctbal > 5000 THEN 'mid' ELSE 'early' END AS bucket FROM customer CROSS JOIN (VALUES (0), (1)) v(i) WHERE c_mktsegment <> 'BUILDING'),
 ci AS (SELECT k, game, bucket, game * 10 + i AS rid FROM ca CROSS JOIN (VALUES (0), (1)) v(i)), j AS (SELECT ci.*, co.rid IS NOT NULL AS there, co.bucket AS found FROM ci LEFT JOIN co USING (game, rid)),
 s AS (SELECT k, game, bucket, count(*) FILTER (NOT there) AS absent, count(*) FILTER (there AND found <> bucket) AS elsewhere, count(*) FILTER (there) AS resolved FROM j GROUP BY 1, 2, 3)
 SELECT 'absent_from_corpus' AS problem, game, bucket, 'c' || k AS claim_id, absent AS n FROM s WHERE absent > 0 UNION ALL SELECT 'of_another_cohort', game, bucket, 'c' || k, elsewhere FROM s WHERE elsewhere > 0
 UNION ALL SELECT 'too_few_citations', game, bucket, 'c' || k, resolved FROM s WHERE resolved < 2
 UNION ALL SELECT 'muted_with_claims', game, bucket, NULL, count(*) FROM ca WHERE bucket = 'mid' AND game IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY 2, 3
 UNION ALL SELECT 'repeated_case_id', min(game), min(bucket), min('c' || k), count(*) FROM ca GROUP BY game || '-' || theme HAVING count(*) > 1""")
def candidate_problems(spark, d):
    claim = F.concat(F.lit("c"), F.col("k").cast("string"))
    case = F.concat(F.col("game").cast("string"), F.lit("-"), "theme")
    ids = F.array(F.col("game") * 10, F.col("game") * 10 + 1)
    cases = _cases(spark, d).select(case.alias("case_id"), "game", "bucket", claim.alias("claim_id"), ids.alias("ids"))
    c = A.table(spark, d, "customer")
    both = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("game"), F.explode(F.array(F.col("c_custkey") * 10, F.col("c_custkey") * 10 + 1)).alias("rid"), F.when(F.col("c_acctbal") > 5000, "mid").otherwise("early").alias("bucket"))
    return audits.candidate_problems(cases, both, c.where("c_nationkey = 3").select(F.col("c_custkey").alias("game"), F.lit("mid").alias("bucket")))


@query(f"WITH {_CASES} SELECT CASE WHEN grouping(game) = 0 THEN 'game' WHEN grouping(bucket) = 0 THEN 'cohort' ELSE 'theme' END AS by, coalesce(CAST(game AS VARCHAR), bucket, theme) AS name, count(*) AS n FROM ca GROUP BY GROUPING SETS ((game), (bucket), (theme))")
def candidate_distribution(spark, d):
    return audits.distribution(_cases(spark, d))


@query("""SELECT c_custkey AS case_id, unnest(list_filter([CASE WHEN c_nationkey = 1 THEN 'field:citation_verdict' END, CASE WHEN c_nationkey % 3 = 0 THEN 'verdict' END, CASE WHEN c_nationkey % 5 = 0 THEN 'split' END], lambda x: x IS NOT NULL)) AS leak FROM customer""")
def payload_leaks(spark, d):
    k = F.col("c_nationkey")
    head = F.concat(F.lit("case about mixed things, "), F.when(k == 1, "citation_verdict, ").otherwise(""), F.when(k % 3 == 0, "is mixed ").otherwise("is remixed "), F.when(k % 5 == 0, "4u/1d").otherwise("14u/1d"))
    rows = A.table(spark, d, "customer").select(
        F.col("c_custkey").alias("case_id"), F.concat(head, F.lit(" --- CITATION 1: mixed 4u/1d")).alias("payload"), F.lit("about mixed things").alias("claim"), F.lit("mixed").alias("verdict"), F.lit(4).alias("positive"), F.lit(1).alias("negative")
    )
    return audits.leaks(rows, ["citation_verdict", "citation_split"])


_SCORES = "s AS (SELECT doc_id, quality + quality * (1 - toxic) AS score, doc_id <> 17 AS inside, NOT (toxic = 1 AND quality = 1) AS safe FROM labels)"


def _scores(spark, d):
    q, t = F.col("quality"), F.col("toxic")
    return A.table(spark, d, "labels").select(F.col("doc_id").alias("case_id"), (q + q * (1 - t)).alias("score"), (F.col("doc_id") != 17).alias("in_cohort"), (~((t == 1) & (q == 1))).alias("safe"))


@query(f"""WITH {_SCORES} SELECT count(*) AS n, round(100e0 * count(*) FILTER (score = 2) / count(*), 1) AS pct_two, round(avg(score), 2) AS mean, count(*) FILTER (score = 0) || '/' || count(*) FILTER (score = 1) || '/' || count(*) FILTER (score = 2) AS distribution,
 string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (score = 0) AS zero_ids, round(100e0 * count(*) FILTER (inside) / count(*), 1) AS in_cohort_pct, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (NOT inside), '') AS outside_ids,
 coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (NOT safe), '') AS unsafe_ids, CAST(count(*) FILTER (score = 0) AS BIGINT) AS zeros, CAST(count(*) FILTER (NOT inside) AS BIGINT) AS outside, CAST(count(*) FILTER (NOT safe) AS BIGINT) AS unsafe,
 CASE WHEN count(*) FILTER (NOT safe) > 0 THEN 'fail' ELSE 'pass' END AS result FROM s""")
def score_summary(spark, d):
    return audits.aggregate_scores(_scores(spark, d)).fillna("", ["outside_ids", "unsafe_ids"])


@query(f"WITH {_SCORES} SELECT 'zero' AS failing, doc_id AS case_id FROM s WHERE score = 0 UNION ALL SELECT 'outside', doc_id FROM s WHERE NOT inside UNION ALL SELECT 'unsafe', doc_id FROM s WHERE NOT safe")
def score_failures(spark, d):
    return audits.failing_cases(_scores(spark, d))


@query("""WITH s AS (SELECT event_type AS outcome, count(*) AS n, CAST(sum(event_id % 14) AS BIGINT) AS calls, sum(event_id % 40) AS seconds FROM events GROUP BY 1)
 SELECT outcome, n, calls, round(100e0 * n / sum(n) OVER (), 1) AS share_pct, round(sum(calls) OVER () / (sum(seconds) OVER () / 60e0), 1) AS per_minute FROM s""")
def batch_outcomes(spark, d):
    return audits.batch_report(A.request_log(spark, d).select(F.col("ledger").alias("outcome"), (F.col("id") % 14).alias("calls"), (F.col("id") % 40).alias("seconds")))


@query(f"WITH {_DELTA} SELECT * FROM dl ORDER BY delta_pool, game, bucket LIMIT 25")
def worst_deltas(spark, d):
    return audits.worst(_deltas(spark, d))


@query("SELECT doc_id AS rid FROM documents ORDER BY sha256('seven:' || doc_id), doc_id LIMIT 40")
def uniform_audit(spark, d):
    return audits.seeded_sample(A.table(spark, d, "documents").select(F.col("doc_id").alias("rid")), "rid", 40, "seven")


@query(f"""WITH {O.FACT}, o AS (SELECT game, bucket, voted_up AS up FROM (SELECT *, row_number() OVER (PARTITION BY game, bucket, rid ORDER BY {_LAST}) AS back FROM fact WHERE {_CITE}) WHERE back = 1), c AS (SELECT game, bucket, count(*) AS cited_n, count(*) FILTER (up) AS c FROM o GROUP BY 1, 2),
 a AS (SELECT game, bucket, count(*) AS available_n, count(*) FILTER (voted_up) AS a FROM fact GROUP BY 1, 2) SELECT game, bucket, cited_n, available_n, round(round(100e0 * c / cited_n, 1) - round(100e0 * a / available_n, 1), 1) + 0 AS delta_avail FROM c JOIN a USING (game, bucket)""")
def available_deltas(spark, d):
    return audits.available_delta(_citations(spark, d), A.fact_reviews(spark, d))


@query(f"WITH {_TITLES} SELECT night, count(*) AS n, round(median(pct), 3) AS median, round(avg(pct), 3) AS mean FROM titles GROUP BY 1")
def night_medians(spark, d):
    return audits.night_medians(_titles(spark, d))


@query("SELECT count(*) FILTER (l_linenumber = 1) AS with_hardware, count(*) FILTER (l_returnflag = 'R') AS refunded, count(*) FILTER (l_linestatus = 'O') AS early_access FROM lineitem")
def key_counts(spark, d):
    rows = A.table(spark, d, "lineitem")
    return audits.key_counts(rows.select(F.when(F.col("l_linenumber") == 1, "gpu").alias("hardware"), (F.col("l_returnflag") == "R").alias("refunded"), (F.col("l_linestatus") == "O").alias("early_access")))


@query("""SELECT c_custkey AS key, CASE WHEN c_nationkey % 4 = 0 THEN NULL WHEN c_nationkey % 4 = 1 THEN NULL ELSE c_mktsegment END AS word, CASE WHEN c_nationkey % 4 = 0 THEN 'invalid_json' WHEN c_nationkey % 4 = 1 THEN 'missing:word' END AS code FROM customer""")
def parsed_responses(spark, d):
    k = F.col("c_nationkey") % 4
    body = F.when(k == 0, '{"word": ').when(k == 1, '{"other": 1}').otherwise(F.concat(F.lit('{"word": "'), "c_mktsegment", F.lit('"}')))
    part = lambda t, thought: F.struct(t.alias("text"), F.lit(thought).alias("thought"))
    parts = F.array(part(F.lit("let me see {"), True), part(F.substring(body, 1, 5), False), part(F.expr("substring(body, 6)"), None))
    rows = A.table(spark, d, "customer").withColumn("body", body).select(F.col("c_custkey").alias("key"), audits.response_text(parts).alias("text"))
    return rows.select("key", audits.parse_response(F.col("text"), "word string", "word").alias("p")).select("key", "p.parsed.word", "p.code")


@query("""SELECT 's' AS sheet, 'title' AS kind, c_name AS name, NULL AS bucket, CAST(c_custkey AS VARCHAR) AS id FROM customer UNION ALL SELECT 's', 'citation', c_name, 'mid', CAST(c_custkey * 10 AS VARCHAR) FROM customer""")
def sheet_entries(spark, d):
    c = A.table(spark, d, "customer")
    key = F.col("c_custkey")
    content = F.concat(F.lit("# Sheet\n- [x] **"), "c_name", F.lit("** (`"), key.cast("string"), F.lit("`, n)\n  3. [ ] "), "c_name", F.lit(" / mid / `"), (key * 10).cast("string"), F.lit("`\n- [y] **no** (`1`"))
    return audits.sheet_entries(c.select(F.lit("s").alias("sheet"), content.alias("content")))


@query("SELECT c_custkey AS key, CASE c_nationkey % 3 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN '77' END AS appid, CASE WHEN c_nationkey % 2 = 0 THEN 'v' || c_nationkey ELSE 'unknown' END AS rubric FROM customer")
def run_names(spark, d):
    k, key = F.col("c_nationkey"), F.col("c_custkey").cast("string")
    display = F.when(k % 3 == 0, F.concat(F.lit("verdict  "), key, F.lit(" x"))).when(k % 3 == 1, "")
    name = F.when(k % 3 == 1, "run verdict 77").otherwise("verdict none")
    rubric = F.when(k % 2 == 0, F.concat(F.lit("# R\n**Version:**  v"), k.cast("string"), F.lit(" \nrest"))).otherwise("# R\nVersion: 2")
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), audits.run_title(display, name).alias("appid"), audits.rubric_version(rubric).alias("rubric"))


@query("SELECT o_orderkey || '.json' AS path, o_comment_length AS content FROM (SELECT o_orderkey, length(o_orderpriority) AS o_comment_length, o_orderstatus FROM orders) WHERE o_orderstatus = 'F'")
def ref_snapshot(spark, d):
    o = A.table(spark, d, "orders")
    files = o.select(F.col("o_orderstatus").alias("ref"), F.concat(F.lit("verdicts/"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("path"), F.length("o_orderpriority").alias("content"))
    return audits.snapshot(files, "F", "verdicts/").select(F.regexp_replace("path", "^verdicts/", "").alias("path"), "content")


@query("SELECT p_partkey AS appid, CASE WHEN p_size > 10 THEN p_name END AS name, CASE WHEN p_size > 20 THEN p_brand END AS art, p_size <= 20 AS refetch FROM part")
def name_lookup(spark, d):
    p = A.table(spark, d, "part").withColumnRenamed("p_partkey", "appid")
    cache = p.where("p_size > 10").select("appid", F.col("p_name").alias("name"), F.when(F.col("p_size") > 20, F.col("p_brand")).alias("art"))
    return audits.lookup(p.select("appid"), cache)


_LISTS = "fr AS (SELECT p_partkey FROM part WHERE p_type = 'SMALL'), li AS (SELECT p_partkey FROM part WHERE p_type LIKE 'PROMO%'), ex AS (SELECT p_partkey FROM part WHERE p_size < 9)"


def _lists(spark, d):
    p = A.table(spark, d, "part").withColumnRenamed("p_partkey", "appid")
    note = lambda where, c: p.where(where).select("appid", F.col(c).alias("note"))
    return p, note("p_type = 'SMALL'", "p_brand"), note("p_type LIKE 'PROMO%'", "p_type"), note("p_size < 9", "p_brand")


@query(f"""WITH {_LISTS}, m AS (SELECT *, p_partkey IN (FROM fr) AS f, p_partkey IN (FROM li) AS l, p_partkey IN (FROM ex) AS e FROM part)
 SELECT p_partkey AS appid, f AND NOT e OR l AS live, CASE WHEN e THEN 'free, audited as single-player: ' || p_brand WHEN f THEN 'free-to-play' WHEN l THEN 'audited: ' || p_type ELSE 'priced, not on the live-service list' END AS basis FROM m""")
def classified_titles(spark, d):
    p, free, live, exempt = _lists(spark, d)
    return catalog.classify_titles(p.select("appid"), free, live, exempt)


@query(f"WITH {_LISTS} SELECT p_partkey AS appid, p_name AS title, 'ranked' AS basis FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, p_brand, 'audited list' FROM part WHERE p_partkey IN (FROM ex) AND p_partkey NOT IN (FROM fr) AND p_partkey NOT IN (FROM li)")
def extended_catalog(spark, d):
    p, have, duplicates, extra = _lists(spark, d)
    chosen = p.where("p_size > 40").select("appid", F.col("p_name").alias("title"), F.lit("ranked").alias("basis"))
    return catalog.add_extra(chosen, extra, have, duplicates)


@query("SELECT count(*) AS n, sha256('{\"v\":1,\"n\":' || count(*) || ',\"c\":{' || coalesce(string_agg('\"' || p_partkey || '\":\"' || p_brand || '\"', ',' ORDER BY p_partkey), '') || '}}') AS payload_sha256 FROM part WHERE p_size > 25 AND p_retailprice > 950")
def art_shard(spark, d):
    p = A.table(spark, d, "part").withColumnRenamed("p_partkey", "appid")
    folder = f"{shared_folder(spark)}/art-{uuid.uuid4().hex}"
    write_entities(documents.art_pieces(p.where("p_size > 25").select("appid", F.col("p_brand").alias("suffix")), p.where("p_retailprice > 950")), folder)
    files = read_entities(spark, folder)
    return files.select(F.get_json_object("content", "$.n").cast("long").alias("n"), F.sha2("content", 256).alias("payload_sha256"))


@query("SELECT p_partkey AS appid, p_brand AS art FROM part WHERE p_size > 30 AND p_size <> 40")
def changed_art(spark, d):
    p = A.table(spark, d, "part").withColumnRenamed("p_partkey", "appid")
    stored = p.select("appid", F.when(F.col("p_size") == 40, F.col("p_brand")).otherwise("old").alias("art"))
    return documents.art_changes(stored, p.select("appid", F.when(F.col("p_size") > 30, F.col("p_brand")).alias("art")))


@query("SELECT c_custkey AS appid, c_name || ': ' || c_mktsegment AS title, c_mktsegment AS description, 'https://site.test/verdict/' || c_custkey AS url, CASE WHEN c_nationkey < 5 THEN 'https://cdn.test/' || c_custkey || '/header.jpg' ELSE 'https://art.test/' || c_nationkey END AS image FROM customer")
def document_cards(spark, d):
    c = A.table(spark, d, "customer")
    art = F.when(F.col("c_nationkey") >= 5, F.concat(F.lit("https://art.test/"), F.col("c_nationkey").cast("string")))
    rows = c.select(F.col("c_custkey").alias("appid"), F.col("c_name").alias("game_name"), F.col("c_mktsegment").alias("word"), F.col("c_mktsegment").alias("tagline"), art.alias("header_image"))
    return documents.card(rows, "https://site.test", "https://cdn.test")


@query("SELECT c_custkey AS game, 'recency: last 365 days of the pool run ' || CASE WHEN c_nationkey > 0 THEN '+' ELSE '-' END || (CASE WHEN c_nationkey > 0 THEN c_nationkey ELSE 3 END) || '.5 pts vs lifetime (80.0% of 200 pooled vs 61.2% of 3000 lifetime)' AS line FROM customer")
def recency_lines(spark, d):
    k = F.col("c_nationkey")
    delta = F.when(k > 0, k + 0.5).otherwise(-3.5)
    rows = A.table(spark, d, "customer").select(F.col("c_custkey").alias("game"), F.lit(365).alias("days"), delta.alias("delta_pts"), F.lit(80.0).alias("recent_pct"), F.lit(200).alias("recent_n"), F.lit(61.2).alias("lifetime_pct"), F.lit(3000).alias("lifetime_n"))
    return documents.describe_recency(rows)


@query("SELECT p_partkey AS appid, arg_min(title, (-reviews, place)) AS title, max(reviews) AS reviews FROM (SELECT p_partkey, p_name AS title, CAST(trunc(p_retailprice) AS INTEGER) AS reviews, 1 AS place FROM part UNION ALL SELECT p_partkey, p_brand, CAST(trunc(p_retailprice) AS INTEGER) + CASE WHEN p_size > 25 THEN 1 ELSE 0 END, 0 FROM part) GROUP BY 1")
def best_entries(spark, d):
    e = A.catalog_entries(spark, d)
    again = A.table(spark, d, "part").select(F.col("p_partkey").alias("appid"), F.col("p_brand").alias("title"), (F.col("p_retailprice").cast("int") + (F.col("p_size") > 25).cast("int")).alias("reviews"), F.lit(0).alias("place"))
    return catalog.best_per_key(e.select("appid", "title", "reviews", F.lit(1).alias("place")).unionByName(again))


@query(f"WITH {_TITLES} SELECT game, pool_n FROM titles ORDER BY pool_n DESC, game LIMIT 20")
def largest_pools(spark, d):
    return _titles(spark, d).select("game", "pool_n").orderBy(F.desc("pool_n"), "game").limit(20)
