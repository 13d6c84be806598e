"""Every query of the review engine by name, with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield import config as C
from tallyfield.functions import rates as R
from tallyfield.functions import text as X
from tallyfield.functions.broadcasts import small
from tallyfield.operators import serving as serving_operators
from tallyfield.operators.documents import LABELS as documents_labels
from tallyfield.operators.documents import cohort_label
from tallyfield.operators import catalog, claims, evals, filtering, ledger, pool, publish, sourcing, typeahead, verdict
from tallyfield.plans import oracles as O
from tallyfield.sources import adapters as A
from tallyfield.package import cut, shared_folder
from tallyfield.sources.files import memo_key
from tallyfield.streaming import facts, limits, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Words of the test texts that stand in for the side-input lists.
BLOCKED, SOFT = ["scum", "moron"], ["idiot", "trash", "clown", "stupid"]
NOW = "1998-06-01"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {O.RATES}, {O.MEAN} SELECT game, mean_pct, {O.WORD} AS word FROM means")
def verdict_words(spark, d):
    return verdict.post_refund_mean(pool.pool_rates(A.fact_reviews(spark, d)))


@query(f"WITH {O.FACT}, {O.COUNTS} SELECT g.game, b.bucket, coalesce(pool_n, 0) AS pool_n FROM (SELECT DISTINCT game FROM fact) g CROSS JOIN (VALUES ('refund_window'), ('early'), ('mid'), ('veteran')) b(bucket) LEFT JOIN counts USING (game, bucket)")
def bucket_counts(spark, d):
    return pool.bucket_counts(A.fact_reviews(spark, d))


@query(f"WITH {O.RATES} SELECT * FROM rates")
def pool_rates(spark, d):
    return pool.pool_rates(A.fact_reviews(spark, d))


@query(f"WITH {O.POOL} SELECT game, rid, minutes, voted_up, created, n_seen, array_to_string(source_filters, '+') AS source_filters FROM firsts JOIN pool USING (game, rid) WHERE rn = 1")
def pool_dedup(spark, d):
    rows = pool.dedup_pool(A.fact_reviews(spark, d))
    return rows.select("game", "rid", "minutes", "voted_up", "created", "n_seen", F.array_join("source_filters", "+").alias("source_filters"))


@query(f"WITH {O.POOL} SELECT array_to_string(source_filters, '+') AS source_filters, count(*) AS n FROM pool GROUP BY 1")
def source_histogram(spark, d):
    rows = pool.dedup_pool(A.fact_reviews(spark, d))
    return rows.groupBy(F.array_join("source_filters", "+").alias("source_filters")).agg(F.count("*").alias("n"))


_SPLIT = f"""split AS (SELECT game, count(*) FILTER (recent) AS recent_n, round(100e0 * count(*) FILTER (recent AND voted_up) / nullif(count(*) FILTER (recent), 0), 1) AS recent_pct,
 count(*) FILTER (NOT recent) AS older_n, round(100e0 * count(*) FILTER (NOT recent AND voted_up) / nullif(count(*) FILTER (NOT recent), 0), 1) AS older_pct
 FROM (SELECT *, created >= TIMESTAMP '{NOW}' - INTERVAL 365 DAY AS recent FROM fact) GROUP BY 1)"""


def _split(spark, d):
    return pool.temporal_split(A.fact_reviews(spark, d), F.lit(NOW).cast("timestamp_ntz"))


@query(f"WITH {O.FACT}, {_SPLIT} SELECT *, round(recent_pct - older_pct, 1) AS delta_pts FROM split")
def temporal_split(spark, d):
    return _split(spark, d)


_LIFE = "CASE WHEN game % 2 = 0 THEN 50e0 ELSE 75e0 END"


@query(f"""WITH {O.FACT}, {_SPLIT} SELECT game, CASE WHEN recent_pct - {_LIFE} > 0 THEN 'improved' ELSE 'declined' END AS direction, round(recent_pct - {_LIFE}, 1) AS delta_pts,
 CASE WHEN older_n >= 100 THEN older_pct END AS older_pct FROM split WHERE recent_n >= 150 AND abs(round(recent_pct - {_LIFE}, 1)) >= 8""")
def recency_shift(spark, d):
    split = _split(spark, d).drop("delta_pts")
    return verdict.recency_shift(split, split.select("game", F.when(F.col("game") % 2 == 0, 50.0).otherwise(75.0).alias("lifetime_pct")))


def _primary(spark, d, lines=None):
    return _first_sweep(pool.numbered(pool.dedup_pool(A.fact_reviews(spark, d, lines)), F.col("created")))


def _first_sweep(rows):
    return rows.select("game", "rid", "bucket", F.element_at("source_filters", 1).alias("primary"), "seq")


def _by_game(spark, d, whole, parts):
    """whole(rows) of the games whose rows fit one task; parts(rows) of the others. The former meet once, as bare lines,
    since what is derived from them would have to travel, too."""
    lines = A.table(spark, d, "lineitem")
    large = cut(pool.large_games(lines.select(F.col("l_suppkey").alias("large"))))
    none = large.isEmpty()
    same = F.col("l_suppkey").eqNullSafe(F.col("large"))
    rest = (lines if none else lines.join(small(large), same, "left_anti")).repartition("l_suppkey")
    out = whole(_first_sweep(pool.numbered_whole(pool.dedup_pool(A.fact_reviews(spark, d, rest), met=True))))
    return out if none else out.unionByName(parts(_primary(spark, d, lines.join(small(large), same, "left_semi"))))


def _quota_sql(target: int, quota: int, filters: list[str]) -> str:
    """sample, from pb (game, rid, bucket, prim, seq)."""
    queue = " ".join(f"WHEN '{f}' THEN {i + 1}" for i, f in enumerate(filters))
    return f"""q AS (SELECT *, CASE prim {queue} ELSE {len(filters) + 1} END AS queue, row_number() OVER (PARTITION BY game, bucket, prim ORDER BY seq) AS turn FROM pb),
 k AS (SELECT *, row_number() OVER (PARTITION BY game, bucket ORDER BY turn, queue, prim) <= {quota} AS chosen FROM q),
 l AS (SELECT *, row_number() OVER (PARTITION BY game, bucket, chosen ORDER BY queue, prim, turn) AS lt, {target} - sum(CAST(chosen AS INTEGER)) OVER (PARTITION BY game) AS short FROM k),
 e AS (SELECT *, row_number() OVER (PARTITION BY game, chosen ORDER BY lt, {O.RANK.format(b="bucket")}) AS extra FROM l),
 s AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY seq) AS place FROM e WHERE chosen OR extra <= short), sample AS (SELECT game, rid, bucket, seq FROM s WHERE place <= {target})"""


_SEQ = f"pb AS (SELECT game, rid, bucket, source_filter AS prim, row_number() OVER (PARTITION BY game ORDER BY {O.ORDER}, rid) - 1 AS seq FROM firsts WHERE rn = 1)"
_QUOTA = f"{O.POOL}, {_SEQ}, {_quota_sql(150, 40, ['R', 'A'])}"


@query(f"WITH {O.POOL}, {_SEQ} SELECT game, rid, prim AS \"primary\", seq FROM pb")
def first_seen_order(spark, d):
    return _primary(spark, d).select("game", "rid", "primary", "seq")


@query(f"WITH {_QUOTA} SELECT * FROM sample")
def quota_sample(spark, d):
    sample = lambda rows: pool.quota_sample(rows, 150, 40, ["R", "A"])
    return _by_game(spark, d, sample, sample)


@query(f"""WITH {_QUOTA}, i AS (SELECT game, bucket, count(*) AS in_pool FROM pb GROUP BY 1, 2), k2 AS (SELECT game, bucket, count(*) AS kept FROM sample GROUP BY 1, 2)
 SELECT game, bucket, coalesce(kept, 0) AS kept, in_pool, CAST(floor(coalesce(kept, 0) * 100 / in_pool) AS BIGINT) AS kept_pct FROM i LEFT JOIN k2 USING (game, bucket)""")
def sample_report(spark, d):
    args = 150, 40, ["R", "A"]
    return _by_game(spark, d, lambda rows: pool.sample_report_whole(rows, *args), lambda rows: pool.sample_report(pool.quota_sample(rows, *args), rows))


@query(f"""WITH {O.FACT}, {O.COUNTS} SELECT g.game, min(coalesce(pool_n, 0)) >= 10 AS quotas_met, sum(CASE WHEN b.bucket = 'refund_window' THEN coalesce(pool_n, 0) ELSE 0 END) > 0 AS has_refunds
 FROM (SELECT DISTINCT game FROM fact) g CROSS JOIN (VALUES ('refund_window'), ('early'), ('mid'), ('veteran')) b(bucket) LEFT JOIN counts USING (game, bucket) GROUP BY 1""")
def quotas_met(spark, d):
    return pool.quotas_met(A.fact_reviews(spark, d), 10)


@query(f"""WITH {O.FACT}, s AS (SELECT game, count(*) AS n, count(*) FILTER (bucket = 'refund_window') AS r, count(*) FILTER (bucket = 'early') AS e, count(*) FILTER (bucket = 'mid') AS m, count(*) FILTER (bucket = 'veteran') AS v FROM fact GROUP BY 1),
 t AS (SELECT game, round(v / n, 3) AS veteran_share, r AS refund_n, (r >= 20)::INT + (e >= 20)::INT + (m >= 20)::INT + (v >= 20)::INT AS eligible FROM s)
 SELECT *, eligible < 2 OR veteran_share > 0.60 AS thin FROM t""")
def cohort_structure(spark, d):
    return pool.cohort_structure(A.fact_reviews(spark, d))


_FAR = f"""{O.RATES}, q AS (SELECT game, list(bucket ORDER BY {O.RANK.format(b="bucket")}) AS names, list(pct_positive ORDER BY {O.RANK.format(b="bucket")}) AS p, list(pool_n ORDER BY {O.RANK.format(b="bucket")}) AS ns FROM rates WHERE pool_n >= 30 AND bucket <> 'unknown' GROUP BY 1 HAVING count(*) >= 2),
 s AS (SELECT *, list_transform(range(1, len(p)), lambda i: round(p[i + 1] - p[i], 1)) AS steps, list_position(p, list_max(p)) AS hi, list_position(p, list_min(p)) AS lo FROM q WHERE round(list_max(p) - list_min(p), 1) >= 25),
 u AS (SELECT *, len(list_filter(steps, lambda x: x > 3)) > 0 AS up, len(list_filter(steps, lambda x: x < -3)) > 0 AS down FROM s),
 v AS (SELECT *, round(list_max(p) - list_min(p), 1) AS gap_pts, CASE WHEN NOT up AND NOT down THEN 'flat' WHEN up AND NOT down THEN 'monotonic_increase' WHEN down AND NOT up THEN 'monotonic_decrease'
 WHEN hi > 1 AND hi < len(p) THEN 'rise_then_fall' WHEN lo > 1 AND lo < len(p) THEN 'fall_then_rise' ELSE 'mixed' END AS shape FROM u),
 y AS (SELECT *, CASE WHEN shape = 'rise_then_fall' THEN names[hi] END AS peak_cohort, CASE WHEN shape = 'rise_then_fall' THEN names[hi - 1 + list_position(p[hi:], list_min(p[hi:]))] END AS after_peak_cohort,
  CASE WHEN shape = 'rise_then_fall' THEN round(list_max(p) - list_min(p[hi:]), 1) END AS drop_after_peak_pts, CASE WHEN shape = 'fall_then_rise' THEN names[lo] END AS trough_cohort FROM v)""".replace("fact AS (", "fact0 AS (").replace(
    "FROM fact GROUP", "FROM (SELECT * REPLACE ((rid * 31) % 100 < 50 + (game * 7) % 45 - abs(minutes // 90 - (game * 11) % 80) // 2 * (game % 3 - 1) AS voted_up) FROM fact0) GROUP"
)


def _far_apart(spark, d):
    """Games whose votes rise, fall or bend with the time played, each in its own way."""
    game, played = F.col("game"), F.floor(F.col("minutes") / 90)
    bent = 50 + (game * 7) % 45 - F.floor(F.abs(played - (game * 11) % 80) / 2) * (game % 3 - 1)
    return verdict.cohort_divergence(pool.pool_rates(A.fact_reviews(spark, d).withColumn("voted_up", (F.col("rid") * 31) % 100 < bent)))


@query(f"WITH {_FAR} SELECT game, array_to_string(names, ',') AS cohorts, gap_pts, shape, names[lo] AS low_cohort, names[hi] AS high_cohort, peak_cohort, after_peak_cohort, drop_after_peak_pts, trough_cohort FROM y")
def cohort_divergence(spark, d):
    return _far_apart(spark, d).drop("sequence")


_SHOWN = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in documents_labels.items()) + " END"


@query(f"""WITH {_FAR} SELECT game, 'segmentation [' || shape || '], spread ' || printf('%.1f', gap_pts) || ' pts: ' || array_to_string(list_transform(range(1, len(p) + 1), lambda i: {_SHOWN.format("names[i]")} || ' ' || printf('%.1f', p[i]) || '% (pool_n ' || ns[i] || ')'), ' -> ')
 || CASE shape WHEN 'rise_then_fall' THEN '; peaks at ' || {_SHOWN.format("peak_cohort")} || ' and falls ' || printf('%.1f', drop_after_peak_pts) || ' pts to ' || {_SHOWN.format("after_peak_cohort")} WHEN 'fall_then_rise' THEN '; troughs at ' || {_SHOWN.format("trough_cohort")} ELSE '' END AS line FROM y""")
def divergence_lines(spark, d):
    return serving_operators.describe_divergence(_far_apart(spark, d), cohort_label)


_CLASS = O.classified(BLOCKED, SOFT)


def _classified(spark, d):
    return filtering.classify(A.text_reviews(spark, d), BLOCKED, SOFT)


@query(f"WITH {_CLASS} SELECT rid, reason FROM c")
def classify_reviews(spark, d):
    return _classified(spark, d).select("rid", "reason")


@query(f"""WITH {_CLASS} SELECT rid, array_to_string(list_sort(list_filter([CASE WHEN hearts > 0 THEN 'hearts_present' END, CASE WHEN length(text) > 30 AND letters > 0 AND upper / letters > 0.7 THEN 'all_caps' END,
 CASE WHEN soft THEN 'profanity_soft' END, CASE WHEN reason = 'blocked_term' THEN 'blocked_term' END], lambda x: x IS NOT NULL)), ',') AS annotations FROM c""")
def annotations(spark, d):
    return _classified(spark, d).select("rid", F.array_join(F.array_sort("annotations"), ",").alias("annotations"))


_REASONS = ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in ("heart_density", "blocked_term", "joke_review", "low_information"))


@query(f"""WITH {_CLASS}, s AS (SELECT game, CASE WHEN grouping(bucket) = 1 THEN 'all' ELSE bucket END AS bucket, count(*) AS n_in, count(*) FILTER (reason IS NULL) AS kept, {_REASONS} FROM c GROUP BY GROUPING SETS ((game, bucket), (game))),
 p AS (SELECT *, n_in - kept AS dropped, round(100e0 * (n_in - kept) / n_in, 1) AS drop_pct FROM s)
 SELECT p.*, p.kept < 20 AS muted, p.bucket <> 'all' AND round(p.drop_pct - o.drop_pct, 1) > 10 AS disproportionate FROM p JOIN p o ON o.game = p.game AND o.bucket = 'all'""")
def filter_report(spark, d):
    return filtering.filter_report(_classified(spark, d))


def _pct(part: str, whole: str) -> str:
    return f"round(100e0 * {part} / nullif({whole}, 0), 1)"


@query(f"""WITH {_CLASS}, s AS (SELECT game, bucket, count(*) AS n_pre, count(*) FILTER (voted_up) AS a, count(*) FILTER (reason IS NULL) AS n_post, count(*) FILTER (reason IS NULL AND voted_up) AS b,
 count(*) FILTER (reason = 'low_information') AS n_low_information, count(*) FILTER (reason = 'low_information' AND voted_up) AS l FROM c GROUP BY 1, 2),
 t AS (SELECT game, bucket, n_pre, {_pct('a', 'n_pre')} AS pct_pre, n_post, {_pct('b', 'n_post')} AS pct_post, {_pct('(a - b)', '(n_pre - n_post)')} AS pct_dropped, n_low_information, {_pct('l', 'n_low_information')} AS pct_low_information FROM s)
 SELECT *, round(pct_post - pct_pre, 1) AS delta_pts, coalesce(abs(round(pct_post - pct_pre, 1)) > 3 AND least(n_pre, n_post) >= 30, false) AS warn FROM t""")
def sentiment_shift(spark, d):
    return filtering.sentiment_shift(_classified(spark, d))


_STRIPPED = r"regexp_replace(text, '(?i)\bthe most\b|\bmost\s+(?:polished|fun|important|common\s+complaint)', ' ', 'g')"
_LABELS = ", ".join(f"CASE WHEN regexp_matches({_STRIPPED if chr(92) + 'bmost' in p else 'text'}, '(?i){p}') THEN '{label}' END" for p, label in O.PREVALENCE)


_MATCHES = " + ".join(f"len(regexp_extract_all({_STRIPPED if chr(92) + 'bmost' in p else 'text'}, '(?i){p}'))" for p, _ in O.PREVALENCE)


@query(f"SELECT doc_id AS rid, array_to_string(list_sort(list_distinct(list_filter([{_LABELS}], lambda x: x IS NOT NULL))), ',') AS labels, CAST({_MATCHES} AS INTEGER) AS matches FROM documents")
def prevalence_guard(spark, d):
    hits = A.table(spark, d, "documents").select(F.col("doc_id").alias("rid"), X.prevalence_hits(F.col("text")).alias("hits"))
    return hits.select("rid", F.array_join(F.array_sort(F.array_distinct("hits.label")), ",").alias("labels"), F.size("hits").alias("matches"))


@query(rf"SELECT doc_id AS rid, regexp_matches(regexp_replace(text, '{C.PLATFORM}', '', 'g'), '\d') AS digit FROM documents")
def bare_digits(spark, d):
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("rid"), X.has_bare_digit(F.col("text")).alias("digit"))


#: Words of the run by which a claim is looked for in a text; no claim has fewer.
_RUN = 4


def _cited(spark, d):
    """Claims from the benchmark with the documents that hold them, word by word: those that have the hash of a claim's
    first words among the hashes of their runs, then by the whole claim. Only ids and hashes travel before that."""
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(split(c), " "), F.lit(" "))
    items = A.table(spark, d, "benchmark").select(F.col("item_id").alias("claim_key"), F.col("text").alias("claim"), split(F.col("text")).alias("w"))
    run_at = lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(_RUN)])
    first = items.select(F.col("claim_key").alias("key"), spaced(F.col("claim")).alias("words"), run_at(F.lit(0)).alias("run"))
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("rid"), "text")
    rows = docs.select("rid", split(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - _RUN, F.lit(0)))
    maybe = cut(rows.select("rid", F.explode(F.transform(starts, run_at)).alias("run")).join(small(first.select("key", "run")), "run").select("key", "rid").distinct())
    texts = docs.join(small(maybe.select(F.col("rid").alias("of")).distinct()), F.col("rid") == F.col("of"), "left_semi").select(F.col("rid").alias("of"), spaced(F.col("text")).alias("body"))
    both = maybe.join(texts, F.col("rid") == F.col("of")).join(first.select(F.col("key").alias("k"), "words"), F.col("key") == F.col("k")).where(F.contains("body", "words"))
    cited = both.groupBy("key").agg(F.array_sort(F.collect_set("rid")).alias("ids"))
    rows = items.join(cited, F.col("claim_key") == F.col("key"), "left")
    return cut(rows.select("claim_key", "claim", F.lit("mid").alias("bucket"), F.concat(F.coalesce("ids", F.array().cast("array<bigint>")), F.array(F.col("claim_key") * 3)).alias("ids")))


_SPACED = "array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), ' ')"
_GROUND = f"""i AS (SELECT item_id, text AS claim, ' ' || {_SPACED} || ' ' AS words FROM benchmark), dl AS (SELECT doc_id, ' ' || {_SPACED} || ' ' AS body FROM documents),
 cid AS (SELECT item_id, doc_id AS rid FROM i JOIN dl ON contains(body, words) UNION ALL SELECT item_id, item_id * 3 FROM i),
 ct AS (SELECT item_id, claim, {O.tokens("claim")} AS ct FROM i), rt AS (SELECT doc_id, {O.BUCKET.format(m="n_chars")} AS bucket, {O.tokens("text")} AS rt FROM documents WHERE doc_id IN (SELECT rid FROM cid)),
 h AS (SELECT cid.item_id, cid.rid, rt.doc_id, rt.bucket, ct.ct, rt.rt, CASE WHEN len(ct.ct) > 0 THEN round(len(list_filter(ct.ct, lambda c: len(list_filter(coalesce(rt.rt, []), lambda r: {O.ALIKE})) > 0)) / len(ct.ct), 3) ELSE 0 END AS share
   FROM cid JOIN ct USING (item_id) LEFT JOIN rt ON rt.doc_id = cid.rid)"""


@query(f"WITH {_GROUND} SELECT item_id AS claim_key, rid, share FROM h WHERE doc_id IS NOT NULL")
def token_coverage(spark, d):
    told = _cited(spark, d)
    cited = told.select("claim_key", F.explode("ids").alias("rid"))
    docs = A.table(spark, d, "documents").join(small(cited.select(F.col("rid").alias("cited")).distinct()), F.col("doc_id") == F.col("cited"), "left_semi")
    reviews = cut(docs.select(F.col("doc_id").alias("rid"), X.tokens(F.col("text")).alias("tokens")))
    return claims.coverages(cited, told.select("claim_key", X.tokens(F.col("claim")).alias("tokens")), reviews)[0]


_ITEM_LABELS = _LABELS.replace("text", "i.claim")


@query(f"""WITH {_GROUND}, u AS (SELECT item_id, string_agg(DISTINCT CASE WHEN bucket <> 'mid' THEN CAST(rid AS VARCHAR) END, ',' ORDER BY CASE WHEN bucket <> 'mid' THEN CAST(rid AS VARCHAR) END) AS outside,
   string_agg(DISTINCT CASE WHEN doc_id IS NULL THEN CAST(rid AS VARCHAR) END, ',' ORDER BY CASE WHEN doc_id IS NULL THEN CAST(rid AS VARCHAR) END) AS missing,
   list_distinct(flatten(list(coalesce(rt, [])))) AS un, count(*) FILTER (doc_id IS NOT NULL AND share >= 0.10) AS supporting FROM h GROUP BY 1),
 v AS (SELECT u.*, CASE WHEN len(ct) > 0 THEN round(len(list_filter(ct, lambda c: len(list_filter(un, lambda r: {O.ALIKE})) > 0)) / len(ct), 3) ELSE 0 END AS uc,
   array_to_string(list_sort(list_distinct(list_filter([{_ITEM_LABELS}], lambda x: x IS NOT NULL))), ',') AS people FROM u JOIN ct USING (item_id) JOIN i USING (item_id)),
 f AS (SELECT item_id, uc, supporting, array_to_string(list_filter(['ids_not_in_corpus:' || missing, 'cited_outside_bucket:' || outside, CASE WHEN uc < 0.25 THEN 'low_union_coverage' END,
   CASE WHEN supporting < 2 THEN 'only_' || supporting || '_supporting_citations' END, CASE WHEN people <> '' THEN 'prevalence_language:' || people END], lambda x: x IS NOT NULL), ';') AS failures FROM v)
 SELECT item_id AS claim_key, uc AS union_coverage, supporting, failures, failures = '' AS passed FROM f""")
def grounding(spark, d):
    return claims.ground(_cited(spark, d), A.text_reviews(spark, d))


@query(f"""WITH {O.TEXT}, k AS (SELECT item_id, trim(text) AS claim, [CAST(item_id AS VARCHAR), CAST(item_id * 7 AS VARCHAR), CAST(item_id * 90 AS VARCHAR), CAST(item_id AS VARCHAR)] AS raw FROM benchmark),
 e AS (SELECT DISTINCT ON (item_id, rid) item_id, claim, rid, pos FROM (SELECT item_id, claim, unnest(raw) AS rid, unnest(range(4)) AS pos FROM k) ORDER BY item_id, rid, pos),
 j AS (SELECT e.*, t.rid IS NOT NULL AS known, t.voted_up FROM e LEFT JOIN texts t ON CAST(t.rid AS VARCHAR) = e.rid),
 g AS (SELECT claim, coalesce(string_agg(rid, ',' ORDER BY pos) FILTER (known), '') AS ids, count(*) FILTER (known) AS n, count(*) FILTER (NOT known) AS un, count(*) FILTER (voted_up) AS positive, count(*) FILTER (NOT voted_up) AS negative FROM j GROUP BY item_id, claim)
 SELECT 'ear-' || sha1(claim)[:6] AS claim_id, CASE WHEN un > 0 AND n = 0 THEN 'all_ids_unknown' WHEN n < 2 THEN 'under_two_supporting_reviews' END AS reason, ids, positive, negative,
 CASE WHEN positive + negative = 0 THEN 'unknown' WHEN 3 * positive >= 2 * (positive + negative) THEN 'positive' WHEN 3 * negative >= 2 * (positive + negative) THEN 'negative' ELSE 'mixed' END AS citation_verdict FROM g""")
def claim_enforce(spark, d):
    key = F.col("item_id")
    ids = F.array(*[F.concat(F.lit(" "), (key * k).cast("string")) for k in (1, 7, 90, 1)])
    rows = A.table(spark, d, "benchmark").select(F.lit("g").alias("game"), F.lit("early").alias("bucket"), F.col("text").alias("claim"), ids.alias("ids"))
    out = claims.enforce(rows, A.text_reviews(spark, d).withColumn("game", F.lit("g")))
    return out.select("claim_id", "reason", F.array_join("supporting_ids", ",").alias("ids"), "positive", "negative", "citation_verdict")


_LIKE = "len(k.t) > 0 AND len(x.t) > 0 AND len(list_filter(x.t, lambda c: len(list_filter(k.t, lambda r: {}))  > 0)) / greatest(len(k.t), len(x.t), 1) >= 0.5".format(O.ALIKE)
_KEPT = "STRUCT(seq BIGINT, claim VARCHAR, n BIGINT, t VARCHAR[])[]"


@query(f"""WITH c AS (SELECT item_id % 5 AS g, item_id AS seq, text AS claim, item_id % 4 AS n, {O.tokens("text")} AS t FROM benchmark),
 l AS (SELECT g, list({{'kept': CAST([] AS {_KEPT}), 'seq': CAST(seq AS BIGINT), 'claim': claim, 'n': CAST(n AS BIGINT), 't': t}} ORDER BY seq) AS items FROM c GROUP BY 1),
 m AS (SELECT g, unnest(list_reduce(items, lambda a, x: {{'kept': CASE WHEN coalesce(list_position(list_transform(a.kept, lambda k: {_LIKE}), true), 0) = 0 THEN list_append(a.kept, {{'seq': x.seq, 'claim': x.claim, 'n': x.n, 't': x.t}})
   ELSE list_transform(a.kept, lambda k, i: CASE WHEN i = list_position(list_transform(a.kept, lambda k: {_LIKE}), true) AND x.n > k.n THEN {{'seq': x.seq, 'claim': x.claim, 'n': x.n, 't': x.t}} ELSE k END) END, 'seq': x.seq, 'claim': x.claim, 'n': x.n, 't': x.t}},
   {{'kept': CAST([] AS {_KEPT}), 'seq': CAST(0 AS BIGINT), 'claim': '', 'n': CAST(0 AS BIGINT), 't': CAST([] AS VARCHAR[])}}).kept) AS k FROM l)
 SELECT g AS "group", k.seq AS seq, k.claim AS claim, k.n AS n_ids FROM m""")
def fuzzy_merge(spark, d):
    rows = A.table(spark, d, "benchmark").select((F.col("item_id") % 5).alias("group"), F.col("item_id").alias("seq"), F.col("text").alias("claim"), (F.col("item_id") % 4).alias("n_ids"))
    return claims.merge_similar(rows)


_TEXT_SAMPLE = f"""{O.TEXT}, pb AS (SELECT game, rid, bucket, lang AS prim, rid AS seq FROM texts), {_quota_sql(60, 20, ['en', 'de'])}"""


#: The two turns of a prompt.
_SYSTEM, _USER = "You read reviews of {cohort_label} players ({cohort_range}).", "Game: {game}\nCohort: {cohort_label}, {cohort_range}\n\n{reviews}"
_HOURS = "CASE bucket WHEN 'refund_window' THEN '0-2 hours played' WHEN 'early' THEN '2-20 hours played' WHEN 'mid' THEN '20-100 hours played' WHEN 'veteran' THEN '100+ hours played' END"
_LABEL = "CASE bucket WHEN 'refund_window' THEN '<2h refund window' WHEN 'early' THEN '2-20h' WHEN 'mid' THEN '20-100h' WHEN 'veteran' THEN '100h+' END"


@query(rf"""WITH {_TEXT_SAMPLE}, t AS (SELECT s.game, s.bucket, s.seq, s.rid, trim(regexp_replace(text, '\s+', ' ', 'g')) AS plain, voted_up, minutes FROM sample s JOIN texts USING (rid)),
 u AS (SELECT *, '[' || rid || '] (' || printf('%.1f', round(minutes / 60e0, 1)) || 'h, ' || CASE WHEN voted_up THEN 'recommends' ELSE 'does not recommend' END || ') '
   || CASE WHEN length(plain) > 1500 THEN plain[:1500] || ' ...[truncated]' ELSE plain END AS line FROM t)
 SELECT game, bucket, 'You read reviews of ' || {_LABEL} || ' players (' || {_HOURS} || ').' AS system, sha256('Game: ' || game || chr(10) || 'Cohort: ' || {_LABEL} || ', ' || {_HOURS} || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY seq)) AS user_sha256,
 sha256(string_agg(line, chr(10) || chr(10) ORDER BY seq)) AS prompt_sha256 FROM u GROUP BY 1, 2""")
def extraction_prompts(spark, d):
    reviews = A.text_reviews(spark, d)
    chosen = pool.quota_sample(reviews.select("game", "rid", "bucket", F.col("lang").alias("primary"), F.col("rid").alias("seq")), 60, 20, ["en", "de"])
    texts = reviews.select(F.col("rid").alias("of"), "text", "voted_up", F.round(F.col("minutes") / 60, 1).alias("hours"))
    turns = claims.build_prompts(chosen.join(texts, F.col("rid") == F.col("of")), _SYSTEM, _USER)
    told = F.element_at(F.split("user", "\n\n", 2), 2)
    return turns.select("game", "bucket", "system", F.sha2("user", 256).alias("user_sha256"), F.sha2(told, 256).alias("prompt_sha256"))


#: The reviews that count as cited are those that one of the sweeps saw.
_CITE = "fact.source_filter = 'R'"


_LAST = ", ".join(f"{x} DESC" for x in O.ORDER.split(", "))


def _citations(spark, d):
    return A.fact_reviews(spark, d).where("source_filter = 'R'")


@query(f"""WITH {O.RATES}, o AS (SELECT game, bucket, rid, voted_up AS up FROM (SELECT *, row_number() OVER (PARTITION BY game, bucket, rid ORDER BY {_LAST}) AS back FROM fact WHERE {_CITE}) WHERE back = 1), s AS (SELECT game, bucket, count(*) AS n, count(*) FILTER (up) AS k FROM o GROUP BY 1, 2),
 t AS (SELECT s.*, pct_positive / 100 AS p FROM s JOIN rates USING (game, bucket)),
 q AS (SELECT game, bucket, n, k, p, least(1, CASE WHEN p <= 0 THEN 1 WHEN p >= 1 THEN (k >= n)::INT ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)))) END) AS dp FROM t)
 SELECT game, bucket, n AS cited_reviews, k AS cited_recommend, CASE WHEN dp = 0 THEN 0 ELSE round(dp * pow(10, 2 - floor(log10(dp)))) / pow(10, 2 - floor(log10(dp))) END AS divergence_p,
 CASE WHEN n <= 4 AND dp < 0.05 / 1077 THEN 'thin,divergent' WHEN n <= 4 THEN 'thin' WHEN dp < 0.05 / 1077 THEN 'divergent' ELSE '' END AS triggers, CASE WHEN n <= 4 OR dp < 0.05 / 1077 THEN 'escalated' ELSE 'baseline' END AS level FROM q""")
def binomial_sourcing(spark, d):
    return sourcing.sourcing(_citations(spark, d), pool.pool_rates(A.fact_reviews(spark, d)))


_NAMED = "bucket IN ('refund_window', 'early', 'mid', 'veteran')"


@query(f"""WITH {O.FACT}, a AS (SELECT game, bucket, count(*) AS na, count(*) FILTER (voted_up) AS ua FROM fact WHERE {_NAMED} GROUP BY 1, 2), c AS (SELECT game, bucket, count(*) AS nc, count(*) FILTER (voted_up) AS uc FROM fact WHERE {_CITE} AND {_NAMED} GROUP BY 1, 2),
 aa AS (SELECT game, sum(na) AS na, sum(ua) AS ua FROM a GROUP BY 1), cc AS (SELECT game, sum(nc) AS nc, sum(uc) AS uc FROM c GROUP BY 1), w AS (SELECT game, na, ua, nc, uc FROM aa JOIN cc USING (game) WHERE na >= 20 AND nc >= 10),
 r AS (SELECT game, 'all' AS bucket, na, ua, nc, uc FROM w UNION ALL SELECT game, bucket, na, ua, nc, uc FROM a JOIN c USING (game, bucket) WHERE na >= 10 AND nc >= 5 AND game IN (SELECT game FROM w))
 SELECT game, bucket, round(100e0 * ua / na, 1) AS available_pct, round(100e0 * uc / nc, 1) AS cited_pct, round(100e0 * uc / nc - 100e0 * ua / na, 1) + 0 AS delta, CAST(na AS BIGINT) AS n_available, CAST(nc AS BIGINT) AS n_cited FROM r""")
def claim_balance(spark, d):
    return sourcing.claim_balance(A.fact_reviews(spark, d), _citations(spark, d))


_DELTA = f"""{O.RATES}, o AS (SELECT game, bucket, rid, voted_up AS up FROM (SELECT *, row_number() OVER (PARTITION BY game, bucket, rid ORDER BY {_LAST}) AS back FROM fact WHERE {_CITE}) WHERE back = 1),
 s AS (SELECT game, bucket, count(*) AS cited_n, round(100e0 * count(*) FILTER (up) / count(*), 1) AS cited_pct FROM o GROUP BY 1, 2),
 dl AS (SELECT game, bucket, cited_n, cited_pct, pct_positive AS pool_pct, round(cited_pct - pct_positive, 1) + 0 AS delta_pool FROM s JOIN rates USING (game, bucket))"""


def _deltas(spark, d):
    return sourcing.source_delta(_citations(spark, d), pool.pool_rates(A.fact_reviews(spark, d)))


@query(f"WITH {_DELTA} SELECT * FROM dl")
def source_delta(spark, d):
    return _deltas(spark, d)


@query(f"""WITH {_DELTA}, r AS (SELECT delta_pool AS x, row_number() OVER (ORDER BY delta_pool) AS i, count(*) OVER () AS n FROM dl WHERE delta_pool IS NOT NULL),
 z AS (SELECT *, greatest(1, least(n - 1, (n + 1) // 10)) AS j FROM r), q AS (SELECT *, (n + 1) - j * 10 AS tenths FROM z)
 SELECT n, round(avg(x), 3) AS mean, round(median(x), 3) AS median, min(x) AS least, round(CASE WHEN n = 1 THEN min(x) ELSE sum(CASE WHEN i = j THEN x * (10 - tenths) WHEN i = j + 1 THEN x * tenths ELSE 0 END) / 10 END, 3) AS p10,
 count(*) FILTER (x <= -40) AS below_40, count(*) FILTER (x <= -50) AS below_50, count(*) FILTER (x <= -60) AS below_60 FROM q GROUP BY n""")
def delta_summary(spark, d):
    return sourcing.delta_summary(_deltas(spark, d))


_HTML = r"""chunk AS (SELECT page_id, unnest(string_split(html, '<a ')[2:]) AS c, unnest(range(0, len(string_split(html, '<a ')) - 1)) AS pos FROM pages),
 hr AS (SELECT page_id, pos, regexp_extract(c, 'href="([^"]*)"', 1) AS href, trim(replace(replace(replace(replace(replace(regexp_extract(c, '>([^<]*)</a>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS title FROM chunk),
 ho AS (SELECT *, CASE WHEN href = '' THEN 'no_address' WHEN title = '' THEN 'empty_title' WHEN NOT starts_with(href, '/') THEN 'external' ELSE 'parsed' END AS outcome FROM hr)"""


@query(f"WITH {_HTML} SELECT * FROM ho")
def html_rows(spark, d):
    return catalog.html_rows(A.table(spark, d, "pages"))


@query(f"WITH {_HTML} SELECT outcome, count(*) AS n FROM ho GROUP BY 1")
def row_accounting(spark, d):
    return catalog.row_accounting(catalog.html_rows(A.table(spark, d, "pages")))


_RANKED = "ranked AS (SELECT p_partkey AS appid, p_name AS title, CAST(trunc(p_retailprice) AS INTEGER) AS reviews, p_type AS kind, p_size AS size, row_number() OVER (ORDER BY trunc(p_retailprice) DESC, p_partkey) AS rank, CASE WHEN trunc(p_retailprice) >= 1000 THEN 'core' ELSE 'tail' END AS shard FROM part WHERE trunc(p_retailprice) >= 70)"


@query(f"WITH {_RANKED} SELECT appid, title, reviews, rank, shard FROM ranked")
def catalog_rank(spark, d):
    return catalog.rank_entries(catalog.best_per_key(A.catalog_entries(spark, d)))


@query(f"""WITH {_RANKED}, f AS (SELECT appid, rank, size % 3 = 0 AS live, appid % 11 = 0 AS have, appid % 13 = 0 AS duplicate FROM ranked),
 a AS (SELECT *, coalesce(sum((NOT duplicate AND NOT have AND live)::INT) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lb FROM f),
 b AS (SELECT *, NOT duplicate AND NOT have AND (NOT live OR lb < 15) AS fits FROM a), c AS (SELECT *, coalesce(sum(fits::INT) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
 SELECT appid, rank, live, CASE WHEN duplicate THEN 'dropped' WHEN fits THEN 'chosen' ELSE 'skipped' END AS outcome, CASE WHEN fits THEN CASE WHEN before < 40 THEN 1 ELSE 2 END END AS night FROM c WHERE before < 100 AND (duplicate OR NOT have)""")
def catalog_select(spark, d):
    entries = A.catalog_entries(spark, d)
    ranked = catalog.rank_entries(entries).join(entries.select("appid", "size"), "appid")
    flagged = ranked.select("appid", "rank", (F.col("size") % 3 == 0).alias("live"), (F.col("appid") % 11 == 0).alias("have"), (F.col("appid") % 13 == 0).alias("duplicate"))
    return catalog.select_capped(flagged, 100, 15, 40)


@query(f"""WITH {_RANKED}, n AS (SELECT appid, title, rank, trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g')) AS t FROM ranked),
 m AS (SELECT *, CASE WHEN t = 'red ring' THEN 0 WHEN starts_with(t, 'red ring') THEN 1 WHEN strpos(t, 'red ring') > 1 THEN CASE WHEN t[strpos(t, 'red ring') - 1] = ' ' THEN 2 ELSE 3 END END AS tier FROM n)
 SELECT appid, title, rank, tier FROM m WHERE tier IS NOT NULL ORDER BY tier, rank LIMIT 8""")
def search_topk(spark, d):
    return catalog.search(catalog.rank_entries(A.catalog_entries(spark, d)), " RED  ring")


@query(f"""WITH {_RANKED}, n AS (SELECT appid, title, rank, trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g')) AS t FROM ranked),
 k AS (SELECT DISTINCT title[:i] AS query FROM ranked, range(1, 60) AS r(i) WHERE i <= length(title)), q AS (SELECT query, trim(regexp_replace(lower(strip_accents(query)), '[^a-z0-9]+', ' ', 'g')) AS q FROM k),
 d AS (SELECT DISTINCT q FROM q WHERE q <> ''),
 m AS (SELECT q, appid, title, rank, CASE WHEN t = q THEN 0 WHEN starts_with(t, q) THEN 1 WHEN t[strpos(t, q) - 1] = ' ' THEN 2 ELSE 3 END AS tier FROM d JOIN n ON contains(t, q)),
 p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, rank, appid) AS place FROM m) SELECT query, place, appid, title, rank, tier FROM q JOIN p USING (q) WHERE place <= 8""")
def typeahead_prefixes(spark, d):
    """Every beginning of every title, as it is typed."""
    index = cut(catalog.rank_entries(A.catalog_entries(spark, d)))
    typed = F.transform(F.sequence(F.lit(1), F.greatest(F.length("title"), F.lit(1))), lambda i: F.col("title").substr(F.lit(1), i))
    return typeahead.typeahead(index, index.select(F.explode(typed).alias("query")).distinct())


_DAMAGED = f"""{_RANKED}, dm AS (SELECT appid, CASE WHEN size = 29 THEN upper(title) ELSE title END AS title, CASE WHEN size = 13 THEN 10 ELSE reviews END AS reviews, rank + CASE WHEN size = 19 THEN 1 ELSE 0 END AS rank, CASE WHEN size = 11 THEN 'tail' ELSE shard END AS shard FROM ranked WHERE size <> 17
 UNION ALL SELECT appid, title, reviews, rank, shard FROM ranked WHERE size = 7)"""


@query(f"""WITH {_DAMAGED}, o AS (SELECT reviews > lag(reviews) OVER (ORDER BY rank, appid, reviews DESC) AS bad FROM dm),
 sp AS (SELECT s.p_partkey AS appid, max(t.title) AS has, max(s.p_name) AS title FROM part s LEFT JOIN dm t ON t.appid = s.p_partkey WHERE s.p_size IN (5, 23, 29) AND trunc(s.p_retailprice) >= 70 GROUP BY 1)
 SELECT 'duplicate_ids' AS problem, count(*) - count(DISTINCT appid) AS n FROM dm UNION ALL SELECT 'below_floor', count(*) FILTER (reviews < 70) FROM dm
 UNION ALL SELECT 'wrong_shard', count(*) FILTER ((shard = 'core') <> (reviews >= 1000)) FROM dm UNION ALL SELECT 'rank_gaps', max(rank) - count(*) FROM dm
 UNION ALL SELECT 'out_of_order', count(*) FILTER (bad) FROM o UNION ALL SELECT 'unaccounted', (SELECT count(*) FROM part WHERE trunc(p_retailprice) >= 70) - count(DISTINCT appid) FROM dm
 UNION ALL SELECT 'missing_seeds', count(*) FROM part WHERE p_size IN (17, 31) AND p_partkey NOT IN (SELECT appid FROM dm)
 UNION ALL SELECT 'spot_absent', count(*) FILTER (has IS NULL) FROM sp UNION ALL SELECT 'spot_title', count(*) FILTER (has <> title) FROM sp""")
def index_verify(spark, d):
    """An index with doubled rows, a row without its reviews, a wrong shard, a shifted rank, wrong titles, and rows that are
    missing; some sizes of parts are its seeds, and others its known pairs."""
    entries = A.catalog_entries(spark, d)
    size = F.col("size")
    index = cut(catalog.rank_entries(entries)).join(entries.select("appid", "size"), "appid")
    damaged = index.where(size != 17).select(
        "appid",
        F.when(size == 29, F.upper("title")).otherwise(F.col("title")).alias("title"),
        F.when(size == 13, 10).otherwise(F.col("reviews")).alias("reviews"),
        (F.col("rank") + (size == 19).cast("int")).alias("rank"),
        F.when(size == 11, "tail").otherwise(F.col("shard")).alias("shard"),
    )
    broken = damaged.unionByName(index.where(size == 7).select("appid", "title", "reviews", "rank", "shard"))
    spots = entries.where(size.isin(5, 23, 29) & (F.col("reviews") >= C.REVIEW_FLOOR)).select("appid", "title")
    return catalog.verify_index(broken, entries, entries.where(size.isin(17, 31)).select("appid"), spots)


_SNAP = """b AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS generated FROM orders WHERE o_orderkey % 3 <> 0),
 m AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN o_orderdate WHEN o_orderkey % 4 = 1 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 1 DAY END AS generated FROM orders WHERE o_orderkey % 5 <> 0),
 y AS (SELECT b.key, CASE WHEN b.generated IS NULL THEN 'unreadable' WHEN m.generated IS NULL THEN 'absent' WHEN b.generated > m.generated THEN 'newer' WHEN b.generated = m.generated THEN 'same' ELSE 'older' END AS why FROM b LEFT JOIN m USING (key))"""


def _snapshots(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("generated"))
    day, key, stamp = F.expr("INTERVAL 1 DAY"), F.col("key"), F.col("generated")
    moved = F.when(key % 13 == 0, None).when(key % 4 == 0, stamp).when(key % 4 == 1, stamp - day).otherwise(stamp + day)
    return o.where("key % 3 <> 0").withColumn("generated", F.when(key % 11 != 0, stamp)), o.where("key % 5 <> 0").withColumn("generated", moved)


@query(f"WITH {_SNAP} SELECT key, why IN ('absent', 'newer') AS take, why FROM y")
def publish_select(spark, d):
    return publish.select_publishable(*_snapshots(spark, d))


@query(f"""WITH {_SNAP}, k AS (SELECT key, CASE WHEN why IN ('absent', 'newer') THEN 'publishable:' || why WHEN why <> 'older' THEN why WHEN o.o_orderdate IS NULL THEN 'no_promotion_date'
 WHEN epoch(TIMESTAMP '1996-01-01') - epoch(o.o_orderdate) < 48 * 3600 THEN 'inside_deploy_window' END AS keep_because FROM y LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) o ON o.o_orderkey = key)
 SELECT key, keep_because IS NULL AS prune, keep_because FROM k""")
def prune(spark, d):
    branch, main = _snapshots(spark, d)
    seen = A.table(spark, d, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("ts"))
    return publish.prune(branch, main, seen, F.lit("1996-01-01").cast("timestamp_ntz"))


@query(f"WITH {_CLASS} SELECT game, count(*) AS citations, count(*) FILTER (h) AS hits, bool_or(h) AS withheld FROM (SELECT game, " + r"regexp_matches(translate(lower(text), '013457@$', 'oieastas'), '(?i)(^|[^\p{L}\p{N}_])(?:" + O._bodies(BLOCKED) + r")($|[^\p{L}\p{N}_])') AS h FROM c) GROUP BY 1")
def qr4_gate(spark, d):
    return publish.safety_gate(A.text_reviews(spark, d), BLOCKED)


@query(f"SELECT {O.pacific('ts', '%Y-%m-%d')} AS day, event_type AS ledger, count(*) AS requests, round(sum(value), 2) AS cost FROM events GROUP BY 1, 2")
def ledger_daily(spark, d):
    return ledger.daily(A.request_log(spark, d))


@query(f"SELECT user_id AS key, {O.pacific('ts', '%Y-%m-%d %H')} AS hour, count(*) AS requests, count(*) > 5 AS over_limit FROM events GROUP BY 1, 2")
def hourly_tally(spark, d):
    return ledger.hourly(A.request_log(spark, d))


@query(f"SELECT {O.pacific('ts', '%Y-%m-%d')} AS day, count(*) FILTER (event_type = 'click' AND value > 499) = 0 AS conserved FROM events GROUP BY 1")
def ledger_conserved(spark, d):
    """Ledgers that missed the dearest clicks."""
    log = A.request_log(spark, d)
    return ledger.conserved(ledger.daily(log.where("NOT (ledger = 'click' AND cost > 499)")), log)


@query(f"""WITH t AS (SELECT {O.pacific('ts', '%Y-%m-%d')} AS day, event_id AS place, event_id % 14 AS calls FROM events), s AS (SELECT *, CAST(coalesce(sum(calls) OVER (PARTITION BY day ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent_before FROM t)
 SELECT *, 400 - spent_before >= 13 AS admitted FROM s""")
def budget_stop(spark, d):
    titles = A.request_log(spark, d).select(R.pacific_day(F.col("ts")).alias("day"), F.col("id").alias("place"), (F.col("id") % 14).alias("calls"))
    return ledger.budget_stop(titles, C.DAILY_BUDGET)


@query("""WITH e AS (SELECT event_id AS id, event_type AS ledger, epoch_us(ts) AS us FROM events) SELECT id, ledger, count(*) OVER w AS in_window, count(*) OVER w > 12 AS over FROM e WINDOW w AS (PARTITION BY ledger ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)""")
def trailing_rate(spark, d):
    return ledger.trailing(A.request_log(spark, d), 3600)


@query(f"SELECT {O.pacific('ts', '%Y-%m-%d')} AS day, CAST(greatest(0, sum(13) - sum(CASE WHEN event_id % 3 <> 0 THEN 13 - event_id % 17 ELSE 0 END)) AS BIGINT) AS effective FROM events GROUP BY 1")
def effective_used(spark, d):
    rows = A.request_log(spark, d).select(R.pacific_day(F.col("ts")).alias("day"), F.lit(C.RESERVED).alias("used"), F.when(F.col("id") % 3 != 0, F.col("id") % 17).alias("actual"))
    return ledger.effective_used(rows)


@query(f"SELECT {O.pacific('ts', '%Y-%m-%d')} AS day, count(*) AS attempted, count(*) FILTER (event_type = 'purchase') AS published, CAST(sum(event_id % 14) AS BIGINT) AS calls, round(avg(event_id % 40), 3) AS mean_seconds FROM events GROUP BY 1")
def batch_summary(spark, d):
    ok = F.when(F.col("ledger") == "purchase", "ok").otherwise("stopped")
    rows = A.request_log(spark, d).select(R.pacific_day(F.col("ts")).alias("day"), ok.alias("outcome"), (F.col("id") % 14).alias("calls"), (F.col("id") % 40).alias("seconds"))
    return ledger.batch_summary(rows)


_SAMPLES = "s AS (SELECT r AS round, doc_id AS rid FROM documents CROSS JOIN (VALUES (2), (3), (5)) v(r) WHERE doc_id % r = 0)"


@query(f"WITH {_SAMPLES} SELECT x.round AS a, y.round AS b, count(*) AS shared FROM s x JOIN s y USING (rid) WHERE x.round < y.round GROUP BY 1, 2")
def overlap_rounds(spark, d):
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("rid"), F.explode(F.array(*map(F.lit, (2, 3, 5)))).alias("round"))
    return evals.overlap(docs.where("rid % round = 0"))


@query(f"""WITH {O.TEXT}, t AS (SELECT rid, bucket, row_number() OVER (PARTITION BY bucket ORDER BY sha256('audit:' || rid), rid) AS turn FROM texts), p AS (SELECT rid, bucket, row_number() OVER (ORDER BY turn, bucket) AS place FROM t WHERE turn <= 20)
 SELECT * FROM p WHERE place <= 20""")
def stratified_audit(spark, d):
    return evals.stratified_sample(A.text_reviews(spark, d), 20, "audit")


_TITLES = f"{O.RATES}, {O.MEAN}, tn AS (SELECT game, sum(pool_n) AS pool_n FROM rates GROUP BY 1), titles AS (SELECT game, game % 3 + 1 AS night, mean_pct AS pct, {O.WORD} AS word, pool_n, CASE WHEN mean_pct < 80 THEN 0 WHEN mean_pct < 86 THEN 1 WHEN mean_pct < 90 THEN 2 WHEN mean_pct < 101 THEN 3 END AS band FROM means JOIN tn USING (game))"


def _titles(spark, d):
    rates = pool.pool_rates(A.fact_reviews(spark, d))
    sums = rates.groupBy("game").agg(F.sum("pool_n").alias("pool_n"))
    return verdict.post_refund_mean(rates).join(sums, "game").select("game", (F.col("game") % 3 + 1).alias("night"), F.col("mean_pct").alias("pct"), "word", "pool_n")


@query(f"WITH {_TITLES} SELECT night, band, count(*) AS n, round(100e0 * count(*) FILTER (word = 'Buy') / count(*), 1) AS buy_pct, round(sum(pct * pool_n) / sum(pool_n), 3) AS weighted_pct FROM titles GROUP BY 1, 2")
def night_bands(spark, d):
    return evals.night_bands(_titles(spark, d))


@query(f"""WITH {_TITLES}, r AS (SELECT band, count(*) FILTER (word = 'Buy') / count(*) AS rate FROM titles WHERE night = 1 GROUP BY 1), g AS (SELECT night, band, count(*) AS n, count(*) FILTER (word = 'Buy') AS b FROM titles GROUP BY 1, 2)
 SELECT night, CAST(sum(n) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS actual, round(sum(n * coalesce(rate, 0)), 4) AS expected FROM g LEFT JOIN r USING (band) GROUP BY 1""")
def standardised_share(spark, d):
    return evals.standardised(_titles(spark, d), 1)


_CASES = """lv AS (SELECT doc_id // 3 AS case_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'full' WHEN quality = 1 THEN 'partial' ELSE 'none' END AS level FROM labels),
 cs AS (SELECT case_id, count(*) FILTER (level = 'full') AS f, count(*) FILTER (level = 'partial') AS p FROM lv GROUP BY 1), sc AS (SELECT case_id, CASE WHEN f >= 2 THEN 2 WHEN f = 1 THEN 1 WHEN p >= 2 THEN 1 ELSE 0 END AS score, f = 0 AND p = 1 AS gap FROM cs)"""


def _cases(spark, d):
    level = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "full").when(F.col("quality") == 1, "partial").otherwise("none")
    return evals.case_scores(A.table(spark, d, "labels").select(F.floor(F.col("doc_id") / 3).alias("case_id"), level.alias("level")))


@query(f"WITH {_CASES} SELECT * FROM sc")
def eval_scores(spark, d):
    return _cases(spark, d)


@query(f"""WITH {_CASES}, x AS (SELECT score, 'g' || case_id % 4 AS game, 'c' || case_id % 3 AS cohort FROM sc)
 SELECT CASE WHEN grouping(game) = 0 THEN 'game' WHEN grouping(cohort) = 0 THEN 'cohort' ELSE 'all' END AS by, coalesce(game, cohort, 'all') AS name, count(*) AS n, round(avg(score), 3) AS mean, count(*) FILTER (score = 2) AS twos, count(*) FILTER (score = 1) AS ones, count(*) FILTER (score = 0) AS zeros
 FROM x GROUP BY GROUPING SETS ((game), (cohort), ())""")
def eval_breakdown(spark, d):
    part = lambda letter, n: F.concat(F.lit(letter), (F.col("case_id") % n).cast("string"))
    return evals.score_breakdown(_cases(spark, d).select("score", part("g", 4).alias("game"), part("c", 3).alias("cohort")))


def _documents(spark, d):
    rates = pool.pool_rates(A.fact_reviews(spark, d)).withColumn("muted", F.col("pool_n") < C.MIN_SURVIVORS)
    cited = A.fact_reviews(spark, d).groupBy("game", "bucket", "rid").agg(F.min("source_filter").alias("theme"))
    rows = cited.select("game", "bucket", "theme", F.col("rid").alias("seq"), F.concat(F.lit("c"), F.col("rid").cast("string")).alias("claim_id"), F.lit("").alias("claim"))
    return verdict.assemble(rates, verdict.post_refund_mean(rates), rows)


@query(f"WITH {O.RATES} SELECT DISTINCT game, bucket, theme, 'c' || rid AS claim_id FROM (SELECT game, bucket, rid, min(source_filter) AS theme FROM fact GROUP BY 1, 2, 3) JOIN rates USING (game, bucket) WHERE pool_n >= 20")
def document_claims(spark, d):
    return verdict.citations_of(_documents(spark, d))


@query(f"""WITH {O.RATES}, {O.MEAN} SELECT game, {O.WORD} AS word, s.pool_n, s.cohort_count FROM means JOIN (SELECT game, CAST(sum(pool_n) AS BIGINT) AS pool_n, count(*) FILTER (pool_n >= 20) AS cohort_count FROM rates GROUP BY 1) s USING (game)""")
def document_footers(spark, d):
    return _documents(spark, d).select("game", "verdict.word", "footer.pool_n", "footer.cohort_count")


@query("SELECT doc_id AS rid, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '…' ELSE text END AS review_text, length(text) > 2000 AS truncated, strftime(make_timestamp(1700000000000000 + doc_id * 3600000000), '%Y-%m-%d') AS date FROM documents")
def citations(spark, d):
    docs = A.table(spark, d, "documents")
    built = verdict.build_citation(F.col("text"), F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") * 3600))
    return docs.select(F.col("doc_id").alias("rid"), built.alias("c")).select("rid", "c.*")


@query("SELECT doc_id AS rid, substr(sha256('claims' || chr(0) || coalesce(lang, chr(0) || chr(0)) || chr(0) || coalesce(text, chr(0) || chr(0))), 1, 16) AS key FROM documents")
def memo_keys(spark, d):
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("rid"), memo_key("claims", "lang", "text").alias("key"))


@query("SELECT date_trunc('hour', ts) AS start, event_type AS ledger, count(*) AS requests FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    rows = limits.run_to_end(limits.windows(limits.log_stream(spark, d)), "complete")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT DISTINCT event_id AS id FROM events")
def stream_dedup(spark, d):
    return limits.run_to_end(limits.first_seen(limits.log_stream(spark, d)).select("id"), "append")


@query(f"""WITH RECURSIVE e AS (SELECT event_id AS id, event_type AS ledger, epoch_us(ts) / 1e6 AS at_s, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
 r AS (SELECT ledger, k, id, CAST([at_s] AS DOUBLE[]) AS stamps, 0e0 AS wait FROM e WHERE k = 1
  UNION ALL SELECT ledger, k, id, list_sort(list_append(recent, begins))[-{3 * C.REQUESTS_PER_MINUTE}:], begins - at_s FROM
   (SELECT *, CASE WHEN len(recent) >= {C.REQUESTS_PER_MINUTE} THEN greatest(at_s, recent[-{C.REQUESTS_PER_MINUTE}] + 60) ELSE at_s END AS begins FROM
    (SELECT e.ledger, e.k, e.id, e.at_s, list_sort(list_filter(r.stamps, lambda s: e.at_s - s < 60)) AS recent FROM r JOIN e ON e.ledger = r.ledger AND e.k = r.k + 1)))
 SELECT id, ledger, round(wait, 6) AS wait_seconds FROM r""")
def stateful_limiter(spark, d):
    return limits.run_to_end(limits.limiter(limits.log_stream(spark, d)), "append")


#: What the watermark has passed at the end, in microseconds.
_PASSED = "(SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 FROM events)"


@query(f"""WITH e AS (SELECT event_id AS id, user_id AS key, epoch_us(ts) AS us, event_type IN ('click', 'view') AS request FROM events WHERE epoch_us(ts) < {_PASSED}),
 n AS (SELECT *, lead(us) OVER w - us AS gap, lead(request) OVER w AS again FROM e WINDOW w AS (PARTITION BY key ORDER BY us, id)),
 o AS (SELECT id, key, CASE WHEN gap <= 90000000 THEN CASE WHEN again THEN 'superseded' ELSE 'answered' END WHEN us + 90000000 < {_PASSED} THEN 'lost' END AS outcome, CASE WHEN gap <= 90000000 THEN gap / 1e6 END AS seconds FROM n WHERE request)
 SELECT * FROM o WHERE outcome IS NOT NULL""")
def unanswered_requests(spark, d):
    with state.expiring_state(spark):
        return limits.run_to_end(state.unanswered(limits.log_stream(spark, d), "ledger IN ('click', 'view')"), "append")


@query(f"""WITH e AS (SELECT event_id AS id, user_id AS key, {O.pacific('ts', '%Y-%m-%d %H')} AS hour, row_number() OVER (PARTITION BY user_id, {O.pacific('ts', '%Y-%m-%d %H')} ORDER BY ts, event_id) - 1 AS k FROM events)
 SELECT id, key, hour, CAST(least(k, 5) AS INTEGER) AS used, k < 5 AS allowed FROM e""")
def hour_admission(spark, d):
    with state.expiring_state(spark, by_clock=True):
        return limits.run_to_end(state.hour_admission(limits.log_stream(spark, d)), "append")


_FACTS = """f AS (SELECT user_id AS appid, CAST(floor(value) AS BIGINT) % 7 AS run, CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) % 15 END AS cost, ts AS stamp FROM events),
 k AS (SELECT *, row_number() OVER (PARTITION BY appid, run ORDER BY (cost IS NOT NULL) DESC, stamp DESC, cost DESC) AS place FROM f)"""


def _facts(spark, d):
    """A fact table that followed the log as a stream of runs and their costs; errors leave a cost unknown."""
    folder = f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
    log, whole = limits.log_stream(spark, d), F.floor("cost").cast("long")
    rows = log.select(F.col("key").alias("appid"), (whole % 7).alias("run"), F.when(F.col("ledger") != "error", whole % 15).alias("cost"), F.col("ts").alias("at"))
    table = facts.FactTable(spark, folder)
    facts.follow(rows, table, f"{folder}/checkpoint")
    return table.read()


@query(f"WITH {_FACTS} SELECT appid, run, cost, strftime(stamp, '%Y-%m-%d %H:%M:%S') AS seen FROM k WHERE place = 1")
def merged_facts(spark, d):
    return _facts(spark, d).select("appid", "run", "cost", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("seen"))


@query(f"WITH {_FACTS} SELECT {O.pacific('stamp', '%Y-%m-%d')} AS day, greatest(0, CAST(sum(13) - sum(CASE WHEN cost IS NOT NULL THEN 13 - cost ELSE 0 END) AS BIGINT)) AS effective FROM k WHERE place = 1 GROUP BY 1")
def merged_effective(spark, d):
    """What the days really cost: every run is charged its reservation once, and corrected by its fact, if that is known."""
    return ledger.effective_used(_facts(spark, d).select(R.pacific_day(F.col("at")).alias("day"), F.lit(C.RESERVED).alias("used"), F.col("cost").alias("actual")))


#: Models, the ledgers asked for, and messages of failed requests, on both sides of each rule.
_MODELS = ["model-flash", "model-flash-lite", "gemma", "flash-8b", "lite-flash", "", "pro"]
_ASKED = ["live", "batch", "", None]
_MESSAGES = [
    "401 key refused", "UNAUTHENTICATED: no credential", "status PERMISSION_DENIED", "API key not valid", "403 forbidden", "unauthenticated", "429 quota PerDay", "429 quota PerMinute", "429 Too Many Requests", "RESOURCE_EXHAUSTED",
    "RESOURCE_EXHAUSTED: GenerateRequestsPerDay", "RESOURCE_EXHAUSTED: perday", "500 error", "INTERNAL", "internal", "502 bad gateway", "503", "service UNAVAILABLE", "504 gateway", "DEADLINE_EXCEEDED", "timeout", "connection reset", "",
    "401 after 429", "PerDay", "unavailable", None,
]


def _values(items):
    return "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in items) + "]"


@query(f"""WITH e AS (SELECT event_id AS id, {_values(_MODELS)}[event_id % {len(_MODELS)} + 1] AS model, {_values(_ASKED)}[event_id % {len(_ASKED)} + 1] AS asked, coalesce({_values(_MESSAGES)}[event_id % {len(_MESSAGES)} + 1], '') AS m FROM events),
 r AS (SELECT *, regexp_matches(m, '429|RESOURCE_EXHAUSTED') AS many FROM e)
 SELECT id, CASE WHEN contains(model, 'flash') AND NOT contains(model, 'lite') THEN 'flash' WHEN coalesce(asked, '') = '' THEN 'batch' ELSE asked END AS ledger,
 CASE WHEN regexp_matches(m, '401|UNAUTHENTICATED|PERMISSION_DENIED') THEN 'abort' WHEN many AND NOT contains(m, 'PerDay') THEN 'retry_with_lower_ceiling'
  WHEN many OR regexp_matches(m, '503|UNAVAILABLE|500|INTERNAL|504|DEADLINE') THEN 'retry' ELSE 'raise' END AS class FROM r""")
def routing(spark, d):
    pick = lambda items: F.get(F.array(*[F.lit(x).cast("string") for x in items]), (F.col("id") % len(items)).cast("int"))
    return A.request_log(spark, d).select("id", R.ledger_for(pick(_MODELS), pick(_ASKED)).alias("ledger"), R.error_class(pick(_MESSAGES)).alias("class"))


from tallyfield.plans import documents, responses, serving, sources, tools  # noqa: E402, F401  they register their queries here
