"""Parts of the SQL that checks the queries."""

from __future__ import annotations

from tallyfield import config as C

BUCKET = "CASE WHEN {m} >= 0 AND {m} < 120 THEN 'refund_window' WHEN {m} >= 120 AND {m} < 1200 THEN 'early' WHEN {m} >= 1200 AND {m} < 6000 THEN 'mid' WHEN {m} >= 6000 THEN 'veteran' ELSE 'unknown' END"
RANK = "CASE {b} WHEN 'refund_window' THEN 1 WHEN 'early' THEN 2 WHEN 'mid' THEN 3 WHEN 'veteran' THEN 4 ELSE 5 END"
MINUTES = "CAST((l_quantity - 1) * 150 AS INTEGER)"
FACT = f"""fact AS (SELECT l_orderkey * 10 + l_linenumber AS rid, l_suppkey AS game, {MINUTES} AS minutes, {BUCKET.format(m=MINUTES)} AS bucket,
  (l_orderkey * 31 + l_linenumber * 17) % 100 < 50 + l_suppkey % 50 AS voted_up, l_shipdate AS created, l_returnflag AS source_filter,
  l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus FROM lineitem)"""
COUNTS = "counts AS (SELECT game, bucket, count(*) AS pool_n, count(*) FILTER (voted_up) AS positive FROM fact GROUP BY 1, 2)"
RATES = f"""{FACT}, {COUNTS}, rates AS (SELECT game, bucket, pool_n, round(100e0 * pool_n / sum(pool_n) OVER (PARTITION BY game), 1) AS share_of_pool_pct,
  round(100e0 * positive / pool_n, 1) AS pct_positive FROM counts)"""
MEAN = """means AS (SELECT game, round(sum(pct_positive * pool_n) FILTER (bucket IN ('early', 'mid', 'veteran') AND pool_n >= 30) / sum(pool_n) FILTER (bucket IN ('early', 'mid', 'veteran') AND pool_n >= 30), 4) AS mean_pct
  FROM rates GROUP BY 1)"""
WORD = "CASE WHEN mean_pct >= 89 THEN 'Buy' WHEN mean_pct < 64 THEN 'Skip' WHEN mean_pct IS NOT NULL THEN 'Wait' END"
ORDER = "created, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, source_filter, l_linestatus"
POOL = f"""{FACT}, firsts AS (SELECT *, row_number() OVER (PARTITION BY game, rid ORDER BY {ORDER}) AS rn FROM fact),
  sweeps AS (SELECT game, rid, source_filter, min(rn) AS first_rn, count(*) AS k FROM firsts GROUP BY 1, 2, 3),
  pool AS (SELECT game, rid, CAST(sum(k) AS BIGINT) AS n_seen, list(source_filter ORDER BY first_rn) AS source_filters FROM sweeps GROUP BY 1, 2)"""
_D = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
TEXT = f"""texts AS (SELECT d.doc_id AS rid, source AS game, n_chars AS minutes, {BUCKET.format(m="n_chars")} AS bucket, quality = 1 AS voted_up, text, d.doc_id % 7 AS votes_up, d.doc_id % 11 AS votes_funny, lang FROM {_D})"""
_LEET = "translate(lower(text), '013457@$', 'oieastas')"


def _bodies(terms: list[str]) -> str:
    return "|".join("".join(c + "+" for c in t) + C.SUFFIX for t in terms)


def classified(blocked: list[str], soft: list[str]) -> str:
    around = r"(?i)(^|[^\p{L}\p{N}_])(?:%s)($|[^\p{L}\p{N}_])"
    return rf"""{TEXT}, w AS (SELECT *, list_filter(string_split_regex(regexp_replace(text, '\[/?[a-zA-Z][^\]]{{0,40}}\]', ' ', 'g'), '\s+'), lambda x: x <> '') AS words,
  length(text) - length(replace(text, '♥', '')) AS hearts, length(regexp_replace(text, '[^\p{{L}}\s]', '', 'g')) AS alpha,
  length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS upper FROM texts),
c AS (SELECT *, CASE WHEN hearts >= 3 AND hearts / length(text) >= 0.02 THEN 'heart_density' WHEN regexp_matches({_LEET}, '{around % _bodies(blocked)}') THEN 'blocked_term'
  WHEN votes_funny > votes_up AND votes_funny >= 2 THEN 'joke_review' WHEN len(words) < 5 THEN 'low_information' WHEN length(text) > 20 AND alpha / length(text) < 0.6 THEN 'low_information'
  WHEN len(words) >= 5 AND len(list_distinct(list_transform(words, lambda x: lower(x)))) / len(words) < 0.35 THEN 'low_information' END AS reason,
  regexp_matches({_LEET}, '{around % "|".join(t for t in soft if t not in blocked)}') AS soft FROM w)"""


def tokens(text: str) -> str:
    stop = "[" + ", ".join("'" + w + "'" for w in sorted(C.STOPWORDS)) + "]"
    useful = f"lambda x: length(x) >= 4 AND NOT list_contains({stop}, x)"
    plural = "lambda x: CASE WHEN length(x) > 4 AND x LIKE '%ies' THEN x[:-4] || 'y' WHEN length(x) > 3 AND x LIKE '%es' THEN x[:-3] WHEN length(x) > 3 AND x LIKE '%s' THEN x[:-2] ELSE x END"
    tense = "lambda x: CASE WHEN length(x) > 5 AND x LIKE '%ing' THEN x[:-4] WHEN length(x) > 5 AND x LIKE '%ed' THEN x[:-3] ELSE x END"
    return f"list_distinct(list_filter(list_transform(list_transform(list_filter(string_split_regex(lower({text}), '[^a-z0-9'']+'), {useful}), {plural}), {tense}), {useful}))"


ALIKE = "(c = r OR (length(c) >= 4 AND length(r) >= 4 AND (c[:4] = r[:4] OR contains(c, r) OR contains(r, c))))"


def pacific(ts: str, form: str) -> str:
    return f"strftime(timezone('America/Los_Angeles', timezone('UTC', {ts})), '{form}')"


#: For RE2, which has no lookaround: superlatives go before "most" is looked for.
PREVALENCE = [
    (p.replace("(?<!the )", "").split(r"(?!\s+(?:polished")[0] if "(?<!the )" in p else p.split(r"(?!\s+(?:mission")[0], label) for p, label in C.PREVALENCE
]
