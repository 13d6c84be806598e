"""Queries over the smaller operators; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions.rates import pacific_day
from tallyfield.operators import review_tools as T
from tallyfield.plans import oracles as O
from tallyfield.plans.registry import query
from tallyfield.sources import adapters as A


@query("SELECT doc_id % 50 AS claim, doc_id AS rid, CAST(row_number() OVER (PARTITION BY doc_id % 50 ORDER BY CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END, doc_id) AS INTEGER) AS place FROM documents")
def annotated_first(spark, d):
    k = F.col("doc_id")
    notes = F.when(k % 3 == 0, F.array(F.lit("all_caps"))).otherwise(F.array().cast("array<string>"))
    return T.annotated_first(A.table(spark, d, "documents").select((k % 50).alias("claim"), k.alias("rid"), k.alias("pos"), notes.alias("annotations")))


@query("SELECT id, ledger FROM (SELECT event_id AS id, event_type AS ledger, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p <= 36")
def keep_last(spark, d):
    return T.keep_last(A.request_log(spark, d), 36).select("id", "ledger")


@query("SELECT doc_id // 4 AS case_id, arg_min(CASE WHEN toxic = 1 THEN 'unsafe' WHEN quality = 0 THEN 'weak' ELSE 'routine' END, CASE WHEN toxic = 1 THEN 1 WHEN quality = 0 THEN 2 ELSE 3 END) AS reason FROM labels GROUP BY 1")
def validation_shortlist(spark, d):
    rows = A.table(spark, d, "labels")
    reason = F.when(F.col("toxic") == 1, "unsafe").when(F.col("quality") == 0, "weak").otherwise("routine")
    priority = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).otherwise(3)
    return T.shortlist(rows.select(F.floor(F.col("doc_id") / 4).alias("case_id"), reason.alias("reason"), priority.alias("priority")))


_DAY = O.pacific("ts", "%Y-%m-%d")


@query(f"""WITH a AS (SELECT {_DAY} AS day, count(*) AS used FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT {_DAY} AS day, count(*) AS used FROM events WHERE event_id % 2 = 1 AND event_id % 5 <> 0 GROUP BY 1 HAVING count(*) % 3 <> 0)
 SELECT day, greatest(a.used, b.used) AS used FROM a FULL JOIN b USING (day)""")
def reconciled_days(spark, d):
    log = A.request_log(spark, d).withColumn("day", pacific_day(F.col("ts")))
    count = lambda df: df.groupBy("day").agg(F.count("*").alias("used"))
    return T.reconcile(count(log.where("id % 2 = 0")), count(log.where("id % 2 = 1 AND id % 5 <> 0")).where("used % 3 <> 0"))


@query(f"SELECT {_DAY} AS day, least(12, min(CASE WHEN event_type = 'error' THEN CAST(value AS INTEGER) END)) AS ceiling FROM events GROUP BY 1")
def lowered_ceiling(spark, d):
    log = A.request_log(spark, d)
    return T.lowered_ceiling(log.select(pacific_day(F.col("ts")).alias("day"), F.when(F.col("ledger") == "error", F.round("cost").cast("int")).alias("reported")))


@query("SELECT user_id AS appid, event_id % 7 AS run, arg_min(CASE WHEN event_id % 3 <> 0 THEN event_id % 20 END, (event_id % 3 = 0, event_id)) AS actual FROM events GROUP BY 1, 2")
def settled_runs(spark, d):
    i = F.col("id")
    return T.settle(A.request_log(spark, d).select(F.col("key").alias("appid"), (i % 7).alias("run"), F.when(i % 3 != 0, i % 20).alias("actual"), i.alias("seen")))


#: Failure codes with and without names, unknown ones, and some that only begin like known ones.
_CODES = [
    "ids_not_in_corpus:1", "ids_not_in_corpus:1,2,3", "ids_not_in_corpus", "cited_outside_bucket:2", "cited_outside_bucket:", "low_union_coverage", "low_union_coverage:0.1", "only_0_supporting_citations",
    "only_1_supporting_citations", "only", "only_12", "prevalence_language:ratio", "prevalence_language:percentage,ratio in words", "prevalence_language:a:b", "prevalence_language", "prevalence_language_too:x", "prevalence", "other:code",
    "other", "", "Only_1", " only_1", "low_union", "ids_not_in_corpus_2:7",
]
_KNOWN = r"regexp_extract(c, '^(only|[a-z_]+)', 1)"


@query(f"""WITH e AS (SELECT event_id AS id, [{", ".join(f"'{c}'" for c in _CODES)}][event_id % {len(_CODES)} + 1] AS c FROM events)
 SELECT id, c AS code, CASE {_KNOWN} WHEN 'ids_not_in_corpus' THEN 'it cites reviews that do not exist' WHEN 'cited_outside_bucket' THEN 'it cites reviews of another cohort' WHEN 'low_union_coverage' THEN 'the cited reviews do not mention it'
 WHEN 'only' THEN 'too few of the cited reviews mention it' WHEN 'prevalence_language' THEN 'it says how many people think so (' || CASE WHEN contains(c, ':') THEN substr(c, strpos(c, ':') + 1) ELSE '' END || ')' ELSE c END AS sentence FROM e""")
def explained_failures(spark, d):
    code = F.get(F.array(*map(F.lit, _CODES)), (F.col("id") % len(_CODES)).cast("int"))
    return A.request_log(spark, d).select("id", code.alias("code"), T.explain(code).alias("sentence"))


@query(f"SELECT user_id AS key, {_DAY} AS day, count(*) AS model_calls, count(*) || ' calls charged on ' || {_DAY} AS basis FROM events GROUP BY 1, 2")
def cost_blocks(spark, d):
    return T.cost_block(A.request_log(spark, d))


@query("SELECT c_custkey AS game, c_custkey || ': ' || c_mktsegment AS title, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS description FROM customer")
def metadata_cards(spark, d):
    tagline = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(" ")
    return T.card(A.table(spark, d, "customer").select(F.col("c_custkey").alias("game"), F.col("c_mktsegment").alias("word"), tagline.alias("tagline")))
