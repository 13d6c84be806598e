"""The check of written responses, over documents that stand in for claims, with faults planted in the answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions.rates import bucket_of
from tallyfield.operators import responses
from tallyfield.plans import oracles as O
from tallyfield.plans.registry import query
from tallyfield.sources import adapters as A

#: So many documents make a response.
_BLOCK = 40


def _said(text: str) -> str:
    stripped = rf"regexp_replace({text}, '(?i)\bthe most\b|\bmost\s+(?:polished|fun|important|common\s+complaint)', ' ', 'g')"
    found = ", ".join(f"regexp_extract_all({stripped if chr(92) + 'bmost' in p else text}, '(?i){p}')" for p, _ in O.PREVALENCE)
    return f"array_to_string(list_sort(list_distinct(list_transform(flatten([{found}]), lambda x: trim(x)))), ',')"


_DIGIT = rf"regexp_matches(regexp_replace(text, '{O.C.PLATFORM}', '', 'g'), '\d')"


@query(f"""WITH l AS (SELECT DISTINCT doc_id FROM labels), b AS (SELECT d.doc_id, d.doc_id // {_BLOCK} AS game, {O.BUCKET.format(m="n_chars")} AS bucket, lang, n_chars, coalesce(text, '') AS text FROM documents d JOIN l USING (doc_id)),
 cn AS (SELECT game, bucket, count(*) AS n FROM b GROUP BY 1, 2), co AS (SELECT game, bucket, n < 2 AS muted FROM cn WHERE NOT (bucket = 'refund_window' AND n = 1)),
 u AS (SELECT game, CASE WHEN doc_id % 8 = 0 THEN 'mid' ELSE bucket END AS bucket, doc_id, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE 'c' END || doc_id AS cid, unnest(range(CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END)) AS copy, text FROM b),
 an AS (SELECT game, bucket, arg_min(text, doc_id) AS summary FROM u GROUP BY 1, 2 HAVING count(*) % 5 <> 0),
 fl AS (SELECT game, lang AS flag_id FROM b WHERE lang IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2), se AS (SELECT game, lang AS flag_id, arg_max(text, doc_id) AS sentence FROM b WHERE n_chars % 2 = 1 GROUP BY 1, 2),
 us AS (SELECT u.game, u.bucket, cid, c.bucket AS home, row_number() OVER (PARTITION BY u.game, cid ORDER BY u.bucket, u.doc_id, copy) AS times FROM u JOIN an ON an.game = u.game AND an.bucket = u.bucket JOIN co ON co.game = u.game AND co.bucket = u.bucket AND NOT muted
   LEFT JOIN b c ON c.game = u.game AND 'c' || c.doc_id = cid),
 pr AS (SELECT game, 'summary[' || bucket || ']' AS label, summary AS text FROM an UNION ALL SELECT game, 'flag[' || coalesce(flag_id, 'None') || ']', sentence FROM se), ps AS (SELECT game, label, {_DIGIT} AS digit, {_said("text")} AS said FROM pr),
 f AS (SELECT game, 'cohort_not_answered:' || bucket AS code FROM co WHERE NOT muted AND NOT EXISTS (SELECT 1 FROM an WHERE an.game = co.game AND an.bucket = co.bucket)
  UNION ALL SELECT game, 'flag_not_described:' || flag_id FROM fl WHERE NOT EXISTS (SELECT 1 FROM se WHERE se.game = fl.game AND se.flag_id = fl.flag_id)
  UNION ALL SELECT game, 'unknown_flag_id:' || coalesce(flag_id, 'None') FROM se WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.game = se.game AND fl.flag_id = se.flag_id)
  UNION ALL SELECT an.game, CASE WHEN muted IS NULL THEN 'unknown_bucket:' || an.bucket WHEN muted THEN 'muted_cohort_has_content:' || an.bucket END FROM an LEFT JOIN co ON co.game = an.game AND co.bucket = an.bucket
  UNION ALL SELECT game, CASE WHEN home IS NULL THEN 'unknown_claim_id:' || cid WHEN home <> bucket THEN 'claim_moved_cohort:' || cid || '(from ' || home || ' to ' || bucket || ')' WHEN times > 1 THEN 'claim_reused:' || cid END FROM us
  UNION ALL SELECT game, 'digit_in_prose:' || label FROM ps WHERE digit UNION ALL SELECT game, 'prevalence:' || label || ':' || said FROM ps WHERE said <> '')
 SELECT game, code, count(*) AS n FROM f WHERE code IS NOT NULL GROUP BY 1, 2""")
def checked_responses(spark, d):
    """Responses of which some move claims, make up ids, tell a claim twice, leave a cohort out or fill one that is muted."""
    marked = A.table(spark, d, "labels").select(F.col("doc_id").alias("marked")).distinct()
    docs = A.table(spark, d, "documents").join(marked, F.col("doc_id") == F.col("marked"), "left_semi")
    doc, n = F.col("doc_id"), F.col("n_chars")
    rows = docs.select(doc, F.floor(doc / _BLOCK).alias("game"), bucket_of(n).alias("bucket"), "lang", n, F.coalesce("text", F.lit("")).alias("text"))
    counts = rows.groupBy("game", "bucket").agg(F.count("*").alias("n"))
    cohorts = counts.where("NOT (bucket = 'refund_window' AND n = 1)").select("game", "bucket", (F.col("n") < 2).alias("muted"))
    copies = F.explode(F.sequence(F.lit(0), F.when(doc % 7 == 0, 1).otherwise(0)))
    cid = F.concat(F.when(doc % 9 == 0, "x").otherwise("c"), doc.cast("string"))
    used = rows.select("game", F.when(doc % 8 == 0, "mid").otherwise(F.col("bucket")).alias("bucket"), doc, cid.alias("cid"), copies.alias("copy"), "text")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "copy", "cid"))), lambda x: x["cid"])
    told = used.groupBy("game", "bucket").agg(F.min_by("text", "doc_id").alias("summary"), ids.alias("claim_ids")).where(F.size("claim_ids") % 5 != 0)
    told = told.groupBy("game").agg(F.array_sort(F.collect_list(F.struct("bucket", "summary", "claim_ids"))).alias("cohorts"))
    flags = rows.where("lang IS NOT NULL").groupBy("game", F.col("lang").alias("flag_id")).agg(F.count("*").alias("n")).where("n >= 2").select("game", "flag_id")
    spoken = rows.where(n % 2 == 1).groupBy("game", F.col("lang").alias("flag_id")).agg(F.max_by("text", "doc_id").alias("sentence"))
    spoken = spoken.groupBy("game").agg(F.collect_list(F.struct("flag_id", "sentence")).alias("flag_sentences"))
    answers = rows.select("game").distinct().join(told, "game", "left").join(spoken, "game", "left")
    claims = rows.select("game", F.concat(F.lit("c"), doc.cast("string")).alias("claim_id"), "bucket")
    return responses.check_response(answers, cohorts, claims, flags).groupBy("game", "code").agg(F.count("*").alias("n"))
