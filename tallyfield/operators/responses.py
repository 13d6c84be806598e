"""What is wrong with a written response, beyond its header: rules over its cohorts, claims and flags, as joins.

Every rule yields rows (game, code) of its own; nothing is looked up in a list that grows with the table, and a response
without a code is usable. A response that answers nothing isn't, since each live cohort with claims, and each flag, has to
be answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.text import has_bare_digit, prevalence_hits
from tallyfield.package import cut


def _coded(rows: DataFrame, code: Column) -> DataFrame:
    return rows.select("game", code.alias("code")).where("code IS NOT NULL")


def _prose(rows: DataFrame, label: Column, text: Column) -> DataFrame:
    """Digits, and statements about how many people, in a piece of prose; the latter with what was said."""
    said = F.array_sort(F.array_distinct(prevalence_hits(text)["match"]))
    codes = F.array(F.when(has_bare_digit(text), F.concat(F.lit("digit_in_prose:"), label)), F.when(F.size(said) > 0, F.concat(F.lit("prevalence:"), label, F.lit(":"), F.array_join(said, ","))))
    return rows.select("game", F.explode(F.array_compact(codes)).alias("code"))


def check_response(answers: DataFrame, cohorts: DataFrame, claims: DataFrame, flags: DataFrame) -> DataFrame:
    """game, code of everything that is wrong with the responses. `answers` has game, cohorts (an array of bucket, summary,
    claim_ids) and flag_sentences (an array of flag_id, sentence), `cohorts` game, bucket, muted, `claims` game, claim_id,
    bucket, and `flags` game, flag_id: what was asked for. A code is told as often as it occurs."""
    name = lambda c: F.coalesce(c, F.lit("None"))
    told = cut(answers.select("game", F.posexplode("cohorts").alias("at", "c")).select("game", "at", F.col("c.bucket").alias("bucket"), F.col("c.summary").alias("summary"), F.col("c.claim_ids").alias("claim_ids")))
    spoken = cut(answers.select("game", F.explode("flag_sentences").alias("f")).select("game", "f.flag_id", "f.sentence"))
    asked, given = answers.select("game").distinct(), lambda df, *keys: df.select("game", *keys).distinct()

    live = cohorts.where(~F.col("muted")).join(given(claims, "bucket"), ["game", "bucket"], "left_semi").join(asked, "game", "left_semi")
    unanswered = _coded(live.join(given(told, "bucket"), ["game", "bucket"], "left_anti"), F.concat(F.lit("cohort_not_answered:"), "bucket"))
    undescribed = _coded(flags.join(asked, "game", "left_semi").join(given(spoken, "flag_id"), ["game", "flag_id"], "left_anti"), F.concat(F.lit("flag_not_described:"), "flag_id"))
    unknown_flag = _coded(spoken.join(given(flags, "flag_id"), ["game", "flag_id"], "left_anti"), F.concat(F.lit("unknown_flag_id:"), name(F.col("flag_id"))))

    placed = cut(told.join(cohorts.select("game", "bucket", "muted"), ["game", "bucket"], "left"))
    holds = (F.size(F.coalesce("claim_ids", F.array().cast("array<string>"))) > 0) | (F.trim(F.coalesce("summary", F.lit(""))) != "")
    unknown_bucket = F.when(F.col("muted").isNull(), F.concat(F.lit("unknown_bucket:"), name(F.col("bucket"))))
    misplaced = _coded(placed, unknown_bucket.otherwise(F.when(F.col("muted") & holds, F.concat(F.lit("muted_cohort_has_content:"), "bucket"))))

    # a claim that comes again is told where it is right otherwise, and after its first place
    used = placed.where(~F.col("muted")).select("game", "bucket", "at", F.posexplode("claim_ids").alias("k", "claim_id"))
    known = claims.groupBy("game", "claim_id").agg(F.max("bucket").alias("home"))
    used = used.withColumn("times", F.row_number().over(Window.partitionBy("game", "claim_id").orderBy("at", "k"))).join(known, ["game", "claim_id"], "left")
    moved = F.concat(F.lit("claim_moved_cohort:"), "claim_id", F.lit("(from "), "home", F.lit(" to "), "bucket", F.lit(")"))
    wrong = (
        F.when(F.col("home").isNull(), F.concat(F.lit("unknown_claim_id:"), name(F.col("claim_id"))))
        .when(F.col("home") != F.col("bucket"), moved)
        .when(F.col("times") > 1, F.concat(F.lit("claim_reused:"), "claim_id"))
    )
    parts = [
        undescribed,
        unknown_flag,
        misplaced,
        _coded(used, wrong),
        _prose(told, F.concat(F.lit("summary["), name(F.col("bucket")), F.lit("]")), F.coalesce("summary", F.lit(""))),
        _prose(spoken, F.concat(F.lit("flag["), name(F.col("flag_id")), F.lit("]")), F.coalesce("sentence", F.lit(""))),
    ]
    found = unanswered
    for part in parts:
        found = found.unionByName(part)
    return found
