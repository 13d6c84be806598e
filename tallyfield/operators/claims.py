"""Extracted claims: enforcement, grounding and near-duplicate merging."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield import config as C
from tallyfield.functions.broadcasts import small
from tallyfield.functions.rates import citation_verdict, count_where
from tallyfield.functions.text import collapse, fuzzy_hits, prevalence, tokens
from tallyfield.operators.documents import cohort_hours, cohort_label
from tallyfield.operators.token_index import hits
from tallyfield.package import cut


def claim_id(bucket: Column, text: Column) -> Column:
    return F.concat(F.substring(F.coalesce(bucket, F.lit("x")), 1, 3), F.lit("-"), F.substring(F.sha1(text.cast("binary")), 1, 6))


def enforce(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """claim, claim_id, reason (null: kept), supporting_ids, unknown_ids, positive, negative, citation_verdict of every
    claim (game, bucket, claim, ids). Unknown ids go before the rule of two; the ids keep their order."""
    ids = F.array_distinct(F.transform(F.coalesce("ids", F.array().cast("array<string>")), lambda x: F.trim(x)))
    rows = claims.withColumn("claim", F.trim("claim")).withColumn("ids", ids)
    cited = rows.select("game", "claim", F.posexplode_outer("ids").alias("pos", "rid"))
    known = reviews.select(F.col("game").alias("of"), F.col("rid").cast("string").alias("known_rid"), "voted_up")
    found = cited.join(known, (F.col("game") == F.col("of")) & (F.col("rid") == F.col("known_rid")), "left")
    real = F.col("known_rid").isNotNull()
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "rid")))), lambda x: x["rid"])
    sums = found.groupBy("game", "claim").agg(
        listed(real).alias("supporting_ids"),
        listed(~real & F.col("rid").isNotNull()).alias("unknown_ids"),
        count_where(F.col("voted_up")).alias("positive"),
        count_where(~F.col("voted_up")).alias("negative"),
    )
    reason = F.when((F.size("unknown_ids") > 0) & (F.size("supporting_ids") == 0), "all_ids_unknown").when(F.size("supporting_ids") < 2, "under_two_supporting_reviews")
    return rows.select("game", "bucket", "claim").join(sums, ["game", "claim"]).select(
        "game",
        "bucket",
        "claim",
        claim_id(F.col("bucket"), F.col("claim")).alias("claim_id"),
        reason.alias("reason"),
        "supporting_ids",
        "unknown_ids",
        "positive",
        "negative",
        citation_verdict(F.col("positive"), F.col("negative")).alias("citation_verdict"),
    )


def coverages(cited: DataFrame, claims: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claim_key, rid, share) of each citation of a known review, and (claim_key, union_share) of each claim with any: the
    share of a claim's tokens that are alike to one of the review's, or of any of them. `cited` has claim_key, rid, `claims`
    claim_key and tokens, `reviews` rid and tokens."""
    size = F.size("tokens")
    sizes = claims.select("claim_key", size.alias("size"))
    own = claims.select(F.col("claim_key").alias("left_key"), F.explode("tokens").alias("token"))
    shown = reviews.select(F.col("rid").alias("right_key"), F.explode("tokens").alias("token"))
    found = cut(hits(cited.select(F.col("claim_key").alias("left_key"), F.col("rid").alias("right_key")), own, shown))
    share = F.round(F.when(F.col("size") > 0, F.coalesce("n", F.lit(0)) / F.col("size")).otherwise(0.0), 3)
    each = found.groupBy(F.col("left_key").alias("claim_key"), F.col("right_key").alias("rid")).agg(F.count("*").alias("n"))
    known = cited.join(reviews.select("rid"), "rid", "left_semi").select("claim_key", "rid").distinct()
    any_ = found.groupBy(F.col("left_key").alias("claim_key")).agg(F.count_distinct("token").alias("n"))
    one = known.join(sizes, "claim_key").join(each, ["claim_key", "rid"], "left").select("claim_key", "rid", share.alias("share"))
    return one, sizes.join(any_, "claim_key", "left").select("claim_key", share.alias("union_share"))


def ground(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """claim_key, union_coverage, supporting, failures and passed of every claim (claim_key, claim, bucket, ids), whose keys
    are unique. The claims' few ids are exploded and joined; only the reviews that are cited are tokenised, and their tokens
    meet those of the claims by an index."""
    told = cut(claims.select("claim_key", "claim", "bucket", "ids", tokens(F.col("claim")).alias("tokens")))
    rows = told.select("claim_key", "bucket", F.explode_outer("ids").alias("rid"))
    cited = small(rows.where("rid IS NOT NULL").select(F.col("rid").alias("cited")).distinct())
    corpus = reviews.join(cited, F.col("rid") == F.col("cited"), "left_semi")
    corpus = cut(corpus.select("rid", F.col("bucket").alias("found_bucket"), tokens(F.col("text")).alias("tokens")))
    shares, unions = coverages(rows.where("rid IS NOT NULL").select("claim_key", "rid"), told, corpus)
    found = rows.join(corpus.select(F.col("rid").alias("known"), "found_bucket"), F.col("rid") == F.col("known"), "left").join(shares, ["claim_key", "rid"], "left")
    missing, outside = F.col("rid").isNotNull() & F.col("known").isNull(), F.col("known").isNotNull() & (F.col("found_bucket") != F.col("bucket"))
    sums = found.groupBy("claim_key").agg(
        F.array_sort(F.collect_set(F.when(missing, F.col("rid").cast("string")))).alias("missing"),
        F.array_sort(F.collect_set(F.when(outside, F.col("rid").cast("string")))).alias("outside"),
        count_where(F.col("known").isNotNull() & (F.col("share") >= C.MIN_CITATION_COVERAGE)).cast("long").alias("supporting"),
    )
    sums = sums.join(told.select("claim_key", prevalence(F.col("claim")).alias("people")), "claim_key").join(unions, "claim_key").withColumnRenamed("union_share", "union_coverage")
    codes = F.array_compact(
        F.array(
            F.when(F.size("missing") > 0, F.concat(F.lit("ids_not_in_corpus:"), F.array_join("missing", ","))),
            F.when(F.size("outside") > 0, F.concat(F.lit("cited_outside_bucket:"), F.array_join("outside", ","))),
            F.when(F.col("union_coverage") < C.MIN_UNION_COVERAGE, "low_union_coverage"),
            F.when(F.col("supporting") < C.MIN_CITATIONS, F.format_string("only_%d_supporting_citations", "supporting")),
            F.when(F.size("people") > 0, F.concat(F.lit("prevalence_language:"), F.array_join("people", ","))),
        )
    )
    return sums.select("claim_key", "union_coverage", "supporting", F.array_join(codes, ";").alias("failures"), (F.size(codes) == 0).alias("passed"))


def merge_similar(claims: DataFrame) -> DataFrame:
    """The claims of each group (group, seq, claim, n_ids) after near duplicates are merged in the order of seq: the first
    kept claim that overlaps takes the new one's place or gives it its own if that has strictly more citations. A group
    is what one response claims about one cohort, a handful."""
    item = F.struct("seq", "claim", "n_ids", tokens(F.col("claim")).alias("tokens"))
    groups = claims.groupBy("group").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def like(a: Column, b: Column) -> Column:
        n = F.greatest(F.size(a["tokens"]), F.size(b["tokens"]))
        return (F.size(a["tokens"]) > 0) & (F.size(b["tokens"]) > 0) & (F.size(fuzzy_hits(b["tokens"], a["tokens"])) / F.greatest(n, F.lit(1)) >= C.MERGE_OVERLAP)

    def step(kept: Column, x: Column) -> Column:
        marks = F.transform(kept, lambda k: like(k, x))
        at = F.coalesce(F.array_position(marks, F.lit(True)), F.lit(0))
        swapped = F.transform(kept, lambda k, i: F.when((i + 1 == at) & (x["n_ids"] > k["n_ids"]), x).otherwise(k))
        return F.when(at == 0, F.concat(kept, F.array(x))).otherwise(swapped)

    empty = F.slice("items", 1, 0)
    merged = groups.select("group", F.explode(F.aggregate("items", empty, step)).alias("x"))
    return merged.select("group", F.col("x.seq").alias("seq"), F.col("x.claim").alias("claim"), F.col("x.n_ids").alias("n_ids"))


def prompts(sample: DataFrame) -> DataFrame:
    """game, bucket, prompt: a line per review (game, bucket, rid, seq, hours, voted_up, text) in the order of seq, white
    space collapsed, long ones marked where they are cut. `sample` is a quota sample: a game's rows are of bounded number."""
    plain = collapse(F.coalesce("text", F.lit("")))
    shown = F.when(F.length(plain) > C.PROMPT_CHARS, F.concat(F.substring(plain, 1, C.PROMPT_CHARS), F.lit(" ...[truncated]"))).otherwise(plain)
    says = F.when(F.col("voted_up"), "recommends").otherwise("does not recommend")
    line = F.concat(F.lit("["), F.col("rid").cast("string"), F.lit("] ("), F.format_string("%.1f", F.coalesce("hours", F.lit(0.0))), F.lit("h, "), says, F.lit(") "), shown)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "rid", line.alias("line")))), lambda x: x["line"])
    return sample.groupBy("game", "bucket").agg(F.array_join(lines, "\n\n").alias("prompt"))


def build_prompts(sample: DataFrame, system: str, user: str) -> DataFrame:
    """game, bucket, system, user: the two turns about each cohort of a quota sample. The texts may name {cohort_label},
    {cohort_range}, {game} and {reviews}; what is put in isn't read again."""
    found = prompts(sample)
    parts = {"cohort_label": cohort_label(F.col("bucket")), "cohort_range": cohort_hours(F.col("bucket")), "game": F.col("game").cast("string"), "reviews": F.col("prompt")}

    def filled(text: str) -> Column:
        pieces = re.split(r"\{(\w+)\}", text)
        return F.concat(*[F.coalesce(parts[x], F.lit("")) if k % 2 else F.lit(x) for k, x in enumerate(pieces)])

    return found.select("game", "bucket", filled(system).alias("system"), filled(user).alias("user"))
