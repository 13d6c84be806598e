"""The content filter and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield import config as C
from tallyfield.functions.rates import count_where, percent
from tallyfield.functions.text import block_pattern, leet, occurrences, share_of, soft_pattern, visible_words


def classify(reviews: DataFrame, blocked: list[str], soft: list[str]) -> DataFrame:
    """`reviews` with reason (null: kept; the first rule that fits) and annotations, which never drop a review."""
    text = F.coalesce("text", F.lit(""))
    rows = reviews.withColumn("_text", text)
    rows = rows.withColumn("_words", visible_words(F.col("_text"))).withColumn("_hearts", occurrences(F.col("_text"), "♥")).withColumn("_plain", leet(F.col("_text")))
    rows = rows.withColumn("_blocked", F.col("_plain").rlike(block_pattern(blocked)) if blocked else F.lit(False))
    n, words, length = F.size("_words"), F.col("_words"), F.length("_text")
    up, funny = F.coalesce("votes_up", F.lit(0)), F.coalesce("votes_funny", F.lit(0))
    distinct = F.size(F.array_distinct(F.transform(words, F.lower)))
    hearts = (F.col("_hearts") >= C.HEARTS) & (F.col("_hearts") / length >= C.HEART_DENSITY)
    reason = (
        F.when((length > 0) & hearts, "heart_density")
        .when(F.col("_blocked"), "blocked_term")
        .when((funny > up) & (funny >= C.FUNNY_FLOOR), "joke_review")
        .when(n < C.MIN_WORDS, "low_information")
        .when((length > 20) & (share_of(F.col("_text"), r"[\p{L}\s]+") < C.ALPHA_RATIO), "low_information")
        .when((n >= 5) & (distinct / F.greatest(n, F.lit(1)) < C.REPEAT_RATIO), "low_information")
    )
    letters, upper = length - F.length(F.regexp_replace("_text", r"\p{L}+", "")), length - F.length(F.regexp_replace("_text", r"\p{Lu}+", ""))
    known_soft = [t for t in soft if t not in set(blocked)]
    notes = F.array(
        F.when(F.col("_hearts") > 0, "hearts_present"),
        F.when((length > 30) & (letters > 0) & (upper / F.greatest(letters, F.lit(1)) > 0.7), "all_caps"),
        F.when(F.col("_plain").rlike(soft_pattern(soft, blocked)) if known_soft else F.lit(False), "profanity_soft"),
        F.when((reason == "blocked_term"), "blocked_term"),
    )
    return rows.withColumn("reason", reason).withColumn("annotations", F.array_compact(notes)).drop("_text", "_words", "_hearts", "_plain", "_blocked")


def filter_report(classified: DataFrame) -> DataFrame:
    """By game and cohort, and over the game (cohort "all"): in, kept, dropped by reason, whether muted, and whether the
    cohort loses disproportionately many. One pass by grouping sets."""
    sums = classified.groupingSets([["game", "bucket"], ["game"]], "game", "bucket").agg(
        F.grouping("bucket").alias("whole"),
        F.count("*").alias("n_in"),
        count_where(F.col("reason").isNull()).alias("kept"),
        *[count_where(F.col("reason") == r).alias(r) for r in ("heart_density", "blocked_term", "joke_review", "low_information")],
    )
    rows = sums.withColumn("bucket", F.when(F.col("whole") == 1, "all").otherwise(F.col("bucket"))).withColumn("dropped", F.col("n_in") - F.col("kept"))
    rows = rows.withColumn("drop_pct", percent(F.col("dropped"), F.col("n_in")))
    # a game has five rows here at most
    overall = F.max(F.when(F.col("whole") == 1, F.col("drop_pct"))).over(Window.partitionBy("game"))
    uneven = (F.col("whole") == 0) & (F.round(F.col("drop_pct") - overall, 1) > C.DISPROPORTIONATE)
    return rows.withColumn("muted", F.col("kept") < C.MIN_SURVIVORS).withColumn("disproportionate", uneven).drop("whole")


def sentiment_shift(classified: DataFrame) -> DataFrame:
    """By game and cohort: positive rates before and after the filter, of what it dropped, and whether the difference is
    worth a warning."""
    kept, low, up = F.col("reason").isNull(), F.col("reason") == "low_information", F.col("voted_up")
    sums = classified.groupBy("game", "bucket").agg(
        F.count("*").alias("n_pre"),
        count_where(up).alias("up_pre"),
        count_where(kept).alias("n_post"),
        count_where(kept & up).alias("up_post"),
        count_where(low).alias("n_low_information"),
        count_where(low & up).alias("up_low"),
    )
    gone, gone_up = F.col("n_pre") - F.col("n_post"), F.col("up_pre") - F.col("up_post")
    rows = sums.select(
        "game",
        "bucket",
        "n_pre",
        percent(F.col("up_pre"), F.col("n_pre")).alias("pct_pre"),
        "n_post",
        percent(F.col("up_post"), F.col("n_post")).alias("pct_post"),
        percent(gone_up, gone).alias("pct_dropped"),
        "n_low_information",
        percent(F.col("up_low"), F.col("n_low_information")).alias("pct_low_information"),
    )
    least = F.least("n_pre", "n_post")
    rows = rows.withColumn("delta_pts", F.round(F.col("pct_post") - F.col("pct_pre"), 1))
    return rows.withColumn("warn", F.coalesce((F.abs("delta_pts") > C.SHIFT_WARN) & (least >= C.SHIFT_MIN_N), F.lit(False)))
