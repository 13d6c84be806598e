"""Evaluation and audit reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.rates import count_where, percent

#: Bounds of the bands, low included.
BANDS = [0, 80, 86, 90, 101]


def band(pct: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(BANDS, BANDS[1:])):
        out = F.when((pct >= low) & (pct < high), i).otherwise(out)
    return out


def night_bands(titles: DataFrame) -> DataFrame:
    """night, band, n, buy_pct, weighted_pct of titles (night, pct, pool_n, word)."""
    return titles.groupBy("night", band(F.col("pct")).alias("band")).agg(
        F.count("*").alias("n"), percent(count_where(F.col("word") == "Buy"), F.count("*")).alias("buy_pct"), F.round(F.sum(F.col("pct") * F.col("pool_n")) / F.sum("pool_n"), 3).alias("weighted_pct")
    )


def standardised(titles: DataFrame, reference_night: int) -> DataFrame:
    """night, n, actual, expected: Buy verdicts, and how many there would be at the reference night's rate of each band."""
    rows = titles.withColumn("band", band(F.col("pct"))).withColumn("buy", (F.col("word") == "Buy").cast("int"))
    prior = rows.where(F.col("night") == reference_night).groupBy(F.col("band").alias("of")).agg((F.sum("buy") / F.count("*")).alias("rate"))
    sums = rows.groupBy("night", "band").agg(F.count("*").alias("n"), F.sum("buy").alias("buy"))
    both = sums.join(prior, F.col("band") == F.col("of"), "left")
    return both.groupBy("night").agg(F.sum("n").alias("n"), F.sum("buy").alias("actual"), F.round(F.sum(F.col("n") * F.coalesce("rate", F.lit(0.0))), 4).alias("expected"))


def derive_score(full: Column, partial: Column) -> Column:
    """2, 1 or 0 from the numbers of citations that support a case in full or in part."""
    return F.when(full >= 2, 2).when(full == 1, 1).when(partial >= 2, 1).otherwise(0)


def case_scores(levels: DataFrame) -> DataFrame:
    """case_id, score, gap (a single partial support) of cases' citation levels (case_id, level)."""
    sums = levels.groupBy("case_id").agg(count_where(F.col("level") == "full").alias("full"), count_where(F.col("level") == "partial").alias("partial"))
    return sums.select("case_id", derive_score(F.col("full"), F.col("partial")).alias("score"), ((F.col("full") == 0) & (F.col("partial") == 1)).alias("gap"))


def score_breakdown(scores: DataFrame) -> DataFrame:
    """by, name, n, mean, twos, ones, zeros for each game, each cohort and all cases; one pass by grouping sets."""
    sums = scores.groupingSets([["game"], ["cohort"], []], "game", "cohort").agg(
        F.grouping_id("game", "cohort").alias("g"), F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean"), *[count_where(F.col("score") == k).alias(c) for k, c in ((2, "twos"), (1, "ones"), (0, "zeros"))]
    )
    by = F.when(F.col("g") == 1, "game").when(F.col("g") == 2, "cohort").otherwise("all")
    return sums.select(by.alias("by"), F.coalesce("game", "cohort", F.lit("all")).alias("name"), "n", "mean", "twos", "ones", "zeros")


def overlap(samples: DataFrame) -> DataFrame:
    """a, b, shared: how many rids two rounds (round, rid) have in common. Rounds are few; each rid meets only itself."""
    one, two = samples.select(F.col("round").alias("a"), "rid").distinct(), samples.select(F.col("round").alias("b"), F.col("rid").alias("rid_b")).distinct()
    return one.join(two, (F.col("rid") == F.col("rid_b")) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("shared"))


def stratified_sample(rows: DataFrame, n: int, seed: str) -> DataFrame:
    """rid, bucket, place: `n` rows in turn from the cohorts, in the order of a hash, each rid once. Only the first `n` of
    each cohort meet."""
    key = F.sha2(F.concat(F.lit(seed + ":"), F.col("rid").cast("string")), 256)
    once = rows.groupBy("rid").agg(F.min("bucket").alias("bucket"))
    turn = F.row_number().over(Window.partitionBy("bucket").orderBy(key, "rid"))
    first = once.withColumn("turn", turn).where(F.col("turn") <= n)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy("turn", "bucket")))
    return placed.where(F.col("place") <= n).select("rid", "bucket", "place")


def agreement(scores: DataFrame, again: DataFrame) -> DataFrame:
    """n, agree_pct of two runs over the same cases."""
    second = again.select(F.col("case_id").alias("of"), F.col("score").alias("second"))
    both = scores.join(second, F.col("case_id") == F.col("of"))
    return both.agg(F.count("*").alias("n"), percent(count_where(F.col("score") == F.col("second")), F.count("*")).alias("agree_pct"))
