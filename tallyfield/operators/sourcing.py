"""How the cited reviews relate to the pool they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield import config as C
from tallyfield.operators.ranks import exclusive_quantiles
from tallyfield.functions.rates import binomial_tail, count_where, percent, significant


def _once(citations: DataFrame) -> DataFrame:
    """Each cited review of a cohort once, with its last vote in the order of `order`, or without that column its best; a
    null vote is none for the game."""
    vote = F.coalesce("voted_up", F.lit(False))
    return citations.groupBy("game", "bucket", "rid").agg(F.max_by(vote, "order" if "order" in citations.columns else vote).alias("voted_up"))


def sourcing(citations: DataFrame, rates: DataFrame) -> DataFrame:
    """game, bucket, cited_reviews, cited_recommend, divergence_p, triggers, level: distinct cited reviews of a cohort
    against its pool rate."""
    sums = _once(citations).groupBy("game", "bucket").agg(F.count("*").alias("cited_reviews"), count_where(F.col("voted_up")).alias("cited_recommend"))
    both = sums.join(rates.select("game", "bucket", "pct_positive"), ["game", "bucket"])
    p = binomial_tail(F.col("cited_recommend"), F.col("cited_reviews"), F.col("pct_positive") / 100)
    rows = both.withColumn("p", p)
    triggers = F.array_compact(F.array(F.when(F.col("cited_reviews") <= C.THIN_REVIEWERS, "thin"), F.when(F.col("p") < C.ALPHA, "divergent")))
    return rows.select(
        "game",
        "bucket",
        "cited_reviews",
        "cited_recommend",
        significant(F.col("p")).alias("divergence_p"),
        F.array_join(triggers, ",").alias("triggers"),
        F.when(F.size(triggers) > 0, "escalated").otherwise("baseline").alias("level"),
    )


def claim_balance(available: DataFrame, cited: DataFrame) -> DataFrame:
    """game, bucket, available_pct, cited_pct, delta, n_available, n_cited: cited instances against what could be cited, for
    games (bucket "all") with twice the least numbers of both, and their cohorts with enough of both. Reviews outside the
    named cohorts don't count, and a null vote is no recommendation."""

    def rates(df: DataFrame, n: str, up: str) -> DataFrame:
        named = df.where(F.col("bucket").isin(C.BUCKET_NAMES))
        sums = named.groupingSets([["game", "bucket"], ["game"]], "game", "bucket").agg(F.grouping("bucket").alias("g"), F.count("*").alias(n), count_where(F.col("voted_up")).alias(up))
        return sums.select("game", F.when(F.col("g") == 1, "all").otherwise(F.col("bucket")).alias("bucket"), n, up)

    both = rates(available, "n_available", "a").join(rates(cited, "n_cited", "c"), ["game", "bucket"])
    whole = F.col("bucket") == "all"
    factor = F.when(whole, 2).otherwise(1)
    both = both.where((F.col("n_available") >= C.BALANCE_AVAILABLE * factor) & (F.col("n_cited") >= C.BALANCE_CITED * factor))
    both = both.withColumn("measured", F.max(whole).over(Window.partitionBy("game"))).where("measured")  # five rows a game at most
    a, c = F.lit(100.0) * F.col("a") / F.col("n_available"), F.lit(100.0) * F.col("c") / F.col("n_cited")
    return both.select("game", "bucket", F.round(a, 1).alias("available_pct"), F.round(c, 1).alias("cited_pct"), F.round(c - a, 1).alias("delta"), "n_available", "n_cited")


def source_delta(citations: DataFrame, rates: DataFrame) -> DataFrame:
    """game, bucket, cited_n, cited_pct, pool_pct, delta_pool over distinct cited reviews."""
    sums = _once(citations).groupBy("game", "bucket").agg(F.count("*").alias("cited_n"), count_where(F.col("voted_up")).alias("up"))
    cited = percent(F.col("up"), F.col("cited_n"))
    both = sums.join(rates.select("game", "bucket", F.col("pct_positive").alias("pool_pct")), ["game", "bucket"])
    return both.select("game", "bucket", "cited_n", cited.alias("cited_pct"), "pool_pct", F.round(cited - F.col("pool_pct"), 1).alias("delta_pool"))


def delta_summary(deltas: DataFrame) -> DataFrame:
    """n, mean, median, least, p10 (exclusive), and how many cohorts lie at or below -40, -50 and -60; no row without any."""
    known = deltas.where("delta_pool IS NOT NULL")
    sums = known.agg(
        F.count("*").alias("n"),
        F.round(F.avg("delta_pool"), 3).alias("mean"),
        F.min("delta_pool").alias("least"),
        *[count_where(F.col("delta_pool") <= -t).alias(f"below_{t}") for t in C.DELTA_THRESHOLDS],
    )
    places = exclusive_quantiles(known, "delta_pool", [0.1, 0.5])
    median, p10 = (F.round(F.lit(places.get(s)).cast("double"), 3) for s in (0.5, 0.1))
    return sums.where("n > 0").select("n", "mean", median.alias("median"), "least", p10.alias("p10"), *[f"below_{t}" for t in C.DELTA_THRESHOLDS])


def drift(stored: DataFrame, recomputed: DataFrame, keys: list[str]) -> DataFrame:
    """The keys whose stored and recomputed rows differ in any other column, or that only one side has."""
    columns = [c for c in stored.columns if c not in keys]
    left = stored.select(*keys, F.struct(*columns).alias("stored"))
    right = recomputed.select(*keys, F.struct(*columns).alias("now"))
    return left.join(right, keys, "full").where(~F.col("stored").eqNullSafe(F.col("now"))).select(*keys)
