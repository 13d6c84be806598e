"""The pool of reviews: deduplication, rates, and the quota sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield import config as C
from tallyfield.functions.rates import bucket_rank, count_where, percent

#: Rows of a game that one task may take whole.
GAME_ROWS = 1_000_000


def dedup_pool(reviews: DataFrame, met: bool = False) -> DataFrame:
    """One row per (game, rid), the first of `order`; source_filters has the sweeps that saw it, as they came, n_seen how
    often. The rows of a review meet by one exchange, or have `met` by their game; of each sweep only the first goes on."""
    by_sweep = Window.partitionBy("game", "rid", "source_filter")
    rows = reviews.where("rid IS NOT NULL")
    if not met:
        rows = rows.repartition("game", "rid")
    rows = rows.withColumn("place", F.row_number().over(by_sweep.orderBy("order"))).withColumn("seen", F.count("*").over(by_sweep)).where("place = 1")
    first = Window.partitionBy("game", "rid").orderBy("order")
    whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("place", F.row_number().over(first)).withColumn("source_filters", F.collect_list("source_filter").over(whole)).withColumn("n_seen", F.sum("seen").over(whole))
    return rows.where("place = 1").drop("place", "seen", "source_filter")


def numbered(pool: DataFrame, slices: Column) -> DataFrame:
    """`pool` with seq, the place of a review in its game in the order of `order`, from 0. `slices` is a leading part of
    `order` (a date, a page): a slice is numbered on its own and begins after the sum of those before."""
    rows = pool.withColumn("slice", slices)
    counts = rows.groupBy(F.col("game").alias("g"), F.col("slice").alias("s")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(counts.select("g", "s", before.alias("before")), F.col("game").eqNullSafe(F.col("g")) & F.col("slice").eqNullSafe(F.col("s")))
    own = F.row_number().over(Window.partitionBy("game", "slice").orderBy("order", "rid"))
    return placed.withColumn("seq", F.col("before") + own - 1).drop("g", "s", "before", "slice")


def large_games(games: DataFrame) -> DataFrame:
    """The values of the one column of `games`, a row a review, that have more than GAME_ROWS rows."""
    return games.groupBy(*games.columns).agg(F.count("*").alias("n")).where(F.col("n") > GAME_ROWS).drop("n")


def numbered_whole(pool: DataFrame) -> DataFrame:
    """`numbered` where a game's rows have met: each game in one window."""
    return pool.withColumn("seq", F.row_number().over(Window.partitionBy("game").orderBy("order", "rid")).cast("long") - 1)


def _cohorts(games: DataFrame) -> DataFrame:
    """Every game with every cohort; four rows for each."""
    return games.select("game", F.explode(F.array(*map(F.lit, C.BUCKET_NAMES))).alias("bucket"))


def bucket_counts(reviews: DataFrame) -> DataFrame:
    """pool_n by game and cohort, 0 where there is none."""
    counts = reviews.groupBy("game", "bucket").agg(F.count("*").alias("n"))
    games = counts.groupBy("game").agg(F.lit(1).alias("one"))
    return _cohorts(games).join(counts, ["game", "bucket"], "left").select("game", "bucket", F.coalesce("n", F.lit(0)).alias("pool_n"))


def pool_rates(reviews: DataFrame) -> DataFrame:
    """pool_n, share_of_pool_pct, pct_positive by game and cohort that has reviews. The second aggregation and the
    window run over the few cohorts of a game."""
    counts = reviews.groupBy("game", "bucket").agg(F.count("*").alias("pool_n"), count_where(F.col("voted_up")).alias("positive"))
    whole = F.sum("pool_n").over(Window.partitionBy("game"))
    return counts.select("game", "bucket", "pool_n", percent(F.col("pool_n"), whole).alias("share_of_pool_pct"), percent(F.col("positive"), F.col("pool_n")).alias("pct_positive"))


def temporal_split(reviews: DataFrame, now: Column) -> DataFrame:
    """Rates of the last year and before; the difference is that of the rounded rates. A null date is old."""
    recent = F.coalesce(F.col("created") >= now - F.expr(f"INTERVAL {C.RECENT_DAYS} DAYS"), F.lit(False))
    sums = reviews.groupBy("game").agg(
        count_where(recent).alias("recent_n"),
        count_where(recent & F.col("voted_up")).alias("recent_up"),
        count_where(~recent).alias("older_n"),
        count_where(~recent & F.col("voted_up")).alias("older_up"),
    )
    rated = sums.select("game", "recent_n", percent(F.col("recent_up"), F.col("recent_n")).alias("recent_pct"), "older_n", percent(F.col("older_up"), F.col("older_n")).alias("older_pct"))
    return rated.withColumn("delta_pts", F.round(F.col("recent_pct") - F.col("older_pct"), 1))


def _turns(pool: DataFrame, filters: list[str]) -> DataFrame:
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, filters)), F.col("primary")), F.lit(0)), F.lit(len(filters) + 1))
    return pool.withColumn("queue", place).withColumn("turn", F.row_number().over(Window.partitionBy("game", "bucket", "primary").orderBy("seq")))


def _kept(rows: DataFrame, target: int, quota: int) -> DataFrame:
    """`rows` with turns and whether the sample keeps them. Windows are by game and cohort, never over all rows."""
    rows = rows.withColumn("known", F.coalesce(F.col("bucket").isin(C.BUCKET_NAMES), F.lit(False)))
    rows = rows.withColumn("pick", F.row_number().over(Window.partitionBy("game", "bucket").orderBy("turn", "queue", "primary")))
    rows = rows.withColumn("chosen", F.col("known") & (F.col("pick") <= quota))
    # what is left of a cohort stays queue by queue
    left = Window.partitionBy("game", "bucket", "chosen").orderBy("queue", "primary", "turn")
    rows = rows.withColumn("left_turn", F.row_number().over(left))
    short = F.lit(target) - F.sum(F.col("chosen").cast("int")).over(Window.partitionBy("game"))
    rows = rows.withColumn("short", short).withColumn("rank", bucket_rank(F.col("bucket")))
    extra = F.row_number().over(Window.partitionBy("game", "chosen", "known").orderBy("left_turn", "rank"))
    rows = rows.withColumn("taken", F.col("chosen") | (F.col("known") & (extra <= F.col("short"))))
    place = F.row_number().over(Window.partitionBy("game", "taken").orderBy("seq"))
    return rows.withColumn("kept", F.col("taken") & (place <= target)).select("game", "rid", "bucket", "seq", "kept")


def quota_sample(pool: DataFrame, target: int, quota: int, filters: list[str]) -> DataFrame:
    """(game, rid, bucket, seq): at most `quota` of each cohort, in turn from the sweeps; what is short of `target` comes
    in turn from what the cohorts have left; then the first `target` by seq. `pool` has game, rid, bucket, primary (the
    first sweep that saw the review) and seq."""
    rows = _turns(pool.where(F.col("bucket").isin(C.BUCKET_NAMES)), filters)
    # no queue gives more than its cohort's quota and all that can be short; this is cut before the rows meet
    return _kept(rows.where(F.col("turn") <= target + quota), target, quota).where("kept").drop("kept")


def sample_report(sample: DataFrame, pool: DataFrame) -> DataFrame:
    """kept, in_pool and their whole percentage by game and cohort."""
    kept = sample.groupBy("game", "bucket").agg(F.count("*").alias("kept"))
    whole = pool.groupBy("game", "bucket").agg(F.count("*").alias("in_pool"))
    both = whole.join(kept, ["game", "bucket"], "left")
    return _shares(both.withColumn("kept", F.coalesce("kept", F.lit(0))))


def sample_report_whole(pool: DataFrame, target: int, quota: int, filters: list[str]) -> DataFrame:
    """`sample_report` of `quota_sample` where a game's rows have met: the pool is read once, as each row tells whether it
    is kept."""
    rows = _kept(_turns(pool, filters), target, quota)
    return _shares(rows.groupBy("game", "bucket").agg(count_where(F.col("kept")).alias("kept"), F.count("*").alias("in_pool")))


def _shares(counts: DataFrame) -> DataFrame:
    return counts.select("game", "bucket", "kept", "in_pool", F.floor(F.col("kept") * 100 / F.col("in_pool")).alias("kept_pct"))


def quotas_met(reviews: DataFrame, quota: int) -> DataFrame:
    """Whether every named cohort of a game has its quota; and whether its refund cohort has a review at all."""
    return bucket_counts(reviews).groupBy("game").agg(
        (F.min("pool_n") >= quota).alias("quotas_met"), (F.sum(F.when(F.col("bucket") == C.BUCKET_NAMES[0], F.col("pool_n")).otherwise(0)) > 0).alias("has_refunds")
    )


def cohort_structure(reviews: DataFrame) -> DataFrame:
    """Veteran share, refund reviews, cohorts that are large enough, and whether the game is too thinly segmented."""
    n = lambda name: count_where(F.col("bucket") == name)
    sums = reviews.groupBy("game").agg(F.count("*").alias("n"), *[n(b).alias(b) for b in C.BUCKET_NAMES])
    eligible = sum(((F.col(b) >= C.MIN_SURVIVORS).cast("int") for b in C.BUCKET_NAMES[1:]), (F.col(C.BUCKET_NAMES[0]) >= C.MIN_SURVIVORS).cast("int"))
    share = F.round(F.col("veteran") / F.col("n"), 3)
    out = sums.select("game", F.when(F.col("n") > 0, share).alias("veteran_share"), F.col("refund_window").alias("refund_n"), eligible.alias("eligible"))
    return out.withColumn("thin", (F.col("eligible") < C.MIN_ELIGIBLE) | (F.col("veteran_share") > C.VETERAN_SHARE_MAX))
