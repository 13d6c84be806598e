"""Computed verdicts, distortion flags and the documents they go into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield import config as C
from tallyfield.functions.rates import bucket_rank, verdict_word
from tallyfield.functions.text import has_bare_digit, prevalence


def post_refund_mean(rates: DataFrame, min_pool: int = C.MEAN_MIN_POOL) -> DataFrame:
    """game, mean_pct (of the rounded rates, weighted by pool), word. Only the later cohorts of `min_pool` reviews or
    more count; without any the mean and the word are null."""
    counts = F.col("bucket").isin(C.MEAN_BUCKETS) & (F.col("pool_n") >= min_pool) & F.col("pct_positive").isNotNull()
    if "muted" in rates.columns:
        counts &= ~F.col("muted")
    sums = rates.groupBy("game").agg(
        F.sum(F.when(counts, F.col("pct_positive") * F.col("pool_n"))).alias("points"), F.sum(F.when(counts, F.col("pool_n"))).alias("n")
    )
    mean = F.when(F.col("n") > 0, F.round(F.col("points") / F.col("n"), 4))
    return sums.select("game", mean.alias("mean_pct"), verdict_word(mean).alias("word"))


def shape_of(rates: Column) -> Column:
    """The shape of an array of rates; steps within the tolerance are flat, and ties take the first place."""
    steps = F.transform(F.slice(rates, F.lit(2), F.greatest(F.size(rates) - 1, F.lit(0))), lambda x, i: F.round(x - F.get(rates, i), 1))
    ups, downs = F.exists(steps, lambda s: s > C.SHAPE_TOLERANCE), F.exists(steps, lambda s: s < -C.SHAPE_TOLERANCE)
    n = F.size(rates)
    peak, trough = F.array_position(rates, F.array_max(rates)), F.array_position(rates, F.array_min(rates))
    return (
        F.when(~ups & ~downs, "flat")
        .when(ups & ~downs, "monotonic_increase")
        .when(downs & ~ups, "monotonic_decrease")
        .when((peak > 1) & (peak < n), "rise_then_fall")
        .when((trough > 1) & (trough < n), "fall_then_rise")
        .otherwise("mixed")
    )


def cohort_divergence(rates: DataFrame) -> DataFrame:
    """game, cohorts, gap_pts, shape, low_cohort, high_cohort, sequence (cohort, pct, pool_n) of the games whose cohorts lie
    far apart; of a shape that rises and falls the peak, the lowest cohort after it and the fall, of one that falls and
    rises the trough. Ties take the first cohort."""
    fits = (F.col("pool_n") >= C.DIVERGENCE_MIN_POOL) & F.col("pct_positive").isNotNull() & F.col("bucket").isin(C.BUCKET_NAMES)
    item = F.struct(bucket_rank(F.col("bucket")).alias("rank"), F.col("bucket").alias("cohort"), F.col("pct_positive").alias("pct"), "pool_n")
    rows = rates.where(fits).groupBy("game").agg(F.array_sort(F.collect_list(item)).alias("ranked"))
    sequence = F.transform("ranked", lambda x: F.struct(x["cohort"].alias("cohort"), x["pct"].alias("pct"), x["pool_n"].alias("pool_n")))
    rows = rows.select("game", sequence.alias("sequence"), F.col("ranked.cohort").alias("names"), F.col("ranked.pct").alias("pcts")).where(F.size("pcts") >= 2)
    low, high = F.array_min("pcts"), F.array_max("pcts")
    rows = rows.withColumn("gap_pts", F.round(high - low, 1)).where(F.col("gap_pts") >= C.DIVERGENCE_MIN_GAP).withColumn("shape", shape_of(F.col("pcts")))
    place = lambda x: F.array_position("pcts", x).cast("int")
    after = F.slice("pcts", place(high), F.size("pcts"))
    lowest = F.element_at("names", (place(high) - 1 + F.array_position(after, F.array_min(after))).cast("int"))
    falls, rises = F.col("shape") == "rise_then_fall", F.col("shape") == "fall_then_rise"
    return rows.select(
        "game",
        F.array_join("names", ",").alias("cohorts"),
        "gap_pts",
        "shape",
        F.element_at("names", place(low)).alias("low_cohort"),
        F.element_at("names", place(high)).alias("high_cohort"),
        F.when(falls, F.element_at("names", place(high))).alias("peak_cohort"),
        F.when(falls, lowest).alias("after_peak_cohort"),
        F.when(falls, F.round(high - F.array_min(after), 1)).alias("drop_after_peak_pts"),
        F.when(rises, F.element_at("names", place(low))).alias("trough_cohort"),
        "sequence",
    )


def recency_shift(split: DataFrame, lifetime: DataFrame) -> DataFrame:
    """game, direction, delta_pts, older_pct (only with enough older reviews) where the last year differs from the
    lifetime rate (game, lifetime_pct)."""
    both = split.join(lifetime, "game").withColumn("delta_pts", F.round(F.col("recent_pct") - F.col("lifetime_pct"), 1)).drop("delta")
    fits = (F.col("recent_n") >= C.RECENT_MIN_POOL) & (F.abs("delta_pts") >= C.RECENT_MIN_SHIFT)
    older = F.when(F.col("older_n") >= C.OLDER_MIN_POOL, F.col("older_pct"))
    return both.where(fits).select("game", F.when(F.col("delta_pts") > 0, "improved").otherwise("declined").alias("direction"), "delta_pts", older.alias("older_pct"))


def _any_like(items: Column, pattern: str) -> Column:
    return F.exists(items, lambda s: s.rlike(pattern))


def check_header(headers: DataFrame) -> DataFrame:
    """`headers` (tagline, for_you_if, not_for_you_if, word) with failures, the codes of all rules that they break."""
    text = F.coalesce("tagline", F.lit(""))
    codes = [
        F.when(F.trim(text) == "", "missing_tagline").when(F.length(text) > C.TAGLINE_CHARS, F.format_string("tagline_too_long:%d", F.length(text))),
        F.when((F.col("word") == "Buy") & text.rlike(C.SKIP_LANGUAGE) | (F.col("word") == "Skip") & text.rlike(C.BUY_LANGUAGE), "tagline_contradicts_verdict"),
        F.when(text.rlike(C.FRICTION), "tagline_frames_friction_as_a_condition"),
        F.when(has_bare_digit(text), "digit_in_prose:tagline"),
        F.when(F.size(prevalence(text)) > 0, F.concat(F.lit("prevalence:tagline:"), F.array_join(prevalence(text), ","))),
    ]
    plain = {}
    for name, word, pattern in (("for_you_if", "Skip", C.BUY_LANGUAGE), ("not_for_you_if", "Buy", C.SKIP_LANGUAGE)):
        items = F.coalesce(name, F.array().cast("array<string>"))
        plain[name] = F.transform(items, lambda s: F.regexp_replace(F.lower(F.trim(s)), r"\.+$", ""))
        codes += [
            F.when((F.size(items) < C.FIT_CLAUSES[0]) | (F.size(items) > C.FIT_CLAUSES[1]), F.format_string(f"{name}_out_of_bounds:%d", F.size(items))),
            F.when(F.exists(items, lambda s: F.trim(s) == ""), f"empty_fit_clause:{name}"),
            F.when(F.exists(items, lambda s: F.length(s) > C.CLAUSE_CHARS), f"fit_clause_too_long:{name}"),
            F.when((F.col("word") == word) & _any_like(items, pattern), f"fit_list_contradicts_verdict:{name}"),
            F.when(F.exists(items, has_bare_digit), f"digit_in_prose:{name}"),
            F.when(F.exists(items, lambda s: F.size(prevalence(s)) > 0), f"prevalence:{name}"),
        ]
    codes.append(F.when(F.size(F.array_intersect(plain["for_you_if"], plain["not_for_you_if"])) > 0, "duplicate_fit_clause"))
    return headers.withColumn("failures", F.array_compact(F.array(*codes)))


def build_citation(text: Column, created: Column) -> Column:
    """The shown text, whether it is cut, and the UTC date."""
    cut = F.length(text) > C.CITATION_CHARS
    shown = F.when(cut, F.concat(F.substring(text, 1, C.CITATION_CHARS), F.lit("…"))).otherwise(text)
    return F.struct(shown.alias("review_text"), cut.alias("truncated"), F.date_format(created, "yyyy-MM-dd").alias("date"))


def assemble(rates: DataFrame, verdicts: DataFrame, claims: DataFrame) -> DataFrame:
    """One nested document per game, bottom up: claims by theme in the order of seq, themes by cohort, cohorts in the
    fixed order; muted cohorts carry no claims. `claims` has game, bucket, theme, claim_id, claim, seq."""
    claim = F.struct("seq", "claim_id", "claim")
    themes = claims.groupBy("game", "bucket", "theme").agg(F.array_sort(F.collect_list(claim)).alias("claims"), F.min("seq").alias("first"))
    themes = themes.groupBy("game", "bucket").agg(F.array_sort(F.collect_list(F.struct("first", "theme", "claims"))).alias("themes"))
    rows = rates.join(themes, ["game", "bucket"], "left")
    note = F.when(F.col("muted"), F.format_string("n=%d", "pool_n"))
    none = F.array().cast(themes.schema["themes"].dataType)
    shown = F.when(F.col("muted"), none).otherwise(F.coalesce("themes", none))
    cohort = F.struct(bucket_rank(F.col("bucket")).alias("rank"), "bucket", "pool_n", "pct_positive", "muted", note.alias("n_note"), shown.alias("themes"))
    docs = rows.groupBy("game").agg(F.array_sort(F.collect_list(cohort)).alias("cohorts"), F.sum("pool_n").alias("pool_n"), F.sum((~F.col("muted")).cast("int")).alias("cohort_count"))
    return docs.join(verdicts, "game").select(
        "game", F.struct("word", "mean_pct").alias("verdict"), "cohorts", F.struct("pool_n", "cohort_count").alias("footer")
    )


def citations_of(documents: DataFrame) -> DataFrame:
    """Every claim of nested documents as a row: game, bucket, theme, claim_id."""
    cohorts = documents.select("game", F.explode("cohorts").alias("c"))
    themes = cohorts.select("game", F.col("c.bucket").alias("bucket"), F.explode("c.themes").alias("t"))
    return themes.select("game", "bucket", F.col("t.theme").alias("theme"), F.explode("t.claims").alias("x")).select("game", "bucket", "theme", F.col("x.claim_id").alias("claim_id"))
