"""What readers of the documents see: art, notes, cards, and the state of a request."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield import config as C
from tallyfield.functions.rates import count_where
from tallyfield.sources.entity_files import envelope_pieces


def art(header: Column, capsule: Column, grid: Column, fallback: Column) -> tuple[Column, Column]:
    """(tile, card): a tile may use the grid image before the fallback, a card never does."""
    real = lambda c: F.when(c.startswith("http"), c)
    return F.coalesce(real(header), real(capsule), grid, fallback), F.coalesce(real(header), fallback)


def sourcing_note(triggers: Column) -> Column:
    """Which of the four notes a cohort's triggers call for; null without a sourcing block."""
    thin, divergent = F.array_contains(triggers, "thin"), F.array_contains(triggers, "divergent")
    return F.when(triggers.isNull(), None).when(thin & divergent, "few_and_more_negative").when(thin, "few").when(divergent, "more_negative").otherwise("base")


def normalize_document(documents: DataFrame) -> DataFrame:
    """Older documents in today's shape: one-line headers become taglines, missing lists empty, missing marks false."""
    header = F.col("header")
    names = documents.schema["header"].dataType.fieldNames()
    get = lambda n: header[n] if n in names else F.lit(None)
    none = F.array().cast("array<string>")
    bars = F.transform(F.coalesce("split_bar", F.slice("split_bar", 1, 0)), lambda b: b.withField("muted", F.coalesce(b["muted"], F.lit(False))))
    return documents.select(
        F.col("appid").cast("string").alias("appid"),
        F.struct(
            get("word").cast("string").alias("word"),
            F.coalesce(get("tagline").cast("string"), get("for_whom").cast("string"), F.lit("")).alias("tagline"),
            F.coalesce(get("for_you_if").cast("array<string>"), none).alias("for_you_if"),
            F.coalesce(get("not_for_you_if").cast("array<string>"), none).alias("not_for_you_if"),
        ).alias("header"),
        F.coalesce(bars, F.array().cast(documents.schema["split_bar"].dataType)).alias("split_bar"),
    )


def ui_status(status: Column, conclusion: Column) -> Column:
    """A step as readers see it: one that was skipped hasn't run."""
    return (
        F.when(conclusion == "success", "completed").when(conclusion == "skipped", "pending").when(conclusion.isNotNull(), "failed").when(status == "in_progress", "in_progress").otherwise("pending")
    )


def run_outcome(status: Column, conclusion: Column, failed_steps: Column) -> Column:
    """How a run ended; null while it hasn't. A document that was withheld isn't a crash."""
    return F.when(status != "completed", None).when(conclusion == "success", "published").when(F.array_contains(failed_steps, "qr4"), "qr4_failed").otherwise("stage_failed")


def request_state(requests: DataFrame, published: DataFrame, runs: DataFrame, lost_after: int = 90) -> DataFrame:
    """appid, state, ahead of each request (appid, waited): a document settles it, then a run of its own that goes on,
    then how the latest one ended, then whether the request was lost. `runs` has appid, run, created, status, outcome,
    started. The runs that are active are as few as the service runs at once, so they are counted in one window."""
    active = runs.where(~F.col("status").isin(C.ENDED)).withColumn("ahead", F.row_number().over(Window.orderBy("created", "run")) - 1)
    mine = active.groupBy("appid").agg(F.min_by(F.struct("ahead", "started"), F.struct("created", "run")).alias("mine"))
    ended = runs.where(F.col("status").isin(C.ENDED)).groupBy("appid").agg(F.max_by("outcome", F.struct("created", "run")).alias("ended"), F.count("*").alias("n_ended"))
    there = published.select("appid", F.lit(True).alias("there")).distinct()
    rows = requests.join(there, "appid", "left").join(mine, "appid", "left").join(ended, "appid", "left")
    going = F.when(F.col("mine.started") & (F.col("mine.ahead") == 0), "running").otherwise("queued")
    finished = F.when(F.col("ended") != "published", F.col("ended")).otherwise("queued")
    state = F.when(F.col("there"), "published").when(F.col("mine").isNotNull(), going).when(F.col("n_ended") > 0, F.coalesce(finished, F.lit("queued"))).when(F.col("waited") > lost_after, "dispatch_lost").otherwise("queued")
    return rows.select("appid", state.alias("state"), F.when(state == "queued", F.coalesce("mine.ahead", F.lit(0))).cast("long").alias("ahead"))


def wait_copy(seconds: Column) -> Column:
    """How long something takes, in words."""
    return (
        F.when(seconds < 55, "under a minute").when(seconds < 150, "a couple of minutes").when(seconds < 330, "a few minutes").otherwise(F.format_string("around %d minutes", F.bround(seconds / 60).cast("int")))
    )


def usable_cost(value: Column) -> Column:
    """A whole number above 0, else null."""
    n = value.try_cast("int")
    return F.when(value.rlike("^[0-9]+$") & (n > 0), n)


def describe_divergence(flags: DataFrame, label: Callable[[Column], Column]) -> DataFrame:
    """game, line of flags, as cohort_divergence finds them; `label` names a cohort."""
    steps = F.transform("sequence", lambda s: F.format_string("%s %.1f%% (pool_n %d)", label(s["cohort"]), s["pct"], s["pool_n"]))
    head = F.format_string("segmentation [%s], spread %.1f pts: %s", "shape", "gap_pts", F.array_join(steps, " -> "))
    peak = F.format_string("; peaks at %s and falls %.1f pts to %s", label(F.col("peak_cohort")), "drop_after_peak_pts", label(F.col("after_peak_cohort")))
    trough = F.format_string("; troughs at %s", label(F.col("trough_cohort")))
    return flags.select("game", F.concat(head, F.when(F.col("shape") == "rise_then_fall", peak).when(F.col("shape") == "fall_then_rise", trough).otherwise("")).alias("line"))


def model_for(flash_day: Column, scheduled_day: Column, override: Column, force_lite: Column) -> Column:
    """The model of a title: one asked for, else the small one, unless the day it is scheduled for is being spent."""
    return F.coalesce(override, F.when(~force_lite & (flash_day == scheduled_day), "flash").otherwise("flash-lite"))


def shard_pieces(ranked: DataFrame, source: str) -> DataFrame:
    """The pieces of core.json and tail.json, the titles of an index (appid, title, rank, shard) in the order of rank, with
    the bounds of each shard. A shard without titles has its file, too."""
    bounds = [("core", C.CORE_FLOOR, None), ("tail", C.REVIEW_FLOOR, C.CORE_FLOOR - 1)]
    known = ranked.sparkSession.createDataFrame(bounds, "shard string, min_reviews int, max_reviews int")
    counts = ranked.groupBy(F.col("shard").alias("of")).agg(F.count("*").alias("n"))
    order = F.lit("review count descending; the position is the rank").alias("order")
    head = F.to_json(F.struct(F.lit(1).alias("v"), F.lit(source).alias("source"), "min_reviews", "max_reviews", order, F.coalesce("n", F.lit(0)).alias("n")), {"ignoreNullFields": "false"})
    name = F.concat("shard", F.lit(".json")).alias("name")
    heads = known.join(counts, F.col("shard") == F.col("of"), "left").select(name, F.regexp_replace(head, r"\}$", ',"t":[').alias("head"))
    items = ranked.select(name, F.col("rank").alias("seq"), F.to_json(F.array(F.col("appid").cast("string"), "title")).alias("piece"))
    return envelope_pieces(heads, items, "]}")


def extract(candidates: DataFrame, valid, ask, retries: int = 2) -> DataFrame:
    """Claims by rounds: `ask(rows, attempt)` gives claims (key, claim) for the keys still open, `valid(claims)` those
    that pass; what passes stays, and what is open after `retries` more rounds has none. Only the first round may be
    answered from remembered responses."""
    accepted, open_ = [], candidates
    for attempt in range(retries + 1):
        passed = valid(ask(open_, attempt))
        accepted.append(passed)
        open_ = open_.join(passed.select("key").distinct(), "key", "left_anti")
    return reduce(DataFrame.unionByName, accepted)


def failure_report(codes: DataFrame) -> DataFrame:
    """code, subject, n of failure codes (code:subject:...)."""
    parts = F.split("failure", ":")
    return codes.groupBy(F.element_at(parts, 1).alias("code"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("subject")).agg(F.count("*").alias("n"), count_where(F.size(parts) > 2).alias("with_detail"))
