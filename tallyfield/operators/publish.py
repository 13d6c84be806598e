"""What is published, pruned and withheld."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield import config as C
from tallyfield.functions.rates import count_where
from tallyfield.functions.text import block_pattern, leet


def select_publishable(branch: DataFrame, main: DataFrame) -> DataFrame:
    """key, take, why of every document on the branch (key, generated): taken if main has none that can be read, or an older
    one. A document without a stamp can't be read, and is refused."""
    there = main.select(F.col("key").alias("main_key"), F.col("generated").alias("main_generated"))
    both = branch.join(there, F.col("key") == F.col("main_key"), "left")
    mine, other = F.col("generated"), F.col("main_generated")
    why = F.when(mine.isNull(), "unreadable").when(other.isNull(), "absent").when(mine > other, "newer").when(mine == other, "same").otherwise("older")
    return both.select("key", why.isin("absent", "newer").alias("take"), why.alias("why"))


def prune(branch: DataFrame, main: DataFrame, appeared: DataFrame, now: Column) -> DataFrame:
    """key, prune, keep_because of every document on the branch: one goes only if main has a newer one, which first appeared
    there (key, ts) long enough ago. What may be published, ties, what can't be read, and documents whose appearance has no
    date or is too recent, stay."""
    first = appeared.groupBy(F.col("key").alias("seen_key")).agg(F.min("ts").alias("first_seen"))
    both = select_publishable(branch, main).join(first, F.col("key") == F.col("seen_key"), "left")
    recent = F.col("first_seen") > now - F.expr(f"INTERVAL {C.PRUNE_AFTER_HOURS} HOURS")
    kept = (
        F.when(F.col("take"), F.concat(F.lit("publishable:"), F.col("why")))
        .when(F.col("why") != "older", F.col("why"))
        .when(F.col("first_seen").isNull(), "no_promotion_date")
        .when(recent, "inside_deploy_window")
    )
    return both.select("key", kept.isNull().alias("prune"), kept.alias("keep_because"))


def safety_gate(citations: DataFrame, blocked: list[str]) -> DataFrame:
    """game, citations, hits, withheld: one blocked citation (game, text) withholds the whole document."""
    hit = leet(F.coalesce("text", F.lit(""))).rlike(block_pattern(blocked))
    return citations.groupBy("game").agg(F.count("*").alias("citations"), count_where(hit).alias("hits"), F.bool_or(hit).alias("withheld"))
