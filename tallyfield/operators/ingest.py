"""From raw pages to reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.rates import bucket_of
from tallyfield.functions.text import unescape

#: The part of a page's payload that the engine reads.
PAGE = """struct<cursor:string,reviews:array<struct<recommendationid:string,review:string,voted_up:boolean,timestamp_created:bigint,timestamp_updated:bigint,
refunded:boolean,written_during_early_access:boolean,steam_purchase:boolean,received_for_free:boolean,primarily_steam_deck:boolean,votes_up:bigint,votes_funny:bigint,weighted_vote_score:string,
author:struct<playtime_at_review:bigint,playtime_forever:bigint,playtime_last_two_weeks:bigint>,hardware:struct<adapter_description:string,cpu_name:string,system_ram:bigint,os:string>>>>"""


def hours(minutes: Column) -> Column:
    """Minutes as hours to one decimal, once and here only; missing ones are 0."""
    return F.round(F.coalesce(minutes, F.lit(0)) / 60, 1)


def normalize(pages: DataFrame) -> DataFrame:
    """One flat review for each of the pages' (appid, filter, page, payload); a payload that can't be parsed gives none,
    and rows without an id go."""
    parsed = pages.select("appid", F.col("filter").alias("source_filter"), "page", F.from_json("payload", PAGE).alias("body"))
    r = parsed.select("appid", "source_filter", "page", F.posexplode("body.reviews").alias("pos", "r")).where("r.recommendationid IS NOT NULL")
    minutes = F.coalesce("r.author.playtime_at_review", F.lit(0))
    same = ["refunded", "steam_purchase", "received_for_free"]
    return r.select(
        "appid",
        "source_filter",
        "page",
        F.col("pos").cast("long").alias("pos"),
        F.col("r.recommendationid").alias("recommendationid"),
        F.coalesce("r.review", F.lit("")).alias("review_text"),
        F.col("r.voted_up").alias("voted_up"),
        hours(F.col("r.author.playtime_at_review")).alias("hours_at_review"),
        hours(F.col("r.author.playtime_forever")).alias("hours_total_now"),
        hours(F.col("r.author.playtime_last_two_weeks")).alias("hours_last_two_weeks"),
        bucket_of(minutes).alias("bucket"),
        F.col("r.timestamp_created").alias("created_ts"),
        F.col("r.timestamp_updated").alias("updated_ts"),
        *[F.col(f"r.{c}").alias(c) for c in same],
        F.col("r.written_during_early_access").alias("early_access"),
        F.col("r.primarily_steam_deck").alias("steam_deck"),
        F.coalesce("r.votes_up", F.lit(0)).alias("votes_up"),
        F.coalesce("r.votes_funny", F.lit(0)).alias("votes_funny"),
        F.coalesce(F.col("r.weighted_vote_score").try_cast("double"), F.lit(0.0)).alias("weighted_vote_score"),
        F.col("r.hardware.adapter_description").alias("gpu"),
        F.col("r.hardware.cpu_name").alias("cpu"),
        F.col("r.hardware.os").alias("os"),
        F.col("r.hardware.system_ram").alias("ram_mb"),
    )


def is_free(price_cell: Column, final: Column) -> Column:
    """From a price cell's text and its attribute: the word decides, then a rendered amount, then the attribute."""
    text = F.lower(F.regexp_replace(price_cell, "<[^>]+>", " "))
    return F.when(text.contains("free"), True).when(text.rlike("[0-9]"), False).otherwise(F.coalesce(final == "0", F.lit(False)))


def capsules(pages: DataFrame) -> DataFrame:
    """appid, suffix of the art addresses with a hash segment in the pages' html; the last page wins."""
    pattern = r"store_item_assets/steam/apps/([0-9]+)/([^\"?]+)"
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).alias("m"))
    parts = found.select("page_id", F.regexp_extract("m", pattern, 1).alias("appid"), F.regexp_extract("m", pattern, 2).alias("suffix")).where("suffix LIKE '%/%'")
    return parts.groupBy("appid").agg(F.max_by("suffix", F.struct("page_id", "suffix")).alias("suffix"))


def merge_known(known: DataFrame, swept: DataFrame) -> DataFrame:
    """The swept entries and those known ones that the sweep missed."""
    return swept.unionByName(known.join(swept.select("appid"), "appid", "left_anti"))


def store_titles(chunks: DataFrame) -> DataFrame:
    """appid, title, reviews, outcome of store rows (chunk): why a row isn't an entry is counted, never dropped silently."""
    c = F.col("chunk")
    appid, title = F.regexp_extract(c, 'data-ds-itemkey="App_([0-9]+)"', 1), F.trim(unescape(F.regexp_extract(c, '<span class="title">([^<]*)</span>', 1)))
    tip = F.regexp_extract(c, 'data-tooltip-html="([^"]*)"', 1)
    count = F.replace(F.regexp_extract(tip, "([0-9,]+) user reviews", 1), F.lit(","), F.lit(""))
    outcome = (
        F.when(appid == "", "not_an_app").when(tip == "", "no_tooltip").when(~c.contains('class="title"'), "no_title").when(count == "", "no_review_count").when(title == "", "empty_title").otherwise("parsed")
    )
    return chunks.select(appid.alias("appid"), title.alias("title"), count.try_cast("long").alias("reviews"), outcome.alias("outcome"))
