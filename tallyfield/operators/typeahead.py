"""Typeahead for many queries at once, by an index of runs of characters.

A title is posted under each of its runs of one, two and three characters. A query of up to two characters is itself a key; a
longer one takes that of its runs of three that the fewest titles have, so that queries which share a frequent beginning
don't all read what it is in. What meets under a key is then looked at itself, and of each query the best hits stay: those
of a task first, so no query's hits are gathered before they are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.text import normal_title
from tallyfield.package import cut

#: The longest key.
RUN = 3
EXACT, STARTS, STARTS_A_WORD, WITHIN = range(4)


def _runs(text: Column, size: int) -> Column:
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: text.substr(i, F.lit(size))))


def tier_of(title: Column, query: Column) -> Column:
    """How well a normal query fits a normal title, 0 being the best; null if it isn't in it. Only its first occurrence
    decides whether a word starts with it."""
    at = F.instr(title, query)
    word = F.substring(title, at - 1, F.lit(1)) == " "
    return F.when(title == query, EXACT).when(at == 1, STARTS).when((at > 1) & word, STARTS_A_WORD).when(at > 1, WITHIN)


def postings(entries: DataFrame) -> DataFrame:
    """key, appid, title, rank, normal: every title (appid, title, rank) under each of its keys."""
    rows = entries.select("appid", "title", "rank", normal_title(F.col("title")).alias("normal"))
    keys = F.concat(*[_runs(F.col("normal"), n) for n in range(1, RUN + 1)])
    return rows.select("*", F.explode(keys).alias("key"))


def _keyed(queries: DataFrame, index: DataFrame) -> DataFrame:
    """normal, key of the distinct normal queries; one that no title can hold has no row."""
    short = queries.where(F.length("normal") < RUN).select("normal", F.col("normal").alias("key"))
    counts = index.where(F.length("key") == RUN).groupBy("key").agg(F.count("*").alias("n"))
    runs = queries.where(F.length("normal") >= RUN).select("normal", F.explode(_runs(F.col("normal"), RUN)).alias("key"))
    found = runs.join(counts, "key", "left")
    best = found.groupBy("normal").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    return short.unionByName(best)


def typeahead(entries: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """query, place, appid, title, rank, tier: the best hits of each distinct query (query) among the titles (appid, title,
    rank), by tier, rank and appid; ranks go on from shard to shard. Blank queries have no hits."""
    asked = queries.select("query", normal_title(F.col("query")).alias("normal")).where("normal <> ''").distinct()
    index = cut(postings(entries))
    keyed = _keyed(asked.select("normal").distinct(), index)
    hits = keyed.withColumnRenamed("normal", "asked").join(index, "key").withColumn("tier", tier_of(F.col("normal"), F.col("asked"))).where("tier IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("asked").orderBy("tier", "rank", "appid"))
    best = hits.select("asked", "appid", "title", "rank", "tier").withColumn("place", place).where(F.col("place") <= limit)
    return asked.join(best, F.col("normal") == F.col("asked")).select("query", "place", "appid", "title", "rank", "tier")
