"""Fuzzy matches of tokens by joins on keys, in place of comparing all tokens with all.

Two tokens are alike if they are equal, if both have at least four characters and begin with the same four, or if one of
such is within the other. A token that lies within another shows its first four characters somewhere in it, and one that
begins like another shows them at its start. So the alike tokens of two vocabularies are found among those for which the
first four characters of one are a run of four characters of the other; each pair is then looked at itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a key.
RUN = 4


def _runs(token: Column) -> Column:
    """The runs of four characters of a token, each once; none for shorter ones."""
    places = F.when(F.length(token) >= RUN, F.sequence(F.lit(1), F.length(token) - (RUN - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: token.substr(i, F.lit(RUN))))


def alike_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """token, other: the alike pairs of a token of `left` and one of `right` (token), each once."""
    a = left.select("token").where("token IS NOT NULL").distinct()
    b = right.select(F.col("token").alias("other")).where("other IS NOT NULL").distinct()
    begins = lambda c: F.substring(c, 1, RUN)
    keyed_a = a.where(F.length("token") >= RUN).select("token", begins("token").alias("key"))
    runs_b = b.select("other", F.explode(_runs(F.col("other"))).alias("key"))
    within_b = keyed_a.join(runs_b, "key").where((begins("token") == begins("other")) | F.contains("other", "token"))
    keyed_b = b.where(F.length("other") >= RUN).select("other", begins("other").alias("key"))
    runs_a = a.select("token", F.explode(_runs(F.col("token"))).alias("key"))
    within_a = runs_a.join(keyed_b, "key").where(F.contains("token", "other"))
    short = a.where(F.length("token") < RUN).join(b, F.col("token") == F.col("other"))
    pairs = [x.select("token", "other") for x in (within_b, within_a, short)]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct()


def hits(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """left_key, right_key, token: for each of `pairs` (left_key, right_key), the tokens of the left side (left_key, token)
    that are alike to one of the right side (right_key, token). Rows meet by the token and the key that they are for, so no
    join gathers all that share a frequent token."""
    alike = alike_tokens(left, right)
    wanted = left.join(alike, "token").select("left_key", "token", "other")
    shown = pairs.select("left_key", "right_key").distinct().join(right.select("right_key", F.col("token").alias("other")), "right_key")
    return shown.join(wanted, ["left_key", "other"]).select("left_key", "right_key", "token").distinct()
