"""Smaller operators around audits, retries and releases."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield import config as C
from tallyfield.functions.rates import pacific_day

#: The sentence for each failure code, as a writer is told; {} is what the code names. None speaks of shared
#: words, which would teach a writer to repeat the reviews.
PROBLEMS = {
    "ids_not_in_corpus": "it cites reviews that do not exist",
    "cited_outside_bucket": "it cites reviews of another cohort",
    "low_union_coverage": "the cited reviews do not mention it",
    "only": "too few of the cited reviews mention it",
    "prevalence_language": "it says how many people think so ({})",
}


def annotated_first(citations: DataFrame) -> DataFrame:
    """claim, rid, place: a claim's citations with annotated ones first, else in their order."""
    order = Window.partitionBy("claim").orderBy(F.when(F.size("annotations") > 0, 0).otherwise(1), "pos")
    return citations.select("claim", "rid", F.row_number().over(order).alias("place"))


def keep_last(log: DataFrame, n: int) -> DataFrame:
    """The last `n` rows of each ledger by time, then id."""
    last = Window.partitionBy("ledger").orderBy(F.desc("ts"), F.desc("id"))
    return log.withColumn("_place", F.row_number().over(last)).where(F.col("_place") <= n).drop("_place")


def shortlist(reasons: DataFrame) -> DataFrame:
    """case_id, reason: the first reason, by priority, why a case is worth a second look."""
    return reasons.groupBy("case_id").agg(F.min_by("reason", F.struct("priority", "reason")).alias("reason"))


def reconcile(local: DataFrame, remote: DataFrame) -> DataFrame:
    """day, used: of two counts of the same day the larger."""
    there = remote.select("day", F.col("used").alias("remote_used"))
    return local.join(there, "day", "full").select("day", F.greatest("used", "remote_used").alias("used"))


def lowered_ceiling(reports: DataFrame) -> DataFrame:
    """day, ceiling: what the service reports can only lower a day's ceiling."""
    return reports.groupBy("day").agg(F.least(F.lit(C.REQUESTS_PER_MINUTE), F.min("reported")).alias("ceiling"))


def settle(facts: DataFrame) -> DataFrame:
    """appid, run, actual: each run is settled once, however often it is reported; a known cost beats none, and the first
    of several stays."""
    return facts.groupBy("appid", "run").agg(F.min_by("actual", F.struct(F.col("actual").isNull(), F.col("seen"))).alias("actual"))


def explain(failure: Column) -> Column:
    """A failure code as a sentence, with what it names; another code stays as it is."""
    code, names = F.regexp_extract(failure, "^(only|[a-z_]+)", 1), F.regexp_extract(failure, "^[^:]*:(.*)$", 1)
    out = failure
    for known, sentence in PROBLEMS.items():
        head, named, tail = sentence.partition("{}")
        out = F.when(code == known, F.concat(F.lit(head), names, F.lit(tail)) if named else F.lit(sentence)).otherwise(out)
    return out


def problem_lines(claims: DataFrame) -> DataFrame:
    """claim_key, line: what a writer is told about each claim (claim_key, claim, failures) that failed, in the order of its
    failures, which semicolons part."""
    told = F.array_join(F.transform(F.split("failures", ";"), explain), "; ")
    return claims.where("failures <> ''").select("claim_key", F.concat(F.lit('- "'), "claim", F.lit('"\n    problem: '), told).alias("line"))


def cost_block(log: DataFrame) -> DataFrame:
    """key, day, model_calls, basis: what a title was charged on a day."""
    sums = log.groupBy("key", pacific_day(F.col("ts")).alias("day")).agg(F.count("*").alias("model_calls"))
    return sums.withColumn("basis", F.format_string("%d calls charged on %s", "model_calls", "day"))


def card(documents: DataFrame) -> DataFrame:
    """game, title, description of a document's unfurled link; description falls back to the word."""
    return documents.select("game", F.concat_ws(": ", F.col("game").cast("string"), F.col("word")).alias("title"), F.coalesce(F.nullif(F.trim("tagline"), F.lit("")), "word", F.lit("")).alias("description"))


def releasable(prunes: DataFrame, unpublished: DataFrame, forced: bool, ref: str) -> DataFrame:
    """The keys to prune, or none where unpublished work would be lost; refuses refs that aren't remote."""
    if not ref.startswith("origin/"):
        raise ValueError(f"{ref} is not a remote ref")
    keys = prunes.where("prune").select("key")
    if forced:
        return keys
    return keys if unpublished.where("take").isEmpty() else keys.limit(0)


def banned_words() -> list[str]:
    """Plain words of the prevalence guard's patterns that it rejects on their own, or before a crowd of people: what a
    writer has to be told, so that the guard and the prompt agree."""
    words = set().union(*(re.findall("[a-z]{2,}", re.sub(r"\\[a-zA-Z]|\(\?[<!:=]*", " ", pattern)) for pattern, _ in C.PREVALENCE))
    rejected = lambda text: any(re.search(pattern, text, re.I) for pattern, _ in C.PREVALENCE)
    return sorted(w for w in words if any(rejected(carrier % w) for carrier in C.CARRIERS))


def remote_ledger(spark: SparkSession, path: str, today: str) -> int:
    """The requests that a remote ledger holds for `today`: 0 for another day. A ledger that can't be read, or has no day
    or no whole count of at least 0, raises."""
    row = spark.read.schema("date string, used string").option("multiLine", True).json(path).first()
    if row is None or not row.date or not re.fullmatch(r"\d{4}-\d\d-\d\d", row.date) or not re.fullmatch(r"\d+", row.used or ""):
        raise ValueError("the remote ledger can't be read")
    return int(row.used) if row.date == today else 0
