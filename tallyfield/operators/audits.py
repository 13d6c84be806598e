"""Checks and parsers of evaluation inputs and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.rates import count_where, percent


def candidate_problems(cases: DataFrame, corpus: DataFrame, muted: DataFrame) -> DataFrame:
    """problem, game, bucket, claim_id, n of cases (case_id, game, bucket, claim_id, ids): ids that the corpus (game, rid,
    bucket) lacks, ids of another cohort, fewer than two that resolve, claims of a muted cohort, repeated case ids."""
    cited = cases.select("case_id", "game", "bucket", "claim_id", F.explode_outer("ids").alias("rid"))
    known = corpus.select(F.col("game").alias("g"), F.col("rid").alias("known"), F.col("bucket").alias("found"))
    rows = cited.join(known, (F.col("game") == F.col("g")) & (F.col("rid") == F.col("known")), "left")
    claim = ["game", "bucket", "claim_id"]
    sums = rows.groupBy("case_id", *claim).agg(
        count_where(F.col("rid").isNotNull() & F.col("known").isNull()).alias("absent"), count_where(F.col("known").isNotNull() & (F.col("found") != F.col("bucket"))).alias("elsewhere"), F.count("known").alias("resolved")
    )
    parts = [
        sums.where("absent > 0").select(F.lit("absent_from_corpus").alias("problem"), *claim, F.col("absent").alias("n")),
        sums.where("elsewhere > 0").select(F.lit("of_another_cohort").alias("problem"), *claim, F.col("elsewhere").alias("n")),
        sums.where("resolved < 2").select(F.lit("too_few_citations").alias("problem"), *claim, F.col("resolved").alias("n")),
        cases.join(muted.select("game", "bucket").distinct(), ["game", "bucket"], "left_semi").groupBy("game", "bucket").agg(F.count("*").alias("n")).select(F.lit("muted_with_claims").alias("problem"), "game", "bucket", F.lit(None).cast("string").alias("claim_id"), "n"),
        cases.groupBy("case_id").agg(F.min("game").alias("game"), F.min("bucket").alias("bucket"), F.min("claim_id").alias("claim_id"), F.count("*").alias("n")).where("n > 1").select(F.lit("repeated_case_id").alias("problem"), *claim, "n"),
    ]
    return reduce(DataFrame.unionByName, [p.withColumn("n", F.col("n").cast("long")) for p in parts])


def distribution(cases: DataFrame) -> DataFrame:
    """by, name, n by game, by cohort and by theme; one pass by grouping sets."""
    sums = cases.groupingSets([["game"], ["bucket"], ["theme"]], "game", "bucket", "theme").agg(F.grouping_id("game", "bucket", "theme").alias("g"), F.count("*").alias("n"))
    by = F.when(F.col("g") == 3, "game").when(F.col("g") == 5, "cohort").otherwise("theme")
    name = F.when(F.col("g") == 3, F.col("game").cast("string")).when(F.col("g") == 5, F.col("bucket")).otherwise(F.col("theme"))
    return sums.select(by.alias("by"), name.alias("name"), "n")


def leaks(payloads: DataFrame, forbidden: list[str]) -> DataFrame:
    """case_id, leak of payloads (case_id, payload, claim, verdict, positive, negative): a forbidden field's name anywhere,
    the withheld verdict or split in the head, the claim itself taken out."""
    head = F.replace(F.split_part("payload", F.lit("--- CITATION"), F.lit(1)), F.col("claim"), F.lit(""))
    word = lambda x: F.concat(F.lit("\\b"), F.regexp_replace(x, r"([^A-Za-z0-9_])", r"\\$1"), F.lit("\\b"))
    split = F.concat(F.col("positive").cast("string"), F.lit("u/"), F.col("negative").cast("string"), F.lit("d"))
    found = [F.when(F.contains("payload", F.lit(f)), f"field:{f}") for f in forbidden]
    found.append(F.when(F.coalesce(F.regexp_like(head, word(F.col("verdict"))), F.lit(False)), "verdict"))
    found.append(F.when(F.coalesce(F.regexp_like(head, word(split)), F.lit(False)), "split"))
    return payloads.select("case_id", F.explode(F.array_compact(F.array(*found))).alias("leak"))


def aggregate_scores(scores: DataFrame) -> DataFrame:
    """One row of scores (case_id, score, in_cohort, safe): n, pct_two, mean, distribution, zero_ids, in_cohort_pct, outside_ids,
    unsafe_ids, how many scored zero, lie outside their cohort or aren't safe, and result. The ids are in order, joined by commas, null where there are
    none; ranges of them are put in order and joined each in a task, so the last one only puts texts together."""
    ids = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("case_id")))), ",")
    ranges = scores.repartitionByRange("case_id").withColumn("slice", F.spark_partition_id())
    counts = {"n": F.lit(True), "inside": F.col("in_cohort")} | {f"score_{k}": F.col("score") == k for k in (0, 1, 2)} | _failing()
    parts = ranges.groupBy("slice").agg(F.sum("score").alias("total"), F.count("score").alias("scored"), *[count_where(c).alias(name) for name, c in counts.items()], *[ids(c).alias(f"{name}_ids") for name, c in _failing().items()])
    joined = lambda name: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(f"{name}_ids") != "", F.struct("slice", f"{name}_ids")))), lambda x: x[f"{name}_ids"]), ","), F.lit(""))
    sums = parts.agg(F.sum("total").alias("total"), F.sum("scored").alias("scored"), *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counts], *[joined(name).alias(f"{name}_ids") for name in _failing()])
    return sums.select(
        "n",
        percent(F.col("score_2"), F.col("n")).alias("pct_two"),
        F.round(F.col("total") / F.col("scored"), 2).alias("mean"),
        F.concat_ws("/", *[F.col(f"score_{k}").cast("string") for k in (0, 1, 2)]).alias("distribution"),
        F.col("zeros_ids").alias("zero_ids"),
        percent(F.col("inside"), F.col("n")).alias("in_cohort_pct"),
        "outside_ids",
        "unsafe_ids",
        *_failing(),
        F.when(F.col("unsafe") > 0, "fail").otherwise("pass").alias("result"),
    )


def _failing() -> dict[str, Column]:
    return {"zeros": F.col("score") == 0, "outside": ~F.col("in_cohort"), "unsafe": ~F.col("safe")}


def failing_cases(scores: DataFrame) -> DataFrame:
    """failing, case_id: a row for each case and each way in which it fails."""
    ways = [F.when(c, F.lit("zero" if name == "zeros" else name)) for name, c in _failing().items()]
    return scores.select(F.explode(F.array_compact(F.array(*ways))).alias("failing"), "case_id")


def batch_report(titles: DataFrame) -> DataFrame:
    """outcome, n, calls, share_pct and requests per minute of titles (outcome, calls, seconds)."""
    sums = titles.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("calls").alias("calls"), F.sum("seconds").alias("seconds"))
    whole = Window.partitionBy()  # one row for each outcome, a handful
    rate = F.when(F.sum("seconds").over(whole) > 0, F.round(F.sum("calls").over(whole) / (F.sum("seconds").over(whole) / 60), 1))
    return sums.select("outcome", "n", "calls", percent(F.col("n"), F.sum("n").over(whole)).alias("share_pct"), rate.alias("per_minute"))


def worst(deltas: DataFrame, n: int = 25) -> DataFrame:
    """The rows with the least delta_pool; ties by game and bucket."""
    return deltas.where("delta_pool IS NOT NULL").orderBy("delta_pool", "game", "bucket").limit(n)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """`n` rows by the order of a hash of seed and key, so reruns agree."""
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def available_delta(citations: DataFrame, available: DataFrame) -> DataFrame:
    """game, bucket, cited_n, available_n, delta_avail: distinct cited reviews against all that could be cited."""
    once = citations.groupBy("game", "bucket", "rid").agg(F.max_by(F.coalesce("voted_up", F.lit(False)), "order").alias("up"))
    cited = once.groupBy("game", "bucket").agg(F.count("*").alias("cited_n"), count_where(F.col("up")).alias("c"))
    there = available.groupBy("game", "bucket").agg(F.count("*").alias("available_n"), count_where(F.col("voted_up")).alias("a"))
    both = cited.join(there, ["game", "bucket"], "left")
    delta = F.round(percent(F.col("c"), F.col("cited_n")) - percent(F.col("a"), F.col("available_n")), 1)
    return both.select("game", "bucket", "cited_n", F.coalesce("available_n", F.lit(0)).alias("available_n"), delta.alias("delta_avail"))


def night_medians(titles: DataFrame) -> DataFrame:
    """night, n, median, mean of the titles' rates (night, pct)."""
    return titles.groupBy("night").agg(F.count("*").alias("n"), F.round(F.percentile("pct", 0.5), 3).alias("median"), F.round(F.avg("pct"), 3).alias("mean"))


def key_counts(reviews: DataFrame) -> DataFrame:
    """with_hardware, refunded, early_access: how many reviews carry each."""
    return reviews.agg(count_where(F.col("hardware").isNotNull()).alias("with_hardware"), count_where(F.col("refunded")).alias("refunded"), count_where(F.col("early_access")).alias("early_access"))


def response_text(parts: Column) -> Column:
    """The text of a response's parts (text, thought) that aren't thoughts."""
    return F.array_join(F.transform(F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False))), lambda p: F.coalesce(p["text"], F.lit(""))), "")


def parse_response(text: Column, schema: str, required: str) -> Column:
    """parsed and code: invalid_json for what can't be read, missing for what lacks the required field."""
    read = F.from_json(text, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    code = F.when(text.isNull() | read["_corrupt"].isNotNull() | read.isNull(), "invalid_json").when(read[required].isNull(), f"missing:{required}")
    return F.struct(F.when(code.isNull(), read).alias("parsed"), code.alias("code"))


def sheet_entries(sheets: DataFrame) -> DataFrame:
    """sheet, kind, name, bucket, id of an audit sheet's lines (sheet, content), told by their place in the line, never by
    how long an id is."""
    lines = sheets.select("sheet", F.explode(F.split("content", "\n")).alias("line"))
    title, cite = r"^- \[[ x]\] \*\*(.+?)\*\* \(`([0-9]+)`", r"^\s*[0-9]+\. \[[ x]\] (.+?) / (\w+) / `([0-9]+)`"
    get = lambda p, i: F.regexp_extract("line", p, i)
    is_title, is_cite = F.col("line").rlike(title), F.col("line").rlike(cite)
    return lines.where(is_title | is_cite).select(
        "sheet",
        F.when(is_title, "title").otherwise("citation").alias("kind"),
        F.when(is_title, get(title, 1)).otherwise(get(cite, 1)).alias("name"),
        F.when(is_cite, get(cite, 2)).alias("bucket"),
        F.when(is_title, get(title, 2)).otherwise(get(cite, 3)).alias("id"),
    )


def run_title(display: Column, name: Column) -> Column:
    """The title that a run's name tells; null for runs that tell none."""
    return F.nullif(F.regexp_extract(F.coalesce(F.nullif(display, F.lit("")), name, F.lit("")), r"verdict\s+([0-9]+)", 1), F.lit(""))


def rubric_version(text: Column) -> Column:
    found = F.trim(F.regexp_extract(text, r"(?m)^\*\*Version:\*\*[ \t]*([^\r\n]+)$", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown"))


def snapshot(files: DataFrame, ref: str, prefix: str) -> DataFrame:
    """path, content of the files (ref, path, content) at a ref under a prefix."""
    return files.where((F.col("ref") == ref) & F.startswith("path", F.lit(prefix))).select("path", "content")


def lookup(ids: DataFrame, cache: DataFrame) -> DataFrame:
    """appid, name, art, refetch: a cached row without art is fetched again, one that isn't there is null."""
    rows = ids.join(cache.select("appid", "name", "art"), "appid", "left")
    return rows.select("appid", "name", "art", (F.col("name").isNull() | F.col("art").isNull()).alias("refetch"))
