"""The catalog: store rows, ranking, selection, search and its integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield import config as C
from tallyfield.functions.rates import count_where
from tallyfield.functions.text import normal_title, unescape
from tallyfield.operators.ranks import by_range, ranked, running


def html_rows(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, title, outcome of every link of the pages: each is parsed on its own, from one anchor to the
    next, so that titles and addresses never pair across rows."""
    chunks = pages.select("page_id", F.posexplode(F.slice(F.split("html", "<a "), F.lit(2), F.greatest(F.size(F.split("html", "<a ")) - 1, F.lit(0)))).alias("pos", "chunk"))
    href = F.regexp_extract("chunk", 'href="([^"]*)"', 1)
    title = F.trim(unescape(F.regexp_replace(F.regexp_extract("chunk", ">([^<]*)</a>", 1), "<[^>]*>", "")))
    rows = chunks.select("page_id", F.col("pos").cast("long").alias("pos"), href.alias("href"), title.alias("title"))
    outcome = F.when(F.col("href") == "", "no_address").when(F.col("title") == "", "empty_title").when(~F.col("href").startswith("/"), "external").otherwise("parsed")
    return rows.withColumn("outcome", outcome)


def row_accounting(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


def best_per_key(entries: DataFrame) -> DataFrame:
    """Of entries that share an appid, the one with most reviews; on a tie the first by place, or without one the lower
    title."""
    tie = -F.col("place") if "place" in entries.columns else F.lit(0)
    rows = entries.withColumn("tie", tie)
    best = F.max_by(F.struct("title", "reviews"), F.struct("reviews", "tie"))
    if "place" not in entries.columns:
        best = F.min_by(F.struct("title", "reviews"), F.struct((-F.col("reviews")).alias("least"), "title"))
    return rows.groupBy("appid").agg(best.alias("x")).select("appid", "x.title", "x.reviews")


def classify_titles(catalog: DataFrame, free: DataFrame, live: DataFrame, exempt: DataFrame) -> DataFrame:
    """`catalog` with live and basis from the lists (appid, note): free titles and those on the live list are live, unless
    an audit exempts them."""
    mark = lambda df, name: df.groupBy("appid").agg(F.min("note").alias(name), F.lit(True).alias(f"is_{name}"))
    rows = catalog.join(mark(free, "free"), "appid", "left").join(mark(live, "listed"), "appid", "left").join(mark(exempt, "exempt"), "appid", "left")
    on = lambda n: F.coalesce(f"is_{n}", F.lit(False))
    basis = (
        F.when(on("exempt"), F.concat(F.lit("free, audited as single-player: "), "exempt"))
        .when(on("free"), "free-to-play")
        .when(on("listed"), F.concat(F.lit("audited: "), "listed"))
        .otherwise("priced, not on the live-service list")
    )
    return rows.select(*catalog.columns, (on("free") & ~on("exempt") | on("listed")).alias("live"), basis.alias("basis"))


def add_extra(chosen: DataFrame, extra: DataFrame, have: DataFrame, duplicates: DataFrame) -> DataFrame:
    """appid, title, basis: `chosen` and the audited extra titles (appid, note) that no other list has."""
    rest = extra
    for known in (chosen, have, duplicates):
        rest = rest.join(known.select("appid"), "appid", "left_anti")
    title = F.coalesce(F.nullif("note", F.lit("")), F.col("appid").cast("string"))
    return chosen.select("appid", "title", "basis").unionByName(rest.select("appid", title.alias("title"), F.lit("audited list").alias("basis")))


def rank_entries(entries: DataFrame, floor: int = C.REVIEW_FLOOR) -> DataFrame:
    """appid, title, reviews, rank, shard of the entries above the floor; ranks are by reviews, then appid, then title."""
    order = F.desc("reviews"), F.asc("appid"), F.asc("title")
    dealt = by_range(entries.where(F.col("reviews") >= floor).select("appid", "title", "reviews"), *order)
    shard = F.when(F.col("reviews") >= C.CORE_FLOOR, "core").otherwise("tail")
    return ranked(dealt, *order).select("appid", "title", "reviews", "rank", shard.alias("shard"))


def select_capped(entries: DataFrame, target: int, cap: int, first_night: int) -> DataFrame:
    """The walk down the ranking (appid, rank, live, have, duplicate): premium titles and at most `cap` live ones fill the
    slots until there are `target`; what is beyond the cap before that is reported as skipped, duplicates as dropped, and
    titles that are there already are passed over. outcome: chosen, skipped, dropped; night for the chosen. The walk is two
    running sums over ranges of the ranking."""
    open_ = ~F.col("duplicate") & ~F.col("have")
    rows = running(by_range(entries, "rank"), {"live_before": (open_ & F.col("live")).cast("int")}, "rank")
    rows = rows.withColumn("fits", open_ & (~F.col("live") | (F.col("live_before") < cap)))
    rows = running(rows, {"before": F.col("fits").cast("int")}, "rank")
    rows = rows.where(F.col("before") < target).where(F.col("duplicate") | ~F.col("have"))
    outcome = F.when(F.col("duplicate"), "dropped").when(F.col("fits"), "chosen").otherwise("skipped")
    night = F.when(outcome == "chosen", F.when(F.col("before") < first_night, 1).otherwise(2))
    return rows.select("appid", "rank", "live", outcome.alias("outcome"), night.alias("night"))


def search(ranked: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """appid, title, rank, tier of the best matches. Only the first occurrence decides whether a word starts with it."""
    q = normal_title(F.lit(query))
    t = normal_title(F.col("title"))
    at = F.instr(t, q)
    tier = F.when(t == q, 0).when(at == 1, 1).when((at > 1) & (F.substring(t, at - 1, F.lit(1)) == " "), 2).when(at > 1, 3)
    return ranked.withColumn("tier", F.when(q != "", tier)).where("tier IS NOT NULL").orderBy("tier", "rank").limit(limit).select("appid", "title", "rank", "tier")


def verify_index(entries: DataFrame, source: DataFrame, seeds: DataFrame | None = None, spots: DataFrame | None = None) -> DataFrame:
    """problem, n: duplicate ids, entries below the floor, ranks out of order, a shard on the wrong side, and source rows
    that neither the index nor the floor accounts for; of `seeds` (appid) those that are missing, and of `spots` (appid,
    title) those that are absent or have another title, which alone tells that titles and ids were paired wrongly."""
    order = F.asc("rank"), F.asc("appid"), F.desc("reviews")
    dealt = by_range(entries, *order)
    checks = dealt.agg(
        (F.count("*") - F.count_distinct("appid")).alias("duplicate_ids"),
        count_where(F.col("reviews") < C.REVIEW_FLOOR).alias("below_floor"),
        count_where((F.col("shard") == "core") != (F.col("reviews") >= C.CORE_FLOOR)).alias("wrong_shard"),
        (F.max("rank") - F.count("*")).alias("rank_gaps"),
        (-F.count_distinct("appid")).alias("unaccounted"),
    )
    # within a range by the row before, between ranges by the last row of the one before
    before = F.lag("reviews").over(Window.partitionBy("range").orderBy(*order))
    place = F.struct("rank", "appid", -F.col("reviews"))
    marked = dealt.withColumn("bad", F.coalesce(F.col("reviews") > before, F.lit(False)))
    ranges = marked.groupBy("range").agg(count_where(F.col("bad")).alias("bad"), F.min_by("reviews", place).alias("first"), F.max_by("reviews", place).alias("last")).collect()
    ranges.sort(key=lambda r: r["range"])
    bad = sum(r.bad for r in ranges) + sum(b.first > a.last for a, b in zip(ranges, ranges[1:]) if a.last is not None and b.first is not None)
    whole = source.agg(count_where(F.col("reviews") >= C.REVIEW_FLOOR).alias("unaccounted"), F.lit(bad).cast("long").alias("out_of_order"))
    titles = entries.groupBy(F.col("appid").alias("there")).agg(F.min("title").alias("has")) if "title" in entries.columns else entries.select(F.col("appid").alias("there"), F.lit(None).cast("string").alias("has")).distinct()
    sums = [checks, whole]
    if seeds is not None:
        sums.append(seeds.join(titles, F.col("appid") == F.col("there"), "left_anti").agg(F.count("*").alias("missing_seeds")))
    if spots is not None:
        both = spots.join(titles, F.col("appid") == F.col("there"), "left")
        sums.append(both.agg(count_where(F.col("there").isNull()).alias("spot_absent"), count_where(F.col("there").isNotNull() & ~F.col("has").eqNullSafe(F.col("title"))).alias("spot_title")))
    parts = None
    for one in sums:
        pairs = [F.struct(F.lit(n).alias("problem"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n")) for n in one.columns]
        rows = one.select(F.explode(F.array(*pairs)).alias("x")).select("x.problem", "x.n")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.groupBy("problem").agg(F.sum("n").alias("n"))
