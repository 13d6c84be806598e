"""Whole documents: cohorts with their pool, ordered claims with citations, sourcing, flags with sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield import config as C
from tallyfield.functions.rates import bucket_rank
from tallyfield.sources.entity_files import envelope_pieces

#: How cohorts are called.
LABELS = {"refund_window": "<2h refund window", "early": "2-20h", "mid": "20-100h", "veteran": "100h+"}
RANGES = {"refund_window": "under 2 hours", "early": "2-20 hours", "mid": "20-100 hours", "veteran": "100+ hours"}
#: The sentences under a cohort's rate.
NOTE = "The rate above covers all reviews in this cohort. The points below come from the reviews that described something specific"
NOTE_ENDS = {
    "few_and_more_negative": " — here, an unusually small set of them, leaning more negative than the cohort above.",
    "few": " — here, an unusually small set of them.",
    "more_negative": " — here, reviews leaning more negative than the cohort above.",
    "base": ".",
}


def _named(key: Column, names: dict[str, str], other: Column) -> Column:
    out = other
    for k, v in names.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def cohort_label(bucket: Column) -> Column:
    return _named(bucket, LABELS, bucket)


def cohort_hours(bucket: Column) -> Column:
    """The bounds in hours, as a prompt has them; minutes never reach one."""
    spans = {name: f"{low / 60:g}+ hours played" if high is None else f"{low / 60:g}-{high / 60:g} hours played" for name, low, high in C.BUCKETS}
    return _named(bucket, spans, F.lit("unknown playtime"))


def sourcing_sentence(code: Column) -> Column:
    """The sentence of a code of `serving.sourcing_note`; null without one."""
    return F.when(code.isNotNull(), F.concat(F.lit(NOTE), _named(code, NOTE_ENDS, F.lit("."))))


def signed(x: Column) -> Column:
    return F.format_string("%+.1f", x)


def prefer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `first`, and those of `second` whose keys it doesn't have."""
    return first.unionByName(second.select(*first.columns).join(first.select(*keys).distinct(), keys, "left_anti"))


def cohort_sections(games: DataFrame, report: DataFrame, pool: DataFrame) -> DataFrame:
    """Every cohort of every game in the fixed order: pool_n, pct_positive (null without), muted, surviving, label, hours.
    `report` has game, bucket, kept, muted; `pool` game, bucket, pool_n, pct_positive."""
    rows = games.select("game").distinct().select("game", F.explode(F.array(*map(F.lit, C.BUCKET_NAMES))).alias("bucket"))
    rows = rows.join(report.select("game", "bucket", F.col("kept").alias("surviving"), "muted"), ["game", "bucket"], "left")
    rows = rows.join(pool.select("game", "bucket", "pool_n", "pct_positive"), ["game", "bucket"], "left")
    b = F.col("bucket")
    return rows.select("game", "bucket", "pool_n", "pct_positive", F.coalesce("muted", F.lit(False)).alias("muted"), "surviving", cohort_label(b).alias("label"), _named(b, RANGES, b).alias("hours_range"))


def ordered_claims(claims: DataFrame, listed: DataFrame) -> DataFrame:
    """`claims` (game, bucket, claim_id, seq, ...) with key: those that the response lists come first, in its order, then
    the others in their own; none is left out."""
    places = listed.groupBy("game", "bucket", "claim_id").agg(F.min("pos").alias("pos"))
    joined = claims.join(places, ["game", "bucket", "claim_id"], "left")
    return joined.withColumn("key", F.struct(F.col("pos").isNull().alias("rest"), F.coalesce("pos", "seq").alias("at"), F.col("claim_id"))).drop("pos")


def themes(claims: DataFrame) -> DataFrame:
    """game, bucket, themes: claims (with key, citation_verdict, positive, negative, citations) by theme, themes and claims
    in the order of key. A cohort's claims are what its responses said, a bounded number."""
    claim = F.struct("key", "claim_id", "claim", "citation_verdict", F.struct("positive", "negative").alias("citation_split"), "citations")
    by_theme = claims.groupBy("game", "bucket", "theme").agg(F.array_sort(F.collect_list(claim)).alias("claims"))
    shown = F.transform("claims", lambda c: F.struct(*[c[n].alias(n) for n in ("claim_id", "claim", "citation_verdict", "citation_split", "citations")]))
    item = F.struct(F.col("claims")[0]["key"].alias("first"), "theme", shown.alias("claims"))
    grouped = by_theme.groupBy("game", "bucket").agg(F.array_sort(F.collect_list(item)).alias("themes"))
    return grouped.withColumn("themes", F.transform("themes", lambda t: F.struct(t["theme"].alias("theme"), t["claims"].alias("claims"))))


def flags_with_sentences(flags: DataFrame, sentences: DataFrame) -> DataFrame:
    """game, flags: each detected flag (game, flag_id, direction, shape) with what was written about it, or null; a flag
    has a direction or a shape, never both."""
    rows = flags.join(sentences.select("game", "flag_id", "sentence"), ["game", "flag_id"], "left")
    flag = F.struct("flag_id", F.when(F.col("shape").isNull(), F.col("direction")).alias("direction"), "shape", "sentence")
    return rows.groupBy("game").agg(F.array_sort(F.collect_list(flag)).alias("flags"))


def assemble_documents(sections: DataFrame, themed: DataFrame, summaries: DataFrame, sourcing: DataFrame, flags: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One document per game: verdict, split_bar, cohorts (muted ones with a note and nothing else), flags, footer. One row
    of four cohorts a game meets in each aggregation."""
    rows = sections.join(themed, ["game", "bucket"], "left").join(summaries.select("game", "bucket", "summary"), ["game", "bucket"], "left")
    source = F.struct("triggers", "level", "cited_reviews", "cited_recommend", "divergence_p").alias("sourcing")
    rows = rows.join(sourcing.select("game", "bucket", source), ["game", "bucket"], "left")
    none = F.array().cast(themed.schema["themes"].dataType)
    live = ~F.col("muted")
    shown = F.when(live, F.coalesce("themes", none)).otherwise(none)
    note = F.when(F.col("muted"), F.concat(F.lit("n="), F.coalesce(F.col("surviving").cast("string"), F.lit("None")), F.lit(" - too few reviews to call")))
    bar = F.struct(bucket_rank(F.col("bucket")).alias("rank"), "bucket", "label", "pool_n", "pct_positive", "muted")
    cohort = F.struct(
        bucket_rank(F.col("bucket")).alias("rank"), "bucket", "label", "hours_range", "pool_n", "pct_positive", "muted", note.alias("n_note"),
        F.when(live, F.nullif("summary", F.lit(""))).alias("summary"), shown.alias("themes"), F.when(live & (F.size(shown) > 0), F.col("sourcing")).alias("sourcing"),
    )
    docs = rows.groupBy("game").agg(
        F.array_sort(F.collect_list(bar)).alias("split_bar"), F.array_sort(F.collect_list(cohort)).alias("cohorts"), F.sum("pool_n").alias("pool_n"), F.sum(live.cast("int")).alias("cohort_count")
    )
    docs = docs.join(verdicts, "game").join(flags, "game", "left")
    no_flags = F.array().cast(flags.schema["flags"].dataType)
    return docs.select("game", F.struct("word", "mean_pct").alias("verdict"), "split_bar", "cohorts", F.coalesce("flags", no_flags).alias("flags"), F.struct("pool_n", "cohort_count").alias("footer"))


def claim_rows(documents: DataFrame) -> DataFrame:
    """game, bucket, theme_place, theme, claim_place, claim_id of nested documents, in their order."""
    cohorts = documents.select("game", F.explode("cohorts").alias("c"))
    by_theme = cohorts.select("game", F.col("c.bucket").alias("bucket"), F.posexplode("c.themes").alias("theme_place", "t"))
    return by_theme.select("game", "bucket", "theme_place", F.col("t.theme").alias("theme"), F.posexplode("t.claims").alias("claim_place", "x")).select(
        "game", "bucket", "theme_place", "theme", "claim_place", F.col("x.claim_id").alias("claim_id")
    )


def describe_recency(flags: DataFrame) -> DataFrame:
    """game, line of flags (game, days, delta_pts, recent_pct, recent_n, lifetime_pct, lifetime_n)."""
    return flags.select(
        "game",
        F.format_string("recency: last %d days of the pool run %s pts vs lifetime (%.1f%% of %d pooled vs %.1f%% of %d lifetime)", "days", signed(F.col("delta_pts")), "recent_pct", "recent_n", "lifetime_pct", "lifetime_n").alias("line"),
    )


def synthesis_turn(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """game, turn: what a model is told before it writes: the settled word, each cohort with its claims, the flags. `lines`
    has game, flag_id, line."""
    claim = lambda t, c: F.concat(
        F.lit("\n   "), c["claim_id"], F.lit(" ("), t["theme"], F.lit(") "), c["claim"], F.lit("\n        cited: "),
        c["citation_split"]["positive"].cast("string"), F.lit(" recommend, "), c["citation_split"]["negative"].cast("string"), F.lit(" do not"),
    )
    head = lambda c: F.concat(F.lit("\n\n["), c["bucket"], F.lit("] "), c["hours_range"])
    body = lambda c: F.array_join(F.flatten(F.transform(c["themes"], lambda t: F.transform(t["claims"], lambda x: claim(t, x)))), "")
    rate = lambda c: F.concat(F.lit(" - "), F.coalesce(c["pct_positive"].cast("string"), F.lit("no")), F.lit("% positive"))
    cohorts = F.array_join(F.transform("cohorts", lambda c: F.when(c["muted"], F.concat(head(c), F.lit(" - MUTED: nothing is written about it"))).otherwise(F.concat(head(c), rate(c), body(c)))), "")
    told = lines.groupBy("game").agg(F.array_sort(F.collect_list(F.struct("flag_id", "line"))).alias("told"))
    flags = F.array_join(F.transform("told", lambda f: F.concat(F.lit("\n   flag_id="), f["flag_id"], F.lit("  "), f["line"])), "")
    rows = documents.join(told, "game", "left")
    tail = F.when(F.col("told").isNotNull(), F.concat(F.lit("\n\nPATTERNS, one sentence each:"), flags)).otherwise("")
    word = F.coalesce("verdict.word", F.lit("none"))
    return rows.select("game", F.concat(F.lit("Game: "), F.col("game").cast("string"), F.lit("\n\nVERDICT (settled): "), word, F.lit("\n\nCOHORTS:"), cohorts, tail).alias("turn"))


def card(documents: DataFrame, site: str, cdn: str) -> DataFrame:
    """appid, title, description, url, image of documents (appid, game_name, word, tagline, header_image)."""
    image = F.coalesce("header_image", F.concat(F.lit(f"{cdn}/"), F.col("appid").cast("string"), F.lit("/header.jpg")))
    return documents.select(
        "appid", F.concat("game_name", F.lit(": "), "word").alias("title"), F.col("tagline").alias("description"), F.concat(F.lit(f"{site}/verdict/"), F.col("appid").cast("string")).alias("url"), image.alias("image")
    )


def art_pieces(capsules: DataFrame, indexed: DataFrame, name: str = "art.json") -> DataFrame:
    """The pieces of a file with the art suffixes (appid, suffix) of the titles in the index, in the order of appid."""
    kept = capsules.join(indexed.select("appid").distinct(), "appid", "left_semi")
    quoted = F.regexp_extract(F.to_json(F.array("suffix")), r"^\[(.*)\]$", 1)
    items = kept.select(F.lit(name).alias("name"), F.col("appid").alias("seq"), F.concat(F.lit('"'), F.col("appid").cast("string"), F.lit('":'), quoted).alias("piece"))
    heads = kept.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.format_string('{"v":1,"n":%d,"c":{', "n").alias("head"))
    return envelope_pieces(heads, items, "}}")


def art_changes(stored: DataFrame, found: DataFrame) -> DataFrame:
    """appid, art: documents whose stored art differs from what was found; nothing found changes nothing."""
    both = stored.select("appid", F.col("art").alias("old")).join(found.select("appid", F.col("art").alias("new")), "appid")
    return both.where(F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))).select("appid", F.col("new").alias("art"))


def named_only(titles: DataFrame) -> DataFrame:
    """The titles; fails on one without a name, which must not be published."""
    return titles.withColumn("name", F.when(F.trim("name") != "", F.col("name")).otherwise(F.raise_error(F.concat(F.lit("no name for title "), F.col("appid").cast("string")))))
