"""Quality rules by distribution divergence, in DataFrame functions only.

Every document gives two histograms: its characters by class and, for each language with a list of common words, its
words by list entry, with one class for all other words. The references are the same histograms summed over all
documents of a language that are long enough. A document diverges from a language if the Jensen-Shannon distance (base
2, from 0 to 1) of either histogram to its reference passes the limit, and is rejected if it diverges from every
language; one in a language of which there is no reference isn't judged by the method. Guards: with fewer than MIN_WORDS words the method rejects nothing, and with fewer than MIN_LIST_WORDS the
words by list entry are not compared, as short histograms lie far from any reference by chance.

Defined results: null texts count as empty and fail the base rules; without a reference nothing is rejected by the
method; languages without a list give no reference, and their documents stay; null is compared with all; rows that repeat are judged each; an empty table
gives no rows; other columns are ignored by `judge` and kept by `keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tallyfield.llm.common import SPACE, cut, text_mark, without

#: Common words by language.
COMMON_WORDS = {
    "de": ["das", "den", "der", "die", "ein", "ist", "nicht", "sich", "und", "von", "zu", "mit"],
    "en": ["and", "are", "for", "in", "is", "it", "of", "on", "that", "the", "to", "was"],
    "es": ["con", "de", "el", "en", "la", "las", "los", "para", "por", "que", "un", "y"],
    "fr": ["dans", "de", "des", "du", "est", "et", "la", "le", "les", "pour", "que", "une"],
}
#: Classes of characters, each taken from what the ones before have left; the rest is the last class.
CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "letter": "\\p{L}+", "digit": "[0-9]+", "symbol": "[#*$%&|<>]+", "mark": "[!-/:-@\\[-`{-~]+"}
MIN_WORDS, MIN_LIST_WORDS = 50, 100
CHAR_LIMIT, WORD_LIMIT = 0.3, 0.24
MIN_BASE_WORDS, MAX_REPEATED_PERCENT = 50, 50


def features(docs: DataFrame) -> DataFrame:
    """doc_id, mark, lang and the counts of every document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    chars (by class) and, by language, common (by word)."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark(F.col("text")).alias("mark"), lang.alias("lang"), F.coalesce("text", F.lit("")).alias("t"))
    # layers, so that each costly expression is evaluated once
    rows = rows.select("*", F.btrim("t", F.lit(" \t\n\x0b\x0c\r")).alias("inner"), F.regexp_replace("t", f"[{SPACE}]+", "").alias("left0"))
    for k, pattern in enumerate(CLASSES.values()):
        rows = rows.select("*", F.regexp_replace(f"left{k}", pattern, "").alias(f"left{k + 1}"))
    size = len(CLASSES)
    counts = [F.length(f"left{k}") - F.length(f"left{k + 1}") for k in range(size)]
    chars = F.array(*[c.cast("long") for c in [F.length("t") - F.length("left0"), *counts, F.length(f"left{size}")]])
    rows = rows.select(
        "doc_id",
        "mark",
        "lang",
        chars.alias("chars"),
        F.length("left0").cast("long").alias("word_chars"),
        F.when(F.col("inner") == "", F.array().cast("array<string>")).otherwise(F.split("inner", f"[{SPACE}]+")).alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
    )
    listed = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    hits = F.array_join(F.filter("words", lambda x: x.isin(listed)), "  ")
    rows = rows.select("*", F.size("words").cast("long").alias("n_words"), F.concat(F.lit(" "), hits, F.lit(" ")).alias("hits"))
    windows = F.transform("words", lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)))
    windows = F.when(F.col("n_words") >= 3, F.slice(windows, F.lit(1), F.col("n_words").cast("int") - 2)).otherwise(F.array().cast("array<bigint>"))
    common = [
        F.array(*[((F.length("hits") - F.length(F.replace("hits", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in ws]).alias(f"common_{k}")
        for k, ws in COMMON_WORDS.items()
    ]
    rows = rows.select(
        "doc_id",
        "mark",
        "lang",
        "n_words",
        "word_chars",
        "chars",
        F.element_at("chars", list(CLASSES).index("symbol") + 2).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
        *common,
    )
    # of each window that comes again: its places, and the two after each
    rows = rows.select("*", (F.size(F.array_distinct("windows")) < F.size("windows")).alias("again"))
    numbered = F.arrays_zip(F.col("windows").alias("w"), F.sequence(F.lit(0), F.size("windows") - 1).alias("i"))
    ordered = F.when(F.col("again"), F.sort_array(numbered))
    rows = rows.select("*", ordered.alias("ordered")).drop("windows")
    found = F.filter("ordered", lambda x, i: (x["w"] == F.get("ordered", i - 1)["w"]) | (x["w"] == F.get("ordered", i + 1)["w"]))
    rows = rows.select("*", F.transform(found, lambda x: x["i"]).alias("at")).drop("ordered")
    covered = F.array_union(F.array_union("at", F.transform("at", lambda i: i + 1)), F.transform("at", lambda i: i + 2))
    repeated = F.when(F.col("again"), F.size(covered).cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.select("*", repeated.alias("n_repeat_words")).drop("at", "again")


def references(counts: DataFrame) -> Row:
    """One row of fixed size: by language, the histograms summed over its documents of at least MIN_WORDS words."""
    sums = []
    for k, listed in COMMON_WORDS.items():
        own = (F.col("lang") == k) & (F.col("n_words") >= MIN_WORDS)
        of = lambda c, own=own: F.coalesce(F.sum(F.when(own, c)), F.lit(0))
        sums.append(F.array(*[of(F.get("chars", F.lit(i))) for i in range(len(CLASSES) + 2)]).alias(f"chars_{k}"))
        sums.append(F.array(of(F.col("n_words")), *[of(F.get(f"common_{k}", F.lit(i))) for i in range(len(listed))]).alias(f"words_{k}"))
    return counts.agg(*sums).first()


def _distance(counts: Column, total: Column, reference: list[float]) -> Column:
    """The Jensen-Shannon distance of a histogram to a reference of shares; null if the histogram is empty."""

    def part(count: Column, q: Column) -> Column:
        p = count / total
        m = (p + q) / 2
        return F.when(count > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    parts = F.zip_with(counts, F.array(*map(F.lit, reference)), part)
    summed = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), summed / 2)))


def distances(counts: DataFrame, reference: Row) -> dict[str, tuple[Column, Column]]:
    """By language with a reference: the distance of the characters and that of the words."""
    found = {}
    for k in COMMON_WORDS:
        chars, words = list(reference[f"chars_{k}"]), list(reference[f"words_{k}"])
        if not words[0]:
            continue
        add = lambda a, x: a + x
        total = F.aggregate("chars", F.lit(0).cast("long"), add)
        others = F.col("n_words") - F.aggregate(f"common_{k}", F.lit(0).cast("long"), add)
        shares = [w / words[0] for w in words[1:]]
        found[k] = (
            _distance(F.col("chars"), total, [c / sum(chars) for c in chars]),
            _distance(F.array_append(f"common_{k}", others), F.col("n_words"), [*shares, (words[0] - sum(words[1:])) / words[0]]),
        )
    return found


def judge(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """doc_id, mark (of the text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row."""
    counts = cut(features(docs))
    near = F.lit(False)
    known = distances(counts, references(counts))
    for chars, words in known.values():
        near = near | ((chars <= char_limit) & ((F.col("n_words") < MIN_LIST_WORDS) | (words <= word_limit)))
    foreign = F.coalesce(~F.col("lang").isin(list(known)), F.lit(False))
    passed = (F.col("n_words") < MIN_WORDS) | near | foreign if known else F.lit(True)
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return counts.select(
        "doc_id", "mark", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & passed).alias("kept")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with their own columns."""
    return without(docs, judge(docs).where(~F.col("kept")))
