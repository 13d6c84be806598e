"""Mixing sources to target weights by Pareto order sampling.

Every source has a target, its share by weight of all words, at most MOST times its own words; what a full source leaves
is shared again by weight. Within a source a document's expected number of copies is the source's level times a factor
that falls slowly with the document's length class, at most MOST; the level is set so that the expected words equal the
target. The whole part of that number is allocated for certain. The fraction is the document's inclusion probability p
in a fixed-size sample: documents are ranked by their random odds u / (1 - u) divided by their inclusion odds p / (1 - p),
and taken in that order until the words still due are reached. What is still due then, less than a document, is evened
out by the documents next to the cut: of each length class, from the longest, up to NEXT documents behind the cut are
added and up to NEXT before it are left out, each only if that brings the source nearer to its target. Both are the ones
of their class whose rank is nearest to the cut.

Nothing is gathered by source but sums: the cut is found first among BINS classes of the rank, then inside the class that
holds it, and only NEXT documents of a source and length class on each side ever meet. The random number is a hash of seed
and doc_id, so reruns agree.

Defined results: null texts have size 0 and are never needed; a null source is a source of its own, the last; rows that
repeat a doc_id are sampled each, and tie in a defined order; an empty table gives no rows; other columns are ignored by
`mix` and kept by `repeat_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import cut, own_columns, unused, word_count

MOST = 3
BINS = 4096
NEXT = 2
SEED = 17


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, weight, target. Sources by code point, null last, weigh 1, 2, 3, repeating.

    One row per source, so the order over all of them is small. A source is full if the words of the fuller ones and its
    own bound, taken at its level, leave enough for the rest: levels rise with most * size / weight.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    weighed = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    level = F.col("source_size").cast("double") * most / F.col("weight")
    by_level = Window.orderBy(level, F.col("source").isNull(), F.encode("source", "utf-8"))
    fuller = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    shares = weighed.select(
        "*",
        F.sum("source_size").over(everyone).alias("total"),
        F.sum("weight").over(everyone).alias("weights"),
        F.coalesce(F.sum(F.col("source_size") * most).over(fuller), F.lit(0)).alias("filled"),
        F.coalesce(F.sum("weight").over(fuller), F.lit(0)).alias("passed"),
    )
    # a full source's level is at most the level that the rest would have
    full = F.col("source_size") * most * (F.col("weights") - F.col("passed")) <= (F.col("total") - F.col("filled")) * F.col("weight")
    marked = shares.withColumn("full", full)
    left = marked.select(
        "*",
        (F.col("total") - F.sum(F.when(F.col("full"), F.col("source_size") * most).otherwise(0)).over(everyone)).alias("due"),
        F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(everyone).alias("open"),
    )
    target = F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise(
        F.col("due").cast("double") * F.col("weight") / F.col("open")
    )
    return left.select("source", "source_size", "weight", target.alias("target"))


def _length_class(size: Column) -> Column:
    return F.length(F.bin(size)).cast("long") - 1


def _factor(length_class: Column) -> Column:
    """How often documents of a length class are taken, in units of 1 / 65536 of those of one word; whole numbers, so
    that sums don't depend on their order."""
    return F.floor(F.lit(1048576) / (length_class + 16)).cast("long")


def copies_by_class(sizes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """source, target, source_size, length_class, words, whole, p: the copies allocated for certain and the inclusion
    probability.

    A source has at most 64 length classes. Short documents have the larger factor, so classes fill from the shortest.
    """
    cells = sizes.groupBy("source", _length_class(F.col("size")).alias("length_class")).agg(F.sum("size").alias("words"))
    known = targets.select(F.col("source").alias("of"), "target", "source_size")
    cells = cells.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("factor", _factor(F.col("length_class")))
    one = Window.partitionBy("source")
    before = one.orderBy("length_class").rowsBetween(Window.unboundedPreceding, -1)
    after = one.orderBy("length_class").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cells = cells.select(
        "*",
        (F.coalesce(F.sum("words").over(before), F.lit(0)) * most).alias("filled"),
        F.sum(F.col("words") * F.col("factor")).over(after).alias("moved"),
    )
    # a full class's level is at most the level that the rest would have
    full = F.col("moved").cast("double") * most <= (F.col("target") - F.col("filled")) * F.col("factor")
    cells = cells.withColumn("full", (F.col("words") == 0) | full)
    cells = cells.select(
        "*",
        F.sum(F.when(F.col("full"), F.col("words") * most).otherwise(0)).over(one).alias("taken"),
        F.sum(F.when(~F.col("full"), F.col("words") * F.col("factor")).otherwise(0)).over(one).alias("open"),
    )
    level = F.greatest(F.lit(0.0), F.col("target") - F.col("taken")) * F.col("factor") / F.col("open")
    expected = F.when(F.col("words") == 0, 0.0).when(F.col("full"), float(most)).otherwise(F.least(F.lit(float(most)), level))
    cells = cells.withColumn("expected", expected)
    whole = F.floor("expected").cast("long")
    return cells.select("source", "target", "source_size", "length_class", "words", whole.alias("whole"), (F.col("expected") - F.floor("expected")).alias("p"))


def _random(doc_id: Column, seed: int) -> Column:
    """In the open interval from 0 to 1, from 52 bits of a hash."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(2**52)


def _evened(beside: DataFrame) -> DataFrame:
    """(changed, change): the documents beside the cut that are added or left out. `beside` has rid, source, size, change
    (1 or -1), turn (the nearest to the cut first) and gap (the words still due); a source has at most 64 length classes
    with 2 * NEXT rows each."""
    steps = F.sort_array(F.collect_list(F.struct((-_length_class(F.col("size"))).alias("longest"), (-F.col("change")).alias("adds"), "turn", "size", "rid", "change")))
    listed = beside.groupBy("source").agg(steps.alias("steps"), F.max("gap").alias("gap"))
    none = F.array().cast("array<struct<changed:bigint,change:int>>")
    state = F.aggregate(
        "steps",
        F.struct(F.col("gap").alias("left"), none.alias("picked")),
        lambda a, x: F.when(
            F.abs(a["left"] - x["change"] * x["size"]) < F.abs(a["left"]),
            F.struct((a["left"] - x["change"] * x["size"]).alias("left"), F.array_append(a["picked"], F.struct(x["rid"].alias("changed"), x["change"].alias("change"))).alias("picked")),
        ).otherwise(a),
    )
    return listed.select(F.inline(state["picked"]))


def mix(docs: DataFrame, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies of every row."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    sizes = cut(sizes.withColumn("rid", F.monotonically_increasing_id()))
    cells = cut(copies_by_class(sizes, source_targets(sizes, most), most))
    due = cells.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * F.col("words"))).alias("due"))
    due = due.select(F.col("source").alias("due_source"), "due")

    known = cells.select(F.col("source").alias("of"), F.col("length_class").alias("of_class"), "target", "source_size", "whole", "p")
    same = F.col("source").eqNullSafe(F.col("of")) & (_length_class(F.col("size")) == F.col("of_class"))
    u, p = _random(F.col("doc_id"), seed), F.col("p")
    odds = F.when((p > 0) & (F.col("size") > 0), (u / (1 - u)) / (p / (1 - p)))
    ranked = sizes.join(known, same).select("rid", "doc_id", "source", "size", "source_size", "target", "whole", odds.alias("odds"))
    # the rank's class; without a rank none
    ranked = cut(ranked.withColumn("bin", F.floor(F.col("odds") / (F.col("odds") + 1) * BINS)))

    # the last class that fits, and the one with the cut; at most BINS classes a source
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = ranked.where("bin IS NOT NULL").groupBy("source", "bin").agg(F.sum("size").alias("words"))
    bins = bins.select("*", F.sum("words").over(up_to).alias("reached"))
    fits = F.col("reached") <= F.col("due")
    ends = due.join(bins, F.col("due_source").eqNullSafe(F.col("source")), "left").groupBy("due_source", "due").agg(
        F.coalesce(F.max(F.when(fits, F.col("bin"))), F.lit(-1)).alias("last"),
        F.coalesce(F.max(F.when(fits, F.col("reached"))), F.lit(0)).alias("reached"),
        F.min(F.when(~fits, F.col("bin"))).alias("next"),
    )
    ends = cut(ends.select("due_source", (F.col("due") - F.col("reached")).alias("gap"), "last", "next"))
    placed = ranked.where("bin IS NOT NULL").join(ends, F.col("source").eqNullSafe(F.col("due_source"))).drop("due_source")
    inside = Window.partitionBy("source").orderBy("odds", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
    at_cut = cut(placed.where("bin = next").withColumn("sum", F.sum("size").over(inside)))
    taken = at_cut.where(F.col("sum") <= F.col("gap")).groupBy(F.col("source").alias("of")).agg(F.sum("size").alias("more"))
    columns = ["rid", "doc_id", "source", "size", "odds", "gap"]
    before = placed.where("bin <= last").select(*columns).unionByName(at_cut.where(F.col("sum") <= F.col("gap")).select(*columns))
    behind = at_cut.where(F.col("sum") > F.col("gap")).select(*columns).unionByName(placed.where("bin > next").select(*columns))
    alike = Window.partitionBy("source", _length_class(F.col("size")))
    last = before.withColumn("turn", F.row_number().over(alike.orderBy(F.desc("odds"), F.desc("doc_id"), F.desc("size"), F.desc("rid"))))
    first = behind.withColumn("turn", F.row_number().over(alike.orderBy("odds", "doc_id", "size", "rid")))
    beside = last.where(F.col("turn") <= NEXT).withColumn("change", F.lit(-1)).unionByName(first.where(F.col("turn") <= NEXT).withColumn("change", F.lit(1)))
    beside = beside.join(taken, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("gap", F.col("gap") - F.coalesce("more", F.lit(0)))
    changes = cut(_evened(beside))

    cut_in = at_cut.where(F.col("sum") <= F.col("gap")).select(F.col("rid").alias("changed"), F.lit(1).alias("change"))
    changes = changes.unionByName(cut_in).groupBy("changed").agg(F.sum("change").alias("change"))
    ends = ends.select(F.col("due_source").alias("end_source"), "last")
    rows = ranked.join(ends, F.col("source").eqNullSafe(F.col("end_source"))).join(changes, F.col("rid") == F.col("changed"), "left")
    extra = F.coalesce(F.col("bin") <= F.col("last"), F.lit(False)).cast("long") + F.coalesce("change", F.lit(0))
    rows = rows.withColumn("copies", F.col("whole") + extra)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def repeat_documents(docs: DataFrame, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The rows of `docs`, with their own columns, as often as `mix` takes them. Rows that share a doc_id share the
    largest number of copies of any of them."""
    copies = cut(mix(docs, most, seed).where("copies > 0").groupBy(F.col("doc_id").alias("mixed_id")).agg(F.max("copies").alias("copies")))
    copy = unused(docs, "copy")
    times = F.sequence(F.lit(1), F.col("m.copies").cast("int"))
    rows = docs.alias("d").join(copies.alias("m"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("m.mixed_id")))
    return rows.select(*own_columns(docs, "d"), F.explode(times).alias(copy)).drop(copy)
