"""Ranks, running sums and quantiles over a whole table without a task that holds it.

Rows are dealt by ranges of the order and written to the shared folder with the number of their range, since the ranges are
drawn from a sample and would differ when they are drawn again. Each range is numbered or summed by itself, and begins after
the sum of those before: one row for each range, which the driver adds up. Order statistics are found by passes of counts
over ever narrower brackets, until a bracket has few rows or one value.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.package import cut

#: Bins of a pass, and rows that the driver looks at in the end.
BINS, FEW = 1000, 1000


def by_range(df: DataFrame, *order: str | Column) -> DataFrame:
    """`df` with range, ascending with the order: of two rows of different ranges the one of the lower comes first."""
    size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(size, *order).withColumn("range", F.spark_partition_id()))


def running(dealt: DataFrame, sums: dict[str, Column], *order: str | Column) -> DataFrame:
    """`dealt` (from by_range, in a total order) with the sum of each column over all rows that come before."""
    totals = dealt.groupBy("range").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name) for name, c in sums.items()]).collect()
    totals.sort(key=lambda r: r["range"])
    begins = [[r["range"] for r in totals], *[[0, *accumulate(r[name] for r in totals)][:-1] for name in sums]]
    schema = ", ".join(["begin_range int", *[f"begin_{k} bigint" for k in range(len(sums))]])
    offsets = F.broadcast(dealt.sparkSession.createDataFrame(list(zip(*begins)), schema))  # a row for each range
    before = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = [(F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long") + F.col(f"begin_{k}")).alias(name) for k, (name, c) in enumerate(sums.items())]
    return dealt.join(offsets, F.col("range") == F.col("begin_range")).select(*[c for c in dealt.columns if c not in sums], *own)


def ranked(dealt: DataFrame, *order: str | Column) -> DataFrame:
    """`dealt` with rank, from 1."""
    return running(dealt, {"rank": F.lit(1)}, *order).withColumn("rank", (F.col("rank") + 1).cast("int"))


def order_statistics(df: DataFrame, value: str, wanted: list[int], bins: int = BINS, few: int = FEW) -> dict[int, float]:
    """The values (doubles) of the given ranks, from 1, among the finite ones of a column; nulls don't count."""
    rows = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    whole = rows.agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if any(not 1 <= k <= whole.n for k in wanted):
        raise ValueError(f"ranks go from 1 to {whole.n}")
    found: dict[int, float] = {}
    open_ = {(whole.low, whole.high, 0, whole.n): list(wanted)} if wanted else {}
    while open_:
        (low, high, before, n), asked = open_.popitem()
        if low == high:
            found |= dict.fromkeys(asked, low)
            continue
        inside = rows.where(F.col("v").between(low, high))
        if n <= few:
            values = sorted(r.v for r in inside.collect())
            found |= {k: values[k - before - 1] for k in asked}
            continue
        half, step = low / 2, (high / 2 - low / 2) / bins  # halves, since the span of two doubles may be none
        bin_ = F.least(F.floor((F.col("v") / 2 - half) / F.lit(step)), F.lit(bins - 1)) if step > 0 else F.when(F.col("v") > low, 1).otherwise(0)
        for r in sorted(inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), key=lambda r: r["bin"]):
            mine = [k for k in asked if before < k <= before + r.n]
            if mine:
                open_[r.low, r.high, before, r.n] = mine
            before += r.n
    return found


def exclusive_quantiles(df: DataFrame, value: str, shares: list[float]) -> dict[float, float]:
    """Quantiles at (n + 1) * share between the ordered values, carried on beyond the first two or last two; the one value
    that there is, if there is one, and none of no values."""
    n = df.where(F.col(value).isNotNull()).count()
    if n < 2:
        only = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double")).first()
        return dict.fromkeys(shares, only[0]) if only else {}
    at = {s: (min(max(math.floor((n + 1) * s + 1e-9), 1), n - 1), (n + 1) * s) for s in shares}
    known = order_statistics(df, value, sorted({k + j for k, _ in at.values() for j in (0, 1)}))
    return {s: known[k] + (place - k) * (known[k + 1] - known[k]) for s, (k, place) in at.items()}
