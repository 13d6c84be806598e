"""Scalar rates, buckets and verdicts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfield import config as C


def bucket_of(minutes: Column) -> Column:
    """The usage cohort of a number of minutes."""
    out = F.lit(C.UNKNOWN)
    for name, low, high in C.BUCKETS:
        inside = minutes >= low if high is None else (minutes >= low) & (minutes < high)
        out = F.when(inside, name).otherwise(out)
    return out


def bucket_rank(bucket: Column) -> Column:
    """The cohort's place in the fixed order; unknown ones last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, C.BUCKET_NAMES)), bucket), F.lit(0)), F.lit(len(C.BUCKET_NAMES) + 1))


def percent(part: Column, whole: Column) -> Column:
    """To one decimal; null, never 0, without a denominator."""
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, 1))


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def verdict_word(mean: Column) -> Column:
    return F.when(mean >= C.BUY_AT, "Buy").when(mean < C.SKIP_BELOW, "Skip").when(mean.isNotNull(), "Wait")


def citation_verdict(positive: Column, negative: Column) -> Column:
    """By a share of two thirds either way."""
    n = positive + negative
    return F.when(n == 0, "unknown").when(3 * positive >= 2 * n, "positive").when(3 * negative >= 2 * n, "negative").otherwise("mixed")


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) of n draws at p; null without draws. The terms are summed from the largest of them, found by logarithms,
    both ways by their ratios, so that neither end underflows."""
    top = F.least(k, F.floor((n + 1) * p)).cast("int")
    upto = lambda first, last, step=1: F.when((last - first) * step >= 0, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    one = F.lit(1)
    ways = F.aggregate(upto(one, top), F.lit(0.0), lambda a, j: a + F.log((n - top + j) / j))
    largest = F.exp(ways + top * F.log(p) + (n - top) * F.log(1 - p))

    def rest(places: Column, ratio) -> Column:
        start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
        step = lambda a, i: F.struct((a["term"] * ratio(i)).alias("term"), (a["sum"] + a["term"] * ratio(i)).alias("sum"))
        return F.aggregate(places, start, step, lambda a: a["sum"])

    down = rest(upto(top, one, -1), lambda i: i / (n - i + 1) * ((1 - p) / p))
    up = rest(upto(top + 1, k.cast("int")), lambda i: (n - i + 1) / i * (p / (1 - p)))
    total = largest * (1 + down + up)
    return F.when(n == 0, None).when(p <= 0, 1.0).when(p >= 1, F.when(k >= n, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), total))


def significant(x: Column, digits: int = 3) -> Column:
    """To so many significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x * scale) / scale)


def pacific_day(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, C.PACIFIC), "yyyy-MM-dd")


def pacific_hour(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, C.PACIFIC), "yyyy-MM-dd HH")


def ledger_for(model: Column, asked: Column) -> Column:
    """The large model's own ledger, else the one asked for, else batch."""
    large = model.contains("flash") & ~model.contains("lite")
    return F.when(large, "flash").otherwise(F.coalesce(F.nullif(asked, F.lit("")), F.lit("batch")))


def error_class(message: Column) -> Column:
    """What to do about a failed request: abort, if the credential was refused; retry, and with a lower ceiling if the rate
    was too high, which it isn't where the allowance of a day is gone; or raise."""
    holds = lambda *marks: F.coalesce(reduce(or_, [F.contains(message, F.lit(m)) for m in marks]), F.lit(False))
    return (
        F.when(holds(*C.REFUSED), "abort")
        .when(holds(*C.TOO_MANY) & ~holds(C.DAY_QUOTA), "retry_with_lower_ceiling")
        .when(holds(*C.TOO_MANY, *C.TRANSIENT), "retry")
        .otherwise("raise")
    )
