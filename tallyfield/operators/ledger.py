"""Request budgets over an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield import config as C
from tallyfield.functions.rates import count_where, pacific_day, pacific_hour


def daily(log: DataFrame) -> DataFrame:
    """day (Pacific), ledger, requests, cost."""
    return log.groupBy(pacific_day(F.col("ts")).alias("day"), "ledger").agg(F.count("*").alias("requests"), F.round(F.sum("cost"), 2).alias("cost"))


def hourly(log: DataFrame, limit: int = C.HOURLY_PER_IP) -> DataFrame:
    """key, hour (Pacific), requests, over_limit."""
    sums = log.groupBy("key", pacific_hour(F.col("ts")).alias("hour")).agg(F.count("*").alias("requests"))
    return sums.withColumn("over_limit", F.col("requests") > limit)


def budget_stop(titles: DataFrame, budget: int, reserved: int = C.RESERVED) -> DataFrame:
    """titles (day, place, calls) with spent_before and admitted: a day's titles run in order until less than the reserve
    is left. A day has its own window."""
    before = Window.partitionBy("day").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = titles.withColumn("spent_before", F.coalesce(F.sum("calls").over(before), F.lit(0)))
    return rows.withColumn("admitted", F.lit(budget) - F.col("spent_before") >= reserved)


def trailing(log: DataFrame, seconds: int = 60, ceiling: int = C.REQUESTS_PER_MINUTE) -> DataFrame:
    """id, ledger, in_window, over: requests of a ledger in the `seconds` up to each, the lower end excluded. Windows are
    by ledger and slices of four times that length, with the rows of the slice before that still count."""
    micros, span = F.unix_micros(F.col("ts").cast("timestamp")), seconds * 1_000_000
    own, last = F.floor(micros / (4 * span)), F.floor((micros + span - 1) / (4 * span))
    rows = log.select("id", "ledger", micros.alias("us"), F.explode(F.array_distinct(F.array(own, last))).alias("slice"), own.alias("own"))
    frame = Window.partitionBy("ledger", "slice").orderBy("us").rangeBetween(-(span - 1), 0)
    counted = rows.withColumn("in_window", F.count("*").over(frame)).where("slice = own")
    return counted.select("id", "ledger", "in_window", (F.col("in_window") > ceiling).alias("over"))


def effective_used(reservations: DataFrame) -> DataFrame:
    """day, effective: requests used after each reservation is settled at its actual cost (null: not settled; it may be
    over the reserve); never below 0. `reservations` has day, used, actual."""
    back = F.when(F.col("actual").isNotNull(), C.RESERVED - F.col("actual")).otherwise(0)
    return reservations.groupBy("day").agg(F.greatest(F.lit(0), F.sum("used") - F.sum(back)).cast("long").alias("effective"))


def conserved(daily_rows: DataFrame, log: DataFrame) -> DataFrame:
    """day, conserved: whether the ledgers of a day add up to its requests."""
    parts = daily_rows.groupBy("day").agg(F.sum("requests").alias("sum"))
    whole = log.groupBy(pacific_day(F.col("ts")).alias("of")).agg(F.count("*").alias("n"))
    return parts.join(whole, F.col("day") == F.col("of"), "full").select(F.coalesce("day", "of").alias("day"), F.col("sum").eqNullSafe(F.col("n")).alias("conserved"))


def unsettled(runs: DataFrame, reserved: DataFrame, known: DataFrame, limit: int = 5) -> DataFrame:
    """The oldest runs (appid, run, created, status) that have ended, hold a reservation and aren't settled yet."""
    rows = runs.where(F.col("status").isin(C.ENDED)).join(reserved.select("appid"), "appid", "left_semi").join(known.select("appid", "run"), ["appid", "run"], "left_anti")
    return rows.orderBy("created", "run").limit(limit)


def batch_summary(titles: DataFrame) -> DataFrame:
    """day, attempted, published, calls, mean_seconds of titles (day, outcome, calls, seconds)."""
    return titles.groupBy("day").agg(
        F.count("*").alias("attempted"), count_where(F.col("outcome") == "ok").alias("published"), F.sum("calls").alias("calls"), F.round(F.avg("seconds"), 3).alias("mean_seconds")
    )


def pending(titles: DataFrame, state: DataFrame, published: DataFrame, limit: int) -> DataFrame:
    """The first titles (appid, place) without a document and without a final outcome."""
    final = state.where(F.col("outcome").isin("ok", "thin_segmentation", "qr4_failed"))
    rest = titles.join(published.select("appid"), "appid", "left_anti").join(final.select("appid"), "appid", "left_anti")
    return rest.orderBy("place").limit(limit)
