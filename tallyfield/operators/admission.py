"""Who may still spend requests today, and which titles are next."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield import config as C
from tallyfield.functions.rates import pacific_hour


def _decision(left: Column, needed: int, refusal: str, second: Column | None = None) -> Column:
    """code and remaining: the budget that protects everyone is looked at first, so a refusal names it."""
    code = F.when(left < needed, refusal)
    code = (code if second is None else code.when(second, "ip_limited")).otherwise("ok")
    return F.struct((code == "ok").alias("allowed"), code.alias("code"), left.alias("remaining"))


def can_generate(live_used: Column, ip: Column, ip_used: Column) -> Column:
    """A live request: the reserve first, then the hourly limit of a known address."""
    known = F.coalesce(ip, F.lit("")) != ""
    limited = F.coalesce(known & (F.coalesce(ip_used, F.lit(0)) >= C.HOURLY_PER_IP), F.lit(False))
    return _decision(F.greatest(F.lit(0), C.LIVE_RESERVE - F.coalesce(live_used, F.lit(0))), C.RESERVED, "reserve_exhausted", limited)


def can_batch(batch_used: Column, live_used: Column) -> Column:
    """A title of the batch: what the day allows without the reserve, less all that was spent, live requests included."""
    spent = F.coalesce(batch_used, F.lit(0)) + F.coalesce(live_used, F.lit(0))
    return _decision(F.greatest(F.lit(0), C.DAILY_REQUESTS - C.LIVE_RESERVE - spent), C.RESERVED, "batch_budget_exhausted")


def can_flash(flash_used: Column) -> Column:
    """One request to the large model."""
    return _decision(F.greatest(F.lit(0), C.FLASH_DAILY - F.coalesce(flash_used, F.lit(0))), 1, "flash_daily_exhausted")


def current_hour(tallies: DataFrame, now: Column) -> DataFrame:
    """The tallies (key, hour, requests) of the hour of `now`; older ones are evicted."""
    return tallies.where(F.col("hour") == pacific_hour(now))


def pending_titles(titles: DataFrame, state: DataFrame, published: DataFrame, night: int | None = None, only: DataFrame | None = None, tier: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The first titles (appid, place, night) of a night, among `only`, outside the tier that has a day of its own, without
    a document and without a final outcome."""
    rows = titles if night is None else titles.where(F.col("night") == night)
    if only is not None:
        rows = rows.join(only.select("appid"), "appid", "left_semi")
    final = state.where(F.col("outcome").isin(C.FINAL)).select("appid")
    for gone in (tier, published, final):
        if gone is not None:
            rows = rows.join(gone.select("appid"), "appid", "left_anti")
    return rows if limit is None else rows.orderBy("place").limit(limit)


def run_stages(titles: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """appid, outcome: each stage takes the titles that are left and gives appid and code (null: passed); a title that
    fails in one stops there and holds up no other."""
    done, rows = None, titles.select("appid")
    for name, stage in stages:
        judged = rows.join(stage(rows).select("appid", F.col("code").alias("stage_code"), F.lit(True).alias("answered")), "appid", "left")
        failed = judged.where(F.col("answered").isNull() | F.col("stage_code").isNotNull())
        out = failed.select("appid", F.coalesce("stage_code", F.lit(f"{name}_failed")).alias("outcome"))
        done = out if done is None else done.unionByName(out)
        rows = judged.where(F.col("answered") & F.col("stage_code").isNull()).select("appid")
    ok = rows.withColumn("outcome", F.lit("ok"))
    return ok if done is None else done.unionByName(ok)


def per_title(call: Callable[[object], str | None]) -> Callable[[DataFrame], DataFrame]:
    """A stage out of a function of one appid, which gives its code or null; tasks call it, and what it raises for a title is
    that title's code and ends nothing else. An interruption isn't caught."""

    def stage(titles: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = []
                for appid in batch.column(0).to_pylist():
                    try:
                        codes.append(call(appid))
                    except Exception as e:  # noqa: BLE001  whatever a stage raises
                        codes.append(f"crashed:{type(e).__name__}")
                yield pa.record_batch([batch.column(0), pa.array(codes, pa.string())], names=["appid", "code"])

        return titles.select("appid").mapInArrow(run, f"appid {dict(titles.dtypes)['appid']}, code string")

    return stage


def answer(requests: DataFrame, memo: DataFrame, ask: Callable[[DataFrame], DataFrame], attempt: int) -> DataFrame:
    """key, response, remembered: the first attempt takes what is remembered and asks for the rest; later ones ask for all,
    as a remembered answer is what failed."""
    known = memo.select(F.col("key"), "response").join(requests.select("key"), "key", "left_semi") if attempt == 0 else memo.select("key", "response").limit(0)
    rest = requests.join(known.select("key"), "key", "left_anti")
    return known.withColumn("remembered", F.lit(True)).unionByName(ask(rest).select("key", "response").withColumn("remembered", F.lit(False)))


def retry(requests: DataFrame, memo: DataFrame, ask: Callable[[DataFrame, int], DataFrame], failures: Callable[[DataFrame], DataFrame], retries: int = 2) -> DataFrame:
    """key, response, attempt, code: a response without a failure code stays; others are asked for again, and after the
    last round the code is kept."""
    settled, rows = None, requests
    for attempt in range(retries + 1):
        got = failures(answer(rows, memo, lambda r, a=attempt: ask(r, a), attempt)).withColumn("attempt", F.lit(attempt)).select("key", "response", "attempt", "code")
        kept = got if attempt == retries else got.where("code IS NULL")
        settled = kept if settled is None else settled.unionByName(kept)
        rows = rows.join(got.where("code IS NOT NULL").select("key"), "key", "left_semi")
    return settled
