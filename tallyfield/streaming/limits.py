"""Streaming forms of the request log: windows, first-seen rows, and the rate limiter."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyfield import config as C
from tallyfield.package import shared_folder, ship


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log as a stream; its times become timestamps, which a watermark needs."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    return rows.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"), F.col("event_type").alias("ledger"), F.col("value").alias("cost"))


def windows(log: DataFrame) -> DataFrame:
    """start, ledger, requests by the hour; rows later than a day are too late."""
    late = log.withWatermark("ts", "1 day") if log.isStreaming else log
    return late.groupBy(F.window("ts", "1 hour").alias("w"), "ledger").agg(F.count("*").alias("requests")).select(F.col("w.start").alias("start"), "ledger", "requests")


def first_seen(log: DataFrame) -> DataFrame:
    """The first row of each id."""
    if log.isStreaming:
        return log.withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["id"])
    return log.dropDuplicates(["id"])


def reserve(stamps: list[float], at: float, ceiling: int, window: float = 60.0) -> tuple[list[float], float]:
    """The stamps kept and the wait of a request at `at`: it takes the first moment at which fewer than `ceiling` stamps
    lie in the window before, and that moment is stamped before the wait begins."""
    recent = sorted(s for s in stamps if at - s < window)
    start = at
    if len(recent) >= ceiling:
        start = max(at, recent[-ceiling] + window)
    return sorted([*recent, start])[-3 * ceiling :], start - at


def limiter(log: DataFrame, ceiling: int = C.REQUESTS_PER_MINUTE) -> DataFrame:
    """id, ledger, wait_seconds: the sliding rate limiter of each ledger over a stream, one micro-batch in the order of
    time. A delayed request takes a place in the future, so each wait depends on those before it."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stamps = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        waits = []
        for at in rows["at"]:
            stamps, wait = reserve(stamps, at, ceiling)
            waits.append(round(wait, 6))
        state.update((json.dumps(stamps),))
        yield pd.DataFrame({"id": rows["id"], "ledger": key[0], "wait_seconds": waits})

    ship(log.sparkSession)
    rows = log.select("id", "ledger", (F.unix_micros("ts") / 1e6).alias("at"))
    return rows.groupBy("ledger").applyInPandasWithState(run, "id bigint, ledger string, wait_seconds double", "stamps string", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """The rows of a stream over what is there now; one that ran with this folder before goes on where it stopped. Each micro-batch writes files of its own to the shared folder, which
    holds the query's checkpoint, too; a batch that runs again writes the same ones anew. In complete mode the last batch
    has all rows."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/log").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")
