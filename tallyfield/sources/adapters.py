"""The engine's entities over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.rates import bucket_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact_reviews(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """rid, game, minutes, hours, bucket, voted_up, created, source_filter, order (for ties) from lineitem, or from
    `lines` of it; a rid can come several times, as from several sweeps."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    minutes = ((F.col("l_quantity") - 1) * 150).cast("int")
    return (table(spark, sf_dir, "lineitem") if lines is None else lines).select(
        (key * 10 + line).alias("rid"),
        F.col("l_suppkey").alias("game"),
        minutes.alias("minutes"),
        F.round(minutes / 60, 1).alias("hours"),
        bucket_of(minutes).alias("bucket"),
        ((key * 31 + line * 17) % 100 < 50 + F.col("l_suppkey") % 50).alias("voted_up"),
        F.col("l_shipdate").alias("created"),
        F.col("l_returnflag").alias("source_filter"),
        F.struct("l_shipdate", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus").alias("order"),
    )


def text_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, game, minutes, bucket, voted_up (null without a label), text, votes_up, votes_funny, lang from documents."""
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("marked"), "quality")
    docs = table(spark, sf_dir, "documents")
    return docs.join(marks, F.col("doc_id") == F.col("marked"), "left").select(
        F.col("doc_id").alias("rid"),
        F.col("source").alias("game"),
        F.col("n_chars").alias("minutes"),
        bucket_of(F.col("n_chars")).alias("bucket"),
        (F.col("quality") == 1).alias("voted_up"),
        "text",
        (F.col("doc_id") % 7).alias("votes_up"),
        (F.col("doc_id") % 11).alias("votes_funny"),
        "lang",
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, key, ledger, cost from events."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").alias("key"), F.col("event_type").alias("ledger"), F.col("value").alias("cost")
    )


def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """appid, title, reviews, kind from part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("appid"), F.col("p_name").alias("title"), F.col("p_retailprice").cast("int").alias("reviews"), F.col("p_type").alias("kind"), F.col("p_size").alias("size")
    )
