"""Helpers that the training-data operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyfield.package import shared_folder, ship

__all__ = ["SPACE", "WORD", "counted", "cut", "own_columns", "partitions", "shared_folder", "ship", "spread_keys", "table", "text_mark", "unused", "without", "word_count", "words"]

#: White space that separates words: space and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"
#: A word, for Java's and Python's regular expressions.
WORD = f"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of the folder `sf_dir`, by Spark's own reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`cut(df)` and the number of its rows, found by the job that writes them."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def unused(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of `df` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame, alias: str) -> list[Column]:
    """The columns of `df` under an alias, whatever their names; two of one name are refused by Spark itself."""
    return [F.col(f"{alias}.`{c.replace('`', '``')}`") for c in df.columns]


def text_mark(text: Column) -> Column:
    """Tells apart the texts of rows that share a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs`, with their own columns whatever their names, whose doc_id and text aren't in `gone` (doc_id,
    mark), so that a row goes by its own verdict even where its doc_id is null or repeated."""
    out = cut(gone.select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct())
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.gone_id")) & (text_mark(F.col("d.text")) == F.col("g.gone_mark"))
    return docs.alias("d").join(out.alias("g"), same, "left_anti").select(*own_columns(docs, "d"))


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_keys(n: int, partitions: int) -> list[int]:
    """`n` ints that hash partitioning deals evenly to so many partitions: Spark takes the Murmur3 hash with seed 42
    modulo their number."""
    k = np.arange(64 * max(n, partitions), dtype=np.uint32)
    with np.errstate(over="ignore"):
        turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
        h = np.uint32(42) ^ (turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
        h = (turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h = h ^ (h >> np.uint32(16))
    part = h.view(np.int32) % partitions
    order = np.argsort(part, kind="stable")
    first = np.searchsorted(part[order], part[order])
    turns = np.arange(len(order)) - first  # a partition's first key, its second, and so on
    return order[np.lexsort((part[order], turns))][:n].tolist()


def words(text: Column) -> Column:
    """The words of a text (null: none) as an array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words of a text (null: 0) as a long, without a row for each word."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    ends = (F.element_at(parts, 1) == "").cast("long") + (F.element_at(parts, -1) == "").cast("long")
    return F.greatest(F.size(parts).cast("long") - ends, F.lit(0).cast("long"))
