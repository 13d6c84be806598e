"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`. `run`
writes what each stage returns to the shared checkpoint folder and reads it again for the next, so a lost executor never
sends the work back beyond the stage at hand. What a stage read is removed once its successor is written; the input of the
last one stays, as its rows are read from it.

Defined results: null and empty texts fail the quality rules and go; a row goes by its own verdict where its doc_id is null
or repeated; of rows that repeat a doc_id and a text one stays; of ties the operators' docstrings tell which stays; an
empty table gives no rows; other columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyfield.llm import bpe, exact_dedup, mixing, near_dedup, quality
from tallyfield.llm.common import shared_folder, ship, table
from tallyfield.llm.queries import VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.repeat_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.digest(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mix", mix_sources),
    ("tokens", tokens),
]
#: Byte-level BPE can't be expressed in SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """By Hadoop's file system, as the shared folder may be in any store."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            _remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
