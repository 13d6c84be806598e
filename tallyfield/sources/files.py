"""Files that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One document per file; a file that can't be parsed gives a row of nulls. The path may hold a glob."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_path"))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """term: a line without what follows #, in lower case; blank ones go."""
    term = F.lower(F.trim(F.element_at(F.split("value", "#"), 1)))
    return spark.read.text(path).select(term.alias("term")).where("term <> ''")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """appid, note from lines of digits and a note after #."""
    return (
        spark.read.text(path)
        .select(F.regexp_extract("value", r"^\s*([0-9]+)\s*(?:#.*)?$", 1).alias("appid"), F.trim(F.regexp_extract("value", "#(.*)$", 1)).alias("note"))
        .where("appid <> ''")
    )


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """appid, day: the day that a line's note names, else the first."""
    day = F.nullif(F.regexp_extract("note", "day ([0-9]+)", 1), F.lit("")).cast("int")
    return read_id_list(spark, path).select(F.col("appid").cast("long").alias("appid"), F.coalesce(day, F.lit(1)).alias("day"))


def write_json_documents(df: DataFrame, path: str, pretty: bool = False) -> None:
    """One JSON object per line, or over several lines each."""
    options = {"pretty": "true"} if pretty else {}
    df.select(F.to_json(F.struct(*df.columns), options)).write.mode("overwrite").text(path)


def memo_key(tag: str, *parts) -> F.Column:
    """The key of a remembered response: 16 hexadecimal digits of a hash of its parts; a null part is no empty one."""
    told = [F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("\x00\x00")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\x00", F.lit(tag), *told), 256), 1, 16)


def replay(requests: DataFrame, memo: DataFrame) -> DataFrame:
    """The requests with the remembered response, or null."""
    known = memo.select(F.col("key").alias("memo_key"), "response")
    return requests.join(known, F.col("key") == F.col("memo_key"), "left").drop("memo_key")


def first_of(sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Of each key the row of the first source that has it, and the source's name."""
    rows = None
    for rank, (name, df) in enumerate(sources):
        part = df.withColumn("_rank", F.lit(rank)).withColumn("origin", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    columns = [c for c in rows.columns if c not in (key, "_rank")]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*columns), "_rank").alias("best"))
    return best.select(key, *[F.col(f"best.`{c}`").alias(c) for c in columns])
