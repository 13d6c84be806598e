"""The library's own code for the executors, and the folder that they share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors by Spark's own file service, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_tallyfield_sent", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "tallyfield_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    archive.write(file, os.path.relpath(file, os.path.dirname(top)))
    context.addPyFile(path)
    context._tallyfield_sent = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. A cluster names it in spark.checkpoint.dir; only where that is unset and all
    runs on one machine, as in tests, a temporary folder is used."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, without its lineage, for plans that read it several times."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
