"""Lineage cuts of iterative plans, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a local one gets a temporary folder for the process; on a cluster that is an error, as
    executors would not see such a folder. What is written stays until the owner of the named folder removes it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or _own_folder()).rstrip("/")


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tandem-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back with the same schema: computed once, and safe from lost executors."""
    path = f"{shared_root(df.sparkSession)}/tandem/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    return written(df, "cut")
