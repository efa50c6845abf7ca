"""Basket histories made of order tables: an order is a basket, its distinct suppliers or parts are the items."""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import with_order
from .checkpoints import shared_root, written

HISTORY = "ord long, key long, hash string, unix_time long, date string, subject string, files array<string>"
EXTENSIONS = (".ts", ".py", ".md", ".lock", ".json", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_path() -> Column:
    """A path for a part: type/brand/name-key.extension."""
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), F.col("p_size") % len(EXTENSIONS))
    return F.concat(F.lower("p_type"), F.lit("/"), brand, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey"), ext)


def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", part_path().alias("path"))


def _history(orders: DataFrame, items: DataFrame) -> DataFrame:
    """items: o_orderkey, path. Orders without items are empty baskets."""
    files = items.groupBy("o_orderkey").agg(F.sort_array(F.collect_set("path")).alias("files"))
    time = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    narrow = orders.select("o_orderkey", "o_orderdate", "o_orderpriority", time.alias("unix_time"))
    return with_order(narrow, "unix_time", "o_orderkey").join(files, "o_orderkey", "left").select(  # files are not dealt out by day
        "ord",
        F.col("o_orderkey").alias("key"),
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("hash"),
        "unix_time",
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("date"),
        F.col("o_orderpriority").alias("subject"),
        F.coalesce("files", F.array().cast("array<string>")).alias("files"),
    )


_WRITTEN: dict[tuple[str, str, str, str], str] = {}


def _once(build):
    """A history that is built once for a session and folder, written to the shared folder and read by every later query."""

    @functools.wraps(build)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, shared_root(spark), sf_dir, build.__name__)
        if key in _WRITTEN:
            try:
                return spark.read.schema(HISTORY).parquet(_WRITTEN[key])
            except AnalysisException:  # the folder's owner has removed it
                del _WRITTEN[key]
        table = written(build(spark, sf_dir), build.__name__)
        _WRITTEN[key] = table.inputFiles()[0].rpartition("/")[0]
        return table

    return read


@_once
def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as baskets of suppliers: few items that meet often."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("supp/"), F.col("l_suppkey")).alias("path"))
    return _history(table(spark, sf_dir, "orders"), items)


@_once
def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as baskets of parts: many items that meet rarely.

    Joined by shuffle at every size: Spark guesses the names' size from the compressed columns they are made of, far too low,
    and would gather all of them on the driver to broadcast them.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    items = lines.join(part_paths(spark, sf_dir).hint("merge"), "p_partkey").select("o_orderkey", "path")
    return _history(table(spark, sf_dir, "orders"), items)
