"""Item and pair statistics kept up to date over an append-only stream of baskets (beyond the batch engine's queries).

Decay is multiplicative, so weights are kept relative to a fixed landmark time and rescaled when read; scores do not depend on
the landmark. Sums are appended per micro-batch and added up at reading, so a repeated batch overwrites its own folder and nothing
is counted twice.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Options
from ..functions import scoring
from ..operators import graph, history


def batch_sums(baskets: DataFrame, landmark: int, options: Options) -> DataFrame:
    """kind, a, b, n, weight, last_seen of one batch: items (b null) and pairs, weighed against the landmark."""
    grown = F.exp((F.col("unix_time") - F.lit(landmark)) * F.lit(math.log(2)) / F.lit(scoring.DAY * options.half_life_days))
    rows = history.in_size(baskets, options.max_items).withColumn("decay", grown)
    items = rows.select("date", "decay", F.explode("files").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum("decay").alias("weight"), F.max("date").alias("last_seen"))
    pairs = graph.basket_pairs(rows).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.sum(scoring.pair_weight(F.col("decay"), F.col("n_files"))).alias("weight"), F.max("date").alias("last_seen")
    )
    return items.select(F.lit("item").alias("kind"), "a", F.lit(None).cast("string").alias("b"), "n", "weight", "last_seen").unionByName(pairs.select(F.lit("pair").alias("kind"), "a", "b", "n", "weight", "last_seen"))


def maintain(stream: DataFrame, folder: str, landmark: int, options: Options, checkpoint: str):
    """Starts the query that keeps the sums of a stream of baskets under `folder`, one subfolder a micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch_sums(batch, landmark, options).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scored_pairs(spark: SparkSession, folder: str, landmark: int, origin: int, options: Options) -> DataFrame:
    """a, b, cochanges, weight (as of `origin`), last_seen, score over everything kept so far."""
    kept = spark.read.parquet(folder).groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.max("last_seen").alias("last_seen"))
    scale = math.exp(-math.log(2) * (origin - landmark) / (scoring.DAY * options.half_life_days))
    items = kept.where("kind = 'item'").select(F.col("a").alias("path"), (F.col("weight") * scale).alias("weighted_changes"))
    pairs = kept.where("kind = 'pair'").select("a", "b", F.col("n").alias("cochanges"), (F.col("weight") * scale).alias("weight"), "last_seen")
    return graph.scored_pairs(pairs, items)
