"""The time-decayed co-occurrence graph: item statistics, pairs with first-N evidence, adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Options
from ..functions import scoring
from . import history


def weighted(baskets: DataFrame, options: Options, origin: Column | None = None) -> DataFrame:
    """In-size baskets with decay; the origin is the newest time of all baskets, also of those left out."""
    whole = history.since(baskets, options.since)
    newest = whole.agg(F.max("unix_time").alias("__latest"))
    rows = history.in_size(whole, options.max_items).join(F.broadcast(newest))  # one row
    return rows.withColumn("decay", scoring.decay(F.col("__latest") if origin is None else origin, F.col("unix_time"), options.half_life_days)).drop("__latest")


def item_stats(baskets: DataFrame, options: Options) -> DataFrame:
    """path, changes, weighted_changes, last_seen."""
    rows = weighted(baskets, options).select("date", "decay", F.explode("files").alias("path"))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("changes"), F.sum("decay").alias("weighted_changes"), F.max("date").alias("last_seen"))


def basket_pairs(rows: DataFrame) -> DataFrame:
    """a < b for all item pairs of each basket, made inside the row: no self-join, no shuffle."""
    made = (
        "flatten(transform(sequence(1, size(fs) - 1), i -> transform(slice(fs, i + 1, size(fs)), y -> struct(element_at(fs, i) as a, y as b))))"
    )
    return (
        rows.withColumn("fs", F.array_sort("files"))
        .where(F.size("fs") > 1)
        .withColumn("__pair", F.explode(F.expr(made)))
        .select(*rows.columns, F.size("fs").cast("long").alias("n_files"), "__pair.a", "__pair.b")
    )


def pair_stats(baskets: DataFrame, options: Options) -> DataFrame:
    """a, b, cochanges, weight, last_seen."""
    rows = basket_pairs(weighted(baskets, options))
    return rows.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("cochanges"), F.sum(scoring.pair_weight(F.col("decay"), F.col("n_files"))).alias("weight"), F.max("date").alias("last_seen")
    )


def pair_evidence(baskets: DataFrame, options: Options) -> DataFrame:
    """The first options.evidence baskets of each pair, newest first: a, b, nth, hash, date, subject, file_count, weight."""
    rows = basket_pairs(weighted(baskets, options))
    nth = F.row_number().over(Window.partitionBy("a", "b").orderBy("ord"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= options.evidence).select(
        "a", "b", "nth", "hash", "date", "subject", F.col("n_files").alias("file_count"), scoring.pair_weight(F.col("decay"), F.col("n_files")).alias("weight")
    )


def scored_pairs(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs with their normalised score over the two items' decayed mass."""
    mass = items.select("path", "weighted_changes")
    return (
        pairs.join(mass.select(F.col("path").alias("a"), F.col("weighted_changes").alias("mass_a")), "a")
        .join(mass.select(F.col("path").alias("b"), F.col("weighted_changes").alias("mass_b")), "b")
        .withColumn("score", scoring.normalised_score(F.col("weight"), F.col("mass_a"), F.col("mass_b")))
        .drop("mass_a", "mass_b")
    )


def adjacency(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair: u, v, weight."""
    both = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    return pairs.select(both.alias("e"), "weight").select("e.u", "e.v", "weight")


def degree(adj: DataFrame) -> DataFrame:
    return adj.groupBy("u").agg(F.sum("weight").alias("degree"))
