"""One pair explained, and names resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Options
from . import graph, history, scorers


def resolve(known: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, status, path, matches: exact names win; else the only name with that suffix or basename; else ambiguous or missing.

    known: column path; asked: column asked. Equality on every suffix of a name, not a pattern over all pairs.
    """
    names = known.select("path").distinct()
    parts = F.split("path", "/")
    suffixes = names.withColumn("asked", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))))
    met = asked.select("asked").distinct().join(suffixes, "asked", "left")
    found = met.groupBy("asked").agg(F.sort_array(F.collect_set("path")).alias("matches"), F.coalesce(F.bool_or(F.col("path") == F.col("asked")), F.lit(False)).alias("exact"))
    n = F.size("matches")
    status = F.when(F.col("exact") | (n == 1), "known").when(n == 0, "missing").otherwise("ambiguous")
    return found.select(
        "asked", status.alias("status"), F.when(F.col("exact"), F.col("asked")).when(n == 1, F.get("matches", 0)).alias("path"),
        F.when(F.col("exact"), F.lit("")).otherwise(F.array_join("matches", ",")).alias("matches"),
    )


def explain(baskets: DataFrame, a: str, b: str, options: Options) -> DataFrame:
    """One row a, b, related, cochanges, weight, last_seen over the baskets of a; zeros where they never met."""
    own = history.touching(baskets, baskets.sparkSession.createDataFrame([(a,)], "seed string"), options)
    pair = graph.pair_stats(own.drop("seed"), options.but(since=None)).where((F.col("a") == min(a, b)) & (F.col("b") == max(a, b)))
    asked = baskets.sparkSession.createDataFrame([(a, b)], "a string, b string")
    total = pair.agg(F.max("cochanges").alias("n"), F.max("weight").alias("w"), F.max("last_seen").alias("seen"))
    return asked.join(F.broadcast(total)).select(  # one row each
        "a", "b", F.col("n").isNotNull().alias("related"), F.coalesce("n", F.lit(0)).cast("long").alias("cochanges"),
        F.coalesce("w", F.lit(0.0)).alias("weight"), F.coalesce("seen", F.lit("")).alias("last_seen"),
    )


def evidence(baskets: DataFrame, a: str, b: str, options: Options) -> DataFrame:
    """hash, date, subject, file_count, weight and nth of the newest options.evidence baskets that hold both."""
    seeds = baskets.sparkSession.createDataFrame([(a,)], "seed string")
    return scorers.on_demand_evidence(baskets, seeds, options).where(F.col("path") == b).drop("seed", "path")


def known_names(baskets: DataFrame) -> DataFrame:
    return baskets.select(F.explode("files").alias("path")).distinct()


def same_name(path: str) -> str:
    """A typed name as it is looked up."""
    return "/".join(p for p in path.split("/") if p not in ("", "."))


