"""Ordered basket histories: order, bounds, splits. A basket is (ord, hash, unix_time, date, subject, files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Options
from ..functions.scoring import DAY


def with_order(baskets: DataFrame, time: str, *tiebreak: str) -> DataFrame:
    """Adds ord: 0 for the newest row, then by time and the tiebreak columns, all descending.

    Ranks are taken within a day and moved on by the number of later rows, which comes from a table of one row a day, so no
    task sorts more than a day.
    """
    day = F.floor(F.col(time) / DAY).cast("long")
    rows = baskets.withColumn("__day", day)
    counts = rows.groupBy("__day").agg(F.count(F.lit(1)).alias("__n"))
    later = counts.select("__day", F.coalesce(F.sum("__n").over(Window.orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__later"))
    within = F.row_number().over(Window.partitionBy("__day").orderBy(F.desc(time), *[F.desc(c) for c in tiebreak]))
    return rows.withColumn("__within", within).join(later, "__day").withColumn("ord", (F.col("__later") + F.col("__within") - 1).cast("long")).drop("__day", "__within", "__later")


def in_size(baskets: DataFrame, max_items: int) -> DataFrame:
    """Neither empty nor broad baskets; stands before every expansion."""
    return baskets.where(F.size("files").between(1, max_items))


def since(baskets: DataFrame, time: int | None) -> DataFrame:
    return baskets if time is None else baskets.where(F.col("unix_time") >= time)


def exploded(baskets: DataFrame) -> DataFrame:
    """ord, path and the basket's columns, one row an item."""
    return baskets.withColumn("n_files", F.size("files").cast("long")).withColumn("path", F.explode("files")).drop("files")


def first_for_seed(rows: DataFrame, limit: int) -> DataFrame:
    """The newest `limit` baskets of each seed of (seed, ord, ...); 0 keeps all."""
    if not limit:
        return rows
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy("seed").orderBy("ord"))).where(F.col("__nth") <= limit).drop("__nth")


def touching(baskets: DataFrame, seeds: DataFrame | None, options: Options) -> DataFrame:
    """Rows (seed, ord, ...) of in-size baskets for each seed they hold, newest first within the options' bounds.

    seeds: one column seed, or None for every item. Baskets are scanned once, whatever the number of seeds. Baskets that
    have a column seed already are histories of their seeds.
    """
    rows = since(in_size(baskets, options.max_items), options.since)
    rows = rows if "seed" in rows.columns else rows.withColumn("seed", F.explode("files"))
    if seeds is not None:
        rows = rows.join(seeds.select("seed").distinct(), "seed", "left_semi")
    return first_for_seed(rows, options.max_baskets)


def split(baskets: DataFrame, test: int, train: int) -> tuple[DataFrame, DataFrame]:
    """The newest `test` baskets, and the `train` after them. Raises if nothing is left to train on."""
    if baskets.where(F.col("ord") >= test).isEmpty():
        raise ValueError(f"not enough baskets for evaluation: at most {test}")
    return baskets.where(F.col("ord") < test), baskets.where(F.col("ord").between(test, test + train - 1))


def bounded_scan(baskets: DataFrame, target: str, cap: int = 17500, least: int = 1000, hits: int = 256, stall: int = 5000) -> DataFrame:
    """The baskets that a latency-bounded walk from the newest visits.

    It stops at `cap`; or, once `least` are visited, with `hits` baskets that hold the target, or one and `stall` visited
    since the last. The walk's window spans at most `cap` rows, whatever the history.
    """
    near = baskets.where(F.col("ord") < cap)
    walk = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.array_contains("files", target)
    seen = near.withColumn("__hits", F.count_if(hit).over(walk)).withColumn("__last", F.max(F.when(hit, F.col("ord"))).over(walk))
    stop = (F.col("ord") + 1 >= least) & ((F.col("__hits") >= hits) | ((F.col("__hits") >= 1) & (F.col("ord") - F.col("__last") >= stall)))
    stops = seen.withColumn("__stopped", F.coalesce(F.sum(stop.cast("int")).over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return stops.where("__stopped = 0").drop("__hits", "__last", "__stopped")


def coverage(backend: str, limited: bool = False, mapped_renames: bool = False) -> dict:
    """How complete a backend's history is; fixed vocabulary."""
    suffix = "+diff-renames" if mapped_renames else ""
    known = {
        "git": ("target-window-exact", False, "git-follow" + suffix),
        "git-remove-empty": ("target-window-exact", False, "git-follow" + suffix),
        "pack-scan": ("scan-bounded", True, "exact-blob-renames" + suffix) if limited else ("target-window-exact", False, "exact-blob-renames" + suffix),
        "pack-fast": ("latency-bounded", True, "exact-blob-renames" + suffix),
    }
    completeness, approximate, renames = known.get(backend, ("backend-dependent", True, "diff-renames-only" if mapped_renames else "current-path-only"))
    return {"backend": backend, "completeness": completeness, "approximate": approximate, "rename_tracking": renames}
