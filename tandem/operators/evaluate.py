"""Chronological evaluation: item-to-item queries and leave-one-out audits, set-based over all tasks.

Rankings depend on the training baskets and the seed alone, so each distinct seed is ranked once and joined to its tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BANDS, Options, seed_budget
from ..functions import scoring
from . import changedset, graph, history, scorers


def known_items(train: DataFrame, options: Options) -> DataFrame:
    """The items of in-size training baskets."""
    return history.in_size(train, options.max_items).select(F.explode("files").alias("path")).distinct()


def eligible_tests(test: DataFrame, known: DataFrame, options: Options) -> DataFrame:
    """Items of test baskets with 2 to max_items items: ord, path, is_known, n_files, n_known."""
    rows = test.where(F.size("files").between(2, options.max_items)).select("ord", F.size("files").cast("long").alias("n_files"), F.explode("files").alias("path"))
    marked = rows.join(known.withColumn("is_known", F.lit(True)), "path", "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))
    return marked.withColumn("n_known", F.count_if("is_known").over(Window.partitionBy("ord")))


def rankers(train: DataFrame, options: Options, shape: str) -> dict[str, Callable[[DataFrame, int | None], DataFrame]]:
    """mode -> function(seeds, top) giving (seed, path, score, cochanges, reason, rank, ...), over each seed's baskets or all.

    The options' bounds hold; an evaluation lifts them, as its window bounds it.
    """
    free = options
    if shape == "on-demand":
        return {
            "direct": lambda seeds, top: scorers.direct_on_demand(train, seeds, free, top),
            "pagerank": lambda seeds, top: scorers.pagerank_on_demand(train, seeds, free, top),
            "hot": lambda seeds, top: scorers.hot_on_demand(train, seeds, free, top),
            "path": lambda seeds, top: _path_on_demand(train, seeds, free, top),
        }
    items = graph.item_stats(train, free)
    pairs = graph.pair_stats(train, free)

    def hot(seeds: DataFrame, top: int | None) -> DataFrame:
        if not top:
            raise ValueError("the hottest items of all are the same for every seed: give top")
        first = scorers.hot(items, top + 1)  # one more than asked for, as a seed leaves itself out
        rows = seeds.select("seed").join(F.broadcast(first), F.col("seed") != F.col("path"))
        return scorers.ranked(rows.withColumn("reason", F.lit("hot_file_baseline")), top, "seed")

    def pagerank(seeds: DataFrame, top: int | None) -> DataFrame:
        scores = scorers.pagerank(graph.adjacency(pairs), seeds)
        return scorers.ranked(scorers.with_direct(scores, scorers.direct_global(train, free)), top, "seed")

    return {
        "direct": lambda seeds, top: scorers.direct_global(train, free, top).join(seeds, "seed", "left_semi"),
        "pagerank": pagerank,
        "hot": hot,
        "path": lambda seeds, top: scorers.path_similarity(seeds.select(F.col("seed").alias("path")), items.select("path"), top),
    }


def _path_on_demand(train: DataFrame, seeds: DataFrame, options: Options, top: int | None) -> DataFrame:
    near = scorers.hot_on_demand(train, seeds, options).select("seed", "path")
    scores = scorers.path_similarity(seeds.select(F.col("seed").alias("path")), near.select("path").distinct())
    return scorers.ranked(scores.drop("rank").join(near, ["seed", "path"], "left_semi"), top, "seed")


def query_tasks(items: DataFrame) -> DataFrame:
    """One task for each known item of a basket with two of them or more: ord, seed, n_targets."""
    return items.where("is_known and n_known >= 2").select("ord", F.col("path").alias("seed"), (F.col("n_known") - 1).alias("n_targets"))


def query_metrics(tests: DataFrame, train: DataFrame, options: Options, modes: tuple[str, ...], shape: str, top: int) -> DataFrame:
    """mode, tasks, hit_rate_at_k, precision_at_k, recall_at_k, mrr, avg_results."""
    items = eligible_tests(tests, known_items(train, options), options)
    tasks = query_tasks(items)
    targets = items.where("is_known").select("ord", "path")
    seeds = tasks.select("seed").distinct()
    made = rankers(train, options.but(max_baskets=0, since=None), shape)
    out = None
    for mode in modes:
        results = made[mode](seeds, top).select("seed", "path", "rank")
        met = tasks.join(results, "seed", "left").join(targets.withColumn("hit", F.lit(True)), ["ord", "path"], "left")
        by_task = met.groupBy("ord", "seed").agg(
            F.first("n_targets").alias("n_targets"), F.count("path").alias("results"), F.count_if(F.coalesce("hit", F.lit(False))).alias("hits"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first")
        )
        rows = by_task.agg(
            F.lit(mode).alias("mode"),
            F.count(F.lit(1)).alias("tasks"),
            F.avg((F.col("hits") > 0).cast("double")).alias("hit_rate_at_k"),
            F.avg(F.col("hits") / top).alias("precision_at_k"),
            F.avg(F.col("hits") / F.col("n_targets")).alias("recall_at_k"),
            F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
            F.avg(F.col("results").cast("double")).alias("avg_results"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out.na.fill(0.0)


def query_counters(tests: DataFrame, train: DataFrame, options: Options) -> DataFrame:
    """candidate_tasks, evaluated_tasks, skipped_unknown_seed; baskets with fewer than two known items do not count."""
    items = eligible_tests(tests, known_items(train, options), options).where("n_known >= 2")
    return items.agg(
        F.count(F.lit(1)).alias("candidate_tasks"), F.count_if("is_known").alias("evaluated_tasks"), F.count_if(~F.col("is_known")).alias("skipped_unknown_seed")
    )


def audit_counters(tests: DataFrame, train: DataFrame, options: Options) -> DataFrame:
    """candidate_tasks (all items), evaluated_tasks, skipped_unknown_targets, skipped_insufficient_known_files."""
    items = eligible_tests(tests, known_items(train, options), options)
    return items.agg(
        F.count(F.lit(1)).alias("candidate_tasks"),
        F.count_if(F.col("is_known") & (F.col("n_known") >= 2)).alias("evaluated_tasks"),
        F.count_if(~F.col("is_known")).alias("skipped_unknown_targets"),
        F.count_if(F.col("is_known") & (F.col("n_known") < 2)).alias("skipped_insufficient_known_files"),
    )


def audit_candidates(tests: DataFrame, train: DataFrame, options: Options, mode: str) -> tuple[DataFrame, DataFrame]:
    """Leave-one-out tasks (ord, omitted), and the first options.top candidates of all bands of each, with rank.

    An item is a candidate of the task that omits it from every other seed of its basket.
    Each distinct seed is ranked once over all tasks.
    """
    items = eligible_tests(tests, known_items(train, options), options).where("is_known and n_known >= 2").select("ord", "path")
    tasks = items.select("ord", F.col("path").alias("omitted"))
    seeds = items.select(F.col("path").alias("seed")).distinct()
    ranking = rankers(train, options.but(max_baskets=0, since=None), "on-demand")[mode](seeds, seed_budget(options.top))
    for column, value in (("weight", F.lit(0.0)), ("last_seen", F.lit(""))):
        if column not in ranking.columns:
            ranking = ranking.withColumn(column, value)
    pairs = tasks.join(items.select("ord", F.col("path").alias("seed")), "ord").where("seed <> omitted")
    found = pairs.join(ranking.select("seed", "path", "score", "cochanges", "weight", "last_seen", "reason"), "seed")
    # a result that is itself a seed of the task is no candidate; the omitted item is
    own = items.select("ord", "path", F.lit(True).alias("__own"))
    found = found.join(own, ["ord", "path"], "left").where("__own is null or path = omitted").drop("__own")
    all_bands = changedset.aggregate(found, "changed_set_cochange", "ord", "omitted")
    return tasks, changedset.top_candidates(all_bands, options.but(min_confidence="low"), "ord", "omitted")


def audit_metrics(tasks: DataFrame, shown: DataFrame, options: Options, mode: str) -> DataFrame:
    """mode, tasks, hits_at_k, hit_rate_at_k, precision_at_k, mrr, avg_results, avg_false_positives, abstention_rate."""
    kept = changedset.at_least(shown, options.min_confidence)
    order = Window.partitionBy("ord", "omitted").orderBy("rank")
    kept = kept.withColumn("place", F.row_number().over(order))
    by_task = tasks.join(kept, ["ord", "omitted"], "left").groupBy("ord", "omitted").agg(
        F.count("path").alias("results"), F.min(F.when(F.col("path") == F.col("omitted"), F.col("place"))).alias("first")
    )
    hit = F.col("first").isNotNull()
    n = F.count(F.lit(1))
    return by_task.agg(
        F.lit(mode).alias("mode"), n.alias("tasks"), F.count_if(hit).alias("hits_at_k"), scoring.ratio(F.count_if(hit), n).alias("hit_rate_at_k"),
        scoring.ratio(F.count_if(hit) / options.top, n).alias("precision_at_k"), F.coalesce(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.col("results").cast("double")), F.lit(0.0)).alias("avg_results"),
        F.coalesce(F.avg((F.col("results") - hit.cast("int")).cast("double")), F.lit(0.0)).alias("avg_false_positives"),
        scoring.ratio(F.count_if(F.col("results") == 0), n).alias("abstention_rate"),
    )


def band_metrics(tasks: DataFrame, shown: DataFrame, mode: str) -> DataFrame:
    """mode, confidence, candidates, correct_candidates, candidate_precision, tasks_with_..., task_coverage, conditional_hit_rate."""
    spark = tasks.sparkSession
    right = F.col("path") == F.col("omitted")
    by_task = shown.groupBy("confidence", "ord", "omitted").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right"))
    by_band = by_task.groupBy("confidence").agg(
        F.sum("n").alias("candidates"), F.sum("right").alias("correct_candidates"), F.count(F.lit(1)).alias("tasks_with_candidates"), F.count_if(F.col("right") > 0).alias("tasks_with_correct_candidate")
    )
    bands = spark.createDataFrame([(b,) for b in BANDS], "confidence string")
    rows = bands.join(by_band, "confidence", "left").na.fill(0)
    total = tasks.agg(F.count(F.lit(1)).alias("__tasks"))
    return rows.join(F.broadcast(total)).select(  # one row
        F.lit(mode).alias("mode"), "confidence", "candidates", "correct_candidates",
        scoring.ratio(F.col("correct_candidates"), F.col("candidates")).alias("candidate_precision"), "tasks_with_candidates", "tasks_with_correct_candidate",
        scoring.ratio(F.col("tasks_with_candidates"), F.col("__tasks")).alias("task_coverage"),
        scoring.ratio(F.col("tasks_with_correct_candidate"), F.col("tasks_with_candidates")).alias("conditional_hit_rate"),
    )
