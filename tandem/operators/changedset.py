"""Changed sets and what their items' rankings add up to: audit candidates, diff results, enforcement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BANDS, Options
from ..functions import paths, scoring
from .scorers import DIGITS


def worktree(staged: DataFrame, unstaged: DataFrame, untracked: DataFrame) -> DataFrame:
    """path, history_path of all changes: an unstaged rename of a staged one is looked up under the oldest name.

    An unstaged row takes the place of the staged row it goes on from, or of the same path; untracked paths come last.
    """
    chained = (
        unstaged.alias("u")
        .join(staged.alias("s"), F.col("u.history_path") == F.col("s.path"), "left")
        .select(F.col("u.path").alias("path"), F.coalesce("s.history_path", "u.history_path").alias("history_path"), F.col("u.history_path").alias("from"))
    )
    rest = staged.join(chained.select(F.col("from").alias("path")).distinct(), "path", "left_anti")
    rows = (
        chained.select("path", "history_path", F.lit(0).alias("source"))
        .unionByName(rest.select("path", "history_path", F.lit(1).alias("source")))
        .unionByName(untracked.select("path", F.col("path").alias("history_path"), F.lit(2).alias("source")))
    )
    first = F.row_number().over(Window.partitionBy("path").orderBy("source", "history_path"))
    return rows.withColumn("__first", first).where("__first = 1").select("path", "history_path")


def changed_names(changed: DataFrame) -> DataFrame:
    """Every name of the changed set, visible or in history."""
    return changed.select("path").union(changed.select("history_path")).distinct()


def attributed(rankings: DataFrame, changed: DataFrame) -> DataFrame:
    """Rankings looked up under the history name, with the visible name as seed."""
    names = changed.select(F.col("history_path").alias("seed"), F.col("path").alias("__visible"))
    return rankings.join(names, "seed").drop("seed").withColumnRenamed("__visible", "seed")


def eligible(rankings: DataFrame, universe: DataFrame, changed: DataFrame, options: Options) -> DataFrame:
    """Rankings (already cut to their budget) whose path is in the universe, not changed and not excluded."""
    rows = rankings.join(universe.select("path").distinct(), "path", "left_semi").join(changed_names(changed), "path", "left_anti")
    return rows.where(~paths.excluded(F.col("path"), options.exclude))


def aggregate(rankings: DataFrame, mixed_reason: str = "changed_set_cochange", *key: str) -> DataFrame:
    """Candidates over (seed, path, score, cochanges, weight, last_seen, reason): sums, strongest pair, supporters, band.

    key: further columns that keep sets of rankings apart, such as an evaluation task.
    """
    return (
        rankings.groupBy(*key, "path")
        .agg(
            F.sum("score").alias("score"),
            F.sum("cochanges").alias("cochanges"),
            F.max("cochanges").alias("strongest"),
            F.sum("weight").alias("weight"),
            F.max("last_seen").alias("last_seen"),
            F.sort_array(F.collect_set("seed")).alias("supported_by"),
            F.when(F.min("reason") == F.max("reason"), F.min("reason")).otherwise(mixed_reason).alias("reason"),
        )
        .withColumn("support_count", F.size("supported_by").cast("long"))
        .withColumn("confidence", scoring.confidence(F.col("strongest")))
    )


def candidate_order(*key: str):
    """Window of candidates: confidence, support, score, cochanges, all descending, then path."""
    return Window.partitionBy(*key).orderBy(
        F.desc(scoring.band_rank(F.col("confidence"))), F.desc("support_count"), F.desc(F.round("score", DIGITS)), F.desc("cochanges"), "path"
    )


def at_least(candidates: DataFrame, band: str) -> DataFrame:
    return candidates.where(scoring.band_rank(F.col("confidence")) >= BANDS.index(band))


def top_candidates(candidates: DataFrame, options: Options, *key: str) -> DataFrame:
    """The first options.top of at least options.min_confidence, with rank."""
    kept = at_least(candidates, options.min_confidence)
    return kept.withColumn("rank", F.row_number().over(candidate_order(*key))).where(F.col("rank") <= options.top)


def filtered_count(candidates: DataFrame, options: Options) -> DataFrame:
    """candidates and filtered: how many there are, and how many the minimum confidence hides before the cut."""
    below = scoring.band_rank(F.col("confidence")) < BANDS.index(options.min_confidence)
    return candidates.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(below).alias("filtered"))


def enforcement(shown: DataFrame, band: str) -> DataFrame:
    """findings and triggered: the shown candidates of at least the enforced band."""
    found = F.count_if(scoring.band_rank(F.col("confidence")) >= BANDS.index(band))
    return shown.agg(found.alias("findings"), (found > 0).alias("triggered"))


def merged_evidence(evidence: DataFrame, limit: int, *key: str) -> DataFrame:
    """Evidence of (path, seed, hash, date, ...) per path: newest date first, then hash, each hash once, the first `limit`."""
    once = F.row_number().over(Window.partitionBy(*key, "path", "hash").orderBy(F.desc("date"), "seed"))
    rows = evidence.withColumn("__once", once).where("__once = 1").drop("__once")
    nth = F.row_number().over(Window.partitionBy(*key, "path").orderBy(F.desc("date"), "hash"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= limit)


def with_evidence(results: DataFrame, evidence: DataFrame, *key: str) -> DataFrame:
    """Results with an array evidence (hash, date, subject, file_count, weight) in the order of nth, empty where there is none."""
    fields = ("hash", "date", "subject", "file_count", "weight")
    own = evidence.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("nth", *fields))).alias("__found"))
    shown = F.transform(F.coalesce("__found", F.array()), lambda e: F.struct(*[e[f].alias(f) for f in fields]))
    return results.join(own, list(key), "left").withColumn("evidence", shown).drop("__found")


def diff(rankings: DataFrame, changed: DataFrame, options: Options) -> DataFrame:
    """Related items of a changed set: rankings without changed items, summed, excluded, ranked by score, cut."""
    rows = rankings.join(changed.select("path"), "path", "left_anti")
    total = aggregate(rows, "diff_aggregate").where(~paths.excluded(F.col("path"), options.exclude))
    return total.orderBy(F.desc(F.round("score", DIGITS)), "path").limit(options.top)


def broad_hint(ranked: DataFrame, *key: str) -> DataFrame:
    """Per key, whether at least four and at least half of the first eight results are broad-change files."""
    first = ranked.where("rank <= 8").groupBy(*key).agg(F.count(F.lit(1)).alias("shown"), F.count_if(paths.is_broad(F.col("path"))).alias("broad"))
    return first.withColumn("hint", (F.col("broad") >= 4) & (F.col("broad") * 2 >= F.col("shown")))
