"""Names through time: followed aliases, exact-content renames, and the alias closure of a training window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoints import cut


def follow(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Baskets (seed, ord, files) with every alias of the seed (seed, ord, alias) under its present name, each name once."""
    own = aliases.groupBy("seed", "ord").agg(F.collect_set("alias").alias("__names"))
    named = F.transform("files", lambda f: F.when(F.array_contains(F.coalesce("__names", F.array().cast("array<string>")), f), F.col("seed")).otherwise(f))
    return rows.join(own, ["seed", "ord"], "left").withColumn("files", F.array_distinct(named)).drop("__names")


def exact_content_renames(entries: DataFrame) -> DataFrame:
    """ord, old_path, new_path over tree entries (ord, parent_ord, path, mode, blob).

    A path that its basket brings in is a rename if exactly one path of the parent with the same mode and blob is gone; with
    several there is none.
    """
    now = entries.select("ord", "parent_ord", "path", "mode", "blob")
    before = entries.select(F.col("ord").alias("parent_ord"), F.col("path").alias("old_path"), "mode", "blob")
    added = now.join(before.select("parent_ord", F.col("old_path").alias("path")), ["parent_ord", "path"], "left_anti")
    children = now.select("ord", "parent_ord").distinct()
    removed = before.join(children, "parent_ord").join(now.select("ord", F.col("path").alias("old_path")), ["ord", "old_path"], "left_anti")
    unique = removed.groupBy("ord", "mode", "blob").agg(F.count(F.lit(1)).alias("sources"), F.min("old_path").alias("old_path")).where("sources = 1")
    return added.join(unique, ["ord", "mode", "blob"]).select("ord", "old_path", F.col("path").alias("new_path"))


def alias_map(renames: DataFrame) -> DataFrame:
    """old_path, new_path over (ord, pos, old_path, new_path): of several records of one old name the oldest holds."""
    last = F.row_number().over(Window.partitionBy("old_path").orderBy(F.desc("ord"), F.desc("pos")))
    return renames.withColumn("__last", last).where("__last = 1").select("old_path", "new_path")


def closure(aliases: DataFrame, max_rounds: int = 256) -> DataFrame:
    """old_path, canonical: the end of each chain of aliases; a walk into a cycle ends at the first name it meets again.

    Each round moves every open walk on by one equi-join, so there are as many rounds as the longest chain has renames.
    """
    steps = aliases.select(F.col("old_path").alias("place"), F.col("new_path").alias("next"))
    walks = aliases.select("old_path", F.col("new_path").alias("place"), F.array("old_path").alias("seen"))
    ended = None
    for _ in range(max_rounds):
        moved = cut(walks.join(steps, "place", "left").withColumn("open", F.col("next").isNotNull() & ~F.array_contains("seen", F.col("place"))))
        done = moved.where("not open").select("old_path", F.col("place").alias("canonical"))
        ended = done if ended is None else ended.unionByName(done)
        walks = moved.where("open").select("old_path", F.col("next").alias("place"), F.concat("seen", F.array("place")).alias("seen"))
        if walks.isEmpty():
            return ended
    raise RuntimeError(f"a chain of renames is longer than {max_rounds}")


def canonical(baskets: DataFrame, ends: DataFrame) -> DataFrame:
    """Baskets (ord, files) under canonical names, each name once in its first place."""
    rows = baskets.select("ord", F.posexplode("files").alias("pos", "path")).join(ends.select(F.col("old_path").alias("path"), "canonical"), "path", "left")
    named = rows.select("ord", "pos", F.coalesce("canonical", "path").alias("path"))
    files = named.groupBy("ord").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"])).alias("files"))
    return baskets.drop("files").join(files, "ord", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))


def canonical_tests(tests: DataFrame, test_renames: DataFrame, ends: DataFrame) -> DataFrame:
    """Test baskets: a name that the basket's own rename made is looked up as the canonical old name, others as in training."""
    own = (
        test_renames.join(ends.select("old_path", "canonical"), "old_path", "left")
        .withColumn("named", F.coalesce("canonical", "old_path"))
        .groupBy("ord", F.col("new_path").alias("path"))
        .agg(F.max_by("named", "pos").alias("named"))
    )
    rows = tests.select("ord", F.posexplode("files").alias("pos", "path")).join(own, ["ord", "path"], "left").join(ends.select(F.col("old_path").alias("path"), "canonical"), "path", "left")
    named = rows.select("ord", "pos", F.coalesce("named", "canonical", "path").alias("path"))
    files = named.groupBy("ord").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"])).alias("files"))
    return tests.drop("files").join(files, "ord", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
