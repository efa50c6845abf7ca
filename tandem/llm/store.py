"""Tables in the shared folder, and connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.checkpoints import shared_root, written  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(text: Column) -> Column:
    """The SHA-256 of a text, with which rows are told apart that repeat an id; null counts as the empty text."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def numbered(docs: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    """docs with its columns named c0, c1, ..., whatever their names, and the place of the text as a string among them, or after them."""
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(text_col).cast("string").alias("text"))
    if text_col in names and docs.schema[text_col].dataType == T.StringType():  # sent to the workers once
        return rows.drop("text"), names.index(text_col)
    return rows, len(names)


def renamed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of numbered() rows under the names they have in docs."""
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def without(docs: DataFrame, id_col: str, text_col: str, told: DataFrame) -> DataFrame:
    """The rows of docs that stay by `told` (doc_id, text_key, gone, rows), columns unchanged.

    Rows are known by id and text together; null ids are equal. Rows that told does not have stay. Of `rows` equal rows that are not gone
    one stays, whichever (they may differ in other columns). The join is by shuffle at every size, and texts are not sorted for it.
    """
    told = written(told.where("gone or rows > 1").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "gone"), "told")
    own = F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key"))
    keyed = docs.withColumn("__text_key", text_key(F.col(text_col))).withColumn("__own", F.col(id_col).cast(told.schema["__id"].dataType))
    stay = keyed.join(told.select("__id", "__key").hint("shuffle_hash"), own, "left_anti").select(*docs.columns)
    repeated = told.where("not gone")
    if repeated.isEmpty():
        return stay
    one = keyed.join(repeated, own, "left_semi").groupBy("__own", "__text_key").agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("__row"))
    return stay.unionByName(one.select("__row.*"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table (u long, v long): rows (node, label), label = smallest node.

    Alternating large-star and small-star steps, each a grouped minimum and an equi-join, so no
    neighbour list is ever gathered. Every round is written to the shared folder. Nodes without an edge
    do not appear. Self loops and repeated edges are allowed; an empty table gives an empty table.
    """
    now = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour (itself included)
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # small star: every smaller neighbour of a node, and the node, are tied to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        seen = _mark(after)
        now, changed, mark = after, seen != mark, seen
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(
        F.min("label").alias("label")
    )
