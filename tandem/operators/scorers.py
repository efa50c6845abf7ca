"""Rankings of items related to seeds, for all seeds at once: direct, hot, path and pagerank."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ALPHA, STEPS, Options
from ..functions import paths, scoring
from ..plans.checkpoints import cut
from . import graph, history, nearest, walks

#: Scores are ranked after rounding, so that the order of floating-point sums does not decide ties.
DIGITS = 9
#: Edges of a graph that is walked as arrays: 16 bytes each, and each node's name once.
FEW_EDGES = 1 << 20


def ranked(rows: DataFrame, top: int | None, *key: str) -> DataFrame:
    """Adds rank within the key (score descending, then path) and keeps the first `top`; None keeps all."""
    order = Window.partitionBy(*key).orderBy(F.desc(F.round("score", DIGITS)), "path")
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows if top is None else rows.where(F.col("rank") <= top)


def direct_global(baskets: DataFrame, options: Options, top: int | None = None) -> DataFrame:
    """seed, path, score, cochanges, weight, last_seen, rank over the graph of all baskets."""
    scored = graph.scored_pairs(graph.pair_stats(baskets, options), graph.item_stats(baskets, options))
    both = F.explode(F.array(F.struct(F.col("a").alias("seed"), F.col("b").alias("path")), F.struct(F.col("b").alias("seed"), F.col("a").alias("path"))))
    rows = scored.select(both.alias("e"), "score", "cochanges", "weight", "last_seen").select("e.seed", "e.path", "score", "cochanges", "weight", "last_seen")
    return ranked(rows.withColumn("reason", F.lit("direct_cochange")), top, "seed")


def seed_rows(baskets: DataFrame, seeds: DataFrame | None, options: Options) -> DataFrame:
    """Baskets of each seed with decay from the seed's newest basket."""
    rows = history.touching(baskets, seeds, options)
    newest = rows.groupBy("seed").agg(F.max("unix_time").alias("__latest"))
    return rows.join(newest, "seed").withColumn("decay", scoring.decay(F.col("__latest"), F.col("unix_time"), options.half_life_days)).drop("__latest")


def direct_on_demand(baskets: DataFrame, seeds: DataFrame | None, options: Options, top: int | None = None) -> DataFrame:
    """seed, path, score, cochanges, weight, last_seen, rank: the other item's mass counts only baskets shared with the seed."""
    rows = seed_rows(baskets, seeds, options)
    mass = rows.groupBy("seed").agg(F.sum("decay").alias("mass"))
    other = rows.withColumn("n_files", F.size("files")).withColumn("path", F.explode("files")).where("path <> seed")
    stats = other.groupBy("seed", "path").agg(
        F.count(F.lit(1)).alias("cochanges"),
        F.sum(scoring.pair_weight(F.col("decay"), F.col("n_files"))).alias("weight"),
        F.sum("decay").alias("shared"),
        F.max("date").alias("last_seen"),
    )
    scored = stats.join(mass, "seed").withColumn("score", scoring.normalised_score(F.col("weight"), F.col("mass"), F.col("shared")))
    return ranked(scored.select("seed", "path", "score", "cochanges", "weight", "last_seen", F.lit("direct_cochange").alias("reason")), top, "seed")


def on_demand_evidence(baskets: DataFrame, seeds: DataFrame | None, options: Options) -> DataFrame:
    """seed, path, nth, hash, date, subject, file_count, weight: the first options.evidence baskets, newest first."""
    rows = seed_rows(baskets, seeds, options).withColumn("n_files", F.size("files").cast("long")).withColumn("path", F.explode("files")).where("path <> seed")
    nth = F.row_number().over(Window.partitionBy("seed", "path").orderBy("ord"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= options.evidence).select(
        "seed", "path", "nth", "hash", "date", "subject", F.col("n_files").alias("file_count"), scoring.pair_weight(F.col("decay"), F.col("n_files")).alias("weight")
    )


def hot(items: DataFrame, top: int) -> DataFrame:
    """The items of greatest decayed mass."""
    rows = items.where("weighted_changes > 0").select("path", F.col("weighted_changes").alias("score"), F.lit(0).cast("long").alias("cochanges"), "last_seen")
    return rows.orderBy(F.desc(F.round("score", DIGITS)), "path").limit(top)


def hot_on_demand(baskets: DataFrame, seeds: DataFrame | None, options: Options, top: int | None = None) -> DataFrame:
    """seed, path, score, last_seen, rank: decayed mass in the seed's own baskets."""
    rows = seed_rows(baskets, seeds, options).withColumn("path", F.explode("files")).where("path <> seed")
    stats = rows.groupBy("seed", "path").agg(F.sum("decay").alias("score"), F.max("date").alias("last_seen"))
    return ranked(stats.where("score > 0").withColumn("cochanges", F.lit(0).cast("long")).withColumn("reason", F.lit("hot_file_baseline")), top, "seed")


def path_similarity(targets: DataFrame, candidates: DataFrame, top: int | None = None) -> DataFrame:
    """seed, path, score, rank by cosine of name tokens, plus 0.25 in one folder; both sides have one column path.

    Without `top`, pairs come from equal tokens and equal folders: a pair with neither scores 0 and is dropped. With it,
    frequent tokens are compared by classes of names (see `nearest`).
    """
    if top is not None:
        found = nearest.nearest(targets, candidates, top)
        return ranked(found.select("*", F.lit(0).cast("long").alias("cochanges"), F.lit("path_name_baseline").alias("reason")), top, "seed")

    def side(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        rows = df.select(F.col("path").alias(name)).distinct().withColumn("t", F.explode(paths.tokens(F.col(name)))).select(name, "t.token", "t.weight")
        norms = rows.groupBy(name).agg(F.sum(F.col("weight") * F.col("weight")).alias(f"norm_{name}"))
        return rows, norms

    (own, own_norm), (other, other_norm) = side(targets, "seed"), side(candidates, "path")
    dots = own.withColumnRenamed("weight", "w").join(other, "token").where("seed <> path").groupBy("seed", "path").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    near = (
        own_norm.select("seed", paths.dirname(F.col("seed")).alias("dir")).join(other_norm.select("path", paths.dirname(F.col("path")).alias("dir")), "dir")
        .where("seed <> path").select("seed", "path", F.lit(0.0).alias("dot"))
    )
    scored = (
        dots.unionByName(near).groupBy("seed", "path").agg(F.sum("dot").alias("dot"))
        .join(own_norm, "seed").join(other_norm, "path")
        .withColumn("score", F.col("dot") / F.sqrt(F.col("norm_seed") * F.col("norm_path")) + F.when(paths.dirname(F.col("seed")) == paths.dirname(F.col("path")), 0.25).otherwise(0.0))
        .where("score > 0")
    )
    return ranked(scored.select("seed", "path", "score", F.lit(0).cast("long").alias("cochanges"), F.lit("path_name_baseline").alias("reason")), top, "seed")


def _walk(source: np.ndarray, target: np.ndarray, p: np.ndarray, n: int, seed: int, steps: int, alpha: float) -> np.ndarray:
    """Mass of n nodes after `steps` steps from the seed; p already holds alpha."""
    rank = np.zeros(n)
    rank[seed] = 1.0
    ends = np.bincount(source, minlength=n) == 0
    for _ in range(steps):
        moved = np.bincount(target, rank[source] * p, n)
        moved[seed] += 1 - alpha + alpha * rank[ends].sum()
        rank = moved
    return rank


def _small_walks(moves: DataFrame, start: DataFrame, steps: int, alpha: float, by_seed: bool) -> DataFrame:
    """Walks over graphs of bounded size, held as arrays: one broadcast to all seeds, or each in its seed's group."""
    import pandas as pd
    import pyarrow as pa

    schema = "seed string, path string, score double"

    def shown(seed, names, rank):
        keep = (rank > 0) & (names != seed)
        return pd.DataFrame({"seed": seed, "path": names[keep], "score": rank[keep]})

    if by_seed:

        def of_group(rows: pd.DataFrame) -> pd.DataFrame:
            codes, names = pd.factorize(pd.concat([rows["u"], rows["v"]], ignore_index=True))
            seed, names, half = rows["seed"].iloc[0], np.asarray(names, object), len(rows)
            at = np.flatnonzero(names == seed)
            return shown(seed, names, _walk(codes[:half], codes[half:], rows["p"].to_numpy(), len(names), int(at[0]), steps, alpha) if len(at) else np.zeros(len(names)))

        return moves.join(start.select("seed"), "seed", "left_semi").groupBy("seed").applyInPandas(of_group, schema)

    found = moves.toArrow()
    both = pa.chunked_array([*found["u"].chunks, *found["v"].chunks], pa.string()).combine_chunks().dictionary_encode()
    codes, half = both.indices.to_numpy(), found.num_rows
    graph = moves.sparkSession.sparkContext.broadcast((codes[:half], codes[half:], found["p"].to_numpy(), both.dictionary.to_pylist()))

    def of_seeds(pages):
        source, target, p, names = graph.value
        names = np.array(names, object)
        place = {name: i for i, name in enumerate(names)}
        for page in pages:
            for seed in page["seed"]:
                if seed in place:
                    yield shown(seed, names, _walk(source, target, p, len(names), place[seed], steps, alpha))

    return start.select("seed").repartition("seed").mapInPandas(of_seeds, schema)


def pagerank(adj: DataFrame, seeds: DataFrame, steps: int = STEPS, alpha: float = ALPHA, by_seed: bool = False, few: int = FEW_EDGES) -> DataFrame:
    """seed, path, score: random walks with restart at each seed.

    adj: u, v, weight, and seed if each seed has a graph of its own (by_seed). A node without edges returns its mass to the
    seed. Graphs counted to have at most `few` edges are walked as arrays, all seeds in parallel. Larger ones are walked by one
    loop of `steps` equi-joins for all seeds: mass is 1 throughout, so the restart is one constant row a seed, each step reads the
    last one once, and lineage is cut every ten steps.
    """
    key = ["seed", "u"] if by_seed else ["u"]
    out = adj.groupBy(*key).agg(F.sum("weight").alias("degree"))
    moves = cut(adj.join(out, key).select(*key, "v", (F.col("weight") / F.col("degree") * alpha).alias("p")))
    start = cut(seeds.select("seed").distinct()).withColumn("u", F.col("seed"))
    edges = moves.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] if by_seed else moves.count()
    if (edges or 0) <= few:
        return _small_walks(moves, start, steps, alpha, by_seed)
    rank, restart = start.withColumn("r", F.lit(1.0)), start.withColumn("r", F.lit(1 - alpha))
    for step in range(1, steps + 1):
        joined = rank.join(moves, key, "left")
        moved = joined.select("seed", F.coalesce("v", "seed").alias("u"), (F.col("r") * F.coalesce("p", F.lit(alpha))).alias("r"))
        rank = moved.unionByName(restart).groupBy("seed", "u").agg(F.sum("r").alias("r"))
        if step % 10 == 0 and step < steps:
            rank = cut(rank)
    return rank.where("u <> seed and r > 0").select("seed", F.col("u").alias("path"), F.col("r").alias("score"))


def seed_graphs(baskets: DataFrame, seeds: DataFrame, options: Options) -> DataFrame:
    """seed, u, v, weight: the pair graph of each seed's own baskets."""
    rows = graph.basket_pairs(seed_rows(baskets, seeds, options))
    pairs = rows.groupBy("seed", "a", "b").agg(F.sum(scoring.pair_weight(F.col("decay"), F.col("n_files"))).alias("weight"))
    both = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    return pairs.select("seed", both.alias("e"), "weight").select("seed", "e.u", "e.v", "weight")


def pagerank_on_demand(baskets: DataFrame, seeds: DataFrame, options: Options, top: int | None = None) -> DataFrame:
    """Ranks over each seed's own graph, with the direct pair's evidence where there is one."""
    scores = pagerank(seed_graphs(baskets, seeds, options), seeds, by_seed=True)
    return ranked(with_direct(scores, direct_on_demand(baskets, seeds, options)), top, "seed")


def pagerank_global(baskets: DataFrame, seeds: DataFrame, options: Options, top: int) -> DataFrame:
    """Ranks over the graph of all baskets, with the direct pair's evidence where there is one.

    Up to 2^26 items of baskets are walked without making pairs (see `walks`); more are walked as one graph by `pagerank`.
    """
    seeds = cut(seeds.select("seed").distinct())
    scores = walks.best_of_all(baskets, seeds, options, top)
    if scores is None:
        scores = pagerank(graph.adjacency(graph.pair_stats(baskets, options)), seeds)
    best = ranked(scores, top, "seed").drop("rank")
    return ranked(with_direct(best, walks.direct(baskets, seeds, options)), top, "seed")


def with_direct(scores: DataFrame, direct: DataFrame) -> DataFrame:
    """Attaches cochanges, weight and last_seen of the direct pair, and the reason."""
    own = direct.select("seed", "path", "cochanges", "weight", "last_seen")
    found = scores.join(own, ["seed", "path"], "left")
    reason = F.when(F.col("cochanges").isNotNull(), "pagerank_direct_evidence").otherwise("pagerank_via_cochange_graph")
    return found.withColumn("reason", reason).select(
        "seed", "path", "score", F.coalesce("cochanges", F.lit(0)).cast("long").alias("cochanges"), F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce("last_seen", F.lit("")).alias("last_seen"), "reason",
    )
