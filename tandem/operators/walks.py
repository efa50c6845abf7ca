"""PageRank over the graph of all baskets without its pairs: a step goes from items to their baskets and back.

An edge weighs the sum of its baskets' pair weights, so the mass that a basket passes to an item is its weight times the others' mass by degree. The
baskets are held as arrays, by each of a few tasks that share the seeds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ALPHA, STEPS, Options
from ..functions import scoring
from ..plans.checkpoints import written
from . import graph

#: Items of all baskets, 4 bytes each and as much again for their baskets, and names, 8 bytes each, that a task may hold.
FEW_ITEMS, FEW_NAMES = 1 << 26, 1 << 22
CHUNK = 1 << 21
DIGITS = 9


def _packed(names):
    """One row a batch: places of the items among the names, sizes and weights of the baskets."""

    def run(batches):
        known = names.value
        for batch in batches:
            ids = batch.column("ids")
            place = np.searchsorted(known, ids.flatten().to_numpy()).astype(np.int32)
            size = np.diff(ids.offsets.to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (place, size, batch.column("weight").to_numpy())], ["items", "sizes", "weights"])

    return run


def _walk(chunks: list, degree: np.ndarray, seed: int, steps: int, alpha: float) -> np.ndarray:
    rank, ends = np.zeros(len(degree)), degree <= 0
    rank[seed] = 1.0
    for _ in range(steps):
        share = np.divide(rank, degree, out=np.zeros(len(degree)), where=~ends)
        moved = np.zeros(len(degree))
        for items, sizes, weights in chunks:
            own = share[items]
            all_ = np.add.reduceat(own, np.cumsum(sizes) - sizes)
            moved += np.bincount(items, np.repeat(all_, sizes) * np.repeat(weights, sizes) - own * np.repeat(weights, sizes), len(degree))
        moved = np.maximum(moved, 0.0) * alpha  # what rounding leaves below nothing
        moved[seed] += 1 - alpha + alpha * rank[ends].sum()
        rank = moved
    return rank


def _of_groups(names, top: int, steps: int, alpha: float):
    def run(batches):
        known, held, chunks, group, seeds = names.value, [], [], None, []

        def merged():
            parts = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            chunks.append(parts)

        def ranks():
            if held:
                merged()
            degree = np.zeros(len(known))
            for items, sizes, weights in chunks:
                degree += np.bincount(items, np.repeat(weights * (sizes - 1), sizes), len(known))
            for name, id_ in seeds:
                at = int(np.searchsorted(known, id_))
                if at == len(known) or known[at] != id_:
                    continue
                rank = _walk(chunks, degree, at, steps, alpha)
                rank[at] = 0.0
                found = np.flatnonzero(rank > 0)
                value = np.floor(rank[found] * 10.0**DIGITS + 0.5)
                if len(found) > top:
                    found = found[value >= np.partition(value, len(value) - top)[len(value) - top]]  # ties with the last one stay
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(known[found]), pa.array(rank[found])], ["seed", "id", "score"])

        for batch in batches:
            for g, own, *parts in zip(*(batch.column(c) for c in ("group", "seeds", "items", "sizes", "weights"))):
                if g.as_py() != group:
                    if group is not None:
                        yield from ranks()
                    chunks.clear()
                    group, seeds = g.as_py(), [(x["seed"], x["id"]) for x in own.as_py()]
                held.append([np.frombuffer(x.as_buffer(), kind) for x, kind in zip(parts, (np.int32, np.int32, np.float64))])
                if sum(len(x[0]) for x in held) >= CHUNK:
                    merged()
        if group is not None:
            yield from ranks()

    return run


def best_of_all(baskets: DataFrame, seeds: DataFrame, options: Options, top: int, few_items: int = FEW_ITEMS, steps: int = STEPS, alpha: float = ALPHA) -> DataFrame | None:
    """seed, path, score: the `top` best of each seed by walks with restart, and those that tie with the last; None for histories beyond `few_items`.

    Names are known by 64-bit hashes; None also if two share one.
    """
    rows = graph.weighted(baskets, options).where(F.size("files") > 1)
    if (rows.agg(F.sum(F.size("files"))).first()[0] or 0) > few_items:
        return None
    nodes = written(rows.select(F.explode("files").alias("path")).distinct().select("path", F.xxhash64("path").alias("id")), "nodes")
    if nodes.count() > FEW_NAMES:
        return None
    ids = np.unique(nodes.select("id").toArrow()["id"].to_numpy())
    if len(ids) < nodes.count():
        return None
    names = baskets.sparkSession.sparkContext.broadcast(ids)
    weight = scoring.pair_weight(F.col("decay"), F.size("files").cast("long"))
    blocks = rows.select(F.transform("files", lambda f: F.xxhash64(f)).alias("ids"), weight.alias("weight")).mapInArrow(_packed(names), "items binary, sizes binary, weights binary")
    blocks = written(blocks, "basket-blocks")
    tasks = max(1, baskets.sparkSession.sparkContext.defaultParallelism // 2)
    own = seeds.select("seed", F.xxhash64("seed").alias("id")).distinct()
    groups = min(tasks, max(1, own.count()))
    own = written(own.groupBy(F.pmod("id", F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("seed", "id")).alias("seeds")), "seed-groups")
    spread = blocks.crossJoin(F.broadcast(own)).repartition(groups, "group").sortWithinPartitions("group")
    found = spread.mapInArrow(_of_groups(names, top, steps, alpha), "seed string, id long, score double")
    return found.join(nodes, "id").select("seed", "path", "score")


def direct(baskets: DataFrame, seeds: DataFrame, options: Options) -> DataFrame:
    """seed, path, cochanges, weight, last_seen: the seeds' pairs of the graph of all baskets."""
    rows = graph.weighted(baskets, options).withColumn("seed", F.explode("files")).join(seeds.select("seed").distinct(), "seed", "left_semi")
    pairs = rows.withColumn("path", F.explode("files")).where("path <> seed")
    weight = scoring.pair_weight(F.col("decay"), F.size("files").cast("long"))
    return pairs.groupBy("seed", "path").agg(F.count(F.lit(1)).alias("cochanges"), F.sum(weight).alias("weight"), F.max("date").alias("last_seen"))
