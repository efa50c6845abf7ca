"""The most similar names of each name, exactly, without comparing all with all.

A token (or folder) of few names is rare, any other is frequent. Names that share a rare one are compared in full, in groups of
bounded size. Names that share none have a score of their frequent tokens and norms only, so it is computed once for each pair of
classes of names that agree in those, in blocks of classes. A class is known by its names of smallest path: with `top + 1` of the best classes, and as many names of
each, none of the `top` best is left out, whether or not a name shares a rare token with the seed.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..plans.checkpoints import written

#: A token of at most so many names, or an eighth of the square root of all names, is rare.
RARE = 64
#: Classes of a block.
BLOCK = 2048
PAIRS = 1 << 18
DIGITS, BONUS = 9, 0.25
_ENTRY = np.dtype([("id", "<i4"), ("weight", "<f4")])  # weights are halves of small whole numbers
_HEAD = np.dtype([("norm", "<f8"), ("folder", "<i4")])


def _steps(score: np.ndarray) -> np.ndarray:
    """Scores in units of the last digit that ranks them."""
    return np.floor(score * 10.0**DIGITS + 0.5)


def _parted(frequent):
    """Adds key, what a name's class is known by, and rare, the ids of its rare tokens and folder."""

    def run(batches):
        known = frequent.value

        def place(ids):
            at = np.searchsorted(known, ids)
            return np.where((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == ids), at, -1) if len(known) else np.full(len(ids), -1)

        for batch in batches:
            n, ids = batch.num_rows, batch.column("ids").flatten().to_numpy()
            weight, folder = batch.column("weights").flatten().to_numpy(), batch.column("folder").to_numpy()
            row = np.repeat(np.arange(n), np.diff(batch.column("ids").offsets.to_numpy()))
            head = np.zeros(n, _HEAD)
            head["norm"], head["folder"] = np.bincount(row, weight * weight, n), place(folder)
            at = place(ids)
            order = np.lexsort((at, row))
            order = order[at[order] >= 0]
            entries = np.zeros(len(order), _ENTRY)
            entries["id"], entries["weight"] = at[order], weight[order]
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[order], minlength=n))))
            keys = [head[i].tobytes() + entries[ends[i] : ends[i + 1]].tobytes() for i in range(n)]
            lone = np.flatnonzero(head["folder"] < 0)
            owner, rare = np.concatenate((row[at < 0], lone)), np.concatenate((ids[at < 0], folder[lone]))
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rare[np.argsort(owner, kind="stable")]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary()), rare], [*batch.schema.names, "key", "rare"])

    return run


def _in_groups(top: int):
    """The best of each seed among the names that share one rare token with it; rows come in order of tokens."""

    def compared(rows: pa.Table):
        token, seed, cand, folder = (rows.column(c).to_numpy() for c in ("token", "seed", "cand", "folder"))
        ids, lists = rows.column("ids").combine_chunks(), rows.column("weights").combine_chunks()
        ids, weight, first = ids.flatten().to_numpy(), lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
        count = np.diff(first)
        row = np.repeat(np.arange(len(token)), count)
        norm = np.bincount(row, weight * weight, len(token))
        names, code = np.unique(ids, return_inverse=True)
        place = row * len(names) + code
        order = np.argsort(place)
        place, sorted_weight = place[order], weight[order]
        cut = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
        group = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        lo, size = cut[:-1][group], np.diff(cut)[group]
        asked = np.flatnonzero(seed & (size > 1))
        parts = np.cumsum(size[asked]) // PAIRS
        for some in np.split(asked, np.flatnonzero(np.diff(parts)) + 1):
            a = np.repeat(some, size[some])
            b = np.arange(len(a)) - np.repeat(np.cumsum(size[some]) - size[some], size[some]) + lo[a]
            keep = cand[b] & (a != b)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            pair = np.repeat(np.arange(len(a)), count[a])
            flat = np.arange(len(pair)) - np.repeat(np.cumsum(count[a]) - count[a], count[a]) + first[a][pair]
            wanted = b[pair] * len(names) + code[flat]
            at = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
            dot = np.bincount(pair, np.where(place[at] == wanted, weight[flat] * sorted_weight[at], 0.0), len(a))
            score = dot / np.sqrt(norm[a] * norm[b]) + np.where(folder[a] == folder[b], BONUS, 0.0)
            value = _steps(score)
            order = np.lexsort((-value, a))
            begin = np.flatnonzero(np.concatenate(([True], a[order][1:] != a[order][:-1], [True])))
            last = np.minimum(begin[:-1] + top, begin[1:]) - 1  # ties with the last one stay
            best = order[value[order] >= np.repeat(value[order][last], np.diff(begin))]
            yield pa.RecordBatch.from_arrays(
                [rows.column("path").take(pa.array(x)).combine_chunks() for x in (a[best], b[best])] + [pa.array(score[best])], ["seed", "path", "score"]
            )

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held, n = [*held, batch], n + batch.num_rows
            token = batch.column("token").to_numpy()
            if n < 4096 or token[0] == token[-1]:
                continue
            whole = int(np.searchsorted(token, token[-1]))
            yield from compared(pa.Table.from_batches([*held[:-1], batch.slice(0, whole)]))
            held, n = [batch.slice(whole)], batch.num_rows - whole
        if held:
            yield from compared(pa.Table.from_batches(held))

    return run


def _unpacked(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Heads, entries and the owners of the entries."""
    entries = np.frombuffer(b"".join(x[_HEAD.itemsize :] for x in keys), _ENTRY)
    owner = np.repeat(np.arange(len(keys)), [(len(x) - _HEAD.itemsize) // _ENTRY.itemsize for x in keys])
    return np.frombuffer(b"".join(x[: _HEAD.itemsize] for x in keys), _HEAD), entries, owner


def _in_blocks(top: int):
    """The best `top + 1` classes of a block for each class of another that holds a seed, equal scores by first path."""

    def run(batches):
        for batch in batches:
            for ours, theirs in zip(batch.column("ours"), batch.column("theirs")):
                ours, theirs = ours.values, theirs.values
                heads, entries, owner = _unpacked(theirs.field("key").to_pylist())
                order = np.argsort(entries["id"], kind="stable")
                kinds, begin = np.unique(entries["id"][order], return_index=True)
                ends = [*begin[1:], len(order)]
                lists = {int(k): (owner[order[lo:hi]], entries["weight"][order[lo:hi]].astype(float)) for k, lo, hi in zip(kinds, begin, ends)}
                size = np.minimum(theirs.field("n").to_numpy(), top + 1)
                seeds, wanted, of = _unpacked(ours.field("key").to_pylist())
                first = np.searchsorted(of, np.arange(len(seeds) + 1))
                out = []
                for i in range(len(seeds)):
                    dot = np.zeros(len(heads))
                    for id_, weight in wanted[first[i] : first[i + 1]].tolist():
                        if id_ in lists:
                            rows, other = lists[id_]
                            dot[rows] += weight * other
                    score = dot / np.sqrt(seeds["norm"][i] * heads["norm"])
                    if seeds["folder"][i] >= 0:
                        score += np.where(heads["folder"] == seeds["folder"][i], BONUS, 0.0)
                    value = _steps(score)
                    best = np.flatnonzero(score > 0)
                    if len(best) > top + 1:
                        least = np.partition(value[best], len(best) - top - 1)[len(best) - top - 1]
                        over, even = best[value[best] > least], best[value[best] == least]
                        best = np.concatenate((over, even[: top + 1 - len(over)]))
                    best = best[np.lexsort((best, -value[best]))]
                    better = np.concatenate(([0], np.cumsum(size[best])))[np.searchsorted(-value[best], -value[best])]
                    best = best[better <= top]
                    out.append((np.full(len(best), i), best, score[best]))
                a, b, score = (np.concatenate(x) for x in zip(*out))
                columns = [ours.field("class").take(pa.array(a)), theirs.field("class").take(pa.array(b)), theirs.field("first").take(pa.array(b)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["seed_class", "class", "first", "score"])

    return run


def _best(rows: DataFrame, n: int, key: str, tie: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(F.round("score", DIGITS)), tie)
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def nearest(targets: DataFrame, candidates: DataFrame, top: int, rare: int = RARE, block: int = BLOCK) -> DataFrame:
    """seed, path, score: the `top` best candidates of each target, and maybe more; both sides have one column path.

    Tokens are compared by 64-bit hashes.
    """
    spark = targets.sparkSession
    sides = targets.select("path", F.lit(True).alias("seed"), F.lit(False).alias("cand")).unionByName(candidates.select("path", F.lit(False).alias("seed"), F.lit(True).alias("cand")))
    tokens = paths.tokens(F.col("path"))
    names = (
        sides.groupBy("path").agg(F.max("seed").alias("seed"), F.max("cand").alias("cand")).withColumn("t", tokens).where(F.size("t") > 0)
        .select("path", "seed", "cand", F.transform("t", lambda t: F.xxhash64(t["token"])).alias("ids"), F.col("t.weight").alias("weights"), F.xxhash64(F.lit("folder"), paths.dirname(F.col("path"))).alias("folder"))
    )
    names = written(names, "names")
    rare = max(rare, isqrt(names.count()) // 8)
    counted = names.select(F.explode(F.concat("ids", F.array("folder"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    frequent = spark.sparkContext.broadcast(np.sort(counted.where(F.col("n") > rare).select("id").toArrow()["id"].to_numpy()))
    parted = written(names.mapInArrow(_parted(frequent), f"{_ddl(names)}, key binary, rare array<long>"), "parted-names")

    groups = parted.select(F.explode("rare").alias("token"), "path", "seed", "cand", "ids", "weights", "folder").repartition("token").sortWithinPartitions("token")
    close = groups.mapInArrow(_in_groups(top), "seed string, path string, score double")

    known = parted.groupBy("key").agg(F.min(F.when(F.col("cand"), F.col("path"))).alias("first"), F.count_if("cand").alias("n"), F.max("seed").alias("seed"))
    classes = written(known.withColumn("class", F.monotonically_increasing_id()), "classes")
    blocks = -(-classes.count() // block) or 1
    classes = classes.withColumn("block", F.expr(f"pmod(xxhash64(key), {blocks})"))
    theirs = classes.where("n > 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("first", "class", "n", "key"))).alias("theirs"))
    ours = classes.where("seed").groupBy("block").agg(F.collect_list(F.struct("class", "key")).alias("ours"))
    ours = ours.select("ours", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    matched = ours.hint("merge").join(theirs, "block").select("ours", "theirs").mapInArrow(_in_blocks(top), "seed_class long, class long, first string, score double")

    # there may be as many classes as names, and keys compress far better than a broadcast's rows
    member = parted.join(classes.select("key", "class").hint("merge"), "key")
    nth = F.row_number().over(Window.partitionBy("class").orderBy("path"))
    members = member.where("cand").select("class", "path").withColumn("nth", nth).where(F.col("nth") <= top + 1).drop("nth")
    wide = _best(matched, top + 1, "seed_class", "first").join(members, "class").select("seed_class", "path", "score")
    wide = _best(wide, top + 1, "seed_class", "path").join(member.where("seed").select(F.col("class").alias("seed_class"), F.col("path").alias("seed")), "seed_class")
    return close.unionByName(wide.where("seed <> path").select("seed", "path", "score")).groupBy("seed", "path").agg(F.max("score").alias("score"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
