"""N-gram Jaccard join: a MinHash LSH forest proposes candidates, exact set comparison decides every link.

Each document is the set of its five-word shingles. Its signature fills `trees` prefix tries of `max_depth` hash
values. Tries are visited from the longest prefix on, and a document's prefixes are shortened until the least similar
partner that a set of its size can have shares a node with the target recall. Sets are laid out in the order of the first trie, in blocks of
bounded size; a block is compared with itself and with those blocks that share a trie node with it, by exact sets, and only
per-document counts leave a comparison, so pairs of documents are never rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .store import components, documents, text_key, without, written

SHINGLE, THRESHOLD, TREES, MAX_DEPTH, RECALL = 5, 0.8, 32, 8, 0.9999
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 19
SMALL, KNOWN = 64, 1 << 18


def prefix(similarity: float, trees: int, max_depth: int, recall: float) -> int:
    """The longest prefix that two sets of this similarity share in some tree with the target recall."""
    return next((d for d in range(max_depth, 1, -1) if 1 - (1 - similarity**d) ** trees >= recall), 1)


def least_similarity(n: int, threshold: float) -> float:
    """The least similarity of the threshold or more that a set of n shingles can have with a different one; 2 if none."""
    ratios = ((n - a, n + b) for a in range(n + 1) for b in range(int(n / threshold) + 2 - n) if a or b)
    return min((i / u for i, u in ratios if i >= threshold * u - 1e-9), default=2.0)


def visited(threshold: float, trees: int, max_depth: int, recall: float) -> list[set[int]]:
    """Prefix lengths at which sets of 0, 1, 2, ... shingles look for partners; the last entry is that of all larger sets.

    Two sets meet at the longer of the prefixes that each is shortened to. A set with no possible partner looks nowhere.
    """
    whole = prefix(threshold, trees, max_depth, recall)
    least = [least_similarity(n, threshold) for n in range(SMALL)]
    own = [prefix(x, trees, max_depth, recall) if x <= 1 else 0 for x in least]
    depth_of = lambda m: own[m] if m < SMALL else whole
    met = [{max(own[n], depth_of(m)) for m in range(math.ceil(n * threshold - 1e-9), int(n / threshold + 1e-9) + 1) if depth_of(m)} if own[n] else set() for n in range(SMALL)]
    return [*met, {whole}]


def _row_sets(hashes: np.ndarray, begin: np.ndarray):
    for i in range(len(begin) - 1):
        own = np.sort(hashes[begin[i] : begin[i + 1]])
        yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own


def _set_id(own: np.ndarray) -> int:
    total = bt.mix(own * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64, keepdims=True)
    return int((total + bt.mix(np.array([len(own)], np.uint64))).astype(np.int64)[0])


def _signatures(shingle: int, trees: int, max_depth: int, levels: list[int], of_size: list[set[int]]):
    rng = np.random.default_rng(11)
    size = trees * max_depth
    flip = rng.integers(0, 2**32, size, dtype=np.uint32)
    times = rng.integers(0, 2**31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    odd = rng.integers(0, 2**63, max_depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        seen = set()  # a set's nodes are given once a task, as far as is remembered
        for batch in batches:
            ids, sizes, least = [], [], np.full((batch.num_rows, size), 0xFFFFFFFF, np.uint32)
            for lo, _, data, offsets in bt.slices(batch.column(2)):
                hashes, first = bt.words(data, offsets)
                for i, own in enumerate(_row_sets(*bt.shingles(hashes, first, shingle))):
                    ids.append(_set_id(own) if len(own) else None)
                    sizes.append(len(own))
                    top = (own >> np.uint64(32)).astype(np.uint32)
                    for at in range(0, len(top), 512):
                        np.minimum(least[lo + i], ((top[at : at + 512, None] ^ flip) * times).min(0), out=least[lo + i])
            label = least.reshape(-1, trees, max_depth).astype(np.uint64)
            columns = [batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32())]
            new = np.array([i not in seen and not seen.add(i) for i in ids], bool)
            if len(seen) > KNOWN:
                seen.clear()
            for depth in levels:
                keys = bt.mix((label[:, :, :depth] * odd[:depth]).sum(2, dtype=np.uint64) + np.arange(trees, dtype=np.uint64) * odd[0] + np.uint64(depth))
                met = new & np.array([depth in of_size[min(n, len(of_size) - 1)] for n in sizes], bool)
                at = np.concatenate(([0], np.cumsum(np.where(met, trees, 0)))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(at, pa.array(keys[met].astype(np.int64).ravel(), pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "set_id", "n_shingles", *[f"k{i}" for i in range(len(levels))]])

    return bt.frugal(run)


def block_links(sets: list[np.ndarray], side: np.ndarray, weight: np.ndarray, threshold: float, cross: bool):
    """Exact links among `sets` (only across sides if `cross`): summed partner weights, and a local component label."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    everything, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(everything, kind="stable")
    ordered = everything[order]
    change = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    start = np.flatnonzero(change)
    length = np.diff(np.append(start, len(ordered)))
    dense = np.empty(len(ordered), np.int64)
    dense[order] = np.cumsum(change) - 1
    posting = owner[order]
    begin = np.concatenate(([0], np.cumsum(size)))
    links, label = np.zeros(n, np.int64), np.arange(n)
    for a in range(n):
        own = dense[begin[a] : begin[a + 1]]
        own = own[length[own] > 1]
        common = np.bincount(posting[bt.gather(start[own], length[own])], minlength=n)
        fits = common >= threshold * (size[a] + size - common) - 1e-9
        fits[a] = False
        if cross:
            fits &= side != side[a]
        if fits.any():
            links[a] = weight[fits].sum()
            met = np.unique(np.append(label[fits], label[a]))
            label[np.isin(label, met)] = met[0]
    return links, label


def _blocks(shingle: int, block_rows: int, block_shingles: int):
    """Sorted sets (set_id, weight, comp, text) as blocks of bounded size, a row each; their shingles packed and compressed."""

    def run(batches):
        part, n = TaskContext.get().partitionId() << 33, 0
        ids, weights, comps, sets, size = [], [], [], [], 0

        def made():
            packed = np.concatenate((np.cumsum([len(s) for s in sets]).astype(np.uint64), *sets)).tobytes()
            columns = [[part + n], [ids], [weights], [comps], [pa.compress(packed, "zstd", asbytes=True)], [len(packed)]]
            types = [pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["block", "ids", "weights", "comps", "data", "bytes"])

        for batch in batches:
            set_id, weight, comp = (batch.column(i).to_numpy() for i in range(3))
            for lo, _, data, offsets in bt.slices(batch.column(3)):
                hashes, first = bt.words(data, offsets)
                for i, own in enumerate(_row_sets(*bt.shingles(hashes, first, shingle)), lo):
                    # a repeated row comes again; a text of the same key can be another one
                    if (ids and ids[-1] == set_id[i]) or not len(own) or _set_id(own) != set_id[i]:
                        continue
                    if ids and (len(ids) >= block_rows or size + len(own) > block_shingles):
                        yield made()
                        n, ids, weights, comps, sets, size = n + 1, [], [], [], [], 0
                    ids.append(int(set_id[i]))
                    weights.append(int(weight[i]))
                    comps.append(int(comp[i]))
                    sets.append(own)
                    size += len(own)
        if ids:
            yield made()

    return bt.frugal(run)


def _unpacked(data: bytes, size: int, n: int) -> list[np.ndarray]:
    values = np.frombuffer(pa.decompress(data, size, "zstd"), np.uint64)
    return np.split(values[n:], values[: n - 1].astype(np.int64))


def _verify(threshold: float):
    """Exact links within a block, or between the two blocks of a row: set_id, links, root."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sets, weight, side = [], [], [], []
                for k in (0, 4):
                    if batch.column(k)[row].is_valid:
                        own = batch.column(k)[row].values.to_pylist()
                        ids += own
                        weight += batch.column(k + 1)[row].values.to_pylist()
                        sets += _unpacked(batch.column(k + 2)[row].as_buffer().to_pybytes(), batch.column(k + 3)[row].as_py(), len(own))
                        side += [k] * len(own)
                if len(ids) < 2:
                    continue
                links, label = block_links(sets, np.array(side), np.array(weight), threshold, side[-1] > 0)
                low = {}
                for i, g in enumerate(label):
                    low[g] = min(low.get(g, ids[i]), ids[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array([low[g] for g in label], pa.int64())], ["set_id", "links", "root"]
                )

    return bt.frugal(run)


def _linked(
    docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES,
    max_depth: int = MAX_DEPTH, recall: float = RECALL, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES,
) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id, text_key, set_id and n_shingles; and each set's label, size of class, first row and links."""
    of_size = visited(threshold, trees, max_depth, recall)
    levels = sorted(set().union(*of_size), reverse=True)
    keys = [f"k{i}" for i in range(len(levels))]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, text_key string, set_id long, n_shingles int, " + ", ".join(f"{k} array<long>" for k in keys)
    rows = written(base.mapInArrow(_signatures(shingle, trees, max_depth, levels, of_size), schema), "signatures")
    full = rows.where("set_id is not null")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = written(
        full.groupBy("set_id").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("weight"), *[F.min(F.get(k, F.lit(0))).alias(k) for k in keys]), "classes"
    )

    edges = None
    for k in keys:  # every set of a node is tied to the node's smallest
        own = full.select("set_id", F.explode(k).alias("node")).repartition("node").distinct()
        heads = own.groupBy("node").agg(F.min("set_id").alias("v"), F.max("set_id").alias("last")).where("v <> last").select("node", "v")
        tied = own.join(heads, "node").where("set_id <> v").select(F.col("set_id").alias("u"), "v")
        edges = tied if edges is None else edges.unionByName(tied)
    clusters = components(edges)

    member = classes.join(clusters.select(F.col("node").alias("set_id"), F.col("label").alias("comp")), "set_id").select(
        F.col("first.doc_id").alias("m_id"), F.col("first.text_key").alias("m_key"), "set_id", "weight", "comp", *keys
    )
    loaded = base.join(member.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_key") == F.col("m_key")))
    place = ["comp", *keys[::-1], "set_id"]
    loaded = written(loaded.select("set_id", "weight", "comp", "text", *keys), "members")
    blocks = written(
        loaded.repartitionByRange(*place).sortWithinPartitions(*place).select("set_id", "weight", "comp", "text")
        .mapInArrow(_blocks(shingle, block_rows, block_shingles), "block long, ids array<long>, weights array<long>, comps array<long>, data binary, bytes long"),
        "blocks",
    )
    placed = blocks.select("block", F.explode(F.arrays_zip(F.col("ids").alias("set_id"), F.col("comps").alias("comp"))).alias("e")).select("block", "e.*")
    wide = placed.groupBy("comp").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high").select("comp")
    spread = written(placed.join(wide, "comp").select("set_id", "block"), "spread")
    met = None
    for k in keys:
        here = full.select("set_id", k).join(spread, "set_id").select(F.explode(k).alias("node"), "block").distinct()
        met = here if met is None else met.unionByName(here)
    met = written(met, "met")
    pairs = met.select("node", F.col("block").alias("bi")).join(met.select("node", F.col("block").alias("bj")), "node").where("bi < bj").select("bi", "bj").distinct()
    pairs = written(pairs.unionByName(blocks.select(F.col("block").alias("bi"), F.lit(None).cast("long").alias("bj"))), "pairs")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.count() // 4 + 1)
    side = lambda b, i: blocks.select(F.col("block").alias(b), *[F.col(c).alias(f"{c}{i}") for c in ("ids", "weights", "data", "bytes")])
    both = pairs.join(side("bi", 0), "bi").join(side("bj", 1), "bj", "left").repartition(tasks, "bi", "bj")
    found = written(both.select(*[f"{c}{i}" for i in (0, 1) for c in ("ids", "weights", "data", "bytes")]).mapInArrow(_verify(threshold), "set_id long, links long, root long"), "links")

    label = components(found.where("links > 0").select(F.col("set_id").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    settled = (
        classes.select("set_id", "first", "weight").join(label.select(F.col("node").alias("set_id"), "label"), "set_id", "left")
        .join(links, "set_id", "left")
        .select("set_id", "first", "weight", F.coalesce("label", "set_id").alias("label"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    named = settled.groupBy("label").agg(F.min("first").alias("class_first"), F.sum("weight").alias("class_size"))
    return rows.select("doc_id", "text_key", "set_id", "n_shingles"), settled.join(named, "label").select("set_id", "class_first", "class_size", "n_links")


def near_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, class_size, n_links.

    class_id is the smallest doc_id of the documents joined by links, directly or over others; n_links
    counts the other documents of similarity `threshold` or more, copies included. A document of one to
    four words has one shingle of all its words. Null, empty and wordless texts have no shingle: no link, and
    a class of their own. Repeated rows count as documents of their own. A null doc_id stays null and never names a
    class that has another id. Very long texts are compared whole; one alone fills a block if it must. An empty table gives no
    rows. Other columns are ignored. Sets are compared by 64-bit shingle hashes.
    """
    rows, settled = _linked(docs, id_col, text_col, **options)
    linked = rows.where("set_id is not null").join(settled, "set_id").select("doc_id", "n_shingles", F.col("class_first.doc_id").alias("class_id"), "class_size", "n_links")
    return linked.unionByName(
        rows.where("set_id is null").select(
            "doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links")
        )
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay: one of each class of near-duplicates, columns unchanged.

    It is the row of the smallest id, null ids coming last; of several texts with that id in one class the one with the smallest
    digest, and one row of those that repeat both id and text. Rows without shingles are no near-duplicates of anything and all stay.
    """
    rows, settled = _linked(docs, id_col, text_col, **options)
    known = rows.where("set_id is not null").join(settled.select("set_id", F.col("class_first.doc_id").alias("first_id"), F.col("class_first.text_key").alias("first_key")), "set_id")
    told = known.groupBy("doc_id", "text_key").agg(
        F.bool_or(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key")))).alias("gone"), F.count(F.lit(1)).alias("rows")
    )
    return without(docs, id_col, text_col, told)


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_join(documents(spark, sf_dir))
