"""LM scoring by prediction by partial matching, pretrained on the corpus.

A text is its tokens (runs of visible bytes, A-Z lower-cased) joined by one space, then an end mark; a context
trie over bytes, `order` deep, is counted over all training texts. The probability of a byte is that of its longest known
context; what a context has not seen escapes to the next shorter one with the share t / (n + t) of its t distinct
symbols (method C), whose symbols are then excluded. With fixed counts this is a function of the byte and the
`order` bytes before, so every distinct run of order + 1 bytes in the corpus is scored once: the trie is parted at its nodes of
few context bytes, and each part is scored as sorted arrays, a level at a time. Texts look the scores up: the commonest runs in
a broadcast table of fixed size, all others by a join. Token counts for the unigram base are looked up in the same way.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .store import documents, written

ORDER = 5
COMMON = 1 << 19
HELD = 1 << 20
SLICE = 1 << 20
FEW = 1 << 20
SIGN = np.int64(-(2**63))


class Coded:
    """Rows of a slice as the bytes to be coded, each row behind `order` end marks."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, order: int):
        pad, parts, tokens = b"\n" * order, [], []
        for i in range(len(offsets) - 1):
            own = data[offsets[i] : offsets[i + 1]].tobytes().lower().split()
            tokens.append(len(own))
            parts.append(pad + b" ".join(own) + b"\n")
        self.order, self.tokens = order, np.array(tokens, np.int64)
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def token_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Negative 64-bit keys of all tokens, and each row's first."""
        starts, ends, first = bt.spans((self.bytes != 32) & (self.bytes != 10), self.offsets)
        return bt.hash_spans(self.bytes, starts, ends).view(np.int64) | SIGN, first

    def run_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the runs of order + 1 bytes, one for each coded byte, and each row's first."""
        n = len(self.bytes) - self.order
        key = np.zeros(n, np.int64)
        for j in range(self.order + 1):
            key = (key << 8) | self.bytes[j : j + n]
        coded = np.ones(len(self.bytes), bool)
        coded[bt.gather(self.offsets[:-1], np.full(len(self.offsets) - 1, self.order))] = False
        return key[coded[self.order :]], self.offsets - self.order * np.arange(len(self.offsets))


class Lookup:
    """Vectorised hash table from int64 keys to float64 values, in tables of shrinking size and a sorted rest."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables, rest = [], np.arange(len(keys))
        for _ in range(4):
            bits = max(4, int(len(rest)).bit_length())
            slot = self._slot(keys[rest], bits)
            owner = np.zeros(1 << bits, np.int64)
            owner[slot] = rest
            mine = owner[slot] == rest
            table_keys, table_values = np.full(1 << bits, 1 << 62, np.int64), np.zeros(1 << bits)
            table_keys[slot[mine]], table_values[slot[mine]] = keys[rest[mine]], values[rest[mine]]
            self.tables.append((bits, table_keys, table_values))
            rest = rest[~mine]
        order = np.argsort(keys[rest])
        self.keys, self.values = keys[rest][order], values[rest][order]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * bits)) >> np.uint64(64 - bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN where there is none."""
        out = np.full(len(keys), np.nan)
        at = np.arange(len(keys))
        for bits, table_keys, table_values in self.tables:
            slot = self._slot(keys[at], bits)
            hit = table_keys[slot] == keys[at]
            out[at[hit]] = table_values[slot[hit]]
            at = at[~hit]
        if len(self.keys) and len(at):
            place = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
            hit = self.keys[place] == keys[at]
            out[at[hit]] = self.values[place[hit]]
        return out


def _summed(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return [keys[start], *(np.add.reduceat(c[order], start) if len(start) else c for c in counts)]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.diff(np.append(start, len(keys)))


def _count(order: int):
    """Partial counts of a task: tokens of training texts (negative keys), and runs of all texts."""

    def run(batches):
        held, size = [], 0

        def rows(merged):
            for at in range(0, len(merged[0]), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 18)]) for c in merged], ["key", "n_train", "n_all"])

        for batch in batches:
            training = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, offsets in bt.slices(batch.column(0), SLICE):
                own = training[lo:hi]
                coded = Coded(data, offsets, order)
                keys, first = coded.run_keys()
                mine = np.repeat(own, np.diff(first))
                trained, n = _distinct(keys[mine])
                other, m = _distinct(keys[~mine])
                held += [(trained, n, n), (other, np.zeros_like(m), m)]
                keys, first = coded.token_keys()
                keys, n = _distinct(keys[np.repeat(own, np.diff(first))])
                held.append((keys, n, n))
                size += len(trained) + len(other) + len(keys)
                if size > HELD:
                    held = [tuple(_summed(*(np.concatenate(c) for c in zip(*held))))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from rows(held[0])
                        held, size = [], 0
        if held:
            yield from rows(_summed(*(np.concatenate(c) for c in zip(*held))))

    return bt.frugal(run)


def _level(keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """A trie level of sorted keys (context bytes, then symbol): its contexts, each with total, kinds and first key."""
    contexts = keys >> 8
    start = np.flatnonzero(np.concatenate(([True], contexts[1:] != contexts[:-1]))) if len(keys) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts, start) if len(start) else np.zeros(0, np.int64)
    return {"key": keys, "n": counts, "context": contexts[start], "start": start, "total": total, "kinds": np.diff(np.append(start, len(keys)))}


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted keys, -1 for those that are not there."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, at, -1)


def _or_zero(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at >= 0, values[np.maximum(at, 0)], 0) if len(values) else np.zeros(len(at), np.int64)


def trie_scores(keys: np.ndarray, n_train: np.ndarray, order: int, short: list[dict]) -> np.ndarray:
    """log10 probability of the last byte of each run after those before it.

    keys, distinct, hold all runs of their last len(short) context bytes; short has the whole trie's levels of fewer
    context bytes, the one of none first. Levels are visited from the longest context on, and only runs that a level has not seen
    go to the next.
    """
    value = np.zeros(len(keys))
    seen = n_train > 0
    at = np.argsort(keys[seen])
    level = _level(keys[seen][at], n_train[seen][at])
    left, tail = np.arange(len(keys)), keys
    mass, kinds, excluded = level["total"] + level["kinds"], level["kinds"], np.zeros(len(left), np.int64)
    above = None
    for depth in range(order, -1, -1):
        if depth < order:
            mask = (1 << (8 * (depth + 1))) - 1
            above = level
            if depth < len(short):
                level = short[depth]
            else:
                level = _level(*_summed(above["key"] & mask, above["n"]))
            # what the longer contexts have seen is excluded from the shorter one
            same = _find(level["key"], above["key"] & mask)
            gone = np.add.reduceat(level["n"][same], above["start"]) if len(above["start"]) else np.zeros(0, np.int64)
            longer = _find(above["context"], tail >> 8)
            excluded, known = _or_zero(gone, longer), _or_zero(above["kinds"], longer)
            tail = tail & mask
        else:
            known = np.zeros(len(left), np.int64)
        own = _find(level["context"], tail >> 8)
        fresh = _or_zero(level["kinds"], own) - known
        mass = _or_zero(level["total"], own) - excluded + fresh
        place = _find(level["key"], tail)
        hit = place >= 0
        value[left[hit]] += np.log10(level["n"][place[hit]] / mass[hit])
        out = ~hit & (fresh > 0)
        value[left[out]] += np.log10(fresh[out] / mass[out])
        left, tail = left[~hit], tail[~hit]
    if len(left):
        value[left] -= np.log10(256 - _or_zero(level["kinds"], _find(level["context"], tail >> 8)))
    return value


def _run_scores(order: int, source, depth: int):
    """Scores of sorted rows (node, key, n_train, n_all): whole nodes together, about HELD / 4 rows at a time."""

    def run(batches):
        keys, counts = source.value
        short, level = [], _level(keys, counts)
        for d in range(depth - 1, -1, -1):
            short.insert(0, level)
            level = _level(*_summed(level["key"] & ((1 << (8 * d)) - 1), level["n"])) if d else level
        held, size = [], 0

        def scored(rows):
            key, n_train, n_all = rows
            value = trie_scores(key, n_train, order, short)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(value), pa.array(n_all)], ["key", "value", "n"])

        for batch in batches:
            node, *rows = (batch.column(i).to_numpy() for i in range(4))
            if not len(node):
                continue
            held.append((node, *rows))
            size += len(node)
            if size >= HELD // 4 and held[0][0][0] != node[-1]:
                whole = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(whole[0], whole[0][-1]))
                yield scored([c[:cut] for c in whole[1:]])
                held, size = [tuple(c[cut:] for c in whole)], len(whole[0]) - cut
        if held:
            yield scored([np.concatenate(c) for c in list(zip(*held))[1:]])

    return bt.frugal(run)


def run_scores(counts: DataFrame, order: int, few: int = FEW) -> DataFrame:
    """key, value (log10 probability of the last byte of each run after those before it) and n, over key, n_train, n_all.

    The trie is parted at its nodes of three context bytes, whole subtrees together; the levels above are a table of all
    three-byte strings, broadcast. Where more than `few` of them occur it is parted at two bytes, where 65536 are possible.
    """
    depth = min(3, order)
    level = lambda d: counts.where("n_train > 0").groupBy(F.col("key").bitwiseAND((1 << (8 * d)) - 1).alias("key")).agg(F.sum("n_train").alias("n"))
    top = written(level(depth), "strings")
    if depth == 3 and top.count() > few:
        depth = 2
        top = top.groupBy(F.col("key").bitwiseAND((1 << 16) - 1).alias("key")).agg(F.sum("n").alias("n"))
    found = top.orderBy("key").toArrow()
    source = counts.sparkSession.sparkContext.broadcast(tuple(found[c].to_numpy() for c in ("key", "n")))
    node = F.shiftrightunsigned("key", 8).bitwiseAND((1 << (8 * depth)) - 1).alias("node")
    rows = counts.select(node, "key", "n_train", "n_all").repartition("node").sortWithinPartitions("node")
    return rows.mapInArrow(_run_scores(order, source, depth), "key long, value double, n long")


def _floor(table: DataFrame, limit: int) -> int:
    """The least rank of frequency such that no more than `limit` rows have it or a higher one."""
    ranks = table.groupBy("rank").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rank")).collect()
    held, least = 0, 1 << 30
    for r in ranks:  # a few hundred rows: rank is eight times the logarithm of a count
        held += r["rows"]
        if held > limit:
            break
        least = r["rank"]
    return least


_TABLES: dict[str, tuple[Lookup, Lookup]] = {}


def _tables(source, name: str) -> tuple[Lookup, Lookup]:
    """The tables of a broadcast, made once in each Python worker."""
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = tuple(Lookup(*part) for part in source.value)
    return _TABLES[name]


def _score(source, name: str, order: int, end_value: float, end_known: int):
    def run(batches):
        tokens, runs = _tables(source, name)
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo, hi, data, offsets in bt.slices(batch.column(1), SLICE):
                coded = Coded(data, offsets, order)
                ids = np.arange(uid, uid + hi - lo)
                uid += hi - lo
                rare, sums, known = [], [], coded.tokens + 0
                for table, (keys, first) in ((tokens, coded.token_keys()), (runs, coded.run_keys())):
                    value = table.get(keys)
                    off = np.isnan(value)
                    row = np.repeat(np.arange(hi - lo), np.diff(first))
                    sums.append(np.bincount(row, np.where(off, 0.0, value), hi - lo))
                    if table is tokens:
                        known -= np.bincount(row[off], minlength=hi - lo)
                    at = np.lexsort((keys[off], row[off]))
                    rare.append((row[off][at], keys[off][at]))
                row, keys = (np.concatenate(x) for x in zip(*rare))
                new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])))) if len(row) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(row)))
                n = hi - lo
                main = pa.StructArray.from_arrays(
                    [
                        batch.column(0).slice(lo, n), pa.array(coded.tokens + 1), pa.array(known + end_known),
                        pa.array(sums[0] + end_value), pa.array(sums[1]),
                    ], ["doc_id", "n_tokens", "n_known", "base", "score"],
                )
                spread = (bt.mix(ids.astype(np.uint64)) >> np.uint64(2)).view(np.int64) | (1 << 61)  # no run or token has such a key
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(spread), pa.array(np.zeros(n, np.int64)), main], ["uid", "key", "times", "main"]
                )
                if len(new):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row[new]]), pa.array(keys[new]), pa.array(times), pa.nulls(len(new), main.type)], ["uid", "key", "times", "main"]
                    )

    return bt.frugal(run)


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", *, order: int = ORDER, common: int = COMMON, few: int = FEW) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows with held_out true teach nothing; null counts as false. Null and empty texts are the end mark alone. score and
    base_score are log10 probabilities of the same event, the token sequence and its end. Repeated rows each count and are each
    scored. Without training rows nothing is known: the base is that of zero counts and bytes are uniform. Other columns are ignored.
    Tokens are told apart by 63-bit hashes.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    partial = rows.select("text", (~F.col("held_out")).alias("training")).mapInArrow(_count(order), "key long, n_train long, n_all long")
    counts = written(partial.groupBy("key").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all")), "counts")
    trained = rows.where("not held_out").count()
    words = counts.where("key < 0")
    seen = words.agg(F.sum("n_train").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total = (seen["n"] or 0) + trained
    spread = total + 0.5 * (seen["v"] + (trained > 0) + 1)
    unknown = float(np.log10(0.5 / spread))

    rank = F.floor(F.log2("n") * 8).cast("int").alias("rank")
    base = words.select("key", F.log10((F.col("n_train") + 0.5) / spread).alias("value"), F.col("n_train").alias("n")).select("key", "value", rank)
    trie = written(run_scores(counts.where("key >= 0"), order, few).select("key", "value", rank), "scores")
    near, tail = [], []
    for table in (base, trie):
        least = _floor(table, common)
        found = table.where(F.col("rank") >= least).select("key", "value").toArrow()
        near.append(tuple(found[c].to_numpy() for c in ("key", "value")))
        tail.append(table.where(F.col("rank") < least).select("key", "value"))

    source = docs.sparkSession.sparkContext.broadcast(near)  # at most 2 x `common` keys, whatever the corpus
    schema = "uid long, key long, times long, main struct<doc_id: long, n_tokens: long, n_known: long, base: double, score: double>"
    parts = rows.select("doc_id", "text").mapInArrow(_score(source, uuid.uuid4().hex, order, float(np.log10((trained + 0.5) / spread)), int(trained > 0)), schema)
    value = F.col("times") * F.coalesce("value", F.when(F.col("key") < 0, unknown).otherwise(0.0))
    joined = parts.join(tail[0].unionByName(tail[1]), "key", "left").select(
        "uid", "main",
        F.when((F.col("key") < 0) & F.col("value").isNotNull(), F.col("times")).otherwise(0).alias("n_known"),
        F.when(F.col("key") < 0, value).otherwise(0.0).alias("base"),
        F.when((F.col("key") >= 0) & F.col("main").isNull(), value).otherwise(0.0).alias("score"),
    )
    summed = joined.groupBy("uid").agg(
        F.max("main.doc_id").alias("doc_id"), F.max("main.n_tokens").alias("n_tokens"),
        (F.max("main.n_known") + F.sum("n_known")).alias("n_known"),
        (F.max("main.base") + F.sum("base")).alias("base_score"), (F.max("main.score") + F.sum("score")).alias("score"),
    )
    return summed.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def crc_fold(id_col: str, folds: int, fold: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    scores = lm_scores(documents(spark, sf_dir), crc_fold("doc_id", 5, 1))
    held = F.coalesce(crc_fold("doc_id", 5, 1), F.lit(False)).alias("held_out")
    return scores.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")
