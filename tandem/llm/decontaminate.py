"""Benchmark decontamination: every suffix of the test items is looked up in suffix arrays of the training text.

The training text is read in shards (runs of whole documents). A shard's suffix array holds the word positions
at which a test window could begin, sorted by their next ten words; a binary search places every test suffix in
it, the hits are followed on to the longest verbatim match, and the documents and locations come back with the
row they stand in. The test items are broadcast if they fit a block of bounded size, and nothing is shuffled. More items are
looked up a block at a time, each in a pass of its own over the training text, and only hits are written and merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as bt
from .store import documents, numbered, renamed, text_key, written

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 1 << 20


class TestItems:
    """One block of test items as word ids over their own vocabulary, 0 standing between items."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        self.window, self.names = window, [name for name, _ in rows]
        text = pa.array([text for _, text in rows], pa.large_string())
        word_ids, items, starts, lengths = [], [], [], []
        hashed = []
        for lo, hi, data, offsets in bt.slices(text):
            hashes, first = bt.words(data, offsets)
            hashed += [(item, hashes[first[i] : first[i + 1]]) for i, item in enumerate(range(lo, hi))]
        self.vocabulary = np.unique(np.concatenate([h for _, h in hashed] or [np.zeros(0, np.uint64)]))
        at = 0
        for item, hashes in hashed:
            n = len(hashes)
            if n:
                begin = np.arange(max(1, n - window + 1))
                starts.append(at + begin)
                lengths.append(np.full(len(begin), min(n, window)))
                items.append(np.full(len(begin), item))
            word_ids.append(np.append(np.searchsorted(self.vocabulary, hashes) + 1, 0))
            at += n + 1
        none = np.zeros(0, np.int64)
        self.words = np.concatenate([*word_ids, np.zeros(window, np.int64)]).astype(np.int64)
        self.starts, self.lengths, self.items = (np.concatenate(x or [none]) for x in (starts, lengths, items))
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary ids of word hashes, 0 for words that no test item has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def packed(self, matrix: np.ndarray) -> list[np.ndarray]:
        """Rows of word ids as few sortable columns."""
        per, out = max(1, 63 // self.bits), []
        for at in range(0, matrix.shape[1], per):
            key = np.zeros(len(matrix), np.int64)
            for j in range(at, min(at + per, matrix.shape[1])):
                key = (key << self.bits) | matrix[:, j]
            out.append(key)
        return out


def _search(columns: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of each wanted row in sorted columns, all rows at once."""
    low = np.zeros(len(wanted[0]), np.int64)
    high = np.full(len(wanted[0]), len(columns[0]), np.int64)
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high) >> 1, 0)
        less, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
        for column, value in zip(columns, wanted):
            less |= equal & (column[mid] < value)
            equal &= column[mid] == value
        up = open_ & ((less | equal) if right else less)
        low, high = np.where(up, mid + 1, low), np.where(open_ & ~up, mid, high)
    return low


def find(test: TestItems, hashes: np.ndarray, first: np.ndarray):
    """Matches of test windows in a shard: word position, test suffix, longest verbatim length (in words)."""
    none = np.zeros(0, np.int64)
    if not len(test.starts) or not len(hashes):
        return none, none, none
    ids = test.ids(hashes)
    at = np.arange(len(ids))
    unknown = np.append(np.flatnonzero(ids == 0), len(ids))
    ends = np.append(first[1:], len(ids))
    reach = np.minimum(unknown[np.searchsorted(unknown, at)], ends[np.searchsorted(ends, at, "right")]) - at
    suffix = np.flatnonzero(reach >= test.lengths.min())
    if not len(suffix):
        return none, none, none
    step = np.arange(test.window)
    padded = np.append(ids, np.zeros(test.window, np.int64))
    keys = test.packed(np.where(step < reach[suffix, None], padded[suffix[:, None] + step], 0))
    order = np.lexsort(keys[::-1])
    suffix, keys = suffix[order], [k[order] for k in keys]
    own = test.words[test.starts[:, None] + step]
    inside = step < test.lengths[:, None]
    low = _search(keys, test.packed(np.where(inside, own, 0)), False)
    high = _search(keys, test.packed(np.where(inside, own, (1 << test.bits) - 1)), True)
    count = high - low
    position, which = suffix[bt.gather(low, count)], np.repeat(np.arange(len(count)), count)
    length = test.lengths[which].copy()
    going = np.arange(len(position))
    while len(going):  # follow each match on beyond its window
        ahead, there = position[going] + length[going], test.starts[which[going]] + length[going]
        same = (length[going] < reach[position[going]]) & (padded[np.minimum(ahead, len(ids))] == test.words[np.minimum(there, len(test.words) - 1)])
        going = going[same]
        length[going] += 1
    return position, which, length


def _scan(items, window: int, carried: int, text_at: int, names_out: list[str]):
    def run(batches):
        test = TestItems(items.value, window)
        names = np.array(test.names, object)
        for batch in batches:
            counts, edges, spans, item_rows, item_edges, best = [], [0], [], [], [0], []
            for lo, hi, data, offsets in bt.slices(batch.column(text_at), SHARD_BYTES):
                hashes, first = bt.words(data, offsets)
                position, which, length = find(test, hashes, first)
                row = np.searchsorted(first, position, "right") - 1
                order = np.lexsort((position, row))
                position, which, length, row = (x[order] for x in (position, which, length, row))
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                counts.append(np.diff(first))
                for i in range(hi - lo):
                    a, b = edge[i], edge[i + 1]
                    if a < b:  # few rows have a hit
                        start = position[a:b] - first[i]
                        ends = np.maximum.accumulate(start + test.lengths[which[a:b]])
                        fresh = np.concatenate(([True], start[1:] > ends[:-1]))
                        spans.append(np.stack((start[fresh], ends[np.append(np.flatnonzero(fresh)[1:] - 1, len(ends) - 1)]), 1).ravel())
                        own = sorted({*names[np.unique(test.items[which[a:b]])]})
                        item_rows += own
                        top = a + int(np.lexsort((which[a:b], start, -length[a:b]))[0])
                        best.append((int(length[top]), int(position[top] - first[i]), test.names[test.items[which[top]]]))
                        edges.append(edges[-1] + len(spans[-1]))
                        item_edges.append(item_edges[-1] + len(own))
                    else:
                        best.append((0, None, None))
                        edges.append(edges[-1])
                        item_edges.append(item_edges[-1])
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(carried)), pa.array(np.concatenate(counts or none).astype(np.int64)), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(spans or none).astype(np.int64))),
                    pa.ListArray.from_arrays(pa.array(item_edges, pa.int32()), pa.array(item_rows, pa.string())),
                    pa.array([x[0] for x in best], pa.int64()), pa.array([x[1] for x in best], pa.int64()), pa.array([x[2] for x in best], pa.string()),
                ], names_out,
            )

    return bt.frugal(run)


RESULT = {"n_words": "long", "spans": "array<long>", "items": "array<string>", "longest": "long", "longest_start": "long", "longest_item": "string"}
_PAIRS = "array_sort(flatten(transform(parts, p -> transform(sequence(0, cast(size(p.spans) / 2 as int) - 1), i -> named_struct('s', p.spans[2 * i], 'e', p.spans[2 * i + 1])))))"
_JOINED = (  # the ranges in order, those that touch made one
    f"aggregate({_PAIRS}, cast(array() as array<bigint>), (a, x) -> if(size(a) > 0 and x.s <= element_at(a, -1), "
    "concat(slice(a, 1, size(a) - 1), array(greatest(element_at(a, -1), x.e))), concat(a, array(x.s, x.e))))"
)


def _found(texts: DataFrame, block: list[tuple[str, str]], window: int, carried: int = 1, text_at: int = 1) -> DataFrame:
    """The first `carried` columns of texts, unchanged, and RESULT for the text (a string) in column text_at."""
    source = texts.sparkSession.sparkContext.broadcast(block)
    fields = [*texts.schema.fields[:carried], *T.StructType.fromDDL(", ".join(f"{k} {t}" for k, t in RESULT.items())).fields]
    return texts.mapInArrow(_scan(source, window, carried, text_at, [f.name for f in fields]), T.StructType(fields))


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_bytes: int):
    """How many blocks the items make, and a function that collects one, of about block_bytes."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.col(item_text_col).cast("string").alias("text")
    ).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))

    def block(k: int) -> list[tuple[str, str]]:
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        return [(r["id"], r["text"]) for r in part.orderBy("id", "text").collect()]

    return blocks, block


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_words, spans, items, longest, longest_start, longest_item.

    spans lists the hit word ranges, disjoint and in order, as start, end, start, end, ...; items the sorted
    distinct ids of the items with a window in the text; longest the words of the longest verbatim match, its start in the
    document and its item (the first in the text, then in the items, of equal ones). A window is `window` consecutive words of an
    item; a shorter item is one window; an item without words, or with a null text, has none. A null item id counts as
    the empty string. Null and empty texts have no words and no hits; very long texts are searched whole. Repeated rows and items are
    each looked at; repeated ids of items count once. An empty benchmark hits nothing, an empty table has no rows. Other columns are
    ignored. Words are compared by 64-bit hashes, and texts met in several blocks are known by SHA-256.
    """
    blocks, block = _blocks(benchmark, item_col, item_text_col, block_bytes)
    text = F.col(text_col).cast("string").alias("text")
    if blocks == 1:
        return _found(docs.select(F.col(id_col).alias("doc_id"), text), block(0), window)
    key = text_key(F.col(text_col))
    texts, hits = docs.select(key.alias("doc_id"), text), None
    for k in range(blocks):
        own = written(_found(texts, block(k), window).where("size(spans) > 0").drop("n_words"), "hits").withColumn("block", F.lit(k))
        hits = own if hits is None else hits.unionByName(own)
    parts = hits.dropDuplicates(["doc_id", "block"]).groupBy(F.col("doc_id").alias("__key")).agg(F.collect_list(F.struct("spans", "items", "longest", "longest_start", "longest_item")).alias("parts"))
    top = F.expr("array_min(transform(parts, p -> named_struct('n', -p.longest, 'longest_start', p.longest_start, 'longest_item', p.longest_item)))")
    merged = parts.select(
        "__key", F.expr(_JOINED).alias("spans"), F.expr("array_sort(array_distinct(flatten(transform(parts, p -> p.items))))").alias("items"), top.alias("top")
    )  # a text has at most one part a block
    n_words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long").alias("n_words")
    return docs.select(F.col(id_col).alias("doc_id"), key.alias("__key"), n_words).join(merged, "__key", "left").select(
        "doc_id", "n_words", F.coalesce("spans", F.array().cast("array<long>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(-F.col("top.n"), F.lit(0)).cast("long").alias("longest"), "top.longest_start", "top.longest_item",
    )


def flagged(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """contamination() with n_hit, n_items, items_sha256 and contaminated derived from its spans and items."""
    n = F.size("spans")
    return contamination(docs, benchmark, **options).select(
        "doc_id",
        "n_words",
        F.expr(
            "aggregate(spans, named_struct('total', 0L, 'sign', -1L), "
            "(a, x) -> named_struct('total', a.total + a.sign * x, 'sign', -a.sign), a -> a.total)"
        ).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n > 0).alias("contaminated"),
        "longest",
        "longest_start",
        "longest_item",
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", *, item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of docs without any hit, columns unchanged. A row is judged by its own text, whatever its id.

    Against one block of items whole rows go through the search and nothing is shuffled; against more, the texts with a hit in
    any block are known by SHA-256 and their rows removed by a join. Null and empty texts stay.
    """
    blocks, block = _blocks(benchmark, item_col, item_text_col, block_bytes)
    if blocks == 1:
        rows, at = numbered(docs, text_col)
        return renamed(_found(rows, block(0), window, len(docs.columns), at).where("size(spans) = 0"), docs)
    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    found = contamination(texts, benchmark, "key", item_col=item_col, item_text_col=item_text_col, window=window, block_bytes=block_bytes)
    hit = found.where("size(spans) > 0").select(F.col("doc_id").alias("__hit")).distinct()
    keyed = docs.withColumn("__text_key", text_key(F.col(text_col)))
    return keyed.join(hit.hint("shuffle_hash"), F.col("__text_key") == F.col("__hit"), "left_anti").drop("__text_key")


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return flagged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, id, i, spots.n AS n FROM spots JOIN windows ON spots.g = windows.g AND spots.n = windows.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
