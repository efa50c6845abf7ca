"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters, of digits or of other visible characters. Hashed features are word unigrams and
bigrams, and n-grams of word shapes (case, kind, length, repetition of the word before). A document's vector is the mean of
its features, and its score a sparse dot product with the trained weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as bt
from .store import documents, numbered, renamed

BITS = 18
SAMPLE = 4000
THRESHOLD = 0.7
SCALE = 10.0

_KIND = np.full(256, 4, np.uint8)  # other visible characters
_KIND[:33] = _KIND[127] = 0
_KIND[48:58] = 3
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature indices of all rows in turn, and each row's first."""
    kind = _KIND[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    starts, ends = starts[kind[starts] > 0], ends[kind[starts] > 0]
    first = np.searchsorted(starts, offsets)
    word = bt.hash_spans(bt.LOWER[data], starts, ends)
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    length = ends - starts
    caps = upper[ends] - upper[starts]
    shape = kind[starts].astype(np.int64) * 64 + np.minimum(length, 15) * 4 * (kind[starts] != 1)
    shape += np.where(caps == 0, 0, np.where(caps == length, 1, np.where(_UPPER[data[starts]] == 1, 2, 3))) + 256 * 64 * (length > 15)
    lead = np.zeros(len(starts), bool)
    lead[first[:-1][first[:-1] < len(starts)]] = True
    prior = np.roll(word, 1)
    shape += 4096 * (~lead & (word == prior))
    form = bt.mix(shape.astype(np.uint64) + np.uint64(1))

    def back(h, k):  # the value k words before in the row, 0 before its first
        out = np.zeros_like(h)
        out[k:] = h[:-k] if len(h) > k else h[:0]
        place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        out[place < k] = 0
        return out

    odd = bt._ODD
    views = (
        word * odd[1],
        word * odd[2] + back(word, 1) * odd[3],
        form * odd[4],
        form * odd[5] + back(form, 1) * odd[6],
        form * odd[7] + back(form, 1) * odd[8] + back(form, 2) * odd[9],
    )
    index = np.stack([(bt.mix(v + odd[10 + i]) >> np.uint64(64 - bits)).astype(np.int64) for i, v in enumerate(views)], 1)
    return index.ravel(), first * len(views)


def _vectors(bits: int):
    def run(batches):
        for batch in batches:
            index, count = [], []
            for _, _, data, offsets in bt.slices(batch.column(1)):
                got, first = features(data, offsets, bits)
                for i in range(len(first) - 1):
                    i_, c_ = np.unique(got[first[i] : first[i + 1]], return_counts=True)
                    index.append(i_.astype(np.int32))
                    count.append((c_ * (SCALE / max(1, c_.sum()))).astype(np.float32))
            at = np.concatenate(([0], np.cumsum([len(x) for x in index]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(at, pa.array(np.concatenate(index), pa.int32())), pa.ListArray.from_arrays(at, pa.array(np.concatenate(count), pa.float32()))],
                ["label", "index", "value"],
            )

    return bt.frugal(run)


def train_ftrl(rows, bits: int = BITS, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4) -> np.ndarray:
    """FTRL-proximal over rows of (label, index, value); the last weight is the bias."""
    size = (1 << bits) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(3)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            label, index, value = rows[k]
            i, x = np.append(index, size - 1), np.append(value, 1.0)
            w_i = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w_i @ x, -35, 35))) - label) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w_i
            n[i] += g * g
    w[:] = weights(np.arange(size))
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample: int = SAMPLE, bits: int = BITS):
    """Weights trained on at most `sample` labelled rows (those of smallest hashed id), or None without labelled rows.

    Rows with crc32(id as text) mod 4 = 2 are held out. Labels that are null or belong to no document are left out.
    """
    key = F.col(id_col).cast("string")
    known = labels.where(F.col(label_col).isNotNull() & key.isNotNull() & (F.crc32(key) % 4 != 2))
    chosen = known.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("label")).orderBy(F.xxhash64("__id"), "__id", "label").limit(sample)
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("label", "text")
    found = rows.mapInArrow(_vectors(bits), "label double, index array<int>, value array<float>").toArrow()
    if not found.num_rows:
        return None
    found = found.combine_chunks()
    label = found["label"].to_numpy()
    parts = [(c := found[name].combine_chunks(), c.offsets.to_numpy(), c.values.to_numpy()) for name in ("index", "value")]
    (_, at, index), (_, _, value) = parts
    return train_ftrl([(label[k], index[at[k] : at[k + 1]], value[at[k] : at[k + 1]]) for k in range(len(label))], bits)


def _with_score(rows: DataFrame, weights: np.ndarray, carried: int, text_at: int, bits: int) -> DataFrame:
    """The first `carried` columns of rows, unchanged, and the score of the text (a string) in column text_at."""
    shared = rows.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    fields = [*rows.schema.fields[:carried], T.StructField("score", T.DoubleType())]
    names = [f.name for f in fields]

    def run(batches):
        w = shared.value
        for batch in batches:
            out = []
            for _, _, data, offsets in bt.slices(batch.column(text_at)):
                index, first = features(data, offsets, bits)
                total = np.concatenate(([0.0], np.cumsum(w[index], dtype=np.float64)))
                logit = (total[first[1:]] - total[first[:-1]]) * SCALE / np.maximum(1, np.diff(first)) + w[-1]
                out.append(1 / (1 + np.exp(-np.clip(logit, -35, 35))))
            score = pa.array(np.concatenate(out or [np.zeros(0)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(carried)), score], names)

    return rows.mapInArrow(bt.frugal(run), T.StructType(fields))


def score(docs: DataFrame, weights: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts have no features and get the score of the bias. Without a model (no labelled row) nothing
    speaks against a text: every score is 1. A null id is not held out. Repeated rows are each scored; other columns
    are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    if weights is None:
        return rows.select("doc_id", held, F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    scored = _with_score(rows, weights, 1, 1, bits)
    return scored.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_filter(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, bits: int = BITS
) -> DataFrame:
    """The rows of docs that the classifier accepts, columns unchanged. A row is judged by its own text, whatever its id.

    Whole rows go through the scoring, so there is no shuffle, however many rows share a text. Null and empty texts get the score
    of the bias; without labelled rows nothing is rejected.
    """
    weights = fit(docs, labels, id_col, text_col, bits=bits)
    if weights is None:
        return docs
    rows, at = numbered(docs, text_col)
    return renamed(_with_score(rows, weights, len(docs.columns), at, bits).where(F.col("score") >= threshold), docs)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
