"""Quality classifier: held-out accuracy, defined results, and the sparse dot product."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tandem.llm import quality

from .edge import ROWS, frame

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = quality.op9_quality_classifier(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right >= 0.95
    assert got.agg(F.min("score") >= 0, F.max("score") <= 1).first() == (True, True)


def test_defined_results(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(1, 1), (3, 1), (7, 1), (12, 0), (13, 0), (99, 0), (5, None)], "doc_id long, quality int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == len(ROWS)
    empty = {r.score for r in rows if r.doc_id in (4, 5, 6)}
    assert len(empty) == 1
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == (r.score >= 0.7)
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {1.0}
    assert quality.quality_filter(docs, labels.limit(0)).count() == len(ROWS)
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).count() == 0


def test_scores_do_not_depend_on_neighbours(spark):
    weights = np.random.default_rng(0).normal(size=(1 << quality.BITS) + 1)
    whole = {r.doc_id: r.score for r in quality.score(frame(spark), weights).collect()}
    for i, t in [ROWS[3], ROWS[10], ROWS[13]]:
        alone = quality.score(frame(spark, [(i, t)]), weights).first().score
        assert abs(alone - whole[i]) < 1e-9


def plain_ftrl(rows, alpha=0.5, beta=1.0, l1=0.02, l2=0.02, epochs=4):
    """FTRL-proximal, a coordinate at a time, over dictionaries."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(3)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            label, x = rows[k]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - label) * v
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i]
                n[i] = old + g * g
    return weight


def test_training_and_scores_match_plain_ftrl():
    r = np.random.default_rng(8)
    rows = []
    for _ in range(150):
        index = np.unique(r.integers(0, 40, 12)).astype(np.int32)
        rows.append((float((index < 20).sum() > len(index) / 2), index, r.random(len(index)).astype(np.float32)))
    bits = 6
    got = quality.train_ftrl(rows, bits)
    want = plain_ftrl([(label, {**dict(zip(index.tolist(), value.tolist())), 64: 1.0}) for label, index, value in rows])
    assert np.allclose(got, [want(i) for i in range(65)], atol=1e-6) and (got != 0).sum() > 5


def test_scores_are_sparse_dot_products(spark):
    weights = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1)
    got = {r.doc_id: r.score for r in quality.score(frame(spark), weights).collect() if r.doc_id in (1, 7, 10)}
    for i, t in [ROWS[0], ROWS[7], ROWS[11]]:
        data = np.frombuffer(t.encode(), np.uint8)
        index, _ = quality.features(data, np.array([0, len(data)]))
        dot = sum(float(np.float32(weights[j])) * n for j, n in Counter(index.tolist()).items()) * quality.SCALE / len(index) + float(np.float32(weights[-1]))
        assert abs(got[i] - 1 / (1 + math.exp(-dot))) < 1e-5


def test_rows_are_judged_by_their_own_text(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 160)], "doc_id long, quality int")
    good, bad = "a calm sentence about the harbour and its boats", "BUY NOW $$$ !!! $$$ BUY BUY"
    rows = [(i, f"{good if i % 2 else bad} {i}") for i in range(100, 160)] + [(None, bad), (None, good), (7, bad), (7, good)]
    kept = [(r.doc_id, r.text) for r in quality.quality_filter(frame(spark, rows), labels).collect()]
    assert (None, good) in kept and (7, good) in kept and (None, bad) not in kept and (7, bad) not in kept


def test_filter_returns_whole_rows_without_a_shuffle(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 160)], "doc_id long, quality int")
    rows = [(i, f"a calm sentence about the harbour and its boats {i}" if i % 2 else f"BUY NOW $$$ !!! $$$ BUY BUY {i}") for i in range(100, 160)]
    docs = frame(spark, rows + [(1, None)])
    docs = docs.select("*", F.col("text").alias("c1"), F.lit(None).cast("string").alias("a b.c"), F.array(F.struct("key", "doc_id")).alias("held_out"),
                       F.timestamp_seconds(F.col("uid")).alias("at"), F.col("score").cast("decimal(9,3)").alias("predicted"),
                       F.to_date(F.lit("1900-01-02")).alias("day"), F.create_map("kept", "uid").alias("counts"), F.encode("text", "utf-8").alias("raw"))
    docs = docs.select("*", *[F.lit(i).alias(f"more{i}") for i in range(30)])
    got = quality.quality_filter(docs, labels)
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    scored = quality.score(docs, quality.fit(docs, labels)).collect()
    good = {r.doc_id for r in scored if r.predicted}
    assert 0 < len(good) < len(rows)
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id in good)
    assert quality.quality_filter(docs.limit(0), labels).count() == 0
