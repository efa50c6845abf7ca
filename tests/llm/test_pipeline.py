"""The pipeline's stages against brute force, and what registration promises."""

import hashlib

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tandem.llm import quality

from .edge import ROWS
from .test_decontaminate import ITEMS
from .test_decontaminate import brute as leaks
from .test_exact_dedup import brute as equal
from .test_near_join import shingle_set


JUNK = "BUY NOW !!! $$$ CLICK $$$ !!!"


def test_stages_match_brute_force(spark, tmp_path):
    more = [(2, "a unique text under a repeated id"), (30, "same words here"), (31, "same  words here"), (31, "same words here")]
    taught = [(i, f"{JUNK} {i}" if i % 2 else f"a calm sentence about the harbour and its {i} boats") for i in range(100, 180)]
    rows = ROWS + more + taught + [(40, f"{JUNK} {JUNK} forty"), (None, f"{JUNK} without an id")]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    # whatever a brute-force test below calls good is labelled so
    labels = [(i, 0 if i % 2 else 1) for i, _ in taught] + [(i, 1) for i, _ in ROWS if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, t) for i, t in ITEMS], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.read.parquet(str(tmp_path / "labels.parquet"))
    scored = quality.score(docs.withColumn("row", F.struct("doc_id", "text")), quality.fit(docs, table), "row").collect()
    kept = sorted(((r.doc_id.doc_id, r.doc_id.text) for r in scored if r.predicted), key=str)
    assert 0 < len(kept) < len(rows) and not any((t or "").startswith(JUNK) for _, t in kept) and all(r in kept for r in more)
    kept = [r for r, judged in zip(kept, equal(kept)) if judged[3]]
    kept = representatives(kept)
    kept = [r for r, judged in zip(kept, leaks(kept, ITEMS)) if not judged[5]]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in kept), key=str)
    assert {r.doc_id: r.n_tokens for r in got}[4] == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def representatives(rows):
    """One row of each class of near-duplicates: of the smallest id, then of the smallest digest of the text."""
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                label = [label[i] if x == label[j] else x for x in label]
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.sha256((rows[i][1] or "").encode()).hexdigest(), i)
    return [rows[i] for i in range(len(rows)) if i == min((j for j in range(len(rows)) if label[j] == label[i]), key=order)]


def test_registered_queries():
    names = __spark_entry__.queries()
    assert [n for n in names if n.startswith("op")] and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names) and all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
