"""What a Python worker holds: there can be more workers than cores, and idle ones stay alive with what they keep."""

import gc
import tracemalloc

import numpy as np
import pyarrow as pa

from tandem.llm import bpe, bytetext, decontaminate, near_join, quality

from .edge import frame

MB = 1 << 20


class Items:
    value = [("a", "one test item of twelve words that no text here has at all")]


def functions(spark, monkeypatch):
    """What each stage of the pipeline runs in Python over (doc_id, text_key, text) or (doc_id, text), and the place of the text."""
    caught = []
    docs = frame(spark).select("doc_id", "text")
    whole = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: caught.append(f) or whole(self, f, schema))
    quality._with_score(docs, np.zeros((1 << quality.BITS) + 1), 2, 1, quality.BITS)
    bpe.encode_decode(docs, bpe.public_model())
    of_size = near_join.visited(near_join.THRESHOLD, near_join.TREES, near_join.MAX_DEPTH, near_join.RECALL)
    return {
        "quality": (caught[0], 1),
        "signatures": (near_join._signatures(5, 32, 8, sorted(set().union(*of_size), reverse=True), of_size), 2),
        "contamination": (decontaminate._scan(Items, 10, 2, 1, ["c0", "c1", *decontaminate.RESULT]), 1),
        "bpe": (caught[1], 1),
    }


def test_a_worker_holds_little_and_keeps_nothing(spark, monkeypatch):
    r = np.random.default_rng(4)
    words = np.array([f"w{i}x" for i in range(300)])
    texts = [" ".join(words[r.integers(0, 300, 420)]) for _ in range(4000)]
    for name, (run, text_at) in functions(spark, monkeypatch).items():
        columns = [pa.array([str(i) if i else "" for i in range(4000)]) for _ in range(text_at)] + [pa.array(texts)]
        batch = pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])
        assert 7 * MB < batch.nbytes < 10 * MB
        gc.collect()
        models = sum(isinstance(o, bpe.WordBpe) for o in gc.get_objects())
        tracemalloc.start()
        for out in run(iter([batch])):
            assert out.num_rows
        out = None
        kept, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert kept < 4 * MB, (name, kept)
        assert peak < 120 * MB, (name, peak)
        assert sum(isinstance(o, bpe.WordBpe) for o in gc.get_objects()) == models, name
        assert len(bytetext._POWERS) == len(bytetext._INVERSE) == 1, name


def test_powers_grow_again_after_a_release():
    data, offsets = np.frombuffer(b"one two three one", np.uint8), np.array([0, 17])
    before, _ = bytetext.words(data, offsets)
    bytetext.release()
    after, _ = bytetext.words(data, offsets)
    assert (before == after).all() and after[0] == after[3] != after[1]
